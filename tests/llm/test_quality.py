import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import quality as Q
from tests.llm.cases import LONG, PROSE, ROWS, documents, empty, odd


def counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(w, w[1:], w[2:]))
    again = {i + d for i in range(len(w) - 2) if windows[w[i], w[i + 1], w[i + 2]] > 1 for d in range(3)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again))


def test_counts_equal_brute_force(spark, sf):
    texts = [r["text"] for r in documents(spark, sf).collect()]
    texts += ["a b c a b c", "a a a", "a a a a", "x\ny\nx\n \n\t\n", "| a || b", "a\xa0b\u2003c\x85d", "é\x0be\x0cf\rg", LONG, "\n\n",
              None, "", "a b c d a b c"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in Q.text_statistics(df, ["doc_id"]).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counts(
            texts[r["doc_id"]]), texts[r["doc_id"]]


def mcd(x, floors, core=Q.CORE):
    """The same estimate in numpy, one group at a time."""
    x, ridge = np.asarray(x), np.diag(np.square(floors))
    middle = np.percentile(x, 50, axis=0, method="inverted_cdf")
    spread = np.maximum(1.4826 * np.percentile(np.abs(x - middle), 50, axis=0, method="inverted_cdf"), floors)
    cov = np.diag(spread ** 2)
    for _ in range(Q.ROUNDS):
        d = np.einsum("ij,jk,ik->i", x - middle, np.linalg.inv(cov), x - middle)
        near = x[d <= np.percentile(d, 100 * core, method="inverted_cdf")]
        before = np.linalg.slogdet(cov)[1]
        middle, cov = near.mean(0), np.cov(near.T, bias=True) + ridge
        if abs(np.linalg.slogdet(cov)[1] - before) / 2 < 1e-3:
            break
    d = np.einsum("ij,jk,ik->i", x - middle, np.linalg.inv(cov), x - middle)
    return d / max(1.0, np.percentile(d, 50, method="inverted_cdf") / Q.chi_square_quantile(0.5, x.shape[1]))


def test_distances_equal_numpy(spark):
    rng = np.random.default_rng(4)
    rows = []
    for g, n in (("a", 300), (None, 120), ("c", 2), ("d", 1)):
        base = rng.multivariate_normal([0, 1, 2, 3], np.diag([1, 2, 3, 4]) + 0.7, n)
        base[: n // 10] += 40
        rows += [(g, "s", *map(float, v)) for v in base]
    df = spark.createDataFrame(rows, "lang string, source string, " + ", ".join(f"{n} double" for n in Q.STATS))
    got = Q.robust_distances(df, ["lang", "source"], Q.STATS, F.lit(True)).collect()
    for g in ("a", None, "c", "d"):
        own = [r for r in got if r["lang"] == g]
        want = mcd([[r[n] for n in Q.STATS] for r in own], Q.FLOORS)
        assert np.allclose([r["distance"] for r in own], want, rtol=0.02, atol=1e-6)
    far = sorted((r["distance"] for r in got if r["lang"] == "a"), reverse=True)
    assert min(far[:30]) > 10 * max(far[30:])  # the shifted tenth does not hide itself


def test_junk_goes_and_prose_stays(spark):
    rows = [(i, f"{PROSE}{i} seen from hill number {i}. " + " ".join(f"word{i % 7}{j}" for j in range(60)), "en", "s") for i in range(60)]
    junk = [(1000 + i, " ".join(f"wo#{i}##$%&{j}*** |||<>" for j in range(80)), "en", "s") for i in range(8)]
    df = spark.createDataFrame(rows + junk, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["kept"] for r in Q.judge(df).collect()}
    assert all(got[i] for i in range(60)) and not any(got[1000 + i] for i in range(8))


def test_base_and_odd_rows(spark):
    got = Q.judge(odd(spark)).collect()
    assert len(got) == len(ROWS)
    text = {r[0]: r[1] for r in ROWS}
    for r in got:
        c = counts(text[r["doc_id"]])
        failed = c[0] < 50 or 100 * c[4] > 50 * c[0]
        assert (r["n_words"], r["n_repeat_words"], r["base_failed"]) == (c[0], c[4], failed)
        assert not (failed and r["kept"]) and r["kept"] is not None
    assert Q.judge(empty(spark)).count() == 0


def test_chi_square_quantiles():
    for share, p, known in ((0.5, 4, 3.357), (0.95, 4, 9.488), (0.999, 4, 18.467), (0.95, 2, 5.991)):
        assert Q.chi_square_quantile(share, p) == pytest.approx(known, rel=0.02)


def test_exact_quantiles_far_out():
    for share, p, known in ((0.999, 4, 18.4668), (0.9999, 4, 23.5127), (1 - 1e-9, 4, 47.8795), (0.95, 1, 3.84146), (0.95, 3, 7.81473)):
        assert Q.chi_square_quantile(share, p) == pytest.approx(known, rel=1e-5)


def test_moderate_junk_goes(spark):
    rng = np.random.default_rng(6)

    def prose(lines=10):
        return ["".join(rng.choice(list("abcdefghij"), 3)) + " " + " ".join(
            "".join(rng.choice(list("klmnopqrst"), rng.integers(2, 9))) for _ in range(12)) for _ in range(lines)]

    def symbols(per_word):
        words = "\n".join(prose()).split(" ")
        return " ".join(w + "#" * int(rng.random() < per_word) for w in words)

    clean = ["\n".join(prose(int(rng.integers(8, 20)))) for _ in range(120)]
    lines = [prose(8) for _ in range(4)]
    junk = [symbols(x) for x in (0.3, 0.4, 0.5, 0.6, 0.8, 1.0)] + ["\n".join(y + "\nmenu" for y in x) for x in lines]
    rows = [(i, t, "en", "s") for i, t in enumerate(clean + junk)]
    got = {r["doc_id"]: r for r in Q.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert sum(got[i]["kept"] for i in range(120)) >= 118
    assert not any(got[120 + i]["kept"] for i in range(len(junk)))
    assert not any(r["base_failed"] for r in got.values())


def test_small_groups_are_judged_by_larger_ones(spark):
    rng = np.random.default_rng(7)

    def prose():
        return "\n".join(" ".join("".join(rng.choice(list("abcdefghijklmnopqrst"), rng.integers(2, 9))) for _ in range(12))
                         for _ in range(10))

    def junk():
        return " ".join(w + "##$%" for w in prose().split())

    rows = [(i, prose(), "en", "large") for i in range(60)]
    rows += [(100, prose(), "en", "tiny"), (101, prose(), "en", "tiny"), (102, junk(), "en", "tiny"),
             (103, junk(), "en", "alone"), (104, prose(), None, None), (105, junk(), "xx", None),
             (106, "too short", "yy", "none pass")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in Q.judge(df).collect()}
    assert len(got) == len(rows)
    assert [got[i]["kept"] for i in range(100, 107)] == [True, True, False, False, True, False, False]
    assert sum(got[i]["kept"] for i in range(60)) >= 59


@pytest.mark.parametrize("sizes, levels", [
    ({("a", "p"): 40, ("a", "q"): 5, ("b", "p"): 30}, {("a", "q"): 1}),
    ({("a", "p"): 12, ("a", "q"): 12, ("b", "p"): 3, (None, None): 2}, {("a", "p"): 1, ("a", "q"): 1, ("b", "p"): 2, (None, None): 2}),
    ({("a", "p"): 3, (None, "p"): 2}, {("a", "p"): 2, (None, "p"): 2})])
def test_levels_and_distances_equal_numpy(spark, sizes, levels):
    rng = np.random.default_rng(8)
    rows = [(g, s, *map(float, rng.normal([0, 1, 2, 3], 1.5))) for (g, s), n in sizes.items() for _ in range(n)]
    df = spark.createDataFrame(rows, "lang string, source string, " + ", ".join(f"{n} double" for n in Q.STATS))
    got = Q.sized_distances(df, ("lang", "source"), Q.STATS, F.lit(True)).collect()
    assert len(got) == len(rows)

    def estimate(judges):
        """Distances of the rows that ``judges`` accepts, by their values."""
        own = [r[2:] for r in rows if judges(r)]
        return dict(zip(own, mcd(own, Q.FLOORS)))

    for group in sizes:
        level = levels.get(group, 0)
        by = estimate((lambda r: r[:2] == group, lambda r: r[0] == group[0], lambda r: True)[level])
        for r in got:
            if (r["lang"], r["source"]) == group:
                assert r["level"] == level
                assert r["distance"] == pytest.approx(by[tuple(r[n] for n in Q.STATS)], rel=0.02, abs=1e-6)
