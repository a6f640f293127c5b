import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.llm import mixing
from tests.llm.cases import PROSE, ROWS, documents, empty, odd


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def targets(sizes, weights, factor, epochs):
    """Clamp and reshare until no source is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    rest, share, done = set(names), factor * sum(sizes.values()), {}
    while rest:
        whole = sum(weight[s] for s in rest)
        left = share - sum(done.values())
        above = [s for s in rest if left * weight[s] / whole > epochs * sizes[s]]
        if not above:
            return done | {s: left * weight[s] / whole for s in rest}
        for s in above:
            done[s] = epochs * sizes[s]
            rest.remove(s)
    return done


@pytest.mark.parametrize("weights,factor,epochs", [([5, 2, 1], 1.5, 2.0), ([1], 0.5, 1.0), ([9, 1], 3.0, 2.0)])
def test_targets_and_takes(spark, sf, weights, factor, epochs):
    docs = documents(spark, sf)
    sizes = Counter()
    for r in docs.collect():
        sizes[r["source"]] += len(words(r["text"]))
    want = targets(sizes, weights, factor, epochs)
    rows = mixing.mix(docs.withColumn("src", F.col("source")), weights, factor, epochs, carry=["src"]).collect()
    taken, of = Counter(), {r["doc_id"]: r for r in rows}
    for r in docs.collect():
        g = of[r["doc_id"]]
        assert g["size"] == len(words(r["text"])) and g["source_size"] == sizes[r["source"]]
        assert g["target"] == pytest.approx(want[r["source"]]) and 0 <= g["taken"] <= epochs * g["size"]
        taken[r["source"]] += g["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)  # to a word for each bucket


def test_reruns_agree_and_seeds_differ(spark, sf):
    docs = documents(spark, sf)

    def takes(d, seed):
        return sorted((r["doc_id"], r["taken"]) for r in mixing.mix(d, [5, 2, 1], seed=seed).collect())
    assert takes(docs, 7) == takes(docs.repartition(5), 7) != takes(docs, 8)


def test_expanded_texts_hold_the_words_taken(spark, sf):
    docs = documents(spark, sf)
    mixed = mixing.mix(docs, [5, 2, 1], carry=["doc_id", "text"])
    want = {r["doc_id"]: r["taken"] for r in mixed.collect()}
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = Counter()
    for r in mixing.expand(mixed, ["doc_id", "text"]).collect():
        got[r["doc_id"]] += len(words(r["text"]))
        assert text[r["doc_id"]].startswith(r["text"])
    assert {k: v for k, v in want.items() if v} == {k: v for k, v in got.items() if v}


def test_parts_are_cut_after_a_word(spark):
    rows = [("  a b\n\nc  ", n) for n in (1, 2, 3)] + [("x\ty", 1), ("x\ty", 2)]
    df = spark.createDataFrame(rows, "t string, n long").select(mixing.first_words("t", "n").alias("c"))
    got = [r["c"] for r in df.collect()]
    assert [g.rstrip() for g in got] == ["  a", "  a b", "  a b\n\nc", "x", "x\ty"]


def test_odd_rows(spark):
    rows = mixing.mix(odd(spark), [5, 2, 1], carry=["text", "doc_id"])
    got = rows.collect()
    assert len(got) == len(ROWS)
    assert Counter(r["size"] for r in got) == Counter(len(words(r[1])) for r in ROWS)
    assert mixing.expand(rows, ["doc_id", "text"]).count() >= 1
    assert mixing.mix(empty(spark), [5, 2, 1]).count() == 0
    blank = odd(spark, [(1, None, None, None, 0), (2, "", "x", "s", 0)])
    assert [r["taken"] for r in mixing.mix(blank, [5, 2, 1]).collect()] == [0, 0]
    same = odd(spark, [(1, PROSE, "en", "a", 1)] * 40)
    assert abs(sum(r["taken"] for r in mixing.mix(same, [1], 1.5).collect()) - 1.5 * 40 * 19) <= 1
