import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import pii
from tests.llm.cases import LONG, ROWS, documents, empty, odd


@pytest.fixture(scope="module")
def learnt(spark, sf):
    return pii.train(documents(spark, sf.replace("sf0.001", "sf0.01")).select("doc_id", "text"))


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base(text):
    found = []
    for kind, pattern in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
                                    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+",
                                    r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if (kind == 0 or kind == 1 and all(int(p) <= 255 for p in m.group().split("."))
                    or kind == 2 and 12 <= len(digits) <= 19 and luhn(digits) or kind == 3 and 9 <= len(digits) <= 15):
                found.append((m.start(), kind, m.end()))
    return sorted(found)


ALPHABET = ["a", "b", "@", ".", "-", "_", "+", "1", "2", "25", "255", "256", "007", " ", "(", ")", "é", "🙂", "%", "\n",
            "4111111111111111", "+1 (555) 555-0100", "x@y.z", "1.2.3.4", "4012 8888 8888 1881", "me@mail1.example.com"]


def spans(rows):
    return sorted((r["s"], r["kind"], r["e"]) for r in rows)


def test_base_equals_brute_force(spark, sf):
    r = random.Random(5)
    texts = ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 25))) for _ in range(1500)]
    texts += [x["text"] for x in documents(spark, sf).collect()] + [None, "", LONG, "1.2.3.4 " * 3000, "a" * 50_000 + "@b.c",
                                                                     "1" * 20_000, "+1" + " 2" * 6]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    model = pii.train(df)
    for row in pii.with_spans(df, model).collect():
        want = base(row["text"])
        assert spans(row["base"]) == want, row["text"][:200]
        assert set(want) <= set(spans(row["spans"]))


def test_numbers_run_together_are_found(spark, learnt):
    model = learnt
    cases = ["see +1 (269) 555-3296 4111111111111111 there", "at 4111111111111111 4012888888881881 now", "plain 12345 words 2.0"]
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r["doc_id"]: [cases[r["doc_id"]][s["s"]:s["e"]] for s in r["spans"]] for r in pii.with_spans(df, model).collect()}
    assert got == {0: ["+1 (269) 555-3296", "4111111111111111"], 1: ["4111111111111111", "4012888888881881"], 2: []}


def test_digest(spark):
    text = "mail me@x.org or 10.0.0.1"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = pii.with_spans(df, pii.train(df)).select(pii.span_text("base").alias("t"), F.sha2(pii.span_text("base"), 256).alias("h")).first()
    assert row["t"] == "email:5:13,ip:17:25" and row["h"] == hashlib.sha256(row["t"].encode()).hexdigest()


def test_redaction(spark):
    text = "é🙂 me@x.org, +1 (555) 555-0100 and 10.0.0.1; card 4111 1111 1111 1111!"
    df = spark.createDataFrame([(1, text, "k"), (2, None, "k"), (3, "nothing here", "k")], "doc_id long, text string, spans string")
    got = {r["doc_id"]: r for r in pii.redact(df.drop("spans"), pii.train(df)).collect()}
    assert got[1]["text"] == "é🙂 <EMAIL>, <PHONE> and <IP>; card <CARD>!"
    assert got[2]["text"] is None and got[3]["text"] == "nothing here"


def test_trees_learn_and_sql_agrees(spark):
    rng = np.random.default_rng(1)
    x = np.unique(rng.integers(0, 4, (600, len(pii.FEATURES))), axis=0)
    truth = (x[:, 1] > 1) & (x[:, 4] < 3)
    positive, negative = np.where(truth, 9.0, 0.0), np.where(truth, 0.0, 5.0)
    model = pii.boost(x, positive, negative)
    pii.calibrate(model, x, positive, negative, 0.95)
    assert ((model.probability(x) > 0.5) == truth).all()
    df = spark.createDataFrame([tuple(map(int, r)) for r in x], ", ".join(f"{f} int" for f in pii.FEATURES))
    odds = df.select(F.struct(*pii.FEATURES).alias("f"), *pii.FEATURES).select(
        F.expr(model.sql("f")).alias("o"), *pii.FEATURES).collect()
    for r in odds:
        p = model.probability(np.array([[r[f] for f in pii.FEATURES]]))[0]
        assert 1 / (1 + np.exp(-r["o"])) == pytest.approx(p, rel=1e-6)
    pii.calibrate(model, x, positive * 0, negative, 0.95)
    assert model.thresholds == [1.0] * 4 or all(t >= 0.5 for t in model.thresholds)


def test_odd_rows(spark):
    got = pii.find(odd(spark)).collect()
    assert len(got) == len(ROWS) and all(r["base"] == [] for r in got)
    assert pii.find(empty(spark)).count() == 0


# ------------------------------------------- the whole method, text by text

WIDE = [(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 0),
        (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+ ?(\(at\)|\[at\]) ?[A-Za-z0-9-]+( ?(\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]+)+", 0),
        (r"(?<![0-9.])[0-9]{1,3}(\.[0-9]{1,3}){3}(?![0-9])(?!\.[0-9])", 1),
        (r"(?<![0-9A-Fa-f:])([0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])", 1),
        (r"(?<![0-9A-Za-z])([0-9]{12,19}|[0-9]{4}([ .-][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z])", 2),
        (r"(?<![0-9A-Za-z+])(\+[0-9]{1,3}[ .-]?)?(\([0-9]{2,4}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])", 3),
        (r"(?<![0-9])[0-9]{7,19}(?![0-9])", 3)]


def passes(kind, x):
    digits = re.sub("[^0-9]", "", x)
    if kind == 0:
        return re.search("[A-Za-z]{2,}$", x) is not None
    if kind == 1:
        return ":" in x or all(int(p) <= 255 for p in x.split("."))
    return 12 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 9 <= len(digits) <= 15


def features(text, start, end, kind):
    x, digits = text[start:end], re.sub("[^0-9]", "", text[start:end])
    groups = len(re.findall("[0-9A-Za-z]+", x))
    seps = [c for c in " -." if c in x]
    first = re.search("[0-9A-Za-z]", x).group()
    between = text[max([0, *[e for s, e in spots(text, start, kind)]]):start][-24:]

    def side(c):
        return 0 if c == "" or c in " \t\n\x0b\x0c\r" else 1 if c.isalpha() or c in "0123456789" else 2
    cues = list(re.finditer(rf"(?i)(?<![^\W_])(?:({pii.CUES[kind]})|({pii.OTHER_CUE}))(?![^\W_])", between))
    return (kind, sum(len(digits) >= n for n in (7, 9, 12, 16)), sum(groups >= n for n in (2, 4, 6)), int("(" in x),
            4 if len(seps) > 1 else {"": 0, " ": 1, "-": 2, ".": 3}["".join(seps)],
            0 if first in "01" else 1 if first in "23456789" else 2, int(len(set(digits)) > 3), side(between[-1:]),
            side(text[end:end + 1]), 0 if not cues else 1 if cues[-1].group(1) else 2)


SPOTS = {}


def spots(text, start, kind):
    """Matches of the same generator before a start: what is beside a match ends there."""
    return [x for x in SPOTS.get((text, start), ()) if x[1] <= start]


def whole_method(text, model):
    sure = base(text)
    found = []
    for g, (pattern, kind) in enumerate(WIDE):
        places = [m.span() for m in re.finditer(pattern, text)]
        for s, e in places:
            if passes(kind, text[s:e]) and not any(s < y and x < e for x, _, y in sure):
                SPOTS[(text, s)] = places
                row = np.array([features(text, s, e, kind)])
                if model.probability(row)[0] >= model.thresholds[kind] - 1e-9:
                    found.append((float(model.raw(row)[0]), e - s, -s, kind))
    best = [a for a in found if not any(b[3] == a[3] and -b[2] < -a[2] + a[1] and -a[2] < -b[2] + b[1]
                                        and (round(b[0], 6), *b[1:3]) > (round(a[0], 6), *a[1:3]) for b in found)]
    return sorted(set(sure) | {(-c, k, b - c) for _, b, c, k in best})


WORDS = ["phone", "order", "card", "isbn", "mail", "call", "id", "server", "the", "x.", "see", "no", "tel:", "(", ")", "a@b.cd", "10.0.0.1",
         "300.1.1.1", "4111111111111111", "4111.1111.1111.1111", "4111 1111 1111 1112", "5551234567", "555-123-4567", "(555) 123-4567",
         "+1 (555) 555-0100", "+1 555 555-0100 4111111111111111", "20240101123", "ann (at) mail (dot) org", "bo[at]x.y", "1:2:3:4:5:6:7:8",
         "1234567", "é", "🙂", "5551234567@x.org", "12345678901234567890", "4012 888888 81881"]


def test_added_spans_equal_brute_force(spark, learnt):
    r = random.Random(11)
    texts = [" ".join(r.choice(WORDS) for _ in range(r.randint(1, 9))) for _ in range(1200)]
    texts += ["".join(r.choice(WORDS) for _ in range(r.randint(1, 5))) for _ in range(400)]
    model = learnt
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    added = 0
    for row in pii.with_spans(df, model).collect():
        want = whole_method(row["text"], model)
        assert spans(row["spans"]) == want, row["text"]
        added += len(want) - len(base(row["text"]))
    assert added > 300


def used(model):
    def walk(tree):
        return {pii.FEATURES[tree[0]]} | walk(tree[2]) | walk(tree[3]) if isinstance(tree, tuple) else set()
    return set().union(*map(walk, model.trees))


def test_equal_digits_in_unlike_contexts(spark, learnt):
    model = learnt
    assert len(used(model)) >= 5 and "ok" not in pii.FEATURES
    cases = {"phone 5551234567": 1, "order 5551234567": 0, "card 4111.1111.1111.1111": 1, "isbn 4111.1111.1111.1111": 0,
             "call 555-123-4567": 1, "ticket 555-123-4567": 0}
    df = spark.createDataFrame(list(cases.items()), "text string, n int")
    assert {r["text"]: len(r["spans"]) for r in pii.with_spans(df, model).collect()} == cases


def test_planted_spans(spark, sf, learnt):
    """Precision and recall on spans planted into documents; the README has the figures."""
    r = random.Random(3)
    docs = [x["text"] for x in documents(spark, sf).collect() if x["text"]]
    plain = [t for t in docs if not re.search("[0-9]{3}", t)][:300]

    def digits(n):
        return str(r.randint(2, 9)) + "".join(str(r.randint(0, 9)) for _ in range(n - 1))

    def card():
        head = "4" + digits(14)
        return next(head + str(d) for d in range(10) if luhn(head + str(d)))
    rows, planted = [], {}
    for i, t in enumerate(plain):
        c = card()
        good = [f"phone {digits(10)}", f"call {digits(3)}-{digits(3)}-{digits(4)}", f"mail {digits(3)}zo (at) site (dot) org",
                f"visa {c[:4]}.{c[4:8]}.{c[8:12]}.{c[12:]}"]
        bad = [f"order {digits(10)}", f"ticket {digits(3)}-{digits(3)}-{digits(4)}", f"version {digits(2)}.{digits(1)}",
               f"isbn {c[:4]}.{c[4:8]}.{c[8:12]}.{c[12:]}"]
        words, which = t.split(" "), i % 4
        at = r.randrange(len(words) + 1)
        words.insert(at, (good if i % 8 < 4 else bad)[which])
        rows.append((i, " ".join(words)))
        planted[i] = i % 8 < 4
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = learnt
    hit = {x["doc_id"]: len(x["spans"]) > 0 for x in pii.with_spans(df, model).collect()}
    right = sum(hit[i] and planted[i] for i in hit)
    precision, recall = right / max(1, sum(hit.values())), right / sum(planted.values())
    print(f"planted: precision {precision:.3f}, recall {recall:.3f}, {len(rows)} texts")
    assert precision >= 0.9 and recall >= 0.9


def test_many_spans_in_one_text(spark):
    text = " ".join(f"phone {5550000000 + i} (at) +1 (555) 555-{i % 10000:04d}" for i in range(3_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = pii.redact(df, pii.Trees(start=3.0)).first()
    assert row["text"].count("<PHONE>") == 6_000
