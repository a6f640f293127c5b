import re
from collections import defaultdict
from itertools import permutations

from pyspark.sql import functions as F

from quarry.llm import filter_audit
from tests.llm.cases import LONG, ROWS, documents, empty, odd

FILTERS = "ABCDE"


def failing(rows):
    """Letters that each row fails, by the rules as stated."""
    out = []
    for doc_id, text, *_ in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        own = {"A"} if len(w) < 200 else set()
        own |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        own |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t) else set()
        own |= {"D"} if re.search("[#$%&*|]", t) else set()
        if doc_id is not None and any(i is not None and i < doc_id and (u or "") == t for i, u, *_ in rows):
            own.add("E")
        out.append(own)
    return out


def wanted(rows, labels):
    good, toxic = defaultdict(int), defaultdict(int)
    for i, q, x in labels:
        good[i] |= q == 1
        toxic[i] |= x == 1
    good[None] = toxic[None] = 0
    fails, out = failing(rows), {}
    for part in {r[2] or "" for r in rows}:
        own = [(r[0], f) for r, f in zip(rows, fails) if (r[2] or "") == part]
        total = defaultdict(int)
        for order in permutations(FILTERS):
            left = own
            for step, k in enumerate(order, 1):
                gone = [i for i, f in left if k in f]
                left = [(i, f) for i, f in left if k not in f]
                total[k] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(k in f for _, f in own) - len(gone), sum(f == {k} for _, f in own),
                    sum(good[i] for i in gone), sum(toxic[i] for i in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return out


def result(docs, labels):
    found = filter_audit.audit(docs, labels, filter_audit.contract_filters(F.coalesce("text", F.lit(""))), "E",
                               F.coalesce("lang", F.lit("")))
    return {tuple(r)[:3]: list(r)[4:] for r in found.collect()}


def test_audit_equals_brute_force(spark, sf):
    docs = documents(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    assert result(docs, labels) == wanted(rows, [tuple(r) for r in labels.collect()])


def test_odd_rows_and_labels(spark):
    labels = [(1, 1, 0), (4, 0, 1), (4, 1, None), (None, 1, 1), (2, None, 1), (99, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("clash"))
    docs = odd(spark).withColumn("quality", F.lit(7)).withColumn("filter", F.lit("x")).withColumn("before", F.lit(1))
    assert result(docs, table) == wanted(ROWS, labels)
    assert result(empty(spark), table) == {}


def test_common_copies_and_no_labels(spark):
    """A text that a third of the rows share, ties of ids, and no labels."""
    rows = [(i, "same words " * 120 if i % 3 == 0 else f"{i} # {LONG[:i]}", "en" if i % 2 else None) for i in range(120)]
    rows += [(0, "same words " * 120, "en"), (1, None, ""), (2, "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert result(docs, none) == wanted(rows, [])


def test_other_filters(spark):
    """Two filters and no duplicates: four rows, each order with its own steps."""
    docs = spark.createDataFrame([(1, "aa"), (2, "ab"), (3, "bb"), (4, None)], "doc_id int, text string")
    none = spark.createDataFrame([], "doc_id int, quality int, toxic int")
    found = filter_audit.audit(docs, none, {"x": F.col("text").contains("a"), "y": F.col("text").contains("b")})
    got = {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["shapley"]) for r in found.collect()}
    assert got == {("xy", 1): (2, 2, 0, 3), ("xy", 2): (1, 1, 1, 3), ("yx", 1): (2, 2, 0, 3), ("yx", 2): (1, 1, 1, 3)}
