"""Audit of how filters interact, by relations of failing ids.

One id table per filter holds the rows that fail it. A filter that comes after
a set S of others removes those of its ids that no table of S holds (left-anti
join) and is redundant for those that one of them holds (left-semi join). What
a filter does at a step depends on the set before it, not on that set's order,
so both joins run once over all sets: every failing id meets the other tables
with the set as a bit mask. Only failing rows are moved, by their row number,
which no two rows share, so no key is hot; rows that pass everything are only
counted. All orders then come from sums a set: 80 a part for five filters.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import SPACE, stage
from quarry.session import scratch_dir

#: A text shared by more than one in HOT rows is looked up in a table of at most HOT rows.
HOT = 10_000
MEASURES = ["rows", "good", "toxic", "redundant"]


def contract_filters(text: Column) -> dict[str, Column]:
    """Failure conditions A to D of a text; ``duplicate`` ids are E."""
    words = F.array_remove(F.split(text, SPACE), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    return {"A": n < 200, "B": 100 * distinct < 50 * n,
            "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text),
            "D": text.rlike("[#$%&*|]")}


def _later_copies(rows: DataFrame) -> DataFrame:
    """``uid`` of rows whose text a smaller ``doc_id`` has as well.

    Texts meet by their hash, pre-aggregated, so copies of one text need not
    meet in a task. The way back to the rows is a join with the few texts that
    many rows share as a small table, and one by hash for all others.
    """
    shared = stage(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"),
                                              F.count(F.lit(1)).alias("n"))
                   .where(F.col("last") > F.col("first")), "copies")
    total = rows.count()
    hot = F.col("n") * HOT > total  # fewer than HOT texts
    own = rows.where(F.col("doc_id").isNotNull()).select("uid", "doc_id", "digest")
    frequent = F.broadcast(shared.where(hot).select("digest", "first"))
    some = own.join(frequent, "digest").where(F.col("doc_id") > F.col("first"))
    others = (own.join(frequent, "digest", "left_anti")
              .join(shared.where(~hot).select("digest", "first"), "digest").where(F.col("doc_id") > F.col("first")))
    return some.select("uid").union(others.select("uid"))


def failing_ids(docs: DataFrame, filters: dict[str, Column], part: Column, duplicate: str | None) -> tuple:
    """The rows (``uid, doc_id, part``, digest) and one id table per filter,
    as ``uid, doc_id, part, filter``."""
    text = F.coalesce("text", F.lit(""))
    found = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in filters.items()]))
    rows = stage(docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", part.alias("part"),
                             *([F.unhex(F.sha2(text, 256)).alias("digest")] if duplicate else []),
                             found.alias("fails")), "audit-rows")
    ids = rows.select("uid", "doc_id", "part", F.explode("fails").alias("filter"))
    if duplicate:
        copies = rows.join(_later_copies(rows), "uid", "left_semi")
        ids = ids.union(copies.select("uid", "doc_id", "part", F.lit(duplicate)))
    return rows, ids


def with_labels(ids: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds ``good`` and ``toxic`` (0 or 1; of several labels of an id, the
    larger). Rows without an id have no label and take no part in the join."""
    known = (labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id")
             .agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")).alias("good"),
                  F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("toxic")))
    none = [F.lit(0).alias("good"), F.lit(0).alias("toxic")]
    met = ids.where(F.col("doc_id").isNotNull()).join(known, "doc_id", "left")
    return (met.select("uid", "part", "filter", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")])
            .unionByName(ids.where(F.col("doc_id").isNull()).select("uid", "part", "filter", *none)))


def _one_table_a_filter(ids: DataFrame) -> DataFrame:
    """The id tables, a folder each below the shared folder."""
    path = scratch_dir(ids.sparkSession, "failing-ids")
    ids.write.partitionBy("filter").parquet(path)
    return ids.sparkSession.read.schema(ids.schema).parquet(path)


def _bits(names: list[str]) -> dict[str, int]:
    return {k: 1 << i for i, k in enumerate(names)}


def _bit(names: list[str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in _bits(names).items() for x in pair]), F.col("filter"))


def by_prefix(ids: DataFrame, parts: DataFrame, names: list[str]) -> DataFrame:
    """``part, filter, before`` (the set of filters before it, a bit mask) with
    the rows it removes, the good and the toxic among them, and how many of its
    rows are redundant; zeros included."""
    # One shuffle by row number: both joins and the sets find their rows in place.
    placed = ids.withColumn("bit", _bit(names)).repartition("uid")
    sets = F.array(*[F.lit(s) for s in range(1 << len(names))])
    steps = (placed.withColumn("before", F.explode(sets))
             .where(F.col("before").bitwiseAND(F.col("bit")) == 0))
    other = placed.select(F.col("uid").alias("failed"), F.col("bit").alias("by"))
    earlier = (F.col("uid") == F.col("failed")) & (F.col("before").bitwiseAND(F.col("by")) != 0)
    key, none = ["part", "filter", "before"], F.lit(0).cast("long")
    one = F.count(F.lit(1))
    removed = steps.join(other, earlier, "left_anti").groupBy(key).agg(
        one.alias("rows"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"), none.alias("redundant"))
    redundant = steps.join(other, earlier, "left_semi").groupBy(key).agg(
        *[none.alias(m) for m in MEASURES[:3]], one.alias("redundant"))
    slots = [F.struct(F.lit(k).alias("filter"), F.lit(s).alias("before"))
             for k, bit in _bits(names).items() for s in range(1 << len(names)) if not s & bit]
    zeros = (parts.select("part", F.explode(F.array(*slots)).alias("slot"))
             .select("part", "slot.*", *[none.alias(m) for m in MEASURES]))
    return removed.union(redundant).union(zeros).groupBy(key).agg(*[F.sum(m).alias(m) for m in MEASURES])


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Column], duplicate: str | None = None,
          part: Column | None = None) -> DataFrame:
    """``part, filter_order, step, filter, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley`` of every order of the
    filters (single letters; at most six), zeros included.

    ``filters`` are failure conditions on the columns of ``docs``, null: does
    not fail; ``duplicate`` names the filter that rows fail whose text a
    smaller ``doc_id`` has too. Null texts are empty and copies of each other;
    a row without ``doc_id`` is no copy and makes none, and has no label;
    repeated rows count each time, rows of one id are no copies of each other
    by that alone; several labels of an id count as their larger; texts of any
    length are read whole, in the scan; no documents give no rows. Only the
    columns that ``part`` and ``filters`` name, ``doc_id`` and ``text`` are
    read.
    """
    names = [*filters, *([duplicate] if duplicate else [])]
    if len(names) > 6 or any(len(k) != 1 for k in names):
        raise ValueError("up to six filters of one letter each")
    part = F.lit("") if part is None else part
    rows, ids = failing_ids(docs, filters, part, duplicate)
    parts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("total"))
    found = stage(by_prefix(_one_table_a_filter(with_labels(ids, labels)), parts, names), "prefixes")
    steps = []
    for order in permutations(names):
        before = 0
        for i, k in enumerate(order):
            steps.append(("".join(order), i + 1, k, before))
            before |= _bits(names)[k]
    # As many rows as the orders of the filters have steps: 600 of five filters.
    steps = docs.sparkSession.createDataFrame(steps, "filter_order string, step int, filter string, before int")
    alone = (found.where(F.col("before") == (1 << len(names)) - 1 - _bit(names))
             .select("part", "filter", F.col("rows").alias("unique_fails")))
    full = (found.join(F.broadcast(steps), ["filter", "before"]).join(alone, ["part", "filter"])
            .join(parts, "part"))
    so_far = Window.partitionBy("part", "filter_order").orderBy("step")
    own = Window.partitionBy("part", "filter")
    return full.select(
        "part", "filter_order", "step", "filter",
        (F.col("total") - F.sum("rows").over(so_far)).alias("kept"), F.col("rows").alias("removed"), "redundant",
        "unique_fails", F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"),
        F.sum("rows").over(own).alias("shapley"))
