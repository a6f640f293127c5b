"""Mixing sources to target weights by capped water-filling.

Targets share ``factor`` times all words by weight; no source gives more than
``max_epochs`` times its own. Sources above their cap are clamped to it and the
excess goes to the others by weight, until none is above. A source's share of
itself then has a whole part, so many repetitions of each document, and a
fraction: a seeded order of its documents is taken up to that many words, the
last one in part. Large sources are dealt into seeded buckets that each meet
their own fraction, so no task ever holds a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import SPACE, WORD, stage
from quarry.operators.ids import dense_index

BUCKET = 1000  # documents of one source that are ordered together, about


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def _level(sources: DataFrame, total: float, max_epochs: float) -> float:
    """Words per weight of all sources below their cap: one row a round."""
    above = F.lit(max_epochs) * F.col("source_size") < F.col("weight") * F.col("level")
    level, clamped = 0.0, -1
    while True:
        row = (sources.withColumn("level", F.lit(level))
               .agg(F.sum(F.when(above, F.col("source_size"))).alias("full"),
                    F.sum(F.when(~above, F.col("weight"))).alias("open"),
                    F.count(F.when(above, 1)).alias("n"))).first()
        if row["n"] == clamped or not row["open"]:
            return level if row["open"] else float("inf")
        level, clamped = (total - max_epochs * (row["full"] or 0)) / row["open"], row["n"]


def source_targets(sizes: DataFrame, weights: list[float], factor: float, max_epochs: float) -> DataFrame:
    """``source, n_docs, source_size, weight, target`` of each source; sources
    by code point, null last, take the weights in turn."""
    sources = stage(sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"),
                                                F.sum("size").alias("source_size")), "sources")
    placed = stage(dense_index(sources, [F.col("source").asc_nulls_last()], "place"), "placed")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.col("place") % len(weights) + 1).cast("int"))
    weighted = placed.withColumn("weight", weight)
    words = weighted.agg(F.sum("source_size")).first()[0] or 0
    level = _level(weighted, factor * words, max_epochs)
    return weighted.drop("place").withColumn("target", F.least(
        F.lit(float(max_epochs)) * F.col("source_size"),
        F.col("weight") * F.lit(level) if level != float("inf") else F.lit(float(max_epochs)) * F.col("source_size")))


def mix(docs: DataFrame, weights: list[float], factor: float = 1.5, max_epochs: float = 2.0,
        seed: int = 7, carry: list[str] | None = None) -> DataFrame:
    """Each row of ``docs`` (``doc_id, text, source``) with what the mix takes:
    ``doc_id, size, source_size, target, whole, part, taken`` and the columns
    of ``carry`` (prefixed ``in_``).

    ``whole`` repetitions of the document are taken, then ``part`` words of one
    more; taken = whole * size + part. Null and empty texts have size 0 and
    give nothing but whole repetitions; a null source is a source of its own,
    last in order; repeated rows are rows of their own; an empty table gives
    no rows. The same rows and seed give the same mix.
    """
    kept = [F.col(c).alias(f"in_{c}") for c in carry or []]
    sized = stage(docs.select("doc_id", "source", word_count().alias("size"),
                              F.xxhash64("text").alias("tie"), *kept), "sizes")
    targets = source_targets(sized.select("source", "size"), weights, factor, max_epochs)
    own = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = stage(targets.withColumn("whole", F.floor(own)).withColumn("fraction", own - F.floor(own))
                    .withColumn("buckets", F.ceil(F.col("n_docs") / BUCKET))
                    .select(F.col("source").alias("of"), "source_size", "target", "whole", "fraction", "buckets"),
                    "targets")
    dealt = (sized.join(targets, F.col("source").eqNullSafe(F.col("of"))).drop("of")
             .withColumn("draw", F.xxhash64(F.lit(seed), "doc_id", "tie"))
             .withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "tie"), "buckets")))
    group = Window.partitionBy("source", "bucket")
    before = group.orderBy("draw", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    quota = F.round(F.col("fraction") * F.col("bucket_size")).cast("long")
    # Both sums over one dealing of the rows: carried texts move once.
    summed = (dealt.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))
              .withColumn("bucket_size", F.sum("size").over(group)))
    part = F.greatest(F.lit(0).cast("long"), F.least("size", quota - F.col("before")))
    return (summed.withColumn("part", part)
            .withColumn("taken", F.col("whole") * F.col("size") + F.col("part"))
            .select("doc_id", "size", "source_size", "target", "whole", "part", "taken",
                    *[f"in_{c}" for c in carry or []]))


def first_words(text: str, n: str) -> Column:
    """``text`` up to the end of its ``n``-th word, white space kept (0 < n)."""
    space = SPACE.replace("\\", "\\\\")
    pieces = f"cast({n} + if({text} rlike '^{space}', 1, 0) as int)"  # a leading blank makes an empty piece
    parts = f"split({text}, '{space}+', {pieces} + 1)"
    rest = f"if(size({parts}) > {pieces}, length(element_at({parts}, -1)), 0)"
    return F.expr(f"substring({text}, 1, length({text}) - {rest})")


def expand(mixed: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """The documents of a mix: ``columns`` (carried as ``in_``) once for each
    whole repetition, and once with the words of a part, cut after them."""
    copies = F.col("whole") + F.when(F.col("part") > 0, 1).otherwise(0)
    cut = F.when((F.col("copy") > F.col("whole")) & (F.col("part") < F.col("size")),
                 first_words(f"in_{text}", "part")).otherwise(F.col(f"in_{text}"))
    numbered = mixed.where(copies > 0).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    return numbered.select(*[cut.alias(c) if c == text else F.col(f"in_{c}").alias(c) for c in columns])
