"""SimHash near-duplicate detection with a pigeonring filter.

A document's fingerprint has 64 bits: each word shingle's XXH64 (seed 42)
votes for its bits, and a bit is set if more than half the shingles have it.
Documents link at ``max_bits`` or fewer differing bits.

Candidate search (pigeonring): the 64 bits lie on a ring of ``segments``
segments. If two fingerprints differ in at most t bits, then some segment
starts a chain whose cumulative differences stay within l*t/m after each of
its l segments (m: number of segments). As long as l*t/m is below one, the
budget is zero, so the chain's first segments are equal: these are the join
key. The rest of the chain prunes candidates before the full Hamming check.

Keys shared by more than ``bucket_limit`` distinct fingerprints would give all
pairs of a group of near copies. Their fingerprints link exactly by another
way: two fingerprints differ in at most t bits if and only if they meet in a
point at most ceil(t/2) flips from the one and floor(t/2) from the other, so
each emits the points around it and joins the smallest one at each point. The
work is linear in the fingerprints and no pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from quarry.llm.common import connected_components, stage, words_of

SEED = 42
CHUNK = 4096  # hashes whose bits are expanded at once


def shingle_hashes(words: list[bytes], size: int) -> Iterator[int]:
    """XXH64 of each shingle; a shorter text is one shingle, no words none."""
    digest = xxhash.xxh64_intdigest
    if not words:
        return iter(())
    if len(words) <= size:
        return iter((digest(b" ".join(words), SEED),))
    columns = [words[i:] for i in range(size)]
    return (digest(b" ".join(s), SEED) for s in zip(*columns))


def majority_bits(hashes: Iterator[int]) -> int:
    """64-bit number whose bits are set in over half the hashes (none: 0)."""
    values = np.fromiter(hashes, dtype="<u8")
    if not len(values):
        return 0
    votes = np.zeros(64, dtype=np.int64)
    for i in range(0, len(values), CHUNK):
        part = values[i:i + CHUNK].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * votes > len(values)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, size: int = 3) -> int:
    return majority_bits(shingle_hashes(words_of(text), size))


def fingerprint_udf(size: int):
    @F.pandas_udf(LongType())
    def run(texts: pd.Series) -> pd.Series:
        values = np.fromiter((fingerprint(t, size) for t in texts), dtype="<u8", count=len(texts))
        return pd.Series(values.view("<i8"))
    return run


def _ring(segments: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment of the ring."""
    cuts = [64 * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _mask(bits: int) -> int:
    m = (1 << bits) - 1
    return m - (1 << 64) if m >> 63 else m


def _budgets(segments: int, max_bits: int) -> list[int]:
    return [(n * max_bits) // segments for n in range(1, segments + 1)]


def _chain_masks(segments: int) -> list[list[int]]:
    """masks[n - 1][s]: bits of the n segments from s on, of a ring turned to s."""
    widths = [w for _, w in _ring(segments)]
    return [[_mask(sum(widths[(s + i) % segments] for i in range(n))) for s in range(segments)]
            for n in range(1, segments + 1)]


def _pick(values: list[int], index: str) -> str:
    """SQL for the entry of ``values`` at a row's ``index``."""
    return f"element_at(array({', '.join(f'{v}L' if v != -(1 << 63) else 'bigint(-9223372036854775808)' for v in values)}), {index} + 1)"


def ring_keys(prints: DataFrame, max_bits: int, segments: int) -> DataFrame:
    """(fp, s, turned, key): the fingerprint turned to segment s, and its key."""
    zero = max(i for i, b in enumerate([0, *_budgets(segments, max_bits)]) if b == 0)
    masks = _chain_masks(segments)[zero - 1]
    starts = [a for a, _ in _ring(segments)]
    first = _pick(starts, "s")
    return (prints.select("fp", F.explode(F.array(*[F.lit(s) for s in range(segments)])).alias("s"))
            .withColumn("turned", F.expr(
                f"shiftrightunsigned(fp, int({first})) | "
                f"if(s = 0, 0L, shiftleft(fp, 64 - int({first})))"))
            .withColumn("key", F.expr(f"turned & {_pick(masks, 's')}")))


def _points(max_bits: int) -> list[int]:
    """XOR masks of at most ceil(max_bits / 2) flips."""
    far = (max_bits + 1) // 2
    masks = [sum(1 << i for i in c) for n in range(far + 1) for c in combinations(range(64), n)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(prints: DataFrame, max_bits: int = 2, segments: int = 5, bucket_limit: int = 64) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints ``fp``, whose components
    are those of the relation "at most ``max_bits`` differing bits".

    ``segments`` must exceed ``max_bits``. Buckets of up to ``bucket_limit``
    fingerprints go through chains; fingerprints of larger ones through the
    points around them (``_dense_links``).
    """
    if max_bits < 1:
        return prints.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where(F.lit(False))
    if segments <= max_bits:
        raise ValueError("segments must exceed max_bits")
    if max_bits > 4:
        raise ValueError("the points around a fingerprint are too many beyond 4 bits")
    keys = ring_keys(prints, max_bits, segments)
    sizes = keys.groupBy("s", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    sized = stage(keys.join(sizes, ["s", "key"]), "ring")
    light = sized.where(F.col("size") <= bucket_limit)
    left = light.select("s", "key", F.col("fp").alias("a"), F.col("turned").alias("ta"))
    right = light.select("s", "key", F.col("fp").alias("b"), F.col("turned").alias("tb"))
    masks, budgets = _chain_masks(segments), _budgets(segments, max_bits)
    chain = " AND ".join(f"bit_count((ta ^ tb) & {_pick(masks[n], 's')}) <= {budgets[n]}"
                         for n in range(segments) if n + 1 == segments or budgets[n + 1] > budgets[n])
    near = (left.join(right, ["s", "key"]).where(F.col("a") < F.col("b"))
            .where(F.expr(chain)).where(F.expr(f"bit_count(a ^ b) <= {max_bits}"))
            .select("a", "b"))
    dense = sized.where(F.col("size") > bucket_limit).select("fp").distinct()
    return near.unionByName(_dense_links(dense, max_bits))


def _dense_links(dense: DataFrame, max_bits: int) -> DataFrame:
    """Links within dense sets: centres that share a point join its smallest.

    With t even, both ends are within t/2 flips of a shared point, and any two
    centres of a point are within t bits: stars give exactly the components.
    With t odd, points lie up to (t-1)/2 flips from one end and one more from
    the other; a point's inner centres join the smallest inner one, and each
    outer centre joins that inner one (an outer pair may be t+1 bits apart).
    """
    near = max_bits // 2
    masks = F.array(*[F.lit(m) for m in _points(max_bits)])
    # Spread first: rows multiply here, in every task alike.
    points = (dense.repartition("fp").select("fp", F.explode(masks).alias("flip"))
              .select("fp", F.expr("fp ^ flip").alias("point"), F.expr("bit_count(flip)").alias("far")))
    inner = points.where(F.col("far") <= near).groupBy("point").agg(F.min("fp").alias("hub"))
    return (points.join(inner, "point")
            .where(F.col("fp") != F.col("hub")).select(F.col("hub").alias("a"), F.col("fp").alias("b")))


def prints_and_roots(docs: DataFrame, shingle: int, max_bits: int, segments: int,
                     bucket_limit: int) -> tuple[DataFrame, DataFrame]:
    """``doc_id, tie, fp`` of every row (``tie``: a hash of the text), and
    ``fp, root`` of every fingerprint: the smallest one of its component."""
    prints = stage(docs.select("doc_id", F.xxhash64("text").alias("tie"),
                               fingerprint_udf(shingle)("text").alias("fp")), "prints")
    distinct = stage(prints.select("fp").distinct(), "classes")
    roots = connected_components(links(distinct, max_bits, segments, bucket_limit), "a", "b")
    owner = (distinct.join(roots, distinct["fp"] == roots["node"], "left")
             .select("fp", F.coalesce("root", "fp").alias("root")))
    return prints, owner


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2, segments: int = 5,
                    bucket_limit: int = 64) -> DataFrame:
    """Fingerprint and component of every row: ``doc_id, fp, component_id``.

    ``component_id`` is the smallest doc_id of the component. Null and empty
    texts have fingerprint zero and link like any other; rows with a null
    doc_id count as members but never name a component unless all do (null
    then); repeated rows stay repeated; an empty table gives no rows. Only
    ``doc_id`` and ``text`` are read, so other columns may have any name.
    """
    prints, owner = prints_and_roots(docs, shingle, max_bits, segments, bucket_limit)
    # Ids meet by fingerprint first: a group of copies is one row from there on.
    classes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first")).join(owner, "fp"), "members")
    named = classes.groupBy(F.col("root").alias("of")).agg(F.min("first").alias("component_id"))
    owned = classes.join(named, F.col("root") == F.col("of")).select("fp", "component_id")
    return prints.join(owned, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, max_bits: int = 2, segments: int = 5,
             bucket_limit: int = 64) -> DataFrame:
    """``docs`` with one row of each component: the one of the smallest doc_id
    (nulls last), among equal ids one by a hash of the text."""
    columns = list(docs.columns)
    prints, owner = prints_and_roots(docs, shingle, max_bits, segments, bucket_limit)
    rows = prints.join(owner, "fp")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")).alias("first")
    # Keys without nulls, the same in the join and the last step: texts move once.
    def key(id_: str, tie: str) -> list[Column]:
        kind = docs.schema["doc_id"].dataType
        return [F.col(id_).isNull().alias("_none"), F.coalesce(id_, F.lit(0).cast(kind)).alias("_id"),
                F.col(tie).alias("_tie")]

    on = ["_none", "_id", "_tie"]
    kept = rows.groupBy("root").agg(first).select(*key("first.doc_id", "first.tie"))
    tied = docs.withColumn("_t", F.xxhash64("text"))
    return (tied.select(*key("doc_id", "_t"), *columns).join(kept, on, "left_semi")
            .dropDuplicates(on).select(*columns))


def hex_fingerprint(c: str = "fp"):
    return F.lower(F.lpad(F.hex(c), 16, "0"))
