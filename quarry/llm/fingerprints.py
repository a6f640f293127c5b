"""SimHash document fingerprints and their search by permuted block tables.

A fingerprint has 128 bits. Terms are the distinct word pairs of a text (and,
in texts of fewer than ``SHORT`` words, its words and character trigrams);
each votes on every bit with its weight, 1 + log2 of its frequency, for or
against. Likeness of two fingerprints is the share of equal bits.

Block tables: with the bits cut into ``blocks`` blocks, two fingerprints within
``radius`` bits agree in at least blocks - radius of them. One table for each
choice of that many blocks, keyed by their bits, finds every such pair; full
distances then decide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from quarry.llm.common import stage, words_of

BITS = 128
DIGITS = BITS // 4
SHORT = 16
CHUNK = 4096


def _terms(text: str) -> Iterator[bytes]:
    words = words_of(text)
    if len(words) < SHORT:
        yield from words
        joined = b" ".join(words).decode()
        for i in range(len(joined) - 2):
            yield joined[i:i + 3].encode()
    for pair in zip(words, words[1:]):
        yield b" ".join(pair)


def _second(h: np.ndarray) -> np.ndarray:
    """Another 64 well mixed bits of each hash (multiply and shift rounds)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprint(text: str | None) -> np.ndarray:
    """16 bytes; all zero for a text without words."""
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, _terms(text or "")), dtype="<u8")
    values, counts = np.unique(hashes, return_counts=True)
    weights = (1 + np.log2(counts)).astype(np.float32)
    votes = np.zeros(BITS, dtype=np.float64)
    for i in range(0, len(values), CHUNK):
        h, w = values[i:i + CHUNK], weights[i:i + CHUNK]
        both = np.stack([h, _second(h)], axis=1).view(np.uint8).reshape(len(h), BITS // 8)
        votes += w @ np.unpackbits(both, axis=1).astype(np.float32) - w.sum() / 2
    return np.packbits(votes > 0)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return 1.0 - int(np.bitwise_count(a ^ b).sum()) / BITS


def edited(text: str, after: str) -> str:
    """``text`` with its last half replaced by as much of the text after it."""
    half = len(text) // 2
    return text[:len(text) - half] + after[:half]


def compare(text: str, after: str, own: np.ndarray, after_print: np.ndarray) -> tuple:
    changed = edited(text, after)
    changed_print = fingerprint(changed)
    return (hashlib.sha256(changed.encode("utf-8", "replace")).hexdigest(), own.tobytes().hex(),
            changed_print.tobytes().hex(), likeness(own, changed_print), likeness(own, after_print))


_FOUND = "edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_COLUMNS = ["edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one ordered partition, each compared with the one after it.

    The first row's text is also given as an edge "head", and the last row as
    edge "tail" with its text: what follows it lies in a later partition.
    """
    part, before, kind = TaskContext.get().partitionId(), None, pa.int64()
    blank = (None,) * len(_COLUMNS)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [kind, pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2, pa.string(), pa.int32(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                                          ["doc_id", "n_chars", *_COLUMNS, "edge", "part", "text"])
    for batch in batches:
        rows, kind = [], batch.schema.field(0).type
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text = text or ""
            now = (doc_id, text, fingerprint(text))
            if before is None:
                rows.append((None, None, *blank, "head", part, text))
            else:
                rows.append((before[0], len(before[1]), *compare(before[1], text, before[2], now[2]), None, part, None))
            before = now
        yield out(rows)
    if before is not None:
        yield out([(before[0], len(before[1]), *blank, "tail", part, before[1])])


_KINDS = StructType([StructField(c, DoubleType() if c.startswith("near") else StringType()) for c in _COLUMNS])


@F.pandas_udf(_KINDS)
def _compare_udf(texts: pd.Series, after: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([compare(a, b, fingerprint(a), fingerprint(b)) for a, b in zip(texts, after)],
                        columns=_COLUMNS)


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """Every row's fingerprint, and its likeness to the edited text's and the
    next document's: ``doc_id, n_chars`` and the columns of ``compare``.

    The order is ascending doc_id, nulls last, equal ids by text; the row after
    the last is the first, so a single row follows itself. Null texts count as
    empty. Texts move once, into ranges of doc_id; at the ends of ranges only
    one row a range is joined to the next range's first. An empty table gives
    no rows; only ``doc_id`` and ``text`` are read.
    """
    order = [F.col("doc_id").asc_nulls_last(), F.col("tie")]
    texts = (docs.select("doc_id", "text").withColumn("tie", F.xxhash64("text"))
             .repartitionByRange(*order).sortWithinPartitions(*order, "text").select("doc_id", "text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    walked = stage(texts.mapInArrow(
        _walk, f"doc_id {kind}, n_chars long, {_FOUND}, edge string, part int, text string"), "prints")
    heads = walked.where("edge = 'head'").select("part", F.col("text").alias("after"))
    # One row a range: no wider than the number of ranges.
    ring = heads.select("part", F.lead("part").over(Window.orderBy("part")).alias("next"))
    start = heads.agg(F.min("part")).first()[0]
    ring = ring.select("part", F.coalesce("next", F.lit(start)).alias("next"))
    ends = (walked.where("edge = 'tail'").select("doc_id", "n_chars", "text", "part").join(ring, "part")
            .join(heads.withColumnRenamed("part", "next"), "next")
            .select("doc_id", "n_chars", _compare_udf("text", "after").alias("found"))
            .select("doc_id", "n_chars", "found.*"))
    return walked.where("edge IS NULL").select("doc_id", "n_chars", *_COLUMNS).unionByName(ends)


# ------------------------------------------------------------- block tables

def _tables(radius: int, blocks: int) -> list[list[tuple[int, int]]]:
    """For each table, the (first hex digit, digits) of its key's blocks."""
    if not radius < blocks <= DIGITS:
        raise ValueError("blocks must exceed the radius and not the hex digits")
    cuts = [DIGITS * i // blocks for i in range(blocks + 1)]
    pieces = [(a + 1, b - a) for a, b in zip(cuts, cuts[1:])]
    return [list(c) for c in combinations(pieces, blocks - radius)]


def block_keys(prints: DataFrame, radius: int, blocks: int) -> DataFrame:
    """Each fingerprint once a table: its columns and ``block`` (number, key)."""
    keys = [F.concat_ws(":", F.lit(str(n)), *[F.substring("fingerprint", a, w) for a, w in table])
            for n, table in enumerate(_tables(radius, blocks))]
    return prints.withColumn("block", F.explode(F.array(*keys)))


def distance(a: str, b: str) -> Column:
    parts = [f"bit_count(cast(conv(substring({a}, {i}, 8), 16, 10) as bigint) ^ "
             f"cast(conv(substring({b}, {i}, 8), 16, 10) as bigint))" for i in range(1, DIGITS, 8)]
    return F.expr(" + ".join(parts))


def within_radius(index: DataFrame, queries: DataFrame, radius: int = 3, blocks: int = 4) -> DataFrame:
    """All indexed fingerprints within ``radius`` bits of each query's.

    Both tables have ``fingerprint``; each is made distinct first, so copies
    cost nothing: the result ``(query, found, bits)`` relates fingerprints,
    and rows join to them by fingerprint. Null fingerprints match nothing.
    """
    def distinct(df: DataFrame) -> DataFrame:
        return df.select("fingerprint").where("fingerprint IS NOT NULL").distinct()

    left = block_keys(distinct(queries), radius, blocks).withColumnRenamed("fingerprint", "query")
    right = block_keys(distinct(index), radius, blocks).withColumnRenamed("fingerprint", "found")
    return (left.join(right, "block").withColumn("bits", distance("query", "found"))
            .where(F.col("bits") <= radius).select("query", "found", "bits").distinct())
