"""Packing documents into sequences by length patterns.

A document's tokens and one end token are cut only if they exceed a sequence:
into full pieces, after a first piece that may be shorter. Sequences follow
patterns of a few lengths that fill them. Non-negative least squares finds how
often to repeat each pattern to meet the histogram of piece lengths (a length's
error weighs as the length, for a long piece left over costs most); rounded
down to what the histogram still holds, the rest goes by best fit (longest
piece first, then the longest that still fits, repeated while the lengths
last). Two pattern sets are tried - all, and those with a piece over half a
sequence - and the plan with fewest sequences is taken, the first of equals.
The patterns are all that fill a sequence exactly with lengths in stock,
whatever the size of the input: about a twelfth of the capacity's square. Only
the histogram, one number a length, is on the driver; pieces get their place by
their rank among those of their length, found in the sorted starts of the
plan's runs. Full pieces are sequences of their own and need no rank.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from quarry.llm.common import stage

BUCKET = 1000  # pieces of one length that are ranked together, about
RANKS = 1 << 44  # above every rank: a length and a rank make one sorted number
ROUNDS, SETTLED = 150, 1e-4
#: Fixed value: how a byte-level BPE of this kind splits texts before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Ids of a byte-level BPE file as its library gives them.

    The same vocabulary in a faster library gives the same ids for texts
    without special strings (tests compare both over all code points); texts
    that hold one go to the file's own library.
    """

    def __init__(self, path: str):
        self.own = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.vocab = spec["model"]["vocab"]
        # The file writes each byte as a visible character; printable ones stand for themselves.
        shown = sorted(ByteLevel.alphabet())
        plain = [b for b in range(256) if chr(b) in shown]
        other = [b for b in range(256) if chr(b) not in shown]
        self.byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
        split = spec["pre_tokenizer"]
        self.fast = None
        if (spec["model"]["type"], split["type"], split.get("use_regex"), split.get("add_prefix_space")) == (
                "BPE", "ByteLevel", True, False) and not spec["normalizer"]:
            ranks = {self.spelled(token): i for token, i in self.vocab.items() if token not in self.special}
            self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def spelled(self, token: str) -> bytes:
        """The bytes of a token of the file, a special one as it stands."""
        return token.encode() if token in self.special else bytes(self.byte[c] for c in token)

    def ids(self, text: str) -> list[int]:
        if self.fast is None or any(s in text for s in self.special):
            return self.own.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int) -> DataFrame:
    """``uid`` (of the piece), ``doc_id, piece, start, length, ids_crc32``."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, uid = encoder(tokenizer_path), TaskContext.get().partitionId() << 40
        for batch in batches:
            rows = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.array([*enc.ids(text or ""), end_id], dtype="<u4")
                at = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                if at[-1] != len(ids):  # shorter than one sequence
                    at.append(len(ids))
                rows += [(uid + i, doc_id, i, a, b - a, zlib.crc32(ids[a:b].tobytes()))
                         for i, (a, b) in enumerate(zip(at, at[1:]))]
                uid += len(at) - 1
            kinds = [pa.int64(), batch.schema.field(0).type, pa.int32(), *[pa.int64()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                                             ["uid", "doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return (docs.select("doc_id", "text")
            .mapInArrow(cut, f"uid long, doc_id {kind}, piece int, start long, length long, ids_crc32 long"))


# ------------------------------------------------------------------ the plan

def enumerate_patterns(counts: np.ndarray, capacity: int, shortest_lead: int) -> np.ndarray:
    """Patterns of two or three lengths in stock that fill a sequence exactly,
    as rows of three lengths, the longest (``shortest_lead`` or more) first
    (0: none). Only which lengths there are matters, not how many pieces.
    """
    stock = counts > 0
    half = np.arange((capacity + 1) // 2, capacity)
    pairs = np.stack([half, capacity - half, np.zeros_like(half)], axis=1)
    long, mid = np.meshgrid(np.arange(shortest_lead, capacity - 1), np.arange(1, capacity // 2 + 1))
    long, mid = long.ravel(), mid.ravel()
    short = capacity - long - mid
    fits = (short > 0) & (short <= mid) & (mid <= long)
    rows = np.concatenate([pairs, np.stack([long[fits], mid[fits], short[fits]], axis=1)])
    return rows[((rows == 0) | stock[rows]).all(axis=1)]


def repeat_counts(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Non-negative least squares of pattern repeats against the histogram,
    errors weighing as the lengths, by multiplicative updates (each keeps the
    sign and lowers the error). Ends when an update changes the repeats by less
    than ``SETTLED`` of them, after ``rounds`` at the latest: what the repeats
    then still miss goes by best fit."""
    if not len(patterns):
        return np.zeros(0)
    size, wanted = len(counts), counts.astype(float)
    weight = np.arange(size, dtype=float)  # no length: no weight

    def used(x: np.ndarray) -> np.ndarray:
        return np.bincount(patterns.ravel(), weights=np.repeat(x, patterns.shape[1]), minlength=size)

    goal = (weight * wanted)[patterns].sum(axis=1)
    shares = np.maximum(np.bincount(patterns.ravel(), minlength=size), 1)
    shares[0], wanted[0] = 1, 0
    x = (wanted / shares)[patterns].max(axis=1) + 1e-9
    for _ in range(rounds):
        factor = goal / np.maximum((weight * used(x))[patterns].sum(axis=1), 1e-12)
        change = np.abs(factor - 1) @ x
        settled = change < SETTLED * x.sum()
        x *= factor
        if settled:
            break
    return x


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Longest first, filled with the longest that fits; empties ``left``."""
    out = []
    while left.any():
        row, room, free = [], capacity, left.copy()
        while room and (fit := np.flatnonzero(free[:room + 1])).size:
            v = int(fit[-1])
            row.append(v)
            free[v] -= 1
            room -= v
        n = min(int(left[v]) // row.count(v) for v in set(row))
        out.append((tuple(row), n))
        for v in row:
            left[v] -= n
    return out


def plan(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) of every pattern used; uses exactly ``counts``."""
    plans = []
    for shortest_lead in (capacity // 3, capacity // 2 + 1):
        left = counts.astype(np.int64).copy()
        full = int(left[capacity])
        left[capacity] = 0
        out = [((capacity,), full)] if full else []
        patterns = enumerate_patterns(left, capacity, shortest_lead)
        x = repeat_counts(patterns, left)
        for i in np.argsort(-x, kind="stable"):
            if x[i] < 1:
                break
            row = [int(v) for v in patterns[i] if v]
            n = min(int(x[i]), *(int(left[v]) // row.count(v) for v in row))
            if n:
                out.append((tuple(row), n))
                for v in row:
                    left[v] -= n
        plans.append(out + best_fit(left, capacity))
    return min(plans, key=lambda p: sum(n for _, n in p))


def slots(patterns: list[tuple[tuple[int, ...], int]], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, rank after the last, first sequence, offset)."""
    taken, sequence, out = [0] * (capacity + 1), 0, []
    for row, n in patterns:
        offset = 0
        for v in row:
            out.append((v, taken[v], taken[v] + n, sequence, offset))
            taken[v] += n
            offset += v
        sequence += n
    return out


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Every piece of every row with its place: ``doc_id, piece, start, length,
    ids_crc32, sequence_id, offset``.

    Null and empty texts have the end token alone; repeated rows and ids are
    packed as documents of their own; a text of any length is one task's ids,
    cut into full pieces; an empty table gives no rows; only ``doc_id`` and
    ``text`` are read.
    """
    spark = docs.sparkSession
    found = stage(pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in found.groupBy("length").count().collect():  # one number a length
        counts[row["length"]] = row["count"]
    # Full pieces: a sequence each, numbered below zero.
    whole = (found.where(F.col("length") == capacity)
             .select("doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.col("uid")).alias("sequence_id"),
                     F.lit(0).cast("long").alias("offset")))
    counts[capacity] = 0
    length, low, _, first, offset = np.array(sorted(slots(plan(counts, capacity), capacity)) or [[0] * 5],
                                             dtype=np.int64).T
    # At most as many runs as the plan's patterns have pieces, which the capacity bounds.
    shared = spark.sparkContext.broadcast((length * RANKS + low, low, first, offset))
    # One row a length: how many buckets share its ranks.
    stock = spark.createDataFrame([(i, int(-(-c // BUCKET))) for i, c in enumerate(counts) if c],
                                  "length long, buckets long")
    dealt = (found.join(F.broadcast(stock), "length").withColumn("draw", F.xxhash64("uid"))
             .withColumn("bucket", F.pmod("draw", "buckets")))
    sizes = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "bucket").orderBy("draw", "uid")
    ranked = (dealt.withColumn("nr", F.row_number().over(own)).join(offsets, ["length", "bucket"])
              .withColumn("rank", (F.col("base") + F.col("nr") - 1).cast("long"))
              .select("doc_id", "piece", "start", "length", "ids_crc32", "rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, low, first, offset = shared.value
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(keys, batch.column("length").to_numpy() * RANKS + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(first[at] + rank - low[at]), pa.array(offset[at])],
                [*batch.schema.names[:5], "sequence_id", "offset"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    placed = ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, "
                                      "sequence_id long, offset long")
    return placed.unionByName(whole)
