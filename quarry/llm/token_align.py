"""Alignment of two tokenizers' tokens by their byte ends.

Both tokenizers spell the same bytes (a space and the text). Byte offsets where
a token of each ends cut the tokens into groups. One side's token indices are
laid out by byte offset and looked up at the other side's ends, so a text takes
steps in proportion to its tokens and bytes, however the two sides differ.

Each group gives one link, between the tokens that end with it. How often an
id pair is linked is counted over the whole corpus: pairs with a share of
``SHARE`` or more of all links (so at most 1 / ``SHARE`` of them) go to all
tasks, all others meet their counts in a join by pair, where none is hot. Texts
are read once; what is kept of a document between the two passes is four or
eight bytes a link.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import stage
from quarry.llm.packing import Encoder

SHARE = 1e-6
FLUSH = 1 << 21  # links that are counted at once in a task


class Sides:
    """Ids, token bytes and their lengths of both tokenizers."""

    def __init__(self, byte_path: str, piece_path: str):
        enc = Encoder(byte_path)
        self.fast, self.own = enc.fast, enc.own
        self.own.encode_special_tokens = True  # their strings in a text are plain text
        named = {i: enc.spelled(t) for t, i in (enc.vocab | self.own.get_vocab()).items()}
        self.a_bytes = [named.get(i, b"") for i in range(max(named) + 1)]
        self.model = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.b_bytes = [self._piece(i) for i in range(self.model.get_piece_size())]
        self.a_size = np.array([len(t) for t in self.a_bytes], dtype=np.int64)
        self.b_size = np.array([len(t) for t in self.b_bytes], dtype=np.int64)
        self.names = [str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        # A pair is one number: id of A times the size of B, plus id of B.
        self.base = len(self.b_bytes)
        self.pair = np.dtype("<u4" if len(self.a_bytes) * self.base <= 1 << 32 else "<u8")

    def _piece(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

    def ids(self, text: str | None) -> tuple[list[int], list[int]]:
        """Both sides' ids; none where either side does not spell the text."""
        if not text:
            return [], []
        spaced = " " + text
        raw = spaced.encode()
        a = self.fast.encode_ordinary(spaced) if self.fast else self.own.encode(spaced, add_special_tokens=False).ids
        b = self.model.encode(text, num_threads=1)
        spell = b"".join
        if spell([self.a_bytes[i] for i in a]) != raw or spell([self.b_bytes[i] for i in b]) != raw:
            return [], []
        return a, b


@lru_cache(maxsize=2)
def sides(byte_path: str, piece_path: str) -> Sides:
    return Sides(byte_path, piece_path)


def common_ends(a: Sequence[int], b: Sequence[int]) -> tuple[list[int], list[int]]:
    """Indices in ``a`` and in ``b`` of the ends they share; both rise and end
    with the same value (or are both empty)."""
    if not len(a):
        return [], []
    place = np.full(int(a[-1]) + 1, -1, dtype=np.int64)
    place[b] = np.arange(len(b))
    found = place[a]
    at_a = np.flatnonzero(found >= 0)
    return at_a.tolist(), found[at_a].tolist()


def group_text(a: list[str], b: list[str], at_a: list[int], at_b: list[int]) -> str:
    """``a1,a2|b1;a3|b2,b3``: the groups that end with the given indices."""
    out, i, j = [], 0, 0
    for x, y in zip(at_a, at_b):
        left = a[i] if x == i else ",".join(a[i:x + 1])
        right = b[j] if y == j else ",".join(b[j:y + 1])
        out.append(left + "|" + right)
        i, j = x + 1, y + 1
    return ";".join(out)


def groups(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """``uid, doc_id, n_a, n_b, n_groups, groups_sha256`` and ``links``, the
    linked pairs' numbers one after another."""
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sides(byte_path, piece_path)
        names = own.names.__getitem__
        for batch in batches:
            counts, hashes, links = [], [], []
            for text in batch.column("text").to_pylist():
                a, b = own.ids(text)
                if not a:
                    counts.append((0, 0, 0))
                    hashes.append("")
                    links.append(b"")
                    continue
                ids_a, ids_b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
                at_a, at_b = common_ends(np.cumsum(own.a_size[ids_a]), np.cumsum(own.b_size[ids_b]))
                counts.append((len(a), len(b), len(at_a)))
                text = group_text(list(map(names, a)), list(map(names, b)), at_a, at_b)
                hashes.append(hashlib.sha256(text.encode()).hexdigest())
                links.append((ids_a[at_a] * own.base + ids_b[at_b]).astype(own.pair).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("uid"), batch.column("doc_id"),
                 *[pa.array([c[i] for c in counts], pa.int64()) for i in range(3)],
                 pa.array(hashes, pa.string()), pa.array(links, pa.binary())],
                ["uid", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return (docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text")
            .mapInArrow(align, f"uid long, doc_id {kind}, n_a long, n_b long, n_groups long, "
                               "groups_sha256 string, links binary"))


def pair_counts(found: DataFrame, base: int, pair: np.dtype) -> DataFrame:
    """``pair, n, best``: how often each id pair is linked in all documents,
    and whether no pair with the same B id is linked more often."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def out() -> pa.RecordBatch:
            pairs, n = np.unique(np.frombuffer(b"".join(held), pair), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64)), pa.array(n, pa.int64())], ["pair", "n"])
        for batch in batches:
            for links in batch.column(0).to_pylist():
                held.append(links)
                size += len(links) // pair.itemsize
                if size >= FLUSH:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    counts = stage(found.select("links").mapInArrow(count, "pair long, n long")
                   .groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    b_id = F.pmod("pair", F.lit(base)).alias("b_id")
    most = counts.groupBy(b_id).agg(F.max("n").alias("most"))  # as many rows as B has ids
    return stage(counts.withColumn("b_id", b_id).join(F.broadcast(most), "b_id")
                 .select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")


def align(docs: DataFrame, byte_path: str, piece_path: str, share: float = SHARE) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256`` of every row.

    Side A is a byte-level file and sees a space before the text, side B a
    piece model that adds its own. Null and empty texts, and those that a side
    does not spell back, have no tokens: zeros and an empty hash. Repeated rows
    and ids stay rows of their own and count each time; of ties for a B id's
    most frequent partner all are best; texts of any length are aligned whole,
    in time linear in their tokens and bytes, one text in a task; an empty table gives no
    rows. Only ``doc_id`` and ``text`` are read. ``share`` decides how a pair
    meets its count, never the count.
    """
    spark = docs.sparkSession
    own = sides(byte_path, piece_path)
    base, pair = own.base, own.pair
    found = stage(groups(docs, byte_path, piece_path), "groups")
    counts = pair_counts(found, base, pair)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = max(2, int(np.ceil(total * share)))
    head = counts.where(F.col("n") >= least).orderBy("pair").toPandas()  # at most 1 / share rows
    shared = spark.sparkContext.broadcast((head["pair"].to_numpy(np.int64), head["n"].to_numpy(np.int64),
                                           head["best"].to_numpy(np.int64)))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row a document with its frequent pairs' sums (its key: below
        zero), and one for each other distinct pair of it."""
        pairs, n, best = shared.value
        for batch in batches:
            uid, links = batch.column("uid").to_numpy(), batch.column("links").to_pylist()
            codes = np.frombuffer(b"".join(links), pair).astype(np.int64)
            doc = np.repeat(np.arange(len(links)), [len(x) // pair.itemsize for x in links])
            place = np.minimum(np.searchsorted(pairs, codes), max(len(pairs) - 1, 0))
            known = pairs[place] == codes if len(pairs) else np.zeros(len(codes), dtype=bool)
            sums = np.zeros((2, len(links)), dtype=np.int64)
            np.add.at(sums[0], doc[known], best[place[known]])
            np.add.at(sums[1], doc[known], n[place[known]])
            rest, times = np.unique(np.stack([doc[~known], codes[~known]]), axis=1, return_counts=True)
            m, none = len(uid), np.zeros(rest.shape[1], dtype=np.int64)
            columns = ([uid, uid[rest[0]]], [-1 - uid, rest[1]], [np.zeros(m, dtype=np.int64), times],
                       [sums[0], none], [sums[1], none])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in columns],
                                             ["uid", "key", "times", "n_best", "count_sum"])

    rare = counts.where(F.col("n") < least)
    sums = (found.select("uid", "links").mapInArrow(meet, "uid long, key long, times long, n_best long, count_sum long")
            .join(rare, F.col("key") == F.col("pair"), "left").groupBy("uid")
            .agg(F.sum(F.col("n_best") + F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
                 F.sum(F.col("count_sum") + F.coalesce(F.col("n") * F.col("times"), F.lit(0))).alias("count_sum")))
    return (found.select("uid", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256").join(sums, "uid")
            .select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum",
                    "groups_sha256"))
