"""Log-likelihood of whole documents under a gated recurrent language model.

From all training rows come the counts of every token; frequent tokens (a
share of ``SHARE`` or more of all, so at most 1/SHARE of them) go to all tasks,
the most frequent WORDS - 2 are the model's own words. The model starts from
the corpus frequencies, takes a first course over at most ``warm_docs`` drawn
documents on the driver, and then learns from all training documents in
``ROUNDS`` rounds, each over its own part of them: replicas of about
``REPLICA`` tokens each go on from the last average, and their weights are
averaged by tokens in a tree.

A token that is no word of the model costs P(rare | state) times its smoothed
share among the training tokens that are no words of the model. Tokens that
are not frequent meet their counts in a join by token; a document's sums come
together by its row number. Texts themselves are never moved, only their word
numbers in the model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import gru
from quarry.llm.common import stage

SHARE = 1e-6
ROUNDS = 4         # each training document teaches in one of them
BATCH = 256        # parallel parts of a replica's stream, fewer if it is short
WINDOW = 32        # steps that errors go back
REPLICA = 1_000_000
GROUP = 3_000_000  # tokens scored together, about
WARM_TOKENS = 4096 # documents of the first course have no more
FLUSH = 32 << 20    # bytes of counted tokens that a task keeps


def words_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all ``texts`` one after the other, A-Z lower-cased, and how
    many each text has: what ``common.words_of`` gives, a whole batch at once.

    Arrow's ASCII whitespace is space and 0x09-0x0D; a text that begins or ends
    with it, or has nothing else, gives empty words, which are none.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = split.flatten()
    real = pc.greater(pc.binary_length(words), 0)
    owner = np.repeat(np.arange(len(texts)), split.value_lengths().to_numpy())
    n = np.bincount(owner[real.to_numpy(zero_copy_only=False)], minlength=len(texts))
    return words.filter(real), n


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of a partition; the empty word counts the end tokens."""
    held: list[pa.RecordBatch] = []

    def merged() -> list[pa.RecordBatch]:
        table = pa.Table.from_batches(held).group_by("word", use_threads=False).aggregate([("n", "sum")])
        return table.select(["word", "n_sum"]).rename_columns(["word", "n"]).combine_chunks().to_batches()

    for batch in batches:
        found = pc.value_counts(words_in(batch.column(0))[0])
        held += [pa.RecordBatch.from_arrays([found.field(0).cast(pa.string()), found.field(1)], ["word", "n"]),
                 pa.RecordBatch.from_arrays([pa.array([""]), pa.array([batch.num_rows], pa.int64())], ["word", "n"])]
        if sum(b.nbytes for b in held) > 2 * FLUSH:
            held = merged()
            if sum(b.nbytes for b in held) > FLUSH:
                yield from held
                held = []
    if held:
        yield from merged()


@dataclass
class Vocabulary:
    """Frequent tokens by falling count, with log10(count + 0.5) of each."""

    index: dict[bytes, int]
    log_counts: np.ndarray
    end_log_count: float
    end_known: bool

    def numbers(self, words: pa.Array) -> np.ndarray:
        found = words.cast(pa.binary()).to_numpy(zero_copy_only=False)
        return np.fromiter(map(self.index.get, found, repeat(-1)), dtype=np.int64, count=len(found))

    @staticmethod
    def ids(k: np.ndarray) -> np.ndarray:
        """The model's numbers of words."""
        return np.where((k >= 0) & (k < gru.WORDS - 2), k + 2, gru.RARE).astype(np.uint16)


@dataclass
class Totals:
    tokens: int        # N
    distinct: int      # V
    rare_tokens: int   # of training tokens that are no words of the model
    rare_distinct: int


def count_tokens(train: DataFrame) -> DataFrame:
    return stage(train.select("text").mapInArrow(_count, "word string, n long")
                 .groupBy("word").agg(F.sum("n").alias("n")), "counts")


def vocabulary(counts: DataFrame) -> tuple[Vocabulary, Totals, np.ndarray, int]:
    """The vocabulary, the totals, the model's word counts, and the count from
    which a token is frequent."""
    tokens, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("n")).first()
    least = max(2, int(np.ceil(tokens * SHARE)))
    rows = counts.where((F.col("n") >= least) & (F.col("word") != "")).collect()  # at most 1 / SHARE
    rows.sort(key=lambda r: (-r["n"], r["word"]))
    end = counts.where("word = ''").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    numbers = np.array([r["n"] for r in rows], dtype=float)
    own = numbers[:gru.WORDS - 2]
    model_counts = np.zeros(gru.WORDS)
    model_counts[gru.END], model_counts[2:2 + len(own)] = end, own
    model_counts[gru.RARE] = tokens - end - own.sum()
    vocab = Vocabulary({r["word"].encode(): i for i, r in enumerate(rows)}, np.log10(numbers + 0.5),
                       float(np.log10(end + 0.5)), end > 0)
    totals = Totals(int(tokens), int(distinct), int(model_counts[gru.RARE]),
                    int(distinct) - (end > 0) - len(own))
    return vocab, totals, model_counts, least


_CODED = ("uid long, doc_id {kind}, held_out boolean, draw long, n_tokens long, n_frequent long, n_rare long, "
          "frequent double, rare double, ids binary, tail array<string>, tail_n array<int>")
_CODED_NAMES = [f.split()[0] for f in _CODED.split(", ")]


def _sums(log_counts: np.ndarray, k: np.ndarray, owner: np.ndarray, docs: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every document: how many words are numbered ``least`` or more, and
    the sum of their logarithms."""
    some = k >= least
    n = np.bincount(owner[some], minlength=docs)
    logs, ends = log_counts[k[some]], np.cumsum(n).tolist()
    return n, np.array([logs[a:b].sum() for a, b in zip([0, *ends], ends)])


def _tails(at: np.ndarray, places: np.ndarray, owner: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the tokens at ``places``: each document's distinct words in the order
    they come, how often each does, and how many of them a document has."""
    _, first, n = np.unique((owner[places] << 32) + at[places], return_index=True, return_counts=True)
    order = np.argsort(first)
    first = places[first[order]]
    return at[first], n[order], np.bincount(owner[first], minlength=docs)


def _coded(batch: pa.RecordBatch, v: Vocabulary) -> pa.RecordBatch:
    """The texts of a batch as word numbers, worked off all at once."""
    words, n = words_in(batch.column("text"))
    coded = words.dictionary_encode()
    at = coded.indices.to_numpy()
    distinct = v.numbers(coded.dictionary)  # each word of the batch is looked up once
    k, owner = distinct[at], np.repeat(np.arange(len(n)), n)
    # A document's numbers, two bytes each, its end token last.
    ends = np.cumsum(n + 1)
    ids = np.full(len(k) + len(n), gru.END, np.uint16)
    ids[np.arange(len(k)) + owner] = v.ids(distinct)[at]
    n_known, frequent = _sums(v.log_counts, k, owner, len(n), 0)
    n_other, other = _sums(v.log_counts, k, owner, len(n), gru.WORDS - 2)
    tail, tail_n, n_tail = _tails(at, np.flatnonzero(k < 0), owner, len(n))
    lists = pa.array(np.concatenate([[0], np.cumsum(n_tail)]), pa.int32())
    return pa.RecordBatch.from_arrays(
        [*[batch.column(c) for c in _CODED_NAMES[:4]],
         pa.array(n + 1, pa.int64()), pa.array(n_known + v.end_known, pa.int64()),
         pa.array(n - n_known + n_other, pa.int64()),
         pa.array(frequent + v.end_log_count, pa.float64()), pa.array(other, pa.float64()),
         pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(
             np.concatenate([[0], 2 * ends]).astype(np.int32)), pa.py_buffer(ids)]),
         pa.ListArray.from_arrays(lists, coded.dictionary.take(pa.array(tail)).cast(pa.string())),
         pa.ListArray.from_arrays(lists, pa.array(tail_n, pa.int32()))], _CODED_NAMES)


def code(rows: DataFrame, vocab: Vocabulary, seed: int = 3) -> DataFrame:
    """Every document once as word numbers (``ids``, two bytes each), with the
    sums of its frequent tokens and its other tokens with their counts. Written
    once: the rounds and the scoring read this, the texts are not split again."""
    shared = rows.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _coded(batch, shared.value)

    kind = rows.schema["doc_id"].dataType.simpleString()
    drawn = rows.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "held_out",
                        F.xxhash64(F.lit(seed), "doc_id", "text").alias("draw"), "text")
    return stage(drawn.mapInArrow(run, _CODED.format(kind=kind)), "coded")


def _ids(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint16).astype(np.int32)


def learn(train: DataFrame, model_counts: np.ndarray, warm_docs: int) -> dict[str, np.ndarray]:
    """Weights from the coded training documents."""
    weights = gru.fresh(model_counts)
    coded = train.select("draw", "ids", "n_tokens").withColumn("round", F.pmod("draw", F.lit(ROUNDS)))
    short = coded.where(F.col("n_tokens") <= WARM_TOKENS)
    last = short.select("draw").orderBy("draw").limit(warm_docs).agg(F.max("draw")).first()[0]
    if last is not None:
        warm = short.where(F.col("draw") <= last).select("draw", "ids").limit(warm_docs).collect()
        warm.sort(key=lambda r: (r["draw"], r["ids"]))
        gru.train(weights, np.concatenate([_ids(r["ids"]) for r in warm]), rate=0.2)
    sizes = coded.groupBy("round").agg(F.sum("n_tokens").alias("n")).collect()
    for r in sorted(sizes, key=lambda r: r["round"]):
        # Dealt evenly, without a key: as many replicas as the tokens need, however many shuffle partitions there are.
        share = (coded.where(F.col("round") == r["round"]).select("draw", "ids")
                 .repartition(max(1, round(r["n"] / REPLICA))).sortWithinPartitions("draw", "ids"))
        weights = _averaged(share, weights)
    return weights


def _averaged(share: DataFrame, weights: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The mean weights, by tokens, of one replica a partition of ``share``."""
    start = share.sparkSession.sparkContext.broadcast(weights)

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream: list[np.ndarray] = []
        own = {k: w.copy() for k, w in start.value.items()}
        seen = 0

        def course() -> None:
            nonlocal stream, seen
            ids = np.concatenate(stream)
            gru.train(own, ids, batch=max(1, min(BATCH, len(ids) // 16)), window=WINDOW, rate=0.14)
            seen += len(ids)
            stream = []
        held = 0
        for batch in batches:
            for ids in batch.column("ids").to_pylist():
                stream.append(_ids(ids))
                held += len(stream[-1])
                if held >= REPLICA:
                    course()
                    held = 0
        if stream:
            course()
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array([seen], pa.int64()), pa.array([np.concatenate([own[k].ravel() for k in gru.NAMES]).tobytes()],
                                                        pa.binary())], ["tokens", "weights"])

    found = stage(share.mapInArrow(refine, "tokens long, weights binary"), "replicas")
    sums = found.rdd.map(lambda r: (r["tokens"], r["tokens"] * np.frombuffer(r["weights"], np.float32)))
    n, total = sums.treeReduce(lambda a, b: (a[0] + b[0], a[1] + b[1]), depth=3)
    flat, at, out = (total / n).astype(np.float32), 0, {}
    for k in gru.NAMES:
        out[k] = flat[at:at + weights[k].size].reshape(weights[k].shape)
        at += weights[k].size
    return out


def score(docs: DataFrame, held_out: Column, warm_docs: int = 1500) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``
    of every row of ``docs`` (``doc_id, text``).

    Rows where ``held_out`` is not true teach. Null and empty texts are an end
    token alone; repeated rows count each time; a text of any length is scored
    whole, one task holding it as two bytes a token; an empty table gives no
    rows. Only ``doc_id`` and ``text`` are read.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    counts = count_tokens(rows.where(~F.col("held_out")))
    vocab, totals, model_counts, least = vocabulary(counts)
    coded = code(rows, vocab)
    weights = learn(coded.where(~F.col("held_out")), model_counts, warm_docs)
    shared = spark.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        uids: list[int] = []
        size = 0

        def out() -> pa.RecordBatch:
            model = gru.score(shared.value, held) / np.log(10)
            return pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), pa.array(model, pa.float64())], ["uid", "model"])
        for batch in batches:
            for uid, ids in zip(batch.column("uid").to_pylist(), batch.column("ids").to_pylist()):
                held.append(np.frombuffer(ids, np.uint16))
                uids.append(uid)
                size += len(held[-1])
                if size >= GROUP:
                    yield out()
                    held, uids, size = [], [], 0
        if held:
            yield out()

    model = coded.select("uid", "ids").mapInArrow(run, "uid long, model double")
    rest = counts.where((F.col("n") < least) & (F.col("word") != "")).select("word", F.col("n").alias("c"))
    tail = (coded.select("uid", F.inline(F.arrays_zip("tail", "tail_n")))
            .join(rest, F.col("tail") == F.col("word"), "left").withColumn("c", F.coalesce("c", F.lit(0)))
            .groupBy("uid").agg(F.sum(F.col("tail_n") * F.log10(F.col("c") + F.lit(0.5))).alias("tail"),
                                F.sum(F.when(F.col("c") > 0, F.col("tail_n")).otherwise(0)).alias("tail_known")))
    own = coded.select("uid", "doc_id", "held_out", "n_tokens", "n_frequent", "n_rare", "frequent", "rare")
    sums = own.join(model, "uid").join(tail, "uid", "left").fillna(0, ["tail", "tail_known"])
    base_norm = float(np.log10(totals.tokens + 0.5 * (totals.distinct + 1)))
    rare_norm = float(np.log10(totals.rare_tokens + 0.5 * (totals.rare_distinct + 1)))
    return sums.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_frequent") + F.col("tail_known")).alias("n_known"),
        F.lit(totals.tokens).cast("long").alias("train_tokens"),
        (F.col("frequent") + F.col("tail") - F.col("n_tokens") * base_norm).alias("base_score"),
        (F.col("model") + F.col("rare") + F.col("tail") - F.col("n_rare") * rare_norm).alias("score"))
