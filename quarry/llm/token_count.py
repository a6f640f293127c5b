"""Token counts without token ids: pieces are counted once per distinct
pre-token and summed over each document's pre-token frequencies.

The tokenizer is a byte-fallback BPE whose pieces never hold a space after
another character, nor a line feed beside one, so no merge crosses from a
character to a space or touches a line feed. A text (with the space that the
library puts before it) thus falls apart into pre-tokens - a run of spaces and
line feeds with what follows it - whose pieces can be counted alone. That
property is checked when a model is loaded.

Frequent pre-tokens (a share of ``share`` or more of a sampled part's, so at
most 1 / ``share`` of them) are counted on the driver and sent to all tasks.
All others of every document move by their hash, so each distinct one meets in
one place and is counted there once. The sample only decides which way a
pre-token goes; the counts are exact.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import stage

SHARE = 1e-6
SAMPLE = 1 / 16
_PIECE = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_SPACE = "▁"  # the library's own sign for a space; in a text it is one


@lru_cache(maxsize=2)
def load(path: str) -> sentencepiece.SentencePieceProcessor:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if re.search(f"[^{_SPACE}]{_SPACE}", piece) or "\n" in piece:
            raise ValueError(f"piece {piece!r} crosses pre-tokens")
    return model


def pre_tokens(text: str) -> list[str]:
    return _PIECE.findall(" " + text.replace(_SPACE, " ")) if text else []


def count_pieces(model: sentencepiece.SentencePieceProcessor, tokens: list[str]) -> list[int]:
    """Pieces of each pre-token where it stands in its text.

    The library puts a space before what it is given: in place of a
    pre-token's own first space, or one piece too many before a line feed.
    """
    own = [t[0] == " " for t in tokens]
    ids = model.encode([t[1:] if s else t for t, s in zip(tokens, own)], num_threads=1)
    return [1 if t == " " else len(i) - (not s) for t, i, s in zip(tokens, ids, own)]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"token": pa.array(list(found), pa.string()),
                                           "n": pa.array(list(found.values()), pa.int64())})
    for batch in batches:
        for text in batch.column(0).to_pylist():
            found.update(pre_tokens(text or ""))
            if len(found) > 500_000:
                yield out()
                found.clear()
    yield out()


def frequent_tokens(docs: DataFrame, share: float = SHARE, sample: float = SAMPLE) -> list[str]:
    """Pre-tokens with at least ``share`` of the sampled ones: 1/share at most."""
    found = (docs.select("text").sample(sample, seed=1).mapInArrow(_frequencies, "token string, n long")
             .groupBy("token").agg(F.sum("n").alias("n")))
    found = stage(found, "tokens")
    least = (found.agg(F.sum("n")).first()[0] or 0) * share
    return [r[0] for r in found.where(F.col("n") >= max(least, 2)).select("token").collect()]


def token_counts(docs: DataFrame, model_path: str, share: float = SHARE, sample: float = SAMPLE) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every row's whole text.

    Null texts count as empty: no bytes, no tokens. Repeated rows and ids stay
    rows of their own; an empty table gives no rows; only ``doc_id`` and
    ``text`` are read. Strings like ``<s>`` inside a text are plain text, as
    the library takes them by default.
    """
    spark = docs.sparkSession
    head = frequent_tokens(docs, share, sample)
    head_pieces = spark.sparkContext.broadcast(dict(zip(head, count_pieces(load(model_path), head))))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row a document with its frequent part, and one for each other
        distinct pre-token of it."""
        known = head_pieces.value
        for batch in batches:
            ids, docs_, texts = (c.to_pylist() for c in batch.columns)
            for at in range(0, len(ids), 256):
                uid, doc, size, tokens, times = [], [], [], [], []
                for u, d, t in zip(ids[at:at + 256], docs_[at:at + 256], texts[at:at + 256]):
                    t = t or ""
                    total, rest = 0, []
                    for token, n in Counter(pre_tokens(t)).items():
                        pieces = known.get(token)
                        if pieces is None:
                            rest.append((token, n))
                        else:
                            total += pieces * n
                    uid += [u] * (len(rest) + 1)
                    doc += [d] + [None] * len(rest)
                    size += [len(t.encode("utf-8", "replace"))] + [None] * len(rest)
                    tokens += [None] + [r[0] for r in rest]
                    times += [total] + [r[1] for r in rest]
                yield pa.RecordBatch.from_pydict({
                    "uid": pa.array(uid, pa.int64()), "doc_id": pa.array(doc, batch.schema.field(1).type),
                    "n_bytes": pa.array(size, pa.int64()), "token": pa.array(tokens, pa.string()),
                    "n": pa.array(times, pa.int64())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come ordered by pre-token: each distinct one is counted once,
        or once more where a batch ends within its rows."""
        model = load(model_path)
        for batch in batches:
            coded = batch.column("token").dictionary_encode()
            codes = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)  # -1: a document's own row
            pieces = np.array([*count_pieces(model, coded.dictionary.to_pylist()), 1], dtype=np.int64)
            n = pieces[codes] * batch.column("n").to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n)], ["uid", "doc_id", "n_bytes", "n"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = (docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text")
            .mapInArrow(split, f"uid long, doc_id {kind}, n_bytes long, token string, n long"))
    # A document's own row has no pre-token and goes by its number.
    slot = F.when(F.col("token").isNull(), F.col("uid")).otherwise(F.xxhash64("token"))
    counted = (rows.repartition(slot).sortWithinPartitions("token")
               .mapInArrow(count, f"uid long, doc_id {kind}, n_bytes long, n long"))
    return (counted.groupBy("uid").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"),
                                       F.sum("n").alias("n_tokens")).drop("uid"))
