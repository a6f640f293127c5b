"""Language identification: sparse multinomial logistic regression on TF-IDF
character n-grams, trained with follow-the-regularised-leader (FTRL-proximal,
elastic net) and calibrated by a temperature.

Texts are lower-cased, runs of non-letters become one space, and n-grams of one
to three characters are hashed to ``DIMS`` features. Document frequencies cover
all training rows. Only the regression itself sees a bounded sample: about
``max_train_docs`` labelled rows (never over twice as many), as many of each
language, drawn by a hash; every fifth of them calibrates instead of training.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from quarry.llm.common import stage

DIMS = 1 << 15
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and their counts; none for a text without letters."""
    none = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32)
    if not text:
        return none
    chars = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")
    letter = _letters()[chars]
    if not letter.any():
        return none
    keep = letter | np.concatenate(([True], letter[:-1]))  # the first of each run of others
    chars = np.where(letter, chars, 32)[keep].astype(np.uint32)
    grams, seen = chars, []
    for n in range(3):
        if n:
            grams = grams[:-1] * np.uint32(0x01000193) + chars[n:]
        mixed = (grams + np.uint32(n + 1)) * np.uint32(0x9E3779B1)
        seen.append(mixed >> np.uint32(17))
    counts = np.bincount(np.concatenate(seen), minlength=DIMS)
    index = np.flatnonzero(counts)
    return index.astype(np.int32), counts[index].astype(np.int32)


@dataclass
class Model:
    labels: list[str]
    idf: np.ndarray       # (DIMS,)
    weights: np.ndarray   # (DIMS + 1, labels); the last row is the bias
    temperature: float = 1.0

    def vector(self, index: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = (1 + np.log(counts)) * self.idf[index]
        x = x / max(np.linalg.norm(x), 1e-12)
        return np.append(index, DIMS), np.append(x, 1.0)

    def logits(self, index: np.ndarray, counts: np.ndarray) -> np.ndarray:
        at, x = self.vector(index, counts)
        return x @ self.weights[at]

    def predict(self, text: str | None) -> tuple[str, float]:
        index, counts = features(text)
        if not len(index) or not self.labels:
            return UNKNOWN, 0.0
        p = _softmax(self.logits(index, counts) / self.temperature)
        best = int(p.argmax())
        return self.labels[best], float(p[best])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(model: Model, rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 3, alpha: float = 0.5,
         beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> None:
    """Set the weights by FTRL-proximal over ``rows`` (features, counts, label)."""
    z = np.zeros_like(model.weights)
    n = np.zeros_like(model.weights)

    def weights(at) -> np.ndarray:
        zi = z[at]
        shrunk = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(zi) <= l1, 0.0, shrunk)

    for _ in range(epochs):
        for index, counts, label in rows:
            at, x = model.vector(index, counts)
            w = weights(at)
            error = _softmax(x @ w)
            error[label] -= 1
            g = x[:, None] * error
            old = n[at]
            new = old + g * g
            z[at] += g - (np.sqrt(new) - np.sqrt(old)) / alpha * w
            n[at] = new
    model.weights = weights(slice(None))


def calibrate(model: Model, rows: list[tuple[np.ndarray, np.ndarray, int]]) -> None:
    """Temperature of least log loss over held-back rows, by golden section."""
    if not rows:
        return
    logits = np.stack([model.logits(i, c) for i, c, _ in rows])
    truth = np.array([label for *_, label in rows])

    def loss(log_t: float) -> float:
        p = _softmax(logits / np.exp(log_t))[np.arange(len(truth)), truth]
        return float(-np.log(np.maximum(p, 1e-12)).mean())

    low, high, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    model.temperature = float(np.exp((low + high) / 2))


def _document_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, rows = np.zeros(DIMS + 1, dtype=np.int64), 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            seen[features(text)[0]] += 1
            rows += 1
    seen[DIMS] = rows
    yield pa.RecordBatch.from_pydict({"feature": pa.array(np.arange(DIMS + 1), pa.int32()), "n": pa.array(seen)})


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [features(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("lang"), batch.column("draw"), pa.array([i.tobytes() for i, _ in found], pa.binary()),
             pa.array([c.tobytes() for _, c in found], pa.binary())], ["lang", "draw", "features", "counts"])


def fit(docs: DataFrame, max_train_docs: int = 4000, seed: int = 11) -> Model:
    """Learn from ``docs`` (``doc_id, text, lang``); rows without text or lang
    teach nothing. Without labels every prediction is ``und``.
    """
    rows = (docs.select("text", "lang", F.xxhash64(F.lit(seed), "doc_id", "text").alias("draw"))
            .where(F.col("text").isNotNull() & F.col("lang").isNotNull()))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    labels = sorted(sizes)  # one row a language
    frequency = stage(rows.select("text").mapInArrow(_document_frequency, "feature int, n long")
                      .groupBy("feature").agg(F.sum("n").alias("n")), "df").collect()
    df = np.zeros(DIMS + 1)
    for r in frequency:
        df[r["feature"]] = r["n"]
    idf = np.log((1 + df[DIMS]) / (1 + df[:DIMS])) + 1
    model = Model(labels, idf, np.zeros((DIMS + 1, len(labels))))
    if not labels:
        return model
    # Draws are uniform: a share of their range takes about as many rows of each language.
    each = max(1, max_train_docs // len(labels))
    limit = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(min(2**63 - 1, int(2**64 * each / n) - 2**63)))
                         for lang, n in sizes.items()])
    sample = (rows.where(F.col("draw") <= limit).limit(2 * max_train_docs)
              .mapInArrow(_extract, "lang string, draw long, features binary, counts binary").collect())
    taught = [(np.frombuffer(r["features"], np.int32), np.frombuffer(r["counts"], np.int32),
               labels.index(r["lang"]), r["draw"]) for r in sample]
    taught.sort(key=lambda r: (r[3], r[2], r[0].tobytes()))
    taught = [r[:3] for r in taught if len(r[0])]
    ftrl(model, [r for i, r in enumerate(taught) if i % 5])
    calibrate(model, taught[::5])
    return model


_FOUND = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())])


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of every row with ``lang_pred, score``.

    Only the text decides. Null texts and texts without letters are ``und``
    with score 0; every other text gets a learned language with its calibrated
    probability. Repeated rows agree; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(_FOUND)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    return docs.select(*keep, run("text").alias("found")).select(*keep, "found.*")


def remainder(divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor`` (null for a null id)."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor
