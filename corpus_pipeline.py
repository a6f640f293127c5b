"""A training corpus from ``documents``: language, near-duplicates, personal
data, source mix, packed sequences.

Each stage takes the rows its predecessor kept and reads only the columns of
``documents``, so extra columns may have any name and are dropped. Empty tables
stay empty. Null texts have no language and leave with the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import lang_id, mixing, packing, pii, simhash_dedup
from quarry.llm.common import prepare, read, stage
from quarry.llm.queries import MIX_WEIGHTS, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text whose best language is less likely than this is rejected.
MIN_LANGUAGE_SCORE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and texts of no clear language; the language
    of a document without one is filled in."""
    prepare(spark)
    rows = docs.select(*COLUMNS)
    found = lang_id.predict(rows, lang_id.fit(rows), COLUMNS)
    kept = found.where((F.col("lang_pred") != lang_id.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates."""
    prepare(spark)
    return simhash_dedup.keep_one(docs.select(*COLUMNS), shingle=3, max_bits=2)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by tags; ``n_chars`` follows the text."""
    prepare(spark)
    rows = docs.select(*COLUMNS)
    return _sized(pii.redact(rows, pii.train(rows)))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's documents: one row for each repetition, parts cut at a word."""
    prepare(spark)
    mixed = mixing.mix(docs.select(*COLUMNS), MIX_WEIGHTS, factor=1.5, max_epochs=2.0, carry=COLUMNS)
    return _sized(mixing.expand(mixed, COLUMNS))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: one row a piece."""
    prepare(spark)
    return packing.pack(docs.select(*COLUMNS), tokenizer_path("byte_bpe_50k.json"), 2048, end_id=0)


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


STAGES = [
    ("language_id", language_stage),
    ("near_dedup", near_dedup_stage),
    ("personal_data", personal_data_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Trained models and fingerprints have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written below the shared folder."""
    prepare(spark)
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
