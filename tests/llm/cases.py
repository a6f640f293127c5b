"""Odd rows that every operator must take: nulls in any column, empty and very
long texts, repeated rows and ids, and extra columns with clashing names."""
from pyspark.sql import functions as F

PROSE = "The quick brown fox jumps over the lazy dog near the river bank while seven ducks watch it quietly. "
LONG = " ".join(f"word{i % 997} und{i % 13}" for i in range(30_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [
    (1, PROSE * 3, "en", "a", 10), (2, None, "en", "a", 0), (3, "", None, None, 0), (4, PROSE * 3, "en", "b", 10),
    (4, PROSE * 3, "en", "b", 10), (None, "Lonely text without any id at all", "en", None, None),
    (5, LONG, "de", "a", None), (6, " \n\t\r\x0b\x0c ", "en", "b", 3), (7, "Ünïcode 漢字 🙂 text", None, "b", 9),
    (8, "UPPER case Words", "en", "c", 16), (9, "upper CASE words", "en", "c", 16),
]


def odd(spark, rows=ROWS):
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("uid", "fp", "root", "score", "token", "word", "n", "key", "size", "draw", "bucket", "spans", "base",
              "length", "part", "edge", "tie", "_t", "s", "host", "rule", "distance", "found", "held_out"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark, sf, n=None):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    return df.where(F.col("doc_id") < n) if n else df
