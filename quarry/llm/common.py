"""Helpers shared by the training-data operators.

``stage`` cuts lineage by writing a Parquet table below the shared checkpoint
folder and reading it again: what has been computed once survives the loss of
an executor. ``connected_components`` works on edge tables only; nothing of
the graph reaches the driver but one checksum row a round.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import ensure_checkpoint_dir, scratch_dir

#: Word boundary of all contracts: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Rows and bytes of texts that go to a Python worker at once.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def prepare(spark: SparkSession) -> None:
    """Shared folder for written tables, and bounds on what a Python worker and
    its executor hold at once: Spark's default of 10,000 rows a batch counts
    rows, not the length of their texts. Smaller settings of the session stay.
    """
    ensure_checkpoint_dir(spark)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{table}.parquet"))


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once below the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only, as the contracts ask; other letters stay."""
    return F.translate(c, UPPER, LOWER)


def words_of(text: str | None) -> list[bytes]:
    """Words of a whole text as UTF-8, A-Z lower-cased.

    ``bytes.split()`` splits exactly at space and 0x09-0x0D, and
    ``bytes.lower()`` touches only A-Z.
    """
    return text.encode("utf-8", "replace").lower().split() if text else []


def _signature(edges: DataFrame) -> tuple:
    h = F.xxhash64("child", "parent").cast("decimal(38,0)")
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(h).alias("s")).first()
    return row["n"], row["s"]


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Smallest node reachable, for every node of an edge table that is not it.

    Star contraction: each round points every child at the smallest parent of
    its parent, then links all parents of a child to the smallest of them, so
    the number of rounds grows with the logarithm of the longest path. A node
    with very many neighbours costs only partial minima and a join that
    adaptive execution may split. Nulls, loops and repeated edges are ignored.

    Returns ``(node, root)``; a node that is its own root has no row.
    """
    hi, lo = F.greatest(a, b), F.least(a, b)
    cur = stage(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
                .select(hi.alias("child"), lo.alias("parent")).distinct(), "cc")
    seen = _signature(cur)
    while seen[0]:
        up = cur.groupBy(F.col("child").alias("parent")).agg(F.min("parent").alias("up"))
        large = (cur.join(up, "parent", "left")
                 .select("child", F.coalesce("up", "parent").alias("parent")).distinct())
        large = stage(large, "cc")
        least = large.groupBy("child").agg(F.min("parent").alias("least"))
        small = (large.join(least, "child")
                 .select(F.when(F.col("parent") == F.col("least"), F.col("child"))
                         .otherwise(F.col("parent")).alias("child"), F.col("least").alias("parent"))
                 .distinct())
        cur = stage(small, "cc")
        now = _signature(cur)
        if now == seen:
            break
        seen = now
    return cur.select(F.col("child").alias("node"), F.col("parent").alias("root"))
