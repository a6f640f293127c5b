"""Global dense positions and id assignment (W1) without a single-partition
window.

Plan: range-partition on the order key, sort within partitions, stamp each
row with ``(partition id, monotonically increasing id)`` and checkpoint
(reliable, into ``spark.checkpoint.dir``) so both passes see identical
partitions. Per-partition counts (one row per partition) are the only thing
the driver sees; the prefix offsets go back as a broadcast table whose size
is bounded by the partition count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.plans.views import format_id
from quarry.session import ensure_checkpoint_dir

_LOW33 = (1 << 33) - 1


def dense_index(df: DataFrame, order_cols: list, name: str = "pos", start: int = 0,
                num_partitions: int | None = None) -> DataFrame:
    """Add ``name`` = start + 0-based position of the row in ``order_cols`` order.

    ``order_cols`` must be a total order (unique) for the result to be stable.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    stamped = (df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
               .withColumn("_pid", F.spark_partition_id())
               .withColumn("_mid", F.monotonically_increasing_id())
               .checkpoint(eager=True))
    counts = sorted((r["_pid"], r["count"]) for r in stamped.groupBy("_pid").count().collect())
    offsets, acc = [], start
    for pid, cnt in counts:
        offsets.append((pid, acc))
        acc += cnt
    if not offsets:
        return stamped.drop("_pid", "_mid").withColumn(name, F.lit(None).cast("long"))
    odf = spark.createDataFrame(offsets, "_pid int, _off long")
    out = stamped.join(F.broadcast(odf), "_pid")
    return out.withColumn(name, F.col("_off") + F.col("_mid").bitwiseAND(F.lit(_LOW33))).drop(
        "_pid", "_mid", "_off")


def store_count(store: DataFrame) -> int:
    """Number of stored records (an aggregate, not a collect of rows)."""
    return int(store.agg(F.count(F.lit(1)).alias("n")).first()["n"])


def next_number(store: DataFrame | None, mode: str = "count") -> int:
    """First free number: ``count`` (the row count, default) or ``max`` of the
    numeric part of existing ids (safe after deletes)."""
    if store is None:
        return 1
    if mode == "max":
        m = store.agg(F.max(F.regexp_extract("id", r"(\d+)$", 1).cast("long")).alias("m")).first()["m"]
        return int(m or 0) + 1
    return store_count(store) + 1


def assign_ids(df: DataFrame, order_cols: list, store: DataFrame | None = None,
               prefix: str = "LL", mode: str = "count") -> DataFrame:
    """Ids ``PREFIX-%06d`` continuing after the store, in ``order_cols`` order."""
    first = next_number(store, mode)
    return dense_index(df, order_cols, "_num", start=first).withColumn(
        "id", format_id(F.col("_num"), prefix)).drop("_num")


def id_column(n: Column, prefix: str = "LL") -> Column:
    return format_id(n, prefix)
