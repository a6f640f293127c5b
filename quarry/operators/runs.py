"""Run-level operators.

* ``shuffle_order`` - a seeded, reproducible random order: sort on
  ``md5(seed || key)`` then key (range-partitioned sort, no single task).
* ``generation_limit`` - the first ``n`` rows of an order: a top-k
  (``TakeOrderedAndProject``: each task keeps ``n`` rows, the driver merges
  ``n`` per task) - the limit *is* the feature here.
* ``retry_first_success`` - the earliest success of a key is a partial minimum,
  the attempts before it partial counts. Only a caller's cap ``k`` needs row
  numbers (a partial ``WindowGroupLimit`` then comes before the shuffle).
* ``run_summary`` - one grouped aggregation with partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.ids import dense_index

MAX_ATTEMPTS = 3  # fixed value: attempts per metadata key in a generation run


def shuffle_key(key, seed: str = "0"):
    return F.md5(F.concat(F.lit(str(seed)), F.col(key).cast("string")))


def shuffle_order(df: DataFrame, key: str, seed: str = "0", name: str = "position") -> DataFrame:
    """Add the 0-based position in the seeded shuffled order."""
    return dense_index(df.withColumn("_h", shuffle_key(key, seed)), ["_h", key], name).drop("_h")


def generation_limit(df: DataFrame, key: str, n: int, seed: str = "0") -> DataFrame:
    """The first ``n`` rows in the seeded order (top-k, not a full sort)."""
    return df.orderBy(shuffle_key(key, seed), F.col(key)).limit(n)


def retry_first_success(attempts: DataFrame, key: str = "key", order=("ts", "event_id"),
                        outcome: str = "outcome", k: int | None = None) -> DataFrame:
    """Per key, the attempts in order; the first ``inserted`` wins.

    Duplicates and failures are counted only for attempts before the win (all
    when none wins); ``k`` ends a key after its first ``k`` attempts. Output
    ``(key, status, success_attempt, n_attempts, n_duplicates, n_failures)``.

    Without ``k`` there is no window: the win's place in the order is a
    minimum, and what lies before it are counts, so a hot key is summed up
    where its rows are. ``order`` must be unique within a key.
    """
    at = F.struct(*order)
    if k is not None:
        w = Window.partitionBy(key).orderBy(*order)
        attempts = attempts.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")
    wins = (attempts.where(F.col(outcome) == "inserted").groupBy(F.col(key).alias("_key"))
            .agg(F.min(at).alias("_won")))
    j = attempts.join(wins, F.col(key).eqNullSafe(F.col("_key")), "left")
    won, before = F.col("_won").isNotNull(), F.col("_won").isNull() | (at < F.col("_won"))
    g = j.groupBy(key).agg(
        F.max(won).alias("_ok"), F.count_if(before).alias("_before"),
        F.count_if(before & (F.col(outcome) == "duplicate")).cast("int").alias("n_duplicates"),
        F.count_if(before & (F.col(outcome) == "failure")).cast("int").alias("n_failures"))
    n = (F.col("_before") + F.col("_ok").cast("int")).cast("int")
    return g.select(
        key, F.when(F.col("_ok"), F.lit("inserted")).otherwise(F.lit("failed")).alias("status"),
        F.when(F.col("_ok"), n).alias("success_attempt"), n.alias("n_attempts"), "n_duplicates", "n_failures")


# Event type -> run counter.
RUN_OUTCOMES = {"inserted": "purchase", "duplicates": "view", "failures": "error"}


def run_summary(events: DataFrame, run=None) -> DataFrame:
    """A4: inserted / duplicates / failures / elapsed seconds per run."""
    # zone-independent on TIMESTAMP_NTZ: calendar date and microsecond span
    run = run if run is not None else F.to_date("ts").cast("string")
    return events.groupBy(run.alias("run")).agg(
        *[F.count_if(F.col("event_type") == v).alias(k) for k, v in RUN_OUTCOMES.items()],
        (F.expr("timestampdiff(MICROSECOND, min(ts), max(ts))") / F.lit(1e6)).alias("elapsed_sec"))
