"""The composed generation run: attempts -> gate -> verdicts -> components ->
difficulty -> ids -> store -> index, with the run's counters.

The rule runs attempt by attempt: keys in their order, a few attempts each. An
attempt that duplicates the store or an earlier insert is a duplicate; else one
whose verdict fails is a failure; else it is inserted and ends its key. The run
ends with the insert that reaches ``limit``. As one plan over all attempts:
failed attempts can never be inserted, so keep-first among the valid ones (with
their keys as attempt groups, the store before them) decides the inserts; then
every attempt up to its key's end and the run's end is counted, and a failed
one is a duplicate if the store or an *earlier* insert is like it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import mock, scoring
from quarry.operators import ids, neardup, search
from quarry.sources import store as st


def attempt_outcomes(attempts: DataFrame, existing: DataFrame | None, limit: int | None = None,
                     t: float = neardup.THRESHOLD) -> DataFrame:
    """``attempts`` (``key, seq, id, title, statement, tags, valid``; ``seq`` is
    their order, unique) that the run makes, with ``outcome``."""
    rows = attempts.checkpoint()
    valid = rows.where("valid")
    inserted = (neardup.greedy_dedupe(valid, store=existing, t=t, limit=limit, group="key")
                .where("accepted").drop("accepted").checkpoint())
    if limit is not None:
        end = inserted.agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("end")).first()
        if end["n"] >= limit:
            rows = rows.where(F.col("seq") <= end["end"])
    ended = inserted.select(F.col("key").alias("_key"), F.col("seq").alias("_end"))
    made = rows.join(ended, F.col("key").eqNullSafe(F.col("_key")), "left").where(
        F.col("_end").isNull() | (F.col("seq") <= F.col("_end")))
    before = inserted.select("id", "seq", "title", "statement", "tags")
    if existing is not None:
        before = existing.select("id", F.lit(-1).cast("long").alias("seq"), "title", "statement", "tags").unionByName(before)
    failed = made.where("NOT valid").select("id", "seq", "title", "statement", "tags")
    like = (neardup.first_duplicate(failed, before, t).join(failed.select("id", "seq"), "id")
            .where(F.col("dup_seq") < F.col("seq")).select(F.col("id").alias("_like")).distinct())
    outcome = (F.when(F.col("seq") == F.col("_end"), "inserted")
               .when(F.col("valid") | F.col("_like").isNotNull(), "duplicate").otherwise("failure"))
    return (made.join(like, F.col("id") == F.col("_like"), "left").withColumn("outcome", outcome)
            .drop("_key", "_end", "_like"))


def counters(outcomes: DataFrame) -> DataFrame:
    """One row: what the run inserted, discarded and failed."""
    return outcomes.agg(F.count_if(F.col("outcome") == "inserted").alias("inserted"),
                        F.count_if(F.col("outcome") == "duplicate").alias("duplicates"),
                        F.count_if(F.col("outcome") == "failure").alias("failures"))


def generation_run(attempts: DataFrame, store_base: str, index_base: str, limit: int | None = None,
                   t: float = neardup.THRESHOLD) -> DataFrame:
    """Run, append the inserted records under new ids and rebuild the index.

    Returns the attempts made with ``outcome`` and ``new_id`` (inserts only).
    The records get offline components and analysed difficulty.
    """
    spark = attempts.sparkSession
    current = st.store_scan(spark, store_base)
    made = attempt_outcomes(attempts, current if st.versions(spark, store_base) else None, limit, t).checkpoint()
    new = ids.assign_ids(made.where("outcome = 'inserted'").withColumn("attempt_id", F.col("id")), ["seq"],
                         store=current).checkpoint()
    records = mock.mock_components(new).withColumn("time_complexity", F.col("editorial.time_complexity"))
    st.store_append(scoring.with_final_difficulty(records), store_base)
    stored = st.store_scan(spark, store_base).withColumns({
        "time_complexity": F.col("editorial.time_complexity"), "space_complexity": F.col("editorial.space_complexity")})
    search.write_index(search.postings(stored), search.search_summary(stored), index_base)
    return made.join(new.select(F.col("attempt_id").alias("id"), F.col("id").alias("new_id")), "id", "left")
