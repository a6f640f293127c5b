"""Ids after deletes, seeded order, expectations on edge records, retries."""
from pyspark.sql import functions as F

from quarry.functions import mock
from quarry.operators import ids, quality, runs


def test_ids_continue_after_max_or_count(spark):
    store = spark.createDataFrame([("LL-000001",), ("LL-000007",)], "id string")  # a deleted gap
    new = spark.createDataFrame([(1,), (2,)], "k int")
    by_count = [r.id for r in ids.assign_ids(new, ["k"], store=store).orderBy("k").collect()]
    by_max = [r.id for r in ids.assign_ids(new, ["k"], store=store, mode="max").orderBy("k").collect()]
    assert by_count == ["LL-000003", "LL-000004"] and by_max == ["LL-000008", "LL-000009"]


def test_shuffle_order_is_seeded_and_total(spark):
    df = spark.range(0, 500).select(F.col("id").cast("string").alias("key"))
    a = {r.key: r.position for r in runs.shuffle_order(df, "key", "7").collect()}
    b = {r.key: r.position for r in runs.shuffle_order(df, "key", "7").collect()}
    c = {r.key: r.position for r in runs.shuffle_order(df, "key", "8").collect()}
    assert a == b and a != c and sorted(a.values()) == list(range(500))


def test_expectations_flag_edge_records(spark):
    base = spark.createDataFrame([("LL-000001", "A title", "s", "Medium", 50, "t", "c", "o"),
                                  ("LL-000001", " ", "s", "Medium", 50, "t", None, "o"),
                                  ("XX-000003", "B", "s", "Weird", 50, "t", "c", "o")],
                                 "id string, title string, statement string, difficulty string, xp int, "
                                 "topic string, concept string, learning_objective string")
    recs = mock.mock_components(base.withColumns({
        "tags": F.array(F.lit("x")), "input_format": F.lit("i"), "output_format": F.lit("o"),
        "constraints": F.array(F.lit("c"))}))
    checked = quality.check_expectations(quality.assemble_record(recs))
    got = {(r.id, r.title): set(r.failed_rules) for r in checked.collect()}
    assert got[("LL-000001", "A title")] == {"id_unique"}
    assert got[("LL-000001", " ")] == {"id_unique", "title_not_empty", "not_null_concept"}
    assert got[("XX-000003", "B")] == {"difficulty_allowed", "id_prefix"}
    summary = {r.rule: r.n_failed for r in quality.expectation_summary(checked).collect()}
    assert summary["id_unique"] == 2 and summary["not_null_created_at"] == 0


def test_retry_first_success_counts_only_up_to_the_win(spark):
    rows = [(1, 1, "duplicate"), (1, 2, "failure"), (1, 3, "inserted"), (1, 4, "inserted"),
            (2, 1, "duplicate"), (2, 2, "duplicate"), (2, 3, "duplicate"), (2, 4, "inserted"),
            (3, 1, "inserted"), (3, 2, "duplicate")]
    df = spark.createDataFrame(rows, "key long, ts long, outcome string").withColumn("event_id", F.col("ts"))
    got = {r.key: (r.status, r.success_attempt, r.n_attempts, r.n_duplicates, r.n_failures)
           for r in runs.retry_first_success(df, k=3).collect()}
    assert got == {1: ("inserted", 3, 3, 1, 1), 2: ("failed", None, 3, 3, 0), 3: ("inserted", 1, 1, 0, 0)}
    every = {r.key: (r.status, r.success_attempt, r.n_attempts, r.n_duplicates, r.n_failures)
             for r in runs.retry_first_success(df).collect()}
    assert every == got | {2: ("inserted", 4, 4, 3, 0)}
