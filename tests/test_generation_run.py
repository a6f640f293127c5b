"""The composed run against the rule applied attempt by attempt."""
import pytest
from pyspark.sql import functions as F

from quarry.operators import generation_run, search
from quarry.plans import oracle_lit as L
from quarry.plans import views
from quarry.session import scratch_dir
from quarry.sources import store

SCHEMA = "id string, seq long, title string, statement string, tags array<string>"


def attempts_of(p):
    return (p.withColumn("key", F.floor(F.col("seq") / 3)).withColumn("valid", F.col("seq") % 4 != 1))


@pytest.mark.parametrize("limit", [None, 5])
def test_outcomes_equal_the_loop(spark, sf, limit):
    df = attempts_of(views.problems_from_part(views.table(spark, sf, "part")))
    rows = [r.asDict() for r in df.orderBy("seq").collect()]
    old = [("S-1", 0, rows[40]["title"], rows[40]["statement"], rows[40]["tags"])]
    existing = spark.createDataFrame(old, SCHEMA)
    want = L.run_attempts([(r["key"], L.Record.of(r), r["valid"]) for r in rows],
                          [L.Record.of(dict(zip(["id", "seq", "title", "statement", "tags"], o))) for o in old], limit)
    got = generation_run.attempt_outcomes(df, existing, limit).collect()
    assert {(r.id, r.outcome) for r in got} == {(r.id, o) for r, o in want} and len(got) == len(want)
    assert limit or {"inserted", "duplicate", "failure"} == {o for _, o in want}


def test_run_appends_numbers_and_indexes(spark, sf):
    df = attempts_of(views.problems_from_part(views.table(spark, sf, "part")))
    base, index = scratch_dir(spark, "t-run"), scratch_dir(spark, "t-run-index")
    made = generation_run.generation_run(df, base, index, limit=3).checkpoint()
    new = made.where("outcome = 'inserted'").orderBy("seq").collect()
    assert [r.new_id for r in new] == ["LL-000001", "LL-000002", "LL-000003"]
    n = generation_run.counters(made).first()
    assert n.inserted == 3 and n.duplicates + n.failures + 3 == made.count()
    stored = {r.id: r for r in store.store_scan(spark, base).collect()}
    assert {r.new_id: r.title for r in new} == {k: r.title for k, r in stored.items()}
    assert all(r.xp and r.difficulty and r.hints and r.test_cases.public for r in stored.values())
    post, summary = search.read_index(spark, index)
    assert {r.id for r in search.search_query(spark, post, summary, new[0].title).collect()} >= {"LL-000001"}
    # A second run goes on after the first: its inserts are now stored, so their attempts are duplicates.
    again = generation_run.generation_run(df, base, index, limit=2).checkpoint()
    ids = [r.new_id for r in again.where("outcome = 'inserted'").orderBy("seq").collect()]
    assert ids == ["LL-000004", "LL-000005"][:len(ids)] and store.store_scan(spark, base).count() == 3 + len(ids)
    assert {r.id for r in new} <= {r.id for r in again.where("outcome = 'duplicate'").collect()}
