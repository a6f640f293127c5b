import os

import pytest
from pyspark.sql import functions as F

from quarry.operators import ledger, quality, search
from quarry.sources import metadata
from quarry.streaming import gate


def counting_client(log, fail=()):
    """Notes every call in a file of its own; some prompts fail."""
    def factory():
        def call(prompt):
            import uuid
            with open(os.path.join(log, uuid.uuid4().hex), "w") as f:
                f.write(prompt)
            if prompt in fail:
                raise ValueError("no")
            return prompt.upper()
        return call
    return factory


def calls(log):
    return sorted(open(os.path.join(log, n)).read() for n in os.listdir(log))


def test_each_prompt_is_called_once(spark, tmp_path):
    logs = [str(tmp_path / f"log{i}") for i in range(3)]
    for x in logs:
        os.mkdir(x)
    path = str(tmp_path / "ledger")
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, "c"), (6, "a"), (7, "")], "n int, p string")
    first = ledger.generate_once(rows.where("n < 5"), "p", counting_client(logs[0], fail=("b",)), path, wave=1)
    assert {r.n: (r.response, r.error) for r in first.collect()} == {
        1: ("A", None), 2: (None, "ValueError: no"), 3: ("A", None), 4: (None, None)}
    assert calls(logs[0]) == ["a", "b"]
    second = ledger.generate_once(rows, "p", counting_client(logs[1]), path)  # the failed call and the new prompts
    assert {r.n: r.response for r in second.collect()} == {1: "A", 2: "B", 3: "A", 4: None, 5: "C", 6: "A", 7: ""}
    assert calls(logs[1]) == ["", "b", "c"]
    ledger.generate_once(rows, "p", counting_client(logs[2]), path).collect()
    assert calls(logs[2]) == []


def test_half_written_wave_and_broken_client(spark, tmp_path):
    path = str(tmp_path / "ledger")
    rows = spark.createDataFrame([(1, "a")], "n int, p string")

    def broken():
        raise OSError("down")
    out = ledger.generate_once(rows, "p", broken, path).first()
    assert (out.response, out.error) == (None, "OSError: down")
    half = f"{path}/batch=half"
    spark.createDataFrame([(None, "a", "X", None)], ledger.LEDGER).select(
        F.unhex(F.sha2("prompt", 256)).alias("hash"), "prompt", "response", "error").write.parquet(half)
    os.remove(f"{half}/_SUCCESS")
    assert ledger.read_ledger(spark, path).first().response is None
    odd = ledger.generate_once(rows, "p", lambda: (lambda _: 7), path).first()
    assert (odd.response, odd.error is None) == (None, False)
    assert ledger.generate_once(rows.limit(0), "p", broken, path).count() == 0


@pytest.mark.parametrize("one", [True, False])
def test_rejects_and_records_are_all(spark, tmp_path, one):
    good, cut, typed = '{"topic": "A"}', '{"topic": ', '{"topic": "B", "tags": 7}'
    for i, text in enumerate((good, cut, typed, "", " \n ")):
        (tmp_path / f"m{i}.json").write_text(text)
    got = {r.file_name: (r.reason, r.raw and r.raw.strip())
           for r in metadata.metadata_rejects(spark, str(tmp_path), one).collect()}
    want = {"m1": ("malformed", cut.strip()), "m2": ("malformed", typed), "m4": ("no record", None)}
    assert got == want  # m3 has no bytes
    assert [r.file_name for r in metadata.metadata_scan(spark, str(tmp_path), one).collect()] == ["m0"]


def test_ids_in_the_store_fail(spark):
    new = spark.createDataFrame([("LL-1",), ("LL-2",), ("LL-2",), (None,)], "id string")
    for c in quality.RECORD_COLUMNS:
        if c not in new.columns:
            new = new.withColumn(c, F.lit(None))
    new = new.withColumn("starter_code", F.create_map(F.lit("python"), F.lit("x"))).withColumn(
        "test_cases", F.struct(F.array(F.lit("a")).alias("public"), F.array(F.lit("a")).alias("hidden"))).withColumn(
        "editorial", F.struct(F.lit("x").alias("optimal"))).withColumn("hints", F.array(F.lit("a")))
    old = spark.createDataFrame([("LL-2", 1), ("LL-2", 2), ("LL-9", 3), (None, 4)], "id string, x int")
    got = sorted((str(r.id), r.rule_id_unique, r.rule_id_not_stored)
                 for r in quality.check_expectations(new, stored=old).collect())
    assert got == [("LL-1", True, True), ("LL-2", False, False), ("LL-2", False, False), ("None", True, True)]


def test_index_survives_repeats_and_half_written_folders(spark, tmp_path):
    schema = "id string, title string, tags array<string>, topic string, difficulty string, xp int"
    rest = dict(time_complexity=F.lit("O(1)"), space_complexity=F.lit(None).cast("string"))
    full = spark.createDataFrame([], schema).withColumns(rest).schema
    src, base, ckpt = (str(tmp_path / x) for x in ("src", "index", "ckpt"))

    def arrive(rows):
        spark.createDataFrame(rows, schema).withColumns(rest).coalesce(1).write.mode("append").parquet(src)
        gate.stream_index(spark, src, full, base, ckpt)
    one, two = ("p1", "Red Ring", ["x"], "t", "Easy", 1), ("p2", "Blue Plate", ["y"], "t", "Hard", 2)
    arrive([one, two, one])
    arrive([("p1", "Red Ring", ["x"], "t", "Hard", 5), ("p3", "Old Bolt", ["z"], "t", "Easy", 3)])
    post, summ = gate.read_stream_index(spark, base)
    rebuilt = search.postings(spark.createDataFrame(
        [("p1", "Red Ring", ["x"], "t", "Hard", 5), one, two, ("p3", "Old Bolt", ["z"], "t", "Easy", 3)], schema).withColumns(rest))
    assert sorted(map(tuple, post.select("term", "id").collect())) == sorted(
        map(tuple, rebuilt.select("term", "id").distinct().collect()))
    assert {r.id: (r.difficulty, r.xp) for r in summ.collect()} == {"p1": ("Hard", 5), "p2": ("Hard", 2), "p3": ("Easy", 3)}
    n = post.count()
    folder = next(os.scandir(f"{base}/postings")).path
    os.remove(f"{folder}/_SUCCESS")
    assert gate.read_stream_index(spark, base)[0].count() < n
