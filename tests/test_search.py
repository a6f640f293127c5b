"""Index terms and conjunctive substring search goldens."""
import pytest
from pyspark.sql import functions as F

from quarry.functions.mock import MOCK_SPACE, MOCK_TIME
from quarry.operators import search

REC = [("LL-000001", "Original AI Sliding Window Challenge", "Sliding Window", ["Array"], "Medium", 50,
        MOCK_TIME, MOCK_SPACE)]
SCHEMA = ("id string, title string, topic string, tags array<string>, difficulty string, xp int, "
          "time_complexity string, space_complexity string")


@pytest.fixture(scope="module")
def index(spark):
    recs = spark.createDataFrame(REC, SCHEMA)
    return search.postings(recs), search.search_summary(recs)


def test_terms_golden(index):
    post, _ = index
    assert {r.term for r in post.collect()} == {
        "array", "sliding", "window", "50", "challenge", "original", "bruteforceon2optimalon", "medium", "ai",
        "bruteforceo1optimalokwherekisthealphabetsizeorwindowelementrange"}


@pytest.mark.parametrize("q,hit", [("sliding", True), ("slid win", True), ("on2", True), ("50", True),
                                   ("sliding xyz", False), ("", False), ("!!", False), ("SLIDING sliding", True)])
def test_queries(spark, index, q, hit):
    post, summ = index
    got = [r.id for r in search.search_query(spark, post, summ, q).collect()]
    assert got == (["LL-000001"] if hit else [])


def test_batch_equals_single(spark, index):
    post, summ = index
    qs = ["sliding", "slid win", "on2", "sliding xyz", "a", "!!"]
    qdf = spark.createDataFrame(list(enumerate(qs)), "query_id int, query string")
    batch = {(r.query_id, r.id) for r in search.search_batch(post, summ, qdf).collect()}
    single = {(i, r.id) for i, q in enumerate(qs) for r in search.search_query(spark, post, summ, q).collect()}
    assert batch == single


# ------------------------------------------------------- the stored dictionary

WORDS = ["sliding", "window", "sorting", "binary", "tree", "trie", "graph", "on2", "ologn", "a1", "zz"]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """An index of 200 records whose titles are drawn from WORDS by position."""
    recs = [(f"R{i:03d}", " ".join(WORDS[(i * k) % len(WORDS)] for k in (1, 3, 7)), WORDS[i % 4], [WORDS[i % 11]],
             None, i, None, None) for i in range(200)]
    df = spark.createDataFrame(recs, SCHEMA)
    base = str(tmp_path_factory.mktemp("index") / "idx")
    search.write_index(search.postings(df), search.search_summary(df), base)
    return base, {r.id: set(r.terms) for r in df.select("id", search.index_terms().alias("terms")).collect()}


QUERIES = ["sliding", "tr", "r", "tree on2", "i in", "zz a1", "xq", "tree xq", "", "!!", "log 1", "7"]


def plain(terms, query):
    words = ["".join(c for c in w.lower() if c.isalnum()) for w in query.split()]
    words = [w for w in words if w]
    return {i for i, own in terms.items() if words and all(any(w in t for t in own) for w in words)}


def test_stored_search_equals_plain_loop(spark, stored):
    base, terms = stored
    post, summary, dictionary = search.open_index(spark, base)
    qdf = spark.createDataFrame(list(enumerate(QUERIES)), "query_id int, query string")
    batch = search.search_batch(post, summary, qdf, dictionary=dictionary).select("query_id", "id").collect()
    for i, q in enumerate(QUERIES):
        want = plain(terms, q)
        assert {r.id for r in search.search_query(spark, post, summary, q, dictionary).collect()} == want, q
        assert [r.id for r in batch if r.query_id == i and r.id not in want] == []
        assert {r.id for r in batch if r.query_id == i} == want, q


def test_one_word_reads_the_folder_of_its_rarest_bigram(spark, stored):
    import re
    base, terms = stored
    dictionary = search.open_index(spark, base)[2]
    vocabulary = set().union(*terms.values())
    for word in ("sliding", "window", "n2", "r"):
        counts = {g: sum(g in t for t in vocabulary) for g in search._grams_of(word)}
        rarest = min(counts, key=lambda g: (counts[g], g))
        found = search.dictionary_terms(dictionary, [word])
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert re.search(rf"PartitionFilters: \[[^\]]*folder#\d+ = {search._folder(rarest)}\)?\]", plan), plan
        assert f"EqualTo(gram,{rarest})" in plan and "NestedLoop" not in plan
        own = dictionary.grams.where(f"folder = {search._folder(rarest)}").select(F.input_file_name()).distinct()
        assert 0 < own.count() < len(dictionary.grams.inputFiles())
        assert {r.term for r in found.collect()} == {t for t in vocabulary if word in t}


def test_dictionary_holds_every_gram_once(spark, stored):
    base, terms = stored
    grams, sizes = search.open_index(spark, base)[2]
    vocabulary = set().union(*terms.values())
    want = {(t[i:i + n], t) for t in vocabulary for n in (1, 2) for i in range(len(t) - n + 1)}
    rows = [(r.gram, r.term) for r in grams.collect()]
    assert len(rows) == len(want) and set(rows) == want
    assert all(r.folder == search._folder(r.gram) for r in grams.collect())
    assert {r.gram: r.n_terms for r in sizes.collect()} == {
        g: sum(k == g for k, _ in want) for g in {k for k, _ in want}}


def test_half_written_index_is_not_read(spark, stored, tmp_path):
    import pathlib
    import shutil
    base = tmp_path / "idx"
    shutil.copytree(stored[0], base)
    shutil.copytree(base / "v=000001", base / "v=000002")
    (base / "v=000002" / "gram_sizes" / "_SUCCESS").unlink()
    files = search.open_index(spark, str(base))[2].grams.inputFiles()
    assert files and all("v=000001" in pathlib.PurePosixPath(f.replace("%3D", "=")).as_posix() for f in files)
    empty = search.open_index(spark, str(tmp_path / "none"))
    assert [t.count() for t in (*empty[:2], *empty[2])] == [0, 0, 0, 0]
    assert search.search_query(spark, *empty[:2], "tree", empty[2]).count() == 0


def test_records_of_one_file_are_dealt_to_bounded_tasks(spark, monkeypatch):
    """Repeated and null ids, one file: postings and search as with one task."""
    recs = [(f"R{i % 90:03d}" if i % 7 else None, " ".join(WORDS[(i * k) % len(WORDS)] for k in (1, 3, 7)),
             WORDS[i % 4], [WORDS[i % 11]], None, i % 5, None, None) for i in range(200)]
    df = spark.createDataFrame(recs, SCHEMA).coalesce(1)
    summary = search.search_summary(df).distinct().coalesce(1)

    def found():
        post = search.postings(df)
        hits = search.search_query(spark, post, summary, "sliding win")
        return [sorted(map(str, x.collect())) for x in (post, hits)]

    whole = found()
    monkeypatch.setattr(search, "RECORDS_PER_TASK", 20)
    assert search._spread(df).rdd.getNumPartitions() == 10
    assert max(search._spread(df).rdd.glom().map(len).collect()) < 60
    assert search._spread(summary, "id").rdd.getNumPartitions() == -(-summary.count() // 20)
    assert found() == whole and all(whole)
