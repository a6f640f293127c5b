"""Pages, verdicts, ids, store and streaming."""
import os

import pytest
from pyspark.sql import functions as F

from quarry.operators import ids, neardup, pages, verdicts
from quarry.plans import views
from quarry.session import scratch_dir
from quarry.sources import metadata, store
from quarry.streaming import gate

HTML = ('<html><body><div class="mw-parser-output"><ul><li><a href="/w/Brent">Brent\'s algorithm</a></li>'
        '<li><a href="/x">Sorting</a></li><li><a href="/y"> Dijkstra&#39;s algorithm </a></li></ul></div>'
        '<nav><ul><li><a href="/n">Navigation algorithm</a></li></ul></nav></body></html>')


def test_crawl_from_page(spark):
    pg = spark.createDataFrame([(1, "u", HTML, 200), (2, "v", HTML, 500)],
                               "page_id long, url string, html string, status int")
    coll = pages.metadata_collection(spark, pg)
    crawled = coll.where("origin = 'crawled'").orderBy("idx").collect()
    assert [(r.topic, r.difficulty, r.tags) for r in crawled] == [
        ("Brent's algorithm", "Medium", ["Brent's", "Algorithm"]), ("Dijkstra's algorithm", "Hard",
                                                                     ["Dijkstra's", "Algorithm"])]
    assert crawled[0].file_name == "metadata_crawled_0001"
    assert coll.count() == 13 + 2


def test_parser_and_regex_agree_on_flat_pages(spark, sf):
    pg = views.table(spark, sf, "pages")
    a = pages.page_links(pg, views.G_PATH).collect()
    b = pages.page_links_regex(pg, views.G_PATH).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and len(a) > 0


MARKUP = [
    # nested block, an anchor outside any list, a list after the inner block
    ('<div class="mw-parser-output x"><a href="/no">outside a list</a><div><ul><li><a href="/1">one</a></li></ul></div>'
     '<ul><li><b><a href="/2">two</a></b></li></ul></div><ul><li><a href="/no">outside the block</a></li></ul>',
     [("/1", "one"), ("/2", "two")]),
    # single quotes, no quotes, entities (unescaped once), no href, upper case, comments
    ("<DIV CLASS='mw-parser-output'><UL><LI><A HREF='/s'>s &amp; t</A><li><a href=/u>u&eacute;&#x21;</a>"
     '<li><a href="/e?a=1&amp;amp;b=2">e</a><li><a>none</a><!-- <a href="/c">c</a> --></ul></div>',
     [("/s", "s & t"), ("/u", "u\u00e9!"), ("/e?a=1&amp;b=2", "e"), ("", "none")]),
    # scripts hold no text; unclosed tags; a class name that only begins alike
    ('<div class="mw-parser-output"><ul><li><a href="/x">x<script>var a = "<b>";</script> y</a></ul>'
     '<div class="mw-parser-outputs"><li><a href="/no">not in a list of ours', [("/x", "x y")]),
    (None, []), ("", []),
]


def test_links_on_any_markup(spark):
    df = spark.createDataFrame([(i, m) for i, (m, _) in enumerate(MARKUP)], "page_id long, html string")
    got = {}
    for r in pages.page_links(df).orderBy("page_id", "pos").collect():
        got.setdefault(r.page_id, []).append((r.href, r.text))
    assert got == {i: want for i, (_, want) in enumerate(MARKUP) if want}


def test_nested_matches_share_their_text(spark):
    df = spark.createDataFrame([(1, "<ul><li>a<ul><li>b</li></ul>c</li></ul>")], "page_id long, html string")
    assert [r.text for r in pages.page_links(df, ["ul", "li"]).orderBy("pos").collect()] == ["abc", "b"]


def test_all_links_of_a_page_count(spark):
    links = spark.createDataFrame([(1, i, "", f"algorithm {i}") for i in range(50)], pages.LINKS_SCHEMA)
    assert pages.crawl_topics(links).count() == 50 and pages.crawl_topics(links, head=30).count() == 30
    assert pages.crawl_topics(links, max_len=12).count() == 10


def test_metadata_sink_and_scan_roundtrip(spark):
    coll = pages.baseline_metadata(spark)
    path = scratch_dir(spark, "t-meta")
    assert metadata.metadata_sink(coll, path, per_record_files=True) == 13
    back = metadata.metadata_scan(spark, path)
    assert sorted(r.file_name for r in back.collect()) == sorted(r.file_name for r in coll.collect())


def test_metadata_scan_skips_broken_file(spark, tmp_path):
    (tmp_path / "metadata_baseline_0001.json").write_text('{"topic": "A", "difficulty": "Easy", "tags": ["x"]}')
    (tmp_path / "metadata_baseline_0002.json").write_text('{"topic": ')
    got = metadata.metadata_scan(spark, str(tmp_path)).collect()
    assert [(r.file_name, r.topic) for r in got] == [("metadata_baseline_0001", "A")]


def test_verdict_kinds(spark):
    cases = spark.createDataFrame([(1, 0, "i", "2 "), (1, 1, "i", "3"), (2, 0, "i", "1"), (3, 0, "i", "x"),
                                   (4, 0, "i", "y")],
                                  "problem_id long, case_idx int, input string, expected string")
    outs = spark.createDataFrame([(1, 0, " 2", 0, False), (1, 1, "4", 0, False), (2, 0, "1", 1, False),
                                  (3, 0, "x", 0, True)],
                                 "problem_id long, case_idx int, actual string, exit_code int, timed_out boolean")
    probs = spark.createDataFrame([(1,), (2,), (3,), (4,), (5,)], "problem_id long")
    got = {r.problem_id: (r.passed, r.n_cases, r.first_fail_idx, r.first_fail_kind)
           for r in verdicts.case_verdicts(probs, cases, outs).collect()}
    assert got == {1: (False, 2, 1, "mismatch"), 2: (False, 1, 0, "runtime_error"), 3: (False, 1, 0, "timeout"),
                   4: (False, 1, 0, "missing_output"), 5: (False, 0, None, "no_cases")}


def test_dense_index_and_wide_ids(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("k"))
    out = ids.dense_index(df, ["k"], "pos").collect()
    assert all(r.k == r.pos for r in out)
    wide = ids.assign_ids(spark.range(0, 2).select(F.col("id").alias("k")), ["k"],
                          store=spark.range(0, 999_999)).orderBy("k").collect()
    assert [r.id for r in wide] == ["LL-1000000", "LL-1000001"]


def test_store_versions(spark):
    base = scratch_dir(spark, "t-store")
    assert store.store_scan(spark, base).count() == 0
    recs = spark.createDataFrame([("LL-000001", "t", 50)], "id string, title string, xp int")
    store.store_append(recs, base)
    store.store_append(recs.withColumn("id", F.lit("LL-000002")), base)
    assert store.store_scan(spark, base).count() == 2
    store.store_append(recs, base, batch="7")
    store.store_append(recs, base, batch="7")  # replay: same batch folder
    assert store.store_scan(spark, base).count() == 3
    assert store.store_scan(spark, base, exclude_batch="7").count() == 2
    store.store_overwrite(store.store_scan(spark, base).where("id = 'LL-000002'"), base)
    assert [r.id for r in store.store_scan(spark, base).collect()] == ["LL-000002"]


def _record(n, title="t"):
    return (f"LL-{n:06d}", title, f"statement number {n} about {title}", n)


RECORD = "id string, title string, statement string, seq long"


def _arrive(spark, path, rows):
    spark.createDataFrame([(*r, ["x"]) for r in rows], RECORD + ", tags array<string>").coalesce(1).write.mode(
        "append").parquet(path)
    return spark.read.parquet(path).schema


TOPICS = ["apples", "quantum fields", "zebra crossings", "winter storms", "violin bows", "deep trenches", "glass",
          "harvest moons"]


def test_append_overwrite_then_streams_keep_every_record(spark):
    """A stream's first batch, and another stream's, leave the compacted store alone."""
    base, checkpoint = scratch_dir(spark, "t-all"), scratch_dir(spark, "t-ck1")
    old = spark.createDataFrame([_record(i, TOPICS[i]) for i in range(3)], RECORD)
    store.store_append(old, base)
    store.store_append(spark.createDataFrame([_record(3, TOPICS[3])], RECORD), base)
    store.store_overwrite(store.store_scan(spark, base), base)
    for n, ck in ((4, checkpoint), (5, scratch_dir(spark, "t-ck2"))):
        src = scratch_dir(spark, "t-src")
        schema = _arrive(spark, src, [_record(n, TOPICS[n])])
        gate.stream_gate(spark, src, schema, base, ck)
        assert store.store_scan(spark, base).count() == n + 1
    store.store_overwrite(store.store_scan(spark, base), base)
    assert sorted(r.title for r in store.store_scan(spark, base).collect()) == sorted(TOPICS[:6])


def test_replayed_batch_is_not_doubled(spark):
    base, token = scratch_dir(spark, "t-replay"), "query-0"
    rows = spark.createDataFrame([_record(1)], RECORD)
    store.store_append(spark.createDataFrame([_record(0)], RECORD), base)
    for _ in range(2):
        store.store_append(rows, base, batch=token)
    assert store.store_scan(spark, base).count() == 2
    assert [r.id for r in store.store_scan(spark, base, exclude_batch=token).collect()] == ["LL-000000"]


def test_failed_overwrite_leaves_the_store(spark):
    base = scratch_dir(spark, "t-fail")
    store.store_append(spark.createDataFrame([_record(i) for i in range(4)], RECORD), base)
    bad = store.store_scan(spark, base).withColumn("xp", F.raise_error(F.lit("broken job")).cast("int"))
    for _ in range(2):
        with pytest.raises(Exception, match="broken job"):
            store.store_overwrite(bad, base)
        assert store.store_scan(spark, base).count() == 4
    store.store_overwrite(store.store_scan(spark, base).where("id < 'LL-000002'"), base)
    assert store.store_scan(spark, base).count() == 2
    store.store_overwrite(store.store_scan(spark, base).where("false"), base)
    assert store.store_scan(spark, base).count() == 0


def test_import_of_a_missing_file_is_empty(spark, tmp_path):
    assert store.import_json_array(spark, str(tmp_path / "none.json")).count() == 0


def test_index_versions(spark):
    from quarry.operators import search
    base = scratch_dir(spark, "t-index")
    assert [d.count() for d in search.read_index(spark, base)] == [0, 0]
    summary = spark.createDataFrame([], search.SUMMARY_SCHEMA)
    for n in (1, 2):
        search.write_index(spark.createDataFrame([("w", str(i)) for i in range(n)], search.POSTINGS_SCHEMA), summary, base)
        assert search.read_index(spark, base)[0].count() == n
    bad = spark.createDataFrame([("w", "1")], search.POSTINGS_SCHEMA)
    with pytest.raises(Exception, match="broken"):
        search.write_index(bad.withColumn("id", F.raise_error(F.lit("broken")).cast("string")), summary, base)
    assert search.read_index(spark, base)[0].count() == 2


def test_stream_gate_equals_batch_greedy(spark, sf):
    p = views.problems_from_part(views.table(spark, sf, "part"))
    src = scratch_dir(spark, "t-src")
    gate.write_slices(p, src, "seq", 3)
    local = src[len("file:"):] if src.startswith("file:") else src
    assert len([f for f in os.listdir(local) if f.endswith(".parquet")]) >= 3
    base = scratch_dir(spark, "t-gate")
    gate.stream_gate(spark, src, p.schema, base, scratch_dir(spark, "t-ck"))
    streamed = {r.id for r in store.store_scan(spark, base).collect()}
    batch = {r.id for r in neardup.greedy_dedupe(p).where("accepted").collect()}
    assert streamed == batch
