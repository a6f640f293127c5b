"""End-to-end golden: crawl -> metadata -> offline problems -> keep-first dedupe
against the one shipped store record (values derived from the record rules)."""
import pytest
from pyspark.sql import functions as F

from quarry.functions import mock
from quarry.operators import neardup, pages

# Fixed values (golden data only): the offline problem wording of the record
# model and the shipped store record it produced.
REF_TITLE_FMT = "Original AI %s Challenge"
REF_STATEMENT_FMT = ("Given an array of integers representing the sensor log of a space vessel, find the minimum "
                     "contiguous subsegment where the variance of coordinates is within safety limits. This "
                     "challenge focuses on the concept of %s with %s difficulty.")
STORE = [("LL-000001", "Original AI Sliding Window Challenge", REF_STATEMENT_FMT % ("Variable Window", "Medium"),
          ["Array"])]
CRAWLED = ["Brent's algorithm", "Floyd's cycle-finding algorithm", "Gale–Shapley algorithm",
           "Blossom algorithm", "Coloring algorithm", "Hopcroft–Karp algorithm", "Hungarian algorithm"]


@pytest.fixture(scope="module")
def candidates(spark):
    items = "".join(f'<li><a href="/wiki/{i}">{t}</a></li>' for i, t in enumerate(CRAWLED))
    html = f'<html><body><div class="mw-parser-output"><ul>{items}</ul></div></body></html>'
    pg = spark.createDataFrame([(0, "u", html)], "page_id long, url string, html string")
    coll = pages.metadata_collection(spark, pg)
    saved = {r.file_name: r for r in coll.collect()}
    assert len(saved) == 20
    assert (saved["metadata_crawled_0001"].difficulty, saved["metadata_crawled_0002"].difficulty) == ("Medium", "Hard")
    assert saved["metadata_crawled_0001"].tags == ["Brent's", "Algorithm"]
    order = sorted(saved)
    seq = spark.createDataFrame(list(enumerate(order)), "seq long, file_name string")
    old = (mock.TITLE_FMT, mock.STATEMENT_FMT)
    mock.TITLE_FMT, mock.STATEMENT_FMT = REF_TITLE_FMT, REF_STATEMENT_FMT
    try:
        probs = mock.mock_problem(coll.join(seq, "file_name")).select(
            F.col("file_name").alias("id"), "seq", "title", "statement", "tags").collect()
    finally:
        mock.TITLE_FMT, mock.STATEMENT_FMT = old
    return spark.createDataFrame(probs, "id string, seq long, title string, statement string, tags array<string>")


def test_keep_first_against_shipped_record(spark, candidates):
    store = spark.createDataFrame(STORE, "id string, title string, statement string, tags array<string>")
    acc = {r.id for r in neardup.greedy_dedupe(candidates, store=store).where("accepted").collect()}
    assert acc == {"metadata_baseline_0003", "metadata_crawled_0002"}


def test_first_duplicate_scores_against_store(spark, candidates):
    store = spark.createDataFrame([(s[0], 0) + s[1:] for s in STORE],
                                  "id string, seq long, title string, statement string, tags array<string>")
    r = {x.id: x for x in neardup.first_duplicate(candidates, store).collect()}["metadata_baseline_0001"]
    got = tuple(round(v, 4) for v in (r.title_similarity, r.statement_similarity, r.tag_similarity,
                                      r.weighted_similarity))
    assert r.dup_id == "LL-000001" and got == (1.0, 0.9901, 0.5, 0.945)


def test_first_duplicate_among_store_and_accepted(spark, candidates):
    # store order: the shipped record, then the accepted records in order
    acc = candidates.where(F.col("id").isin("metadata_baseline_0003", "metadata_crawled_0002")).select(
        "id", (F.col("seq") + 1).alias("seq"), "title", "statement", "tags")
    store = spark.createDataFrame([(s[0], 0) + s[1:] for s in STORE],
                                  "id string, seq long, title string, statement string, tags array<string>")
    rest = candidates.where(F.col("id").isin("metadata_baseline_0007", "metadata_crawled_0003"))
    got = {r.id: (r.dup_id, tuple(round(v, 4) for v in (r.title_similarity, r.statement_similarity,
                                                         r.tag_similarity, r.weighted_similarity)))
           for r in neardup.first_duplicate(rest, store.unionByName(acc)).collect()}
    assert got == {"metadata_baseline_0007": ("metadata_baseline_0003", (0.7576, 0.9116, 0.3333, 0.7922)),
                   "metadata_crawled_0003": ("metadata_crawled_0002", (0.7234, 0.8798, 0.3333, 0.7626))}
