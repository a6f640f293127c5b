"""The URL filter's SQL gives what the operator gives, links included."""
import duckdb
import pandas as pd

from quarry.llm import url_filter
from quarry.llm.oracle import ORACLE
from quarry.llm.queries import URL_RULES

ROWS = [
    (1, "http://a.com/1", "<LINK href='http://bad.net/x' rel=\"canonical\">"),
    (2, "http://b.com/2?q=1#f", '<meta http-equiv="refresh" content="0; URL=http://a.com/1">'),
    (3, "http://c.com/dir/3", '<link rel=canonical href=4>'), (4, "https://C.com/dir/4", '<link rel="canonical" href="/5">'),
    (5, "http://c.com/5", '<link rel="canonical" href="//d.example.net/en/">'), (6, "http://e.com", "<link rel=stylesheet href=http://bad.net/>"),
    (7, None, None), (8, "nothing", "<p>"), (9, "http://www.fr.org/fr/x", None), (10, "http://bad.net/x", ""),
    (11, "http://g.com/", '<link rel="canonical" href="http://bad.net/q"><meta http-equiv=refresh content="5,url=http://o.org/fr/">'),
]


def test_sql_equals_the_operator(spark):
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(ROWS, columns=["page_id", "url", "html"]))
    want = {r[0]: r[1:] for r in con.execute(ORACLE["op5_url_filter"]).fetchall()}
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.judge(pages, URL_RULES).collect()}
    assert got == want
    assert {k: v[3] for k, v in got.items()} == dict.fromkeys(range(1, 12), "allow") | dict.fromkeys((1, 2, 10), "block")


def test_sql_equals_the_operator_on_both_forms_of_a_bare_host(spark):
    rows = [(1, "http://foo.com/p", "<link rel=canonical href='http://x.net'>"),
            (2, "http://bar.com/p", "<link rel=canonical href='http://x.net/'>"), (3, "http://x.net", None)]
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(rows, columns=["page_id", "url", "html"]))
    want = sorted(con.execute(ORACLE["op5_url_filter"]).fetchall(), key=lambda r: r[0])
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted(tuple(r) for r in url_filter.judge(pages, URL_RULES).collect()) == want
    assert [r[4] for r in want] == ["block"] * 3
