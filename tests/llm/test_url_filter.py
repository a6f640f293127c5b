import re

from pyspark.sql import functions as F

from quarry.llm import url_filter as U
from quarry.llm.queries import URL_RULES

SCHEMA = "page_id long, url string, html string"


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3:]
    host = re.match("[^/?#]*", rest).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match("[^?#]*", rest[len(host):]).group()


def rule_of(url, rules):
    host, path = parts(url)
    fits = [r for r in rules if host and (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    return max(fits, key=lambda r: (len(r[1] + r[2]), len(r[1]))) if fits else None


def judged(spark, rows, rules=URL_RULES, redirects=None):
    pages = spark.createDataFrame(rows, SCHEMA).withColumn("host", F.lit("clash")).withColumn("rule", F.lit("clash"))
    return {r["page_id"]: r for r in U.judge(pages, rules, redirects).collect()}


def test_rules_equal_brute_force(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    for r in U.judge(pages, URL_RULES).join(pages.select("page_id", "url"), "page_id").collect():
        best = rule_of(r["url"], URL_RULES)
        assert (r["host"], r["path"]) == parts(r["url"])
        assert r["rule"] == (best and best[1] + best[2]) and r["verdict"] == (best[0] if best else "allow")


def test_odd_urls(spark):
    urls = [None, "", "no scheme.net/x", "http://", "HTTP://A.NET", "http://A.NET/", "ftp://x.example.net/en/a?b#c",
            "http://example.net/EN/", "http://notexample.com/de/", "http://example.com/de/", "http://example.com/de",
            "http://www.fr.org/fr/x", "http://org/fr/", "http://É.ORG/fr/ü", "x://net:80/", "http://a..net/", "://net/"]
    got = judged(spark, [(i, u, None) for i, u in enumerate(urls)] + [(99, urls[5], None)])
    for i, u in enumerate(urls):
        best = rule_of(u, URL_RULES)
        assert (got[i]["host"], got[i]["path"]) == parts(u), u
        assert (got[i]["rule"], got[i]["verdict"]) == ((best[1] + best[2], best[0]) if best else (None, "allow")), u
    assert got[99]["verdict"] == got[5]["verdict"] == "block"
    assert judged(spark, [(None, None, None)])[None]["verdict"] == "allow"
    assert U.judge(spark.createDataFrame([], SCHEMA), URL_RULES).count() == 0


def test_decisions_reach_aliases(spark):
    def link(u):
        return f"<html><head><LINK href='{u}' rel=\"canonical\"></head></html>"

    def refresh(u):
        return f'<meta http-equiv="refresh" content="0; URL={u}">'
    rows = [
        (1, "http://a.com/1", link("http://bad.net/x")),            # blocked through its canonical page
        (2, "http://b.com/2", refresh("http://a.com/1?")),           # no such node: another query
        (3, "http://c.com/3", refresh("https://a.com/1#top")),       # scheme and fragment do not matter
        (4, "http://d.com/4", link("http://good.example.net/en/")),  # allowed ...
        (5, "http://d.com/5", link("http://d.com/4")),
        (6, "http://e.com/6", link("//d.com/5")),                    # ... also down a chain
        (7, "http://e.com/7", link("/8")), (8, "http://e.com/8", link("http://bad.net/y")),
        (9, "http://e.com/dir/9", link("10")), (10, "http://e.com/dir/10", refresh("http://bad.net/z")),
        (11, "http://bad.net/z", None),                              # its own rule stands
        (12, "http://f.com/", link("http://f.com")), (13, "http://f.com", "<link rel=stylesheet href=http://bad.net/>"),
        (14, "http://g.com/14", link("http://bad.net/q") + refresh("http://ok.org/fr/")),  # allow outweighs block
    ]
    got = {k: r["verdict"] for k, r in judged(spark, rows).items()}
    want = dict.fromkeys(range(1, 15), "allow") | dict.fromkeys((1, 3, 7, 8, 9, 10, 11), "block")
    assert got == want
    redirects = spark.createDataFrame([("http://b.com/2", "http://c.com/3"), (None, "http://a.com/1")],
                                      "from_url string, to_url string")
    assert judged(spark, rows, redirects=redirects)[2]["verdict"] == "block"


def test_both_forms_of_a_bare_host_are_looked_up(spark):
    rows = [(1, "http://foo.com/p", "<link rel=canonical href='http://x.net'>"),
            (2, "http://bar.com/p", "<link rel=canonical href='http://x.net/'>"), (3, "http://x.net", None),
            (4, "http://baz.com/p", "<link rel=canonical href='http://y.net'>")]  # without the other form no rule fits
    got = U.judge(spark.createDataFrame(rows, SCHEMA), URL_RULES).collect()
    assert sorted((r["page_id"], r["verdict"]) for r in got) == [(1, "block"), (2, "block"), (3, "block"), (4, "allow")]
