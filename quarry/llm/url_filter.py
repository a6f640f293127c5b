"""URL filters with redirect equivalence.

Rules name a host (with all its subdomains) and a path prefix; the longest that
fits decides. For other urls, canonical links, refresh redirects and given
redirect edges tie urls together: connected components carry explicit
decisions to all aliases, and an explicit allow in a component outweighs any
block. Without either, a url is allowed. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import ascii_lower, connected_components, stage

CANONICAL = (r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*?\bhref\s*=\s*["']?\s*([^"'\s>]+)""")
REFRESH = (r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*?\bcontent\s*=\s*["']?"""
           r"""\s*[0-9.]+\s*[;,]\s*url\s*=\s*["']?\s*([^"'\s>]+)""")


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def with_parts(df: DataFrame, url: str) -> DataFrame:
    """``host`` (A-Z lower-cased), ``path`` and ``node``: host, path and query.

    Null urls and urls without ``://`` have an empty host and path and a null
    node; a missing path counts as ``/`` in the node.
    """
    df = df.withColumn("_rest", _after_scheme(F.col(url)))
    df = df.withColumn("_host", F.regexp_extract("_rest", r"^[^/?#]*", 0))
    df = df.withColumn("_tail", F.substring("_rest", F.length("_host") + 1, F.length("_rest")))
    path = F.regexp_extract("_tail", r"^[^?#]*", 0)
    before_fragment = F.regexp_extract("_tail", r"^[^#]*", 0)
    return (df.withColumn("host", F.coalesce(ascii_lower(F.col("_host")), F.lit("")))
            .withColumn("path", F.coalesce(path, F.lit("")))
            .withColumn("node", F.concat("host", F.when(F.length(path) > 0, F.lit("")).otherwise(F.lit("/")),
                                         before_fragment))
            .withColumn("node", F.when(F.col("_rest").isNotNull() & (F.col("host") != ""), F.col("node")))
            .drop("_rest", "_host", "_tail"))


def with_rule(df: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Adds ``rule`` and ``rule_verdict`` of the longest rule that fits a row's
    ``host`` and ``path`` (null: none). ``rules``: (verdict, host, path).

    Distinct hosts meet the rules, so a host with very many urls costs one
    lookup; among rules of one length the longer host wins.
    """
    spark = df.sparkSession
    table = spark.createDataFrame(rules, "verdict string, of string, prefix string")
    hosts = df.select("host").where("host <> ''").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = (hosts.select("host", F.explode(suffixes).alias("of")).join(table, "of")
               .groupBy(F.col("host").alias("_h")).agg(F.collect_list(F.struct(
                   (F.length("of") + F.length("prefix")).alias("size"), F.length("of").alias("depth"),
                   F.concat("of", "prefix").alias("rule"), "verdict", "prefix")).alias("_rules")))
    # Written first: Spark knows how small it is and leaves the urls where they are.
    fitting = stage(fitting, "rules")
    best = F.array_max(F.filter("_rules", lambda r: F.col("path").startswith(r["prefix"])))
    return (df.join(fitting, F.col("host") == F.col("_h"), "left").withColumn("_best", best)
            .withColumn("rule", F.col("_best.rule")).withColumn("rule_verdict", F.col("_best.verdict"))
            .drop("_h", "_rules", "_best"))


def page_links(pages: DataFrame) -> DataFrame:
    """``from_url, to_url`` of canonical links and refresh redirects in pages,
    made absolute; pages whose own url has no scheme give none."""
    found = F.concat(F.regexp_extract_all("html", F.lit(CANONICAL), 1), F.regexp_extract_all("html", F.lit(REFRESH), 1))
    href = F.regexp_replace("href", "&amp;", "&")
    scheme, site = F.regexp_extract("url", r"^[^:/?#]*", 0), F.regexp_extract("url", r"^[^:/?#]*://[^/?#]*", 0)
    folder = F.regexp_replace(F.regexp_extract("url", r"^[^:/?#]*://[^?#]*", 0), r"(?<=[^/])/[^/]*$", "")
    to = (F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), href).when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
          .when(href.startswith("/"), F.concat(site, href)).otherwise(F.concat(folder, F.lit("/"), href)))
    return (pages.where(F.col("url").contains("://") & F.col("html").isNotNull())
            .select("url", F.explode_outer(found).alias("href")).where("href IS NOT NULL").select(F.col("url").alias("from_url"), to.alias("to_url")))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], redirects: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row of ``pages``
    (``page_id, url, html``).

    ``redirects`` may add edges ``from_url, to_url``. Null urls, null pages and
    urls without a scheme fit no rule, have no aliases and are allowed;
    repeated rows get the same verdict; an empty table gives no rows.
    """
    # Written once: the expressions below use each url many times.
    edges = stage(page_links(pages), "links")
    if redirects is not None:
        edges = edges.unionByName(redirects.select("from_url", "to_url"))
    for side, end in (("from_url", "a"), ("to_url", "b")):
        edges = with_parts(edges, side)
        for part, name in (("node", end), ("host", f"{end}_host"), ("path", f"{end}_path")):
            edges = edges.withColumnRenamed(part, name)
    edges = stage(edges.drop("from_url", "to_url").where("a <> b"), "aliases")
    roots = connected_components(edges, "a", "b")
    # Two rows where a node has urls with the path / and without one: a rule may fit only one of them.
    ends = edges.select(F.col("a").alias("end"), F.col("a_host").alias("host"), F.col("a_path").alias("path")).unionByName(
        edges.select(F.col("b").alias("end"), F.col("b_host").alias("host"), F.col("b_path").alias("path"))).distinct()
    ends = with_rule(ends, rules)
    decided = (ends.join(roots, F.col("end") == roots["node"], "left")
               .withColumn("root", F.coalesce("root", "end")))
    verdicts = decided.groupBy("root").agg(
        F.max(F.col("rule_verdict") == "allow").alias("allowed"), F.max(F.col("rule_verdict") == "block").alias("blocked"))
    carried = (decided.select("end", "root").distinct().join(verdicts, "root")
               .select("end", F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").alias("carried")))
    judged = with_rule(with_parts(pages.select("page_id", "url"), "url"), rules)
    return (judged.join(carried, F.col("node") == F.col("end"), "left")
            .withColumn("verdict", F.coalesce("rule_verdict", "carried", F.lit("allow")))
            .select("page_id", "host", "path", "rule", "verdict"))
