"""DuckDB SQL of the operators that SQL can express.

Only the URL filter and the filter audit: XXH64, trained models, tokenizers,
seeded draws and packing have no form in SQL; tests hold those against brute
force.
"""

ORACLE: dict[str, str] = {}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _parts(table: str, url: str, keep: str) -> str:
    """host, path and node (host, path and query) of a table's url column."""
    return f"""SELECT {keep}, coalesce(translate(h, '{_UPPER}', '{_LOWER}'), '') AS host,
      coalesce(regexp_extract(tail, '^[^?#]*'), '') AS path,
      CASE WHEN h <> '' THEN translate(h, '{_UPPER}', '{_LOWER}')
        || CASE WHEN regexp_extract(tail, '^[^?#]*') = '' THEN '/' ELSE '' END
        || regexp_extract(tail, '^[^#]*') END AS node
    FROM (SELECT *, substr(rest, length(h) + 1) AS tail
      FROM (SELECT *, regexp_extract(rest, '^[^/?#]*') AS h
        FROM (SELECT *, CASE WHEN strpos({url}, '://') > 0 THEN substr({url}, strpos({url}, '://') + 3) END AS rest
          FROM {table})))"""


def _rule(what: str) -> str:
    return f"""(SELECT {what} FROM rules WHERE host <> '' AND (host = rh OR ends_with(host, '.' || rh))
      AND starts_with(path, rp) ORDER BY length(rh || rp) DESC, length(rh) DESC LIMIT 1)"""


ORACLE["op5_url_filter"] = f"""
WITH RECURSIVE rules(v, rh, rp) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'),
  ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
tags AS (SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\\b[^>]*>')) AS tag FROM pages
  WHERE strpos(url, '://') > 0),
hrefs AS (SELECT url, replace(CASE
    WHEN regexp_matches(tag, '(?is)^<link.*\\brel\\s*=\\s*["'']?canonical\\b')
      THEN regexp_extract(tag, '(?is)\\bhref\\s*=\\s*["'']?\\s*([^"''\\s>]+)', 1)
    WHEN regexp_matches(tag, '(?is)^<meta.*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b')
      THEN regexp_extract(tag, '(?is)\\bcontent\\s*=\\s*["'']?\\s*[0-9.]+\\s*[;,]\\s*url\\s*=\\s*["'']?\\s*([^"''\\s>]+)', 1)
    END, '&amp;', '&') AS href FROM tags),
links AS (SELECT url, CASE
    WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN href
    WHEN starts_with(href, '//') THEN regexp_extract(url, '^[^:/?#]*') || ':' || href
    WHEN starts_with(href, '/') THEN regexp_extract(url, '^[^:/?#]*://[^/?#]*') || href
    ELSE regexp_replace(regexp_extract(url, '^[^:/?#]*://[^?#]*'), '([^/])/[^/]*$', '\\1') || '/' || href END AS target
  FROM hrefs WHERE href <> ''),
a AS ({_parts('links', 'url', 'url, target')}),
b AS ({_parts('links', 'target', 'url, target')}),
edges AS (SELECT DISTINCT a.node AS x, b.node AS y FROM a JOIN b ON a.url = b.url AND a.target = b.target
  WHERE a.node <> b.node),
both_ways AS (SELECT x, y FROM edges UNION SELECT y, x FROM edges),
reach(x, y) AS (SELECT x, y FROM both_ways UNION SELECT reach.x, e.y FROM reach JOIN both_ways e ON reach.y = e.x),
ends AS (SELECT DISTINCT node, host, path FROM a UNION SELECT DISTINCT node, host, path FROM b),
decided AS (SELECT node, {_rule('v')} AS v FROM ends),
carried AS (SELECT reach.x AS node, CASE WHEN bool_or(v = 'allow') THEN 'allow' WHEN bool_or(v = 'block') THEN 'block' END AS v
  FROM reach JOIN decided ON decided.node = reach.y GROUP BY 1),
p AS ({_parts('pages', 'url', 'page_id')})
SELECT page_id, host, path, {_rule("rh || rp")} AS rule, coalesce({_rule('v')}, carried.v, 'allow') AS verdict
FROM p LEFT JOIN carried ON carried.node = p.node
"""

ORACLE["op13_filter_audit"] = """
WITH RECURSIVE texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
firsts AS (SELECT t, min(doc_id) AS first FROM texts GROUP BY t),
words AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM texts),
marks AS (SELECT doc_id, part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t), regexp_matches(t, '[#$%&*|]'),
    coalesce(doc_id > first, false)] AS fails FROM words JOIN firsts USING (t)),
known AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
    max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
groups AS (SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
    FROM marks LEFT JOIN known USING (doc_id) GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest(range(1, 6)) AS i),
orders(o) AS (SELECT '' UNION ALL SELECT o || x FROM orders, letters WHERE strpos(o, x) = 0),
steps AS (SELECT o AS filter_order, i AS step, list_transform(string_split(o, ''), lambda c: ascii(c) - 64) AS seq
    FROM orders, letters WHERE length(o) = 5),
judged AS (SELECT part, filter_order, step, seq[step] AS f, n, good, toxic, fails[seq[step]] AS failing,
    len(list_filter(seq[:step - 1], lambda k: fails[k])) > 0 AS earlier,
    len(list_filter(fails, lambda b: b)) = 1 AS alone FROM groups, steps),
sums AS (SELECT part, filter_order, step, f, sum(CASE WHEN NOT earlier AND NOT failing THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN NOT earlier AND failing THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN earlier AND failing THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN alone AND failing THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN NOT earlier AND failing THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN NOT earlier AND failing THEN toxic ELSE 0 END) AS toxic_lost FROM judged GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
    redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
    toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM sums
"""
