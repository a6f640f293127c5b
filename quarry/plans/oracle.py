"""Oracle SQL (DuckDB) for the registered queries.

Tables ``part documents pages events lineitem ...`` are views in the oracle
session. Every computed column carries the same alias as its Spark twin.
"""

from __future__ import annotations

from quarry.functions import mock, prompts
from quarry.operators import pages
from quarry.plans import duck as d
from quarry.plans import oracle_lit as L
from quarry.plans import views
from quarry.plans.queries import SEARCH_TEXT, SHUFFLE_SEED

ORACLE: dict[str, str] = {}


def sql(name: str, text: str) -> None:
    ORACLE[name] = text


def _words(q: str) -> list[str]:
    # The query string is a literal; DuckDB normalises its words below.
    return [w for w in q.split()]


# ------------------------------------------------------------ index & search

_Q_WORDS = ", ".join(f"({d.lit(w)})" for w in _words(SEARCH_TEXT))

sql("search_query", f"""
WITH {d.PF_VIEW}, {d.POSTINGS_FROM_PF},
W AS (SELECT DISTINCT {d.norm_word('w')} AS word FROM (VALUES {_Q_WORDS}) t(w) WHERE {d.norm_word('w')} <> ''),
M AS (SELECT DISTINCT w.word, p.id FROM (SELECT DISTINCT term FROM POST) v JOIN W w ON contains(v.term, w.word)
      JOIN POST p ON p.term = v.term),
H AS (SELECT id FROM M GROUP BY id HAVING count(*) = (SELECT count(*) FROM W))
SELECT PF.id, coalesce(title, '') AS title, difficulty, xp, coalesce(topic, '') AS topic,
       array_to_string(tags, ', ') AS tags, time_complexity, space_complexity,
       printf('[%s] %s (%s, %s XP)', PF.id, title, difficulty, CAST(xp AS VARCHAR)) || chr(10) ||
       '  Topic: ' || topic || chr(10) || '  Tags: ' || array_to_string(tags, ', ') || chr(10) ||
       '  Complexity: ' || time_complexity || ' | ' || space_complexity AS line
FROM PF JOIN H ON PF.id = H.id
""")

sql("postings", f"WITH {d.PF_VIEW}, {d.POSTINGS_FROM_PF} SELECT term, id FROM POST")

sql("index_terms", f"""
WITH {d.PF_VIEW}
SELECT id, array_to_string(list_sort({d.index_terms()}), ' ') AS terms,
       CAST(len({d.index_terms()}) AS INTEGER) AS n_terms FROM PF
""")

sql("search_summary", f"""
WITH {d.PF_VIEW}
SELECT id, coalesce(title, '') AS title, coalesce(difficulty, '') AS difficulty,
       array_to_string(coalesce(tags, []::VARCHAR[]), ', ') AS tags, coalesce(topic, '') AS topic,
       coalesce(xp, 0) AS xp, coalesce(time_complexity, '') AS time_complexity,
       coalesce(space_complexity, '') AS space_complexity
FROM PF
""")

sql("problem_listing", f"""
WITH {d.PF_VIEW}
SELECT id, {d.pad("coalesce(id, '')", 10)} || ' | ' || {d.pad("substr(coalesce(title, ''), 1, 28)", 30)} || ' | '
           || {d.pad("coalesce(difficulty, '')", 10)} || ' | ' || {d.pad("substr(coalesce(topic, ''), 1, 18)", 20)} AS row
FROM PF
""")

sql("search_batch", f"""
WITH {d.PF_VIEW}, {d.POSTINGS_FROM_PF},
Q AS (SELECT DISTINCT p_name AS query_id, p_name AS query FROM part),
QW AS (SELECT DISTINCT query_id, {d.norm_word('w')} AS word
       FROM (SELECT query_id, unnest({d.split_words('query')}) AS w FROM Q) WHERE {d.norm_word('w')} <> ''),
NW AS (SELECT query_id, count(*) AS n_words FROM QW GROUP BY query_id),
WT AS (SELECT DISTINCT w.word, v.term FROM (SELECT DISTINCT word FROM QW) w
       JOIN (SELECT DISTINCT term FROM POST) v ON contains(v.term, w.word)),
WI AS (SELECT DISTINCT WT.word, POST.id FROM WT JOIN POST ON POST.term = WT.term),
H AS (SELECT QW.query_id, WI.id, count(*) AS n FROM QW JOIN WI ON QW.word = WI.word GROUP BY ALL)
SELECT H.query_id, H.id, coalesce(PF.title, '') AS title
FROM H JOIN NW ON H.query_id = NW.query_id AND H.n = NW.n_words JOIN PF ON PF.id = H.id
""")

# ------------------------------------------------------------------ text core

sql("normalize_text", f"""
SELECT doc_id, md5({d.norm_text('text')}) AS norm_md5, length({d.norm_text('text')}) AS norm_len FROM documents
""")

sql("normalize_word", f"""
WITH {d.P_VIEW}
SELECT id, {d.norm_word('title')} AS title_word,
       array_to_string(list_transform(tags, lambda t: {d.norm_word('t')}), '|') AS tag_words,
       {d.norm_word('time_complexity')} AS time_word
FROM P
""")

sql("normalize_tags", f"""
WITH {d.D_VIEW}
SELECT id, array_to_string({d.norm_tags("[topic, ' ', '', upper(tags[1]), NULL::VARCHAR]")}, '|') AS tag_set FROM D
""")

sql("tag_jaccard", f"""
WITH {d.P_VIEW},
J AS (SELECT a.id, b.id AS prev_id, {d.norm_tags('a.tags')} AS sa, {d.norm_tags('b.tags')} AS sb
      FROM P a JOIN P b ON a.seq = b.seq + 1)
SELECT id, prev_id,
       CASE WHEN len(sa) = 0 AND len(sb) = 0 THEN 1.0
            WHEN len(sa) = 0 OR len(sb) = 0 THEN 0.0
            ELSE len(list_intersect(sa, sb))::DOUBLE / len(list_distinct(list_concat(sa, sb))) END AS tag_similarity
FROM J
""")

# ------------------------------------------------------------------- scoring

sql("constraint_score", f"WITH {d.P_VIEW} SELECT id, {d.constraint_score('constraints')} AS constraint_score FROM P")
sql("topic_score", f"WITH {d.P_VIEW} SELECT id, {d.topic_score('tags', 'topic')} AS topic_score FROM P")
sql("complexity_score",
    f"WITH {d.P_VIEW} SELECT id, {d.complexity_score('time_complexity', 'constraints')} AS complexity_score FROM P")
sql("prior_score", f"WITH {d.P_VIEW} SELECT id, {d.prior_score('difficulty')} AS prior_score FROM P")
sql("difficulty_score", f"WITH {d.PF_VIEW} SELECT id, difficulty_score FROM PF")
sql("difficulty_class", f"WITH {d.PF_VIEW} SELECT id, difficulty_score, difficulty FROM PF")
sql("xp_award", f"WITH {d.PF_VIEW} SELECT id, difficulty, xp FROM PF")
sql("final_difficulty",
    f"WITH {d.PF_VIEW} SELECT id, suggested_difficulty, difficulty, xp, title, topic FROM PF")


# ------------------------------------------------------------ pages -> metadata

def _links_sql(path=views.G_PATH) -> str:
    outer, leaf = path[0], path[-1]
    return f"""LB AS (SELECT page_id, array_to_string(regexp_extract_all(html, '(?is)<{outer}\\b[^>]*>(.*?)</{outer}>', 1), chr(10)) AS blk FROM pages),
LA AS (SELECT page_id, regexp_extract_all(blk, '(?is)<{leaf}\\b([^>]*)>(.*?)</{leaf}>', 0) AS anchors FROM LB),
LX AS (SELECT page_id, unnest(generate_series(0, len(anchors) - 1)) AS pos, unnest(anchors) AS a FROM LA WHERE len(anchors) > 0),
LINKS AS (SELECT page_id, CAST(pos AS INTEGER) AS pos,
  {_unescape("regexp_extract(regexp_extract(a, '(?is)^<" + leaf + "\\b([^>]*)>', 1), '(?i)href\\s*=\\s*\"([^\"]*)\"', 1)")} AS href,
  {d.ustrip(_unescape("regexp_replace(regexp_extract(a, '(?is)^<" + leaf + "\\b[^>]*>(.*)</" + leaf + ">$', 1), '<[^>]*>', '', 'g')"))} AS text
  FROM LX)"""


def _unescape(x: str) -> str:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = f"replace({x}, {d.lit(a)}, {d.lit(b)})"
    return x


_TOPICS_SQL = f"""TOPICS AS (SELECT * FROM LINKS
  WHERE length(text) >= 1 AND length(text) < {pages.MAX_TOPIC_LEN} AND contains(lower(text), {d.lit(views.G_KEYWORD.lower())}))"""

_CRAWLED_SQL = f"""CRAWLED AS (
  SELECT printf('{pages.CRAWLED_FILE_FMT}', idx + 1) AS file_name, 'crawled' AS origin, text AS topic,
         CASE WHEN idx % 2 = 0 THEN 'Medium' ELSE 'Hard' END AS difficulty,
         CASE WHEN len({d.split_words('text')}) > 0 THEN [{d.split_words('text')}[1], {d.lit(pages.CRAWLED_TAG)}]
              ELSE [{d.lit(pages.CRAWLED_TAG)}] END AS tags,
         text AS concept, printf({d.lit(pages.OBJECTIVE_FMT)}, text) AS learning_objective
  FROM (SELECT *, row_number() OVER (ORDER BY page_id, pos) - 1 AS idx FROM TOPICS))"""


def _baseline_sql() -> str:
    rows = []
    for i, (topic, diff, tags, concept, obj) in enumerate(pages.BASELINE_TOPICS):
        tl = "[" + ", ".join(d.lit(t) for t in tags) + "]"
        rows.append(f"({d.lit(pages.BASELINE_FILE_FMT % (i + 1))}, 'baseline', {d.lit(topic)}, {d.lit(diff)}, "
                    f"{tl}, {d.lit(concept)}, {d.lit(obj)})")
    return ("BASELINE AS (SELECT * FROM (VALUES " + ", ".join(rows) +
            ") t(file_name, origin, topic, difficulty, tags, concept, learning_objective))")


_COLLECTION_SQL = f"""{_links_sql()}, {_TOPICS_SQL}, {_CRAWLED_SQL}, {_baseline_sql()},
COLLECTION AS (SELECT * FROM BASELINE UNION ALL SELECT * FROM CRAWLED)"""

_META_OUT = ("SELECT file_name, origin, topic, difficulty, array_to_string(tags, '|') AS tags, concept, "
             "learning_objective FROM ")

sql("page_links", f"WITH {_links_sql()} SELECT page_id, pos, href, text FROM LINKS")
sql("crawl_topics", f"WITH {_links_sql()}, {_TOPICS_SQL} SELECT page_id, pos, href, text FROM TOPICS")
sql("crawled_metadata", f"WITH {_links_sql()}, {_TOPICS_SQL}, {_CRAWLED_SQL} {_META_OUT} CRAWLED")
sql("metadata_collection", f"WITH {_COLLECTION_SQL} {_META_OUT} COLLECTION")
sql("metadata_sink", f"WITH {_COLLECTION_SQL} {_META_OUT} COLLECTION")
sql("metadata_scan", f"WITH {_COLLECTION_SQL} {_META_OUT} COLLECTION")
sql("saved_count", f"WITH {_COLLECTION_SQL} SELECT count(*) AS saved_count FROM COLLECTION")


# ------------------------------------------------------- model replies as tables

def _render_sql(template: str, cols: set, defaults: dict | None = None) -> str:
    defaults = defaults or {}
    parts = []
    for text, field in prompts.template_parts(template):
        if text:
            parts.append(d.lit(text))
        if field is not None:
            dv = defaults.get(field, "")
            if field not in cols:
                parts.append(d.lit(dv))
            elif field in prompts.LIST_SLOTS:
                parts.append(f"array_to_string(coalesce({field}, []::VARCHAR[]), ', ')")
            else:
                parts.append(f"coalesce(CAST({field} AS VARCHAR), {d.lit(dv)})")
    return "(" + " || ".join(parts) + ")" if parts else "''"


_D_COLS = {"id", "seq", "title", "statement", "tags", "topic"}


def _render_all() -> str:
    cols = []
    for n, t in prompts.TEMPLATES.items():
        r = _render_sql(t, _D_COLS, prompts.PROBLEM_DEFAULTS if n == "problem" else None)
        cols.append(f"md5({r}) AS {n}_md5, length({r}) AS {n}_len")
    return ", ".join(cols)


sql("render_prompts", f"WITH {d.D_VIEW} SELECT id, {_render_all()} FROM D")


def _json_escape(x: str) -> str:
    x = f"regexp_replace({x}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', ' ', 'g')"
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        x = f"replace({x}, {d.lit(a)}, {d.lit(b)})"
    return x


L_VIEW = f"""LB0 AS (SELECT doc_id, '{{"text": "' || {_json_escape('text')} || '", "lang": "' || {_json_escape('lang')} || '"' || CASE WHEN doc_id % 7 = 0 THEN '' ELSE '}}' END AS body FROM documents),
LF AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '```json' || chr(10) || body || chr(10) || '```'
                           WHEN doc_id % 3 = 1 THEN '```' || chr(10) || body || chr(10) || '```'
                           ELSE body END AS f FROM LB0),
L AS (SELECT doc_id, f AS response FROM LF)"""

_LINE_SEP = "\\r\\n|[\\n\\x0b\\x0c\\r\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]"


def clean_sql(x: str) -> str:
    t = d.ustrip(x)
    rest = f"(regexp_split_to_array({t}, '{_LINE_SEP}'))[2:]"
    body = (f"(CASE WHEN len({rest}) > 0 AND {d.ustrip(f'{rest}[-1]')} = '```' "
            f"THEN {rest}[1:len({rest}) - 1] ELSE {rest} END)")
    return f"(CASE WHEN starts_with({t}, '```') THEN {d.ustrip(f'array_to_string({body}, chr(10))')} ELSE {t} END)"


def json_ok(x: str) -> str:
    t = d.ustrip(x)
    return (f"(CASE WHEN {x} IS NOT NULL AND json_valid({x}) AND starts_with({t}, '{{') "
            f"AND ends_with({t}, '}}') THEN json_type({x}) = 'OBJECT' ELSE false END)")


sql("clean_llm_json", f"""
WITH {L_VIEW}, C AS (SELECT doc_id, {clean_sql('response')} AS c FROM L)
SELECT doc_id, md5(c) AS clean_md5, length(c) AS clean_len FROM C
""")

sql("parse_or_fallback", f"""
WITH {L_VIEW}, C AS (SELECT doc_id, {clean_sql('response')} AS c FROM L),
K AS (SELECT doc_id, c, {json_ok('c')} AS ok FROM C)
SELECT doc_id, ok AS parsed_ok,
       md5(CASE WHEN ok THEN json_extract_string(c, '$.text') ELSE '' END) AS text_md5,
       CASE WHEN ok THEN json_extract_string(c, '$.lang') ELSE 'und' END AS lang
FROM K
""")

sql("default_fill", f"""
WITH {d.D_VIEW}
SELECT id, coalesce(topic, 'Coding') AS topic,
       coalesce(CASE WHEN quality = 1 THEN 'Easy' WHEN quality = 0 THEN 'Hard' END, 'Medium') AS difficulty,
       coalesce(CASE WHEN toxic = 1 THEN 'Moderation' END, 'General') AS concept,
       array_to_string(tags, ', ') AS tags
FROM D LEFT JOIN labels ON labels.doc_id = D.seq
""")

sql("metadata_overlay", f"""
WITH {d.P_VIEW},
R AS (SELECT *, '{{"title": "' || {_json_escape('title')} || '", "statement": "' || {_json_escape('statement')}
      || '", "constraints": ["1 <= N <= 10"], "topic": "Other", "difficulty": "Easy"}}' AS reply FROM P),
K AS (SELECT *, {json_ok(clean_sql('reply'))} AS ok, {clean_sql('reply')} AS c FROM R)
SELECT id, CASE WHEN ok THEN json_extract_string(c, '$.title') END AS title,
       CASE WHEN ok THEN json_extract_string(c, '$.statement') END AS statement,
       topic, array_to_string(tags, '|') AS tags, NULL::VARCHAR AS concept, '' AS learning_objective,
       difficulty,
       CASE WHEN ok THEN array_to_string(CAST(json_extract(c, '$.constraints') AS VARCHAR[]), '|') END AS constraints
FROM K
""")


def _mock_sql() -> str:
    md = mock.MOCK_DEFAULTS
    topic = f"coalesce(topic, {d.lit(md['topic'])})"
    concept = f"coalesce(concept, {d.lit(md['concept'])})"
    diff = f"coalesce(difficulty, {d.lit(md['difficulty'])})"
    tags = "coalesce(tags, [" + ", ".join(d.lit(t) for t in md["tags"]) + "])"
    return (f"SELECT file_name, printf({d.lit(mock.TITLE_FMT)}, {topic}) AS title, "
            f"md5(printf({d.lit(mock.STATEMENT_FMT)}, {concept}, {diff})) AS statement_md5, "
            f"{d.lit('|'.join(mock.MOCK_CONSTRAINTS))} AS constraints, {d.lit(mock.INPUT_FORMAT)} AS input_format, "
            f"{d.lit(mock.OUTPUT_FORMAT)} AS output_format, 1 AS n_examples, {topic} AS topic, {diff} AS difficulty, "
            f"array_to_string({tags}, '|') AS tags, {concept} AS concept, "
            f"coalesce(learning_objective, {d.lit(md['learning_objective'])}) AS learning_objective FROM COLLECTION")


sql("mock_problems", f"WITH {_COLLECTION_SQL} {_mock_sql()}")

sql("mock_components", f"""
WITH {_COLLECTION_SQL}
SELECT file_name, {d.lit('|'.join(sorted(mock.STARTER)))} AS languages, {len(mock.PUBLIC_CASES)} AS n_public,
       {len(mock.HIDDEN_CASES)} AS n_hidden, {len(mock.HINTS)} AS n_hints, {d.lit(mock.MOCK_TIME)} AS time_complexity,
       md5({d.lit(mock.STARTER['python'])}) AS python_md5
FROM COLLECTION
""")

sql("llm_generate", f"""
WITH {d.D_VIEW}
SELECT id, CAST(length({_render_sql(prompts.TEMPLATES['hints'], _D_COLS)}) AS BIGINT) AS n, true AS parsed_ok FROM D
""")


# ------------------------------------------------------------ verdicts & gates

def _cases_values() -> str:
    rows = []
    for i, (inp, out) in enumerate(mock.PUBLIC_CASES):
        rows.append(f"({i}, {d.lit(inp)}, {d.lit(out)}, NULL::VARCHAR)")
    for j, (inp, out, t) in enumerate(mock.HIDDEN_CASES):
        rows.append(f"({len(mock.PUBLIC_CASES) + j}, {d.lit(inp)}, {d.lit(out)}, {d.lit(t)})")
    return "MC AS (SELECT * FROM (VALUES " + ", ".join(rows) + ") t(case_idx, input, expected, type))"


sql("case_flatten", f"""
WITH {d.P_VIEW}, {_cases_values()}
SELECT P.id AS problem_id, CAST(case_idx AS INTEGER) AS case_idx, input, expected, type FROM P CROSS JOIN MC
""")

V_VIEW = """G AS (SELECT l_orderkey AS problem_id, l_linenumber AS case_idx, max(l_quantity) AS q,
              max(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 1 ELSE 0 END) AS rf,
              min(l_linestatus) AS st, max(l_tax) AS tax, max(l_discount) AS disc
       FROM lineitem GROUP BY 1, 2),
VC AS (SELECT problem_id, case_idx, st || ' ' AS expected FROM G),
VO AS (SELECT problem_id, case_idx, CASE WHEN tax >= 0.08 THEN 'X' ELSE '  ' || st END AS actual,
              CAST(rf AS INTEGER) AS exit_code, q >= 49 AS timed_out FROM G WHERE disc < 0.1),
VR AS (SELECT c.problem_id, c.case_idx, c.expected, o.actual, o.exit_code, o.timed_out,
              o.problem_id IS NOT NULL AS has_output
       FROM VC c LEFT JOIN VO o ON c.problem_id = o.problem_id AND c.case_idx = o.case_idx)"""

_ACT, _EXP = "coalesce(actual, '')", "coalesce(expected, '')"
_TEQ = f"({d.ustrip(_ACT)} = {d.ustrip(_EXP)})"

sql("case_results", f"WITH {V_VIEW} SELECT problem_id, case_idx, expected, actual, exit_code, timed_out, has_output FROM VR")
sql("case_match", f"WITH {V_VIEW} SELECT problem_id, case_idx, {_TEQ} AND has_output AS match FROM VR")

sql("case_verdicts", f"""
WITH {V_VIEW},
K AS (SELECT *, CASE WHEN NOT has_output THEN 'missing_output'
                     WHEN coalesce(timed_out, false) THEN 'timeout'
                     WHEN coalesce(exit_code, 0) <> 0 THEN 'runtime_error'
                     WHEN NOT {_TEQ} THEN 'mismatch' END AS kind FROM VR),
A AS (SELECT problem_id, count(*) AS n_cases, count_if(kind IS NOT NULL) AS n_failed,
             min(CASE WHEN kind IS NOT NULL THEN case_idx END) AS first_idx FROM K GROUP BY problem_id),
A2 AS (SELECT A.*, K.kind AS first_kind FROM A LEFT JOIN K ON K.problem_id = A.problem_id AND K.case_idx = A.first_idx)
SELECT o_orderkey AS problem_id, coalesce(n_cases, 0) > 0 AND coalesce(n_failed, 0) = 0 AS passed,
       coalesce(n_cases, 0) AS n_cases, first_idx AS first_fail_idx,
       CASE WHEN coalesce(n_cases, 0) = 0 THEN 'no_cases' ELSE first_kind END AS first_fail_kind
FROM orders LEFT JOIN A2 ON A2.problem_id = o_orderkey
""")

_CONSTR = "[" + ", ".join(d.lit(c) for c in mock.MOCK_CONSTRAINTS) + "]"
DR_VIEW = f"""{d.D_VIEW},
DR AS (SELECT D.*, CASE WHEN quality = 1 THEN 'Easy' WHEN quality = 0 THEN 'Hard' END AS sugg,
              CASE WHEN url IS NOT NULL THEN regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) END AS concept,
              CASE WHEN toxic = 0 THEN 'Write a clean solution' END AS learning_objective,
              {_CONSTR} AS constraints, {d.lit(mock.MOCK_TIME)} AS time_complexity
       FROM D LEFT JOIN labels ON labels.doc_id = D.seq LEFT JOIN pages ON pages.page_id = D.seq),
DS AS (SELECT *, {d.difficulty_score(d='sugg')} AS score FROM DR),
DF AS (SELECT *, {d.difficulty_class('score')} AS difficulty, {d.xp_award(d.difficulty_class('score'))} AS xp FROM DS)"""

_REC_OUT = (f"SELECT id, md5(title) AS title_md5, md5(statement) AS statement_md5, difficulty, xp, "
            f"array_to_string(tags, '|') AS tags, topic, concept, learning_objective, "
            f"array_to_string(constraints, '|') AS constraints, {len(mock.STARTER)} AS n_languages, "
            f"{len(mock.PUBLIC_CASES)} AS n_public, {len(mock.HIDDEN_CASES)} AS n_hidden, {len(mock.HINTS)} AS n_hints, "
            f"time_complexity FROM DF")

sql("assemble_records", f"WITH {DR_VIEW} {_REC_OUT}")


def _rules_sql() -> list[tuple[str, str]]:
    """The rules on records broken by their number (see ``checked_records``)."""
    rules = []
    data = {"title", "statement", "difficulty", "xp", "tags", "topic", "concept", "learning_objective", "constraints"}
    broken = {"hints": "seq % 19 <> 0", "input_format": "seq % 23 <> 0"}
    for c in ("title statement difficulty xp tags topic concept learning_objective input_format output_format "
              "constraints starter_code test_cases hints editorial created_at").split():
        rules.append((f"not_null_{c}", f"{c} IS NOT NULL" if c in data else broken.get(c, "true")))
    rules += [("difficulty_allowed", "coalesce(difficulty IN ('Easy', 'Medium', 'Hard'), false)"),
              ("title_not_empty", f"coalesce({d.ustrip('title')} <> '', false)"),
              ("starter_python_java", "seq % 5 <> 0"), ("public_cases", "seq % 17 <> 0"),
              ("hidden_cases", "seq % 7 <> 0"), ("optimal_not_empty", "seq % 13 <> 0"),
              ("three_hints", "seq % 11 <> 0 AND seq % 19 <> 0"),
              ("id_prefix", "coalesce(starts_with(id, 'LL-'), false)"), ("id_unique", "id_n = 1")]
    return rules


_DFU = f"""{DR_VIEW}, DB AS (SELECT * REPLACE (CASE WHEN seq % 101 = 0 THEN 'LL-000001'
  WHEN seq % 97 = 0 THEN 'XX' || substr(id, 3) ELSE id END AS id) FROM DF),
DU AS (SELECT *, count(*) OVER (PARTITION BY id) AS id_n FROM DB)"""

sql("expectations", f"WITH {_DFU} " + " UNION ALL ".join(
    f"SELECT '{n}' AS rule, count_if(NOT ({c})) AS n_failed FROM DU" for n, c in _rules_sql()))

sql("expectations_quarantine", f"""
WITH {_DFU}, Q AS (SELECT id, concat_ws('|', {', '.join(f"CASE WHEN NOT ({c}) THEN '{n}' END" for n, c in _rules_sql())}) AS failed_rules FROM DU)
SELECT id, failed_rules FROM Q WHERE failed_rules <> ''
""")

# ---------------------------------------------------------------- store & runs

sql("store_append", f"WITH {DR_VIEW} {_REC_OUT}")
sql("store_scan", f"WITH {DR_VIEW} {_REC_OUT}")
sql("store_overwrite", f"WITH {DR_VIEW} {_REC_OUT} WHERE topic <> 'en'")
sql("store_count", f"WITH {DR_VIEW} SELECT count(id) AS n_records FROM DF")
sql("index_io", f"WITH {d.PF_VIEW}, {d.POSTINGS_FROM_PF} SELECT POST.id, term, title FROM POST JOIN PF ON PF.id = POST.id")
sql("assign_ids", f"""
SELECT doc_id, {d.fmt_id('(SELECT count(*) FROM part) + row_number() OVER (ORDER BY doc_id)')} AS id FROM documents
""")
sql("shuffle_order", f"""
WITH {d.P_VIEW}
SELECT id, title, row_number() OVER (ORDER BY md5('{SHUFFLE_SEED}' || id), id) - 1 AS position FROM P
""")
sql("generation_limit", f"""
WITH {d.PF_VIEW}
SELECT id, title, difficulty FROM PF ORDER BY md5('{SHUFFLE_SEED}' || id), id LIMIT 10
""")
sql("retry_first_success", f"""
WITH E AS (SELECT user_id AS key, ts, event_id,
                  CASE event_type WHEN 'purchase' THEN 'inserted' WHEN 'view' THEN 'duplicate' ELSE 'failure' END AS outcome
           FROM events WHERE event_type IN ('purchase', 'view', 'error')),
R AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) AS rn FROM E),
S AS (SELECT key, min(CASE WHEN outcome = 'inserted' THEN rn END) AS s, count(*) AS n FROM R GROUP BY key)
SELECT S.key, CASE WHEN s IS NOT NULL THEN 'inserted' ELSE 'failed' END AS status,
       CAST(s AS INTEGER) AS success_attempt, CAST(coalesce(s, n) AS INTEGER) AS n_attempts,
       CAST(count_if(outcome = 'duplicate' AND rn < coalesce(s, n + 1)) AS INTEGER) AS n_duplicates,
       CAST(count_if(outcome = 'failure' AND rn < coalesce(s, n + 1)) AS INTEGER) AS n_failures
FROM S JOIN R ON S.key = R.key GROUP BY S.key, s, n
""")
sql("run_summary", """
SELECT strftime(ts, '%Y-%m-%d') AS run, count_if(event_type = 'purchase') AS inserted,
       count_if(event_type = 'view') AS duplicates, count_if(event_type = 'error') AS failures,
       (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS elapsed_sec
FROM events GROUP BY 1
""")


# ------------------------------------------------------------------ near-dup
# Scores come from the plain-Python brute force in oracle_lit (DuckDB has no
# Ratcliff-Obershelp); everything else is SQL.

def _lit_entries() -> None:
    if not L.available():
        return
    adj = L.values([r[:4] for r in L.adjacent_scores()],
                   ["id", "prev_id", "title_similarity", "statement_similarity"])
    adj_sql = f"""WITH {d.P_VIEW}, ADJ AS {adj},
J AS (SELECT ADJ.*, {d.norm_tags('pa.tags')} AS sa, {d.norm_tags('pb.tags')} AS sb
      FROM ADJ JOIN P pa ON pa.id = ADJ.id JOIN P pb ON pb.id = ADJ.prev_id),
S AS (SELECT id, prev_id, title_similarity, statement_similarity,
             CASE WHEN len(sa) = 0 AND len(sb) = 0 THEN 1.0 WHEN len(sa) = 0 OR len(sb) = 0 THEN 0.0
                  ELSE len(list_intersect(sa, sb))::DOUBLE / len(list_distinct(list_concat(sa, sb))) END AS tag_similarity
      FROM J),
W AS (SELECT *, title_similarity * 0.4 + statement_similarity * 0.5 + tag_similarity * 0.1 AS weighted_similarity FROM S)"""
    sql("sequence_ratio", f"{adj_sql} SELECT id, prev_id, title_similarity, statement_similarity FROM W")
    sql("weighted_similarity", f"{adj_sql} SELECT id, prev_id, tag_similarity, weighted_similarity FROM W")
    sql("is_duplicate", f"""{adj_sql} SELECT id, prev_id, (title_similarity >= 0.85 OR statement_similarity >= 0.85
        OR weighted_similarity >= 0.85) AS is_duplicate FROM W""")

    sql("near_dup_pairs", "SELECT * FROM " + L.values(L.string_pairs(*L.part_split()), [
        "branch", "new_id", "existing_id", "n_new", "n_existing", "title_similarity", "statement_similarity",
        "tag_similarity", "weighted_similarity"]))
    fd_cols = ["id", "dup_id", "dup_seq", "title_similarity", "statement_similarity", "tag_similarity",
               "weighted_similarity"]
    sql("first_duplicate", "SELECT * FROM " + L.values(L.part_first_matches(), fd_cols))
    gone_b = L.values([(k,) for k in L.document_matches()], ["id"])
    sql("dedupe_gate_benchmark", f"WITH {d.D_VIEW} SELECT id, seq FROM D WHERE id NOT IN (SELECT id FROM {gone_b})")
    new, old = L.gate_split()
    gone = L.values([(r.id,) for r in new if L.first_match(r, old)], ["id"])
    sql("dedupe_gate", f"WITH {d.P_VIEW} SELECT id, seq FROM P WHERE seq % 101 >= 2 "
                       f"AND id NOT IN (SELECT id FROM {gone})")
    made = L.part_run()
    sql("generation_run", "SELECT * FROM " + L.values(made, ["id", "seq", "outcome", "new_id"]))
    n = {k: sum(r[2] == k for r in made) for k in ("inserted", "duplicate", "failure")}
    sql("generation_counters", f"SELECT {n['inserted']} AS inserted, {n['duplicate']} AS duplicates, "
                               f"{n['failure']} AS failures")
    kept = L.values([(k,) for k in L.keep_first(L.part_records())], ["id"])
    sql("greedy_dedupe", f"WITH {d.P_VIEW} SELECT id, seq, title FROM P WHERE id IN (SELECT id FROM {kept})")
    sql("stream_gate", f"WITH {d.P_VIEW} SELECT id, title FROM P WHERE id IN (SELECT id FROM {kept})")


_lit_entries()


# ------------------------------------------------------------------ streaming
sql("stream_index", f"WITH {d.PF_VIEW}, {d.POSTINGS_FROM_PF} SELECT term, id FROM POST")

sql("metadata_rejects", """
SELECT 'malformed' AS reason, md5('{"concept": "c' || doc_id || '", "topic": "' || lang || '"'
       || CASE WHEN doc_id % 5 = 1 THEN '' ELSE ', "tags": 7}' END) AS raw_md5
FROM documents WHERE doc_id % 5 IN (1, 3)
""")

sql("llm_generate_once", """
WITH asked AS (SELECT doc_id, n_chars // 1000 AS size, 'thousands of characters in ' || lang || ' ' || (n_chars // 1000) AS prompt
               FROM documents)
SELECT doc_id, CASE WHEN size % 2 = 0 THEN length(prompt)::INTEGER END AS n,
       CASE WHEN size % 2 = 1 THEN 'ValueError: odd' END AS error FROM asked
""")

sql("expectations_stored", f"""
WITH {d.D_VIEW}
SELECT id, true AS rule_id_unique, seq % 7 <> 0 AS rule_id_not_stored, seq % 7 = 0 AS listed FROM D
""")
