"""DuckDB SQL text for the correctness oracle.

Hand-written SQL expressions for the same rules as the Spark operators, so
the oracle is an independent path (RE2 regexes, DuckDB list functions).
"""

from __future__ import annotations

from quarry.functions import scoring
from quarry.plans import views

WS_BODY = r"\t-\r\x1c-\x20\x{85}\p{Z}"
WORD_BODY = r"\p{L}\p{N}_"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def ustrip(x: str) -> str:
    return (f"regexp_replace(regexp_replace({x}, '\\A[{WS_BODY}]+', ''), "
            f"'[{WS_BODY}]+\\z', '')")


def norm_text(x: str) -> str:
    inner = ustrip(f"lower(coalesce({x}, ''))")
    return f"regexp_replace({inner}, '[^{WORD_BODY}{WS_BODY}]', '', 'g')"


def norm_word(x: str) -> str:
    return f"regexp_replace(lower(coalesce({x}, '')), '[^{WORD_BODY}]', '', 'g')"


def split_words(x: str) -> str:
    s = ustrip(f"coalesce({x}, '')")
    return f"(CASE WHEN {s} = '' THEN []::VARCHAR[] ELSE regexp_split_to_array({s}, '[{WS_BODY}]+') END)"


def norm_tags(x: str) -> str:
    kept = f"list_filter(coalesce({x}, []::VARCHAR[]), lambda t: t IS NOT NULL AND t <> '')"
    return f"list_sort(list_distinct(list_transform({kept}, lambda t: {ustrip('lower(t)')})))"


def pick(values, idx: str) -> str:
    arr = "[" + ", ".join(lit(v) for v in values) + "]"
    return f"{arr}[({idx}) + 1]"


def fmt_id(n: str, prefix: str = views.ID_PREFIX) -> str:
    return f"printf('{prefix}-%06d', ({n})::BIGINT)"


def any_contains(s: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({s}, {lit(p)})" for p in phrases) + ")"


P_VIEW = f"""P AS (
  SELECT {fmt_id('p_partkey + 1')} AS id, p_partkey AS seq, p_name AS title,
         p_name || ' ' || p_type || ' ' || p_brand AS statement,
         [p_type, p_brand] AS tags,
         {pick(views.P_TOPICS, 'p_partkey % 6')} AS topic,
         {pick(views.P_PRIORS, 'p_size % 4')} AS difficulty,
         ['1 <= N <= 10^' || CAST(p_size % 10 AS VARCHAR), '1 <= A[i] <= 1000'] AS constraints,
         {pick(views.P_TIME, 'p_partkey % 7')} AS time_complexity,
         CASE WHEN p_size % 2 = 0 THEN 'O(1)' ELSE 'O(N)' END AS space_complexity
  FROM part)"""

D_VIEW = f"""D AS (
  SELECT {fmt_id('doc_id + 1')} AS id, doc_id AS seq,
         split_part(text, chr(10), 1) AS title, text AS statement,
         [lang, source] AS tags, lang AS topic
  FROM documents)"""


def constraint_text(c: str) -> str:
    return f"lower(array_to_string(coalesce({c}, []::VARCHAR[]), ' '))"


def constraint_score(c: str) -> str:
    s = constraint_text(c)
    return (f"(CASE WHEN {any_contains(s, scoring.LARGE_MARKERS)} THEN 25 "
            f"WHEN {any_contains(s, scoring.HUGE_MARKERS)} THEN 35 ELSE 10 END)")


def large_constraints(c: str) -> str:
    return any_contains(constraint_text(c), scoring.LARGE_MARKERS + scoring.HUGE_MARKERS)


def topic_score(tags: str, topic: str) -> str:
    items = f"list_transform(list_concat(coalesce({tags}, []::VARCHAR[]), [coalesce({topic}, '')]), lambda t: lower(coalesce(t, '')))"
    hard = f"len(list_filter({items}, lambda t: {any_contains('t', scoring.HARD_TOPICS)})) > 0"
    med = f"len(list_filter({items}, lambda t: {any_contains('t', scoring.MEDIUM_TOPICS)})) > 0"
    return f"(CASE WHEN {hard} THEN 30 WHEN {med} THEN 15 ELSE 5 END)"


def complexity_score(tc: str, c: str) -> str:
    s = f"lower(coalesce({tc}, ''))"
    return (f"(CASE WHEN contains({s}, 'o(n log n)') OR contains({s}, 'o(log n)') THEN 15 "
            f"WHEN contains({s}, 'o(n)') THEN 10 "
            f"WHEN contains({s}, 'o(2^') OR contains({s}, 'o(n!)') OR contains({s}, 'exponential') THEN 25 "
            f"WHEN contains({s}, 'o(n^2)') THEN (CASE WHEN {large_constraints(c)} THEN 10 ELSE 5 END) "
            f"ELSE 0 END)")


def prior_score(d: str) -> str:
    s = f"lower(coalesce({d}, 'Medium'))"
    return f"(CASE WHEN {s} = 'hard' THEN 10 WHEN {s} = 'medium' THEN 5 ELSE 0 END)"


def difficulty_score(c="constraints", tags="tags", topic="topic", tc="time_complexity", d="difficulty") -> str:
    return f"({constraint_score(c)} + {topic_score(tags, topic)} + {complexity_score(tc, c)} + {prior_score(d)})"


def difficulty_class(score: str) -> str:
    return f"(CASE WHEN {score} <= 35 THEN 'Easy' WHEN {score} >= 71 THEN 'Hard' ELSE 'Medium' END)"


def xp_award(d: str) -> str:
    s = f"lower(coalesce({d}, 'Medium'))"
    return f"CAST(CASE WHEN {s} = 'easy' THEN 20 WHEN {s} = 'medium' THEN 50 WHEN {s} = 'hard' THEN 100 ELSE 50 END AS INTEGER)"


# P view with analysed difficulty and XP (the minimum-slice record).
PF_VIEW = P_VIEW + f""",
PS AS (SELECT *, {difficulty_score()} AS difficulty_score FROM P),
PF AS (
  SELECT id, seq, title, statement, tags, topic, constraints, time_complexity, space_complexity,
         difficulty AS suggested_difficulty, difficulty_score,
         {difficulty_class('difficulty_score')} AS difficulty,
         {xp_award(difficulty_class('difficulty_score'))} AS xp
  FROM PS)"""


def index_terms(title="title", topic="topic", tags="tags", d="difficulty", xp="xp",
                tc="time_complexity", sc="space_complexity") -> str:
    parts = (f"list_concat({split_words(title)}, {split_words(topic)}, "
             f"list_transform(coalesce({tags}, []::VARCHAR[]), lambda t: coalesce(t, '')), "
             f"[coalesce({d}, ''), CAST(coalesce({xp}, 0) AS VARCHAR), coalesce({tc}, ''), coalesce({sc}, '')])")
    return f"list_distinct(list_filter(list_transform({parts}, lambda w: {norm_word('w')}), lambda t: length(t) >= 2))"


POSTINGS_FROM_PF = f"""POST AS (
  SELECT DISTINCT term, id FROM (SELECT unnest({index_terms()}) AS term, id FROM PF))"""


def pad(x: str, w: int) -> str:
    return f"(CASE WHEN length({x}) >= {w} THEN {x} ELSE rpad({x}, {w}, ' ') END)"
