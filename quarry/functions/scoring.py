"""Difficulty scoring and XP as one native projection.

All rules are ``when`` chains over lower-cased text; no Python runs per row.
Null means missing means default throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Constraint markers and their scores.
LARGE_MARKERS = ["10^5", "10^6", "200000"]      # score 25
HUGE_MARKERS = ["10^7", "10^8", "10^9"]         # score 35
SMALL_CONSTRAINT_SCORE = 10
# Topic phrases (substring match on lower-cased tags and topic).
HARD_TOPICS = ["dynamic programming", "segment tree", "fenwick tree", "graph", "dijkstra",
               "strongly connected components", "trie", "suffix array"]
MEDIUM_TOPICS = ["binary search", "sliding window", "two pointers", "bfs", "dfs", "greedy",
                 "heap", "priority queue", "recursion"]
# Class bounds (score <= 35 Easy, >= 71 Hard) and XP per class.
EASY_MAX, HARD_MIN = 35, 71
XP = {"easy": 20, "medium": 50, "hard": 100}
XP_OTHER = 50


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _any_contains(s: Column, phrases) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | s.contains(p)
    return out


def constraint_text(constraints) -> Column:
    return F.lower(F.array_join(F.coalesce(_c(constraints), F.array().cast("array<string>")), " "))


def constraint_score(constraints) -> Column:
    """F8: 25 for 10^5/10^6/200000, elif 35 for 10^7/10^8/10^9, else 10."""
    s = constraint_text(constraints)
    return (F.when(_any_contains(s, LARGE_MARKERS), F.lit(25))
            .when(_any_contains(s, HUGE_MARKERS), F.lit(35))
            .otherwise(F.lit(SMALL_CONSTRAINT_SCORE)))


def large_constraints(constraints) -> Column:
    s = constraint_text(constraints)
    return _any_contains(s, LARGE_MARKERS + HUGE_MARKERS)


def topic_score(tags, topic) -> Column:
    """30 if any tag/topic contains a hard phrase, elif a medium phrase 15, else 5."""
    items = F.concat(F.coalesce(_c(tags), F.array().cast("array<string>")),
                     F.array(F.coalesce(_c(topic), F.lit(""))))
    low = F.transform(items, lambda t: F.lower(F.coalesce(t, F.lit(""))))
    hard = F.exists(low, lambda t: _any_contains(t, HARD_TOPICS))
    med = F.exists(low, lambda t: _any_contains(t, MEDIUM_TOPICS))
    return F.when(hard, F.lit(30)).when(med, F.lit(15)).otherwise(F.lit(5))


def complexity_score(time_complexity, constraints) -> Column:
    """first hit wins on the lower-cased time complexity."""
    s = F.lower(F.coalesce(_c(time_complexity), F.lit("")))
    return (F.when(s.contains("o(n log n)") | s.contains("o(log n)"), F.lit(15))
            .when(s.contains("o(n)"), F.lit(10))
            .when(s.contains("o(2^") | s.contains("o(n!)") | s.contains("exponential"), F.lit(25))
            .when(s.contains("o(n^2)"), F.when(large_constraints(constraints), F.lit(10)).otherwise(F.lit(5)))
            .otherwise(F.lit(0)))


def prior_score(difficulty) -> Column:
    """suggested difficulty hard 10, medium 5 (missing = Medium), else 0."""
    d = F.lower(F.coalesce(_c(difficulty), F.lit("Medium")))
    return F.when(d == "hard", F.lit(10)).when(d == "medium", F.lit(5)).otherwise(F.lit(0))


def difficulty_score(constraints, tags, topic, time_complexity, difficulty) -> Column:
    """A5: sum of the four partial scores."""
    return (constraint_score(constraints) + topic_score(tags, topic)
            + complexity_score(time_complexity, constraints) + prior_score(difficulty))


def difficulty_class(score) -> Column:
    """<= 35 Easy, >= 71 Hard, else Medium."""
    s = _c(score)
    return F.when(s <= EASY_MAX, F.lit("Easy")).when(s >= HARD_MIN, F.lit("Hard")).otherwise(F.lit("Medium"))


def xp_award(difficulty) -> Column:
    """easy 20, medium 50, hard 100, anything else 50; missing = Medium."""
    d = F.lower(F.coalesce(_c(difficulty), F.lit("Medium")))
    out = F.lit(XP_OTHER)
    for k, v in reversed(list(XP.items())):
        out = F.when(d == k, F.lit(v)).otherwise(out)
    return out.cast("int")


def with_final_difficulty(df: DataFrame, constraints="constraints", tags="tags", topic="topic",
                          time_complexity="time_complexity", difficulty="difficulty") -> DataFrame:
    """Replace the suggested difficulty by the analysed class; XP follows it."""
    score = difficulty_score(constraints, tags, topic, time_complexity, difficulty)
    return (df.withColumn("difficulty_score", score)
              .withColumn("suggested_difficulty", _c(difficulty))
              .withColumn("difficulty", difficulty_class(F.col("difficulty_score")))
              .withColumn("xp", xp_award(F.col("difficulty"))))
