"""Difficulty, class and XP goldens."""
from pyspark.sql import functions as F

from quarry.functions import scoring
from quarry.functions.mock import MOCK_CONSTRAINTS, MOCK_TIME

ROWS = [  # (topic, suggested, tags, expected score, class)
    ("Sliding Window", "Medium", ["Array", "Two Pointer"], 55, "Medium"),
    ("Sliding Window", "Easy", ["Array", "String"], 50, "Medium"),
    ("Binary Search", "Hard", ["Array", "Optimization"], 60, "Medium"),
    ("Prefix Sum", "Easy", ["Array", "Prefix Sum"], 40, "Medium"),
    ("Breadth First Search", "Medium", ["Graph", "BFS"], 70, "Medium"),
    ("Dynamic Programming", "Hard", ["Dynamic Programming", "Grid"], 75, "Hard"),
    ("Monotonic Stack", "Medium", ["Stack", "Monotonic Stack"], 45, "Medium"),
]


def test_difficulty_goldens(spark):
    df = spark.createDataFrame([(t, d, tg) for t, d, tg, _, _ in ROWS],
                               "topic string, difficulty string, tags array<string>")
    df = df.withColumn("constraints", F.array(*[F.lit(c) for c in MOCK_CONSTRAINTS])).withColumn(
        "time_complexity", F.lit(MOCK_TIME))
    out = scoring.with_final_difficulty(df).select("difficulty_score", "difficulty", "xp").collect()
    assert [(r.difficulty_score, r.difficulty) for r in out] == [(s, c) for *_, s, c in ROWS]
    assert [r.xp for r in out] == [100 if c == "Hard" else 50 for *_, c in ROWS]


def test_constraint_branch_order(spark):
    df = spark.createDataFrame([(["N <= 10^5", "A <= 10^9"],), (["A <= 10^9"],), (["N <= 10^4"],),
                                (["100000"],), (["10^50"],), (None,)], "c array<string>")
    got = [r.s for r in df.select(scoring.constraint_score("c").alias("s")).collect()]
    assert got == [25, 35, 10, 10, 25, 10]


def test_complexity_first_hit(spark):
    df = spark.createDataFrame([("O(N log N)",), ("Brute Force: O(N^2), Optimal: O(N)",), ("O(2^N)",),
                                ("O(N^2)",), ("o(n log k)",), (None,)], "t string")
    got = [r.s for r in df.select(scoring.complexity_score("t", F.array(F.lit("1 <= N <= 10^5"))).alias("s")).collect()]
    assert got == [15, 10, 25, 10, 0, 0]


def test_xp_and_class(spark):
    df = spark.createDataFrame([("easy",), ("MEDIUM",), ("Hard",), ("other",), (None,)], "d string")
    assert [r.x for r in df.select(scoring.xp_award("d").alias("x")).collect()] == [20, 50, 100, 50, 50]
    s = spark.createDataFrame([(35,), (36,), (70,), (71,)], "s int")
    assert [r.c for r in s.select(scoring.difficulty_class("s").alias("c")).collect()] == [
        "Easy", "Medium", "Medium", "Hard"]


def test_topic_substring_rules(spark):
    df = spark.createDataFrame([(["Heaps"], ""), (["Retrieval"], ""), (["Two Pointer"], ""), ([], "Graph Theory")],
                               "tags array<string>, topic string")
    got = [r.s for r in df.select(scoring.topic_score("tags", "topic").alias("s")).collect()]
    assert got == [15, 30, 5, 30]
