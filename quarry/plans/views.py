"""Adapter views: the driver's test tables seen as the record model.

Each view is a single native projection (or one aggregation for V), so it
fuses into the consumer's whole-stage codegen span and Catalyst prunes the
parquet scan to the columns actually used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the P view (part as problems).
P_TOPICS = ["Sliding Window", "Graph Traversal", "Prefix Sum", "Dynamic Programming",
            "Binary Search", "Heaps"]
P_PRIORS = ["Easy", "Medium", "Hard", "Unknown"]
P_TIME = ["O(N)", "O(N log N)", "O(2^N)", "O(N^2)", "O(N!)", "",
          "Brute Force: O(N^2), Optimal: O(N)"]
ID_PREFIX = "LL"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values, idx: Column) -> Column:
    """values[idx] for a 0-based integer column (CASE-like, codegen friendly)."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def format_id(n: Column, prefix: str = ID_PREFIX) -> Column:
    """``PREFIX-%06d``; widens past 999999 (never truncates)."""
    return F.format_string(f"{prefix}-%06d", n.cast("long"))


def problems_from_part(part: DataFrame) -> DataFrame:
    """P view."""
    k, size = F.col("p_partkey"), F.col("p_size")
    return part.select(
        format_id(k + 1).alias("id"),
        k.alias("seq"),
        F.col("p_name").alias("title"),
        F.concat(F.col("p_name"), F.lit(" "), F.col("p_type"), F.lit(" "), F.col("p_brand")).alias("statement"),
        F.array(F.col("p_type"), F.col("p_brand")).alias("tags"),
        pick(P_TOPICS, k % 6).alias("topic"),
        pick(P_PRIORS, size % 4).alias("difficulty"),
        F.array(F.concat(F.lit("1 <= N <= 10^"), (size % 10).cast("string")),
                F.lit("1 <= A[i] <= 1000")).alias("constraints"),
        pick(P_TIME, k % 7).alias("time_complexity"),
        F.when(size % 2 == 0, F.lit("O(1)")).otherwise(F.lit("O(N)")).alias("space_complexity"),
    )


def problems_from_documents(docs: DataFrame) -> DataFrame:
    """D view."""
    first_line = F.substring_index(F.col("text"), "\n", 1)
    return docs.select(
        format_id(F.col("doc_id") + 1).alias("id"),
        F.col("doc_id").alias("seq"),
        first_line.alias("title"),
        F.col("text").alias("statement"),
        F.array(F.col("lang"), F.col("source")).alias("tags"),
        F.col("lang").alias("topic"),
    )


def items_from_benchmark(bench: DataFrame) -> DataFrame:
    """benchmark items as stored problems (title = first line)."""
    first_line = F.substring_index(F.col("text"), "\n", 1)
    return bench.select(
        format_id(F.col("item_id") + 1, "BM").alias("id"),
        F.col("item_id").alias("seq"),
        first_line.alias("title"),
        F.col("text").alias("statement"),
        F.array().cast("array<string>").alias("tags"),
    )


def case_tables_from_lineitem(lineitem: DataFrame) -> tuple[DataFrame, DataFrame]:
    """V view: (cases, outputs) keyed by (problem_id, case_idx).

    One partial+final aggregation over lineitem feeds both. An output exists
    only for groups whose largest discount is below 0.1, so some cases have
    no produced output (a failure).
    """
    g = (lineitem.groupBy(F.col("l_orderkey").alias("problem_id"),
                          F.col("l_linenumber").alias("case_idx"))
         .agg(F.max("l_quantity").alias("_q"),
              F.max(F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), 1)
                    .otherwise(0)).alias("_rf"),
              F.min("l_linestatus").alias("_st"),
              F.max("l_tax").alias("_tax"),
              F.max("l_discount").alias("_disc")))
    cases = g.select("problem_id", "case_idx",
                     F.concat(F.col("problem_id").cast("string"), F.lit(":"),
                              F.col("case_idx").cast("string")).alias("input"),
                     F.concat(F.col("_st"), F.lit(" ")).alias("expected"),
                     F.lit("recorded").alias("type"))
    outputs = g.where(F.col("_disc") < 0.1).select(
        "problem_id", "case_idx",
        F.when(F.col("_tax") >= 0.08, F.lit("X")).otherwise(F.concat(F.lit("  "), F.col("_st"))).alias("actual"),
        F.col("_rf").cast("int").alias("exit_code"),
        (F.col("_q") >= 49).alias("timed_out"))
    return cases, outputs


# Fixed values of the E view: event type -> attempt outcome.
E_OUTCOMES = {"purchase": "inserted", "view": "duplicate", "error": "failure"}


def attempts_from_events(events: DataFrame) -> DataFrame:
    """E view: (key, ts, event_id, outcome); other event types dropped first."""
    m = F.create_map(*[x for kv in E_OUTCOMES.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return (events.where(F.col("event_type").isin(list(E_OUTCOMES)))
            .select(F.col("user_id").alias("key"), "ts", "event_id",
                    m[F.col("event_type")].alias("outcome")))


def json_escape(c: Column) -> Column:
    """Minimal JSON string escaping, identical in every engine."""
    c = F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " ")
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    c = F.replace(c, F.lit('"'), F.lit('\\"'))
    c = F.replace(c, F.lit("\n"), F.lit("\\n"))
    c = F.replace(c, F.lit("\r"), F.lit("\\r"))
    return F.replace(c, F.lit("\t"), F.lit("\\t"))


def responses_from_documents(docs: DataFrame) -> DataFrame:
    """L view: documents as model replies (fenced variants, every 7th without its closing brace)."""
    close = F.when(F.col("doc_id") % 7 == 0, F.lit('"')).otherwise(F.lit('"}'))
    body = F.concat(F.lit('{"text": "'), json_escape(F.col("text")), F.lit('", "lang": "'),
                    json_escape(F.col("lang")), close)
    m3 = F.col("doc_id") % 3
    fenced = (F.when(m3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
              .when(m3 == 1, F.concat(F.lit("```\n"), body, F.lit("\n```")))
              .otherwise(body))
    return docs.select("doc_id", fenced.alias("response"))


# Fixed values of the G view.
G_PATH = ["nav", "ul", "li", "a"]
G_KEYWORD = "e"
