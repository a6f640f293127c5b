"""Test-case verdicts over recorded outputs.

Running candidate programs is not the engine's job; their outputs arrive as
a table ``(problem_id, case_idx, actual, exit_code, timed_out)``. A verdict
is then one left join plus one aggregation with map-side partial
aggregation (counts and a ``min`` of a struct are algebraic, so a problem
holding a third of all cases never lands whole in one task).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import trimmed_equal

# Failure kinds in the order they are checked for one case.
KIND_MISSING = "missing_output"
KIND_TIMEOUT = "timeout"
KIND_RUNTIME = "runtime_error"
KIND_MISMATCH = "mismatch"
KIND_NO_CASES = "no_cases"


def case_flatten(problems: DataFrame, key: str = "id", cases: str = "test_cases") -> DataFrame:
    """Public then hidden cases, 0-based running index; a missing list is empty."""
    pub = F.transform(F.coalesce(F.col(f"{cases}.public"), F.array()),
                      lambda x: F.struct(x["input"].alias("input"), x["output"].alias("output"),
                                         F.lit(None).cast("string").alias("type")))
    hid = F.transform(F.coalesce(F.col(f"{cases}.hidden"), F.array()),
                      lambda x: F.struct(x["input"].alias("input"), x["output"].alias("output"),
                                         x["type"].alias("type")))
    return (problems.select(F.col(key).alias("problem_id"),
                            F.posexplode(F.concat(pub, hid)).alias("case_idx", "c"))
            .select("problem_id", F.col("case_idx").cast("int").alias("case_idx"),
                    F.col("c.input").alias("input"), F.col("c.output").alias("expected"),
                    F.col("c.type").alias("type")))


def case_results(cases: DataFrame, outputs: DataFrame) -> DataFrame:
    """Every expected case with the produced output of its input (left join)."""
    o = outputs.select("problem_id", "case_idx", "actual", "exit_code", "timed_out",
                       F.lit(True).alias("has_output"))
    j = cases.join(o, ["problem_id", "case_idx"], "left")
    return j.withColumn("has_output", F.coalesce(F.col("has_output"), F.lit(False)))


def case_match(results: DataFrame) -> DataFrame:
    """Trimmed equality of produced and expected output."""
    return results.withColumn("match", trimmed_equal("actual", "expected") & F.col("has_output"))


def with_case_outcome(results: DataFrame) -> DataFrame:
    kind = (F.when(~F.col("has_output"), F.lit(KIND_MISSING))
            .when(F.coalesce(F.col("timed_out"), F.lit(False)), F.lit(KIND_TIMEOUT))
            .when(F.coalesce(F.col("exit_code"), F.lit(0)) != 0, F.lit(KIND_RUNTIME))
            .when(~trimmed_equal("actual", "expected"), F.lit(KIND_MISMATCH)))
    return results.withColumn("fail_kind", kind).withColumn("ok", kind.isNull())


def case_verdicts(problems: DataFrame, cases: DataFrame, outputs: DataFrame,
                  key: str = "problem_id") -> DataFrame:
    """A3: pass iff at least one case and every case ok; else the first
    failing case (lowest index) and its kind. Problems without cases fail."""
    r = with_case_outcome(case_results(cases, outputs))
    agg = r.groupBy("problem_id").agg(
        F.count(F.lit(1)).alias("n_cases"),
        F.count_if(~F.col("ok")).alias("n_failed"),
        F.min(F.when(~F.col("ok"), F.struct("case_idx", "fail_kind"))).alias("first_fail"))
    p = problems.select(F.col(key).alias("problem_id")).join(agg, "problem_id", "left")
    n = F.coalesce(F.col("n_cases"), F.lit(0))
    return p.select(
        "problem_id",
        ((n > 0) & (F.coalesce(F.col("n_failed"), F.lit(0)) == 0)).alias("passed"),
        n.alias("n_cases"),
        F.col("first_fail.case_idx").alias("first_fail_idx"),
        F.when(n == 0, F.lit(KIND_NO_CASES)).otherwise(F.col("first_fail.fail_kind")).alias("first_fail_kind"))
