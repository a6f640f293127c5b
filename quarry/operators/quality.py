"""Record assembly (J5) and row-level expectations.

Expectations are boolean columns evaluated in one projection; the summary
is one aggregation (``count_if`` per rule, partial + final). Id uniqueness
needs the only shuffle (group by id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import ustrip

# The stored record's non-key columns (all NOT NULL) and allowed classes.
RECORD_COLUMNS = ["title", "statement", "difficulty", "xp", "tags", "topic", "concept",
                  "learning_objective", "input_format", "output_format", "constraints",
                  "starter_code", "test_cases", "hints", "editorial", "created_at"]
DIFFICULTIES = ["Easy", "Medium", "Hard"]
MIN_PUBLIC, MIN_HIDDEN, N_HINTS = 1, 10, 3


def assemble_record(problem: DataFrame, components: DataFrame | None = None, key: str = "id",
                    hints_col: str = "hints") -> DataFrame:
    """The nested stored record. ``components`` (optional) is joined on
    the key (left: missing parts stay null); a ``{hints: [...]}`` struct is
    unwrapped to the bare list. Generated ``examples`` are not stored."""
    df = problem if components is None else problem.join(components, key, "left")
    if hints_col in df.columns and dict(df.dtypes)[hints_col].startswith("struct"):
        df = df.withColumn(hints_col, F.col(f"{hints_col}.hints"))
    cols = [F.col(key).alias("id")]
    for c in RECORD_COLUMNS:
        if c in df.columns:
            cols.append(F.col(c))
        elif c == "created_at":
            cols.append(F.current_timestamp().alias(c))
        else:
            cols.append(F.lit(None).alias(c))
    out = df.select(*cols)
    return out.withColumn("xp", F.col("xp").cast("int"))


def rule_columns(prefix: str = "LL") -> dict[str, Column]:
    rules: dict[str, Column] = {f"not_null_{c}": F.col(c).isNotNull() for c in RECORD_COLUMNS}
    rules["difficulty_allowed"] = F.coalesce(F.col("difficulty").isin(DIFFICULTIES), F.lit(False))
    rules["title_not_empty"] = F.coalesce(ustrip(F.col("title")) != "", F.lit(False))
    rules["starter_python_java"] = F.coalesce(
        (F.length(F.coalesce(F.col("starter_code")["python"], F.lit(""))) > 0)
        & (F.length(F.coalesce(F.col("starter_code")["java"], F.lit(""))) > 0), F.lit(False))
    rules["public_cases"] = F.coalesce(F.size(F.col("test_cases.public")) >= MIN_PUBLIC, F.lit(False))
    rules["hidden_cases"] = F.coalesce(F.size(F.col("test_cases.hidden")) >= MIN_HIDDEN, F.lit(False))
    rules["optimal_not_empty"] = F.coalesce(F.length(F.col("editorial.optimal")) > 0, F.lit(False))
    rules["three_hints"] = F.coalesce(F.size(F.col("hints")) == N_HINTS, F.lit(False))
    rules["id_prefix"] = F.coalesce(F.col("id").startswith(prefix + "-"), F.lit(False))
    return rules


def check_expectations(records: DataFrame, prefix: str = "LL", ids: DataFrame | None = None,
                       stored: DataFrame | None = None) -> DataFrame:
    """Add one boolean per rule, ``id_unique`` and ``passed`` / ``failed_rules``.

    ``ids`` may give the records' ids without their assembly; else the records
    are evaluated once more for them. ``stored``: the store; an id that it
    holds fails ``id_not_stored``. Only the store's ids are read, and of them
    only those of the batch go on (a semi-join, before which Spark puts its
    runtime Bloom filter on a large store's scan)."""
    rules = rule_columns(prefix)
    own_ids = (records if ids is None else ids).select("id")
    names = [*rules, "id_unique"]
    if stored is not None:
        taken = (stored.select("id").join(own_ids.distinct(), "id", "left_semi").distinct()
                 .withColumn("_taken", F.lit(True)))
        records = (records.join(taken, "id", "left").withColumn("rule_id_not_stored", F.col("_taken").isNull())
                   .drop("_taken"))
        names.append("id_not_stored")
    dup_ids = own_ids.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(
        "id", F.lit(False).alias("id_unique"))
    checked = records.withColumns({f"rule_{k}": v for k, v in rules.items()})
    checked = checked.join(dup_ids, "id", "left").withColumn(
        "rule_id_unique", F.coalesce(F.col("id_unique"), F.lit(True))).drop("id_unique")
    failed = F.filter(F.array(*[F.when(~F.col(f"rule_{n}"), F.lit(n)) for n in names]),
                      lambda x: x.isNotNull())
    return checked.withColumn("failed_rules", failed).withColumn("passed", F.size(failed) == 0)


def expectation_summary(checked: DataFrame) -> DataFrame:
    """Failures per rule in one pass: ``(rule, n_failed)``."""
    names = [c[len("rule_"):] for c in checked.columns if c.startswith("rule_")]
    agg = checked.agg(*[F.count_if(~F.col(f"rule_{n}")).alias(n) for n in names])
    stack = ", ".join(f"'{n}', `{n}`" for n in names)
    return agg.selectExpr(f"stack({len(names)}, {stack}) as (rule, n_failed)")


def split_pass_quarantine(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    return checked.where("passed"), checked.where("NOT passed")
