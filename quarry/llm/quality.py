"""Quality rules: word, symbol and repetition counts of each text, and robust
multivariate outliers of its transformed statistics per language and source.

Everything here is DataFrame expressions. Each group's centre and scatter are
a minimum-covariance-determinant estimate: from a start at medians and median
absolute deviations, concentration steps keep the ``core`` share of rows with
the smallest Mahalanobis distances and estimate anew, until no determinant
falls any more. A small ridge (``FLOORS``) keeps groups without spread regular:
one symbol in a text of the least length that passes the base is 0.02, and one
repeated window there, 0.12 of the words, stays within the cutoff. Distances are scaled to the
median that normal data would have, but never enlarged.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import SPACE, stage

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
#: Log word length, log symbols a word, share of repeated lines, share of words in repeated windows.
STATS = ["log_word_chars", "log_symbols", "line_repeats", "word_repeats"]
FLOORS = [0.02, 0.02, 0.03, 0.03]
CORE = 0.75
TAIL = 1e-4
#: Most concentration steps; they end earlier, once no determinant falls.
ROUNDS = 20
#: Fewest rows an estimate is made from: five a statistic.
MIN_ROWS = 20


def text_statistics(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` with ``n_words, word_chars, n_symbols, n_lines,
    n_dup_lines, n_repeat_words`` of each whole text (null: none).

    The steps are separate projections: an array that a lambda looks into is
    computed once a row.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    has_word = SPACE.replace("[", "[^")
    df = docs.select(*keep, t.alias("_t")).select(
        *keep, "_t", F.array_remove(F.split("_t", SPACE + "+"), "").alias("_w"),
        F.filter(F.split("_t", "\n"), lambda x: x.rlike(has_word)).alias("_l"))
    df = df.select(
        *keep, F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("_t", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"), "_w")
    counts = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    windows = F.transform(F.slice("_w", F.lit(1), F.greatest(F.col("n_words") - 2, F.lit(0)).cast("int")),
                          lambda x, i: F.concat_ws(" ", x, F.get("_w", i + 1), F.get("_w", i + 2)))
    df = df.select(*keep, *counts, windows.alias("_s"))
    # Only texts with a repeated window need their windows in order.
    repeats = F.size(F.array_distinct("_s")) < F.size("_s")
    ordered = F.when(repeats, F.sort_array(F.transform("_s", lambda x, i: F.struct(x.alias("s"), i.alias("i")))))
    df = df.select(*keep, *counts, ordered.alias("_o"))

    def same(e: Column, k: Column) -> Column:
        return (F.coalesce(e["s"] == F.get("_o", k - 1)["s"], F.lit(False))
                | F.coalesce(e["s"] == F.get("_o", k + 1)["s"], F.lit(False)))

    df = df.select(*keep, *counts, F.filter("_o", same).alias("_r"))
    covered = F.array_distinct(F.flatten(F.transform(
        "_r", lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2))))
    return df.select(*keep, *counts, F.coalesce(F.size(covered), F.lit(0)).cast("long").alias("n_repeat_words"))


def with_base_verdict(stats: DataFrame, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    failed = ((F.col("n_words") < min_words)
              | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")))
    return stats.withColumn("base_failed", failed)


def _vector() -> list[Column]:
    words = F.greatest("n_words", F.lit(1))
    return [F.log(F.greatest("word_chars", F.lit(1)) / words), F.log1p(F.col("n_symbols") / words),
            F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)), F.col("n_repeat_words") / words]


# ------------------------------------------------------------------- the MCD

def _low(i: int, j: int) -> str:
    return f"l{i}{j}"


def _squared_distance(names: list[str]) -> Column:
    """Forward substitution with a group's triangular factor, written out."""
    z: list[Column] = []
    for i, name in enumerate(names):
        rest = F.col(name) - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(_low(i, j)) * z[j]
        z.append(rest / F.col(_low(i, i)))
    return sum((v * v for v in z[1:]), z[0] * z[0])


def _factor(df: DataFrame, p: int) -> DataFrame:
    """Columns ``l``: Cholesky factor of the scatter columns ``c`` with its ridge."""
    for i in range(p):
        for j in range(i + 1):
            v = F.col(f"c{i}{j}")
            for k in range(j):
                v = v - F.col(_low(i, k)) * F.col(_low(j, k))
            df = df.withColumn(_low(i, j), F.sqrt(F.greatest(v, F.lit(FLOORS[i] ** 2))) if i == j
                               else v / F.col(_low(j, j)))
    return df


def _params(p: int) -> list[str]:
    return [f"m{i}" for i in range(p)] + [_low(i, j) for i in range(p) for j in range(i + 1)]


def _estimate(rows: DataFrame, group: list[str], names: list[str]) -> DataFrame:
    p = len(names)
    aggs = [F.avg(n).alias(f"m{i}") for i, n in enumerate(names)]
    for i in range(p):
        for j in range(i + 1):
            ridge = FLOORS[i] ** 2 if i == j else 0.0
            aggs.append((F.covar_pop(names[i], names[j]) + ridge).alias(f"c{i}{j}"))
    return _factor(rows.groupBy(*group).agg(*aggs), p).select(*group, *_params(p))


def _start(rows: DataFrame, group: list[str], names: list[str]) -> DataFrame:
    p = len(names)
    middle = rows.groupBy(*group).agg(*[F.percentile_approx(n, 0.5, 10000).alias(f"m{i}")
                                        for i, n in enumerate(names)])
    off = _with(rows, stage(middle, "mcd"), group).groupBy(*group).agg(
        *[F.first(f"m{i}").alias(f"m{i}") for i in range(p)],
        *[F.percentile_approx(F.abs(F.col(n) - F.col(f"m{i}")), 0.5, 10000).alias(f"d{i}")
          for i, n in enumerate(names)])
    spread = [F.greatest(1.4826 * F.col(f"d{i}"), F.lit(FLOORS[i])) if i == j else F.lit(0.0)
              for i in range(p) for j in range(i + 1)]
    names_l = [_low(i, j) for i in range(p) for j in range(i + 1)]
    return off.select(*group, *[f"m{i}" for i in range(p)], *[s.alias(n) for s, n in zip(spread, names_l)])


def _with(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """Rows with their group's columns; null languages and sources are groups.

    ``groups`` is a written table: Spark knows its size before it plans, and
    moves the rows only if there are too many groups to send to all tasks.
    """
    other = groups.select(*[F.col(c).alias(f"of_{c}") for c in by], *[c for c in groups.columns if c not in by])
    on = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in by]
    return rows.join(other, on, "left").drop(*[f"of_{c}" for c in by])


def _concentrate(inside: DataFrame, group: list[str], names: list[str], core: float) -> DataFrame:
    """Each group's estimate from all of its rows: centre, triangular factor and
    ``scale`` of distances. One row a group moves between steps."""
    groups = stage(_start(inside, group, names), "mcd")
    logdet = sum((F.log(_low(i, i)) for i in range(1, len(names))), F.log(_low(0, 0)))
    for _ in range(ROUNDS):
        far = _with(inside, groups, group).withColumn("distance", _squared_distance(names))
        edge = stage(far.groupBy(*group).agg(F.percentile_approx("distance", core, 10000).alias("edge")), "mcd")
        near = _with(far.select(*group, *names, "distance"), edge, group).where("distance <= edge")
        after = stage(_estimate(near, group, names), "mcd")
        moved = _with(groups.select(*group, logdet.alias("was")), after.select(*group, logdet.alias("now")), group)
        fell = moved.agg(F.max(F.abs(F.col("was") - F.col("now")))).first()[0]
        groups = after
        if fell is None or fell < 1e-3:
            break
    normal_median = chi_square_quantile(0.5, len(names))
    middle = (_with(inside, groups, group).withColumn("distance", _squared_distance(names)).groupBy(*group)
              .agg(F.greatest(F.percentile_approx("distance", 0.5, 10000) / normal_median, F.lit(1.0)).alias("scale")))
    return stage(_with(groups, stage(middle, "mcd"), group), "mcd")


def _apart(rows: DataFrame, groups: DataFrame, group: list[str], names: list[str]) -> DataFrame:
    """``rows`` with ``distance`` from their group's estimate, null without one."""
    return (_with(rows, groups, group).withColumn("distance", _squared_distance(names) / F.col("scale"))
            .drop(*_params(len(names)), "scale"))


def robust_distances(rows: DataFrame, group: list[str], names: list[str], fit_on: Column,
                     core: float = CORE) -> DataFrame:
    """``rows`` with ``distance``: squared, scaled, from its group's estimate,
    however small the group.

    Only rows where ``fit_on`` holds take part in estimates; in a group without
    any, the distance is null.
    """
    inside = rows.where(fit_on).select(*group, *names)
    return _apart(rows, _concentrate(inside, group, names, core), group, names)


def sized_distances(rows: DataFrame, group: tuple[str, str], names: list[str], fit_on: Column,
                    min_rows: int = MIN_ROWS, core: float = CORE) -> DataFrame:
    """``rows`` with ``distance`` from the estimate that judges their group, and
    ``level``: 0 the group's own, 1 that of the first column of ``group``, 2 that
    of all rows.

    A group takes the first of the three that ``min_rows`` rows with ``fit_on``
    stand behind, and all rows where none has so many. An estimate is made from
    all rows of its level, those of large groups too. In a group where ``fit_on``
    never holds, the distance may be null.
    """
    outer, inner = group
    sizes = stage(rows.groupBy(*group).agg(F.count_if(fit_on).alias("n")), "mcd")
    small = (F.col("n") > 0) & (F.col("n") < min_rows)
    sums = stage(sizes.groupBy(outer).agg(F.sum("n").alias("n_outer"), F.bool_or(small).alias("some_small")), "mcd")
    level = (F.when(F.col("n") >= min_rows, 0).when(F.col("n_outer") >= min_rows, 1).otherwise(2))
    levels = stage(_with(sizes, sums, [outer]).select(
        *group, level.alias("level"), ((F.col("n_outer") >= min_rows) & F.col("some_small")).alias("teaches_outer"),
        (F.col("n") > 0).alias("judged")), "mcd")
    all_rows = not levels.where("level = 2 AND judged").isEmpty()

    keys = ["level", "of_outer", "of_inner"]
    key = [F.when(F.col("level") < 2, F.col(outer)).alias("of_outer"),
           F.when(F.col("level") < 1, F.col(inner)).alias("of_inner")]
    own = F.when(F.col("level") == 0, F.lit(0))
    takes = F.array_compact(F.array(own, F.when(F.col("teaches_outer"), F.lit(1)), F.when(F.lit(all_rows), F.lit(2))))
    # A row teaches at most three estimates; without small groups just its own.
    inside = (_with(rows.where(fit_on).select(*group, *names), levels, list(group))
              .select(*group, *names, F.explode(takes).alias("level")).select(*names, "level", *key))
    groups = _concentrate(stage(inside, "mcd"), keys, names, core)
    placed = _with(rows, levels.drop("teaches_outer", "judged"), list(group)).select("*", *key)
    return _apart(placed, groups, keys, names).drop("of_outer", "of_inner")


def chi_square_quantile(share: float, p: int) -> float:
    """By bisection of the closed form of the upper tail."""
    def beyond(x: float) -> float:
        half, k = x / 2, 1 if p % 2 else 2
        out = math.erfc(math.sqrt(half)) if p % 2 else math.exp(-half)
        while k < p:
            out += math.exp(k / 2 * math.log(half) - half - math.lgamma(k / 2 + 1))
            k += 2
        return out

    low, high = 0.0, 1.0
    while beyond(high) > 1 - share:
        low, high = high, 2 * high
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if beyond(middle) > 1 - share else (low, middle)
    return high


def judge(docs: DataFrame, min_words: int = 50, max_repeat_percent: int = 50, tail: float = TAIL) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``distance`` and ``kept``.

    A row is kept if it passes the base rules and its squared distance is
    within the chi-square quantile of 1 - ``tail``. Groups are languages and
    sources; one with fewer than ``MIN_ROWS`` rows that pass the base is judged
    by its language, or by all rows (``sized_distances``; a table with fewer
    such rows by what it has). Null and empty texts have no words and fail the
    base; null languages and sources form groups; repeated rows count each
    time, equal statistics get equal verdicts; very long texts are counted
    whole, in one row's arrays; an empty table gives no rows. Only
    ``doc_id, text, lang, source`` are read.
    """
    counted = with_base_verdict(text_statistics(docs, ["doc_id", "lang", "source"]), min_words, max_repeat_percent)
    rows = stage(counted.select("*", *[v.alias(n) for v, n in zip(_vector(), STATS)]), "stats")
    far = sized_distances(rows, ("lang", "source"), STATS, ~F.col("base_failed"))
    cutoff = chi_square_quantile(1 - tail, len(STATS))
    return far.withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "distance")
