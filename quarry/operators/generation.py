"""Model replies as table work.

``generate`` is the only Python on the path: a user-supplied client is
created once per partition inside ``mapInPandas`` and called per prompt;
any error becomes a null reply, which ``parse_or_fallback`` turns into the
offline value. Cleaning and parsing are native (``split``/``filter``,
``from_json`` with a corrupt-record column).
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import ustrip, with_clean_llm_json

CORRUPT = "_corrupt"

PROBLEM_REPLY = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("statement", T.StringType()),
    T.StructField("constraints", T.ArrayType(T.StringType())),
    T.StructField("input_format", T.StringType()),
    T.StructField("output_format", T.StringType()),
    T.StructField("examples", T.ArrayType(T.StructType([
        T.StructField("input", T.StringType()), T.StructField("output", T.StringType()),
        T.StructField("explanation", T.StringType())]))),
])

OVERLAY_FIELDS = ["topic", "tags", "concept", "learning_objective", "difficulty"]


def parse_reply(cleaned, schema: T.StructType) -> Column:
    """from_json with a corrupt-record column; null for anything a strict
    JSON object parser would refuse (malformed, empty, not an object,
    trailing text after the object)."""
    full = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])
    c = F.col(cleaned) if isinstance(cleaned, str) else cleaned
    parsed = F.from_json(c, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT,
                                   "allowSingleQuotes": "false"})
    # The cleaned text is already stripped. from_json stops after the first
    # value; as the only element of an array, nothing may stand behind it.
    alone = F.json_array_length(F.concat(F.lit("["), c, F.lit("]"))) == 1
    ok = (c.isNotNull() & F.coalesce(alone, F.lit(False)) & parsed.isNotNull() & parsed[CORRUPT].isNull()
          & c.startswith("{") & c.endswith("}"))
    return F.when(ok, parsed.dropFields(CORRUPT))


def parse_or_fallback(df: DataFrame, reply: str, schema: T.StructType, fallback: Column,
                      out: str = "parsed") -> DataFrame:
    """F16: cleaned + parsed reply, or the whole fallback value on any failure.

    Staged projections: clean once, parse once, then derive both outputs."""
    c, p = f"_{out}_clean", f"_{out}_p"
    df = with_clean_llm_json(df, reply, c)
    df = df.withColumn(p, parse_reply(F.col(c), schema))
    return (df.withColumn(out, F.coalesce(F.col(p), fallback)).withColumn(f"{out}_ok", F.col(p).isNotNull())
            .drop(c, p))


def default_fill(df: DataFrame, defaults: dict) -> DataFrame:
    """P5: null (= missing) fields take their default."""
    cols = {}
    for k, v in defaults.items():
        d = F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v)
        cols[k] = F.coalesce(F.col(k), d) if k in df.columns else d
    return df.withColumns(cols)


def metadata_overlay(problem: DataFrame, prefix: str = "meta_") -> DataFrame:
    """After parsing, metadata fields overwrite the reply's fields.

    Metadata columns are expected as ``meta_<field>``; a missing learning
    objective becomes ``""``.
    """
    cols = {}
    for f in OVERLAY_FIELDS:
        src = F.col(prefix + f)
        cols[f] = F.coalesce(src, F.lit("")) if f == "learning_objective" else src
    return problem.withColumns(cols)


def generate(df: DataFrame, prompt_col: str, client_factory: Callable[[], Callable[[str], str]],
             out: str = "response", key_cols: list[str] | None = None) -> DataFrame:
    """Call a model client for every prompt; one client per partition.

    ``client_factory`` runs on the executor and returns ``prompt -> text``.
    Failures (exceptions, non-string results) give a null reply; a factory
    that fails gives its whole partition null replies.
    """
    keys = key_cols or [c for c in df.columns if c != prompt_col]
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField(prompt_col, T.StringType()),
                                                          T.StructField(out, T.StringType())])

    def run(batches):
        try:
            client = client_factory()
        except Exception:  # noqa: BLE001 - no client: every call fails
            def client(_):
                raise RuntimeError("no client")
        for pdf in batches:
            res = []
            for p in pdf[prompt_col]:
                try:
                    r = client(p)
                    res.append(r if isinstance(r, str) else None)
                except Exception:  # noqa: BLE001 - a failed call falls back later
                    res.append(None)
            pdf = pdf.copy()
            pdf[out] = pd.Series(res, dtype="object")
            yield pdf

    return df.select(*keys, prompt_col).mapInPandas(run, schema)
