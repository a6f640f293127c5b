"""The record store (S5, S6, S7, S10) as versioned Parquet.

Layout: ``<base>/v=<NNNNNN>/batch=<token>/part-*.parquet``. A batch folder
counts once its job has left its ``_SUCCESS`` marker, and a version once it
has such a batch: a write that fails is never read. Reads take the newest
version; an append writes one batch folder into it; an overwrite writes one
batch into a *new* version, so a job may rewrite the store from a plan that
still reads the old one. Tokens are unique unless the caller names one: a
token named again replaces that batch alone (a stream's replay).
One writer at a time. Listing uses the Hadoop FileSystem of the path (works
for any shared file system the cluster names).
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STORE_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("statement", T.StringType()),
    T.StructField("difficulty", T.StringType()),
    T.StructField("xp", T.IntegerType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("topic", T.StringType()),
    T.StructField("concept", T.StringType()),
    T.StructField("learning_objective", T.StringType()),
    T.StructField("input_format", T.StringType()),
    T.StructField("output_format", T.StringType()),
    T.StructField("constraints", T.ArrayType(T.StringType())),
    T.StructField("starter_code", T.MapType(T.StringType(), T.StringType())),
    T.StructField("test_cases", T.StructType([
        T.StructField("public", T.ArrayType(T.StructType([
            T.StructField("input", T.StringType()), T.StructField("output", T.StringType())]))),
        T.StructField("hidden", T.ArrayType(T.StructType([
            T.StructField("input", T.StringType()), T.StructField("output", T.StringType()),
            T.StructField("type", T.StringType())]))),
    ])),
    T.StructField("hints", T.ArrayType(T.StringType())),
    T.StructField("editorial", T.StructType([
        T.StructField("brute_force", T.StringType()), T.StructField("optimal", T.StringType()),
        T.StructField("time_complexity", T.StringType()), T.StructField("space_complexity", T.StringType()),
        T.StructField("common_mistakes", T.ArrayType(T.StringType()))])),
    T.StructField("created_at", T.TimestampType()),
])


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


SUCCESS = "_SUCCESS"


def _folders(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """Names of the folders in ``path`` that start with ``prefix``, sorted."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    found = [(st.getPath().getName(), st.isDirectory()) for st in fs.listStatus(p)]
    return sorted(name for name, folder in found if folder and name.startswith(prefix))


def committed(spark: SparkSession, path: str) -> bool:
    """Whether the job that wrote the folder ended well."""
    fs, p = _fs(spark, f"{path.rstrip('/')}/{SUCCESS}")
    return fs.exists(p)


def version_numbers(spark: SparkSession, base: str) -> list[int]:
    """All version numbers in use, committed or not."""
    return [int(n[2:]) for n in _folders(spark, base, "v=") if n[2:].isdigit()]


def batches(spark: SparkSession, base: str, v: int) -> list[str]:
    """Paths of the committed batches of a version."""
    paths = [f"{_vpath(base, v)}/{n}" for n in _folders(spark, _vpath(base, v), "batch=")]
    return [p for p in paths if committed(spark, p)]


def versions(spark: SparkSession, base: str) -> list[int]:
    """Committed versions: those with at least one committed batch."""
    return [v for v in version_numbers(spark, base) if batches(spark, base, v)]


def _vpath(base: str, v: int) -> str:
    return f"{base.rstrip('/')}/v={v:06d}"


def conform(df: DataFrame) -> DataFrame:
    """Project/cast a record frame onto the store schema (missing -> null)."""
    cols = []
    for f in STORE_SCHEMA.fields:
        cols.append((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name))
    return df.select(*cols)


def store_scan(spark: SparkSession, base: str, exclude_batch: str | None = None) -> DataFrame:
    """Newest committed version of the store; none -> empty frame, same schema.

    ``exclude_batch`` hides one batch (a replayed stream batch must not see
    its own earlier output)."""
    vs = versions(spark, base)
    paths = [p for p in batches(spark, base, vs[-1]) if not p.endswith(f"/batch={exclude_batch}")] if vs else []
    if not paths:
        return spark.createDataFrame([], STORE_SCHEMA)
    return spark.read.schema(STORE_SCHEMA).parquet(*paths)


def import_json_array(spark: SparkSession, path: str) -> DataFrame:
    """S5 (import): one JSON array document; a missing file reads as empty, and
    what cannot be parsed is dropped. Any other error is raised."""
    try:
        return spark.read.schema(STORE_SCHEMA).option("multiLine", True).option(
            "mode", "DROPMALFORMED").json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STORE_SCHEMA)


def store_append(df: DataFrame, base: str, batch: str | None = None) -> str:
    """Append records to the newest version (create the first if none).

    Each call writes its own ``batch=`` folder; a given ``batch`` token is
    rewritten on replay instead of duplicated."""
    spark = df.sparkSession
    vs = versions(spark, base)
    token = batch if batch is not None else uuid.uuid4().hex
    used = version_numbers(spark, base)
    path = f"{_vpath(base, vs[-1] if vs else (used[-1] + 1 if used else 1))}/batch={token}"
    conform(df).write.mode("overwrite").parquet(path)
    return path


def store_overwrite(df: DataFrame, base: str) -> str:
    """Write the whole store as a new version (never the one being read).

    The old version stays in force until the write has committed."""
    spark = df.sparkSession
    used = version_numbers(spark, base)
    path = f"{_vpath(base, used[-1] + 1 if used else 1)}/batch={uuid.uuid4().hex}"
    conform(df).write.mode("errorifexists").parquet(path)
    return path


def store_count(spark: SparkSession, base: str) -> DataFrame:
    """``count(id)`` of the store as a one-row frame."""
    return store_scan(spark, base).agg(F.count("id").alias("n_records"))
