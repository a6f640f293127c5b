"""Metadata files: directory scan (S1) and sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.pages import META_SCHEMA

SINK_COLUMNS = ["file_name", "origin", "topic", "difficulty", "tags", "concept", "learning_objective"]


def metadata_scan(spark: SparkSession, path: str, one_object_per_file: bool = True) -> DataFrame:
    """Read metadata JSON; unreadable records/files are dropped, not fatal.

    ``one_object_per_file`` reads the hand-written layout (each ``*.json``
    holds one object); the file name without ``.json`` becomes ``file_name``
    unless the data or a partition folder already carries it.
    """
    schema = T.StructType(META_SCHEMA.fields + [T.StructField("file_name", T.StringType())])
    r = (spark.read.schema(schema).option("mode", "DROPMALFORMED")
         .option("multiLine", one_object_per_file))
    df = r.json(path)
    from_path = F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")
    return df.withColumn("file_name", F.coalesce(F.col("file_name"), from_path))


CORRUPT = "_corrupt_record"


def metadata_rejects(spark: SparkSession, path: str, one_object_per_file: bool = True,
                     pattern: str = "*.json") -> DataFrame:
    """What ``metadata_scan`` leaves out: ``file_name, path, reason, raw``.

    ``malformed``: text that is no record, or a record with a field of another
    type, as it stands in the file (a line, or the whole file where each holds
    one object). ``no record``: files that hold only white space (the reader's
    listing leaves out files of no bytes: nothing is lost with them). Every field is parsed, whatever columns a reader would ask for; files are
    listed without reading their contents.
    """
    schema = T.StructType([*META_SCHEMA.fields, T.StructField("file_name", T.StringType()),
                           T.StructField(CORRUPT, T.StringType())])
    parsed = F.from_json("raw", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    rows = (spark.read.option("wholetext", one_object_per_file).option("pathGlobFilter", pattern)
            .option("recursiveFileLookup", "true").text(path)
            .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))
            .where(F.length(F.regexp_replace("raw", r"\s+", "")) > 0))
    bad = (rows.withColumn("parsed", parsed).where(F.col("parsed").isNull() | F.col(f"parsed.{CORRUPT}").isNotNull())
           .select("path", F.lit("malformed").alias("reason"), "raw"))
    files = (spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
             .load(path).select(F.col("_metadata.file_path").alias("path")))
    silent = (files.join(rows.select("path").distinct(), "path", "left_anti")
              .select("path", F.lit("no record").alias("reason"), F.lit(None).cast("string").alias("raw")))
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.json$", "")
    return bad.unionByName(silent).select(name.alias("file_name"), "path", "reason", "raw")


def metadata_sink(collection: DataFrame, path: str, per_record_files: bool = False) -> int:
    """Overwrite the metadata collection as JSON; returns the count.

    Default layout is one folder per origin (JSON lines, file name kept as a
    column). ``per_record_files`` writes one single-object file per record
    (a folder per ``file_name``) - the hand-written layout, for small
    collections only.
    """
    obs = Observation("metadata_sink")
    out = collection.select(*SINK_COLUMNS).observe(obs, F.count(F.lit(1)).alias("n"))
    w = out.write.mode("overwrite")
    if per_record_files:
        w.partitionBy("file_name").json(path)
    else:
        w.partitionBy("origin").json(path)
    return int(obs.get["n"])  # counted while writing, no second pass
