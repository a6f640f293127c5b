"""Incremental runs with Structured Streaming.

Arriving candidate files are processed with ``trigger(availableNow=True)``
and ``foreachBatch``; each micro-batch is an ordinary batch plan:

* ``stream_gate`` (R1): candidates are checked against the store *and*
  against those accepted earlier in the same batch (greedy keep-first with
  the store as pre-accepted records), then appended to the store under a token
  of the stream's query id and the batch id. A replayed batch overwrites its
  own folder and ignores it when reading the store, so the sink is idempotent
  (exactly-once output with the stream checkpoint); other streams have other
  ids and never touch it.
* ``stream_index`` (R2): postings and summaries of each batch's records are
  appended under the same token; the union equals a full rebuild, also where
  records arrive again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators import neardup, search
from quarry.sources import store as st


def _run(stream: DataFrame, fn, checkpoint: str) -> None:
    """Process everything that has arrived; ``fn`` gets each batch and a token
    of its own, the same again if that batch is replayed.

    The token holds the query's id from the checkpoint: a stream with another
    checkpoint never meets this one's folders.
    """
    def batch(df: DataFrame, batch_id: int) -> None:
        meta = df.sparkSession.read.json(f"{checkpoint.rstrip('/')}/metadata").first()
        fn(df, f"{meta['id']}-{batch_id}")

    (stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def stream_gate(spark: SparkSession, source: str, schema: T.StructType, store_base: str, checkpoint: str,
                t: float = neardup.THRESHOLD, max_files_per_trigger: int = 1, **cols) -> None:
    """Gate each arriving batch against the store and itself, append the rest."""
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
              .parquet(source))

    def batch(df: DataFrame, token: str) -> None:
        current = st.store_scan(spark, store_base, exclude_batch=token)
        kept = neardup.greedy_dedupe(df, store=current, t=t, **cols).where("accepted").drop("accepted")
        st.store_append(kept, store_base, batch=token)

    _run(stream, batch, checkpoint)


def stream_index(spark: SparkSession, source: str, schema: T.StructType, index_base: str, checkpoint: str,
                 max_files_per_trigger: int = 1) -> None:
    """R2: keep the index current: postings/summary of new records per batch.

    A pair (term, id) is written once, however often its record arrives: those
    of ids that earlier batches hold are compared with their postings, which
    are read only where there are such ids. Of several summaries of an id the
    last to arrive counts. A replayed batch writes its own folders anew."""
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
              .parquet(source))

    def batch(df: DataFrame, token: str) -> None:
        number = int(token.rsplit("-", 1)[1])
        new = search.postings(df).dropDuplicates(["term", "id"])
        before = _index_part(spark, index_base, "summary", exclude_batch=token)
        if before is not None:
            again = before.select("id").join(df.select("id").distinct(), "id", "left_semi").distinct().checkpoint()
            if not again.isEmpty():
                held = (_index_part(spark, index_base, "postings", exclude_batch=token).select("term", "id")
                        .join(again, "id", "left_semi"))
                new = new.join(held, ["term", "id"], "left_anti")
        new.write.mode("overwrite").parquet(f"{index_base}/postings/batch={token}")
        (search.search_summary(df).dropDuplicates(["id"]).withColumn("arrival", F.lit(number))
         .write.mode("overwrite").parquet(f"{index_base}/summary/batch={token}"))

    _run(stream, batch, checkpoint)


def _index_part(spark: SparkSession, index_base: str, part: str, exclude_batch: str | None = None) -> DataFrame | None:
    """One side of the index from its committed batches; none: None."""
    base = f"{index_base.rstrip('/')}/{part}"
    paths = [f"{base}/{n}" for n in st._folders(spark, base, "batch=") if n != f"batch={exclude_batch}"]
    paths = [p for p in paths if st.committed(spark, p)]
    return spark.read.parquet(*paths) if paths else None


def read_stream_index(spark: SparkSession, index_base: str) -> tuple[DataFrame, DataFrame]:
    """Postings and summaries of the committed batches, the last summary of
    each id. An index without any committed batch is an error."""
    post, summ = (_index_part(spark, index_base, part) for part in ("postings", "summary"))
    if post is None or summ is None:
        raise ValueError(f"no committed batch in {index_base}")
    kept = [c for c in summ.columns if c != "arrival"]
    last = summ.groupBy("id").agg(F.max_by(F.struct(*kept), "arrival").alias("s"))
    return post, last.select("s.*")


def write_slices(df: DataFrame, path: str, order: str, n: int) -> None:
    """Write ``df`` as ``n`` arrivals by ranges of ``order``: one job each, with
    as many files as its rows need."""
    bounds = df.agg(F.min(order).alias("a"), F.max(order).alias("b")).first()
    lo, hi = int(bounds["a"]), int(bounds["b"])
    step = (hi - lo) // n + 1
    for i in range(n):
        part = df.where((F.col(order) >= lo + i * step) & (F.col(order) < lo + (i + 1) * step))
        part.write.mode("append").parquet(path)
