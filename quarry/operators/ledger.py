"""Model calls with a reply ledger (U1): each distinct prompt is called once.

The ledger is a folder of committed batches (``batch=<token>``, read only with
their success marker) of rows ``hash, prompt, response, error``. Prompts that
it answers are never called again; what is missing is called in waves of about
``wave`` prompts, each written and committed before the next begins, so a run
that is lost keeps all earlier waves and a rerun calls only the rest. A call
that fails is a row with its error, and is called again by the next run.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.store import _folders, committed

LEDGER = "hash binary, prompt string, response string, error string"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """One row a prompt: its reply, or the error of its last failed call."""
    folders = [f"{path.rstrip('/')}/{n}" for n in _folders(spark, path, "batch=")]
    paths = [p for p in folders if committed(spark, p)]
    rows = spark.read.schema(LEDGER).parquet(*paths) if paths else spark.createDataFrame([], LEDGER)
    # Answered rows first: one a prompt, since answered prompts are not called again.
    best = F.struct(F.col("error").isNull().alias("ok"), "prompt", "response", "error")
    return (rows.groupBy("hash").agg(F.max(best).alias("r"))
            .select("hash", "r.prompt", "r.response", "r.error"))


def _call(prompts: DataFrame, client_factory: Callable[[], Callable[[str], str]]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, broken = None, None
        try:
            client = client_factory()
        except Exception as e:  # noqa: BLE001 - no client: every call of this task fails
            broken = f"{type(e).__name__}: {e}"
        for pdf in batches:
            replies, errors = [], []
            for prompt in pdf["prompt"]:
                reply, error = None, broken
                if client is not None:
                    try:
                        reply = client(prompt)
                        if not isinstance(reply, str):
                            reply, error = None, f"reply of type {type(reply).__name__}"
                    except Exception as e:  # noqa: BLE001 - kept as a row
                        error = f"{type(e).__name__}: {e}"
                replies.append(reply)
                errors.append(error)
            yield pdf.assign(response=pd.Series(replies, dtype="object", index=pdf.index),
                             error=pd.Series(errors, dtype="object", index=pdf.index))

    return prompts.select("hash", "prompt").mapInPandas(run, LEDGER)


def generate_once(df: DataFrame, prompt_col: str, client_factory: Callable[[], Callable[[str], str]], ledger: str,
                  wave: int = 100_000, parallel: int | None = None, out: str = "response",
                  error: str = "error") -> DataFrame:
    """Every row of ``df`` with the ledger's reply to its prompt (``out``) and
    the error if it has none.

    ``client_factory`` runs on the executor and returns ``prompt -> text``; one
    client a task, ``parallel`` tasks a wave (by default as many as the session
    has slots). Null prompts are not called. Rows of one prompt may be many:
    the calls see distinct prompts, and the join back has one ledger row each.
    """
    spark = df.sparkSession
    keyed = df.withColumn("_hash", F.unhex(F.sha2(F.col(prompt_col), 256)))
    wanted = (keyed.where(F.col(prompt_col).isNotNull()).groupBy(F.col("_hash").alias("hash"))
              .agg(F.first(prompt_col).alias("prompt")))
    answered = read_ledger(spark, ledger).where("error IS NULL").select("hash")
    missing = wanted.join(answered, "hash", "left_anti").checkpoint()
    waves = -(-missing.count() // wave)
    tasks = parallel or spark.sparkContext.defaultParallelism
    for i in range(waves):
        part = missing.where(F.pmod(F.xxhash64("hash"), F.lit(waves)) == i).repartition(tasks)
        _call(part, client_factory).write.parquet(f"{ledger.rstrip('/')}/batch={uuid.uuid4().hex}")
    replies = read_ledger(spark, ledger).select(F.col("hash").alias("_hash"), F.col("response").alias(out),
                                                F.col("error").alias(error))
    return keyed.join(replies, "_hash", "left").drop("_hash")
