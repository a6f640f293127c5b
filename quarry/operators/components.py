"""Connected components of an edge table by alternating stars.

Each round hangs all larger neighbours of a node on its smallest one, then all
smaller neighbours on the smallest of them; components of any shape become
stars after a number of rounds that grows with the logarithm of their size.
Nothing of the graph reaches the driver but a count and a checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _checksum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def _hang(links: DataFrame) -> DataFrame:
    """Edges from each node of ``u`` and its partners ``v`` to the smallest of them."""
    least = links.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("low"))
    hung = links.join(least, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return hung.unionByName(least.select("u", F.col("low").alias("v"))).where("u > v").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, root)``: the smallest node reachable, for each node that is not it.

    Nulls, loops and repeated edges change nothing; no edges give no rows.
    """
    now = (edges.where(F.col(a) != F.col(b))
           .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct().checkpoint())
    before, seen = None, _checksum(now)
    while seen[0] and seen != before:
        # larger neighbours of a node, with its smaller ones to choose from
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("low"))
        large = (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
                 .distinct().checkpoint())
        now = _hang(large).checkpoint()
        before, seen = seen, _checksum(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
