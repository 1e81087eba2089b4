"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm.common import materialize


def _stars(edges: DataFrame) -> bool:
    """Whether every edge hangs a node on the root of its component: each ``u`` has one ``v``, and no ``v`` is a ``u``."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    ends = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return ends.filter("hangs > 1 OR hangs > 0 AND holds > 0").isEmpty()


#: Far above the logarithm of any diameter.
MOST_ROUNDS = 200


def connected(edges: DataFrame, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """``node`` and ``root``, the smallest node that it is linked with, for every node of ``edges`` (a, b).

    Each round hangs the larger neighbours of every node on its smallest one, then the smaller ones;
    the number of rounds grows with the logarithm of the largest component's diameter. A hub's
    neighbours are combined before the shuffle, and its rows are dealt by AQE's skew join. Components
    that are not done after ``most_rounds`` are an error, never a result.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    left = most_rounds
    while not _stars(now):
        if not left:
            raise RuntimeError(f"components are not connected after {most_rounds} rounds")
        left -= 1
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        now = materialize(hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
