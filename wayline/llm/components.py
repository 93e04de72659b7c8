"""Connected components by alternating large-star and small-star steps.

Every step keeps a minimum per node, pre-aggregated, and joins it back on; no
node's neighbours are ever gathered. The minima are written before the join, so
that Spark may split the join of a hub. It ends when a step changes no edge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.llm.common import remove, written


def large_star(edges: DataFrame) -> tuple[DataFrame, str]:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least, at = written(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")), at


def small_star(edges: DataFrame) -> tuple[DataFrame, str]:
    down = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least, at = written(down.groupBy("u").agg(F.min("v").alias("m")))
    rest = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.select("u", F.col("m").alias("v"))), at


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component``, the smallest node it is connected to, of every node that is not that itself; ``edges``: u, v."""
    spark = edges.sparkSession
    now, at = written(edges.select("u", "v").where("u <> v").distinct())
    rows = now.count()
    while True:
        large, minima = large_star(now)
        wide, between = written(large.distinct())
        small, more = small_star(wide)
        after, at_after = written(small.distinct())
        rows_after = after.count()
        done = rows_after == rows and after.join(now, ["u", "v"], "left_anti").isEmpty()
        remove(spark, at, minima, between, more)
        if done:
            return after.select(F.col("u").alias("node"), F.col("v").alias("component"))
        now, at, rows = after, at_after, rows_after
