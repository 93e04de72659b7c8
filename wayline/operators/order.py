"""Exact order statistics without a sorted list: a sketch brackets the value, and only what lies in the bracket is put in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The sketch's ranks are right to one part in so many; the bracket reaches some such parts to either side.
ACCURACY, REACH = 2_000, 4


def upper_median(df: DataFrame, keys: Sequence[str], value: str, name: str = "middle", accuracy: int = ACCURACY) -> DataFrame:
    """A row for each key: the value that floor(n / 2) others come before, of two middle ones the upper. Nulls don't count; a key of nulls has no row.

    Without keys one row, or none. Two passes: the sketch gives two values that the median lies between; then values below are
    counted, those between are counted one by one and summed up in order, some thousandths of a key's rows at most. Numbers only;
    NaN is greatest. Should the bracket miss, the query fails.
    """
    share = REACH / accuracy
    some = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    bounds = some.groupBy(*keys).agg(F.count("*").alias("_size"), F.percentile_approx("_v", [max(0.0, 0.5 - share), min(1.0, 0.5 + share)], accuracy).alias("_b"))
    both = some.join(bounds, list(keys)) if keys else some.join(F.broadcast(bounds))  # one row
    # the least and the greatest value of a small key may be sketched, so ranges are open where they are the bounds
    between = both.where(F.col("_v") <= F.col("_b")[1]).groupBy(*keys, "_size", F.when(F.col("_v") >= F.col("_b")[0], F.col("_v")).alias("_v")).agg(F.count("*").alias("_n"))
    order = Window.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    summed = between.withColumn("_sum", F.sum("_n").over(order)).where(F.col("_sum") > F.floor(F.col("_size") / 2))
    found = summed.groupBy(*keys, "_size").agg(F.min(F.struct("_sum", "_v")).alias("_m"))
    every = bounds.select(*keys, F.col("_size").alias("_all"))
    held = every.join(found, list(keys), "left") if keys else every.join(found, how="left")  # one row
    missed = F.raise_error(F.lit("the sketch's bracket misses the median"))
    return held.where("_all > 0").select(*keys, F.when(F.col("_m._v").isNull(), missed).otherwise(F.col("_m._v")).alias(name))
