"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Every shard draws a number for a key, from the key and the shard's number alone,
and the key goes to the shard of the greatest draw; a shard's weight stretches
its draws, so that shards hold rows in proportion to their weights. A shard that
is added takes from all others what it wins and nothing moves between the
others; one that is taken away, or whose weight falls, gives its rows away only.

Places in a shard are gapless: rows are counted by buckets of a shard, a running
sum over the buckets gives each its first place, and rows are numbered within
their bucket. Equal rows are counted before they are shuffled, so that a key of
a third of all rows is one line of a bucket and not a hot group.

The key is any column or columns; a null one is a key too. Rows of one key lie
in one shard, however many they are. Null texts have no bytes and the checksum
of the empty text. Equal draws go to the smaller shard. An empty table gives an
empty result. Other columns are ignored, or carried by ``assigned``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayline.llm.common import written

#: Buckets of a shard, bytes a record takes besides its text, and equal rows that are numbered together.
BUCKETS, OVERHEAD, TOGETHER = 4096, 16, 4096


def draws(key: Sequence[str], weights: Sequence[float], first: int = 0) -> Column:
    """An array of (draw, minus shard) of the shards from ``first`` on: weight over the negative logarithm of a uniform number."""
    if any(w <= 0 for w in weights):
        raise ValueError("weights must be positive")
    numbers = F.array(*(F.struct(F.lit(first + k).cast("bigint").alias("shard"), F.lit(float(w)).alias("weight")) for k, w in enumerate(weights)))

    def draw(s: Column) -> Column:
        uniform = (F.shiftrightunsigned(F.xxhash64(*key, s["shard"]), 12) + F.lit(0.5)) * F.lit(2.0**-52)  # never 0 or 1
        return F.struct((s["weight"] / -F.log(uniform)).alias("draw"), (-s["shard"]).alias("minus"))

    return F.transform(numbers, draw)


def shard_of(key: Sequence[str], weights: Sequence[float]) -> Column:
    """The shard, from 0, of the greatest draw."""
    return (-F.array_max(draws(key, weights))["minus"]).cast("int")


def grown(key: Sequence[str], weights: Sequence[float], shard: Column, more: float = 1.0) -> Column:
    """The shard if one of weight ``more`` is added: the new one or the same. ``shard`` is the one without it."""
    new = F.element_at(draws(key, [more], first=len(weights)), 1)
    own = F.element_at(draws(key, weights), shard + 1)
    return F.when(new["draw"] > own["draw"], len(weights)).otherwise(shard).cast("int")


def assigned(docs: DataFrame, weights: Sequence[float], key: Sequence[str] = ("doc_id",), name: str = "shard") -> DataFrame:
    """All columns and the shard of each row, without a shuffle; a column of that name is replaced."""
    return docs.withColumn(name, shard_of(key, weights))


def moved(docs: DataFrame, before: Sequence[float], after: Sequence[float], key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``from_shard``, ``to_shard`` and ``n_rows`` of the rows that change their shard."""
    both = docs.select(shard_of(key, before).alias("from_shard"), shard_of(key, after).alias("to_shard")).where("from_shard <> to_shard")
    return both.groupBy("from_shard", "to_shard").agg(F.count("*").alias("n_rows"))


def placed(docs: DataFrame, weights: Sequence[float], buckets: int = BUCKETS) -> DataFrame:
    """``doc_id``, ``size`` (bytes), ``text_crc32``, ``shard``, ``slot`` (from 0 in each shard) and ``grown_shard`` (with one shard more).

    Slots follow buckets, then doc_id (null first), size and checksum; rows equal in all of these are alike and take any of theirs.
    """
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text).cast("bigint") + OVERHEAD).alias("size"), F.crc32(text).alias("text_crc32"))
    own = ["doc_id", "size", "text_crc32"]
    bucket = F.pmod(F.xxhash64(*own), F.lit(buckets)).cast("int")
    alike = rows.groupBy(*own).agg(F.count("*").alias("n")).withColumn("shard", shard_of(["doc_id"], weights))
    alike, _ = written(alike.withColumns({"bucket": bucket, "grown_shard": grown(["doc_id"], weights, F.col("shard"))}))

    sums = alike.groupBy("shard", "bucket").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select("shard", "bucket", F.coalesce(before, F.lit(0)).alias("bucket_start"))  # shards x buckets
    within = F.sum("n").over(Window.partitionBy("shard", "bucket").orderBy(*own).rowsBetween(Window.unboundedPreceding, -1))
    first = alike.withColumn("start", F.coalesce(within, F.lit(0))).join(starts, ["shard", "bucket"])

    parts = first.select(*own, "shard", "grown_shard", (F.col("bucket_start") + F.col("start")).alias("start"), "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(TOGETHER))).alias("skip"))
    dealt = parts.repartition("shard", "start", "skip")  # the parts of many equal rows go to many tasks
    slot = F.explode(F.sequence(F.col("start") + F.col("skip"), F.col("start") + F.least(F.col("skip") + TOGETHER, F.col("n")) - 1))
    return dealt.select(*own, "shard", slot.alias("slot"), "grown_shard")


def write(docs: DataFrame, folder: str, weights: Sequence[float], key: Sequence[str] = ("doc_id",), files: int = 1) -> None:
    """Writes the shards as ``folder/shard=K``, each in about so many files; rows of a hot key are split over them like any other."""
    plain = [f.name for f in docs.schema if "map<" not in f.dataType.simpleString()]  # maps have no hash
    spread = F.pmod(F.xxhash64(*plain), F.lit(files))
    assigned(docs, weights, key).repartition("shard", spread).write.partitionBy("shard").parquet(folder)
