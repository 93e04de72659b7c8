"""Document fingerprints: threshold-scaled sketches, in DataFrame functions only.

A sketch keeps every distinct hash of five-word shingles that lies in the lowest
quarter of all hash values, and nothing else, so the sketch of two texts
together is the union of theirs. The share of the smaller sketch that the larger
holds estimates containment, however unequal the documents are. A text of fewer
than five words is one shingle.

Beside the sketch, a fingerprint has the text's least hash, which merges by
minimum: it tells texts apart of which no hash is low enough. Two empty sketches
are as alike as their least hashes are equal; an empty sketch and another are
not alike. Texts without words have neither, and are alike.

Nulls are empty texts. Ids are whole numbers. Rows of equal ids follow each
other by a hash of the text, then by text; rows without an id come last,
likewise. A document is compared with the next in descending order by dealing
documents once to ranges of (id, hash); a range also gets the first document of
the next range, and an id with many rows is many ranges. Other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayline.llm.common import texts

WORDS = 5
#: Hashes whose highest bits are all zero are kept: one in four.
LOW_BITS = 2
#: Documents to a range of ids; splits by quantile; most ranges, whose first ids go through the driver.
RANGE_ROWS, QUANTILES, MOST_RANGES = 5_000, 256, 100_000


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the fingerprint of a text column: its sorted ``sketch``, and its ``least`` hash."""
    words = F.array_remove(F.split(F.lower(text), r"[ \t\n\x0B\f\r]+"), "")
    hashed = df.withColumn("_w", F.transform(words, lambda w: F.xxhash64(w)))
    w, n = F.col("_w"), F.size("_w")
    shingles = F.when(n >= WORDS, F.transform(F.sequence(F.lit(0), n - WORDS), lambda i: F.xxhash64(*(w[i + k] for k in range(WORDS))))).when(n > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))
    hashed = hashed.withColumn("_s", shingles)
    low = F.filter("_s", lambda h: F.shiftrightunsigned(h, 64 - LOW_BITS) == 0)
    return hashed.withColumn(name, F.struct(F.sort_array(F.array_distinct(low)).alias("sketch"), F.array_min("_s").alias("least"))).drop("_w", "_s")


def merged(a: Column, b: Column) -> Column:
    """The fingerprint of two texts together, but for shingles across the seam."""
    return F.struct(F.sort_array(F.array_union(a["sketch"], b["sketch"])).alias("sketch"), F.least(a["least"], b["least"]).alias("least"))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of the smaller document's shingles that the larger holds."""
    n, m = F.size(a["sketch"]), F.size(b["sketch"])
    shared = F.size(F.array_intersect(a["sketch"], b["sketch"])) / F.least(n, m)
    return F.when(F.least(n, m) > 0, shared).otherwise(((n == m) & a["least"].eqNullSafe(b["least"])).cast("double"))


def written(fingerprint: Column) -> Column:
    """The sketch's hashes in hexadecimal, a stroke, and the least hash; equal for equal texts, and empty without words."""
    digits = lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")
    return F.coalesce(F.concat(F.array_join(F.transform(fingerprint["sketch"], digits), ""), F.lit("-"), digits(fingerprint["least"])), F.lit(""))


def range_of(bounds: list[int], at: Column, splits: int) -> Column:
    """The range of an id: between two quantiles, found by halving, and an equal split between these."""

    def halve(lo: int, hi: int) -> Column:
        if hi - lo == 1:
            first, after = bounds[lo], bounds[hi]
            split = F.floor((at - first).cast("double") * splits / max(1, after - first))
            return F.lit(lo * splits) + F.least(F.greatest(split, F.lit(0)), F.lit(splits - 1))
        mid = (lo + hi) // 2
        return F.when(at < bounds[mid], halve(lo, mid)).otherwise(halve(mid, hi))

    return F.coalesce(halve(0, len(bounds) - 1), F.lit(0)).cast("bigint") if len(bounds) > 1 else F.lit(0).cast("bigint")


def with_next(docs: DataFrame, *columns: str) -> DataFrame:
    """Adds ``next_<column>`` of the next lower (``doc_id``, hash of text), after the lowest of the highest, in one shuffle.

    Ranges are named (range, part): a range of ids, and a part by hash of an id that many quantiles fall on, or of no id.
    """
    spark = docs.sparkSession
    rows, nulls = docs.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    n = min(MOST_RANGES, max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / RANGE_ROWS)))  # several to a task, so that tasks are even
    quantiles = min(n, QUANTILES)
    cuts = docs.agg(F.percentile_approx("doc_id", [i / quantiles for i in range(quantiles + 1)], 10_000).alias("q")).first()["q"] or []
    bounds, splits = sorted(set(cuts)), math.ceil(n / quantiles)
    heavy = {x: cuts.count(x) * splits for x in bounds if cuts.count(x) > 1}  # at most QUANTILES ids
    if nulls:
        heavy[None] = max(1, math.ceil(n * nulls / rows))
    own_id, place = F.col("doc_id"), F.shiftrightunsigned(F.xxhash64("text"), 33)  # 31 bits
    parts = F.lit(1)
    for x, k in heavy.items():
        parts = F.when(own_id.isNull() if x is None else own_id == x, k).otherwise(parts)
    # an id of many rows is the lowest of its range, as it is a quantile: it has a range of its own, of odd number
    alone = own_id.isNull() | own_id.isin(*[x for x in heavy if x is not None])
    ranges = F.when(own_id.isNull(), F.lit(-1)).otherwise(2 * range_of(bounds, own_id, splits) + alone.cast("int")).cast("bigint")
    placed = docs.withColumn("_order", place).withColumn("range", ranges).withColumn("part", F.floor(F.col("_order") * parts / F.lit(float(1 << 31))).cast("bigint"))
    first = placed.groupBy("range", "part").agg(F.max("doc_id").alias("id"), F.max("_order").alias("order")).collect()  # at most MOST_RANGES, and one more for each heavy id's
    first.sort(key=lambda r: (r["id"] is not None, r["id"] or 0, r["order"]))
    guests = [(*r, after["range"], after["part"]) for r, after in zip(first, first[1:] + first[:1], strict=True)]
    guest_of = F.broadcast(spark.createDataFrame(guests, "range bigint, part bigint, g_id bigint, g_order bigint, g_range bigint, g_part bigint"))
    dealt = placed.join(guest_of, ["range", "part"])
    is_head = own_id.eqNullSafe(F.col("g_id")) & ((F.col("range") % 2 == 0) | (F.col("_order") == F.col("g_order")))
    home = F.struct("range", "part", F.lit(False).alias("is_guest"))
    away = F.struct(F.col("g_range").alias("range"), F.col("g_part").alias("part"), F.lit(True).alias("is_guest"))
    places = F.when(is_head, F.array(home, away)).otherwise(F.array(home))
    dealt = dealt.withColumn("place", F.explode(places)).select(*docs.columns, "_order", "place.range", "place.part", "place.is_guest")
    order = Window.partitionBy("range", "part").orderBy("is_guest", F.col("doc_id").desc(), F.col("_order").desc(), F.col("text").desc())
    return dealt.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in columns)).where("not is_guest").drop("range", "part", "is_guest", "_order")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and ``fingerprint`` of every whole text."""
    return with_fingerprint(texts(docs), "text", "fingerprint")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Every document with its next one and its edited text: its last half replaced by the next one's beginning."""
    paired = with_next(fingerprints(docs), "text", "fingerprint")
    n = F.length("text").cast("bigint")
    half = F.floor(n / 2)
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    none = F.struct(F.array().cast("array<bigint>").alias("sketch"), F.lit(None).cast("bigint").alias("least"))
    paired = paired.select("doc_id", n.alias("n_chars"), "fingerprint", edited.alias("edited"), F.coalesce("next_fingerprint", none).alias("next_fingerprint"))
    return with_fingerprint(paired, "edited", "edited_fingerprint")
