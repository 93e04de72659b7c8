"""Near copies by SimHash, then by the Jaccard likeness of their word runs, which decides.

Texts of one set of runs collapse to a class first. Fingerprints of the runs give the first candidates, through the
Gray-order index of ``simhash``: pairs at most four bits apart, enough of them to connect all such. A likeness of 0.8 is
some ten bits of 64 apart, beyond any index of fingerprints, so min-hash bands complete the search: a class has BANDS keys,
each of ROWS min-hashes, and two classes of likeness 0.8 share one with 0.9998 probability. Classes that share a key are
compared by their sets in one task, all pairs but those already connected. Before the first EARLY bands, and again before
the others, groups that links already connect are left out, so that a class's set does not travel once for each of its keys. Groups
of more than CHUNK classes are dealt by the next band's key too, and where still that many agree on both, at random; then
what has not joined a group's main component meets every part of it, so no pair is left out. That grows with the square of
a large group only where its classes are not near copies.

Every link is checked by the sets of runs. Runs are told apart by 64-bit hashes for names, keys and fingerprints, and by
the upper half of these where sets are compared: that changes the likeness of two sets of n runs by n / 2^32 or so. Null
texts are empty; texts without words are one class. Rows without a ``doc_id`` are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.llm import simhash
from wayline.llm.common import checkpoint, per_task, slices, texts
from wayline.llm.components import components

WORDS, LEAST = 5, 0.8
BANDS, ROWS, EARLY, CHUNK = 12, 3, 2, 256
_DRAWN = np.random.default_rng(11).integers(0, 1 << 63, (2, BANDS * ROWS, 1), dtype=np.uint64)
FLIP, FACTOR = _DRAWN[0], _DRAWN[1] * np.uint64(2) + np.uint64(1)


def runs(text: str, words: int = WORDS) -> np.ndarray:
    """The set of the text's word runs, as sorted hashes."""
    return np.unique(np.array(simhash.shingle_hashes(text, words), np.uint64))


def half(own: np.ndarray) -> np.ndarray:
    """The upper halves of sorted hashes, still sorted."""
    return np.unique((own >> np.uint64(32)).astype(np.uint32))


def name_of(own: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes())).view(np.int64))


def band_keys(own: np.ndarray) -> list[int]:
    if not len(own):
        return []
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for i in range(0, len(own), 8192):
        least = np.minimum(least, ((own[i : i + 8192] ^ FLIP) * FACTOR).min(1))
    return [int(np.uint64(xxhash.xxh64_intdigest(least[b * ROWS : (b + 1) * ROWS].tobytes(), b)).view(np.int64)) for b in range(BANDS)]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / max(1, len(a) + len(b) - common)


def shared_keys(classes: DataFrame, chunk: int) -> DataFrame:
    """``name``, ``first_id``, ``band``, ``key``, ``following``, ``n``: all classes that share a key with n - 1 others; equal small groups are one."""
    rows = classes.select("name", "first_id", "bands", F.posexplode("bands").alias("band", "key")).select(
        "name", "first_id", "band", "key", F.get("bands", (F.col("band") + 1) % BANDS).alias("following")
    )
    groups = rows.groupBy("key").agg(F.min("band").alias("band"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("name")).alias("mark")).where("n > 1")
    own = F.when(F.col("n") > chunk, F.col("key"))
    groups = groups.groupBy("n", "mark", own.alias("own")).agg(F.min(F.struct("band", "key")).alias("x")).select("x.key", "n")
    return rows.join(groups, "key")


def neighbours(found: DataFrame) -> DataFrame:
    """``node``, ``component``: a label of each linked class, the least within two links; equal ones are connected, and most that are have equal ones."""
    both = found.unionByName(found.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = checkpoint(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))
    further = least.select(F.col("u").alias("m"), F.col("m").alias("m2"))
    return least.join(further, "m").select(F.col("u").alias("node"), F.col("m2").alias("component"))


def unsettled(shared: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of groups that hold classes of more than one label, with it as ``root``."""
    placed = shared.join(found.withColumnRenamed("node", "name"), "name", "left").withColumn("root", F.coalesce("component", "name")).drop("component")
    open_keys = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    return placed.join(open_keys, "key", "left_semi")


def dealt_first(shared: DataFrame, chunk: int) -> DataFrame:
    """``name``, ``root``, ``key``, ``part``, ``away`` of rows with a ``root``: small groups whole; large ones by the following key, or at random."""
    large = shared.where(F.col("n") > chunk).drop("n")
    again = large.groupBy("key", "following").agg(F.count("*").alias("n")).where("n > 1")
    part = F.pmod(F.xxhash64("name", "key"), F.ceil(F.col("n") / chunk))
    kept = ["name", "root", "key"]
    small = shared.where(F.col("n") <= chunk).select(*kept, F.lit(0).cast("bigint").alias("part"), F.lit(False).alias("away"))
    return small.unionByName(large.join(again, ["key", "following"]).select(*kept, F.xxhash64("following", part).alias("part"), F.lit(False).alias("away")))


def dealt_again(shared: DataFrame, found: DataFrame, chunk: int) -> DataFrame:
    """Of large groups: each class at home in a part, and those outside the group's main component away in all the others."""
    large = shared.where(F.col("n") > chunk).join(found.withColumnRenamed("node", "name"), "name", "left")
    large = large.select("name", "key", F.ceil(F.col("n") / chunk).alias("parts"), F.coalesce("component", "name").alias("root"))
    main = large.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("n")).where("n > 1")
    placed = large.join(main.drop("n"), "key").withColumn("home", F.pmod(F.xxhash64("name", "key"), "parts"))
    parts = F.when(F.col("root") == F.col("main"), F.array("home")).otherwise(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))
    return placed.select("name", "root", "key", "home", F.explode(parts).alias("part")).select("name", "root", "key", "part", (F.col("home") != F.col("part")).alias("away"))


def links(dealt: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """``u``, ``v``: like classes of a part, enough to connect all that are; of one root, or both away, none is compared."""
    placed = dealt.join(sets, "name").repartition("key", "part").sortWithinPartitions("key", "part", "away", "name")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, joined = None, [], {}

        def top(x: int) -> int:
            while x in joined:
                x = joined[x]
            return x

        for batch in batches:
            u, v = [], []
            for key, part, away, name, root, own in zip(*(batch.column(c).to_pylist() for c in ("key", "part", "away", "name", "root", "runs")), strict=True):
                if (key, part) != at:
                    at, held, joined = (key, part), [], {}
                mine, x = np.frombuffer(own, np.uint32), top(root)
                for other, other_root, theirs in held:
                    y = top(other_root)
                    if x != y and min(len(mine), len(theirs)) >= least * max(len(mine), len(theirs)) and likeness(mine, theirs) >= least:
                        u.append(name)
                        v.append(other)
                        joined[x] = x = y
                if not away:
                    held.append((name, root, mine))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return placed.mapInArrow(per_task(linked), "u bigint, v bigint")


def close_pairs(classes: DataFrame) -> DataFrame:
    """``name``, ``other``: pairs of classes whose fingerprints are equal or linked, enough of them to connect all that are."""
    prints = checkpoint(classes.groupBy("fingerprint").agg(F.min("name").alias("other")))
    equal = classes.join(prints, "fingerprint").where("name <> other").select("name", "other")
    linked = simhash.links(prints.select("fingerprint"))
    linked = linked.join(prints.select(F.col("fingerprint").alias("u"), F.col("other").alias("name")), "u").join(prints.withColumnRenamed("fingerprint", "v"), "v")
    return equal.unionByName(linked.select("name", "other"))


def checked(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """``u``, ``v``: the pairs whose sets are alike."""
    both = pairs.join(sets, "name").join(sets.select(F.col("name").alias("other"), F.col("runs").alias("other_runs")), "other")

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = (([np.frombuffer(x, np.uint32) for x in batch.column(c).to_pylist()]) for c in ("runs", "other_runs"))
            keep = pa.array([likeness(a, b) >= least for a, b in zip(*sides, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("name").filter(keep), batch.column("other").filter(keep)], names=["u", "v"])

    return both.mapInArrow(per_task(alike), "u bigint, v bigint")


def all_links(docs: DataFrame, classes: DataFrame, words: int, least: float, chunk: int) -> DataFrame:
    shared = checkpoint(shared_keys(classes, chunk))
    close = checkpoint(close_pairs(classes))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                sets = [runs(t, words) for t in piece.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(map(name_of, sets), pa.int64()), pa.array([half(x).tobytes() for x in sets], pa.binary())], names=["name", "runs"])

    named = close.select("name").unionByName(close.select(F.col("other").alias("name"))).distinct().join(classes, "name").select("first_id")
    wanted = docs.join(shared.select("first_id").unionByName(named).distinct().withColumnRenamed("first_id", "doc_id"), "doc_id", "left_semi")
    sets = checkpoint(wanted.select("text").mapInArrow(per_task(whole), "name bigint, runs binary").dropDuplicates(["name"]))
    found = checkpoint(checked(close, sets, least))
    for bands in (F.col("band") < EARLY, F.col("band") >= EARLY):
        rest = unsettled(shared.where(bands), neighbours(found))
        found = found.unionByName(checkpoint(links(dealt_first(rest, chunk), sets, least)))
    if shared.where(F.col("n") > chunk).isEmpty():
        return found
    whole_so_far = components(found)
    again = checkpoint(links(dealt_again(shared, whole_so_far, chunk), sets, least))
    return again.unionByName(whole_so_far.select(F.col("node").alias("u"), F.col("component").alias("v")))


def near_copies(docs: DataFrame, words: int = WORDS, least: float = LEAST, chunk: int = CHUNK) -> DataFrame:
    """``doc_id`` and ``component_id``, the smallest ``doc_id`` that checked links of likeness ``least`` lead to, of every row with an id."""
    base = texts(docs).where("doc_id is not null")
    kind = base.schema["doc_id"].dataType.simpleString()

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                hashes = [simhash.shingle_hashes(t, words) for t in piece.column("text").to_pylist()]
                prints = [simhash.fingerprint(x) for x in hashes]
                sets = [np.unique(np.array(x, np.uint64)) for x in hashes]
                columns = [piece.column("doc_id"), pa.array(map(name_of, sets), pa.int64()), pa.array(prints, pa.int64()), pa.array(map(band_keys, sets), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "name", "fingerprint", "bands"])

    every = checkpoint(base.mapInArrow(per_task(keyed), f"doc_id {kind}, name bigint, fingerprint bigint, bands array<bigint>"))
    first = every.groupBy("name").agg(F.min(F.struct("doc_id", "fingerprint", "bands")).alias("x"))
    classes = checkpoint(first.select("name", F.col("x.doc_id").alias("first_id"), "x.fingerprint", "x.bands"))
    found = components(all_links(base, classes, words, least, chunk))
    return every.select("doc_id", "name").join(simhash.least_ids(classes, found, "name"), "name").select("doc_id", "component_id")
