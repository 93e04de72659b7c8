"""SimHash near-duplicates through a Gray-order hierarchical index.

Exact copies collapse to one fingerprint first. Two fingerprints of at most
four differing bits agree on two of six blocks, so each is dealt to the tables
of the fifteen block pairs; a table's key is the pattern that its whole group
shares. A group that is too large for a task is dealt again by pairs of blocks
of its other bits. In a group, fingerprints sorted by Gray rank are packed into pages, and
pages into upper nodes; a node holds the masked bits that all below it share.
Pairs of nodes go down from the top, adding up differences on newly shared
bits, and whole groups are pruned beyond the limit. Of the links that are found
a group returns a spanning forest only, and pages that are already connected
are not compared again, so a dense group costs no square of its size in rows.
Components are joined up by Spark.

Null texts are empty; a text without words has fingerprint zero, linked like
any other. Rows without an id take part; the component of such rows alone is
null. Repeated rows stay repeated; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.llm.common import checkpoint, per_task, slices, texts
from wayline.llm.components import components

SEED, WORDS, LIMIT = 42, 4, 4
PAGE, FAN = 32, 16
#: Fingerprints of a group that one task takes; a larger group is dealt anew by more bits, and after three times has at
#: most 20 bits left to differ.
HOT, LEVELS = 1 << 16, 3


def shingle_hashes(text: str, words: int = WORDS) -> list[int]:
    """XXH64 of each run of words, ASCII lower-cased and space-joined; of all words if there are fewer."""
    found = text.encode().lower().split()
    if not found:
        return []
    line = b" ".join(found)
    ends, at = [], -1
    for w in found:
        at += len(w) + 1
        ends.append(at)
    begins = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], SEED) for a, b in zip(begins, ends[words - 1 :], strict=False)] or [digest(line, SEED)]


def fingerprint(hashes: list[int]) -> int:
    """Bits set in over half the hashes."""
    counts = np.zeros(64, np.int64)
    every = np.array(hashes, np.uint64)
    for i in range(0, len(every), 8192):
        counts += np.unpackbits(every[i : i + 8192].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(every), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id`` and ``fingerprint`` (64 bits in a bigint) of every whole text."""
    base = texts(docs)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [fingerprint(shingle_hashes(t, words)) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.int64())], names=["doc_id", "fingerprint"])

    return base.mapInArrow(per_task(hashed), f"doc_id {base.schema['doc_id'].dataType.simpleString()}, fingerprint bigint")


def pair_masks(fixed: int = 0) -> list[int]:
    """The bits left beside the fixed ones, cut into six blocks: the fixed bits with each pair of blocks."""
    left = [i for i in range(64) if not fixed >> i & 1]
    cuts = [round(len(left) * k / 6) for k in range(7)]
    blocks = [sum(1 << i for i in left[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [fixed | a | b for a, b in combinations(blocks, 2)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def deeper(level: int) -> dict[int, list[int]]:
    """Of each mask of a level the masks below it."""
    masks = [0]
    for _ in range(level):
        masks = [m for x in masks for m in pair_masks(x)]
    return {x: pair_masks(x) for x in masks}


def gray_rank(fp: Column) -> Column:
    """The place of the fingerprint in Gray order: the exclusive or of all its right shifts."""
    for n in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, n))
    return fp


class Level:
    """Nodes over consecutive rows or nodes: the first pattern below each, and the bits that all below share."""

    def __init__(self, keys: np.ndarray, patterns: np.ndarray, masks: np.ndarray, most: int):
        new = np.concatenate(([True], keys[1:] != keys[:-1]))
        at = np.arange(len(keys))
        place = at - np.maximum.accumulate(np.where(new, at, 0))
        self.first = np.flatnonzero(place % most == 0)
        self.size = np.diff(np.append(self.first, len(keys)))
        self.keys, self.patterns = keys[self.first], patterns[self.first]
        differ = np.bitwise_or.reduceat(patterns ^ np.repeat(self.patterns, self.size), self.first)
        self.masks = ~differ & np.bitwise_and.reduceat(masks, self.first)


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least row of each row's component, after linking rows a and b."""
    while len(a):
        x, y = label[a], label[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        apart = low != high
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        np.minimum.at(label, high[apart], low[apart])
        while True:
            shorter = label[label]
            if (shorter == label).all():
                break
            label = shorter
    return label


def group_links(keys: np.ndarray, fps: np.ndarray, limit: int = LIMIT, pairs_at_once: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside groups of equal keys. Rows come by key, then Gray rank."""
    n = len(fps)
    none = np.array([], np.int64)
    if n < 2:
        return none, none
    label = np.arange(n)
    pages = Level(keys, fps, np.full(n, ~np.uint64(0)), PAGE)
    page_of = np.repeat(np.arange(len(pages.first)), pages.size)
    for gap in range(1, int(pages.size.max())):  # inside pages
        near = np.flatnonzero(page_of[gap:] == page_of[:-gap])
        near = near[np.bitwise_count(fps[near] ^ fps[near + gap]) <= limit]
        label = merge(label, near, near + gap)
    levels = [pages]
    while len(levels[-1].first) > 1 and (levels[-1].keys[1:] == levels[-1].keys[:-1]).any():
        x = levels[-1]
        levels.append(Level(x.keys, x.patterns, x.masks, FAN))
    top = len(levels) - 1
    roots = np.flatnonzero(np.ones(len(levels[top].first), bool) if top else pages.size < 0)
    todo = [(top, roots[i : i + pairs_at_once], roots[i : i + pairs_at_once], None, None) for i in range(0, len(roots), pairs_at_once)]
    while todo:
        depth, a, b, differences, shared = todo.pop()
        level = levels[depth]
        common = level.masks[a] & level.masks[b]
        fresh = common if shared is None else common & ~shared
        total = np.bitwise_count((level.patterns[a] ^ level.patterns[b]) & fresh).astype(np.int64) + (0 if differences is None else differences)
        keep = total <= limit
        a, b, total, common = a[keep], b[keep], total[keep], common[keep]
        if not depth:
            apart = a != b
            label = page_links(pages, fps, label, a[apart], b[apart], limit)
            continue
        i, j, parent = children(level, a, b)
        for k in range(0, len(i), pairs_at_once):
            cut = slice(k, k + pairs_at_once)
            todo.append((depth - 1, i[cut], j[cut], total[parent[cut]], common[parent[cut]]))
    linked = np.flatnonzero(label != np.arange(n))
    return linked, label[linked]


def children(level: Level, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of nodes below each pair of nodes, and that pair's number; a node with itself gives each pair once."""
    number = level.size[a] * level.size[b]
    parent = np.repeat(np.arange(len(a)), number)
    place = np.arange(len(parent)) - np.repeat(np.cumsum(number) - number, number)
    wide = level.size[b][parent]
    i, j = level.first[a][parent] + place // wide, level.first[b][parent] + place % wide
    once = i <= j
    return i[once], j[once], parent[once]


def page_links(pages: Level, fps: np.ndarray, label: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int, at_once: int = 512) -> np.ndarray:
    """Links between rows of two pages, unless all these are connected already."""
    for k in range(0, len(a), at_once):
        low, high = np.minimum.reduceat(label, pages.first), np.maximum.reduceat(label, pages.first)
        x, y = a[k : k + at_once], b[k : k + at_once]
        todo = ~((low[x] == high[x]) & (low[y] == high[y]) & (low[x] == low[y]))
        x, y = x[todo], y[todo]
        if not len(x):
            continue
        step = np.arange(PAGE)
        left, right = pages.first[x][:, None] + step, pages.first[y][:, None] + step
        real = (step < pages.size[x][:, None])[:, :, None] & (step < pages.size[y][:, None])[:, None, :]
        last = len(fps) - 1
        differ = np.bitwise_count(fps[np.minimum(left, last)][:, :, None] ^ fps[np.minimum(right, last)][:, None, :])
        pair, i, j = np.nonzero(real & (differ <= limit))
        label = merge(label, left[pair, i], right[pair, j])
    return label


def dealt_links(dealt: DataFrame, hot: int) -> DataFrame:
    """Links inside groups of equal ``key``: u, v, mask 0; and the rows of larger groups than ``hot``: fingerprint as u, their mask.

    dealt: key, fingerprint, mask, by key and Gray rank. No more than ``hot`` rows and a batch are held.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # key, fingerprint, mask
        large = None  # the key of the group that is being passed on

        def out(u: np.ndarray, v: np.ndarray, mask: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64)), pa.array(mask)], names=["u", "v", "mask"])

        def linked(rows: list[np.ndarray]) -> pa.RecordBatch:
            a, b = group_links(rows[0], rows[1])
            return out(rows[1][a], rows[1][b], np.zeros(len(a), np.int64))

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([batch.column("key").to_numpy(), batch.column("fingerprint").to_numpy().view(np.uint64), batch.column("mask").to_numpy()])
            rows = [np.concatenate(x) for x in zip(*held, strict=True)]
            keys = rows[0]
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            size = np.diff(np.append(first, len(keys)))
            done = np.ones(len(first), bool)
            done[-1] = False  # the last group may go on
            passed = (size > hot) | (keys[first] == large) if large is not None else size > hot
            send = np.repeat(passed, size)
            take = np.repeat(done & ~passed, size)
            if send.any():
                yield out(rows[1][send], rows[1][send], rows[2][send])
            if take.any():
                yield linked([x[take] for x in rows])
            large = keys[-1] if passed[-1] else None
            held = [] if passed[-1] else [[x[first[-1] :] for x in rows]]
        if held:
            yield linked(held[0])

    return dealt.mapInArrow(per_task(find), "u bigint, v bigint, mask bigint")


def links(classes: DataFrame, hot: int = HOT) -> DataFrame:
    """``u``, ``v``: linked fingerprints, enough of them to connect all that are linked. classes: distinct ``fingerprint``.

    Two fingerprints that differ in four bits agree on two of six blocks, and then on two of six of what is left: each
    level is exact, and only groups that are too large for a task go to the next.
    """
    spark = classes.sparkSession
    fp = F.col("fingerprint")
    rows, found = classes.select(fp, F.explode(F.array(*(F.lit(signed(m)) for m in pair_masks()))).alias("mask")), None
    for level in range(1, LEVELS + 1):
        dealt = rows.select(F.xxhash64("mask", fp.bitwiseAND(F.col("mask"))).alias("key"), gray_rank(fp).alias("rank"), fp, "mask")
        dealt = dealt.repartition("key").sortWithinPartitions("key", "rank").select("key", "fingerprint", "mask")
        out = checkpoint(dealt_links(dealt, hot if level < LEVELS else 1 << 62))
        own = out.where("mask = 0").select("u", "v")
        found = own if found is None else found.unionByName(own)
        large = out.where("mask <> 0").select(F.col("u").alias("fingerprint"), F.col("mask").alias("was"))
        if level == LEVELS or large.isEmpty():
            return found
        below = spark.createDataFrame([(signed(m), signed(x)) for m, xs in deeper(level).items() for x in xs], "was bigint, mask bigint")
        rows = large.join(F.broadcast(below), "was").select("fingerprint", "mask")  # 225 or 3,375 masks
    return found


def least_ids(classes: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """``name`` and ``component_id`` of every class. classes: ``name``, ``first_id``; found: ``node``, ``component``.

    The least id of a component is summed up first and cut, so that Spark may split the join of a component with many classes.
    """
    roots = classes.join(found.withColumnRenamed("node", name), name, "left").select(name, "first_id", F.coalesce("component", name).alias("root"))
    least = checkpoint(roots.groupBy("root").agg(F.min("first_id").alias("component_id")))
    return roots.join(least, "root").select(name, "component_id")


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id``, ``fingerprint`` and ``component_id``, the smallest ``doc_id`` that links lead to, of every row."""
    every = checkpoint(fingerprints(docs, words))
    classes = checkpoint(every.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")))
    found = components(links(classes.select("fingerprint")))
    return every.join(least_ids(classes, found, "fingerprint"), "fingerprint").select("doc_id", "fingerprint", "component_id")
