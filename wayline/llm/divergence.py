"""Source divergence audit: how the words of a language's sources differ, in exact whole numbers.

Terms are runs of ASCII letters and characters beyond ASCII, A-Z lower-cased.
Two passes over whole texts. The first adds the document frequencies of all
terms to count-min sketches, one a task; merged by saturating sums they never
underestimate, so that a term below the limit in the sketch is below it in
truth. The second counts the other terms' occurrences by language and source,
and drops the impossible ones inside the task, before anything is shuffled.
Survivors are counted exactly and the limit is applied to the true frequency:
the sketch only saves work. With more data than its cells can tell apart it
saves less; results stay the same.

Sources are compared by sparse joins. A term that neither of two sources has
adds the same to their distance each time, one that a single source has depends
on its count alone (a histogram of counts meets the other sources), and only
terms that both have are joined, on language and term.

Null texts, languages and sources are empty strings. Every row is a document,
repeated rows too. A language without kept terms has pairs of value 0. An empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayline.llm.common import per_task, slices, written

#: Least number of documents of a kept term, pseudo-count, and whole that shares are parts of.
LEAST_DOCS, PRIOR, WHOLE, TOP = 30, 5, 1_000_000_000, 50
#: Rows and cells of the sketch, cells of a block of it, and parts that tasks' blocks are first merged in.
DEPTH, WIDTH, BLOCK, PARTS = 3, 1 << 21, 1 << 16, 64
#: Terms that a task holds before it gives them out.
HELD = 500_000
CHUNK_BYTES = 4 << 20
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


@dataclass(frozen=True)
class Sketch:
    """Saturating document frequencies; ``cells`` is null where no document was read."""

    cells: np.ndarray | None
    least: int

    def possible(self, lang: bytes, terms: list[bytes]) -> np.ndarray:
        if self.cells is None:
            return np.zeros(len(terms), bool)
        found = np.full(len(terms), self.least, np.int64)
        for row, places in zip(self.cells, places_of(lang, terms, *self.cells.shape), strict=True):
            found = np.minimum(found, row[places])
        return found >= self.least


def places_of(lang: bytes, terms: list[bytes], depth: int, width: int) -> Iterator[np.ndarray]:
    """The cell of each term in each row of a sketch."""
    hashed = np.fromiter((xxhash.xxh64_intdigest(lang + b"\0" + t) for t in terms), np.uint64, len(terms))
    low, high = hashed & np.uint64(0xFFFFFFFF), hashed >> np.uint64(32) | np.uint64(1)
    return (((low + np.uint64(k) * high) % np.uint64(width)).astype(np.int64) for k in range(depth))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in runs, cut between terms, that take bounded memory."""
    start = 0
    while start < len(text):
        end = min(len(text), start + CHUNK_BYTES)
        part = text[start:end].translate(LETTERS)
        if end < len(text):
            cut = part.rfind(b" ")
            while cut < 1 and end < len(text):  # a term as long as this
                more = text[end : end + CHUNK_BYTES].translate(LETTERS)
                at = more.find(b" ")
                part, end = part + (more if at < 0 else more[:at]), end + (len(more) if at < 0 else at)
                if at >= 0:
                    break
            if cut > 0:
                part, end = part[:cut], start + cut
        yield part.split()
        start = end


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, bytes]]:
    for batch in batches:
        for part in slices(batch):
            yield from zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True)


def narrow(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def cells_for(least: int) -> type:
    """The type of a cell, which counts to ``least``."""
    return np.uint8 if least < 256 else np.uint32


def merged(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Saturating sums of blocks of equal number; rows are sorted by it. Holds one block."""
    kind = cells_for(most)
    own, total = None, None
    for batch in batches:
        for block, cells in zip(batch.column("block").to_pylist(), batch.column("cells").to_pylist(), strict=True):
            each = np.frombuffer(cells, kind).astype(np.int64)
            if block != own:
                if own is not None:
                    yield block_row(own, 0, total.astype(kind))
                own, total = block, each
            else:
                total = np.minimum(total + each, most)
    if own is not None:
        yield block_row(own, 0, total.astype(kind))


def block_row(block: int, part: int, cells: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"block": [block], "part": [part], "cells": [cells.tobytes()]}, schema=pa.schema([("block", pa.int32()), ("part", pa.int32()), ("cells", pa.binary())]))


def sketch(docs: DataFrame, least: int = LEAST_DOCS, depth: int = DEPTH, width: int = WIDTH) -> Sketch:
    """The merged sketch of all documents' terms by language; the driver gets its cells, depth x width of them at most."""
    blocks = -(-width // BLOCK)

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros((depth, blocks * BLOCK), cells_for(least))
        held: dict[str, Counter[bytes]] = {}

        def add() -> None:
            for lang, found in held.items():
                terms, counts = list(found), np.fromiter(found.values(), np.int64, len(found))
                for row, places in zip(cells, places_of(lang.encode(), terms, depth, width), strict=True):
                    at, which = np.unique(places, return_inverse=True)
                    row[at] = np.minimum(row[at] + np.bincount(which, counts).astype(np.int64), least)  # numbers of 64 bits until they are cut
            held.clear()

        size = 0
        for lang, _, text in rows_of(batches):
            own: set[bytes] = set()
            for terms in terms_of(text):
                own.update(terms)
            found = held.setdefault(lang, Counter())
            size -= len(found)
            found.update(own)
            size += len(found)
            if size > HELD:
                add()
                size = 0
        add()
        part = TaskContext.get().partitionId() % PARTS
        for k, row in enumerate(cells):
            for b, block in enumerate(row.reshape(blocks, BLOCK)):
                if block.any():
                    yield block_row(k * blocks + b, part, block)

    schema = "block int, part int, cells binary"
    add_up = per_task(lambda batches: merged(batches, least))
    once = narrow(docs).mapInArrow(per_task(tasks), schema).repartition("block", "part").sortWithinPartitions("block", "part").mapInArrow(add_up, schema)
    twice = once.repartition("block").sortWithinPartitions("block").mapInArrow(add_up, schema)
    found = twice.select("block", "cells").collect()  # depth x width cells
    if not found:
        return Sketch(None, least)
    cells = np.zeros((depth * blocks, BLOCK), cells_for(least))
    for r in found:
        cells[r.block] = np.frombuffer(r.cells, cells.dtype)
    return Sketch(cells.reshape(depth, blocks * BLOCK)[:, :width], least)


def counts(docs: DataFrame, limits: Sketch) -> DataFrame:
    """``lang``, ``source``, ``term``, ``n`` (occurrences) and ``n_docs`` of the terms that the sketch can't rule out."""
    shared = docs.sparkSession.sparkContext.broadcast(limits)
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("n_docs", pa.int64())])

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter[bytes], Counter[bytes]]] = {}

        def given() -> Iterator[pa.RecordBatch]:
            for (lang, source), (found, in_docs) in held.items():
                terms = list(found)
                for a in range(0, len(terms), 1 << 16):
                    some = terms[a : a + (1 << 16)]
                    kept = [t for t, possible in zip(some, shared.value.possible(lang.encode(), some), strict=True) if possible]
                    columns = [pa.array(x, f.type) for x, f in zip(([lang] * len(kept), [source] * len(kept), [t.decode() for t in kept], [found[t] for t in kept], [in_docs[t] for t in kept]), schema, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)
            held.clear()

        size = 0
        for lang, source, text in rows_of(batches):
            found, in_docs = held.setdefault((lang, source), (Counter(), Counter()))
            size -= len(found)
            own: set[bytes] = set()
            for terms in terms_of(text):
                found.update(terms)
                own.update(terms)
            in_docs.update(own)
            size += len(found)
            if size > HELD:
                yield from given()
                size = 0
        yield from given()

    each = narrow(docs).mapInArrow(per_task(tasks), "lang string, source string, term string, n bigint, n_docs bigint")
    # each task has a row for a term and source already, and what follows needs a term's sources together
    return each.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """A count's part of a whole, in ``WHOLE``ths, exactly; null if there are no terms."""
    wide = lambda c: c.cast("decimal(28,0)")
    return F.when(terms > 0, 1 + F.call_function("div", F.lit(WHOLE).cast("decimal(10,0)") * wide(n + PRIOR), wide(total) + PRIOR * wide(terms)))


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP, width: int = WIDTH) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``.

    Part ``pair``: each other source of the language by distance; part ``term``: the ``top`` terms that a source has more of
    than its language. From 1 for the largest value; equal values by item.
    """
    own = Window.partitionBy("lang", "term")
    every = counts(docs, sketch(docs, least, width=width)).withColumns({"lang_n": F.sum("n").over(own), "lang_docs": F.sum("n_docs").over(own)})
    kept, _ = written(every.where(F.col("lang_docs") >= least).select("lang", "source", "term", "n", "lang_n"))

    vocabulary = kept.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n")).groupBy("lang").agg(F.count("*").alias("n_terms"), F.sum("lang_n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("n_own"))
    groups = narrow(docs).select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(vocabulary, "lang", "left")
    groups, _ = written(groups.na.fill(0, ["total", "n_own", "n_terms", "lang_total"]).withColumn("none", share(F.lit(0), F.col("total"), F.col("n_terms"))))

    rows = kept.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("n_terms")))
    more = rows.withColumn("value", F.col("p") - share(F.col("lang_n"), F.col("lang_total"), F.col("n_terms"))).where("value > 0")
    place = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    terms = more.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value").withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)

    pairs = distances(rows, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(place))
    return pairs.unionByName(terms)


def distances(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``item`` (another source) and ``value``, the sum over all kept terms of how far their shares are apart.

    rows: lang, source, term, p, none of the terms that a source has; groups: lang, source, none, n_own, n_terms of all sources.
    """
    def pair(left: DataFrame, right: DataFrame, on: list[str], which: Column) -> DataFrame:
        return left.alias("a").join(right.alias("b"), on).where(which)

    source, item = F.col("a.source").alias("source"), F.col("b.source").alias("item")
    apart = lambda x, y: F.abs(F.col(x) - F.col(y))
    neither = (F.col("a.n_terms") - F.col("a.n_own") - F.col("b.n_own")) * apart("a.none", "b.none")
    base = pair(groups, groups, ["lang"], F.col("a.source") != F.col("b.source")).select("lang", source, item, F.coalesce(neither, F.lit(0)).alias("value"))

    levels = rows.groupBy("lang", "source", "p").agg(F.count("*").alias("n"))
    single = pair(levels, groups, ["lang"], F.col("a.source") != F.col("b.source")).groupBy("lang", source, item).agg(F.sum(F.col("n") * apart("p", "b.none")).alias("value"))

    some = rows.select("lang", "source", "term", "p", "none")
    extra = apart("a.p", "b.p") - apart("a.p", "b.none") - apart("b.p", "a.none") + apart("a.none", "b.none")
    both = pair(some, some, ["lang", "term"], F.col("a.source") < F.col("b.source")).groupBy("lang", source, item).agg(F.sum(extra).alias("value"))

    turned = [x.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value") for x in (single, both)]
    every = base.unionByName(single).unionByName(both).unionByName(turned[0]).unionByName(turned[1])
    return every.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
