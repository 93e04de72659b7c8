"""Benchmark decontamination by latent semantic retrieval.

Documents become word numbers over the benchmark's vocabulary, written once to
the shared folder. Passages of fixed length give document frequencies and, in
one more pass, the sketch of a randomised singular value decomposition of the
TF-IDF matrix of all passages and of the benchmark's items, which weigh as much
as all documents together; its axes span the latent space. Overlapping windows,
about as long as an item, whose latent vector is near the item's are candidates, and for items that the
space hardly holds those that share a run of words. Long items are looked for
by their parts. The longest common subsequence of the whole item with the words
around decides, and below a clear match the item's answer, its last third, must
be there too. That is asked one candidate after the other; before, the words
that a candidate's surroundings share with its part are counted for all at once,
and candidates with too few are left out, which the decision would leave out too.

The benchmark is taken in groups of items of bounded size; each group is
collected and broadcast, and documents go by once for each. Null texts have no
words; items without words match nothing. Documents' repeated rows are joined
by ``doc_id``. An empty table on either side gives an empty result.
"""

from __future__ import annotations

import itertools
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.llm.common import per_task, shared_dir, slices, texts

#: Items of a group, and words of an item that retrieval looks at together.
GROUP_ITEMS, ITEM_WORDS = 2000, 64
PASSAGE, STRIDE = 48, 24
#: Words of a block; windows that are compared with an item begin at each block and have as many as are about its length.
BLOCK, NARROWEST, WIDEST, AT_ONCE = 12, 2, 4, 12 << 12
AXES, SPARE = 64, 8
#: Terms in more than this share of the passages carry no weight, unless an item would lose over half its words by it:
#: an item that many rows hold keeps all, with this least weight.
COMMON, FLOOR = 0.1, 0.1
#: Items' parts of which the latent space holds less than this length are also looked up by runs of their words.
WEAK, GRAM = 0.5, 5
#: Least cosine of candidates; a share of the item in order that is enough, one that is with some of its answer if it comes to
#: that many words, and the share of the answer that is enough where it doesn't; below a clear match also a share of the
#: item's weight by TF-IDF, so that words of every text don't make one.
NEAR, CLEAR, LIKELY, ANSWER, FEW, SURE, WEIGHT = 0.45, 0.8, 0.5, 0.4, 8, 0.9, 0.4

#: Candidates of which shared words are counted at a time; cells of the table of parts and words that this takes, and its least columns.
COUNTED, CELLS, COLUMNS = 1024, 1 << 22, 256
#: Passages of a step of the sketch, as a matrix of all their words.
SKETCHED = 64

WORD = re.compile(r"\w+")
#: Characters that end a word: those beyond ASCII, and a blank for each ASCII byte of the kind.
OTHER_ENDS = re.compile(r"[^\w\x00-\x7f]")
ASCII_ENDS = bytes(x if x > 127 or WORD.match(chr(x)) else 32 for x in range(256))


def word_numbers(text: str, number: dict[bytes, int]) -> np.ndarray:
    """The numbers of a text's words in lower case, -1 of one without; the same words as WORD's."""
    text = text.lower()
    if not text.isascii():
        text = OTHER_ENDS.sub(" ", text)
    words = text.encode().translate(ASCII_ENDS).split()
    return np.fromiter(map(number.get, words, itertools.repeat(-1)), np.int32, len(words))


def common_length(masks: dict[int, int], n: int, other: list[int]) -> int:
    """Length of the longest common subsequence. masks: the bits of each word's places among n words."""
    full = (1 << n) - 1
    row = full
    for word in other:
        match = row & masks.get(word, 0)
        row = ((row + match) | (row - match)) & full
    return n - row.bit_count()


def places(words: list[int]) -> dict[int, int]:
    masks: dict[int, int] = {}
    for i, w in enumerate(words):
        masks[w] = masks.get(w, 0) | 1 << i
    return masks


@dataclass
class Items:
    """Parts of the benchmark's items, as word numbers; retrieval looks for parts, and the whole item decides."""

    item: list[int]
    words: list[list[int]]
    number: dict[str, int]
    whole: list[list[int]]  #: the words of each item
    row: list[int]  #: of each part its item's place in ``whole``, and the number of that one's words before it
    before: list[int]

    @classmethod
    def of(cls, rows: list[tuple[int, str]]) -> Items:
        number: dict[str, int] = {}
        item, parts, whole, row, before = [], [], [], [], []
        for i, text in rows:
            words = [number.setdefault(w, len(number)) for w in WORD.findall((text or "").lower())]
            count = -(-len(words) // ITEM_WORDS)
            for k in range(count):  # parts of about the same length
                item.append(i)
                parts.append(words[k * len(words) // count : (k + 1) * len(words) // count])
                row.append(len(whole))
                before.append(k * len(words) // count)
            whole.append(words)
        return cls(item, parts, number, whole, row, before)


def passage_terms(ids: list[np.ndarray], n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(passage, term, count) over passages that don't overlap, and the number of passages."""
    sizes = np.array([len(x) for x in ids])
    if not sizes.sum():
        none = np.array([], np.int64)
        return none, none, none, 0
    per_doc = -(-sizes // PASSAGE)
    first = np.cumsum(per_doc) - per_doc
    starts = np.cumsum(sizes) - sizes
    place = np.arange(sizes.sum()) - np.repeat(starts, sizes)
    passage = np.repeat(first, sizes) + place // PASSAGE
    flat = np.concatenate(ids).astype(np.int64)
    known = flat >= 0
    key, count = np.unique(passage[known] * n_terms + flat[known], return_counts=True)
    return key // n_terms, key % n_terms, count, int(per_doc.sum())


def weighed(passage: np.ndarray, term: np.ndarray, count: np.ndarray, n: int, idf: np.ndarray) -> np.ndarray:
    weight = count * idf[term]
    norm = np.sqrt(np.bincount(passage, weight * weight, n))
    return weight / np.maximum(norm[passage], 1e-12)


def gram_times(passage: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, test: np.ndarray) -> np.ndarray:
    """Transpose of the passages' matrix times it times the test vectors. Passages come in order; a few at a time have few different terms."""
    out = np.zeros_like(test)
    some = weight != 0
    passage, term, weight = passage[some], term[some], weight[some]
    edges = np.searchsorted(passage, np.arange(0, n + SKETCHED, SKETCHED))
    for i, a, b in zip(range(0, n, SKETCHED), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        own, column = np.unique(term[a:b], return_inverse=True)
        matrix = np.zeros((min(SKETCHED, n - i), len(own)))
        matrix[passage[a:b] - i, column] = weight[a:b]
        out[own] += matrix.T @ (matrix @ test[own])
    return out


def run_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words."""
    out = np.zeros(max(0, len(ids) - n + 1), np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + len(out)].astype(np.uint64)
    return out


@dataclass
class LatentItems:
    items: Items
    idf: np.ndarray
    terms: np.ndarray  #: weighed axes of each term
    vectors: np.ndarray  #: of the items' parts, of length 1
    weak: list[int]  #: parts to look up by runs of words too

    def __post_init__(self) -> None:
        self.masks = [places(w) for w in self.items.whole]
        self.terms = np.vstack([self.terms, np.zeros((1, self.terms.shape[1]), np.float32)])  # a word that is in no item, of number -1, adds nothing
        widths = [min(WIDEST, max(NARROWEST, round(len(w) / BLOCK))) for w in self.items.words]
        self.scales = {}  # by blocks of a window: the parts of about that length, and their vectors
        for width in sorted(set(widths)):
            parts = [i for i, x in enumerate(widths) if x == width]
            self.scales[width] = parts, np.ascontiguousarray(self.vectors[parts].T)
        self.weights = [self.idf[w].tolist() for w in self.items.whole]
        self.answers = [w[-max(1, len(w) // 3) :] for w in self.items.whole]
        self.answer_masks = [places(w) for w in self.answers]
        self.runs: dict[int, dict[int, list[int]]] = {}  # by length and hash, the weak parts
        for part in self.weak:
            n = min(GRAM, len(self.items.words[part]))
            for h in set(run_hashes(np.array(self.items.words[part]), n).tolist()):
                self.runs.setdefault(n, {}).setdefault(h, []).append(part)
        self.run_keys = {n: np.array(sorted(x), np.uint64) for n, x in self.runs.items()}
        self.run_marks = {n: np.zeros(1 << 16, bool) for n in self.runs}  # of the first bits of hashes
        for n, keys in self.run_keys.items():
            self.run_marks[n][keys >> np.uint64(48)] = True
        sizes = np.array([len(w) for w in self.items.words], np.int64)
        self.margins, self.least = np.maximum(STRIDE, sizes // 2), LIKELY * sizes
        columns = min(len(self.idf), max(COLUMNS, CELLS // max(1, len(sizes))))
        self.times = np.zeros((len(sizes), columns), np.uint8)  # of words in parts, which hold ITEM_WORDS at most; where words share a column, of all
        np.add.at(self.times, (np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.array(w, np.int64) for w in self.items.words]) % columns), 1)

    def shared_runs(self, ids: np.ndarray) -> list[tuple[int, int, int]]:
        """First word, number of words and part of each run that a weak part holds too."""
        out = []
        for n, keys in self.run_keys.items():
            hashes = run_hashes(ids, n)
            hits = np.flatnonzero(self.run_marks[n][hashes >> np.uint64(48)])
            hits = hits[keys[np.minimum(np.searchsorted(keys, hashes[hits]), len(keys) - 1)] == hashes[hits]]
            out += [(at, n, part) for at in hits.tolist() for part in self.runs[n][int(hashes[at])]]
        return out

    def windows(self, ids: np.ndarray) -> np.ndarray:
        """Sums of the words' vectors up to each block, from none on. The words fill whole blocks."""
        blocks = self.terms[ids[::BLOCK]]
        for k in range(1, BLOCK):
            blocks += self.terms[ids[k::BLOCK]]
        sums = np.zeros((len(blocks) + 1, blocks.shape[1]))
        np.cumsum(blocks, axis=0, dtype=np.float64, out=sums[1:])
        return sums

    def found_in(self, docs: list[np.ndarray]) -> list[dict[int, tuple[float, float, float, int]]]:
        """Of each document the matching items: similarity, common share, answer's share, first word of the window."""
        out: list[dict[int, tuple[float, float, float, int]]] = [{} for _ in docs]
        batch: list[int] = []
        held = 0
        for i, ids in enumerate(docs):
            if (ids >= 0).any():
                batch.append(i)
                held += len(ids)
            if batch and (held >= AT_ONCE or i == len(docs) - 1):
                self.search([docs[k] for k in batch], [out[k] for k in batch])
                batch, held = [], 0
        return [{i: (near, share, answered, -start) for i, (share, answered, near, start) in x.items()} for x in out]

    def search(self, docs: list[np.ndarray], out: list[dict[int, tuple[float, float, float, int]]]) -> None:
        """The same of some documents, laid one after the other, each from a new block on."""
        sizes = np.array([len(x) for x in docs])
        n_blocks = -(-sizes // BLOCK)
        begin = np.cumsum(n_blocks) - n_blocks
        ids = np.full(n_blocks.sum() * BLOCK, -1, np.int32)
        ids[np.repeat(begin * BLOCK - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())] = np.concatenate(docs)
        sums, listed = self.windows(ids), ids.tolist()
        low, high = (begin * BLOCK).tolist(), (begin * BLOCK + sizes).tolist()
        known = np.flatnonzero(ids >= 0)
        rank = np.concatenate([[0], np.cumsum(ids >= 0)])  # of each place, the known words before it
        terms = ids[known]
        order = np.argsort(terms.astype(np.uint16) if len(self.idf) <= 1 << 16 else terms, kind="stable")
        again = np.full(len(known), -1)  # the same word's place before, among known words
        again[order[1:]] = np.where(terms[order[1:]] == terms[order[:-1]], order[:-1], -1)
        terms %= self.times.shape[1]
        edges = begin * BLOCK, begin * BLOCK + sizes
        tried: set[tuple[int, int, int]] = set()
        exact: dict[int, set[tuple[int, int]]] = {}  # of each part the documents and blocks that hold a run of it
        for at, n, part in self.shared_runs(ids):
            doc = int(np.searchsorted(begin, at // BLOCK, side="right")) - 1
            if at + n <= high[doc]:
                exact.setdefault(part, set()).add((doc, at // BLOCK))
        for width, (parts, vectors) in self.scales.items():
            parts_of = np.array(parts)
            n = np.maximum(1, n_blocks - width + 1)
            doc = np.repeat(np.arange(len(docs)), n)
            first = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n - begin, n)
            last = np.minimum(first + width, (begin + n_blocks)[doc])
            for i in range(0, len(doc), 4096):
                latent = (sums[last[i : i + 4096]] - sums[first[i : i + 4096]]).astype(np.float32)
                length = np.maximum(np.linalg.norm(latent, axis=1), 1e-9)
                product = latent @ vectors
                hits = np.flatnonzero(product >= NEAR * length[:, None])
                for h in range(0, len(hits), COUNTED):
                    row, k = np.divmod(hits[h : h + COUNTED], len(parts))
                    part, d, start = parts_of[k], doc[i + row], first[i + row] * BLOCK
                    a = rank[np.maximum(edges[0][d], start - self.margins[part])]
                    b = rank[np.minimum(edges[1][d], start + width * BLOCK + self.margins[part])]
                    enough = self.shared_words(terms, again, a, b, part) >= self.least[part]
                    row, k = row[enough], k[enough]
                    near = product[row, k] / length[row]
                    for e, x, j, y in zip(d[enough].tolist(), start[enough].tolist(), part[enough].tolist(), near.tolist(), strict=True):
                        self.check(listed, low[e], high[e], x, width * BLOCK, j, y, out[e], tried)
            for j, part in enumerate(parts):
                for d, b in exact.get(part, ()):
                    end = min(b + width, int(begin[d] + n_blocks[d]))
                    start = max(int(begin[d]), end - width)
                    own = sums[end] - sums[start]
                    self.check(listed, low[d], high[d], start * BLOCK, width * BLOCK, part, float(own @ vectors[:, j] / max(np.linalg.norm(own), 1e-9)), out[d], tried)

    def shared_words(self, terms: np.ndarray, again: np.ndarray, a: np.ndarray, b: np.ndarray, part: np.ndarray) -> np.ndarray:
        """How many words of each part are among the known words from a to b, or more where words share a column: each word counts where it first stands."""
        size = b - a
        begin = np.cumsum(size) - size
        at = np.arange(size.sum()) + np.repeat(a - begin, size)
        counts = self.times[np.repeat(part, size), terms[at]] * (again[at] < np.repeat(a, size))
        sums = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        return sums[begin + size] - sums[begin]

    def check(self, ids: list[int], low: int, high: int, start: int, size: int, part: int, near: float, out: dict[int, tuple[float, float, float, int]], tried: set[tuple[int, int, int]]) -> None:
        """Keeps the part's item in out if the document's words (low to high) around the window hold enough of it, and of its answer.

        Of an item of several parts the window's own must be there for the most; then the words where all of it would lie are looked at, once
        for windows that agree on the place but for a quarter of its length.
        """
        row, before = self.items.row[part], self.items.before[part]
        words, own = self.items.whole[row], self.items.words[part]
        if len(own) < len(words):
            margin = max(STRIDE, len(own) // 2)
            there = set(ids[max(low, start - margin) : min(high, start + size + margin)])
            place = (low, row, (start - before) // (len(words) // 4))
            if place in tried or sum(w in there for w in own) < LIKELY * len(own):
                return
            tried.add(place)
        margin = max(STRIDE, len(words) // 2)
        context = ids[max(low, start - before - margin) : min(high, start + size + len(words) - len(own) - before + margin)]
        there = set(context)
        held = [w in there for w in words]
        if sum(held) < LIKELY * len(words):  # no more of them can be in order
            return
        weights = self.weights[row]
        light = sum(x for x, y in zip(weights, held, strict=True) if y) < WEIGHT * sum(weights)
        if light and sum(held) < CLEAR * len(words):
            return
        share = common_length(self.masks[row], len(words), context) / len(words)
        if share < LIKELY or light and share < CLEAR:
            return
        answer = self.answers[row]
        answered = common_length(self.answer_masks[row], len(answer), context) / len(answer)
        if share >= CLEAR or answered >= (ANSWER if share * len(words) >= FEW else SURE):
            item = self.items.item[part]
            out[item] = max(out.get(item, (0.0, 0.0, 0.0, 0)), (share, answered, near, low - max(low, start - before)))


def read_ids(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.int32) for x in column.to_pylist()]


def find_group(docs: DataFrame, rows: list[tuple[int, str]], seed: int) -> DataFrame:
    spark = docs.sparkSession
    items = Items.of(rows)
    n_terms = len(items.number)
    base = texts(docs)
    kind = base.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id bigint, similarity double, common_share double, answer_share double, first_word bigint"
    if not n_terms:
        return spark.createDataFrame([], schema)
    shared_items = spark.sparkContext.broadcast(items)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w.encode(): i for w, i in shared_items.value.number.items()}
        for batch in batches:
            for part in slices(batch):
                ids = [word_numbers(t, number).tobytes() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    at = f"{shared_dir(spark)}/words-{uuid.uuid4().hex}"
    base.mapInArrow(per_task(numbered), f"doc_id {kind}, ids binary").write.parquet(at)
    words = spark.read.parquet(at)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, passages = np.zeros(n_terms, np.int64), 0
        for batch in batches:
            for part in slices(batch, "ids"):
                _, term, _, n = passage_terms(read_ids(part.column("ids")), n_terms)
                total += np.bincount(term, minlength=n_terms)
                passages += n
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, n_terms), pa.int64()), pa.array([passages, *total.tolist()], pa.int64())], names=["term", "n"])

    counts = dict(words.select("ids").mapInArrow(per_task(counted), "term bigint, n bigint").groupBy("term").agg(F.sum("n")).collect())
    n_passages = counts.get(-1, 0)
    if not n_passages:
        return spark.createDataFrame([], schema)
    df = np.array([counts[t] for t in range(n_terms)], np.float64)
    full = np.log((n_passages + 1) / (df + 1))
    common = df > COMMON * max(n_passages, 100)
    needed = sorted({w for x in items.words if common[x].mean() > 0.5 for w in x})
    idf = np.where(common, 0.0, full)
    idf[needed] = np.maximum(full[needed], FLOOR)
    test = np.random.default_rng(seed).standard_normal((n_terms, AXES + SPARE))
    shared = spark.sparkContext.broadcast((idf, test))

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_idf, own_test = shared.value
        total = np.zeros_like(own_test)
        for batch in batches:
            for part in slices(batch, "ids"):
                passage, term, count, n = passage_terms(read_ids(part.column("ids")), n_terms)
                if n:
                    total += gram_times(passage, term, weighed(passage, term, count, n, own_idf), n, own_test)
        flat = pa.FixedSizeListArray.from_arrays(pa.array(total.ravel()), total.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(range(n_terms), pa.int64()), flat.cast(pa.list_(pa.float64()))], names=["term", "row"])

    partial = words.select("ids").mapInArrow(per_task(sketched), "term bigint, row array<double>")
    rows_of = partial.groupBy("term").agg(*(F.sum(F.col("row")[j]).alias(f"c{j}") for j in range(AXES + SPARE))).collect()
    product = np.zeros_like(test)
    for r in rows_of:
        product[r[0]] = r[1:]
    own = [np.array(w) for w in items.words]
    sizes = [len(w) for w in own]
    key, count = np.unique(np.repeat(np.arange(len(own)), sizes) * n_terms + np.concatenate(own), return_counts=True)
    passage, term = key // n_terms, key % n_terms
    weight = weighed(passage, term, count, len(own), idf)
    product = product / n_passages + gram_times(passage, term, weight, len(own), test) / len(own)
    basis, _ = np.linalg.qr(product)
    core = basis.T @ product @ np.linalg.pinv(basis.T @ test)
    _, turn = np.linalg.eigh((core + core.T) / 2)
    axes = basis @ turn[:, ::-1][:, :AXES]
    vectors = np.zeros((len(own), axes.shape[1]))
    np.add.at(vectors, passage, weight[:, None] * axes[term])
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors /= np.maximum(length, 1e-9)
    weak = np.flatnonzero(length[:, 0] < WEAK).tolist()
    latent = spark.sparkContext.broadcast(LatentItems(items, idf, (idf[:, None] * axes).astype(np.float32), vectors.astype(np.float32), weak))

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = latent.value
        for batch in batches:
            for part in slices(batch, "ids"):
                which, out = [], []
                for i, found in enumerate(search.found_in(read_ids(part.column("ids")))):
                    for item, (near, share, answered, start) in found.items():
                        which.append(i)
                        out.append((item, near, share, answered, start))
                columns = [part.column("doc_id").take(pa.array(which, pa.int64()))]
                columns += [pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "similarity", "common_share", "answer_share", "first_word"])

    return words.mapInArrow(per_task(matched), schema)


def matches(docs: DataFrame, benchmark: DataFrame, seed: int = 7) -> DataFrame:
    """``doc_id``, ``item_id`` and the figures of the best window, of every document that holds an item."""
    found = None
    last = None
    while True:
        rest = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
        if last is not None:
            rest = rest.where((F.col("item_id") > last[0]) | (F.col("item_id") == last[0]) & (F.col("text") > last[1]))
        rows = [tuple(r) for r in rest.orderBy("item_id", "text").limit(GROUP_ITEMS).collect()]
        group = find_group(docs, rows, seed) if rows or found is None else None
        if group is not None:
            found = group if found is None else found.unionByName(group)
        if len(rows) < GROUP_ITEMS:
            return found
        last = rows[-1]


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, with all their columns; rows without a ``doc_id`` stay."""
    return docs.join(matches(docs, benchmark).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
