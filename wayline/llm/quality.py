"""Quality by nearest-neighbour voting in a latent semantic space.

Terms are shapes of words (runs of small and capital letters and of digits
shrunk to one sign, marks kept) and repetitions of a word within the last four.
A bounded sample of labelled documents, half of either label where there are
enough, gives the TF-IDF weights and, by a singular value decomposition, the
latent space; its vectors are broadcast. Every document is compared with all of
them by exact blocked cosine products, and the labels of the nearest vote by
similarity.

Nulls are empty texts. A text without words is as likely good as the sample.
Repeated rows stay repeated; other columns are ignored; an empty table gives an
empty result. Without any label the score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from wayline.llm.common import per_task, resident, slices, texts

#: Labelled documents of either label that the vectors are made from.
SAMPLE = 2048
#: Bytes of text whose characters are taken apart at a time.
SLICE = 1 << 20
TERMS, REPEATS, AXES, NEIGHBOURS, BLOCK = 2048, 4, 32, 25, 1024


def character_classes() -> np.ndarray:
    """0: white space, 1: small letter, 2: capital letter, 3: digit; others their own."""
    every = np.arange(0x110000, dtype=np.uint32)
    for i in range(0x3000):
        c = chr(i)
        if c.isspace():
            every[i] = 0
        elif c.isalpha():
            every[i] = 2 if c.isupper() else 1
        elif c.isdigit():
            every[i] = 3
    every[0x3000:0xA000] = 1
    every[0x3000] = 0
    return every


def term_counts(block: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, count) of a block, by text and term."""
    points = np.frombuffer("\n".join([*block, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = resident("classes", character_classes)[points]
    solid = kinds != 0
    before = np.concatenate(([False], solid[:-1]))
    starts = np.flatnonzero(solid & ~before)
    if not len(starts):
        none = np.array([], np.int64)
        return none, none, none
    at = np.flatnonzero(solid)
    first = np.searchsorted(at, starts)
    word = np.repeat(np.arange(len(starts)), np.diff(np.append(first, len(at))))
    kind = kinds[at]
    kept = np.concatenate(([True], (kind[1:] != kind[:-1]) | (word[1:] != word[:-1]) | (kind[1:] > 3)))
    with np.errstate(over="ignore"):
        content = mixed(points[at], word, first)
        shape_word = word[kept]
        shape_first = np.searchsorted(shape_word, np.arange(len(starts)))
        shape = mixed(kind[kept], shape_word, shape_first)
    ends = np.cumsum(np.array([len(x) + 1 for x in block]))
    text = np.searchsorted(ends, starts, side="right")
    keys = [text * (TERMS + REPEATS) + (shape % np.uint64(TERMS)).astype(np.int64)]
    for gap in range(1, REPEATS + 1):
        same = np.flatnonzero((content[gap:] == content[:-gap]) & (text[gap:] == text[:-gap])) + gap
        keys.append(text[same] * (TERMS + REPEATS) + TERMS + gap - 1)
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    return key // (TERMS + REPEATS), key % (TERMS + REPEATS), count


def mixed(values: np.ndarray, word: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each word's sequence of values."""
    place = (np.arange(len(values)) - first[word]).astype(np.uint64)
    x = (values.astype(np.uint64) + place * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return np.add.reduceat(x, first)


@dataclass
class Voters:
    idf: np.ndarray
    axes: np.ndarray  #: terms x axes
    vectors: np.ndarray  #: voters x axes, of length 1
    labels: np.ndarray

    @classmethod
    def fit(cls, samples: list[tuple[list[int], list[int]]], labels: list[int]) -> Voters:
        weights = np.zeros((len(samples), TERMS + REPEATS), np.float32)
        for i, (terms, counts) in enumerate(samples):
            weights[i, terms] = np.log1p(counts)
        idf = np.log((1 + len(samples)) / (1 + (weights > 0).sum(0))) + 0.1
        weights *= idf
        weights /= np.maximum(np.linalg.norm(weights, axis=1, keepdims=True), 1e-9)
        _, vectors = np.linalg.eigh((weights.T @ weights).astype(np.float64))
        axes = vectors[:, ::-1][:, :AXES].astype(np.float32)
        return cls(idf.astype(np.float32), axes, unit(weights @ axes), np.array(labels, np.float32))

    def scores(self, block: list[str]) -> np.ndarray:
        out = np.full(len(block), self.labels.mean() if len(self.labels) else 0.5)
        text, term, count = term_counts(block)
        if not len(text) or not len(self.labels):
            return out
        weight = np.log1p(count).astype(np.float32) * self.idf[term]
        first = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
        latent = unit(np.add.reduceat(weight[:, None] * self.axes[term], first, axis=0))
        k = min(NEIGHBOURS, len(self.labels))
        for i in range(0, len(first), BLOCK):
            near = latent[i : i + BLOCK] @ self.vectors.T
            best = nearest(near, k)
            vote = np.maximum(np.take_along_axis(near, best, axis=1), 0) ** 8 + 1e-9
            out[text[first[i : i + BLOCK]]] = (vote * self.labels[best]).sum(1) / vote.sum(1)
        return np.clip(out, 0, 1)


def nearest(near: np.ndarray, k: int) -> np.ndarray:
    """The places of the k greatest of each row; of equal ones the first, which are in order of label and terms."""
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    least = np.take_along_axis(near, best, axis=1).min(1, keepdims=True)
    for i in np.flatnonzero((near >= least).sum(1) > k):
        best[i] = np.argsort(-near[i], kind="stable")[:k]
    return best


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Voters:
    """labels: ``doc_id`` and the label, 0 or 1, of rows to learn from; at most ``sample`` of each are used, by a hash of the id."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("_label"))
    order = F.xxhash64("doc_id", F.lit("quality"))
    chosen = [r for y in (0, 1) for r in known.where(F.col("_label") == y).orderBy(order, "doc_id").limit(sample).collect()]
    spark = docs.sparkSession
    some = F.broadcast(spark.createDataFrame(chosen, known.schema))  # at most 2 x sample rows
    found = texts(docs).join(some, "doc_id").groupBy("doc_id", "_label").agg(F.min("text").alias("text"))  # of repeated ids the first text

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=SLICE):
                text, term, n = term_counts(part.column("text").to_pylist())
                cuts = np.searchsorted(text, np.arange(1, part.num_rows))
                columns = [pa.array([x.tolist() for x in np.split(v, cuts)], pa.list_(pa.int32())) for v in (term, n)]
                yield pa.RecordBatch.from_arrays([part.column("_label"), *columns], names=["label", "terms", "counts"])

    rows = found.mapInArrow(per_task(count), "label int, terms array<int>, counts array<int>").collect()  # at most 2 x sample
    rows.sort()
    return Voters.fit([(r["terms"], r["counts"]) for r in rows], [r["label"] for r in rows])


def score(docs: DataFrame, voters: Voters, keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """The columns in ``keep`` and ``name``, the likelihood of label 1, of every whole text."""
    base = docs.select(*keep, *(() if "text" in keep else ("text",)))
    shared = docs.sparkSession.sparkContext.broadcast(voters)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=SLICE):
                found = shared.value.scores([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(found, pa.float64())], names=[*keep, name])

    return base.mapInArrow(per_task(vote), StructType([*(docs.schema[c] for c in keep), StructField(name, DoubleType())]))
