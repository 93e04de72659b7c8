"""Toxicity by non-negative positive-unlabelled learning.

The positives are texts confirmed as toxic, the unlabelled ones a sample of all
texts, whatever their labels. A linear model over words and their beginnings is
trained in numpy on the class-prior-corrected risk: prior x risk of positives as
toxic, plus what is left of the unlabelled risk as clean after prior x the
positives' risk as clean is taken away. Where that rest turns negative, the
step goes against it, which keeps the model from overfitting.

Both samples are bounded by parameters; the prior is the share of toxic ones
among the labels to learn from. Every whole text is scored. Nulls and texts
without words get the score of the bias alone. Repeated rows stay repeated;
other columns are ignored; an empty table gives an empty result. Without
positives every score is 0.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.llm.common import per_task, slices, texts

POSITIVES, UNLABELLED = 3000, 9000
DIMENSIONS, BEGINNINGS = 1 << 20, (4, 5, 6)
#: Features of fewer positives than this, or not so many times as common in them, are left out.
LEAST, LIFT = 4, 2
STEPS, RATE, DECAY, CACHE = 250, 0.05, 2e-4, 400_000

WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def features(word: str) -> list[int]:
    """The word itself, and its beginnings."""
    parts = [f"={word}", *(f"{word[:n]}" for n in BEGINNINGS if len(word) >= n)]
    return [zlib.crc32(p.encode()) % DIMENSIONS for p in parts]


@dataclass
class ToxicModel:
    weights: dict[int, float]
    bias: float
    cache: dict[str, float] = field(default_factory=dict, repr=False)

    def word_weight(self, word: str) -> float:
        x = self.cache.get(word)
        if x is None:
            if len(self.cache) > CACHE:
                self.cache.clear()
            x = self.cache[word] = sum(self.weights.get(f, 0.0) for f in features(word))
        return x

    def score(self, text: str) -> float:
        z = self.bias + sum(sorted(map(self.word_weight, words(text))))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


@dataclass
class Lists:
    """The features of some texts, one entry per distinct word that has it."""

    flat: np.ndarray
    sizes: np.ndarray

    def document_counts(self) -> np.ndarray:
        """The number of texts that have each feature."""
        total = np.zeros(DIMENSIONS, np.int64)
        ends = np.cumsum(self.sizes)
        for end, size in zip(ends.tolist(), self.sizes.tolist(), strict=True):
            total[np.unique(self.flat[end - size : end])] += 1
        return total

    def rows(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text and place of the features that have one."""
        at = np.flatnonzero(place[self.flat] >= 0)
        return np.searchsorted(np.cumsum(self.sizes), at, side="right"), place[self.flat[at]]


def train(positive: Lists, unlabelled: Lists, prior: float) -> ToxicModel:
    n_p, n_u = len(positive.sizes), max(1, len(unlabelled.sizes))
    if not n_p:
        return ToxicModel({}, -30.0)
    seen_p, seen_u = positive.document_counts(), unlabelled.document_counts()
    used = np.flatnonzero((seen_p >= LEAST) & (seen_p / n_p > LIFT * seen_u / n_u))
    place = np.full(DIMENSIONS, -1)
    place[used] = np.arange(len(used))
    (rp, fp), (ru, fu) = positive.rows(place), unlabelled.rows(place)
    d = len(used)
    w, bias = np.zeros(d), float(np.log(prior / (1 - prior)))
    m1, m2 = np.zeros(d + 1), np.zeros(d + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, STEPS + 1):
        zp = np.bincount(rp, w[fp], n_p) + bias
        zu = np.bincount(ru, w[fu], len(unlabelled.sizes)) + bias
        as_clean = lambda z: np.logaddexp(0, z)
        rest = as_clean(zu).mean() - prior * as_clean(zp).mean() if len(zu) else 0.0
        clean_p, clean_u = -prior * sigmoid(zp) / n_p, sigmoid(zu) / n_u
        if rest >= 0:
            gp, gu = -prior * sigmoid(-zp) / n_p + clean_p, clean_u
        else:
            gp, gu = -clean_p, -clean_u
        g = np.append(np.bincount(fp, gp[rp], d) + np.bincount(fu, gu[ru], d) + DECAY, gp.sum() + gu.sum())
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        move = RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        w, bias = np.maximum(w - move[:-1], 0), bias - move[-1]  # a word can't make a text clean
    return ToxicModel({int(f): float(x) for f, x in zip(used, w, strict=True) if abs(x) > 1e-3}, float(bias))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> ToxicModel:
    """labels: ``doc_id`` and the label, 0 or 1, of rows to learn from. Samples are taken by a hash of the id."""
    spark = docs.sparkSession
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("_label"))
    order = F.xxhash64("doc_id", F.lit("toxicity"))
    prior = known.agg(F.avg("_label")).first()[0]
    if not prior:
        return ToxicModel({}, -30.0)
    toxic = known.where("_label = 1").orderBy(order, "doc_id").limit(positives).select("doc_id", F.lit(1).alias("_label"))
    other = docs.where("doc_id is not null").select("doc_id").distinct().orderBy(order, "doc_id").limit(unlabelled).select("doc_id", F.lit(0).alias("_label"))
    chosen = [tuple(r) for r in toxic.unionByName(other).collect()]
    some = F.broadcast(spark.createDataFrame(chosen, toxic.schema))  # at most positives + unlabelled rows
    found = texts(docs).join(some, "doc_id").groupBy("doc_id", "_label").agg(F.min("text").alias("text")).withColumn("key", F.xxhash64("doc_id"))  # of repeated ids the first text

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = [sorted(f for w in words(t) for f in features(w)) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("_label"), part.column("key"), pa.array(rows, pa.list_(pa.int32()))], names=["label", "key", "features"])

    table = found.mapInArrow(per_task(extract), "label int, key bigint, features array<int>").toArrow().sort_by("key")  # at most positives + unlabelled rows
    label, features_of = table["label"].combine_chunks().to_numpy(), table["features"].combine_chunks()

    def of(y: int) -> Lists:
        lists = features_of.take(pa.array(np.flatnonzero(label == y)))
        return Lists(lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy()))

    return train(of(1), of(0), min(max(prior, 1e-3), 0.999))


def score(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """``doc_id`` and ``score``, the likelihood of label 1, of every whole text."""
    base = texts(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in slices(batch):
                found = [own.score(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.float64())], names=["doc_id", "score"])

    return base.mapInArrow(per_task(scored), f"doc_id {base.schema['doc_id'].dataType.simpleString()}, score double")
