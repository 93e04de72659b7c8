"""Learned scores on held-out rows, and their edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from wayline.llm import quality, toxicity
from wayline.llm.common import crc_mod, read

SF = "/root/testdata/sf0.01"


def area(rows):
    """The share of (1, 0) pairs in order."""
    good = [s for y, s in rows if y == 1]
    bad = [s for y, s in rows if y == 0]
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))


def test_quality_of_held_out_rows(spark):
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    scored = quality.score(docs, quality.fit(docs, labels.where(crc_mod("doc_id", 5) != 0)))
    held = scored.join(labels, "doc_id").where(crc_mod("doc_id", 5) == 0).select("quality", "score").collect()
    assert area(held) > 0.95


def made_up(spark, n=400):
    rng = random.Random(2)
    usual = [f"word{i}" for i in range(300)]
    nasty = ["scumbag", "vermin", "filthy", "idiots"]
    rows = []
    for i in range(n):
        toxic = i % 5 == 0
        words = [rng.choice(usual) for _ in range(60)] + ([rng.choice(nasty) for _ in range(4)] if toxic else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(toxic)))
    return spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")


def test_toxicity_from_positives_and_unlabelled(spark):
    rows = made_up(spark)
    docs, labels = rows.select("doc_id", "text"), rows.select("doc_id", "toxic").where(F.col("doc_id") % 2 == 0)
    scored = toxicity.score(docs, toxicity.fit(docs, labels)).join(rows.select("doc_id", "toxic"), "doc_id").where(F.col("doc_id") % 2 == 1)
    assert area(scored.select("toxic", "score").collect()) > 0.98


def test_toxicity_on_the_sample(spark):
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    scored = toxicity.score(docs, toxicity.fit(docs, labels.where(crc_mod("doc_id", 4) != 2)))
    held = scored.join(labels, "doc_id").where(crc_mod("doc_id", 4) == 2).select("toxic", "score").collect()
    assert area(held) > 0.7


@pytest.mark.parametrize("fitted", [quality, toxicity])
def test_awkward_rows(spark, docs, rows, empty, fitted):
    label = fitted.__name__.rsplit(".", 1)[1].replace("toxicity", "toxic")
    labels = spark.createDataFrame([(i * 3 + 1, i % 2) for i in range(40)] + [(None, 1), (4, None), (1, 1)], f"doc_id bigint, {label} int")
    for known in (labels, labels.limit(0)):
        scored = fitted.score(docs, fitted.fit(docs, known)).collect()
        assert len(scored) == len(rows) and all(0 <= r.score <= 1 for r in scored)
    assert fitted.score(empty, fitted.fit(empty, labels)).count() == 0
