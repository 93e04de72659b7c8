"""The corpus pipeline: quality, near-duplicates, decontamination, secrets, token ids.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir), and
its result is written as Parquet and read again as the next one's docs. All but
the last return the columns of ``documents``. The stages are written in Python
and numpy, so there is no SQL for the whole; tests hold each against brute force.

Null texts count as empty and stay null; rows without an id are never dropped as
copies or as benchmark items. An empty table goes through as one. Further
columns are carried along up to the last stage, whatever their names.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm import bpe, decontaminate, likeness, quality, secrets
from wayline.llm.common import crc_mod, read, shared_dir

LEAST_QUALITY = 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality vote rejects; null and empty texts get the share of good labels as their score."""
    labels = read(spark, sf_dir, "labels").where(crc_mod("doc_id", 5) != 0)
    name = next(n for n in ("_quality", *(f"_quality{i}" for i in range(len(docs.columns)))) if n not in docs.columns)
    scored = quality.score(docs, quality.fit(docs, labels), keep=tuple(docs.columns), name=name)
    return scored.where(F.col(name) >= LEAST_QUALITY).select(*docs.columns)


def keep_first_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of near copies, and rows without an id.

    Candidates come from op6's index over SimHash fingerprints of five-word runs, and from min-hash bands, as 64 bits can't
    tell a likeness of 0.8 from a lesser one; a Jaccard likeness of 0.8 of the sets of runs decides. Rows of one id are
    one document; of equal texts among them the first row by the other columns stays.
    """
    later = likeness.near_copies(docs).where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.where("doc_id is not null").join(later, "doc_id", "left_anti").select(*docs.columns)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    if others:
        first = kept.groupBy("doc_id", "text").agg(F.min(F.struct(*others)).alias("_first"))
        kept = first.select("doc_id", "text", *(F.col("_first")[c].alias(c) for c in others)).select(*docs.columns)
    else:
        kept = kept.distinct()
    return kept.unionByName(docs.where("doc_id is null"))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold an item of the benchmark."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents, their secrets replaced by a mask."""
    return secrets.redact(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its very text."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    done = bpe.decode(bpe.encode(docs, path), path)
    return done.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", keep_first_of_copies),
    ("benchmark decontamination", drop_benchmark),
    ("secret scans", mask_secrets),
    ("BPE encoding", token_ids),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what is between them lies in the shared folder."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
