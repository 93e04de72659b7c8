"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm import bpe, chat, decontaminate, divergence, quality, rendezvous, secrets, shards, simhash, sketch, sql, structure, tokencount, toxicity
from wayline.llm.common import crc_mod, read, shared_dir


def op1_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    done = bpe.decode(bpe.encode(read(spark, sf_dir, "documents"), path), path)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op3_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sketch.edited_fingerprints(read(spark, sf_dir, "documents"))
    own, edited, following = F.col("fingerprint"), F.col("edited_fingerprint"), F.col("next_fingerprint")
    return found.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        sketch.written(own).alias("fingerprint"), sketch.written(edited).alias("edited_fingerprint"),
        sketch.likeness(own, edited).alias("near_edited"), sketch.likeness(own, following).alias("near_next"),
    )


def op4_token_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokencount.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op5_toxicity_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(crc_mod("doc_id", 4) != 2))
    return judged(toxicity.score(docs, model), crc_mod("doc_id", 4) == 2)


def op7_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    voters = quality.fit(docs, labels.where(crc_mod("doc_id", 5) != 0))
    return judged(quality.score(docs, voters), crc_mod("doc_id", 5) == 0)


def judged(scored: DataFrame, held_out: Column) -> DataFrame:
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_simhash_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op8_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.materialise(read(spark, sf_dir, "documents"), f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}", key=2024, stable=True)


def op9_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repaired(read(spark, sf_dir, "conversations"))


def op10_secret_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read(spark, sf_dir, "documents"))
    base = [r.kind for r in secrets.BASE]

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select(
        "doc_id", *map(count, base),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(base))).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def op11_sketch_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


def op12_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = rendezvous.placed(read(spark, sf_dir, "documents"), [1.0] * SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read(spark, sf_dir, "conversations")
    return structure.digests(structure.repaired(structure.damaged(conversations)), conversations)


SHARDS = 40

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_latent_decontamination": op1_latent_decontamination,
    "op2_bpe_tree": op2_bpe_tree,
    "op3_scaled_sketch": op3_scaled_sketch,
    "op4_token_transducer": op4_token_transducer,
    "op5_toxicity_nnpu": op5_toxicity_nnpu,
    "op6_simhash_gray": op6_simhash_gray,
    "op7_quality_neighbours": op7_quality_neighbours,
    "op8_training_order": op8_training_order,
    "op9_role_repair": op9_role_repair,
    "op10_secret_trigrams": op10_secret_trigrams,
    "op11_sketch_divergence": op11_sketch_divergence,
    "op12_rendezvous_shards": op12_rendezvous_shards,
    "op13_structure_repair": op13_structure_repair,
}

ORACLES: dict[str, str] = {
    "op11_sketch_divergence": sql.OP11.format(least=divergence.LEAST_DOCS, top=divergence.TOP),
    "op12_rendezvous_shards": sql.op12(SHARDS, rendezvous.BUCKETS, rendezvous.OVERHEAD),
    "op13_structure_repair": sql.OP13,
}
