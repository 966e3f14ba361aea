"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegauge.llm import (exact_dedup, hard_negatives, merkle, minhash, packing, pieces, pii, quality_model, quality_rules,
                           sharding, simhash, toxicity, warc)
from tidegauge.llm.common import id_crc32
from tidegauge.llm.sql import ORACLES as ORACLES
from tidegauge.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return fn(spark, lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        run.__name__ = name
        QUERIES[name] = run
        return fn

    return add


@query("op1_quality_rules")
def quality_rules_query(spark, table):
    """Counts, base verdict and line-first verdict of every document."""
    return quality_rules.line_quality(table("documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "lost_words")


@query("op5_pii")
def pii_query(spark, table):
    """Spans of personal data and of the terms that disclose them."""
    found = pii.sanitise(table("documents"))

    def count(rank: int):
        return F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long").alias(f"n_{pii.KINDS[rank]}")

    counts = [count(rank) for rank in range(4)]
    return found.select("doc_id", *counts, F.sha2(pii.span_text(F.col("base")).cast("binary"), 256)
                        .alias("base_sha256"), pii.span_text(F.col("spans")).alias("spans"))


@query("op6_exact_dedup")
def exact_dedup_query(spark, table):
    """The document that stays of each text, for every document."""
    return exact_dedup.mark_duplicates(table("documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op7_sharding")
def sharding_query(spark, table):
    """Shard and place of every document, sizes near equal."""
    return sharding.shard_records(table("documents"), shards=8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")


@query("op9_simhash")
def simhash_query(spark, table):
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(table("documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op2_quality_classifier")
def quality_classifier_query(spark, table):
    """Quality score of every document, learnt outside the held-out fold."""
    model = quality_model.learn(table("documents"), table("labels"))
    return quality_model.score_documents(table("documents").select("doc_id", "text"), model).select(
        "doc_id", "held_out", "score", "predicted")


@query("op8_toxicity")
def toxicity_query(spark, table):
    """Toxicity score of every document, learnt outside the held-out fold."""
    model = toxicity.learn(table("documents"), table("labels"))
    return toxicity.score_documents(table("documents").select("doc_id", "text"), model).select(
        "doc_id", "held_out", "score", "predicted")


@query("op10_packing")
def packing_query(spark, table):
    """Every piece of every document in a sequence of 4096 ids."""
    return packing.pack(table("documents"))


@query("op3_warc")
def warc_query(spark, table):
    """Pages written to ZIP-packaged archives and read back from them."""
    return warc.archived(table("pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op4_sentencepiece")
def sentencepiece_query(spark, table):
    """Ids, score and round trip of every document."""
    return pieces.encode_documents(table("documents"))


@query("op11_merkle_manifest")
def merkle_query(spark, table):
    """Leaf, roots and proof of every document, and whether a tampered third still verifies."""
    tampered = F.coalesce(F.pmod(id_crc32(F.col("doc_id")), F.lit(3)) == 0, F.lit(False))
    text = F.when(tampered, exact_dedup.folded(F.col("text"))).otherwise(F.col("text"))
    claimed = merkle.leaf_digest(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], text)
    found = merkle.verified_manifest(table("documents"), claimed)

    def digest(name):
        return F.lower(F.hex(name)).alias(name)

    return found.select(F.col("key").alias("doc_id"), digest("leaf"), digest("subroot"), digest("root"),
                        merkle.proof_digest(F.col("steps")).alias("proof_sha256"), digest("folded_root"), "verified")


@query("op13_minhash")
def minhash_query(spark, table):
    """Component of every document under a Jaccard similarity of 0.8 of word pairs."""
    return minhash.near_duplicates(table("documents"))


@query("op12_hard_negatives")
def hard_negatives_query(spark, table):
    """Negatives just below each positive of every hundredth vector."""
    rows = hard_negatives.whole_vectors(table("embeddings"))
    moved = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", moved), F.col("id") % 100 == 0)
