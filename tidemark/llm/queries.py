"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared.scratch import Scratch
from ..sources.adapters import table
from . import fingerprint, hard_negatives, license_scan, line_dedup, mixing, packing, quality_model, quality_rules, secrets, toxicity, warc, whitening
from .near_dup import NearDuplicates
from .oracle import ORACLE_SQL as ORACLE_SQL

#: The phrases of the contract of op6, with their labels.
LICENSE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels"), Scratch(spark, "toxicity")))


def op2_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return NearDuplicates(Scratch(spark, "near-dup"), width=2).groups(docs)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.evaluate(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_bits")


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), Scratch(spark, "mix"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), Scratch(spark, "pack"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"), Scratch(spark, "licenses"), phrases=LICENSE_PHRASES).drop("spans")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_model.score(docs, quality_model.train(docs, table(spark, sf_dir, "labels")))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(table(spark, sf_dir, "pages"), Scratch(spark, "warc"))
    return warc.read_archives(manifest, keep_html=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint.with_edits(table(spark, sf_dir, "documents"), Scratch(spark, "fingerprints"))
    own, edited, following = F.col("print"), F.col("edited_print"), F.col("next_print")
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint.as_text(own).alias("fingerprint"),
        fingerprint.as_text(edited).alias("edited_fingerprint"),
        fingerprint.resemblance(own, edited).alias("near_edited"),
        fingerprint.resemblance(own, following).alias("near_next"),
    )


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"), Scratch(spark, "secrets"))
    base = secrets.of_kind(F.col("spans"), "assign", "access", "hex")
    count = lambda kind: F.size(secrets.of_kind(F.col("spans"), kind)).cast("long").alias(f"n_{kind}")
    digest = F.sha2(secrets.listed(base).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), digest, secrets.listed(F.col("spans")).alias("spans"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings"), Scratch(spark, "whitening"))
    each = found.select("id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("place", "value"))
    component = (F.col("place") + 1).alias("component")
    return each.select(F.col("id").alias("vec_id"), component, "n", "deviation", F.col("value").alias("whitened"), F.get("explained", F.col("place")).alias("explained"), "identity_error")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return hard_negatives.mine(vectors, F.col("vec_id") % 50 == 0, Scratch(spark, "hard-negatives"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.drop_repeated(table(spark, sf_dir, "documents"), Scratch(spark, "line-dedup"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_toxicity, op2_minhash_near_dup, op3_quality_rules, op4_source_mix, op5_best_fit_packing, op6_license_scan, op7_quality_classifier, op8_warc, op9_fingerprints, op10_secret_scan, op11_whitening, op12_hard_negatives, op13_line_dedup)
}
