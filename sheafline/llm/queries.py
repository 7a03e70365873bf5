"""One query for each operator, with production parameters over its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bottom_k,
    hash_forest,
    merkle_manifest,
    mixing,
    page_text,
    quality_classifier,
    quality_rules,
    sentencepiece_codec,
    sharding,
    simhash_dedup,
    suffix_dedup,
    token_counts,
    vector_codes,
)
from .common import table


def op1_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_forest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op2_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extracted(table(spark, sf_dir, "pages"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's ids, and whether they decode to its text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = sentencepiece_codec.encoded(docs, verify=True)
    return ids.select("doc_id", "n_tokens", "n_fallback", F.xxhash64("ids").alias("ids_hash"), "round_trip")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what is left without repeats of 400 bytes; `text` is without those of 51 words too."""
    left = suffix_dedup.without_repeats(table(spark, sf_dir, "documents"), ["doc_id"], words=51, apart="text")
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "text")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_tokens(table(spark, sf_dir, "documents"), rule="majority")


def domain_of(source: Column) -> Column:
    """The test tables name sources only: web, books or code by the source's number."""
    number = F.coalesce(F.regexp_extract(source, r"(\d+)$", 1).try_cast("int"), F.lit(0))
    return F.element_at(F.array(F.lit("web"), F.lit("books"), F.lit("code")), F.pmod(number, F.lit(3)) + 1)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    taken = mixing.mixed(docs, share=0.5, weights=mixing.WEIGHTS, max_epochs=2, domain=domain_of(F.col("source")))
    return taken.select("doc_id", "domain", "lang", "source", "n_tokens", "epoch")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"), n_shards=8)


def op11_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bottom_k.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, least=(85, 100))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.coded(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document by the CRC of its id is checked with a text whose A-Z are lower-cased."""
    altered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return merkle_manifest.manifest(table(spark, sf_dir, "documents"), altered=altered).drop("proof")


QUERIES = {
    f.__name__: f
    for f in (
        op1_hash_forest,
        op2_page_text,
        op3_quality_classifier,
        op4_simhash_dedup,
        op5_quality_rules,
        op6_sentencepiece,
        op7_suffix_dedup,
        op8_token_counts,
        op9_mixing,
        op10_sharding,
        op11_bottom_k,
        op12_vector_codes,
        op13_merkle_manifest,
    )
}
ORACLES: dict[str, str] = {
    "op5_quality_rules": quality_rules.SQL,
    "op11_bottom_k": bottom_k.SQL,
    "op12_vector_codes": vector_codes.SQL,
    "op13_merkle_manifest": merkle_manifest.SQL,
}
