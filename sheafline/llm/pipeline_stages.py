"""The stages of corpus_pipeline.py. Each takes (spark, docs, sf_dir); all but the last return the columns of docs.

What holds for every stage: null, empty and blank texts, very long texts, repeated rows, null ids, empty tables and columns
of other names are defined as in the module that the stage calls; no stage changes or reads a column it does not name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bottom_k, mixing, quality_classifier, sentencepiece_codec, suffix_dedup
from .common import bounded_batches, table
from .queries import domain_of


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labels of sf_dir, does not reject.

    Texts without words are scored like any other; repeated rows are judged alike; without labels nothing is rejected.
    """
    bounded_batches(spark)
    return quality_classifier.kept(docs, table(spark, sf_dir, "labels"))


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: similarity 0.8 or more by shingles of five words.

    SimHash fingerprints within 3 bits of each other are looked for first (by pigeonring); as pairs at 0.8 differ in about
    ten bits, bottom-k sketches look for the rest, and only where confirmed fingerprints left documents apart. Both are confirmed on whole sets. The smallest id stays, null ids come
    last, of equal ids that of the lower text hash; texts without words are one group; repeated rows are one group.
    """
    bounded_batches(spark)
    return bottom_k.representatives(docs, shingle_words=5, least=(4, 5), simhash=True)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the passages of over 50 words, or of 400 bytes, that repeat; n_chars is that of the text left.

    Null texts come back empty; a text of which nothing is left stays as an empty one; repeated rows repeat each other.
    """
    bounded_batches(spark)
    others = [c for c in docs.columns if c != "text"]
    left = suffix_dedup.without_repeats(docs, others, as_text=True, names=("__bytes", "__removed", "__spans", "text"), words=51)
    if "n_chars" in others:
        left = left.withColumn("n_chars", F.length("text").cast("long"))
    return left.select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents taken to meet the target weights: as many tokens as every domain can give its share of, in two epochs at most.

    A document of a scarce domain may come twice; texts without words are not taken; null languages and sources are leaves.
    """
    return mixing.mixed(docs, share=None, weights=mixing.WEIGHTS, max_epochs=2, domain=domain_of(F.col("source"))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document: null for null texts, none for empty ones; a repeated row is encoded as often as it is there.

    The ids are decoded again: round_trip tells whether they give the text.
    """
    bounded_batches(spark)
    return sentencepiece_codec.encoded(docs.drop("n_chars"), verify=True, slice_rows=64)
