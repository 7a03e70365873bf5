"""Stages that turn raw documents into token ids, in order; each stage's rows are written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sheafline.llm.common import staged, table
from sheafline.llm.pipeline_stages import encode, keep_good, keep_one_of_group, mix, remove_repeats

STAGES = [
    ("quality_classifier", keep_good),
    ("simhash_dedup", keep_one_of_group),
    ("suffix_dedup", remove_repeats),
    ("mixture", mix),
    ("sentencepiece", encode),
]
#: The stages cannot be written in SQL (a fitted model, connected components, suffix arrays); tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
