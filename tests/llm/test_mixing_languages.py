"""Languages that the production weights don't list."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from sheafline.llm import mixing, pipeline_stages
from sheafline.llm.queries import domain_of

from .test_sets import simple_mix

LANGS = ["en", "de", "fr", "es", "it", "pt", None]


def documents():
    return [(i, f"w{i} " * (1 + i % 9), LANGS[i % 7], f"src{i % 5}") for i in range(700)]


@pytest.mark.parametrize("share", [0.5, 0.95])
def test_unlisted_and_null_languages_have_a_share(spark, share):
    rows = documents()
    other = mixing.WEIGHTS["lang"][None]
    assert other > 0
    explicit = {**mixing.WEIGHTS, "lang": {**mixing.WEIGHTS["lang"], "it": other, "pt": other}}
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), share, mixing.WEIGHTS, 1, domain=domain_of(F.col("source"))).collect()
    assert Counter((r["doc_id"], r["epoch"]) for r in got) == simple_mix(rows, share, explicit, 1)
    assert {r["lang"] for r in got} == set(LANGS)


def test_the_pipeline_takes_them_too(spark):
    docs = spark.createDataFrame(documents(), "doc_id long, text string, lang string, source string")
    assert {r["lang"] for r in pipeline_stages.mix(spark, docs, "").collect()} == set(LANGS)


def test_the_pipeline_meets_its_targets(spark):
    """Web is scarce (a twentieth of the rows), so it comes twice; all domains give their share."""
    docs = spark.createDataFrame([(i, f"w{i} " * (1 + i % 9), LANGS[i % 7], f"src{(0, 1, 2)[i % 3] if i % 20 else 0}" if i % 3 else "src1") for i in range(3000)], "doc_id long, text string, lang string, source string")
    taken = pipeline_stages.mix(spark, docs, "").withColumn("domain", domain_of(F.col("source")))
    sums = {r["domain"]: r["n"] for r in taken.groupBy("domain").agg(F.sum(mixing.tokens("text")).alias("n")).collect()}
    total = sum(sums.values())
    assert total > 0 and all(abs(sums[d] / total - w) < 0.02 for d, w in mixing.WEIGHTS["domain"].items()), sums


def test_one_domain_takes_all(spark):
    docs = spark.createDataFrame([(i, "a b c", "en", "src3") for i in range(50)], "doc_id long, text string, lang string, source string")
    assert pipeline_stages.mix(spark, docs, "").count() == 50
    assert pipeline_stages.mix(spark, docs.filter("false"), "").count() == 0
