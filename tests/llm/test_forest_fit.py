"""The forest finds the nearest on rows other than those its depth was chosen on."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheafline.llm import hash_forest

RNG = np.random.default_rng(4)


@pytest.mark.parametrize("x", [RNG.normal(size=(3000, 768)), RNG.uniform(size=(3000, 512))], ids=["normal", "uniform"])
def test_recall_in_many_dimensions(spark, x):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {}
    for r in hash_forest.nearest(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    found = 0
    for i in range(0, 3000, 50):
        d = ((x - x[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        found += len(got[i] & set(np.argsort(d)[:10].tolist()))
    assert found >= 0.93 * 600


def test_pairs_of_pieces_are_held():
    from sheafline.llm import sentencepiece_codec as sp

    assert sp.PAIRS >= 4 * sp.CACHE
