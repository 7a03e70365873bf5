"""Folds of very many small groups: as plain loops give them, and without a Python call for each group."""

import random
from collections import Counter, defaultdict

import pytest

from sheafline.operators import folds
from sheafline.relations import apply
from tests.support import rows


@pytest.fixture(scope="module")
def boxes(spark):
    rng = random.Random(3)
    data = [
        (None if d == 0 else d, d % 3, i, "ab"[i % 2], *(float(v) for v in (x, x + rng.choice([4, 24]), y, y + rng.choice([2, 8]))))
        for d in range(40)
        for i, (x, y) in enumerate((rng.choice([0, 16, 40, 64]), rng.randrange(0, 90, 3)) for _ in range(1 + d % 12))
    ] + [(50, 0, 1, "a", 0.0, 8.0, 4.0, 8.0), (50, 0, 2, "a", 80.0, 88.0, 4.0, 8.0), (50, 0, 2, "a", 80.0, 88.0, 4.0, 8.0), (50, 0, 3, "a", 0.0, 9.0, 4.0, 8.0), (51, 0, 4, "a", None, 9.0, 4.0, 8.0), (51, 0, 5, "a", 80.0, 99.0, None, 8.0), (51, 0, 6, "a", 0.0, 9.0, 4.0, 8.0)]
    return data, spark.createDataFrame(data, "doc_id long, page int, box_id long, label string, x0 double, x1 double, y0 double, y1 double")


def test_pairs_equal_plain_loops(boxes):
    data, df = boxes
    groups = defaultdict(lambda: ([], []))
    for d, p, i, label, x0, x1, y0, y1 in data:
        if None not in (x0, y0):
            x = (x0 + x1) / 2
            for side in [0] * (x < 50) + [1] * (x > 50):
                groups[d, p, label][side].append((i, (y0 + y1) / 2))
    want = Counter((*k, a, b) for k, (left, right) in groups.items() for a, b in folds.nearest_pairs(left, right, 10.0))
    got = apply("c_bilingual_boxes", boxes=df)
    assert rows(got, "doc_id", "page", "label", "first", "second") == want
    assert "InPandas" not in got._jdf.queryExecution().executedPlan().toString()


def test_clusters_equal_plain_loops(boxes):
    data, df = boxes
    groups = defaultdict(list)
    for d, p, _, _, x0, x1, y0, y1 in data:
        if d != 51:
            groups[d, p].append((x0 * 6, y0 * 8, x1 * 6, y1 * 8))
    want = Counter((*k, *r) for k, rects in groups.items() for r in folds.merged_clusters(rects, 24.0))
    figures = df.filter("doc_id is null or doc_id <> 51").selectExpr("doc_id", "page", "x0 * 6 AS x0", "x1 * 6 AS x1", "y0 * 8 AS y0", "y1 * 8 AS y1")
    got = apply("d_cluster_rects", figures=figures)
    assert rows(got, "doc_id", "page", "x0", "y0", "x1", "y1") == want
    assert "InPandas" not in got._jdf.queryExecution().executedPlan().toString()
