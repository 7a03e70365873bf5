"""Vector codes against plain integers."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from sheafline.llm import queries, vector_codes

SF = "/root/testdata/sf0.01"


def simple(rows, parts=16, entries=64, rounds=2):
    """rows of (id, vector, label)"""
    kept = [(i, v, k) for i, v, k in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(1, -(-max((len(v) for _, v, _ in kept), default=0) // parts)) * parts
    size = width // parts
    whole = [[int(x) * 256 if abs(x) >= 2**53 else math.floor(x * 256) for x in v] + [0] * (width - len(v)) for _, v, _ in kept]
    cut = [[tuple(v[p * size : (p + 1) * size]) for p in range(parts)] for v in whole]
    first = sorted(range(len(kept)), key=lambda j: (kept[j][0] is None, kept[j][0] or 0, list(kept[j][1])))[:entries]
    books = [[cut[j][p] for j in first] for p in range(parts)]

    def near(x, book):
        d = [sum((a - b) ** 2 for a, b in zip(x, e, strict=True)) for e in book]
        return min(range(len(book)), key=d.__getitem__), min(d)

    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for c in cut:
                members[near(c[p], books[p])[0]].append(c[p])
            books[p] = [tuple(sum(x) // len(members[e]) for x in zip(*members[e], strict=True)) if e in members else old for e, old in enumerate(books[p])]
    found = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for _, d in f) for f in found]
    per_label = Counter()
    for (_, _, k), e in zip(kept, errors, strict=True):
        per_label[k] += e
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return Counter((i, "".join(f"{a:02x}" for a, _ in f), min(e, 2**63 - 1), min(per_label[k], 2**63 - 1), sha) for (i, _, k), f, e in zip(kept, found, errors, strict=True))


COLUMNS = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def got(df):
    return Counter(tuple(r) for r in df.select(*COLUMNS).collect())


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert got(queries.op12_vector_codes(spark, SF)) == simple(rows)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    v = [(0, [1.0, 0.5], 1), (1, [1.0, 0.5], None), (1, [-1.0, 0.001], None), (2, [0.0, 0.0], 1), (3, None, 1), (4, [], 2), (5, [nan], 2), (6, [inf], 2), (7, [None], 2), (8, [1.0] * 19, 3), (None, [2.0], 3), (9, [-0.001] * 5, 3), (9, [-0.001] * 5, 3)]
    df = spark.createDataFrame([(*r, 1, 2) for r in v], "vec_id long, embedding array<double>, label int, code int, error int")
    for entries in (2, 64):
        assert got(vector_codes.coded(df, parts=4, entries=entries)) == simple(v, parts=4, entries=entries)
    assert vector_codes.coded(df.filter("false")).count() == 0
    assert vector_codes.coded(df.filter("vec_id = 3")).count() == 0


def test_huge_components(spark):
    rng = np.random.default_rng(1)
    v = [(i, [float(x) * 10.0 ** (i % 5 * 4) for x in rng.normal(size=8)], i % 2) for i in range(60)] + [(60, [1e300] * 8, 0)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>, label int")
    assert got(vector_codes.coded(df, parts=4, entries=5)) == simple(v, parts=4, entries=5)


@pytest.mark.parametrize("most", [1 << 10, 1 << 27])
def test_dots_are_exact(most):
    rng = np.random.default_rng(2)
    x, c = rng.integers(-most, most, (50, 33)), rng.integers(-most, most, (7, 33))
    want = [[sum(int(a) * int(b) for a, b in zip(r, e, strict=True)) for e in c] for r in x]
    assert vector_codes.dots(x, c).tolist() == want
    assert vector_codes.dots(np.array([[-most, most - 1]]), np.array([[most, -most]])).tolist() == [[-most * most - (most - 1) * most]]


def test_many_labels_are_salted(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "BROADCAST_ROWS", 3)
    v = [(i, [float(i % 7), float(i % 3)], i % 9 or None) for i in range(100)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>, label int")
    assert got(vector_codes.coded(df, parts=2, entries=4)) == simple(v, parts=2, entries=4)
