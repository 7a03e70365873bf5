"""Bottom-k near-duplicates against all pairs."""

import random
from collections import Counter

import numpy as np
import pytest

from sheafline.llm import bottom_k, queries

SF = "/root/testdata/sf0.01"


def shingles(text, w):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + w]) for i in range(max(1, len(words) - w + 1))} if words else set()


def simple(rows, w=3, least=(85, 100)):
    """(doc_id, size, component, kept) of each (doc_id, text), by all pairs of distinct sets."""
    sets, own = {}, [frozenset(shingles(t, w)) for _, t in rows]
    for (i, _), s in zip(rows, own, strict=True):
        sets.setdefault(s, []).append(i)
    distinct = sorted((s for s in sets if s), key=len)
    root = {s: s for s in distinct}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if len(b) * least[0] > len(a) * least[1]:
                break
            both = len(a & b)
            if both * least[1] >= (len(a) + len(b) - both) * least[0]:
                root[find(b)] = find(a)
    lowest = {}
    for s in distinct:
        for i in sets[s]:
            r = find(s)
            lowest[r] = i if lowest.get(r) is None else lowest[r] if i is None else min(i, lowest[r])
    component = [lowest[find(s)] if s else i for (i, _), s in zip(rows, own, strict=True)]
    return Counter((i, len(s), c, i == c) for (i, _), s, c in zip(rows, own, component, strict=True))


def got(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect())


def test_query_equals_all_pairs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = simple(rows)
    assert sum(1 for _, n, _, kept in want if n and not kept) > 20
    assert got(queries.op11_bottom_k(spark, SF)) == want


def words(rng, n):
    return [f"w{rng.randrange(40000)}" for _ in range(n)]


@pytest.mark.parametrize("k", [16, 64])
def test_chains_and_thresholds(spark, k):
    """Texts changed step by step, so that similarities lie on both sides of the threshold, short and long ones."""
    rng, rows = random.Random(5), []
    for size in (1, 2, 3, 5, 12, 40, 120, 400):
        for _ in range(4):
            text = words(rng, size)
            for _ in range(9):
                rows.append((len(rows), " ".join(text)))
                text = list(text)
                for _ in range(rng.choice((0, 1, 1, max(1, size // 50), max(1, size // 25)))):
                    text[rng.randrange(len(text))] = f"x{rng.randrange(10**9)}"
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(bottom_k.near_duplicates(df, k=k)) == simple(rows)


def boilerplate(n):
    rng = random.Random(9)
    shared = words(rng, 60)
    return [(i, " ".join(shared + words(rng, 30))) for i in range(n)]


def test_a_frequent_passage_makes_no_pairs(spark, monkeypatch):
    pairs, real = [], bottom_k._confirmed
    monkeypatch.setattr(bottom_k, "_confirmed", lambda p, *a: (pairs.append(p.count()), real(p, *a))[1])
    rows = boilerplate(600)
    rows += [(1000 + i, rows[i][1] + " end") for i in range(0, 600, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(bottom_k.near_duplicates(df)) == simple(rows)
    assert sum(pairs) < 20 * len(rows)


def test_a_large_group_of_near_copies_makes_few_pairs(spark, monkeypatch):
    pairs, real = [], bottom_k._confirmed
    monkeypatch.setattr(bottom_k, "_confirmed", lambda p, *a: (pairs.append(p.count()), real(p, *a))[1])
    rng = random.Random(11)
    base, rows = words(rng, 200), []
    for i in range(500):
        text = list(base)
        for _ in range(rng.randrange(3)):
            text[rng.randrange(200)] = f"y{rng.randrange(10**9)}"
        rows.append((i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(bottom_k.near_duplicates(df)) == simple(rows)
    assert sum(pairs) < 40 * len(rows)


def test_edges(spark):
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "One"), (4, "one"), (4, "one"), (5, "one two"), (6, "ONE  two"), (7, "É é"), (8, "é é"), (None, "a b c d"), (None, "a b c d"), (9, "A B C D"), (None, "lone words here")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, node int, v int")
    assert got(bottom_k.near_duplicates(df)) == Counter({(i, n, c, i == c): k for (i, n, c), k in Counter([
        (0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 1, 3), (4, 1, 3), (5, 1, 5), (6, 1, 5), (7, 1, 7), (8, 1, 8), (None, 2, 9), (None, 2, 9), (9, 2, 9), (None, 1, None)]).items()})
    assert bottom_k.near_duplicates(df.filter("false")).count() == 0


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    text = " ".join(words(random.Random(1), 5000)).encode()
    whole, kept = bottom_k.values(text, 3), bottom_k.whole_set(text, 3)
    monkeypatch.setattr(bottom_k, "PIECE", 100)
    assert np.array_equal(bottom_k.values(text, 3), whole) and np.array_equal(bottom_k.whole_set(text, 3), kept)
    assert len(whole) == len(kept) == len(shingles(text.decode(), 3))


def test_representatives(spark):
    rows = [(2, "a b c d e f g h i j k l"), (1, "a b c d e f g h i j k l"), (3, None), (4, ""), (5, "q r s t u v w x y z"), (None, "q r s t u v w x y z")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, __k string")
    assert sorted(r["doc_id"] for r in bottom_k.representatives(df.drop("__k")).collect()) == [1, 3, 5]
