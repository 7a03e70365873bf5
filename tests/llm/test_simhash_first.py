"""In the near-copy stage what SimHash has linked is settled: sketches compare what it left apart, and groups stay the same."""

import random

from sheafline.llm import bottom_k


def test_sketches_compare_what_fingerprints_left_apart(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(1200)]
    texts = [" ".join(base)] + [" ".join([*base[:i], "other", *base[i + 1 :]]) for i in (100, 500, 900)]
    texts += [" ".join(f"v{rng.randrange(10**6)}" for _ in range(300)) for _ in range(5)]
    far = texts[-1].split()
    texts.append(" ".join([*far[:265], *(f"u{i}" for i in range(12))]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked, plain = [], bottom_k._confirmed

    def counted(pairs, nodes, *rest):
        k = nodes.select("node", "k")
        met = pairs.join(k.withColumnRenamed("node", "a").withColumnRenamed("k", "ka"), "a").join(k.withColumnRenamed("node", "b").withColumnRenamed("k", "kb"), "b")
        asked.append({tuple(sorted(r)) for r in met.select("ka", "kb").collect()})
        return plain(pairs, nodes, *rest)

    monkeypatch.setattr(bottom_k, "_confirmed", counted)
    kept = {r["doc_id"] for r in bottom_k.representatives(df, simhash=True).collect()}
    by_fingerprints, by_sketches = asked[0], asked[1]
    assert {(0, 1), (0, 2), (0, 3)} & by_fingerprints
    assert not by_fingerprints & by_sketches and (8, 9) in by_sketches
    monkeypatch.setattr(bottom_k, "_confirmed", plain)
    assert kept == {0, 4, 5, 6, 7, 8} == {r["doc_id"] for r in bottom_k.representatives(df).collect()}
