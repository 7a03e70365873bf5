"""Nearest neighbours, mixing, sharding and the pipeline."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sheafline.llm import hash_forest, mixing, sharding
from sheafline.llm.queries import domain_of

SF = "/root/testdata/sf0.01"


def simple_nearest(ids, x, queries, k=10):
    out = {}
    for q in queries:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:k]
        out[q] = [(ids[i], d[i]) for i in order]
    return out


def test_forest_recall(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    p = rows.toPandas()
    ids, x = p["vec_id"].to_numpy(), np.stack(p["embedding"]).astype(float)
    want = simple_nearest(ids, x, ids[ids % 10 == 0])
    got = defaultdict(list)
    for r in hash_forest.nearest(rows, F.col("vec_id") % 10 == 0, block_rows=200).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    assert set(got) == set(want)
    hits = sum(len({a for a, _ in want[q]} & {a for a, _ in got[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    d = {(i, j): s for i, n in want.items() for j, s in n}
    assert all(abs(s - d.get((q, j), s)) < 1e-12 for q, n in got.items() for j, s in n)


def test_forest_edges(spark):
    nan, inf = float("nan"), float("inf")
    v = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0]), (10, []), (None, [1.0, 1.0]), (100, [0.5, 0.5])]
    df = spark.createDataFrame([(*r, 1, 2) for r in v], "vec_id long, embedding array<float>, rank int, b int")
    got = [tuple(r) for r in hash_forest.nearest(df, F.col("vec_id") % 100 == 0, k=3).orderBy("query_id", "rank").collect()]
    assert [r[:3] for r in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 100), (100, 1, 0), (100, 2, 1), (100, 3, 2)]
    few = hash_forest.nearest(df.filter("vec_id in (0, 3)"), F.col("vec_id") % 100 == 0)
    assert [tuple(r)[:3] for r in few.collect()] == [(0, 1, 3)]
    assert hash_forest.nearest(df.filter("vec_id = 0"), F.col("vec_id") % 100 == 0).count() == 0
    assert hash_forest.nearest(df.filter("false"), F.col("vec_id") % 100 == 0).count() == 0


def test_rows_of_one_id_are_rows_of_their_own(spark):
    x = np.random.default_rng(3).normal(size=(120, 6))
    ids = [i % 100 for i in range(120)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got = hash_forest.nearest(df, F.col("vec_id") < 5, k=4, visit=50.0, block_rows=40, query_rows=3).collect()
    want = Counter()
    for q in (q for q in range(120) if ids[q] < 5):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        for rank, i in enumerate([i for i in np.lexsort((ids, d)) if i != q][:4], 1):
            want[ids[q], rank, ids[i], round(float(d[i]), 9)] += 1
    assert Counter((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in got) == want


def filled(total, siblings):
    """Shares of total by weight, none over its most."""
    got, active, left = [0.0] * len(siblings), {i for i, (w, _) in enumerate(siblings) if w > 0}, total
    while active and left > 1e-9:
        weights = sum(siblings[i][0] for i in active)
        full = [i for i in active if siblings[i][1] <= left * siblings[i][0] / weights + 1e-9]
        for i in full or active:
            got[i] = siblings[i][1] if full else left * siblings[i][0] / weights
        if not full:
            break
        left -= sum(siblings[i][1] for i in full)
        active -= set(full)
    return got


def simple_mix(rows, share, weights, epochs, seed=13):
    domain = lambda s: ["web", "books", "code"][int((re.search(r"(\d+)$", s or "") or [0, 0])[1]) % 3]
    weight = lambda level, x: weights[level].get(x, 0.0) if level in weights else 1.0
    leaf = defaultdict(list)
    for i, t, lang, source in rows:
        if n := len(re.findall(r"[^\x20\x09-\x0D]+", t or "")):
            leaf[domain(source), lang, source].append((i, t, n))
    total = {k: sum(x[2] for x in v) for k, v in leaf.items()}
    most = {k: total[k] * epochs if weight("domain", k[0]) and weight("lang", k[1]) and weight("source", k[2]) else 0 for k in total}
    out = Counter()
    domains = sorted({k[0] for k in total})
    for d, b1 in zip(domains, filled(share * sum(total.values()), [(weight("domain", d), sum(v for k, v in most.items() if k[0] == d)) for d in domains]), strict=True):
        langs = list({k[1] for k in total if k[0] == d})
        for lang, b2 in zip(langs, filled(b1, [(weight("lang", x), sum(v for k, v in most.items() if k[:2] == (d, x))) for x in langs]), strict=True):
            keys = [k for k in total if k[:2] == (d, lang)]
            for k, b in zip(keys, filled(b2, [(weight("source", k[2]), most[k]) for k in keys]), strict=True):
                whole = min(int(b // total[k]), epochs)
                key = lambda x: hashlib.md5(f"{seed}:{whole}:{'-' if x[0] is None else x[0]}:{xxhash.xxh64_intdigest(x[1].encode(), 42):X}".encode()).hexdigest()  # noqa: B023, E731
                used, rest = 0, b - whole * total[k]
                for x in sorted(leaf[k], key=key):
                    for e in range(whole + (used < rest - 1e-6)):
                        out[x[0], e] += 1
                    used += x[2]
    return out


@pytest.mark.parametrize(("share", "weights", "epochs"), [(0.5, mixing.WEIGHTS, 2), (0.9, {}, 1), (1.5, mixing.WEIGHTS, 2), (0.05, {"domain": {"web": 1.0}}, 1)])
def test_mixing_is_brute_force(spark, share, weights, epochs):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(400)
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), share, weights, epochs, domain=domain_of(F.col("source")))
    assert Counter((r["doc_id"], r["epoch"]) for r in got.collect()) == simple_mix(rows, share, weights, epochs)


def test_mixing_edges(spark):
    rows = [(i, "w " * (i % 7), None if i % 5 == 0 else "en", None if i % 4 == 0 else f"src{i % 3}", "a", 5) for i in range(60)]
    rows += [(None, "a b", "en", "odd", "a", 5), (61, None, "en", "src1", "a", 5), (62, "", "en", "src1", "a", 5), (63, "w " * 50_000, "en", "src1", "a", 5), (63, "w " * 50_000, "en", "src1", "a", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, domain string, last int")
    got = mixing.mixed(df, share=1.0, weights={}, max_epochs=1)
    assert got.columns == ["doc_id", "text", "lang", "source", "last", "domain", "n_tokens", "epoch"]
    assert Counter(r["doc_id"] for r in got.collect()) == Counter(r[0] for r in rows if (r[1] or "").split())
    assert mixing.mixed(df.filter("false")).count() == 0


@pytest.mark.parametrize("copies", [1, 40])
def test_equal_rows_at_the_end_of_a_budget(spark, copies, monkeypatch):
    monkeypatch.setattr(mixing, "EDGE_ROWS", 1)
    rows = [(7, "one two three", "en", "src0", k) for k in range(copies)] + [(i, f"w{i} x", "en", "src0", 0) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, k int").repartition(5)
    total = 3 * copies + 24
    for share in (0.1, 0.5):
        n = [r["n_tokens"] for r in mixing.mixed(df, share, {}, 1).collect()]
        assert share * total - 1e-6 <= sum(n) < share * total + 3  # the shortest prefix that reaches the budget


def test_mixing_by_a_count_of_tokens(spark):
    df = spark.createDataFrame([(i, "a b", "en", "src0", i) for i in range(10)], "doc_id long, text string, lang string, source string, n long")
    got = mixing.mixed(df, 1.0, {}, 1, n_tokens=F.col("n")).collect()
    assert {(r["doc_id"], r["n_tokens"]) for r in got} == {(i, i) for i in range(1, 10)}


def checked_shards(spark, rows, n=8):
    got = sharding.shards(spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, g int, number int"), n).collect()
    assert len(got) == len(rows)
    text = lambda t: (t or "").encode()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len(text(t)) + 1, zlib.crc32(text(t))) for i, t in rows)
    sizes = Counter(r["shard"] for r in got)
    assert all(0 <= s < n for s in sizes) and max(sizes.values(), default=0) - min(sizes[s] for s in range(n)) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
    assert all(r["law"] == "rows" and r["grown_shard"] is None for r in got)
    where = defaultdict(set)
    for r in got:
        where[r["text_crc32"]].add(r["shard"])
    return where


def test_groups_stay_together_under_quotas(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"b{i % 37}" if i % 3 == 1 else f"t{i}") for i in range(1501)]
    where = checked_shards(spark, rows)
    cut = {t for t in {t for _, t in rows} if len(where[zlib.crc32(t.encode())]) > 1}
    assert cut == {"hot"} and len(where[zlib.crc32(b"hot")]) <= 5  # a third of all rows cannot be in one of eight shards


def test_circulation_keeps_loads():
    rng = np.random.default_rng(1)
    for _ in range(50):
        asked = {(s, t): int(rng.integers(1, 9)) for s in range(6) for t in range(6) if s != t and rng.random() < 0.3}
        got = sharding.circulation(asked)
        assert all(0 < n <= asked[x] for x, n in got.items())
        assert all(sum(n for (s, _), n in got.items() if s == k) == sum(n for (_, t), n in got.items() if t == k) for k in range(6))
        left = {x for x in asked if asked[x] > got.get(x, 0)}
        while drop := {x for x in left if all(s != x[1] for s, _ in left)}:
            left -= drop
        assert not left  # what is left has no circle


def test_full_shards_exchange_members(spark):
    rows = [(i, f"pair {i // 2}") for i in range(800)]  # every text has a copy: no shard ever has room
    where = checked_shards(spark, rows)
    assert sum(len(s) > 1 for s in where.values()) <= 8  # at first seven in eight pairs are cut


def test_sharding_edges(spark):
    checked_shards(spark, [(None, None), (None, None), (1, ""), (1, ""), (2, "x" * 300_000), (3, "y")])
    checked_shards(spark, [(i, "same") for i in range(50)])
    checked_shards(spark, [])


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = docs.withColumn("n_bytes", F.lit(1)).withColumn("g", F.lit("z"))
    odd = spark.createDataFrame([(900, None, None, None, None, 1, "z"), (None, "a b", "en", "src1", 3, 1, "z"), (901, "", "en", "src1", 0, 1, "z")], extra.schema)
    frame, counts = extra.unionByName(odd), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = frame
        frame = corpus_pipeline.staged(stage(spark, frame, sf), name)
        assert frame.columns == extra.columns
        assert frame.count() <= before.count()
        counts.append(frame.count())
    assert counts[0] < extra.count() + 3 and counts[1] < counts[0] and counts[2] == counts[1]
    last = corpus_pipeline.STAGES[-1][1](spark, frame, sf)
    assert last.count() == frame.count() and all(len(r["ids"]) == r["n_tokens"] > 0 for r in last.collect())
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, extra.filter("false"), sf).count() == 0


def test_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10 and "pipeline" in names
