"""The Merkle manifest against hashlib, group by group."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sheafline.llm import merkle_manifest, queries

SF = "/root/testdata/sf0.01"
KIND = "doc_id long, source string, lang string, n_chars long, text string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))


def grown(nodes):
    """The root over nodes, and for each node the (before, after) of each level."""
    paths, spans = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(i, min(i + 8, len(nodes))) for i in range(0, len(nodes), 8)]
        for run in runs:
            for i in run:
                step = ("".join(nodes[j] for j in run if j < i), "".join(nodes[j] for j in run if j > i))
                for s in spans[i]:
                    paths[s].append(step)
        nodes, spans = [H(*(nodes[i] for i in run)) for run in runs], [[s for i in run for s in spans[i]] for run in runs]
    return nodes[0], paths


def simple(rows, altered):
    groups = defaultdict(list)
    for r in rows:
        groups[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: grown([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    root, upper = grown([trees[g][0] for g in names])
    out = Counter()
    for g, above in zip(names, upper, strict=True):
        for (_, _, own, r), path in zip(sorted(groups[g], key=lambda x: x[:3]), trees[g][1], strict=True):
            steps = path + above
            h = leaf(r, r["text"] and "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])) if altered(r["doc_id"]) else own
            for before, after in steps:
                h = H(before, h, after)
            out[r["doc_id"], own, trees[g][0], root, H(*(b + a for b, a in steps)), h, h == root] += 1
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def third(i):
    return i is not None and zlib.crc32(str(i).encode()) % 3 == 0


def test_query_equals_brute_force(spark):
    want = simple([r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()], third)
    got = queries.op13_merkle_manifest(spark, SF)
    assert Counter(tuple(r) for r in got.select(*COLUMNS).collect()) == want
    assert len({v for *_, v in want}) == 2


@pytest.mark.parametrize("block_digits", [1, 2])
def test_more_tiers_than_one(spark, monkeypatch, block_digits):
    monkeypatch.setattr(merkle_manifest, "DIGITS", block_digits)
    monkeypatch.setattr(merkle_manifest, "BLOCK", 8**block_digits)
    rows = [{"doc_id": i * 7 % 1009, "source": "s", "lang": "abcdefghijklm"[i % 13] if i % 3 else "z", "n_chars": i, "text": f"Text {i}"} for i in range(1009)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], KIND)
    got = merkle_manifest.manifest(df, altered=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0)
    assert Counter(tuple(r) for r in got.select(*COLUMNS).collect()) == simple(rows, third)


def test_edges(spark):
    rows = [
        (None, None, None, None, None), (None, "s", None, 1, "A"), (1, "s", "é", 1, ""), (1, "s", "é", 1, ""), (1, "s", "é", 1, "B"),
        (3, None, "", 0, "Ünï"), (4, "s", "Z", 2, "lower"), (5, "s", "a", 3, "X" * 200_000), (6, "s", "a", 3, "x\ty\nZ"),
    ]
    df = spark.createDataFrame(rows, KIND)
    clash = df.withColumns({"g": F.lit(1), "h": F.lit("x"), "r": F.lit(2), "leaf": F.lit(3), "path": F.lit(4), "n": F.lit(5)})
    want = simple([dict(zip(("doc_id", "source", "lang", "n_chars", "text"), r, strict=True)) for r in rows], third)
    altered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    for d in (df, clash):
        assert Counter(tuple(r) for r in merkle_manifest.manifest(d, altered=altered).select(*COLUMNS).collect()) == want
    one = merkle_manifest.manifest(df.limit(1)).collect()
    assert [(r["leaf"] == r["subroot"] == r["root"], r["proof"], r["proof_sha256"], r["verified"]) for r in one] == [(True, [], H(), True)]
    assert merkle_manifest.manifest(df.filter("false")).count() == 0
    assert all(r["verified"] for r in merkle_manifest.manifest(df).collect())
