"""SimHash components and suffix-array removal against brute force."""

import hashlib
import random
from collections import Counter

import pytest
import xxhash

from sheafline.llm import simhash_dedup, suffix_dedup
from sheafline.llm.common import components

DOC = "doc_id long, text string, fingerprint string, g string, n long"


def frame(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", "y", 0) for i, t in rows], DOC)


def simple_fingerprint(text):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simple_components(rows):
    prints = [simple_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return Counter((d, f"{p:016x}", least.get(find(i))) for i, ((d, _), p) in enumerate(zip(rows, prints, strict=True)))


def texts(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 6)))
    base = [[word() for _ in range(rng.randint(0, 400))] for _ in range(n // 4)]
    out = []
    for i in range(n):
        t = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 2))):
            if t:
                t[rng.randrange(len(t))] = word()
        out.append((i, " ".join(t)))
    return out


ODD = [(900, None), (901, ""), (902, " \t\n"), (903, "One"), (904, "ONE"), (905, "é É"), (905, "é É"), (None, "two words"), (None, None)]


def test_simhash_is_brute_force(spark):
    rows = texts(1, 160) + ODD + [(910, "long " * 70_000), (911, "long " * 70_001)]
    got = simhash_dedup.near_duplicates(frame(spark, rows))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert Counter(tuple(r) for r in got.collect()) == simple_components(rows)


def test_links_lose_nothing_in_small_buckets(spark):
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    prints = {centre}
    for _ in range(300):
        p = rng.choice(sorted(prints))
        for _ in range(rng.randint(1, 4)):
            p ^= 1 << rng.randrange(64)
        prints.add(p)
    prints |= {rng.getrandbits(64) for _ in range(200)}
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    want = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    df = spark.createDataFrame([(p,) for p in signed], "f long")
    for bucket_rows in (512, 4):  # the second refines nearly every key
        assert {(r["a"], r["b"]) for r in simhash_dedup.links(df, bucket_rows).collect()} == want


def test_representatives_keep_one_row_of_each_component(spark):
    rows = texts(5, 80) + ODD
    df = frame(spark, rows)
    kept = simhash_dedup.representatives(df, shingle_words=3)
    assert kept.columns == df.columns
    comps = {simple_fingerprint(t): None for _, t in rows}
    want = simple_components(rows)
    assert kept.count() == len({c for _, _, c in want})
    assert comps and {r["doc_id"] for r in kept.collect()} == {c for _, _, c in want}


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 300)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(300)}


def simple_removal(rows, length=400):
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = Counter()
    for d, t in rows:
        b = (t or "").encode()
        cut = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                cut[i : i + length] = [True] * length
        left = bytes(c for c, x in zip(b, cut, strict=True) if not x)
        runs = sum(x and (i == 0 or not cut[i - 1]) for i, x in enumerate(cut))
        out[(d, len(b), sum(cut), runs, hashlib.sha256(left).hexdigest())] += 1
    return out


def passages(seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(n))
    shared = [word(n) for n in (700, 450, 399, 401)]
    pick = lambda: rng.choice([word(rng.randint(0, 300)), rng.choice(shared), rng.choice(shared)[rng.randint(0, 60) :]])
    rows = [(i, "".join(pick() for _ in range(rng.randint(0, 5)))) for i in range(120)]
    return rows + [(300, "a" * 3000), (301, None), (302, ""), (303, "ab" * 900), (305, "x" * 399), (306, "line one is here\n" * 200), (306, "line one is here\n" * 200), (None, shared[0]), (None, None)]


@pytest.mark.parametrize("group", [1024, 3])  # the second splits nearly every group
def test_removal_is_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    rows = passages(11)
    got = suffix_dedup.without_repeats(frame(spark, rows), ["doc_id"])
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in got.collect()) == simple_removal(rows)


def test_interval_tree():
    #        entries  0  1  2  3  4
    assert sorted(suffix_dedup.intervals([3, 1, 0, 2])) == [(0, 0, 4), (1, 0, 2), (2, 3, 4), (3, 0, 1)]
    assert list(suffix_dedup.intervals([])) == []


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert simhash_dedup.near_duplicates(empty).count() == 0
    assert simhash_dedup.representatives(empty).count() == 0
    assert suffix_dedup.without_repeats(empty, ["doc_id"]).count() == 0
