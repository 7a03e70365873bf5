"""Groups of near copies against brute force over all pairs."""

import random

from sheafline.llm import bottom_k, pipeline_stages


def similarity(a, b):
    sets = []
    for t in (a, b):
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def simple_kept(rows):
    """Ids kept: the smallest of each component of pairs at 0.8 or more."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if find(i) != find(j) and similarity(rows[i][1], rows[j][1]) >= 0.8:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return set(least.values())


def copies(seed):
    """Texts with one to twelve changed words, so that similarities lie on both sides of 0.8, and one large drifting group."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    out = []
    for _ in range(40):
        base = [word() for _ in range(rng.randint(40, 400))]
        for _ in range(4):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 25))):
                t[rng.randrange(len(t))] = word()
            out.append(" ".join(t))
    drift = [word() for _ in range(120)]
    for _ in range(60):
        drift[rng.randrange(120)] = word()
        out.append(" ".join(drift))
    rng.shuffle(out)
    return [*enumerate(out), (900, None), (901, " \n"), (902, "one two"), (903, "One  TWO"), (904, "one three")]


def test_near_copies_are_brute_force(spark):
    rows = copies(4)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string")
    kept = pipeline_stages.keep_one_of_group(spark, df, "")
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == simple_kept(rows)


def test_a_large_group_and_its_neighbours(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*base[:-1], f"end{i}"])) for i in range(700)]  # each pair is alike
    far = base[:178] + [f"far{i}" for i in range(22)]  # under 0.8 to all of them, over to each other
    rows += [(1000 + i, " ".join([*far, f"z{rng.random()}"])) for i in range(5)]
    rows += [(7, rows[7][1]), (None, "lone words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in bottom_k.representatives(df).collect()} == {0, 1000, None}
    assert bottom_k.representatives(df.filter("false")).count() == 0
