"""Passages of over 50 words that repeat, against a plain loop over all runs of 51 words."""

import random
import re
from collections import Counter

import pytest

from sheafline.llm import pipeline_stages, suffix_dedup


def simple_left(rows, words=51, length=400):
    runs, windows = Counter(), Counter()
    for _, t in rows:
        w, b = (t or "").encode().split(), (t or "").encode()
        runs.update(tuple(w[i : i + words]) for i in range(len(w) - words + 1))
        windows.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = Counter()
    for d, t in rows:
        b = (t or "").encode()
        starts = [m.start() for m in re.finditer(rb"\S+", b)] + [len(b)]
        w, cut = b.split(), [False] * len(b)
        for i in range(len(w) - words + 1):
            if runs[tuple(w[i : i + words])] > 1:
                cut[starts[i] : starts[i + words]] = [True] * (starts[i + words] - starts[i])
        for i in range(len(b) - length + 1):
            if windows[b[i : i + length]] > 1:
                cut[i : i + length] = [True] * length
        out[d, bytes(c for c, x in zip(b, cut, strict=True) if not x).decode("utf-8", "ignore")] += 1
    return out


def passages(seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, n)))
    run = lambda n, size: [word(size) for _ in range(n)]
    shared = [run(51, 1), run(50, 9), run(51, 9), run(62, 6), run(70, 2), run(200, 5), ["é" * 250, "ü" * 40]]
    pick = lambda: rng.choice([run(rng.randint(0, 90), 7), rng.choice(shared), rng.choice(shared)[rng.randint(0, 12) :]])
    space = lambda w: "".join(x + rng.choice([" ", " ", " ", "\n", "  "]) for x in w)
    rows = [(i, space(sum((pick() for _ in range(rng.randint(0, 5))), []))) for i in range(120)]
    return rows + [(300, "a " * 51), (301, "b " * 52), (302, None), (303, " \n"), (304, "c d e " * 90), (305, "x" * 399), (306, rows[3][1]), (None, " ".join(shared[0]))]


@pytest.mark.parametrize("group", [1024, 3])  # the second splits nearly every group
def test_repeats_in_words_are_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    rows = passages(12)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = pipeline_stages.remove_repeats(spark, docs, "")
    assert left.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == simple_left(rows)


def test_a_row_for_each_class_of_a_text(spark):
    line = "the same line again and again "
    docs = spark.createDataFrame([(i, line * 400 + str(i)) for i in range(5)], "doc_id long, text string")
    for args in ({}, {"length": 204, "gram": 52, "in_words": True}):
        rows = suffix_dedup.repeated_spans(docs, **args).collect()
        assert len(rows) == len({(r["doc_key"], r["k1"], r["k2"], r["before"], r["after"]) for r in rows}) < 100 < sum(len(r["pos"]) for r in rows)


def test_words_are_cut_whole():
    text = b" aa\tbb cc\n dd"
    assert suffix_dedup.in_text(text, [(2, 8), (8, 16)]) == [(4, 7), (7, 13)]
    assert suffix_dedup.in_text(b"", []) == []
