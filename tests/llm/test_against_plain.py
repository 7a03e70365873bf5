"""Classifier, sharding and pages as registered against plain single-process versions over whole tables."""

import re
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheafline.llm import quality_classifier as qc
from sheafline.llm import sharding
from sheafline.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def plain_isotonic(at, y):
    """Least squares under order by the max-min formula; centres and levels of the runs of equal levels."""
    n, s, m = len(at), np.concatenate(([0], np.cumsum([sum(v) for v in y]))), np.concatenate(([0], np.cumsum([len(v) for v in y])))
    levels = [max(min((s[b + 1] - s[a]) / (m[b + 1] - m[a]) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
    blocks = defaultdict(list)
    for x, v, level in zip(at, y, levels, strict=True):
        blocks[round(level, 12)] += [x] * len(v)
    return [np.mean(v) for _, v in sorted(blocks.items())], sorted(blocks)


def test_scores_are_the_plain_solve(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    stats = {d: qc.statistics(None if t is None else t.encode()) for d, t in texts.items()}
    halves = {r["doc_id"]: r["h"] for r in qc.with_statistics(docs).select("doc_id", F.pmod(F.xxhash64("x"), F.lit(2)).alias("h")).collect()}
    out = {r["doc_id"] for r in docs.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("o")).collect() if r["o"]}
    known = [(r["doc_id"], float(r["quality"])) for r in labels.filter("quality in (0, 1)").collect() if r["doc_id"] in stats and r["doc_id"] not in out]
    x, y, half = np.array([stats[d] for d, _ in known]), np.array([q for _, q in known]), np.array([halves[d] for d, _ in known])
    spread = x.std(axis=0)
    rng = np.random.default_rng(qc.SEED)
    w, b = rng.normal(size=(qc.N_STATS, qc.FEATURES)) * np.sqrt(2 / qc.N_STATS), rng.uniform(0, 2 * np.pi, size=qc.FEATURES)

    def features(rows):
        z = np.clip((np.array(rows) - x.mean(axis=0)) / np.where(spread == 0, 1, spread), -6, 6)
        return np.hstack([np.cos(z @ w + b) * np.sqrt(2 / qc.FEATURES), np.ones((len(rows), 1))])

    def ridge(rows, marks):
        f = features(rows)
        root = np.diag(np.sqrt([qc.RIDGE] * qc.FEATURES + [1e-6]))  # ridge as rows of zeros below, by least squares
        return np.linalg.lstsq(np.vstack([f, root]), np.concatenate([marks, np.zeros(len(root))]), rcond=None)[0]

    cross = np.where(half == 0, features(x) @ ridge(x[half == 1], y[half == 1]), features(x) @ ridge(x[half == 0], y[half == 0]))
    by_score = defaultdict(list)
    for s, mark in zip(np.round(np.clip(cross, -1, 2) * 1000), y, strict=True):
        by_score[s / 1000].append(mark)
    at = sorted(by_score)
    centres, levels = plain_isotonic(at, [by_score[a] for a in at])
    want = dict(zip(stats, np.clip(np.interp(features(list(stats.values())) @ ridge(x, y), centres, levels), 0, 1), strict=True))
    got = QUERIES["op3_quality_classifier"](spark, SF).collect()
    assert len(got) == len(texts) and {r["doc_id"] for r in got if r["held_out"]} == out
    assert max(abs(r["score"] - want[r["doc_id"]]) for r in got) < 1e-3
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in got)


def cut_links(placed):
    """Pairs of equal texts in different shards, of (text, shard)."""
    groups = defaultdict(Counter)
    for g, s in placed:
        groups[g][s] += 1
    return sum((sum(c.values()) ** 2 - sum(n * n for n in c.values())) // 2 for c in groups.values())


def plain_propagation(rows, start, quota):
    """Documents one by one move to the shard with most of their equals while it has room, until none moves."""
    shard, load = dict(start), Counter(start.values())
    groups = defaultdict(list)
    for i, g in rows:
        groups[g].append(i)
    moved = True
    while moved:
        moved = False
        for i, g in rows:
            near = Counter(shard[j] for j in groups[g] if j != i)
            best = max(near, key=lambda s: (near[s], -s), default=None)
            if best is not None and near[best] > near[shard[i]] and load[best] < quota[best]:
                load[shard[i]] -= 1
                load[best] += 1
                shard[i], moved = best, True
    return [(g, shard[i]) for i, g in rows]


def sharded(spark, rows, n):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    start = {r["doc_id"]: r["s"] for r in df.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(n)).alias("s")).collect()}
    text = dict(rows)
    got = [(text[r["doc_id"]], r["shard"]) for r in sharding.shards(df, n).collect()]
    quota = [len(rows) // n + (i < len(rows) % n) for i in range(n)]
    assert len(got) == len(rows) and sorted(Counter(s for _, s in got).get(i, 0) for i in range(n)) == sorted(quota)
    return cut_links(got), cut_links(plain_propagation(rows, start, quota)), cut_links([(g, start[i]) for i, g in rows])


@pytest.mark.parametrize("sizes", [[2] * 60 + [1] * 40, [3] * 30 + [5] * 10 + [1] * 100, [60] + [2] * 40 + [1] * 40, [7, 7, 7, 7, 7, 7]])
def test_fewer_links_are_cut_than_by_plain_propagation(spark, sizes):
    order = np.random.default_rng(3).permutation(sum(sizes))
    rows = [(int(i), f"text {g}") for i, g in zip(order, [g for g, n in enumerate(sizes) for _ in range(n)], strict=True)]
    ours, plain, start = sharded(spark, rows, 8)
    assert ours <= plain < start


def test_cut_links_over_the_whole_table(spark):
    rows = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    ours, plain, start = sharded(spark, rows, 8)
    assert ours <= plain <= start


class Article(HTMLParser):
    """Blocks of text within article or main, by the standard library's parser; whole parts of other kinds are left out."""

    BREAKS = set("p h1 h2 h3 h4 h5 h6 ul ol li br div section article main table tr td th blockquote pre figure figcaption hr dl dt dd".split())
    PARTS = set("nav header footer aside form script style noscript template button".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.text, self.inside, self.left_out = [], [], 0, []

    def cut(self):
        if line := " ".join("".join(self.text).split()):
            self.blocks.append(line)
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag in self.BREAKS | self.PARTS:
            self.cut()
        self.inside += tag in ("article", "main")
        named = " ".join(v or "" for k, v in attrs if k in ("class", "id"))
        if self.left_out or tag in self.PARTS or re.search(r"\b(?:ad|comments?|sidebar|notice|cookie|share|related)\b", named):
            if tag not in ("br", "img", "input", "hr", "meta", "link", "p", "li"):
                self.left_out.append(tag)

    def handle_endtag(self, tag):
        if tag in self.BREAKS | self.PARTS:
            self.cut()
        if tag in self.left_out:
            while self.left_out.pop() != tag:
                pass
        self.inside -= tag in ("article", "main")

    def handle_data(self, data):
        if self.inside > 0 and not self.left_out:
            self.text.append(data)


def test_pages_as_registered(spark):
    """On the given pages, where every article stands in such a part, the query's text is that of a plain parser."""
    want = {}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        page = Article()
        page.feed(r["html"] or "")
        page.close()
        page.cut()
        want[r["page_id"]] = "\n".join(page.blocks)
    got = {r["page_id"]: r for r in QUERIES["op2_page_text"](spark, SF).collect()}
    assert {i: r["text"] for i, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
