"""Classifier, rules, pages, tokens: against brute force, held-out labels, SQL and the library itself."""

from collections import Counter

import duckdb
import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from sheafline.llm import page_text, quality_classifier, quality_rules, sentencepiece_codec, token_counts
from tests.support import plain, rows

SF = "/root/testdata/sf0.01"
ODD = ["", None, " \n\t", "a", "word " * 100, "\n\n\n", "é ü 漢字 🎉", "x" * 200_000, "a b c d " * 30_000, "▁ mark ▁▁"]


def odd(spark):
    return spark.createDataFrame([(i, t, 1, "z") for i, t in enumerate([*ODD, ODD[3]])] + [(None, "a b", 1, "z")], "doc_id long, text string, n_tokens int, x string")


def test_classifier_on_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = quality_classifier.scores(docs, labels)
    assert got.count() == docs.count()
    out = got.join(labels, "doc_id").filter("held_out").select("quality", "predicted").collect()
    assert len(out) > 50 and sum(r["quality"] == r["predicted"] for r in out) / len(out) > 0.95
    kept = quality_classifier.kept(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {r["doc_id"] for r in got.filter("predicted = 1").collect()}


def test_classifier_edges(spark):
    labels = spark.createDataFrame([(0, 1, 0), (2, 0, 0), (3, 1, 1), (3, 1, 1), (99, 0, 0), (4, None, 0), (5, 7, 0)], "doc_id long, quality int, toxic int")
    got = quality_classifier.scores(odd(spark), labels).collect()
    assert len(got) == 12 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert {r["score"] for r in quality_classifier.scores(odd(spark), labels.filter("false")).collect()} == {0.5}
    assert quality_classifier.scores(odd(spark).filter("false"), labels).count() == 0


def test_isotonic_and_cosines():
    at, level = quality_classifier.isotonic(np.array([0.0, 1, 2, 3]), np.array([0.0, 1, 0, 1]), np.array([1.0, 1, 1, 2]))
    assert list(level) == [0, 0.5, 1] and list(at) == [0, 1.5, 3]
    c = quality_classifier.Cosines([0.0] * 5, [1.0] * 5, n=20_000)
    x = np.random.default_rng(0).normal(size=(6, 5))
    f = c(x)[:, :-1]
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / 5)  # directions have variance 2 / 5
    assert np.abs(f @ f.T - kernel).max() < 0.05


def test_rules_are_the_sql(spark):
    con = duckdb.connect()
    con.register("documents", odd(spark).select("doc_id", "text").toPandas())
    got = con.execute(quality_rules.SQL)
    names = [c[0] for c in got.description]
    want = Counter(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in got.fetchall())
    fix = lambda c: Counter({tuple(None if isinstance(v, str) and v == "nan" else int(v) if isinstance(v, float) else v for v in k): n for k, n in c.items()})
    assert fix(rows(quality_rules.judged(odd(spark)))) == fix(want)


def test_rule_order_does_not_change_the_verdict(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = quality_rules.measured(docs)
    assert sorted(names) == sorted(quality_rules.RULES)
    assert rows(quality_rules.judged(docs, order=names)) == rows(quality_rules.judged(docs, order=names[::-1]))


def simple_repeats(words):
    n = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {j for i in range(len(words) - 2) if n[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(hit)


@pytest.mark.parametrize("text", ["a b c a b c", "a a a a", "a b", "", "x y z x y w x y z", "p q r s t p q r"])
def test_repeated_words(text):
    assert quality_rules.repeated_words(text.encode().split()) == simple_repeats(text.split())


def test_encoding_is_the_library(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    got = {r["doc_id"]: r["ids"] for r in sentencepiece_codec.encoded(docs).collect()}
    for r in docs.collect():
        assert got[r["doc_id"]] == lib.encode(r["text"])
    c = sentencepiece_codec.codec(sentencepiece_codec.default_model())
    for t in ["  two  spaces \n\n\tx  y", " " * 50, "a   b    c     ", "hello    world  ", "aaaa" * 500, "漢字かな🎉 é", "\t\t  x", "x\r\ny"]:
        assert c.encode(t) == lib.encode(t)


def test_unigram_path_is_the_best():
    c = sentencepiece_codec.Codec.__new__(sentencepiece_codec.Codec)
    import ahocorasick

    scores = {"a": -3.0, "b": -3.5, "ab": -5.0, "abc": -9.0, "c": -2.0, "bc": -4.0}
    c.automaton, c.by_merges, c.piece = ahocorasick.Automaton(), False, {p: (s, i) for i, (p, s) in enumerate(scores.items())}
    for p, (s, i) in c.piece.items():
        c.automaton.add_word(p, (len(p), s, i))
    c.automaton.make_automaton()
    c.fallback, c.byte_id = -20.0, [100 + b for b in range(256)]

    def best(t):
        if not t:
            return 0.0
        options = [scores[p] + best(t[len(p) :]) for p in scores if t.startswith(p)]
        return max([*options, *([-20.0 + best(t[1:])] if t[0] not in scores else [])])

    names = {i: p for p, (_, i) in c.piece.items()}
    for t in ["abc", "aabbcc", "abcabcab", "cab", "abzc"]:
        ids = c.best_path(t)
        assert sum(scores[names[i]] if i in names else -20.0 for i in ids) == best(t)


def test_encoding_edges_and_round_trip(spark):
    got = sentencepiece_codec.encoded(odd(spark), verify=True)
    assert got.columns == ["doc_id", "x", "ids", "n_tokens", "n_fallback", "round_trip"]
    assert all(r["round_trip"] for r in got.collect())
    back = sentencepiece_codec.decoded(got)
    assert rows(back, "doc_id", "text") == rows(odd(spark), "doc_id", "text")
    assert sentencepiece_codec.encoded(odd(spark).filter("false")).count() == 0


def simple_attribution(ends, sections, rule):
    owner = [next(i for i, e in enumerate(sections) if b < e) for b in range(sections[-1])]
    tokens, crossing, start = [0] * len(sections), [0] * len(sections), 0
    for e in ends:
        n = Counter(owner[start:e])
        home = owner[start] if rule == "start" else min(n, key=lambda s: (-n[s], s))
        tokens[home] += 1
        crossing[home] += len(n) > 1
        start = e
    return tokens, crossing


def test_token_counts_are_brute_force(spark):
    e = token_counts.encoder(token_counts.default_vocabulary(), token_counts.default_pattern())
    texts = [t for t in ODD if t and len(t) < 10_000] + ["a\n\n\nb", "end\n", "\n\n \n x", "one\r\ntwo"]
    for t in texts:
        ends, lines = e.ends(t), token_counts.line_ends(t.encode())
        assert lines[-1] == len(t.encode()) == ends[-1]
        for rule in ("majority", "start"):
            got = token_counts.attributed(ends, lines, rule)
            assert [list(x) for x in got] == [list(x) for x in simple_attribution(ends.tolist(), lines.tolist(), rule)]


def test_token_count_edges(spark):
    got = token_counts.section_tokens(odd(spark)).groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.sum("n_bytes").alias("b"), F.count("*").alias("s"))
    by = {r["doc_id"]: r for r in got.collect()}
    assert len(by) == 12 and by[0]["s"] == by[1]["s"] == 1 and by[0]["n"] == 0 and by[5]["s"] == 3
    assert all(by[i]["b"] == len((t or "").encode()) for i, t in enumerate(ODD))
    assert token_counts.section_tokens(odd(spark).filter("false")).count() == 0


PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href=/x>x</a></ul></nav>"
    "<!-- c --><div class='ad'>buy</div><div>Site line</div><article><h1>Title &amp; more</h1><p>One\n two<br>three<p>{}<ul><li>a<li>b</ul><aside>side</aside></article>"
    "<section class=comments><p>first!</p></section><footer>&copy; z</footer></body></html>"
)


def test_pages(spark):
    pages = [(i, f"https://h.example.org/en/{i}", PAGE.replace("{}", f"para {i}"), "q") for i in range(4)]
    pages += [(10, None, None, "q"), (11, "not a url", "", "q"), (12, "http://a.b/c", "<p>cut off &am", "q"), (12, "http://a.b/c", "<p>cut off &am", "q"), (13, "http://o.x/1", "<div>alone</div><p>x < y", "q"), (None, "http://o.y/1", "<p>" + "long " * 50_000, "q")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, host string")
    got = page_text.extracted(df).collect()
    assert len(got) == len(pages)
    by = {r["page_id"]: r["text"] for r in got}
    for i in range(4):
        assert by[i] == f"Title & more\nOne two\nthree\npara {i}\na\nb"  # the shared line of the site is gone, the article's stay
    assert by[10] == by[11] == "" and by[13] == "alone\nx < y" and len(by[None]) == 249_999
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert page_text.extracted(df.filter("false")).count() == 0


def test_differencing_alone(spark):
    """Pages of one template without article, main, class or id: what the pages share goes, whatever stands in their articles stays."""
    menu = "".join(f"<li>entry {k}" for k in range(5))
    page = "<html><body><div><ul>{m}</ul></div><p>{v} readers so far</p><h1>About {t}</h1>{b}<div>All rights reserved</div><p>Page {v}</p></body></html>"
    body = lambda i: "".join(f"<p>{w} of {'abcdefghijkl'[i]}x</p>" for w in ("beginning", "middle", "end"))
    pages = [(i, f"http://h/{i:02}", page.format(m=menu, v=i * 7, t="abcdefghijkl"[i] * 3, b=body(i))) for i in range(12)]
    pages += [(50 + i, "http://h/05", pages[5][2]) for i in range(3)]  # copies are no evidence against each other
    want = {i: "\n".join([f"About {'abcdefghijkl'[i] * 3}", *(f"{w} of {'abcdefghijkl'[i]}x" for w in ("beginning", "middle", "end"))]) for i in range(12)}
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in page_text.extracted(df, hints=False).collect()}
    assert {i: got[i] for i in want if i != 5} == {i: t for i, t in want.items() if i != 5}


def simple_pages(pages, near=page_text.NEAR):
    """(page_id, text) by plain loops over all pages of a host in order."""
    rows = sorted(pages, key=lambda r: (r[1], r[0], r[2]))
    lines = [page_text.lines_of(r[2]) for r in rows]
    common = [set() for _ in rows]
    for i in range(len(rows)):
        for j in range(i + 1, min(len(rows), i + 1 + near)):
            if rows[i][1].split("/")[2] == rows[j][1].split("/")[2]:
                one, two = page_text.paired([x for x, _ in lines[i]], [x for x, _ in lines[j]])
                common[i] |= one
                common[j] |= two
    return {r[0]: "\n".join(x for k, (x, _) in enumerate(own) if k not in c) for r, own, c in zip(rows, lines, common, strict=True)}


@pytest.mark.parametrize("parts", [1, 7, 211])
def test_ranges_do_not_change_the_text(spark, parts):
    pages = [(i, f"http://h{i % 4}/{i:03}", f"<div>top {i % 3}</div><p>own {'xyzw'[i % 4] * (1 + i % 5)}</p><div>{'foot' if i % 6 else 'feet'}</div><p>{chr(97 + i % 26)}</p>") for i in range(90)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = page_text.extracted(spark.createDataFrame(pages, "page_id long, url string, html string"), hints=False).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r["page_id"]: r["text"] for r in got} == simple_pages(pages)


@pytest.mark.parametrize("script", ["for(i=0;i<n;i++){}", "a='it\"s <b", "<!-- x", "if(a<b){c='</p>'}"])
def test_scripts_end_at_their_end_tag(script):
    lines = page_text.lines_of(f"<body><p>one</p><script>{script}</script><p>two</p><style>a<b{{}}</style>three</body>")
    assert [x for x, _ in lines] == ["one", "two", "three"]


def simple_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_shared_lines_are_a_longest_common_subsequence():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = (["abcdef"[k] for k in rng.integers(0, 6, rng.integers(0, 14))] for _ in range(2))
        x, y = page_text.shared(a, b)
        assert [a[i] for i in sorted(x)] == [b[i] for i in sorted(y)] and len(x) == simple_lcs(a, b)


def test_alignment_in_halves(monkeypatch):
    monkeypatch.setattr(page_text, "TABLE", 16)
    test_shared_lines_are_a_longest_common_subsequence()


def test_pages_of_the_test_data(spark):
    import html
    import re

    def simple(page):
        m = re.search(r"<article>(.*?)(</article>|$)", page, re.S)
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*(>|$)", "", x))).strip() for x in re.split(r"</?(?:p|h1|br)[^>]*>", m[1])] if m else []
        return "\n".join(x for x in parts if x)

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in page_text.extracted(pages).collect()}
    assert all(got[r["page_id"]] == simple(r["html"]) for r in pages.collect())
