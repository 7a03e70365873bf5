"""Greedy rules that SQL of another engine cannot express, against plain loops over the same tables."""

from collections import defaultdict

import pytest

from sheafline.catalog import apply
from sheafline.relations import frame

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    made = {}
    for name in ("boxes", "segments", "items", "chain_candidates", "words", "lines"):
        frame(spark, SF, name, made)
    return made


def grouped(df, *keys):
    out = defaultdict(list)
    for r in df.collect():
        out[tuple(r[k] for k in keys)].append(r)
    return out


def test_nested_rects(tables):
    want = set()
    for key, g in grouped(tables["boxes"], "doc_id", "page").items():
        kept = []
        for r in sorted(g, key=lambda r: (-(r["x1"] - r["x0"]) * (r["y1"] - r["y0"]), r["box_id"])):
            if not any(r["x0"] >= k["x0"] - 1 and r["x1"] <= k["x1"] + 1 and r["y0"] >= k["y0"] - 1 and r["y1"] <= k["y1"] + 1 for k in kept):
                kept.append(r)
                want.add((*key, r["box_id"]))
    assert {(r["doc_id"], r["page"], r["box_id"]) for r in apply("c_drop_nested_rects", boxes=tables["boxes"]).collect()} == want


def test_merged_batches(tables):
    want = set()
    for g in grouped(tables["segments"], "doc_id", "q_num", "is_solution").values():
        kept = []
        for r in sorted(g, key=lambda r: (r["page"], r["y0"], r["y1"], r["item"], r["seg"])):
            if not any(k["page"] == r["page"] and abs(k["y0"] - r["y0"]) < 3 and abs(k["y1"] - r["y1"]) < 3 for k in kept):
                kept.append(r)
        want |= {(r["doc_id"], r["item"], r["seg"]) for r in kept}
    assert {(r["doc_id"], r["item"], r["seg"]) for r in apply("d_merge_batches", segments=tables["segments"]).collect()} == want


def test_recovered_chains(tables):
    want = set()
    found = grouped(tables["chain_candidates"], "doc_id", "is_solution")
    for key, g in grouped(tables["items"], "doc_id", "is_solution").items():
        have = {int(r["q_num"]) for r in g}
        candidates = {r["num"] for r in found.get(key, [])}
        if len(have) >= 3:
            for n in range(min(have), max(have)):
                if n not in have and n in candidates and (n - 1 in have or n + 1 in have):
                    have.add(n)
                    want.add((*key, n))
    got = apply("e_recover_chain", items=tables["items"], chain_candidates=tables["chain_candidates"])
    assert want and {(r["doc_id"], r["is_solution"], r["num"]) for r in got.collect()} == want


def test_baseline_lines(tables):
    want = []
    for key, g in grouped(tables["words"], "doc_id", "page").items():
        kept = []
        for r in sorted(g, key=lambda r: (r["y0"], r["x0"], r["y1"], r["seq"], r["pos"])):
            last = kept[-1] if kept else None
            if last and abs((r["y0"] + r["y1"]) / 2 - (last[0] + last[1]) / 2) <= 0.45 * max(r["y1"] - r["y0"], last[1] - last[0]):
                kept[-1] = (min(r["y0"], last[0]), max(r["y1"], last[1]), last[2] + 1)
            else:
                kept.append((r["y0"], r["y1"], 1))
        want += [(*key, *k) for k in kept]
    got = apply("d_baseline_lines", words=tables["words"])
    assert sorted((r["doc_id"], r["page"], r["y0"], r["y1"], r["n"]) for r in got.collect()) == sorted(want)


def columns(spans, width=640, bins=200):
    """Columns of one page by the rule as the survey states it."""
    w, n = width / bins, [0] * (bins + 1)
    for a, b in spans:
        for i in range(max(0, int(a / w)), min(bins - 1, int(b / w)) + 1):
            n[i] += 1
    dense = [i for i in range(bins) if n[i] > max(1.0, 0.18 * max(n))]
    cores = []
    for i in dense:
        if cores and i - cores[-1][1] - 1 < 6:
            cores[-1][1] = i
        else:
            cores.append([i, i])
    while len(cores) > 1:
        sizes = [e - s + 1 for s, e in cores]
        k = sizes.index(min(sizes))
        if sizes[k] >= 24:
            break
        left = k == len(cores) - 1 or k and cores[k][0] - cores[k - 1][1] <= cores[k + 1][0] - cores[k][1]
        j = k - 1 if left else k
        cores[j : j + 2] = [[cores[j][0], cores[j + 1][1]]]
    edges = [0.0, *((a[1] + 1 + b[0]) / 2 * w for a, b in zip(cores, cores[1:], strict=False)), float(width)]
    return list(zip(edges, edges[1:], strict=False))


def test_detected_columns(spark):
    pages = {
        1: [(32, 288)] * 5 + [(352, 608)] * 5,
        2: [(32, 608)] * 6,
        3: [(32, 180)] * 5 + [(230, 400)] * 5 + [(450, 608)] * 4,
        4: [(32, 280)] * 6 + [(310, 330)] * 4 + [(360, 600)] * 6,
        5: [(32, 60)] * 4 + [(100, 300)] * 4 + [(352, 608)] * 4,
        6: [(32, 200)] * 9 + [(300, 600)],
    }
    rows = [(1, p, i, 10.0 * i, 10.0 * i + 8, float(a), float(b), "x") for p, spans in pages.items() for i, (a, b) in enumerate(spans)]
    df = spark.createDataFrame(rows, "doc_id long, page int, seq long, y_top double, y_bottom double, x_left double, x_right double, text string")
    got = defaultdict(list)
    for r in apply("d_detect_columns", page_lines=df).orderBy("page", "col").collect():
        got[r["page"]].append((r["x0"], r["x1"]))
    assert {p: [tuple(round(x, 6) for x in c) for c in v] for p, v in got.items()} == {p: [tuple(round(x, 6) for x in c) for c in columns(s)] for p, s in pages.items()}
