"""Review rules on literal items, on both sides of their limits."""

from sheafline.catalog import apply

SEGMENT = "doc_id long, item long, seg int, q_num string, is_solution boolean, page int, y0 double, y1 double, x0 double, x1 double"
ITEM = "doc_id long, item long, q_num string, is_solution boolean, page int, option_labels string, n_segments long, is_hindi boolean"
LINE = "doc_id long, page int, seq long, y0 double, y1 double, x0 double, x1 double, text string"


def tables(spark, items, lines=()):
    """items: (number, side, labels, [(page, y0, y1[, x0, x1])...])"""
    segs, rows = [], []
    for i, (q, sol, labels, parts) in enumerate(items, 1):
        rows.append((1, i, q, sol, parts[0][0], labels, len(parts), None))
        segs += [(1, i, k, q, sol, p, float(y0), float(y1), *(map(float, x) if x else (5.0, 95.0))) for k, (p, y0, y1, *x) in enumerate(parts)]
    text = [(1, p, k, float(y0), float(y1), *(map(float, x) if x else (10.0, 90.0)), "words") for k, (p, y0, y1, *x) in enumerate(lines)]
    return {
        "segments": spark.createDataFrame(segs, SEGMENT), "items": spark.createDataFrame(rows, ITEM), "lines_pct": spark.createDataFrame(text, LINE),
        "key_pairs": spark.createDataFrame([(1, n, "A") for n in (1, 2)], "doc_id long, num int, letter string"), "paper_pages": spark.createDataFrame([(1, 1, 1), (2, 1, 1)], "doc_id long, page int, last_page int"),
    }


def reasons(spark, items, lines=()):
    return {r["item"]: r["reason"] for r in apply("d_flag_items", **tables(spark, items, lines)).collect()}


def scores(spark, items, lines=()):
    return {r["item"]: r["confidence"] for r in apply("d_confidence", **tables(spark, items, lines)).collect()}


def test_shapes(spark):
    """One page each. The median is 20: short is under 9, tall over 38 and from 55 on; the page's edge is at 92."""
    parts = [(1, 20, 40), (2, 20, 40), (3, 20, 40), (4, 20, 28.9), (5, 20, 29.1), (6, 10, 64.9), (7, 10, 65), (8, 57, 92), (9, 56, 92), (10, 72, 91.9), (11, 20, 23.9)]
    items = [(str(n), False, "", [p]) for n, p in enumerate(parts, 1)]
    got = reasons(spark, items)
    assert {n: got[n] for n in (4, 7, 8, 11)} == {4: "shorter than the others", 7: "taller than the others", 8: "ends at the page edge", 11: "shorter than the others"}
    assert all(got[n] is None for n in (1, 2, 3, 5, 6, 9, 10))
    conf = scores(spark, items)
    assert {n: conf[n] for n in (1, 4, 5, 6, 7, 8, 9, 11)} == {1: 1.0, 4: 0.5, 5: 1.0, 6: 1.0, 7: 0.6, 8: 0.3, 9: 1.0, 11: 0.2}


def test_a_lone_item_has_no_median_to_be_short_of(spark):
    assert reasons(spark, [("1", False, "", [(1, 20, 23.9)])]) == {1: "very small"} and reasons(spark, [("1", False, "", [(1, 20, 24)])]) == {1: None}


def test_all_options_and_solutions(spark):
    items = [(str(n), n > 4, labels, [(n, 20, 40)]) for n, labels in enumerate(["ABCD", "AB", "A", "ACD", "AB", "BCD"], 1)]
    assert reasons(spark, items) == {1: None, 2: "options may be missing", 3: None, 4: "options may be missing", 5: None, 6: None}
    short = [("9", False, "ABCD", [(9, 20, 25)]), *[(str(n), False, "", [(n, 20, 40)]) for n in (1, 2, 3)]]
    assert reasons(spark, short)[1] is None  # short, but with all its options


def test_uncovered_text(spark):
    one = [("1", False, "", [(1, 30, 50)]), ("2", False, "", [(2, 30, 50)])]
    assert reasons(spark, one, [(1, 52, 56), (1, 57, 61)])[1] == "text below is not covered"  # a band of 8
    assert reasons(spark, one, [(1, 52, 56), (1, 57, 60.9)])[1] is None
    assert reasons(spark, one, [(1, 64.1, 70), (1, 71, 80)])[1] is None  # begins over 14 away
    assert reasons(spark, one, [(1, 52, 56, 96, 100), (1, 57, 61, 96, 100)])[1] is None  # another column
    assert reasons(spark, one, [(1, 90, 99), (1, 52, 54)])[1] is None  # beyond the body
    assert reasons(spark, one, [(1, 20, 22)])[1] == "text above is not covered" and reasons(spark, one, [(1, 20, 21.9)])[1] is None
    assert reasons(spark, one, [(1, 4, 7)])[1] is None  # in the margin
    two = [("1", False, "", [(1, 30, 50)]), ("2", False, "", [(1, 60, 80)])]
    assert reasons(spark, two, [(1, 20, 25)]) == {1: "text above is not covered", 2: None}  # the topmost of the column
    assert scores(spark, one, [(1, 52, 61), (1, 20, 25)])[1] == 0.2


def test_orphans(spark):
    items = [("1", False, "", [(1, 20, 40, 5, 48)])]
    pages = lambda lines: {r["page"] for r in apply("d_orphan_pages", **tables(spark, items, lines)).collect()}
    assert pages([(1, 20, 24, 55, 90), (1, 30, 32, 55, 90)]) == {1}  # the uncovered half beside a crop
    assert pages([(1, 20, 24, 55, 90), (1, 30, 31.9, 55, 90)]) == set()
    assert pages([(1, 41, 48, 10, 40)]) == set() and pages([(1, 55, 62, 10, 40)]) == {1}  # near the crop, and far from it
    assert pages([(2, 1, 5), (2, 95, 99)]) == set() and pages([(2, 50, 56)]) == {2}


def notes(spark, items):
    got = apply("d_review_notes", **tables(spark, items)).collect()
    return sorted((r["doc_id"], r["kind"], r["message"]) for r in got)


def test_notes(spark):
    item = lambda n, page: (str(n), False, "", [(page, 20, 40)])
    gap = lambda *nums: [m for _, k, m in notes(spark, [item(n, i) for i, n in enumerate(nums)]) if k == "gap" and "missing" in m]
    assert gap(1, 2, 5) == ["questions may be missing: 003, 004"]
    assert gap(1, 5) == []  # two numbers are no run
    assert gap(1, 2, 90) == []  # too many holes
    assert gap(1, 2, 8) == ["questions may be missing: 003, 004, 005, 006, 007"]
    assert gap(1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 20) == ["questions may be missing: 011, 012, 013, 014, 015, 016, 017, 018 and 1 more"]
    got = notes(spark, [item(2, 1), item(2, 2)])
    assert (1, "duplicate", "Q2 appears again") in got and (1, "gap", "in the key but not found: 001") in got and (2, "low_confidence", "nothing was found") in got


def test_a_summary_tells_what_needs_review(spark):
    one = apply("d_job_summary", c_bilingual_exact=spark.createDataFrame([(1,)], "doc_id long"), **tables(spark, [("1", False, "", [(1, 20, 40)]), ("2", False, "", [(2, 20, 40)])])).collect()[0]
    assert (one["total"], one["needs_review"], one["two_languages"], one["answered"]) == (2, False, True, 2)
    assert apply("d_job_summary", c_bilingual_exact=spark.createDataFrame([], "doc_id long"), **tables(spark, [("1", False, "", [(1, 20, 23)])])).collect()[0]["needs_review"]
