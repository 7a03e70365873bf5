"""The clean-up of markers on literal pages, from lines to segments."""

import pytest

from sheafline.catalog import apply

LINE = "doc_id long, page int, seq long, y_top double, y_bottom double, x_left double, x_right double, text string"
FIGURE = "doc_id long, page int, fig_id long, x0 double, x1 double, y0 double, y1 double, kind string, n_rows int, n_columns int"


def frame(spark, rows):
    """rows of (page, y, text), (page, y, text, x0, x1) or with a height after those"""
    out = []
    for i, (page, y, text, *more) in enumerate(rows):
        x0, x1, h = (*more, 50.0, 290.0, 15.0)[: 3] if not more else (*more, 15.0)[:3]
        out.append((1, page, i, float(y), y + h, float(x0), float(x1), text))
    return spark.createDataFrame(out, LINE)


def run(spark, name, rows, width=640, height=800):
    df = frame(spark, rows)
    return apply(name, {"page_width": width, "page_height": height}, page_lines=df, figures=spark.createDataFrame([], FIGURE)).collect()


def crops(spark, rows, **size):
    out = {}
    for r in sorted(run(spark, "d_segments", rows, **size), key=lambda r: (r["page"], r["col"])):
        out.setdefault(("S" if r["is_solution"] else "Q") + r["q_num"], []).append(tuple(round(r[c], 2) for c in ("x0", "x1", "y0", "y1")))
    return out


def test_columns_from_markers_crop_their_own_half(spark):
    """Lines across both columns hide the gutter from the density of lines; six markers in two columns show it."""
    rows = []
    for c, x in ((0, 32), (1, 352)):
        for k in range(3):
            y = 100 + 200 * k
            rows += [(1, y, f"{3 * c + k + 1}. What is meant by it", x, x + 256), (1, y + 20, "as it was said", x + 10, x + 256)]
    rows += [(1, 60 + 180 * k, f"{'abcd'[k]} broad remark {'wxyz'[k]} across both", 32, 608) for k in range(4)]
    got = crops(spark, rows)
    assert set(got) == {f"Q{n}" for n in range(1, 7)}
    assert all({s[:2] for s in got[f"Q{n}"]} == {(4.5, 54.06) if n <= 3 else (54.5, 95.5)} for n in range(1, 7))
    assert got["Q3"][0][3] < 80 and got["Q4"] == [(54.5, 95.5, 12.5, 16.88)]


def test_marker_columns_end_at_the_page(spark):
    rows = [(1, 100 + 100 * k, f"{k + 1}. text here", 32 if k < 2 else 352, 600) for k in range(4)]
    got = sorted((r["col"], r["x0"], r["x1"]) for r in run(spark, "d_columns_from_markers", rows))
    assert got == [(0, 0.0, 346.0), (1, 346.0, 640.0)]
    assert run(spark, "d_columns_from_markers", [(1, 100, "1. a word"), (1, 200, "2. a word", 352, 600)]) == []


def test_one_strong_marker_of_eight_drops_none(spark):
    rows = [(1, 100 + 50 * k, f"{k + 1}. a question") for k in range(7)] + [(1, 500, "Q8 a question")]
    assert len(run(spark, "d_strong_filter", rows)) == 8
    assert sorted(r["q_num"] for r in run(spark, "d_strong_filter", rows + [(1, 550, "Q9 another")])) == ["8", "9"]


def stems(*numbers):
    return [x for k, n in enumerate(numbers) for x in ((1, 100 + 100 * k, f"{n}. A question's stem"), (1, 120 + 100 * k, "(A) a  (B) b  (C) c  (D) d"))]


def test_a_misread_number_is_recovered(spark):
    got = crops(spark, stems(18, 19, "2O", 21, 22), width=600, height=1000)
    assert sorted(got) == ["Q18", "Q19", "Q20", "Q21", "Q22"]
    assert got["Q20"][0][2:] == (30.0, 33.5) and got["Q19"][0][3] == 23.5


def test_a_run_of_missing_numbers_is_recovered_in_order(spark):
    """Each recovered line bounds the next: "I3" stands before 12 and is not taken."""
    rows = stems(6, 7, 8, 9, 10, "l1", "I3", "1Z", "l3", "1A", 15, 16, 17, 18)
    found = sorted((r["num"], r["y_top"]) for r in run(spark, "e_recover_chain", rows, 600, 1600))
    assert found == [(11, 600.0), (12, 800.0), (13, 900.0), (14, 1000.0)]
    assert {f"Q{n}" for n in range(6, 19)} == set(crops(spark, rows, width=600, height=1600))


def test_sparse_numbers_recover_nothing(spark):
    rows = [(1, 100, "3. stem"), (1, 300, "40. stem"), (1, 400, "4l stem"), (1, 500, "77. stem")]
    assert run(spark, "e_recover_chain", rows, 600, 1000) == []
    assert set(crops(spark, rows, width=600, height=1000)) == {"Q3", "Q40", "Q77"}


def test_two_numbers_and_no_key_recover_nothing(spark):
    assert run(spark, "e_recover_chain", stems(1, "Z", 3)) == []


def test_the_key_names_numbers_beyond_the_run(spark):
    rows = [*stems(1, 2, 3, "A", "S"), (2, 100, "Answer Key"), (2, 130, "1-B  2-A  3-D  4-C  5-A")]
    assert sorted(r["num"] for r in run(spark, "e_recover_chain", rows)) == [4, 5]
    assert set(crops(spark, rows)) >= {"Q1", "Q2", "Q3", "Q4", "Q5"}


def test_a_number_before_a_stop_inside_the_first_word_counts(spark):
    assert [(r["num"], r["y_top"]) for r in run(spark, "e_recover_chain", stems(1, 2, "3.2.5mL", 4, 5))] == [(3, 300.0)]


def test_solutions_have_a_run_of_their_own(spark):
    rows = [*stems(1, 2, 3), (1, 420, "Solutions"), *[(1, 450 + 40 * k, f"{n}. as shown") for k, n in enumerate((1, "Z", 3, 4))]]
    assert [(r["is_solution"], r["num"]) for r in run(spark, "e_recover_chain", rows)] == [(True, 2)]


def test_numbered_options_are_no_questions(spark):
    rows = []
    for k, n in enumerate((5, 6, 7, 8)):
        rows += [(1, 60 + 150 * k, f"{n}. Which one", 48, 290)] + [(1, 80 + 150 * k + 20 * o, f"{o}. choice", 68, 290) for o in (1, 2, 3, 4)]
    assert set(crops(spark, rows)) == {"Q5", "Q6", "Q7", "Q8"}
    lettered = [(1, 100 + 50 * k, f"{k + 1}. text", 48 + 20 * (k % 2), 290) for k in range(5)]
    assert len(run(spark, "d_drop_numbered_options", lettered)) == 5  # no number is too high for an option: nothing to go by


def test_cells_of_a_key_are_no_items(spark):
    rows = [*stems(1, 2, 3), *[(2, 100, f"{n}. ({c})", 40 + 80 * n, 100 + 80 * n) for n, c in enumerate("BCAD", 1)], (2, 300, "7. (B)")]
    got = sorted((r["page"], r["q_num"]) for r in run(spark, "c_drop_key_cells", rows))
    assert got == [(1, "1"), (1, "2"), (1, "3"), (2, "7")]


def test_close_twins_are_one_compared_with_the_last_kept(spark):
    rows = [(1, y, "4. twin") for y in (100.0, 101.5, 103.0, 104.5)] + [(1, 200, "5. other"), (1, 300, "4. far")]
    assert sorted(r["y_top"] for r in run(spark, "e_dedupe_close", rows)) == [100.0, 103.0, 200.0, 300.0]


def two_columns(title, page=1, first=(1, 2), second=(5, 6), strong=""):
    rows = [(page, 30 + 10 * k, t, *x) for k, (t, *x) in enumerate(title)]
    for x, numbers in ((45, first), (320, second)):
        for k, n in enumerate(numbers):
            y = 120 + 250 * k
            rows += [(page, y, f"{strong}{n}. A stem that runs on", x, x + 230)] + [(page, y + 40 + 30 * o, f"({'PQRST'[o]}) text of it", x + 18, x + 230) for o in range(5)]
    return rows


def tops(got):
    return {k: min(s[2] for s in v) for k, v in got.items()}


@pytest.mark.parametrize("strong", ["", "Q"])
@pytest.mark.parametrize("x", [(40, 555), (320, 550)])
def test_a_title_across_or_over_a_later_column_is_a_banner(spark, x, strong):
    rows = two_columns([("Quiz of the last week", *x), ("Vectors and scalars", *x)], strong=strong)
    got = crops(spark, rows, width=595, height=842)
    assert set(got) == {"Q1", "Q2", "Q5", "Q6"} and min(tops(got).values()) > 10
    assert all(s[0] > 45 for n in ("Q5", "Q6") for s in got[n]) and all(s[1] < 50 for n in ("Q1", "Q2") for s in got[n])


def test_what_flows_in_from_an_earlier_page_is_kept(spark):
    """Above the leftmost column's first marker of a later page stands the tail of the last question before it."""
    rows = two_columns([], 1) + two_columns([("the tail of question six", 45, 275)], 2, (7, 8), (9, 10))
    assert [s[2] for s in crops(spark, rows, width=595, height=842)["Q6"]][-1] < 5
    strong = two_columns([], 1, strong="Q") + two_columns([("the tail of question six", 45, 275)], 2, (7, 8), (9, 10), "Q")
    assert len(crops(spark, strong, width=595, height=842)["Q6"]) == 1  # a page with Q markers loses all its sparse top


def test_dense_tops_and_options_above_are_no_banners(spark):
    dense = two_columns([(f"remark of some kind {'abcde'[k]}", 320, 550) for k in range(5)])
    assert run(spark, "d_banner_headers", dense, 595, 842) == []
    option = two_columns([("(D) none of them", 320, 550), ("Vectors", 320, 550)])
    assert run(spark, "d_banner_headers", option, 595, 842) == []
    low = [(p, y + 120 if y >= 100 else y, *r) for p, y, *r in two_columns([("Vectors", 320, 550)])]
    assert run(spark, "d_banner_headers", low, 595, 842) == []
