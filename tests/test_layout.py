"""Words, languages, numbers, alignment, frames and furniture on literal rows."""

import pytest

from sheafline.catalog import apply
from sheafline.relations import SETTINGS

WORD = "doc_id long, page int, block int, par int, line int, pos long, word string, conf double, x0 double, x1 double, y0 double, y1 double"
SEGMENT = "doc_id long, item long, seg int, q_num string, is_solution boolean, page int, y0 double, y1 double, x0 double, x1 double"
ITEM = "doc_id long, item long, q_num string, is_solution boolean, is_hindi boolean"
LINE = "doc_id long, page int, seq long, y_top double, y_bottom double, x_left double, x_right double, text string"


def words(spark, rows):
    """rows of (row, word number, word, left, width[, paragraph])"""
    out = [(1, 1, 1, par[0] if par else 1, row, n, w, 95.0, float(x), float(x + width), 100.0 + 72 * row, 118.0 + 72 * row) for row, n, w, x, width, *par in rows]
    return spark.createDataFrame(out, WORD)


def two_columns(rows=4):
    out = []
    for r in range(rows):
        out += [(r, 0, f"{r + 1}.", 60, 30), (r, 1, "left", 110, 60), (r, 2, "stem", 180, 60), (r, 3, f"{r + 5}.", 520, 30), (r, 4, "right", 570, 70), (r, 5, "stem", 650, 60)]
    return out


def read(df, **settings):
    return sorted((r["col"], r["y0"], r["text"], r["x0"], r["x1"]) for r in apply("d_words_to_lines", settings, words=df).collect())


def test_rows_read_across_the_gutter_are_cut(spark):
    got = read(words(spark, two_columns()))
    assert [t for _, _, t, *_ in got] == [f"{n}. left stem" for n in (1, 2, 3, 4)] + [f"{n}. right stem" for n in (5, 6, 7, 8)]
    assert all(x1 < 300 for c, _, _, _, x1 in got if c == 0) and all(x0 >= 520 for c, _, _, x0, _ in got if c == 1)


def test_few_words_make_one_column(spark):
    assert [t for _, _, t, *_ in read(words(spark, two_columns(1)))] == ["1. left stem 5. right stem"]
    assert len(read(words(spark, two_columns(2)))) == 4 and len(read(words(spark, two_columns(2)), words_for_columns=13)) == 2


def test_paragraphs_stay_apart_and_bad_words_are_left_out(spark):
    df = words(spark, [(0, 0, "a", 60, 30, 1), (0, 1, "b", 100, 30, 2), (1, 1, "d", 100, 0), (1, 0, "c", 60, 30)])
    bad = df.limit(1).selectExpr("doc_id", "page", "block", "par", "line", "9L AS pos", "' ' AS word", "conf", "x0", "x1", "y0", "y1").union(df.limit(1).selectExpr("doc_id", "page", "block", "par", "line", "8L AS pos", "'low'", "-1.0D", "x0", "x1", "y0", "y1"))
    assert sorted(t for _, _, t, *_ in read(df.union(bad))) == ["a", "b", "c d"]


def test_next_numbers(spark):
    """Questions 1 and 2 in both languages, 3 in the first and 4 in the second only (by its half of the page); no solutions."""
    rows = [(1, "1", 10, None), (2, "1", 60, None), (3, "2", 60, False), (4, "2", 60, True), (5, "3", 10, None), (6, "Q4", 60, None), (7, "x", 10, None)]
    items = spark.createDataFrame([(1, i, q, False, h) for i, q, _, h in rows], ITEM)
    segs = spark.createDataFrame([(1, i, 0, q, False, 1, 0.0, 9.0, float(x), x + 30.0) for i, q, x, _ in rows], SEGMENT)
    got = {(r["is_solution"], r["mode"]): r["next_number"] for r in apply("d_next_number", items=items, segments=segs).collect()}
    assert got == {(False, "plain"): 5, (False, "paired"): 4, (False, "first"): 4, (False, "second"): 3, **{(True, m): 1 for m in ("plain", "paired", "first", "second")}}
    both = apply("d_next_number", items=items.filter("item <= 4"), segments=segs)
    assert {r["mode"]: r["next_number"] for r in both.collect() if not r["is_solution"]} == {"plain": 3, "paired": 3, "first": 3, "second": 3}


#: 1: a pair side by side. 2: one item with both. 3: alone on the right. 4: alone, marked. 5: a pair told by its marks.
PARTS = [(1, "1", 55, None), (2, "1", 5, None), (3, "2", 5, None), (4, "3", 55, None), (5, "4", 5, True), (6, "5", 5, True), (7, "5", 60, False)]


@pytest.mark.parametrize(
    ("mode", "want"),
    [
        ("first", {("1", "first", 2, None), ("2", "first", 3, None), ("3", "first", 4, None), ("4", "second", 5, None), ("5", "first", 7, None)}),
        ("second", {("1", "second", 1, None), ("2", "second", 3, None), ("3", "second", 4, None), ("4", "second", 5, None), ("5", "second", 6, None)}),
        ("separate", {("1", "first", 2, None), ("1", "second", 1, None), ("2", "first", 3, None), ("2", "second", 3, None), ("3", "second", 4, None), ("4", "second", 5, None), ("5", "first", 7, None), ("5", "second", 6, None)}),
        ("horizontal", {("1", "both", 2, 1), ("2", "both", 3, 3), ("3", "second", 4, None), ("4", "second", 5, None), ("5", "both", 7, 6)}),
        ("vertical", {("1", "both", 2, 1), ("2", "both", 3, 3), ("3", "second", 4, None), ("4", "second", 5, None), ("5", "both", 7, 6)}),
    ],
)
def test_languages(spark, mode, want):
    items = spark.createDataFrame([(1, i, q, False, h) for i, q, _, h in PARTS], ITEM)
    segs = spark.createDataFrame([(1, i, 0, q, False, 1, 10.0, 20.0, float(x), x + 35.0) for i, q, x, _ in PARTS], SEGMENT)
    other = segs.filter("item = 3").drop("q_num", "is_solution")
    got = apply("d_language_partition", {"language_mode": mode}, items=items, segments=segs, other_segments=other).collect()
    assert {(r["q_num"], r["lang"], r["item"], r["beside"]) for r in got} == want
    assert {r["name"] for r in got if r["lang"] != "second"} <= {f"EQ{n}" for n in range(1, 6)} and {r["name"] for r in got if r["lang"] == "second"} <= {f"HQ{n}" for n in range(1, 6)}
    assert {r["q_num"] for r in got if r["uses_other_segments"]} == (set() if mode == "first" else {"2"})


def test_margins_align_by_page(spark):
    """Page 1's left margin is at 60, page 2's at 80 and its right one at 380; two stray lines are no margin."""
    edge = [(1, x) for x in (60, 62, 61, 110)] + [(2, x) for x in (80, 80, 81, 130, 380, 381, 379)] + [(2, 2)]
    lines = spark.createDataFrame([(1, p, k, 10.0 * k, 10.0 * k + 8, float(x), x + 100.0, "text") for k, (p, x) in enumerate(edge)], LINE)
    seg = lambda item, *parts: [(d, item, k, "1", False, p, 0.0, 9.0, x, 90.0) for k, (d, p, x) in enumerate(parts)]
    rows = seg(1, (1, 1, 10.0), (1, 2, 10.0), (1, 2, 60.0)) + seg(2, (1, 2, 12.5), (1, 1, 30.0)) + seg(3, (1, 3, 10.0), (1, 3, 11.0)) + seg(4, (2, 1, 10.0), (2, 1, 13.0), (2, 1, 40.0), (2, 1, 52.0), (2, 1, 39.0))
    got = {(r["item"], r["seg"]): (r["dx"], r["rule"]) for r in apply("d_align_offsets", page_lines=lines, segments=spark.createDataFrame(rows, SEGMENT)).collect()}
    m = lambda x: x / 640 * 100
    assert got[1, 0] == (0.0, "margins") and got[1, 1][0] == pytest.approx(round((10 - m(80)) - (10 - m(61)), 2)) and got[1, 2][0] == pytest.approx(round((60 - m(380)) - (10 - m(61)), 2))
    assert got[2, 1] == (15.0, "margins") and got[3, 1] == (1.0, "margins")
    assert [got[4, k] for k in range(5)] == [(0.0, "segments"), (3.0, "segments"), (0.0, "segments"), (10.0, "segments"), (-1.0, "segments")]


STROKE = "doc_id long, page int, stroke_id long, x0 double, x1 double, y0 double, y1 double, is_rect boolean"


def strokes(spark, *rows):
    return spark.createDataFrame([(1, 1, k, *(float(v) for v in r[:4]), len(r) > 4) for k, r in enumerate(rows)], STROKE)


FRAME = [(55, 55, 200, 320), (540, 540, 200, 320), (55, 540, 200, 200)]  # two sides and a top: x0, x1, y0, y1


def frames(spark, *rows):
    return sorted((r["x0"], r["y0"], r["x1"], r["y1"]) for r in apply("c_content_boxes", {"page_width": 595, "page_height": 842}, strokes=strokes(spark, *rows)).collect())


def test_frames(spark):
    assert frames(spark, *FRAME) == frames(spark, *FRAME, (55, 540, 320, 320)) == [(55.0, 200.0, 540.0, 320.0)]
    assert frames(spark, *FRAME[:2]) == []  # nothing joins the sides
    assert frames(spark, FRAME[0], (540, 540, 208, 320), FRAME[2]) == []  # corners 8 apart
    assert frames(spark, (50, 300, 400, 500, True)) == [(50.0, 400.0, 300.0, 500.0)] and frames(spark, (50, 300, 400, 500)) == []
    assert frames(spark, (50, 300, 400, 424, True)) == []  # too low
    assert frames(spark, *FRAME, (60, 500, 210, 300, True)) == [(55.0, 200.0, 540.0, 320.0)]  # inside the other
    assert frames(spark, *FRAME, (60, 590, 210, 300, True)) == [(55.0, 200.0, 540.0, 320.0), (60.0, 210.0, 590.0, 300.0)]


def furniture(spark, lines=(), links=(), images=(), rules=()):
    kinds = {"links": "doc_id long, page int, link_id long, x0 double, x1 double, y0 double, y1 double, uri string", "placed_images": "doc_id long, page int, image_id long, x0 double, x1 double, y0 double, y1 double"}
    tables = {
        "page_lines": spark.createDataFrame([(1, 1, k, *map(float, r[:4]), r[4]) for k, r in enumerate(lines)], LINE),
        "links": spark.createDataFrame([(1, 1, k, *map(float, r[:4]), r[4]) for k, r in enumerate(links)], kinds["links"]),
        "placed_images": spark.createDataFrame([(1, 1, k, *map(float, r)) for k, r in enumerate(images)], kinds["placed_images"]), "strokes": strokes(spark, *rules),
    }
    got = apply("c_furniture_rects", {"page_width": 595, "page_height": 842}, **tables).collect()
    return sorted((r["kind"], r["x0"], r["y0"]) for r in got)


def test_pictures_beside_branding_rows(spark):
    """Links at 700 to 712 and 725 to 735 are one row (2 per cent of the page is 16.8); one at 300 is another."""
    links = [(40, 90, 700, 712, "https://bit.ly/x"), (100, 150, 725, 735, "https://bit.ly/y"), (40, 90, 300, 310, "https://bit.ly/z"), (40, 90, 500, 510, "https://example.org")]
    images = [(10, 20, 714, 722), (10, 20, 751, 760), (10, 20, 753, 760), (10, 20, 326, 340), (10, 20, 327, 340), (10, 20, 500, 510), (0, 595, 250, 842)]
    got = furniture(spark, links=links, images=images)
    assert [x for x in got if x[0] == "image"] == [("image", 10.0, 326.0), ("image", 10.0, 714.0), ("image", 10.0, 751.0)]
    assert len([x for x in got if x[0] == "link"]) == 3


def test_furniture_text_and_rules(spark):
    lines = [(100, 112, 60, 300, "A real line of text"), (800, 812, 290, 310, "4/5"), (400, 412, 290, 310, "4/5"), (30, 42, 60, 200, "Download App now")]
    rules = [(40, 555, 140, 140), (60, 300, 114, 114), (70, 100, 200, 201), (20, 20, 300, 500), (20, 20, 600, 700), *FRAME]
    got = furniture(spark, lines=lines, rules=rules, images=[(210, 230, 30, 42)])
    assert [x for x in got if x[0] == "text"] == [("text", 60.0, 30.0), ("text", 290.0, 800.0)]
    assert [x for x in got if x[0] == "rule"] == [("rule", 20.0, 300.0), ("rule", 40.0, 140.0)]  # no underline, short bar or frame side
    assert [x for x in got if x[0] == "image"] == [("image", 210.0, 30.0)]


FIGURE = "doc_id long, page int, fig_id long, x0 double, x1 double, y0 double, y1 double, kind string, n_rows int, n_columns int"


@pytest.mark.parametrize(
    ("kind", "box", "kept"),
    [
        ("image", (100, 120.5, 100, 120), True), ("image", (100, 120, 100, 120), False), ("image", (0, 640, 0, 800), True), ("image", (100, 200, 10, 56), False), ("image", (100, 200, 10, 57), True),
        ("drawing", (100, 126, 100, 124), True), ("drawing", (100, 125, 100, 124), False), ("drawing", (100, 126, 100, 123.9), False), ("drawing", (0, 614.4, 32, 768), False), ("drawing", (0, 614.4, 33, 768), True),
        ("drawing", (100, 200, 743, 790), True), ("drawing", (100, 200, 744, 790), False), ("table", (100, 138.4, 100, 116), True), ("table", (100, 138.3, 100, 116), False), ("table", (100, 200, 10, 40), False), ("table", (100, 200, 10, 41), True),
    ],
)
def test_figure_gates(spark, kind, box, kept):
    df = spark.createDataFrame([(1, 1, 1, *map(float, box), kind, 2, 2)], FIGURE)
    assert apply("b_gate_figures", figures=df).count() == int(kept)


def test_a_table_has_two_rows_and_columns(spark):
    df = spark.createDataFrame([(1, 1, k, 100.0, 200.0, 100.0, 200.0, "table", *n) for k, n in enumerate([(2, 2), (1, 9), (9, 1)])], FIGURE)
    assert [r["fig_id"] for r in apply("b_gate_figures", figures=df).collect()] == [0]


def test_drawings_with_text(spark):
    """A figure of 200 by 100. Three lines may reach into it; more only if most of its strokes are short and on no text."""
    fig = spark.createDataFrame([(1, 1, 1, 100.0, 300.0, 100.0, 200.0, "drawing", 0, 0)], FIGURE)

    def kept(n_lines, short=0, long=0, riding=0):
        lines = spark.createDataFrame([(1, 1, k, 105.0 + 20 * k, 110.0 + 20 * k, 290.0, 400.0, "t") for k in range(n_lines)], LINE)
        free = [(110, 110 + 211, 150.5, 150.5)] * short + [(0, 212, 160.5, 160.5)] * long + [(291, 299, 108, 108)] * riding
        return apply("c_text_enclosure", figures=fig, lines=lines, strokes=strokes(spark, *free)).count() == 1

    assert kept(3) and not kept(4)
    assert kept(4, short=8) and not kept(4, short=7) and not kept(4, short=7, riding=3)
    assert kept(4, short=6, long=4) and not kept(4, short=5, long=4)


def test_confidence_of_pages(spark):
    df = spark.createDataFrame([(1, 1, 75.0), (1, 2, 74.9), (1, 3, 0.0)], "doc_id long, page int, conf double")
    assert SETTINGS["ocr_confidence"] == 75 and [r["page"] for r in apply("d_weak_pages", d_ocr_confidence=df).collect()] == [2]


def test_model_answers_with_segments(spark):
    seg = lambda p, a, b: f'{{"page":{p},"y_start_pct":{a},"y_end_pct":{b}}}'
    one = f'{{"q_num":" 7 ","is_solution":true,"segments":[{seg(2, 50, 60)},{seg(1, 10, 20)},{seg(9, 1, 2)},{seg(1, 30, 30)},{seg(1, -1, 5)},{seg(1, 90, 101)},{seg("null", 1, 2)}]}}'
    raws = [f'{{"questions":[{one}]}}', f"[{one}]", one, f'```json\n{{"questions":[{one}]}}\n```', "no answer", '{"questions":[{"q_num":"","segments":[' + seg(1, 1, 2) + "]}]}", '{"questions":[{"q_num":"8"}]}']
    df = spark.createDataFrame([(1, i, 1, 3, r) for i, r in enumerate(raws)], "doc_id long, answer_id long, first_page int, last_page int, raw string")
    got = sorted((r["answer_id"], r["q_num"], r["is_solution"], r["seg"], r["page"], r["y0"], r["y1"]) for r in apply("a_items_from_model_json", model_json=df).collect())
    assert got == [(i, "7", True, *s) for i in range(4) for s in ((1, 1, 10.0, 20.0), (2, 2, 50.0, 60.0))]


def test_a_label_and_its_letter_on_two_lines(spark):
    texts = ["1. As shown", "Answer:", "(B)", "2. thus", "Ans. (A) and", "Answer: (C)"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id long, seq long, text string")
    assert {(r["num"], r["letter"]) for r in apply("d_solution_answers", solution_lines=df).collect()} == {(1, "B"), (2, "A")}
