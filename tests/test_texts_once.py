"""Texts are moved once to number a paper's lines and once to their items; what stands between works on places, with the same rows."""

from sheafline.relations import RELATIONS, SHARED, apply
from tests.support import rows

LINE = "doc_id long, page int, seq long, y_top double, y_bottom double, x_left double, x_right double, text string"
PLACE = "doc_id long, item long, page int, col int, seq long, y_top double, y_bottom double, is_section_header boolean"


def test_state_of_lines_follows_the_last_header(spark):
    texts = ["a", "Hints & Solutions", "b", None, "c", "Answer Key:", "d", "e", "Answer Key:", "f", "Hints & Solutions", "g", "Solutions", "h"]
    pages = [1, 1, 1, 1, 1, 2, 2, 3, 3, 3, 3, 3, 4, 4]
    df = spark.createDataFrame([(1, p, i, 9.0 * i, 9.0 * i + 8, 0.0, 9.0, t) for i, (p, t) in enumerate(zip(pages, texts))] + [(2, 1, 0, 0.0, 8.0, 0.0, 9.0, "z"), (None, 1, 0, 0.0, 8.0, 0.0, 9.0, "y")], LINE)
    tags = {r["seq"]: r for r in apply("b_tag_headers", page_lines=df).filter("doc_id = 1").collect()}
    want, side, key = {}, False, None
    for i, (p, t) in enumerate(zip(pages, texts)):
        if tags[i]["is_key_header"]:
            side, key = False, p
        elif tags[i]["is_solution_header"]:
            side, key = True, None
        if t is not None and not tags[i]["is_solution_header"]:
            want[i] = (side, key == p)
    got = apply("e_section_state", page_lines=df).collect()
    assert {r["seq"]: (r["in_solutions"], r["in_answer_key"]) for r in got if r["doc_id"] == 1} == want
    assert {r["text"]: (r["in_solutions"], r["in_answer_key"]) for r in got if r["doc_id"] != 1} == {"z": (False, False), "y": (False, False)}


def test_lines_are_numbered_over_a_paper(spark):
    docs = spark.createDataFrame([(1, "b\n\n c \n"), (0, "a\n \n"), (3, None), (2, ""), (20, "x"), (19, "d")], "doc_id long, text string")
    got = {(r["paper_id"], r["n"], r["raw"]) for r in apply("body", documents=docs).collect()}
    assert got == {(0, 0, "a"), (0, 1, "b"), (0, 2, " c "), (0, 3, "d"), (1, 0, "x")}


def test_equal_lines_keep_their_number(spark):
    lines = [(1, 1, s, 9.0, None, t, False) for s, t in [(0, "a"), (0, "a"), (1, "b"), (1, "c"), (2, "d")]]
    state = spark.createDataFrame(lines, "doc_id long, page int, seq long, y_top double, y_bottom double, text string, is_section_header boolean")
    places = spark.createDataFrame([(1, 7, 1, 0, s, 9.0, None, False) for s in (0, 0, 1, 1)], PLACE)
    for name, given in (("c_assign_lines", "assigned_places"), ("e_section_cutoff", "kept_places")):
        got = apply(name, e_section_state=state, **{given: places})
        assert sorted(r["text"] for r in got.collect()) == ["a", "a", "b", "c"]


def test_steps_between_have_no_texts(spark):
    df = spark.createDataFrame([(1, 1 + i // 20, i, 30.0 * (i % 20), 30.0 * (i % 20) + 9, 32.0, 288.0, f"{i}. words of it") for i in range(60)], LINE)
    figures = spark.createDataFrame([], "doc_id long, page int, fig_id long, x0 double, x1 double, y0 double, y1 double, kind string, n_rows int, n_columns int")
    for name in ("content_places", "column_places", "assigned_places", "detectable_lines"):
        assert name in SHARED and "text" not in apply(name, page_lines=df, figures=figures).columns
    assert not {"page_lines", "b_tag_headers", "column_lines", "c_assign_lines"} & SHARED
    for name in ("d_banner_headers", "d_validate_columns", "d_segments", "item_ends"):
        assert not {"content_lines", "column_lines", "c_assign_lines", "e_section_cutoff"} & set(RELATIONS[name].inputs())
    assert sum(rows(apply("e_section_cutoff", page_lines=df, figures=figures)).values()) == 60
