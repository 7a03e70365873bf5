"""Papers in two languages side by side, on literal pages."""

from sheafline.catalog import apply
from sheafline.operators.languages import segments_by_language

LINE = "doc_id long, page int, seq long, y_top double, y_bottom double, x_left double, x_right double, text string"
FIGURE = "doc_id long, page int, fig_id long, x0 double, x1 double, y0 double, y1 double, kind string, n_rows int, n_columns int"


def paper(doc, columns, header=None):
    """Lines of a page: each column a list of numbers, a stem and a line below for each."""
    out = []
    for c, numbers in enumerate(columns):
        x = 32.0 + 320 * c
        for k, n in enumerate(numbers):
            y = 100.0 + 150 * k + 20 * c
            out += [(y, x, f"{n}. What is it then"), (y + 20, x, "as it was said"), (y + 40, x, f"(A) this  (B) that {c}")]
    if header:
        out.append((header[0], 32.0, "Hints & Solutions"))
    return [(doc, 1, i, y, y + 12, x, x + 256, t) for i, (y, x, t) in enumerate(out)]


def test_each_language_is_itemised_apart(spark):
    """Paper 1 has two languages and its solutions' header in the left column only; paper 2 goes on in the right column."""
    lines = paper(1, [(1, 2, 3, 1), (1, 2, 3, 1)], header=(540.0,)) + paper(2, [(1, 2, 3, 4), (5, 6, 7, 8)])
    lines += [(1, 2, 100 + 3 * c + k, 100.0 + 20 * c + 20 * k, 112.0 + 20 * c + 20 * k, 32.0 + 320 * c, 288.0 + 320 * c, f"it goes on {c} {k}") for c in (0, 1) for k in range(3)]
    df = spark.createDataFrame(lines, LINE)
    figures = spark.createDataFrame([(1, 1, 1, 400.0, 500.0, 190.0, 230.0, "image", 0, 0), (2, 1, 2, 400.0, 500.0, 190.0, 230.0, "image", 0, 0)], FIGURE)
    tables = {"page_lines": df, "figures": figures}
    flags = {(r["doc_id"], r["bilingual"]) for r in apply("d_bilingual_split", **tables).collect()}
    assert flags == {(1, True), (2, False)}
    got, plain = segments_by_language(**tables).collect(), apply("d_segments", **tables)
    one = {}
    for r in sorted((r for r in got if r["doc_id"] == 1), key=lambda r: r["page"]):
        key = f"{'S' if r['is_solution'] else 'Q'}{r['q_num']}"
        one.setdefault((r["language"], key), []).append((r["page"], *(round(r[c], 2) for c in ("x0", "x1", "y0", "y1"))))
    left, right = (5.0, 45.0), (55.0, 95.0)
    assert one == {
        (0, "Q1"): [(1, *left, 12.5, 19.0)], (0, "Q2"): [(1, *left, 31.25, 37.75)], (0, "Q3"): [(1, *left, 50.0, 56.5)], (0, "S1"): [(1, *left, 68.75, 75.25), (2, *left, 12.5, 19.0)],
        (1, "Q1"): [(1, *right, 15.0, 28.75)], (1, "Q2"): [(1, *right, 33.75, 40.25)], (1, "Q3"): [(1, *right, 52.5, 59.0)], (1, "S1"): [(1, *right, 71.25, 77.75), (2, *right, 15.0, 21.5)],
    }
    # taken together, the left column's last item would end where the right column begins
    assert [r["page"] for r in plain.filter("doc_id = 1 AND is_solution AND item = 4").collect()] == [1]
    assert {tuple(r) for r in plain.filter("doc_id = 2").collect()} == {tuple(r[c] for c in plain.columns) for r in got if r["doc_id"] == 2}
    assert all(r["language"] is None for r in got if r["doc_id"] == 2)


def test_no_lines(spark):
    assert segments_by_language(spark.createDataFrame([], LINE), spark.createDataFrame([], FIGURE)).count() == 0
