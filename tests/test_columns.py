"""Items of literal pages with one, two and three columns, of option grids, and of other page sizes."""

from sheafline.catalog import apply

LINE = "doc_id long, page int, seq long, y_top double, y_bottom double, x_left double, x_right double, text string"
FIGURE = "doc_id long, page int, fig_id long, x0 double, x1 double, y0 double, y1 double, kind string, n_rows int, n_columns int"


def columned(n, scale=1.0, doc_id=1):
    """Two items of three lines in each of n columns, numbered down each column."""
    out = []
    for c in range(n):
        left, right = c * 640 / n + 16, (c + 1) * 640 / n - 16
        for i in range(6):
            num = c * 2 + i // 3 + 1
            text = [f"{num}. Which word of set {num} differs", f"(A) word {num} of one", f"(B) word {num} of two"][i % 3]
            out.append((doc_id, 1, len(out), (100.0 + 40 * i) * scale, (120.0 + 40 * i) * scale, left * scale, right * scale, text))
    return out


def segments(spark, lines, figures=(), **settings):
    df = spark.createDataFrame(lines, LINE)
    got = apply("d_segments", settings=settings, page_lines=df, lines=df, figures=spark.createDataFrame(list(figures), FIGURE))
    out = {}
    for r in got.collect():
        out.setdefault(r["doc_id"], []).append((int(r["q_num"]), r["col"], *(round(r[k], 3) for k in ("x0", "x1", "y0", "y1"))))
    return {k: sorted(v) for k, v in out.items()}


def wanted(n):
    out = []
    for num in range(1, 2 * n + 1):
        c, k = divmod(num - 1, 2)
        spare = 3.2 if n > 1 else 0.0
        x0, x1 = c * 640 / n + 16 - spare, (c + 1) * 640 / n - 16 + spare
        out.append((num, c, round(x0 / 6.4, 3), round(x1 / 6.4, 3), (100 + 120 * k) / 8, (200 + 120 * k) / 8))
    return out


def option_grid(doc_id):
    lines = []
    for num in (1, 2, 3):
        for k, (left, text) in enumerate([(16, f"{num}. Pick one of set {num}"), (16, f"(A) w{num}"), (352, f"(B) x{num}"), (16, f"(C) y{num}"), (352, f"(D) z{num}")]):
            y = 100.0 + 100 * num + 25 * (k + 1) // 2
            lines.append((doc_id, 1, len(lines), y, y + 10, float(left), left + 250.0, text))
    return lines


def test_columns_are_found(spark):
    """Documents 1 to 3 have as many columns, 4 has options in a grid, 5 a figure in the middle column of three."""
    lines = [x for n in (1, 2, 3) for x in columned(n, doc_id=n)] + option_grid(4) + columned(3, doc_id=5)
    got = segments(spark, lines, [(5, 1, 7, 240.0, 420.0, 150.0, 215.0, "drawing", 0, 0)])
    assert {n: got[n] for n in (1, 2, 3)} == {n: wanted(n) for n in (1, 2, 3)}
    assert [(s[0], s[1]) for s in got[4]] == [(1, 0), (2, 0), (3, 0)]
    assert {(s[2], s[3]) for s in got[4]} == {(2.5, round(602 / 6.4, 3))}
    assert {s[0]: s for s in got[5]}[3][5] == 215 / 8
    assert [s for s in got[5] if s[0] != 3] == [w for w in wanted(3) if w[0] != 3]


def test_page_size_is_a_setting(spark):
    assert segments(spark, columned(2, 0.5), page_width=320, page_height=400) == {1: wanted(2)}


def test_a_caller_sets_equal_columns(spark):
    """One column's lines have their centres at the middle, where the second of two equal columns begins."""
    assert [s[1] for s in segments(spark, columned(1), columns="equal")[1]] == [1, 1]


def test_label_lines_keep_document_and_page(spark):
    kind = "doc_id long, page int, item long, is_solution boolean, x0 double, x1 double, y0 double, y1 double"
    rows = [(77, 2, 1, True, -10.0, 50.0, 20.0, 120.0), (41, 1, 1, False, 10.0, 30.0, 0.0, 50.0), (1, 1, 2, False, 30.0, 30.0, 0.0, 50.0)]
    got = apply("a_label_export", segments=spark.createDataFrame(rows, kind)).collect()
    assert sorted(map(tuple, got)) == [(41, 1, "0 0.200000 0.250000 0.200000 0.500000"), (77, 2, "1 0.250000 0.600000 0.500000 0.800000")]
