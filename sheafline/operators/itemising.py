"""From lines and markers to items: columns, reading order, bounds, assignment and segments."""

from ..functions import fixed as fx
from ..relations import SETTINGS, SHARED, relation
from .tagging import EXACT_KEY

SHARED |= {
    "lines", "paper_pages", "b_tag_markers", "section_marks", "e_section_state", "content_places", "c_column_of", "sided_markers", "e_reading_order",
    "detectable_lines", "e_dedupe_close", "e_row_top", "item_bounds", "all_pages", "furniture_keys", "d_find_furniture", "column_places", "assigned_places", "d_columns_fixed",
    "d_detect_columns", "detected_column_of", "d_strong_filter", "d_drop_numbered_options", "c_drop_key_cells", "number_places", "missing_numbers",
    "line_numbers", "e_recover_chain", "c_recover_markers", "d_validate_columns", "page_columns", "d_banner_headers", "b_gate_figures",
}

#: The page's size in the lines' own units, and columns as "found" on each page or "equal" in number to layout_columns.
SETTINGS |= {"page_width": 640, "page_height": 800, "columns": "found", "layout_columns": 2}
W, H = "$(page_width)", "$(page_height)"

relation("d_columns_fixed", "Equal columns where a caller sets their number.", f"""
SELECT doc_id, page, CAST(col AS INT) AS col, CAST(col * {W} / ($(layout_columns) * 1.0) AS DOUBLE) AS x0, CAST((col + 1) * {W} / ($(layout_columns) * 1.0) AS DOUBLE) AS x1
FROM (SELECT doc_id, page, EXPLODE(SEQ(0, $(layout_columns) - 1)) AS col FROM {{all_pages}}) x""")
relation("all_pages", "Pages that have lines.", "SELECT DISTINCT doc_id, page FROM {page_lines}")

#: The column of each row of a table: the one that holds its centre, else the nearest.
_COLUMN_OF = """
SELECT {keys}, col FROM (
  SELECT {keys}, col, row_number() OVER (PARTITION BY {keys} ORDER BY dist, col) AS rn FROM (
    SELECT {own}, c.col, CASE WHEN ({x0} + {x1}) / 2 >= c.x0 AND ({x0} + {x1}) / 2 < c.x1 THEN -1.0
      ELSE least(abs(({x0} + {x1}) / 2 - c.x0), abs(({x0} + {x1}) / 2 - c.x1)) END AS dist
    FROM {{{rows}}} l JOIN {{{columns}}} c ON l.doc_id = c.doc_id AND l.page = c.page) x) y WHERE rn = 1"""
_LINE = {"keys": "doc_id, page, seq", "own": "l.doc_id, l.page, l.seq", "x0": "l.x_left", "x1": "l.x_right", "rows": "page_lines"}
relation("c_column_of", "The column of each line.", _COLUMN_OF.format(**_LINE, columns="page_columns"))
relation("detected_column_of", "The column of each line by the density of lines alone.", _COLUMN_OF.format(**_LINE, columns="d_detect_columns"))
relation("figure_column_of", "The column of each figure.", _COLUMN_OF.format(
    keys="doc_id, page, fig_id", own="l.doc_id, l.page, l.fig_id", x0="l.x0", x1="l.x1", rows="b_gate_figures", columns="page_columns"))

relation("page_columns", "Columns of each page: the validated ones, where that is a single one those that markers show, or a caller's number of equal ones.", """
WITH marked AS (
  SELECT m.doc_id, m.page, m.col, m.x0, m.x1 FROM {d_columns_from_markers} m JOIN (SELECT doc_id, page FROM {d_validate_columns} GROUP BY doc_id, page HAVING count(*) = 1) s ON m.doc_id = s.doc_id AND m.page = s.page
)
SELECT doc_id, page, col, x0, x1 FROM {d_columns_fixed} WHERE $(columns) = 'equal'
UNION ALL SELECT doc_id, page, col, x0, x1 FROM marked WHERE $(columns) <> 'equal'
UNION ALL SELECT v.doc_id, v.page, v.col, v.x0, v.x1 FROM {d_validate_columns} v
WHERE $(columns) <> 'equal' AND NOT EXISTS (SELECT /*M m*/ 1 FROM marked m WHERE m.doc_id = v.doc_id AND m.page = v.page)""")

relation("section_marks", "Headers at which a document's state changes, in order: solution headers after others, and key headers after others or on another page.", "", exact=False,
    spark="""
SELECT doc_id, array_sort(collect_list(struct(page, y_top, x_left, seq, is_key))) AS marks FROM (
  SELECT doc_id, page, y_top, x_left, seq, is_key_header AS is_key, lag(is_key_header) OVER w AS k, lag(page) OVER w AS p FROM {b_tag_headers} WHERE is_key_header OR is_solution_header
  WINDOW w AS (PARTITION BY doc_id ORDER BY page, y_top, x_left, seq)) x
WHERE k IS NULL OR k <> is_key OR (is_key AND NOT p <=> page) GROUP BY doc_id""")  # fmt: skip

#: In Spark lines look their state up in the last of their document's marks, so texts are neither moved nor sorted for it.
relation("e_section_state", "Lines without section-opening headers, with the side and answer-key state they stand in.", """
SELECT doc_id, page, seq, y_top, y_bottom, x_left, x_right, text, is_section_header, in_solutions, in_answer_key FROM (
  SELECT *,
    coalesce(LASTNN(CASE WHEN is_key_header THEN 0 WHEN is_solution_header THEN 1 END NN) OVER (PARTITION BY doc_id ORDER BY page, y_top, x_left, seq), 0) = 1 AS in_solutions,
    coalesce(LASTNN(CASE WHEN is_key_header THEN 1 WHEN is_solution_header THEN 0 END NN) OVER (PARTITION BY doc_id, page ORDER BY y_top, x_left, seq), 0) = 1 AS in_answer_key
  FROM {b_tag_headers}) x
WHERE NOT is_solution_header""", spark="""
SELECT doc_id, page, seq, y_top, y_bottom, x_left, x_right, text, is_section_header, coalesce(NOT mark.is_key, false) AS in_solutions, coalesce(mark.is_key AND mark.page <=> page, false) AS in_answer_key FROM (
  SELECT h.*, try_element_at(filter(m.marks, x -> struct(x.page, x.y_top, x.x_left, x.seq) <= struct(h.page, h.y_top, h.x_left, h.seq)), -1) AS mark
  FROM {b_tag_headers} h LEFT JOIN {section_marks} m ON h.doc_id <=> m.doc_id WHERE NOT h.is_solution_header) x""")  # fmt: skip

relation("sided_markers", "Markers outside answer keys, with their side.", """
SELECT m.doc_id, m.page, m.seq, m.y_top, m.y_bottom, m.x_left, m.x_right, m.q_num, m.is_strong, s.in_solutions AS is_solution
FROM {b_tag_markers} m JOIN {e_section_state} s ON m.doc_id = s.doc_id AND m.page = s.page AND m.seq = s.seq WHERE NOT s.in_answer_key""")

relation("d_strong_filter", "Markers of a side; where strong ones are common the weak are dropped.", """
SELECT doc_id, page, seq, y_top, y_bottom, x_left, x_right, q_num, is_strong, is_solution FROM (
  SELECT *, count_if(is_strong) OVER (PARTITION BY doc_id, is_solution) AS s, count(*) OVER (PARTITION BY doc_id, is_solution) AS n FROM {sided_markers}) x
WHERE is_strong OR NOT ((s >= 2 AND s > 0.15 * n) OR s > 0.5 * n)""")

relation("e_reading_order", "Markers numbered by page, column and height.", """
SELECT m.doc_id, m.page, c.col, m.seq, m.y_top, m.x_left, m.x_right, m.q_num, m.is_strong, m.is_solution,
  CAST(row_number() OVER (PARTITION BY m.doc_id ORDER BY m.page, c.col, m.y_top, m.x_left, m.seq, m.q_num, m.is_solution) AS BIGINT) AS ord
FROM {c_recover_markers} m JOIN {c_column_of} c ON m.doc_id = c.doc_id AND m.page = c.page AND m.seq = c.seq""")

#: Markers in a row that agree in page, number and side are one run; only within a run is one compared with the last kept.
_RUNS = """
WITH runs AS (
  SELECT *, sum(CASE WHEN page = p AND q_num = q AND is_solution = s THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY ord) AS run FROM (
    SELECT *, lag(page) OVER w AS p, lag(q_num) OVER w AS q, lag(is_solution) OVER w AS s FROM {e_reading_order} WINDOW w AS (PARTITION BY doc_id ORDER BY ord)) x
)"""
relation("e_dedupe_close", "Markers without those within 2 pixels of the one kept before them, alike in number and side.", "",
    spark=_RUNS + """
SELECT doc_id, inline(aggregate(rows, slice(rows, 1, 0), (kept, r) -> CASE WHEN size(kept) > 0 AND abs(element_at(kept, -1).y_top - r.y_top) < 2 THEN kept ELSE array_append(kept, r) END))
FROM (SELECT doc_id, array_sort(collect_list(struct(ord, page, col, seq, y_top, x_left, x_right, q_num, is_solution))) AS rows FROM runs GROUP BY doc_id, run) y""",
    other=_RUNS + """
SELECT doc_id, r.ord, r.page, r.col, r.seq, r.y_top, r.x_left, r.x_right, r.q_num, r.is_solution FROM (
  SELECT doc_id, unnest(list_reduce(list_transform(rows, lambda r: [r]), lambda kept, r: CASE WHEN abs(kept[-1].y_top - r[1].y_top) < 2 THEN kept ELSE list_concat(kept, r) END)) AS r
  FROM (SELECT doc_id, list(struct_pack(ord := ord, page := page, col := col, seq := seq, y_top := y_top, x_left := x_left, x_right := x_right, q_num := q_num, is_solution := is_solution) ORDER BY ord) AS rows FROM runs GROUP BY doc_id, run) y) z""")  # fmt: skip

relation("e_row_top", "Each marker's top, pulled up to a stem in the same row.", f"""
SELECT m.doc_id, m.ord, m.page, m.col, m.seq, m.q_num, m.is_solution, m.x_left, m.x_right, m.y_top, least(m.y_top, coalesce(min(l.y_top), m.y_top)) AS row_top
FROM {{e_dedupe_close}} m LEFT JOIN (SELECT s.*, c.col FROM {{e_section_state}} s JOIN {{c_column_of}} c ON s.doc_id = c.doc_id AND s.page = c.page AND s.seq = c.seq) l
  ON m.doc_id = l.doc_id AND m.page = l.page AND m.col = l.col AND l.x_left + 1e-6 >= m.x_left AND l.y_top <= m.y_top + {H} * 0.006 AND l.y_bottom >= m.y_top + {H} * 0.004
GROUP BY m.doc_id, m.ord, m.page, m.col, m.seq, m.q_num, m.is_solution, m.x_left, m.x_right, m.y_top""")

relation("item_bounds", "Where each item begins and the next one does.", """
SELECT *, lead(page) OVER w AS n_page, lead(col) OVER w AS n_col, lead(row_top) OVER w AS n_top FROM {e_row_top} WINDOW w AS (PARTITION BY doc_id ORDER BY ord)""")

relation("content_lines", "Lines that are neither section-opening headers nor furniture.", """
SELECT s.doc_id, s.page, s.seq, s.y_top, s.y_bottom, s.x_left, s.x_right, s.text, s.is_section_header FROM {e_section_state} s
WHERE NOT EXISTS (SELECT 1 FROM {d_find_furniture} f WHERE f.doc_id = s.doc_id AND f.page = s.page AND f.y_top = s.y_top AND f.y_bottom = s.y_bottom)""")

_QUESTION = " OR ".join(f"LIKE_RE(trim({{t}}), r'{p}')" for p in (fx.OPTION_START, fx.WEAK_DOT, fx.WEAK_PAREN, fx.WEAK_OPEN, fx.STRONG))
_OPTION = f"LIKE_RE(trim({{t}}), r'{fx.OPTION_START}')"
relation("content_places", "Content lines without their texts: places, and whether they begin as an option or, near the page's top, as any part of a question.", "", exact=False,
    spark=f"""
SELECT s.* FROM (SELECT doc_id, page, seq, y_top, y_bottom, x_left, x_right, is_section_header, {_OPTION.replace("{t}", "text")} AS is_option, y_top <= 0.15 * {H} AND ({_QUESTION.replace("{t}", "text")}) AS is_question FROM {{e_section_state}}) s
WHERE NOT EXISTS (SELECT 1 FROM {{d_find_furniture}} f WHERE f.doc_id = s.doc_id AND f.page = s.page AND f.y_top = s.y_top AND f.y_bottom = s.y_bottom)""")  # fmt: skip


def placed(text: str) -> str:
    """The same query over content lines' places instead of their texts."""
    return text.replace("{content_lines}", "{content_places}").replace(f"({_QUESTION.replace('{t}', 'l.text')})", "(l.is_question)").replace(_OPTION.replace("{t}", "l.text"), "l.is_option")


_COLUMN_LINES = """
SELECT s.doc_id, s.page, c.col, s.seq, s.y_top, s.y_bottom, s.x_left, s.x_right, s.text, s.is_section_header
FROM {content_lines} s JOIN {c_column_of} c ON s.doc_id = c.doc_id AND s.page = c.page AND s.seq = c.seq
WHERE NOT EXISTS (SELECT 1 FROM {d_banner_headers} f WHERE f.doc_id = s.doc_id AND f.page = s.page AND f.y_top = s.y_top AND f.y_bottom = s.y_bottom)"""
relation("column_lines", "Content lines with their columns, without banners.", _COLUMN_LINES)
relation("column_places", "Column lines without their texts.", "", spark=placed(_COLUMN_LINES).replace(" s.text,", ""), exact=False)

_AFTER = "(l.page > m.page OR (l.page = m.page AND (l.col > m.col OR (l.col = m.col AND l.y_top >= m.row_top))))"
_BEFORE = "(m.n_page IS NULL OR l.page < m.n_page OR (l.page = m.n_page AND (l.col < m.n_col OR (l.col = m.n_col AND l.y_top < m.n_top))))"
relation("assigned_places", "The item of each line, without texts. Bounds that rise within a paper need one ordered pass; only papers whose bounds cross are range-joined.", "", exact=False,
    spark=f"""
WITH crossed AS (
  SELECT DISTINCT doc_id FROM {{item_bounds}} WHERE struct(n_page, n_col, n_top) < struct(page, col, row_top) AND n_page IS NOT NULL
), marks AS (
  SELECT doc_id, page, col, row_top AS y, 0 AS kind, ord, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS DOUBLE) AS y_bottom, false AS is_section_header FROM {{item_bounds}}
  UNION ALL SELECT doc_id, page, col, y_top, 1, NULL, seq, y_bottom, is_section_header FROM {{column_places}}
), walked AS (
  SELECT *, last(ord, true) OVER (PARTITION BY doc_id ORDER BY page, col, y, kind, ord, seq) AS item FROM (SELECT /*M c*/ m.* FROM marks m LEFT ANTI JOIN crossed c ON m.doc_id = c.doc_id) x
)
SELECT doc_id, item, page, col, seq, y AS y_top, y_bottom, is_section_header FROM walked WHERE kind = 1 AND item IS NOT NULL
UNION ALL
SELECT l.doc_id, m.ord, l.page, l.col, l.seq, l.y_top, l.y_bottom, l.is_section_header
FROM (SELECT /*M c*/ b.* FROM {{item_bounds}} b LEFT SEMI JOIN crossed c ON b.doc_id = c.doc_id) m JOIN {{column_places}} l ON l.doc_id = m.doc_id AND {_AFTER} AND {_BEFORE}""")  # fmt: skip

#: Texts are joined to what is left of the lines, once; lines that agree in all of their place are one there.
_WITH_TEXT = """
SELECT a.doc_id, a.item, a.page, a.col, a.seq, a.y_top, a.y_bottom, l.text{more} FROM (SELECT DISTINCT doc_id, item, page, col, seq, y_top, y_bottom, is_section_header FROM {{{places}}}) a
JOIN {{e_section_state}} l ON a.doc_id = l.doc_id AND a.page = l.page AND a.seq = l.seq AND a.y_top <=> l.y_top AND a.y_bottom <=> l.y_bottom AND a.is_section_header <=> l.is_section_header"""
relation("c_assign_lines", "The item of each line: the one whose bounds hold it.", "",
    spark=_WITH_TEXT.format(places="assigned_places", more=", a.is_section_header"),
    other=f"""
SELECT l.doc_id, m.ord AS item, l.page, l.col, l.seq, l.y_top, l.y_bottom, l.text, l.is_section_header
FROM {{item_bounds}} m JOIN {{column_lines}} l ON l.doc_id = m.doc_id AND {_AFTER} AND {_BEFORE}""")  # fmt: skip

relation("kept_places", "An item's lines up to its first section divider, without texts.", "", exact=False,
    spark="""
SELECT doc_id, item, page, col, seq, y_top, y_bottom, is_section_header FROM (
  SELECT *, max(CAST(is_section_header AS INT)) OVER (PARTITION BY doc_id, item ORDER BY page, col, y_top, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cut FROM {assigned_places}) x WHERE cut = 0""")  # fmt: skip
relation("e_section_cutoff", "An item's lines up to its first section divider.", """
SELECT doc_id, item, page, col, seq, y_top, y_bottom, text FROM (
  SELECT *, max(CAST(is_section_header AS INT)) OVER (PARTITION BY doc_id, item ORDER BY page, col, y_top, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cut FROM {c_assign_lines}) x WHERE cut = 0""", spark=_WITH_TEXT.format(places="kept_places", more=""))

_ITEM_ENDS = """
SELECT m.doc_id, m.ord, m.page, m.col, m.row_top, coalesce(d.page, m.n_page) AS n_page, coalesce(d.col, m.n_col) AS n_col, coalesce(d.y_top, m.n_top) AS n_top
FROM {item_bounds} m LEFT JOIN (SELECT doc_id, item, page, col, y_top FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item ORDER BY page, col, y_top, seq) AS rn FROM {c_assign_lines} WHERE is_section_header) x WHERE rn = 1) d
ON m.doc_id = d.doc_id AND m.ord = d.item"""
relation("item_ends", "Where figures stop belonging to an item: its first divider, else the next item.", _ITEM_ENDS, spark=_ITEM_ENDS.replace("c_assign_lines", "assigned_places"))

relation("c_assign_figures", "The item of each figure, by the same bounds, no further than a divider.", f"""
SELECT l.doc_id, m.ord AS item, l.page, l.col, l.fig_id, l.x0, l.x1, l.y_top, l.y1
FROM {{item_ends}} m JOIN (SELECT g.*, coalesce(c.col, 0) AS col, g.y0 AS y_top FROM {{b_gate_figures}} g LEFT JOIN {{figure_column_of}} c ON g.doc_id = c.doc_id AND g.page = c.page AND g.fig_id = c.fig_id) l ON l.doc_id = m.doc_id AND {_AFTER} AND {_BEFORE}""")

_COLUMN_BOUNDS = f"""
SELECT l.doc_id, l.page, l.col, CASE WHEN min(c.k) > 1 THEN greatest(min(l.x_left) - 0.005 * {W}, min(c.x0)) ELSE min(l.x_left) END AS x0, CASE WHEN min(c.k) > 1 THEN least(max(l.x_right) + 0.005 * {W}, min(c.x1)) ELSE max(l.x_right) END AS x1
FROM {{column_lines}} l JOIN (SELECT *, count(*) OVER (PARTITION BY doc_id, page) AS k FROM {{page_columns}}) c ON l.doc_id = c.doc_id AND l.page = c.page AND l.col = c.col
WHERE l.x_right > l.x_left GROUP BY l.doc_id, l.page, l.col"""
relation("d_column_bounds", "Extent of the text in each column; where there are several, half a per cent to spare inside its share of the page.", _COLUMN_BOUNDS, spark=_COLUMN_BOUNDS.replace("column_lines", "column_places"))

_SEGMENTS = f"""
WITH text AS (
  SELECT doc_id, item, page, col, min(y_top) AS y0, max(y_bottom) AS y1, count(*) AS n_lines FROM {{e_section_cutoff}} GROUP BY doc_id, item, page, col
), figs AS (
  SELECT doc_id, item, page, col, min(x0) AS fx0, max(x1) AS fx1, min(y_top) AS fy0, max(y1) AS fy1 FROM {{c_assign_figures}} GROUP BY doc_id, item, page, col
), found AS (
  SELECT coalesce(t.doc_id, f.doc_id) AS doc_id, coalesce(t.item, f.item) AS item, coalesce(t.page, f.page) AS page, coalesce(t.col, f.col) AS col,
    least(coalesce(y0, fy0), coalesce(fy0, y0)) AS y0, greatest(coalesce(y1, fy1), coalesce(fy1, y1)) AS y1, fx0, fx1, coalesce(n_lines, 0) AS n_lines
  FROM text t FULL OUTER JOIN figs f ON t.doc_id = f.doc_id AND t.item = f.item AND t.page = f.page AND t.col = f.col
  UNION ALL
  SELECT m.doc_id, m.ord, m.page, m.col, m.y_top, CAST({H} AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), 0 FROM {{e_row_top}} m
  WHERE NOT EXISTS (SELECT /*M t*/ 1 FROM text t WHERE t.doc_id = m.doc_id AND t.item = m.ord) AND NOT EXISTS (SELECT /*M f*/ 1 FROM figs f WHERE f.doc_id = m.doc_id AND f.item = m.ord)
)
SELECT /*M b*/ s.doc_id, s.item, m.q_num, m.is_solution, s.page, s.col, CAST(s.n_lines AS BIGINT) AS n_lines,
  greatest(0, least(100, s.y0 / {H} * 100)) AS y0, greatest(0, least(100, s.y1 / {H} * 100)) AS y1,
  greatest(0, least(100, least(coalesce(b.x0, c.x0, 0), coalesce(s.fx0, b.x0, c.x0, 0)) / {W} * 100)) AS x0,
  greatest(0, least(100, greatest(coalesce(b.x1, c.x1, {W}), coalesce(s.fx1, b.x1, c.x1, {W})) / {W} * 100)) AS x1
FROM found s JOIN {{e_row_top}} m ON s.doc_id = m.doc_id AND s.item = m.ord
LEFT JOIN {{page_columns}} c ON s.doc_id = c.doc_id AND s.page = c.page AND s.col = c.col
LEFT JOIN {{d_column_bounds}} b ON s.doc_id = b.doc_id AND s.page = b.page AND s.col = b.col
WHERE greatest(0, least(100, s.y1 / {H} * 100)) > greatest(0, least(100, s.y0 / {H} * 100))"""
relation("d_segments", "Segments of each item in per cent of the page: lines and figures by page and column; an item with neither reaches to the page's end.", _SEGMENTS, spark=_SEGMENTS.replace("e_section_cutoff", "kept_places"))

relation("furniture_keys", "What lines need to be judged as furniture, without their texts: places, digests of their keys (null for empty ones), folios and markers.", "", exact=False,
    spark=f"""
SELECT doc_id, page, y_top, y_bottom, top, bottom, CASE WHEN exact_key <> '' THEN unhex(md5(exact_key)) END AS exact_key, CASE WHEN loose_key <> '' THEN unhex(md5(loose_key)) END AS loose_key, folio, marker FROM (
  SELECT *, translate(exact_key, '0123456789', '') AS loose_key FROM (
    SELECT l.doc_id, l.page, l.y_top, l.y_bottom, l.y_top / {H} * 100 AS top, l.y_bottom / {H} * 100 AS bottom, l.exact_key, l.folio, (m.seq IS NOT NULL OR l.is_solution_header) AS marker
    FROM (SELECT doc_id, page, seq, y_top, y_bottom, is_solution_header, {EXACT_KEY.replace("/*G*/", "")} AS exact_key, length(trim(text)) <= 20 AND regexp_like(trim(text), r'{fx.FOLIO}') AS folio FROM {{b_tag_headers}}) l
    LEFT JOIN (SELECT doc_id, page, seq FROM {{b_tag_markers}}) m ON l.doc_id = m.doc_id AND l.page = m.page AND l.seq = m.seq) x) y""")  # fmt: skip

#: Only lines in a margin can be furniture, so Spark judges no others; keys are counted over all lines.
relation("d_find_furniture", "Running titles, footers and folios: lines that repeat at one height on enough pages, or page numbers in a margin.", "",
    spark=f"""
WITH pages AS (
  SELECT doc_id, max(page) AS n, greatest(2, BROUND(max(page) * 0.5, 0)) AS strong FROM {{page_lines}} GROUP BY doc_id
), first_marker AS (
  SELECT doc_id, page, min(top) AS top FROM {{furniture_keys}} WHERE marker GROUP BY doc_id, page
), exact AS (
  SELECT doc_id, exact_key, count(DISTINCT page) AS n, max(top) - min(top) <= 3.0 AS stable, bool_and(top <= 15 OR bottom >= 85) AS margin FROM {{furniture_keys}} WHERE NOT marker AND exact_key IS NOT NULL GROUP BY doc_id, exact_key
), loose AS (
  SELECT doc_id, loose_key, count(DISTINCT page) AS n, max(top) - min(top) <= 3.0 AS stable, bool_and(top <= 15 OR bottom >= 85) AS margin FROM {{furniture_keys}} WHERE NOT marker AND loose_key IS NOT NULL GROUP BY doc_id, loose_key
), judged AS (
  SELECT /*M p, f, e, o*/ k.*, coalesce(f.top < k.top - 0.01, false) AS below_marker,
    coalesce(e.stable AND (e.n >= p.strong OR (e.n >= 3 AND e.margin)), false) OR coalesce(o.stable AND (o.n >= p.strong OR (o.n >= 3 AND o.margin)), false) AS running, coalesce(e.n >= 2, false) AS weak
  FROM (SELECT * FROM {{furniture_keys}} WHERE NOT marker AND (top <= 15 OR bottom >= 85)) k JOIN pages p ON k.doc_id = p.doc_id AND p.n >= 2 LEFT JOIN first_marker f ON k.doc_id = f.doc_id AND k.page = f.page
  LEFT JOIN exact e ON k.doc_id = e.doc_id AND k.exact_key = e.exact_key LEFT JOIN loose o ON k.doc_id = o.doc_id AND k.loose_key = o.loose_key
)
SELECT DISTINCT doc_id, page, y_top, y_bottom FROM judged
WHERE CASE WHEN folio AND ((top <= 15 AND NOT below_marker) OR bottom >= 85) THEN true
  WHEN running THEN (top <= 15 AND NOT below_marker) OR bottom >= 85 ELSE weak AND ((top <= 6 AND NOT below_marker) OR bottom >= 90) END""",
    other=f"""
WITH keyed AS (
  SELECT l.doc_id, l.page, l.seq, l.y_top, l.y_bottom, l.y_top / {H} * 100 AS top, l.y_bottom / {H} * 100 AS bottom, l.exact_key, regexp_replace(l.exact_key, '[0-9]', ''/*G*/) AS loose_key,
    length(trim(l.text)) <= 20 AND LIKE_RE(trim(l.text), r'{fx.FOLIO}') AS folio, (m.seq IS NOT NULL OR l.is_solution_header) AS marker
  FROM (SELECT *, {EXACT_KEY} AS exact_key FROM {{b_tag_headers}}) l
  LEFT JOIN (SELECT doc_id, page, seq FROM {{b_tag_markers}}) m ON l.doc_id = m.doc_id AND l.page = m.page AND l.seq = m.seq
), pages AS (
  SELECT doc_id, max(page) AS n, greatest(2, BROUND(max(page) * 0.5, 0)) AS strong FROM {{page_lines}} GROUP BY doc_id
), first_marker AS (
  SELECT doc_id, page, min(top) AS top FROM keyed WHERE marker GROUP BY doc_id, page
), exact AS (
  SELECT doc_id, exact_key, count(DISTINCT page) AS n, max(top) - min(top) <= 3.0 AS stable, bool_and(top <= 15 OR bottom >= 85) AS margin FROM keyed WHERE NOT marker AND exact_key <> '' GROUP BY doc_id, exact_key
), loose AS (
  SELECT doc_id, loose_key, count(DISTINCT page) AS n, max(top) - min(top) <= 3.0 AS stable, bool_and(top <= 15 OR bottom >= 85) AS margin FROM keyed WHERE NOT marker AND loose_key <> '' GROUP BY doc_id, loose_key
), judged AS (
  SELECT /*M p, f, e, o*/ k.*, coalesce(f.top < k.top - 0.01, false) AS below_marker,
    coalesce(e.stable AND (e.n >= p.strong OR (e.n >= 3 AND e.margin)), false) OR coalesce(o.stable AND (o.n >= p.strong OR (o.n >= 3 AND o.margin)), false) AS running, coalesce(e.n >= 2, false) AS weak
  FROM keyed k JOIN pages p ON k.doc_id = p.doc_id AND p.n >= 2 LEFT JOIN first_marker f ON k.doc_id = f.doc_id AND k.page = f.page
  LEFT JOIN exact e ON k.doc_id = e.doc_id AND k.exact_key = e.exact_key LEFT JOIN loose o ON k.doc_id = o.doc_id AND k.loose_key = o.loose_key WHERE NOT k.marker
)
SELECT DISTINCT doc_id, page, y_top, y_bottom FROM judged
WHERE CASE WHEN folio AND ((top <= 15 AND NOT below_marker) OR bottom >= 85) THEN true
  WHEN running THEN (top <= 15 AND NOT below_marker) OR bottom >= 85 ELSE weak AND ((top <= 6 AND NOT below_marker) OR bottom >= 90) END""")  # fmt: skip

relation("c_strip_furniture", "Lines that do not share page and height with furniture.", """
SELECT l.doc_id, l.page, l.seq, l.y_top, l.y_bottom, l.text FROM {page_lines} l
WHERE NOT EXISTS (SELECT 1 FROM {d_find_furniture} f WHERE f.doc_id = l.doc_id AND f.page = l.page AND f.y_top = l.y_top AND f.y_bottom = l.y_bottom)""")

relation("c_drop_key_cells", "Markers that do not stand in a row of four or more answer-key cells.", f"""
WITH bands AS (
  SELECT doc_id, page, min(y_top) - 1 AS y0, max(y_bottom) + 1 AS y1 FROM {{e_section_state}} WHERE LIKE_RE(trim(text), r'{fx.KEY_CELL}') GROUP BY doc_id, page, BROUND(y_top / 4, 0) HAVING count(*) >= 4
)
SELECT m.* FROM {{d_drop_numbered_options}} m WHERE NOT EXISTS (SELECT /*M b*/ 1 FROM bands b WHERE b.doc_id = m.doc_id AND b.page = m.page AND m.y_top BETWEEN b.y0 AND b.y1)""")

#: The first digits of a marker's number; markers by a user's pattern may have none.
_NUMBER = "TRY_CAST(regexp_extract(q_num, '([0-9]+)', 1) AS INT)"
relation("number_places", "The first place of each number of a side.", f"""
SELECT doc_id, is_solution, num, page, y_top FROM (
  SELECT doc_id, is_solution, num, page, y_top, row_number() OVER (PARTITION BY doc_id, is_solution, num ORDER BY page, y_top, x_left, seq) AS rn
  FROM (SELECT *, {_NUMBER} AS num FROM {{c_drop_key_cells}}) x WHERE num IS NOT NULL) y WHERE rn = 1""")

relation("expected_numbers", "The run of numbers that the answer key within a document's own lines implies.", """
SELECT doc_id, CAST(n AS INT) AS num FROM (SELECT doc_id, EXPLODE(SEQ(lo, hi)) AS n FROM (SELECT doc_id, min(num) AS lo, max(num) AS hi FROM {d_answer_key} GROUP BY doc_id) x) y""")

relation("missing_numbers", "Numbers to look for, with the places of their nearest neighbours: those of the key that no question has; without a key the holes of a side with three numbers or more, if they are few.", """
WITH runs AS (
  SELECT doc_id, is_solution, min(num) AS lo, max(num) AS hi, count(*) AS n FROM {number_places} GROUP BY doc_id, is_solution
), keyed AS (SELECT DISTINCT doc_id FROM {expected_numbers}), sought AS (
  SELECT /*M e, r*/ e.doc_id, false AS is_solution, e.num FROM {expected_numbers} e JOIN runs r ON r.doc_id = e.doc_id AND NOT r.is_solution
  UNION ALL
  SELECT doc_id, is_solution, CAST(k AS INT) FROM (
    SELECT r.doc_id, r.is_solution, EXPLODE(SEQ(r.lo, r.hi)) AS k FROM runs r WHERE r.n >= 3 AND r.hi - r.lo + 1 - r.n <= greatest(3, CAST(floor((r.hi - r.lo) / 3.0) AS INT))
      AND (r.is_solution OR NOT EXISTS (SELECT /*M q*/ 1 FROM keyed q WHERE q.doc_id = r.doc_id))) x
), placed AS (
  SELECT doc_id, is_solution, num, page, y_top, false AS sought FROM {number_places}
  UNION ALL
  SELECT s.doc_id, s.is_solution, s.num, CAST(NULL AS INT), CAST(NULL AS DOUBLE), true FROM sought s
  WHERE NOT EXISTS (SELECT 1 FROM {number_places} p WHERE p.doc_id = s.doc_id AND p.is_solution = s.is_solution AND p.num = s.num)
)
SELECT doc_id, is_solution, num, low_num, low_page, low_y, up_num, up_page, up_y FROM (
  SELECT doc_id, is_solution, num, sought,
    LASTNN(CASE WHEN sought THEN NULL ELSE num END NN) OVER b AS low_num, LASTNN(page NN) OVER b AS low_page, LASTNN(y_top NN) OVER b AS low_y,
    LASTNN(CASE WHEN sought THEN NULL ELSE num END NN) OVER a AS up_num, LASTNN(page NN) OVER a AS up_page, LASTNN(y_top NN) OVER a AS up_y
  FROM placed WINDOW b AS (PARTITION BY doc_id, is_solution ORDER BY num), a AS (PARTITION BY doc_id, is_solution ORDER BY num DESC)) x WHERE sought""")

_HEADS = [r"^(\S+)", r"^([^\s.]*)[.]", r"^([^\s)]*)[)]"]
_HEAD = r"""
SELECT doc_id, page, seq, y_top, x_left, x_right, regexp_replace(regexp_replace(regexp_extract(trim(text), r'{head}', 1), r'^[.)\-:]+', ''), r'[.)\-:]+$', '') AS bare FROM {{e_section_state}}"""
_NUMBERS = rf"""
SELECT DISTINCT doc_id, page, seq, y_top, x_left, x_right, CAST(fixed AS INT) AS num FROM (
  SELECT *, translate(bare, '{fx.OCR_LETTERS}', '{fx.OCR_DIGITS}') AS fixed FROM ({" UNION ALL ".join(_HEAD.format(head=h) for h in _HEADS)}) a WHERE length(bare) BETWEEN 1 AND 3) b
WHERE LIKE_RE(fixed, r'^[0-9]{{1,3}}$')"""
#: Spark reads each text once and takes only those apart that begin as a number may.
_READ_ONCE = rf"""SELECT doc_id, page, seq, y_top, x_left, x_right, regexp_replace(regexp_replace(head, r'^[.)\-:]+', ''), r'[.)\-:]+$', '') AS bare FROM (
  SELECT *, explode(array({", ".join(f"regexp_extract(t, r'{h}', 1)" for h in _HEADS)})) AS head FROM (
    SELECT doc_id, page, seq, y_top, x_left, x_right, trim(text) AS t FROM {{e_section_state}}) n WHERE regexp_like(t, r'^[.)\-:]*[0-9{fx.OCR_LETTERS}]{{1,3}}(?:[.)\-:\s]|$)')) o"""
relation("line_numbers", "Numbers that a line's first word can be read as: the whole of it, or what stands before a full stop or bracket.", _NUMBERS, spark=_NUMBERS.replace(" UNION ALL ".join(_HEAD.format(head=h) for h in _HEADS), _READ_ONCE))

#: The lower and upper bound of a missing number m: the neighbour next to it on either side; if only one of the two is known
#: the other end is open; if neither is, the nearest known numbers. What was last recovered (l_) counts as known.
_LOW = "({l_num} > coalesce({m}low_num, -1))"
_BOUNDS = (
    "(CASE WHEN {low} THEN {l_num} ELSE {m}low_num END = {m}num - 1 OR coalesce({m}up_num <> {m}num + 1, true))",
    "(coalesce({m}up_num = {m}num + 1, false) OR coalesce(CASE WHEN {low} THEN {l_num} ELSE {m}low_num END <> {m}num - 1, true))",
)
_FITS = (
    "({m}low_num IS NOT NULL OR {l_num} IS NOT NULL OR {m}up_num IS NOT NULL)"
    " AND (NOT coalesce({lower}, true) OR CASE WHEN {low} THEN {l_page} ELSE {m}low_page END IS NULL OR {c}page > CASE WHEN {low} THEN {l_page} ELSE {m}low_page END"
    " OR ({c}page = CASE WHEN {low} THEN {l_page} ELSE {m}low_page END AND {c}y_top > CASE WHEN {low} THEN {l_y} ELSE {m}low_y END))"
    " AND (NOT coalesce({upper}, true) OR {m}up_page IS NULL OR {c}page < {m}up_page OR ({c}page = {m}up_page AND {c}y_top < {m}up_y))"
)


def _fits(m: str, c: str, last: str) -> str:
    names = {"m": m, "c": c, "l_num": f"{last}num", "l_page": f"{last}page", "l_y": f"{last}y_top"}
    names["low"] = f"coalesce({_LOW.format(**names)}, false)"
    lower, upper = (b.format(**names) for b in _BOUNDS)
    return _FITS.format(**names, lower=lower, upper=upper)


_FOUND = ("num", "page", "y_top", "x_left", "seq", "x_right")
_TODO = """
WITH found AS (
  SELECT m.doc_id, m.is_solution, m.num, {lines} AS places FROM {{missing_numbers}} m JOIN {{line_numbers}} l ON l.doc_id = m.doc_id AND l.num = m.num GROUP BY m.doc_id, m.is_solution, m.num
), todo AS (
  SELECT /*M f*/ m.*, f.places, CAST(row_number() OVER (PARTITION BY m.doc_id, m.is_solution ORDER BY m.num) AS INT) AS i
  FROM {{missing_numbers}} m JOIN found f ON m.doc_id = f.doc_id AND m.is_solution = f.is_solution AND m.num = f.num
)"""
_ORDER = "l.page, l.y_top, l.x_left, l.seq, l.x_right"
relation("e_recover_chain", "Lines whose first word reads as a missing number and that stand between its neighbours, the earliest of each; in order of the numbers, so that what is found bounds the next.", "",
    spark=_TODO.format(lines=f"array_sort(collect_list(named_struct('page', l.page, 'y_top', l.y_top, 'x_left', l.x_left, 'seq', l.seq, 'x_right', l.x_right)))") + f"""
SELECT doc_id, is_solution, inline(aggregate(todo, CAST(array() AS array<struct<num: int, page: int, y_top: double, x_left: double, seq: bigint, x_right: double>>), (found, m) ->
  concat(found, transform(slice(filter(m.places, c -> {_fits("m.", "c.", "try_element_at(found, -1).")}), 1, 1), c -> named_struct('num', m.num, 'page', c.page, 'y_top', c.y_top, 'x_left', c.x_left, 'seq', c.seq, 'x_right', c.x_right)))))
FROM (SELECT doc_id, is_solution, array_sort(collect_list(struct(num, low_num, low_page, low_y, up_num, up_page, up_y, places))) AS todo FROM todo GROUP BY doc_id, is_solution) x""",
    other=_TODO.format(lines=f"list(struct_pack(page := l.page, y_top := l.y_top, x_left := l.x_left, seq := l.seq, x_right := l.x_right) ORDER BY {_ORDER})").replace("WITH found", "WITH RECURSIVE found") + f""", walk AS (
  SELECT DISTINCT doc_id, is_solution, 0 AS i, CAST(NULL AS INT) AS num, CAST(NULL AS INT) AS page, CAST(NULL AS DOUBLE) AS y_top, CAST(NULL AS STRUCT(page INTEGER, y_top DOUBLE, x_left DOUBLE, seq BIGINT, x_right DOUBLE)) AS place FROM todo
  UNION ALL
  SELECT doc_id, is_solution, i, CASE WHEN p IS NULL THEN l_num ELSE num END, CASE WHEN p IS NULL THEN l_page ELSE p.page END, CASE WHEN p IS NULL THEN l_y ELSE p.y_top END, p FROM (
    SELECT t.doc_id, t.is_solution, t.i, t.num, w.num AS l_num, w.page AS l_page, w.y_top AS l_y, list_filter(t.places, lambda c: {_fits("t.", "c.", "w.")})[1] AS p
    FROM walk w JOIN todo t ON t.doc_id = w.doc_id AND t.is_solution = w.is_solution AND t.i = w.i + 1) x
)
SELECT doc_id, is_solution, num, place.page AS page, place.y_top AS y_top, place.x_left AS x_left, place.seq AS seq, place.x_right AS x_right FROM walk WHERE place IS NOT NULL""")  # fmt: skip

relation("c_recover_markers", "Markers with those recovered from misread numbers, which are weak.", """
SELECT doc_id, page, seq, y_top, x_left, x_right, q_num, is_strong, is_solution, false AS recovered FROM {c_drop_key_cells}
UNION ALL SELECT doc_id, page, seq, y_top, x_left, x_right, CAST(num AS STRING), false, is_solution, true FROM {e_recover_chain}""")

def detect(source: str, width: str, times: str = "1") -> dict[str, str]:
    """SQL for columns by the density of boxes (x_left, x_right) of `source` over 200 bins of a page of that width; in Spark a row counts `times` times."""
    return {
        "spark": f"""
WITH deltas AS (
  SELECT doc_id, page, inline(array(struct(CAST(greatest(0, floor(x_left / ({width} / 200.0))) AS INT) AS bin, {times} AS d), struct(CAST(least(199, floor(x_right / ({width} / 200.0))) AS INT) + 1 AS bin, -{times} AS d))) FROM {{{source}}} WHERE x_right > x_left
), bins AS (
  SELECT doc_id, page, bin, sum(sum(d)) OVER (PARTITION BY doc_id, page ORDER BY bin) AS n, lead(bin, 1, 200) OVER (PARTITION BY doc_id, page ORDER BY bin) AS nxt FROM deltas GROUP BY doc_id, page, bin
), inside AS (
  SELECT *, n > greatest(1.0, 0.18 * max(n) OVER (PARTITION BY doc_id, page)) AS dense FROM bins WHERE nxt > bin
), runs AS (
  SELECT doc_id, page, min(bin) AS s, max(nxt) - 1 AS e FROM (
    SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id, page ORDER BY bin) AS g FROM (
      SELECT *, coalesce(bin - lag(nxt) OVER (PARTITION BY doc_id, page ORDER BY bin) >= 6, true) AS fresh FROM inside WHERE dense) x) y GROUP BY doc_id, page, g
), cores AS (
  SELECT doc_id, page, array_sort(collect_list(struct(s, e))) AS c FROM runs GROUP BY doc_id, page
), wide AS (
  SELECT doc_id, page, aggregate(sequence(1, size(c)), c, (a, i) -> CASE WHEN size(a) <= 1 OR array_min(transform(a, x -> x.e - x.s + 1)) >= 24 THEN a ELSE
    transform(array(array_position(transform(a, x -> x.e - x.s + 1), array_min(transform(a, x -> x.e - x.s + 1)))), k ->
      transform(array(CASE WHEN k = 1 THEN 1 WHEN k = size(a) THEN k - 1 WHEN element_at(a, CAST(k AS INT)).s - element_at(a, CAST(k AS INT) - 1).e <= element_at(a, CAST(k AS INT) + 1).s - element_at(a, CAST(k AS INT)).e THEN k - 1 ELSE k END), j ->
        concat(slice(a, 1, CAST(j AS INT) - 1), array(named_struct('s', element_at(a, CAST(j AS INT)).s, 'e', element_at(a, CAST(j AS INT) + 1).e)), slice(a, CAST(j AS INT) + 2, size(a))))[0])[0] END) AS c FROM cores
)
SELECT doc_id, page, CAST(i AS INT) AS col, CASE WHEN i = 0 THEN 0.0D ELSE (c[i - 1].e + 1 + c[i].s) / 2.0D * (CAST({width} AS DOUBLE) / 200.0D) END AS x0,
  CASE WHEN i = size(c) - 1 THEN CAST({width} AS DOUBLE) ELSE (c[i].e + 1 + c[i + 1].s) / 2.0D * (CAST({width} AS DOUBLE) / 200.0D) END AS x1
FROM wide LATERAL VIEW explode(sequence(0, size(c) - 1)) t AS i
UNION ALL SELECT p.doc_id, p.page, 0, 0.0D, CAST({width} AS DOUBLE) FROM (SELECT DISTINCT doc_id, page FROM {{{source}}}) p LEFT ANTI JOIN cores c ON p.doc_id = c.doc_id AND p.page = c.page""",
        "other": f"""
WITH RECURSIVE deltas AS (
  SELECT doc_id, page, CAST(greatest(0, floor(x_left / ({width} / 200.0))) AS INT) AS bin, 1 AS d FROM {{{source}}} WHERE x_right > x_left
  UNION ALL SELECT doc_id, page, CAST(least(199, floor(x_right / ({width} / 200.0))) AS INT) + 1, -1 FROM {{{source}}} WHERE x_right > x_left
), bins AS (
  SELECT doc_id, page, bin, sum(sum(d)) OVER (PARTITION BY doc_id, page ORDER BY bin) AS n, lead(bin, 1, 200) OVER (PARTITION BY doc_id, page ORDER BY bin) AS nxt FROM deltas GROUP BY doc_id, page, bin
), inside AS (
  SELECT *, n > greatest(1.0, 0.18 * max(n) OVER (PARTITION BY doc_id, page)) AS dense FROM bins WHERE nxt > bin
), runs AS (
  SELECT doc_id, page, min(bin) AS s, max(nxt) - 1 AS e FROM (
    SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id, page ORDER BY bin) AS g FROM (
      SELECT *, coalesce(bin - lag(nxt) OVER (PARTITION BY doc_id, page ORDER BY bin) >= 6, true) AS fresh FROM inside WHERE dense) x) y GROUP BY doc_id, page, g
), cores AS (
  SELECT doc_id, page, list(struct_pack(s := s, e := e) ORDER BY s) AS c FROM runs GROUP BY doc_id, page
), merging AS (
  SELECT doc_id, page, c FROM cores
  UNION ALL
  SELECT doc_id, page, list_concat(list_concat(c[1:j - 1], [struct_pack(s := c[j].s, e := c[j + 1].e)]), c[j + 2:len(c)]) AS c FROM (
    SELECT doc_id, page, c, CASE WHEN k = 1 THEN 1 WHEN k = len(c) THEN k - 1 WHEN c[k].s - c[k - 1].e <= c[k + 1].s - c[k].e THEN k - 1 ELSE k END AS j FROM (
      SELECT doc_id, page, c, list_position(list_transform(c, lambda x: x.e - x.s + 1), list_min(list_transform(c, lambda x: x.e - x.s + 1))) AS k FROM merging
      WHERE len(c) > 1 AND list_min(list_transform(c, lambda x: x.e - x.s + 1)) < 24) a) b
), wide AS (
  SELECT doc_id, page, c FROM merging WHERE len(c) = 1 OR list_min(list_transform(c, lambda x: x.e - x.s + 1)) >= 24
)
SELECT doc_id, page, CAST(i AS INT) AS col, CASE WHEN i = 0 THEN CAST(0 AS DOUBLE) ELSE (c[i].e + 1 + c[i + 1].s) / 2.0 * ({width} / 200.0) END AS x0,
  CASE WHEN i = len(c) - 1 THEN CAST({width} AS DOUBLE) ELSE (c[i + 1].e + 1 + c[i + 2].s) / 2.0 * ({width} / 200.0) END AS x1
FROM (SELECT *, unnest(range(len(c))) AS i FROM wide) w
UNION ALL SELECT p.doc_id, p.page, 0, CAST(0 AS DOUBLE), CAST({width} AS DOUBLE) FROM (SELECT DISTINCT doc_id, page FROM {{{source}}}) p WHERE NOT EXISTS (SELECT 1 FROM cores c WHERE p.doc_id = c.doc_id AND p.page = c.page)""",
    }


relation("d_detect_columns", "Columns of each page from the density of its lines over 200 bins; one where no two lines share a bin.", "", **detect("detectable_lines", W))
_DETECTABLE_LINES = """
SELECT doc_id, page, x_left, x_right FROM {content_lines}
UNION ALL SELECT l.doc_id, l.page, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM {all_pages} l WHERE NOT EXISTS (SELECT 1 FROM {content_lines} c WHERE c.doc_id = l.doc_id AND c.page = l.page)"""
relation("detectable_lines", "Content lines; on pages that have none, all lines.", _DETECTABLE_LINES, spark=placed(_DETECTABLE_LINES))

_VALIDATE_COLUMNS = rf"""
WITH marks AS (
  SELECT s.doc_id, s.page, count(*) AS n, count(DISTINCT c.col) AS cols, max(c.col) AS col FROM {{c_recover_markers}} s JOIN {{detected_column_of}} c ON s.doc_id = c.doc_id AND s.page = c.page AND s.seq = c.seq GROUP BY s.doc_id, s.page
), others AS (
  SELECT /*M m*/ l.doc_id, l.page, count(*) AS n, count_if(NOT LIKE_RE(trim(l.text), r'{fx.OPTION_START}')) AS prose
  FROM {{content_lines}} l JOIN {{detected_column_of}} c ON l.doc_id = c.doc_id AND l.page = c.page AND l.seq = c.seq JOIN marks m ON l.doc_id = m.doc_id AND l.page = m.page AND c.col <> m.col
  WHERE l.x_right > l.x_left GROUP BY l.doc_id, l.page
), single AS (
  SELECT /*M o*/ m.doc_id, m.page FROM marks m LEFT JOIN others o ON m.doc_id = o.doc_id AND m.page = o.page
  WHERE m.n >= 2 AND m.cols = 1 AND NOT coalesce(o.n >= 4 AND o.prose >= greatest(4, CAST(floor(o.n * 0.5) AS INT)), false)
)
SELECT /*M s*/ c.doc_id, c.page, c.col, CASE WHEN s.doc_id IS NULL THEN c.x0 ELSE CAST(0 AS DOUBLE) END AS x0, CASE WHEN s.doc_id IS NULL THEN c.x1 ELSE CAST({W} AS DOUBLE) END AS x1
FROM {{d_detect_columns}} c LEFT JOIN single s ON c.doc_id = s.doc_id AND c.page = s.page WHERE s.doc_id IS NULL OR c.col = 0"""
relation("d_validate_columns", "Detected columns of each page, made one where all of two or more markers stand in one column and the others hold only options.", _VALIDATE_COLUMNS, spark=placed(_VALIDATE_COLUMNS))

relation("d_columns_from_markers", "Columns from clusters of two or more markers' left edges, further apart than 12 per cent of the page; each ends where the next begins.", f"""
WITH gaps AS (
  SELECT doc_id, page, x_left, seq, q_num, is_solution, CASE WHEN x_left - lag(x_left) OVER (PARTITION BY doc_id, page ORDER BY x_left, seq, q_num, is_solution) > 0.12 * {W} THEN 1 ELSE 0 END AS fresh FROM {{c_recover_markers}}
), clusters AS (
  SELECT doc_id, page, g, min(x_left) AS margin FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, page ORDER BY x_left, seq, q_num, is_solution) AS g FROM gaps) x GROUP BY doc_id, page, g HAVING count(*) >= 2
)
SELECT doc_id, page, CAST(i - 1 AS INT) AS col, CASE WHEN i = 1 THEN CAST(0 AS DOUBLE) ELSE greatest(0.0, margin - 6) END AS x0, CASE WHEN nxt IS NULL THEN CAST({W} AS DOUBLE) ELSE greatest(0.0, nxt - 6) END AS x1 FROM (
  SELECT doc_id, page, margin, row_number() OVER (PARTITION BY doc_id, page ORDER BY g) AS i, lead(margin) OVER (PARTITION BY doc_id, page ORDER BY g) AS nxt, count(*) OVER (PARTITION BY doc_id, page) AS n FROM clusters) x WHERE n >= 2""")

relation("d_drop_numbered_options", "Weak markers that hang at a margin of numbers too high for options; indented ones are options and go.", """
WITH anchors AS (
  SELECT doc_id, page, is_solution, x_left FROM {d_strong_filter} WHERE NOT is_strong AND TRY_CAST(regexp_extract(q_num, '([0-9]+)', 1) AS INT) >= 6
), page_margins AS (
  SELECT doc_id, page, is_solution, min(x_left) AS m FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY doc_id, page, is_solution ORDER BY x_left) AS g FROM (
      SELECT *, CASE WHEN x_left - lag(x_left) OVER (PARTITION BY doc_id, page, is_solution ORDER BY x_left) > 6 THEN 1 ELSE 0 END AS fresh FROM (SELECT DISTINCT * FROM anchors) a) b) c GROUP BY doc_id, page, is_solution, g
), doc_margins AS (
  SELECT doc_id, is_solution, min(x_left) AS m FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY doc_id, is_solution ORDER BY x_left) AS g FROM (
      SELECT *, CASE WHEN x_left - lag(x_left) OVER (PARTITION BY doc_id, is_solution ORDER BY x_left) > 6 THEN 1 ELSE 0 END AS fresh FROM (SELECT DISTINCT doc_id, is_solution, x_left FROM anchors) a) b) c GROUP BY doc_id, is_solution, g
), projected AS (
  SELECT p.doc_id, p.page, p.is_solution, coalesce(min(w.x_left), p.m) AS m FROM (
    SELECT /*M g*/ DISTINCT k.doc_id, k.page, k.is_solution, g.m FROM {d_strong_filter} k JOIN doc_margins g ON k.doc_id = g.doc_id AND k.is_solution = g.is_solution
    WHERE NOT EXISTS (SELECT /*M q*/ 1 FROM page_margins q WHERE q.doc_id = k.doc_id AND q.page = k.page AND q.is_solution = k.is_solution)) p
  LEFT JOIN {d_strong_filter} w ON p.doc_id = w.doc_id AND p.page = w.page AND p.is_solution = w.is_solution AND NOT w.is_strong AND abs(w.x_left - p.m) < 50
  GROUP BY p.doc_id, p.page, p.is_solution, p.m
), margins AS (SELECT * FROM page_margins UNION ALL SELECT * FROM projected), homes AS (
  SELECT /*M m*/ k.doc_id, k.page, k.seq, coalesce(max(CASE WHEN k.x_left >= m.m - 9 THEN m.m END), min(m.m)) AS own
  FROM {d_strong_filter} k JOIN margins m ON k.doc_id = m.doc_id AND k.page = m.page AND k.is_solution = m.is_solution GROUP BY k.doc_id, k.page, k.seq
)
SELECT /*M h*/ k.* FROM {d_strong_filter} k LEFT JOIN homes h ON k.doc_id = h.doc_id AND k.page = h.page AND k.seq = h.seq
WHERE k.is_strong OR h.own IS NULL OR k.x_left <= h.own + 9""")

relation("first_markers", "Pages with markers: whether one is strong, and where each column's first one stands.", """
SELECT m.doc_id, m.page, c.col, min(m.y_top) AS y, bool_or(bool_or(m.is_strong)) OVER (PARTITION BY m.doc_id, m.page) AS strong, min(CASE WHEN m.is_strong THEN m.y_top END) AS strong_y,
  min(c.col) OVER (PARTITION BY m.doc_id, m.page) AS leftmost, min(m.page) OVER (PARTITION BY m.doc_id) AS first_page
FROM {c_recover_markers} m JOIN {c_column_of} c ON m.doc_id = c.doc_id AND m.page = c.page AND m.seq = c.seq GROUP BY m.doc_id, m.page, c.col""")

_BANNER_HEADERS = f"""
WITH crossing AS (
  SELECT DISTINCT l.doc_id, l.page, l.seq FROM {{content_lines}} l JOIN {{page_columns}} c ON l.doc_id = c.doc_id AND l.page = c.page AND l.x_left < c.x1 AND c.x1 < l.x_right AND c.x1 < {W}
), anchors AS (
  SELECT doc_id, page, CAST(NULL AS INT) AS col, min(strong_y) AS y, CAST(NULL AS BOOLEAN) AS whole FROM {{first_markers}} WHERE strong GROUP BY doc_id, page
  UNION ALL SELECT doc_id, page, col, y, col <> leftmost OR page = first_page FROM {{first_markers}} WHERE NOT strong
), above AS (
  SELECT a.doc_id, a.page, a.col AS own, a.whole, l.seq, l.y_top, l.y_bottom, count(*) OVER w AS n,
    bool_or({_QUESTION.replace('{t}', 'l.text')}) OVER w AS bad
  FROM anchors a JOIN {{content_lines}} l ON l.doc_id = a.doc_id AND l.page = a.page AND l.y_top < a.y AND l.y_top <= 0.15 * {H} AND a.y <= 0.25 * {H}
  WINDOW w AS (PARTITION BY a.doc_id, a.page, a.col)
)
SELECT /*M x*/ DISTINCT b.doc_id, b.page, b.y_top, b.y_bottom FROM above b JOIN {{c_column_of}} c ON b.doc_id = c.doc_id AND b.page = c.page AND b.seq = c.seq
LEFT JOIN crossing x ON b.doc_id = x.doc_id AND b.page = x.page AND b.seq = x.seq
WHERE b.n <= 4 AND NOT b.bad AND (b.own IS NULL OR (c.col = b.own AND (b.whole OR x.seq IS NOT NULL)))"""
relation("d_banner_headers", "Banners: up to four lines in the top 15 per cent above a first marker that stands in the top quarter, none of them a question's. Where a page has strong markers, those above the first; else those of a column above its own first marker, in the leftmost column only if they cross a gutter or no earlier page has markers.", _BANNER_HEADERS, spark=placed(_BANNER_HEADERS))
