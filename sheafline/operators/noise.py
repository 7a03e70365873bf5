"""Furniture, frames, underlines, watermarks, pairs of languages and other tests between boxes."""

from ..functions import fixed as fx
from ..relations import SETTINGS, SHARED, relation
from .folds import greedy

SHARED |= {"strokes", "figures", "placed_figures", "frame_candidates", "kept_frames", "furniture_lines", "c_underline_filter"}

# Limits of frames, rules, branding rows, drawings with text and watermarks, as shares of the page, points or counts.
SETTINGS |= {
    "border_points": 3.0, "border_share": 0.01, "frame_width": 0.10, "frame_height": 0.03, "frame_play": 6.0, "rule_thick": 0.04, "rule_long": 0.18, "brand_gap": 0.02,
    "background_height": 0.6, "margin_top": 8.0, "margin_bottom": 80.0, "underline_share": 0.3, "underline_above": 0.2, "underline_below": 0.45, "figure_lines": 3, "figure_text": 0.18,
    "dense_strokes": 8, "dense_share": 0.6, "short_stroke": 0.33, "riding_above": 0.25, "riding_below": 0.5, "watermark_play": 0.02, "watermark_share": 0.5, "watermark_pages": 3,
}
W, H = "$(page_width)", "$(page_height)"

relation("brand_bands", "Heights of branding links.", f"""
SELECT doc_id, page, y0, y1 FROM {{links}} WHERE {" OR ".join(f"contains(lower(uri), '{h}')" for h in fx.BRANDING_HOSTS)}""")

relation("c_drop_branding_bands", "Lines and figures clear of branding links (figures by two per cent of the page).", """
SELECT 'line' AS kind, l.doc_id, l.page, l.seq AS id FROM {lines} l WHERE NOT EXISTS (SELECT 1 FROM {brand_bands} b WHERE b.doc_id = l.doc_id AND b.page = l.page AND l.y_top < b.y1 AND l.y_bottom > b.y0)
UNION ALL
SELECT 'figure', f.doc_id, f.page, f.fig_id FROM {figures} f WHERE NOT EXISTS (SELECT 1 FROM {brand_bands} b WHERE b.doc_id = f.doc_id AND b.page = f.page AND f.y0 < b.y1 + $(brand_gap) * $(page_height) AND f.y1 > b.y0 - $(brand_gap) * $(page_height))""")

_RIDES = """least(l.x_right, s.x1) - greatest(l.x_left, s.x0) > 0 AND least(l.x_right, s.x1) - greatest(l.x_left, s.x0) >= $(underline_share) * (s.x1 - s.x0) AND l.y_bottom > l.y_top
  AND (s.y0 + s.y1) / 2 BETWEEN l.y_top - $({above}) * (l.y_bottom - l.y_top) AND l.y_bottom + $({below}) * (l.y_bottom - l.y_top)"""
relation("c_underline_filter", "Strokes that do not ride along a line of text as its underline.", f"""
SELECT s.doc_id, s.page, s.stroke_id FROM {{strokes}} s WHERE NOT EXISTS (SELECT 1 FROM {{lines}} l WHERE l.doc_id = s.doc_id AND l.page = s.page AND s.x1 > s.x0 AND {_RIDES.format(above="underline_above", below="underline_below")})""")

relation("frame_candidates", "Frames: two upright strokes at one height and a level one that joins their tops or feet; and rectangles drawn by one stroke.", f"""
WITH levels AS (SELECT * FROM {{strokes}} WHERE y1 - y0 <= greatest($(border_points), $(border_share) * {H}) AND x1 - x0 >= $(frame_width) * {W}),
uprights AS (SELECT * FROM {{strokes}} WHERE NOT (y1 - y0 <= greatest($(border_points), $(border_share) * {H}) AND x1 - x0 >= $(frame_width) * {W}) AND x1 - x0 <= greatest($(border_points), $(border_share) * {W}) AND y1 - y0 >= $(frame_height) * {H}),
pairs AS (
  SELECT a.doc_id, a.page, a.x0, b.x1, least(a.y0, b.y0) AS y0, greatest(a.y1, b.y1) AS y1 FROM uprights a JOIN uprights b ON a.doc_id = b.doc_id AND a.page = b.page AND (a.x0 < b.x0 OR (a.x0 = b.x0 AND a.stroke_id < b.stroke_id))
    AND abs(a.y0 - b.y0) <= $(frame_play) AND abs(a.y1 - b.y1) <= $(frame_play) AND b.x1 - a.x0 >= $(frame_width) * {W} AND greatest(a.y1, b.y1) - least(a.y0, b.y0) >= $(frame_height) * {H}
)
SELECT DISTINCT doc_id, page, x0, y0, x1, y1 FROM (
  SELECT p.* FROM pairs p WHERE EXISTS (SELECT 1 FROM levels h WHERE h.doc_id = p.doc_id AND h.page = p.page AND h.x0 <= p.x0 + $(frame_play) AND h.x1 >= p.x1 - $(frame_play)
    AND (abs((h.y0 + h.y1) / 2 - p.y0) <= $(frame_play) OR abs((h.y0 + h.y1) / 2 - p.y1) <= $(frame_play)))
  UNION ALL SELECT doc_id, page, x0, x1, y0, y1 FROM {{strokes}} WHERE is_rect AND x1 - x0 >= $(frame_width) * {W} AND y1 - y0 >= $(frame_height) * {H}) f""")
greedy("kept_frames", "Frames that lie in no larger kept one.", "frame_candidates", "doc_id, page", {"neg_area": "-(x1 - x0) * (y1 - y0)", "x0": "x0", "y0": "y0", "x1": "x1", "y1": "y1"},
    "{r}.x0 >= {k}.x0 - $(frame_play) AND {r}.x1 <= {k}.x1 + $(frame_play) AND {r}.y0 >= {k}.y0 - $(frame_play) AND {r}.y1 <= {k}.y1 + $(frame_play)")
relation("c_content_boxes", "Frames around content: of two kinds, without those inside a larger one.", "SELECT doc_id, page, x0, x1, y0, y1 FROM {kept_frames}")

relation("furniture_lines", "Lines with whether they advertise, and whether they are furniture: that, or a page number of its kind in a margin.", rf"""
SELECT doc_id, page, seq, y_top, y_bottom, x_left, x_right, brand, brand OR (LIKE_RE(trim(text), r'{fx.PAGE_OF}') AND (y_top / {H} * 100 <= $(margin_top) OR y_bottom / {H} * 100 >= $(margin_bottom))) AS furniture
FROM (SELECT *, LIKE_RE(text, r'{fx.BRANDING_TEXT}') OR LIKE_RE(text, r'{fx.FURNITURE_TEXT}') AS brand FROM {{page_lines}}) x""")

relation("branding_rows", "Rows of branding: links' heights merged while the next begins within two per cent of the page below all before it, and advertising lines.", f"""
SELECT doc_id, page, min(y0) AS y0, max(y1) AS y1 FROM (
  SELECT *, sum(CASE WHEN y0 <= reach + $(brand_gap) * {H} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM (
    SELECT doc_id, page, y0, y1, max(y1) OVER (PARTITION BY doc_id, page ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {{brand_bands}}) a) b GROUP BY doc_id, page, g
UNION ALL SELECT doc_id, page, y_top, y_bottom FROM {{furniture_lines}} WHERE brand""")

relation("c_furniture_rects", "Rectangles to paint over: branding links; lines of furniture; pictures beside a row of branding, but for a page's background; long thin rules that are neither underlines nor sides of frames.", f"""
SELECT doc_id, page, x0, y0, x1, y1, 'link' AS kind FROM {{links}} WHERE {" OR ".join(f"contains(lower(uri), '{h}')" for h in fx.BRANDING_HOSTS)}
UNION ALL SELECT doc_id, page, x_left, y_top, x_right, y_bottom, 'text' FROM {{furniture_lines}} WHERE furniture
UNION ALL
SELECT i.doc_id, i.page, i.x0, i.y0, i.x1, i.y1, 'image' FROM {{placed_images}} i WHERE i.y1 - i.y0 < $(background_height) * {H}
  AND EXISTS (SELECT 1 FROM {{branding_rows}} b WHERE b.doc_id = i.doc_id AND b.page = i.page AND i.y0 < b.y1 + $(brand_gap) * {H} AND i.y1 > b.y0 - $(brand_gap) * {H})
UNION ALL
SELECT s.doc_id, s.page, s.x0, s.y0, s.x1, s.y1, 'rule' FROM (SELECT *, y1 - y0 <= $(rule_thick) * {H} AND x1 - x0 >= $(rule_long) * {W} AS level FROM {{strokes}} WHERE x1 > x0 OR y1 > y0) s
WHERE (s.level OR (s.x1 - s.x0 <= $(rule_thick) * {W} AND s.y1 - s.y0 >= $(rule_long) * {H}))
  AND NOT EXISTS (SELECT 1 FROM {{c_content_boxes}} f WHERE f.doc_id = s.doc_id AND f.page = s.page AND s.x0 >= f.x0 - $(frame_play) AND s.x1 <= f.x1 + $(frame_play) AND s.y0 >= f.y0 - $(frame_play) AND s.y1 <= f.y1 + $(frame_play)
    AND (abs(s.x0 - f.x0) <= $(frame_play) OR abs(s.x1 - f.x1) <= $(frame_play) OR abs(s.y0 - f.y0) <= $(frame_play) OR abs(s.y1 - f.y1) <= $(frame_play)))
  AND NOT EXISTS (SELECT 1 FROM {{furniture_lines}} l WHERE l.doc_id = s.doc_id AND l.page = s.page AND s.level AND NOT l.furniture AND s.x1 > s.x0 AND {_RIDES.format(above="underline_above", below="underline_below")})""")

relation("c_text_enclosure", "Figures that are drawings: at most three lines of text reach into them and little of them is text; or they hold many strokes, most of them short, that ride on no text.", f"""
WITH t AS (
  SELECT f.doc_id, f.page, f.fig_id, count(*) AS n, sum((least(l.x_right, f.x1) - greatest(l.x_left, f.x0)) * (least(l.y_bottom, f.y1) - greatest(l.y_top, f.y0))) AS area FROM {{figures}} f JOIN {{lines}} l ON l.doc_id = f.doc_id AND l.page = f.page
    AND least(l.x_right, f.x1) > greatest(l.x_left, f.x0) AND least(l.y_bottom, f.y1) > greatest(l.y_top, f.y0) GROUP BY f.doc_id, f.page, f.fig_id
), free AS (
  SELECT s.* FROM {{strokes}} s WHERE NOT EXISTS (SELECT 1 FROM {{lines}} l WHERE l.doc_id = s.doc_id AND l.page = s.page AND {_RIDES.format(above="riding_above", below="riding_below")})
), k AS (
  SELECT f.doc_id, f.page, f.fig_id, count(*) AS n, count_if(s.x1 - s.x0 <= $(short_stroke) * {W} AND s.y1 - s.y0 <= $(short_stroke) * {H}) AS short FROM {{figures}} f JOIN free s ON s.doc_id = f.doc_id AND s.page = f.page
    AND (s.x0 + s.x1) / 2 BETWEEN f.x0 AND f.x1 AND (s.y0 + s.y1) / 2 BETWEEN f.y0 AND f.y1 GROUP BY f.doc_id, f.page, f.fig_id
)
SELECT f.doc_id, f.page, f.fig_id FROM {{figures}} f LEFT JOIN t ON t.doc_id = f.doc_id AND t.page = f.page AND t.fig_id = f.fig_id LEFT JOIN k ON k.doc_id = f.doc_id AND k.page = f.page AND k.fig_id = f.fig_id
WHERE NOT (coalesce(t.n, 0) > $(figure_lines) OR coalesce(t.area, 0) > $(figure_text) * (f.x1 - f.x0) * (f.y1 - f.y0)) OR (coalesce(k.n, 0) >= $(dense_strokes) AND k.short >= $(dense_share) * k.n)""")

relation("placed_figures", "Each figure's place as shares of the page, in its cell of 2 per cent and those beside it; figures at one place are compared as one.", """
SELECT *, EXPLODE(SEQ(cell - 1, cell + 1)) AS near FROM (
  SELECT doc_id, page, fig_id, x0 / $(page_width) AS a, x1 / $(page_width) AS b, y0 / $(page_height) AS c, y1 / $(page_height) AS d, CAST(floor(x0 / $(page_width) / $(watermark_play)) AS INT) AS cell FROM {figures}) x""")

relation("c_watermarks", "Figures that do not stand at one place on at least half of a document's pages, or three.", """
WITH n AS (SELECT doc_id, greatest($(watermark_pages), BROUND(max(page) * $(watermark_share), 0)) AS least_pages FROM {figures} GROUP BY doc_id),
g AS (SELECT doc_id, a, b, c, d, cell, COLLECT_SET(page) AS on_pages FROM {placed_figures} WHERE near = cell GROUP BY doc_id, a, b, c, d, cell),
p AS (SELECT DISTINCT doc_id, a, b, c, d, near FROM {placed_figures}),
k AS (SELECT f.doc_id, f.a, f.b, f.c, f.d, SIZE(ADISTINCT(flatten(COLLECT(o.on_pages)))) AS pages FROM p f JOIN g o ON o.doc_id = f.doc_id AND o.cell = f.near
    AND abs(o.a - f.a) <= $(watermark_play) AND abs(o.b - f.b) <= $(watermark_play) AND abs(o.c - f.c) <= $(watermark_play) AND abs(o.d - f.d) <= $(watermark_play) GROUP BY f.doc_id, f.a, f.b, f.c, f.d),
m AS (SELECT f.doc_id, f.page, f.fig_id, k.pages FROM {placed_figures} f JOIN k ON f.doc_id = k.doc_id AND f.a = k.a AND f.b = k.b AND f.c = k.c AND f.d = k.d WHERE f.near = f.cell)
SELECT m.doc_id, m.page, m.fig_id FROM m JOIN n ON m.doc_id = n.doc_id WHERE m.pages < n.least_pages""")

relation("c_bilingual_exact", "Pairs of the only two items alike in side and number, on one page, side by side by their first segments; a document needs two pairs, or one among four numbers. First is the one with options A to D where one of them has any, else the left one.", """
WITH f AS (SELECT doc_id, item, page, x0, (x0 + x1) / 2 AS mid, row_number() OVER (PARTITION BY doc_id, item ORDER BY seg) AS rn FROM {segments}),
p AS (SELECT i.doc_id, i.is_solution, i.q_num, i.item, f.page, f.x0, f.mid, LIKE_RE(upper(coalesce(i.option_labels, '')), '[ABCD]') AS latin, count(*) OVER (PARTITION BY i.doc_id, i.is_solution, i.q_num) AS n
  FROM {items} i LEFT JOIN f ON i.doc_id = f.doc_id AND i.item = f.item AND f.rn = 1),
m AS (SELECT a.doc_id, a.is_solution, a.q_num, CASE WHEN a.latin <> b.latin THEN a.latin ELSE a.x0 <= b.x0 END AS ahead, a.item AS one, b.item AS other FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.is_solution = b.is_solution AND a.q_num = b.q_num
  AND a.n = 2 AND b.n = 2 AND a.item < b.item AND a.page = b.page AND abs(b.mid - a.mid) > 15),
d AS (SELECT doc_id, count(*) AS pairs FROM m GROUP BY doc_id), g AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, is_solution, q_num FROM p) x GROUP BY doc_id)
SELECT m.doc_id, m.is_solution, m.q_num, CASE WHEN m.ahead THEN m.one ELSE m.other END AS first, CASE WHEN m.ahead THEN m.other ELSE m.one END AS second
FROM m JOIN d ON m.doc_id = d.doc_id JOIN g ON m.doc_id = g.doc_id WHERE d.pairs >= 2 OR g.n <= 4""")

relation("d_bilingual_split", "Whether a document's markers pair up side by side (numbers that occur twice, further apart than 15 per cent of the page: two such, or one among four numbers), and the language column of each marker.", """
WITH pairs AS (
  SELECT doc_id, is_solution, q_num, count(*) AS n, max(x_left + x_right) / 2 - min(x_left + x_right) / 2 AS apart FROM {sided_markers} GROUP BY doc_id, is_solution, q_num
), judged AS (SELECT doc_id, count_if(n = 2 AND apart > 0.15 * $(page_width)) AS pairs, count(*) AS numbers FROM pairs GROUP BY doc_id)
SELECT m.doc_id, m.page, m.seq, j.pairs >= 2 OR (j.pairs = 1 AND j.numbers <= 4) AS bilingual,
  CASE WHEN NOT (j.pairs >= 2 OR (j.pairs = 1 AND j.numbers <= 4)) THEN 0 WHEN c.col <= 1 THEN c.col END AS language
FROM {sided_markers} m JOIN judged j ON m.doc_id = j.doc_id JOIN {c_column_of} c ON m.doc_id = c.doc_id AND m.page = c.page AND m.seq = c.seq""")
