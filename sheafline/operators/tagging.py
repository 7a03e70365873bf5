"""Projections and filters over lines: markers, headers, folios, branding, options, keys, scripts."""

from ..functions import fixed as fx
from ..functions import markers
from ..relations import SETTINGS, SHARED, built, relation

SHARED |= {"page_parts"}
SETTINGS |= {"probe": r"^(\d+)[.] (\w+)", "term": "s1", "question_prefix": "Q", "solution_prefix": "S", "first_number": 5, "number_digits": 3, "name_pattern": "(Name)_(width)x(HEIGHT)-(sizekb)-(size)-(date).(ext)-(n)", "name_date": "2024-01-31", "name_start": 11, "name_digits": 4}

#: The key under which repeated lines agree.
EXACT_KEY = "regexp_replace(lower(text), '[^a-z0-9]', ''/*G*/)"

relation("b_tag_markers", "Item markers: strong (a Q word and number) or weak (a leading number), with the number.", rf"""
SELECT doc_id, page, seq, y_top, y_bottom, x_left, x_right, CAST(CAST(n AS INT) AS STRING) AS q_num, is_strong
FROM (SELECT *, CASE WHEN strong <> '' AND NOT formula THEN strong
    WHEN weak_dot <> '' THEN weak_dot WHEN weak_paren <> '' AND LIKE_RE(t, r'\p{{L}}') THEN weak_paren ELSE weak_open END AS n,
    strong <> '' AND NOT formula AS is_strong
  FROM (SELECT *, regexp_extract(t, r'{fx.STRONG}', 1) AS strong, regexp_extract(t, r'{fx.WEAK_DOT}', 1) AS weak_dot,
      regexp_extract(t, r'{fx.WEAK_PAREN}', 1) AS weak_paren, regexp_extract(t, r'{fx.WEAK_OPEN}', 1) AS weak_open,
      LIKE_RE(t, r'^q\d') OR (LIKE_RE(t, r'^[Qq]\d+(?:\s|$)') AND LIKE_RE(t, r'[=+*-]')) AS formula
    FROM (SELECT *, trim(text) AS t FROM {{page_lines}}) a) b) c
WHERE n <> ''""")

_HEADERS = rf"""
SELECT doc_id, page, seq, y_top, y_bottom, x_left, x_right, text,
  length(t) <= 40 AND k IN ({fx.quoted(fx.SOLUTION_HEADERS)}) AS is_solution_header,
  length(t) <= 40 AND k IN ({fx.quoted(fx.KEY_HEADERS)}) AS is_key_header,
  length(t) <= 60 AND LIKE_RE(t, r'{fx.SECTION}') AS is_section_header
FROM (SELECT *, trim(text) AS t, regexp_replace(lower(trim(text)), '[^a-z0-9]', ''/*G*/) AS k FROM {{page_lines}}) x"""
_HEADER_KEY = "regexp_replace(lower(trim(text)), '[^a-z0-9]', ''/*G*/)"
#: Spark makes keys of short lines only; those of others are not looked at.
relation("b_tag_headers", "Lines that are solution, answer-key or section headers.", _HEADERS, spark=_HEADERS.replace(_HEADER_KEY, f"CASE WHEN length(trim(text)) <= 40 THEN {_HEADER_KEY} END"))

relation("b_tag_folio", "Page numbers that stand in a margin.", rf"""
SELECT doc_id, page, seq, text, top_pct, bottom_pct,
  length(trim(text)) <= 20 AND LIKE_RE(trim(text), r'{fx.FOLIO}') AND (top_pct <= 15 OR bottom_pct >= 85) AS is_folio,
  LIKE_RE(trim(text), r'(?i)^\s*(?:page\s*)?\d{{1,3}}\s*(?:/|of)\s*\d{{1,3}}\s*$') AND (top_pct <= 8 OR bottom_pct >= 80) AS is_margin_number
FROM (SELECT *, y_top / $(page_height) * 100 AS top_pct, y_bottom / $(page_height) * 100 AS bottom_pct FROM {{page_lines}}) x""")

_HOST = " OR ".join(f"contains(lower(uri), '{h}')" for h in fx.BRANDING_HOSTS)
relation("b_tag_branding", "Lines and links that advertise rather than say.", rf"""
SELECT doc_id, page, seq AS id, 'line' AS kind, LIKE_RE(text, r'{fx.BRANDING_TEXT}') OR LIKE_RE(text, r'{fx.FURNITURE_TEXT}') AS is_branding FROM {{page_lines}}
UNION ALL
SELECT doc_id, page, link_id, 'link', {_HOST} FROM {{links}}""")

relation("b_option_letters", "Option letters (A to D with their punctuation) of each line.", "",
    spark=r"""SELECT doc_id, page, seq, array_sort(array_distinct(transform(regexp_extract_all(text, r'(?<![A-Za-z0-9])\(?\s*([A-Da-d])\s*[.)]', 1), x -> upper(x)))) AS letters FROM {page_lines}""",
    other=r"""SELECT doc_id, page, seq, list_sort(list_distinct(list_transform(regexp_extract_all(concat(' ', text), r'(?:^|[^A-Za-z0-9])\(?\s*([A-Da-d])\s*[.)]', 1), lambda x: upper(x)))) AS letters FROM {page_lines}""")

relation("b_normalize_keys", "Keys under which repeated lines agree, with and without digits.", f"""
SELECT doc_id, page, seq, k AS exact_key, regexp_replace(k, '[0-9]', ''/*G*/) AS loose_key
FROM (SELECT doc_id, page, seq, {EXACT_KEY} AS k FROM {{page_lines}}) x""")

relation("b_ocr_number_repair", "Leading tokens read as numbers of up to three digits, with OCR's letters for digits undone.", rf"""
SELECT doc_id, page, seq, token, CASE WHEN LIKE_RE(fixed, r'^\d{{1,3}}$') THEN CAST(fixed AS INT) END AS num
FROM (SELECT *, CASE WHEN length(bare) <= 3 THEN translate(bare, '{fx.OCR_LETTERS}', '{fx.OCR_DIGITS}') ELSE '' END AS fixed
  FROM (SELECT *, regexp_replace(regexp_replace(token, r'^[.)\-:]+', ''), r'[.)\-:]+$', '') AS bare
    FROM (SELECT doc_id, page, seq, regexp_extract(trim(text), r'^(\S+)', 1) AS token FROM {{page_lines}}) a) b) c""")

relation("b_script_class", "Devanagari, Latin or mixed, by the share of letters.", r"""
SELECT doc_id, page, seq, CASE WHEN dev + lat = 0 THEN 'none' WHEN dev > 0.5 * (dev + lat) THEN 'devanagari' WHEN lat > 0.5 * (dev + lat) THEN 'latin' ELSE 'mixed' END AS script
FROM (SELECT doc_id, page, seq, length(regexp_replace(text, r'[^\x{0900}-\x{097F}]', ''/*G*/)) AS dev, length(regexp_replace(text, '[^A-Za-z]', ''/*G*/)) AS lat FROM {page_lines}) x""")

relation("b_parse_page_ranges", "Pages that each text names, clipped to the document; a malformed text gives one row with its error.", r"""
SELECT spec_id, CAST(page AS INT) AS page, CAST(NULL AS STRING) AS error FROM (
  SELECT DISTINCT spec_id, EXPLODE(SEQ(lo, hi)) AS page FROM (
    SELECT spec_id, greatest(least(a, b), 1) AS lo, least(greatest(a, b), max_page) AS hi FROM (
      SELECT spec_id, max_page, TRY_CAST(regexp_extract(part, r'^(\d+)', 1) AS BIGINT) AS a, TRY_CAST(regexp_extract(part, r'(\d+)$', 1) AS BIGINT) AS b FROM {page_parts}
      WHERE ok AND part <> '') p) q WHERE lo <= hi) r
WHERE NOT EXISTS (SELECT 1 FROM {page_parts} bad WHERE bad.spec_id = r.spec_id AND NOT bad.ok)
UNION ALL
SELECT spec_id, CAST(NULL AS INT), concat('Invalid page range: ', min(part)) FROM {page_parts} WHERE NOT ok GROUP BY spec_id""")

relation("page_parts", "Comma-separated parts of page-range texts.", r"""
SELECT spec_id, max_page, trim(part) AS part, LIKE_RE(trim(part), r'^(\d+(\s*-\s*\d+)?)?$') AS ok
FROM (SELECT spec_id, max_page, EXPLODE(SPLIT(regexp_replace(spec, r'(?i)\bto\b', '-'/*G*/), ',')) AS part FROM {page_specs}) x""")

relation("b_regex_probe", "What a user's pattern matches on each line, and its groups.", r"""
SELECT doc_id, page, seq, LIKE_RE(text, $(probe)) AS matched, regexp_extract(text, $(probe), 1) AS q_num, regexp_extract(text, $(probe), 2) AS second_group
FROM {page_lines}""")

relation("b_item_search", "Items whose label, kind or place contains a text, without regard to case.", """
SELECT doc_id, item, label FROM (SELECT doc_id, item, concat(CASE WHEN is_solution THEN 'S' ELSE 'Q' END, q_num) AS label,
  CASE WHEN is_solution THEN 'Solution' ELSE 'Question' END AS kind, concat('page ', CAST(page AS STRING), ', ', CAST(n_segments AS STRING), ' part(s)') AS sub FROM {items}) x
WHERE contains(lower(label), lower($(term))) OR contains(lower(kind), lower($(term))) OR contains(lower(sub), lower($(term)))""")

relation("b_min_box", "Boxes at least 1.5 per cent wide and high.", """
SELECT doc_id, page, box_id, x0, x1, y0, y1 FROM {tiny_boxes} WHERE x1 - x0 >= 1.5 AND y1 - y0 >= 1.5""")

#: The side of the square that a detector reads, and the least score of a box.
SETTINGS |= {"detector_side": 640, "least_score": 0.03}


SHARED |= {"read_rows"}


def _rows(tail: str) -> str:
    """Detector rows with their lists of scores; `tail` is a list's values from the k-th on."""
    return f"""
SELECT doc_id, page, box_id, SIZE(vals) = 6 AS flat, NTH(vals, 5) AS fifth, NTH(vals, 6) AS sixth, {tail.format(k=5)} AS scores, {tail.format(k=6)} AS classes, NTH(vals, 1) * unit AS cx, NTH(vals, 2) * unit AS cy, NTH(vals, 3) * unit / 2 AS half_w, NTH(vals, 4) * unit / 2 AS half_h
FROM (SELECT *, CASE WHEN greatest(abs(NTH(vals, 1)), abs(NTH(vals, 2)), abs(NTH(vals, 3)), abs(NTH(vals, 4))) <= 1.5 THEN $(detector_side) ELSE 1 END AS unit FROM {{tensor_rows}} WHERE SIZE(vals) >= 6) x"""


relation("read_rows", "A detector's rows of six values or more: box in the square's pixels, and the values behind it.", "", spark=_rows("slice(vals, {k}, greatest(SIZE(vals) - {k} + 1, 0))"), other=_rows("vals[{k}:]"))

relation("b_decode_detections", "Boxes in page pixels from a detector's rows of any of three layouts: [xywh, score, class], [xywh, classes] or [xywh, objectness, classes], the last two told apart by the higher score; shares of one scaled up, the letterbox's padding and scale undone, clipped to the page, cut by score and class.", f"""
WITH scored AS (SELECT *, MOST(scores) AS best, CASE WHEN NOT flat AND fifth BETWEEN 0 AND 1 THEN fifth * MOST(classes) END AS product FROM {{read_rows}}),
classed AS (
  SELECT doc_id, page, box_id, cx, cy, half_w, half_h, CASE WHEN flat THEN fifth WHEN product > best THEN product ELSE best END AS score,
    CASE WHEN flat THEN CAST(BROUND(sixth, 0) AS INT) WHEN product > best THEN CAST(array_position(classes, MOST(classes)) AS INT) - 1 ELSE CAST(array_position(scores, best) AS INT) - 1 END AS class_id FROM scored
)
SELECT doc_id, page, box_id, label, score, x0, x1, y0, y1 FROM (
  SELECT c.doc_id, c.page, c.box_id, lower(trim(n.label)) AS label, c.score,
    greatest(0, least(l.width, (c.cx - c.half_w - l.pad_x) / l.unit)) AS x0, greatest(0, least(l.width, (c.cx + c.half_w - l.pad_x) / l.unit)) AS x1,
    greatest(0, least(l.height, (c.cy - c.half_h - l.pad_y) / l.unit)) AS y0, greatest(0, least(l.height, (c.cy + c.half_h - l.pad_y) / l.unit)) AS y1
  FROM classed c JOIN {{class_names}} n ON c.class_id = n.class_id JOIN (SELECT *, CASE WHEN scale > 0 THEN scale ELSE 1.0 END AS unit FROM {{letterboxes}}) l ON c.doc_id = l.doc_id AND c.page = l.page
  WHERE c.score >= $(least_score)) x
WHERE label IN ({fx.quoted(fx.QUESTION_CLASSES + fx.SOLUTION_CLASSES)}) AND x1 > x0 AND y1 > y0""")

_NAMED = " ".join(f"WHEN (abs(w - {a}) <= 2 AND abs(h - {b}) <= 2) OR (abs(w - {b}) <= 2 AND abs(h - {a}) <= 2) THEN '{n}'" for n, a, b in fx.FORMATS)
relation("b_page_size_label", "Millimetres, pixels at 200 dpi, format and orientation of each page.", f"""
SELECT doc_id, page, CAST(w AS INT) AS width_mm, CAST(h AS INT) AS height_mm, CAST(BROUND(width / 72 * 200, 0) AS INT) AS width_px, CAST(BROUND(height / 72 * 200, 0) AS INT) AS height_px,
  CASE {_NAMED} ELSE 'Custom' END AS format, CASE WHEN width > height THEN 'landscape' WHEN width < height THEN 'portrait' ELSE 'square' END AS orientation
FROM (SELECT *, BROUND(width / 72 * 25.4, 0) AS w, BROUND(height / 72 * 25.4, 0) AS h FROM {{page_geom}}) x""")

relation("b_image_dpi", "Resolution of each placed image: the lower of its axes.", """
SELECT doc_id, page, image_id, BROUND(least(w_px / (w_pt / 72), h_px / (h_pt / 72)), 1) AS dpi FROM {page_images} WHERE w_pt > 0 AND h_pt > 0""")

relation("b_output_name", "File name of each item's picture.", """
SELECT doc_id, item, concat(CASE WHEN is_solution THEN $(solution_prefix) ELSE $(question_prefix) END, lpad(CAST(greatest(0, CAST(q_num AS INT) + $(first_number) - 1) AS STRING), $(number_digits), '0'), '.png') AS name FROM {items}""")

#: Tokens of a name pattern, in the order they are filled in, with what stands for them.
_TOKENS = {
    "fullname": "original", "name": "stem", "ext": "ext", "width": "coalesce(CAST(width AS STRING), '')", "height": "coalesce(CAST(height AS STRING), '')", "date": "$(name_date)", "moddate": "$(name_date)", "size": "human",
    "sizekb": "CAST(greatest(1, CAST(floor(bytes / 1024.0 + 0.5) AS BIGINT)) AS STRING)", "sizeb": "CAST(bytes AS STRING)",
}
_FILLED = "replace(regexp_replace(pattern, r'(?i)\\(n\\)', '#'/*G*/), '#', number)"
for _name, _value in _TOKENS.items():
    _FILLED = f"replace(regexp_replace({_FILLED}, r'(?i)\\({_name}\\)', '\x01'/*G*/), '\x01', {_value})"
relation("b_expand_name_tokens", "New stems from a pattern: # and (n) are the padded number, which is put at the end where the pattern has no token at all; the file's name, extension, sizes and the date filled in, in any case; unsafe characters replaced.", rf"""
SELECT idx, CASE WHEN trim(made) = '' THEN number ELSE trim(made) END AS stem, ext FROM (
  SELECT idx, number, ext, regexp_replace(concat({_FILLED}, CASE WHEN LIKE_RE(pattern, r'(?i)#|\([a-z]+\)') THEN '' ELSE number END), r'[\\/:*?"<>|]+', '_'/*G*/) AS made FROM (
    SELECT idx, width, height, bytes, original, CASE WHEN LIKE_RE(original, r'[^.].*\.') THEN regexp_replace(original, r'\.[^.]*$', '') ELSE original END AS stem,
      CASE WHEN LIKE_RE(original, r'[^.].*\.') THEN lower(regexp_extract(original, r'\.([^.]*)$', 1)) ELSE '' END AS ext,
      CASE WHEN bytes < 1024 THEN concat(CAST(bytes AS STRING), 'B') WHEN bytes < 1048576 THEN concat(CAST(CAST(floor(bytes / 102.4 + 0.5) / 10 AS DECIMAL(18, 1)) AS STRING), 'KB') ELSE concat(CAST(CAST(floor(bytes / 104857.6 + 0.5) / 10 AS DECIMAL(18, 1)) AS STRING), 'MB') END AS human,
      CASE WHEN trim($(name_pattern)) = '' THEN '#' ELSE trim($(name_pattern)) END AS pattern,
      CASE WHEN length(n) < $(name_digits) THEN lpad(n, $(name_digits), '0') ELSE n END AS number
    FROM (SELECT *, CAST(row_number() OVER (PARTITION BY batch ORDER BY idx) - 1 + $(name_start) AS STRING) AS n FROM {{files}}) f) g) h""")

# Gates of figures as shares of the page: pictures by area, drawings and tables by size, and margins.
SETTINGS |= {
    "image_area": 0.0008, "drawing_width": 0.04, "drawing_height": 0.03, "border_width": 0.96, "border_height": 0.92, "figure_top": 0.07, "figure_bottom": 0.93,
    "table_width": 0.06, "table_height": 0.02, "sheet_width": 0.98, "sheet_height": 0.97, "table_top": 0.05, "table_bottom": 0.95, "table_rows": 2, "table_columns": 2,
}
_W, _H = "(x1 - x0) / $(page_width)", "(y1 - y0) / $(page_height)"
relation("b_gate_figures", "Pictures that are not too small, drawings and tables that are neither too small nor a border of the whole page, none of them within a margin; tables have two rows and columns.", f"""
SELECT doc_id, page, fig_id, x0, x1, y0, y1 FROM {{figures}}
WHERE CASE kind
  WHEN 'image' THEN {_W} * {_H} >= $(image_area) AND y1 / $(page_height) > $(figure_top) AND y0 / $(page_height) < $(figure_bottom)
  WHEN 'table' THEN n_rows >= $(table_rows) AND n_columns >= $(table_columns) AND {_W} >= $(table_width) AND {_H} >= $(table_height) AND NOT ({_W} >= $(sheet_width) AND {_H} >= $(sheet_height)) AND y1 / $(page_height) > $(table_top) AND y0 / $(page_height) < $(table_bottom)
  ELSE {_W} >= $(drawing_width) AND {_H} >= $(drawing_height) AND NOT ({_W} >= $(border_width) AND {_H} >= $(border_height)) AND y1 / $(page_height) > $(figure_top) AND y0 / $(page_height) < $(figure_bottom) END""")

built("j_custom_marker", "Markers by a user's pattern (here an option letter), by the default rules where it does not match.", ["page_lines"],
    lambda lines: markers.tag_markers(lines.select("doc_id", "page", "seq", "text"), pattern=r"\(([AB])\)").drop("text"),
    other=r"""SELECT doc_id, page, seq, regexp_extract(trim(text), r'^\(([AB])\)', 1) AS q_num, true AS is_strong FROM {page_lines} WHERE LIKE_RE(trim(text), r'(?i)^\(([AB])\)')
UNION ALL SELECT m.doc_id, m.page, m.seq, m.q_num, m.is_strong FROM {b_tag_markers} m JOIN {page_lines} l ON l.doc_id = m.doc_id AND l.page = m.page AND l.seq = m.seq WHERE NOT LIKE_RE(trim(l.text), r'(?i)^\(([AB])\)')""")  # fmt: skip
