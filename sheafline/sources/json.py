"""Rows from the JSON that text extractors, OCR engines and page models return."""

from ..functions import fixed as fx
from ..relations import SETTINGS, relation

relation("page_json", "A text extractor's tree for each page: blocks, lines, spans; some blocks are pictures or blank.", """
SELECT doc_id, page, to_json(named_struct('blocks', concat(collect_list(named_struct('type', 0, 'lines', array(named_struct('bbox', array(x_left, y_top, x_right, y_bottom), 'spans',
  array(named_struct('text', substring(text, 1, 5)), named_struct('text', substring(text, 6))))))), array(named_struct('type', 1, 'lines', array(named_struct('bbox', array(0.0D, 0.0D, 9.0D, 9.0D), 'spans', array(named_struct('text', 'picture'))))),
  named_struct('type', 0, 'lines', array(named_struct('bbox', array(0.0D, 0.0D, 9.0D, 9.0D), 'spans', array(named_struct('text', '  '))))))))) AS raw FROM {lines} GROUP BY doc_id, page""", exact=False)  # fmt: skip

relation("a_lines_from_blocks", "Lines of text blocks: spans joined and trimmed, blanks dropped, ordered by height and left edge.", "",
    spark="""
SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY y_top, x_left, text) AS BIGINT) AS seq, y_top, y_bottom, x_left, x_right, text FROM (
  SELECT doc_id, page, l.bbox[1] AS y_top, l.bbox[3] AS y_bottom, l.bbox[0] AS x_left, l.bbox[2] AS x_right, trim(array_join(transform(l.spans, s -> s.text), '')) AS text FROM (
    SELECT doc_id, page, explode(b.lines) AS l FROM (SELECT doc_id, page, explode(from_json(raw, 'blocks array<struct<type:int,lines:array<struct<bbox:array<double>,spans:array<struct<text:string>>>>>>').blocks) AS b FROM {page_json}) x WHERE b.type = 0) y) z
WHERE text <> ''""",
    other="""SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY y_top, x_left, trim(text)) AS seq, y_top, y_bottom, x_left, x_right, trim(text) AS text FROM {lines} WHERE trim(text) <> ''""")

#: Lines are moved to their page whole and cut into words there, so no word is a row of its own before the arrays are read.
relation("ocr_json", "An OCR engine's parallel arrays for each page.", """
SELECT doc_id, page, to_json(named_struct('text', transform(a, x -> x.word), 'conf', transform(a, x -> x.conf), 'left', transform(a, x -> CASE WHEN x.pos = 11 THEN 'n/a' ELSE CAST(CAST(x.x0 AS INT) AS STRING) END), 'top', transform(a, x -> CAST(CAST(x.y0 AS INT) AS STRING)), 'line', transform(a, x -> x.seq), 'word_num', transform(a, x -> x.pos))) AS raw
FROM (SELECT doc_id, page, flatten(transform(array_sort(collect_list(struct(seq, text, x_left, y_top))), l -> transform(split(l.text, ' '), (word, pos) -> named_struct('seq', l.seq, 'pos', CAST(pos AS BIGINT), 'word', word,
  'conf', CAST((l.seq * 7 + pos) % 103 - 2 AS DOUBLE), 'x0', l.x_left + 6 * pos % 240, 'y0', l.y_top)))) AS a FROM {lines} WHERE text IS NOT NULL GROUP BY doc_id, page) x""", exact=False)  # fmt: skip

relation("a_words_from_ocr", "Words of OCR arrays; blank ones, negative confidences and places that are no whole numbers are dropped.", "",
    spark="""
SELECT doc_id, page, w.line AS seq, w.word_num AS pos, w.text AS word, w.conf, try_cast(w.left AS INT) AS x0, try_cast(w.top AS INT) AS y0 FROM (
  SELECT doc_id, page, explode(arrays_zip(j.text, j.conf, j.left, j.top, j.line, j.word_num)) AS w FROM (SELECT doc_id, page, from_json(raw, 'text array<string>, conf array<double>, left array<string>, top array<string>, line array<bigint>, word_num array<bigint>') AS j FROM {ocr_json}) x) y
WHERE trim(w.text) <> '' AND w.conf >= 0 AND try_cast(w.left AS INT) IS NOT NULL AND try_cast(w.top AS INT) IS NOT NULL""",
    other="""SELECT doc_id, page, seq, pos, word, conf, CAST(x0 AS INT) AS x0, CAST(y0 AS INT) AS y0 FROM {words} WHERE trim(word) <> '' AND conf >= 0 AND pos <> 11""")

relation("poly_json", "Another engine's lines as polygons, in either of two shapes.", """
SELECT doc_id, page, CASE WHEN page % 2 = 0 THEN to_json(named_struct('rec_texts', collect_list(text), 'rec_polys', collect_list(array(array(x_left, y_top), array(x_right, y_top + 1), array(x_right, y_bottom), array(x_left, y_bottom - 1)))))
  ELSE to_json(named_struct('items', collect_list(named_struct('poly', array(array(x_left, y_top), array(x_right, y_top + 1), array(x_right, y_bottom), array(x_left, y_bottom - 1)), 'text', text)))) END AS raw FROM {lines} GROUP BY doc_id, page""", exact=False)  # fmt: skip

relation("a_lines_from_polygons", "Lines from polygons of either shape; a line's box is the extent of its four points.", "",
    spark="""
SELECT doc_id, page, i.text, array_min(transform(i.poly, p -> p[0])) AS x_left, array_max(transform(i.poly, p -> p[0])) AS x_right, array_min(transform(i.poly, p -> p[1])) AS y_top, array_max(transform(i.poly, p -> p[1])) AS y_bottom FROM (
  SELECT doc_id, page, explode(coalesce(from_json(raw, 'items array<struct<poly:array<array<double>>,text:string>>').items,
    transform(arrays_zip(from_json(raw, 'rec_texts array<string>, rec_polys array<array<array<double>>>').rec_polys, from_json(raw, 'rec_texts array<string>, rec_polys array<array<array<double>>>').rec_texts), z -> named_struct('poly', z.rec_polys, 'text', z.rec_texts)))) AS i FROM {poly_json}) x""",
    other="SELECT doc_id, page, text, x_left, x_right, y_top, y_bottom FROM {lines}")

_ITEM = "struct<q_num:string,is_solution:string,segments:array<struct<page:string,y_start_pct:string,y_end_pct:string>>>"
relation("a_items_from_model_json", "Segments of raw model answers: code fences off, from the first bracket to the last; questions wrapped, bare or single; items without a number, pages outside those asked for, and extents outside the page or upside down dropped; in order of page and height.", "",
    spark=rf"""
WITH cut AS (
  SELECT *, CASE WHEN regexp_like(raw, r'^[^{{]*\[') THEN regexp_extract(raw, r'(?s)(\[.*\])', 1) ELSE regexp_extract(raw, r'(?s)(\{{.*\}})', 1) END AS body FROM {{model_json}}
), parsed AS (
  SELECT *, coalesce(CASE WHEN body LIKE '[%' THEN from_json(body, 'array<{_ITEM}>') END, from_json(body, 'questions array<{_ITEM}>').questions, array(from_json(body, '{_ITEM}'))) AS items FROM cut
), parts AS (
  SELECT doc_id, answer_id, first_page, last_page, pos, trim(i.q_num) AS q_num, coalesce(lower(i.is_solution) NOT IN ('false', '0', ''), false) AS is_solution, s
  FROM (SELECT doc_id, answer_id, first_page, last_page, posexplode(items) AS (pos, i) FROM parsed) x LATERAL VIEW explode(i.segments) t AS s WHERE trim(i.q_num) <> ''
), typed AS (SELECT *, CAST(try_cast(s.page AS DOUBLE) AS INT) AS page, try_cast(s.y_start_pct AS DOUBLE) AS y0, try_cast(s.y_end_pct AS DOUBLE) AS y1 FROM parts)
SELECT doc_id, answer_id, CAST(pos AS BIGINT) AS pos, q_num, is_solution, CAST(row_number() OVER (PARTITION BY doc_id, answer_id, pos ORDER BY page, y0, y1) AS BIGINT) AS seg, page, y0, y1 FROM typed
WHERE page BETWEEN first_page AND last_page AND y0 BETWEEN 0 AND 100 AND y1 BETWEEN 0 AND 100 AND y1 > y0""",
    other="""
WITH typed AS (
  SELECT doc_id, box_id AS answer_id, CAST(box_id%50 AS STRING) AS q_num, label = 'solution' AS is_solution, CAST(page + box_id%6 AS INT) AS page, page AS first_page, y0, y1 - (box_id%11=0)::INT*40 AS y1 FROM {boxes} WHERE box_id%23 <> 0
  UNION ALL SELECT doc_id, box_id, CAST(box_id%50 AS STRING), label = 'solution', page, page, 2, 3.5 FROM {boxes} WHERE box_id%23 <> 0)
SELECT doc_id, answer_id, CAST(0 AS BIGINT) AS pos, q_num, is_solution, row_number() OVER (PARTITION BY doc_id, answer_id ORDER BY page, y0, y1) AS seg, page, y0, y1 FROM typed WHERE page <= first_page + 3 AND y1 > y0 AND y1 BETWEEN 0 AND 100""")  # fmt: skip

SETTINGS |= {"model_score": 0.05, "least_high": 3.0, "least_wide": 5.0}
relation("box_json", "Raw detector answers of four shapes: corners in pixels or shares of one, edges in pixels, edges in per cent (whole width where none is named), or a list of four.", """
SELECT doc_id, page, box_id, CASE box_id % 4 WHEN 0 THEN concat('[{', name, '"box":{"xmin":', CAST(x0 / k AS STRING), ',"ymin":', CAST(y0 / h AS STRING), ',"xmax":', CAST(x1 / k AS STRING), ',"ymax":', CAST(y1 / h AS STRING), '}}]')
  WHEN 1 THEN concat('{"boxes":[{', name, '"page":', CAST(page AS STRING), ',"x1":"', CAST(x0 * 4 AS STRING), '","y1":', CAST(y0 * 8 AS STRING), ',"x2":', CAST(x1 * 4 AS STRING), ',"y2":', CAST(y1 * 8 AS STRING), '},{"label":"question","x1":"?","y1":1,"x2":90,"y2":90},{"score":null}]}')
  WHEN 2 THEN concat('{"boxes":[{', name, '"x_start_pct":', CAST(x0 AS STRING), ',"y_start_pct":', CAST(y0 AS STRING), ',"x_end_pct":', CAST(x1 AS STRING), ',"y_end_pct":', CAST(y1 AS STRING), '}]}')
  ELSE concat('{"boxes":[{', name, '"box":[', CAST(x0 AS STRING), ',', CAST(y0 AS STRING), ',', CAST(x1 AS STRING), ',', CAST(y1 AS STRING), ']}]}') END AS raw
FROM (SELECT *, concat('"', CASE WHEN box_id%5=0 THEN 'class' ELSE 'label' END, '":"', CASE WHEN box_id%9=0 THEN 'logo' ELSE label END, '","score":', CAST(score AS STRING), ',') AS name,
  CASE WHEN box_id%8=0 THEN 100 ELSE 0.25 END AS k, CASE WHEN box_id%8=0 THEN 100 ELSE 0.125 END AS h FROM {boxes}) x""", exact=False)  # fmt: skip
_BOX = "struct<page:string,label:string,class:string,score:string,box:string,x1:string,y1:string,x2:string,y2:string,x_start_pct:string,y_start_pct:string,x_end_pct:string,y_end_pct:string>"



def _number(text: str) -> str:
    """text as a number; what has neither a digit nor an n (nan, inf) is none, and is not left to fail as a cast."""
    return f"CASE WHEN {text} RLIKE '[0-9nN]' THEN try_cast({text} AS DOUBLE) END"


def _read(corner: str, place: int, edge: str, named: str, missing: int) -> str:
    """One edge as the answer k has it, whichever shape names it; null where it is no number."""
    return f"""CASE k.unit WHEN 0 THEN {_number(f"k.c.{corner}")} * 100 WHEN 1 THEN {_number(f"k.c.{corner}")} WHEN 2 THEN {_number(f"k.b.{edge}")} WHEN 3 THEN get(k.l, {place}) * CASE WHEN array_max(k.l) <= 1.5 THEN 100 ELSE 1 END
    ELSE CASE WHEN k.b.{named} IS NULL THEN CAST({missing} AS DOUBLE) ELSE {_number(f"k.b.{named}")} END END"""


def _edge(place: int, side: str) -> str:
    """One edge in per cent; units 1 and 2 are pixels of the page."""
    return f"round(greatest(0, least(100, CASE unit WHEN 1 THEN e[{place}] * (100 / p.{side}) WHEN 2 THEN e[{place}] * 100 / p.{side} ELSE e[{place}] END)), 6)"


#: An answer is read step by step in arrays of one, which no condition is pushed below: else every edge parses it again.
relation("a_boxes_from_model_json", "Boxes of raw detector answers in per cent of the page, clipped to it: corners or edges in the page's pixels, in per cent, or in shares of one; by class and score (1 where none is given), at least 3 per cent high and 5 wide. Broken ones go.", "",
    spark=f"""
WITH answers AS (
  SELECT doc_id, page AS own_page, box_id, bs FROM {{box_json}} LATERAL VIEW explode(array(coalesce(CASE WHEN trim(raw) LIKE '[%' THEN from_json(raw, 'array<{_BOX}>') END, from_json(raw, 'boxes array<{_BOX}>').boxes))) t AS bs
), read AS (
  SELECT doc_id, own_page, box_id, rs FROM answers LATERAL VIEW explode(array(transform(transform(transform(transform(filter(bs, b -> lower(trim(coalesce(b.label, b.class, 'question'))) IN ({fx.quoted(fx.QUESTION_CLASSES + fx.SOLUTION_CLASSES)})),
    b -> named_struct('b', b, 'c', CASE WHEN b.box LIKE '{{{{%' THEN from_json(b.box, 'xmin string, ymin string, xmax string, ymax string') END, 'l', CASE WHEN b.box LIKE '[%' THEN from_json(b.box, 'array<double>') END)),
    k -> named_struct('b', k.b, 'c', k.c, 'l', k.l, 'unit', CASE WHEN k.c IS NOT NULL THEN CASE WHEN greatest({", ".join(_number(f"k.c.{x}") for x in ("xmin", "ymin", "xmax", "ymax"))}) <= 1.001 THEN 0 ELSE 1 END
      WHEN k.l IS NOT NULL THEN 3 WHEN k.b.x1 IS NOT NULL AND k.b.y1 IS NOT NULL AND k.b.x2 IS NOT NULL AND k.b.y2 IS NOT NULL THEN 2 ELSE 4 END)),
    k -> named_struct('page', CAST({_number("k.b.page")} AS INT), 'label', lower(trim(coalesce(k.b.label, k.b.class, 'question'))), 'score', CASE WHEN k.b.score IS NULL THEN CAST(1 AS DOUBLE) ELSE {_number("k.b.score")} END, 'unit', k.unit,
      'e', array({_read("xmin", 0, "x1", "x_start_pct", 0)}, {_read("ymin", 1, "y1", "y_start_pct", 0)}, {_read("xmax", 2, "x2", "x_end_pct", 100)}, {_read("ymax", 3, "y2", "y_end_pct", 100)}))),
    r -> CASE WHEN r.score >= $(model_score) AND NOT exists(r.e, v -> v IS NULL) THEN r END))) t AS rs
), placed AS (
  SELECT t.doc_id, t.page, t.box_id, label, score, {_edge(0, "width")} AS x0, {_edge(1, "height")} AS y0, {_edge(2, "width")} AS x1, {_edge(3, "height")} AS y1
  FROM (SELECT doc_id, box_id, coalesce(r.page, own_page) AS page, r.label, r.score, r.unit, r.e FROM read LATERAL VIEW explode(rs) t AS r WHERE r IS NOT NULL) t JOIN {{letterboxes}} p ON t.doc_id = p.doc_id AND t.page = p.page
)
SELECT doc_id, page, box_id, label, score, x0, y0, x1, y1 FROM placed WHERE y1 - y0 >= $(least_high) AND x1 - x0 >= $(least_wide)""".replace("{{%", "{%"),
    other="SELECT doc_id, page, box_id, label, score, x0, y0, x1, y1 FROM {boxes} WHERE box_id%9 <> 0 AND score >= 0.05 AND y1 - y0 >= 3 UNION ALL SELECT doc_id, page, box_id, 'question', 1, 0, 0, 100, 100 FROM {boxes} WHERE box_id%4 = 1")

relation("key_json", "Answer keys as a model gives them.", """
SELECT doc_id, to_json(map_from_entries(collect_list(struct(concat(CASE WHEN num % 2 = 0 THEN 'Q' ELSE '' END, CAST(num AS STRING)), concat(CASE WHEN num % 5 = 0 THEN 'option ' ELSE '(' END, letter, ')'))))) AS raw FROM {key_pairs} GROUP BY doc_id""", exact=False)  # fmt: skip
relation("a_answer_map_from_json", "Answer pairs of a JSON map: first digits of the key (1 to 999), first letter A to E of the value, the first of a number.", "",
    spark=r"""
SELECT doc_id, num, letter FROM (SELECT doc_id, try_cast(regexp_extract(k, r'(\d+)', 1) AS INT) AS num, regexp_extract(upper(regexp_replace(v, '(?i)option', '')), r'([A-E])', 1) AS letter
  FROM {key_json} LATERAL VIEW explode(from_json(raw, 'map<string,string>')) t AS k, v) x WHERE num BETWEEN 1 AND 999 AND letter <> ''""",
    other="SELECT doc_id, num, letter FROM {key_pairs} WHERE num <= 999")

SETTINGS |= {"most_bytes": 2048 * 1024 * 1024, "most_pages": 2000}
relation("file_heads", "First bytes, size and pages of uploads; a file that can't be opened has no number of pages.", """
SELECT idx, CASE WHEN idx % 7 = 0 THEN 'GIF8' ELSE '%PDF' END AS head, bytes * 50000 AS bytes, CASE WHEN idx % 11 > 0 THEN width * 5 END AS pages FROM {files}""")
relation("a_validate_files", "Uploads accepted, or rejected with the first reason: size, kind or a broken file, number of pages.", """
SELECT idx, CASE WHEN bytes > $(most_bytes) THEN 'too large' WHEN coalesce(head, '') <> '%PDF' OR pages IS NULL THEN 'not a PDF' WHEN pages > $(most_pages) THEN 'too many pages' END AS reason FROM {file_heads}""")
