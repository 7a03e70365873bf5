"""Layout tables derived from the driver's tables, so that every operator's work grows with them.

Twenty documents make one paper; its non-empty lines are set 40 to a page in two columns on a page of 640 by 800.
"""

from ..relations import SHARED, relation

SHARED |= {"key_pairs", "more_lines"}

relation("raw_lines", "Lines of each document.", "",
    spark=r"SELECT doc_id, li, raw FROM {documents} LATERAL VIEW posexplode(split(text, '\n')) t AS li, raw",
    other="SELECT doc_id, unnest(range(len(a))) AS li, unnest(a) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM {documents}) d")

#: Spark numbers and moves whole documents, and takes them apart behind that.
relation("body", "Non-empty lines of a paper, numbered.", """
SELECT paper_id, row_number() OVER (PARTITION BY paper_id ORDER BY doc_id, li) - 1 AS n, raw
FROM (SELECT CAST(floor(doc_id/20.0) AS BIGINT) AS paper_id, doc_id, li, raw FROM {raw_lines} WHERE trim(raw) <> '') r""",
    spark=r"""
SELECT paper_id, n_before + pos AS n, raw FROM (
  SELECT paper_id, kept, sum(size(kept)) OVER (PARTITION BY paper_id ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size(kept) AS n_before
  FROM (SELECT CAST(floor(doc_id/20.0) AS BIGINT) AS paper_id, doc_id, filter(split(text, '\n'), x -> trim(x) <> '') AS kept FROM {documents} WHERE text IS NOT NULL) d) r LATERAL VIEW posexplode(kept) t AS pos, raw""")  # fmt: skip

relation("lines", "Positioned lines; every fifth opens an item, two of them with a misread number.", """
SELECT paper_id AS doc_id, CAST(floor(n/40.0) AS INT)+1 AS page, CAST(n AS BIGINT) AS seq,
  CAST(64 + (n%20)*32 AS DOUBLE) AS y_top, CAST(76 + (n%20)*32 AS DOUBLE) AS y_bottom,
  CAST(CASE WHEN n%40>=20 THEN 352 ELSE 32 END AS DOUBLE) AS x_left,
  CAST(CASE WHEN n%40>=20 THEN 608 ELSE 288 END AS DOUBLE) AS x_right,
  CASE WHEN n%5=0 AND (CAST(floor(n/5.0) AS INT)+1)%20=0 THEN concat(replace(CAST(CAST(floor(n/5.0) AS INT)+1 AS STRING),'0','O'),'. ',raw)
       WHEN n%5=0 THEN concat(CAST(CAST(floor(n/5.0) AS INT)+1 AS STRING),'. ',raw)
       WHEN n%5=3 THEN concat('(A) ',raw) WHEN n%5=4 THEN concat('(B) ',raw) ELSE raw END AS text
FROM {body}""")

relation("paper_pages", "Pages of each paper with its last page.", """
SELECT doc_id, page, max(page) OVER (PARTITION BY doc_id) AS last_page FROM (SELECT DISTINCT doc_id, page FROM {lines}) p""")

relation("margin_lines", "A running title and a folio on each page.", """
SELECT doc_id, page, CAST(2000000000 + 2*page AS BIGINT) AS seq, CAST(20 AS DOUBLE) AS y_top, CAST(32 AS DOUBLE) AS y_bottom,
  CAST(32 AS DOUBLE) AS x_left, CAST(608 AS DOUBLE) AS x_right, concat('Model Paper Series ', CAST(doc_id AS STRING)) AS text FROM {paper_pages}
UNION ALL
SELECT doc_id, page, CAST(2000000001 + 2*page AS BIGINT), CAST(772 AS DOUBLE), CAST(784 AS DOUBLE), CAST(304 AS DOUBLE), CAST(336 AS DOUBLE),
  concat(CAST(page AS STRING),'/',CAST(last_page AS STRING)) FROM {paper_pages}""")

relation("section_lines", "A solutions header half-way, key headers and section dividers now and then.", """
SELECT doc_id, page, CAST(1000000000 + page AS BIGINT) AS seq, CAST(44 AS DOUBLE) AS y_top, CAST(56 AS DOUBLE) AS y_bottom,
  CAST(32 AS DOUBLE) AS x_left, CAST(288 AS DOUBLE) AS x_right,
  CASE WHEN page = CAST(floor(last_page/2.0) AS INT) + 1 THEN 'Hints & Solutions' WHEN page%11=7 THEN 'Answer Key:' ELSE 'SECTION-II (Maximum Marks: 12)' END AS text
FROM {paper_pages} WHERE page = CAST(floor(last_page/2.0) AS INT) + 1 OR page%11=7 OR page%9=4""")

relation("twin_lines", "Some markers' lines again, a pixel lower, as a second text layer has them.", """
SELECT doc_id, page, CAST(4000000000 + seq AS BIGINT) AS seq, y_top + 1 AS y_top, y_bottom + 1 AS y_bottom, x_left, x_right, text FROM {lines} WHERE seq % 15 = 0""")

relation("numbered_options", "Four numbered options, indented, under some markers.", """
SELECT doc_id, page, CAST(5000000000 + seq * 10 + o AS BIGINT) AS seq, y_top + 12 + o * 4 AS y_top, y_top + 15 + o * 4 AS y_bottom, x_left + 20 AS x_left, x_right, concat(CAST(o AS STRING), '. choice ', CAST(o AS STRING)) AS text
FROM (SELECT *, EXPLODE(SEQ(1, 4)) AS o FROM {lines} WHERE seq % 35 = 5) x""")

relation("key_cells", "Some answer-key rows of ten cells each, between the lines of the first pages.", """
SELECT doc_id, CAST(num % 3 AS INT) + 1 AS page, CAST(3000000000 + num AS BIGINT) AS seq, CAST(82 + floor(num / 10.0) * 32 AS DOUBLE) AS y_top, CAST(90 + floor(num / 10.0) * 32 AS DOUBLE) AS y_bottom, CAST(num % 10 * 60 AS DOUBLE) AS x_left,
  CAST(num % 10 * 60 + 40 AS DOUBLE) AS x_right, concat(CAST(num AS STRING), '. (', letter, ')') AS text FROM {key_pairs} WHERE num < 60""")

relation("key_rows", "The answer key as text, ten pairs to a line, on pages after the last.", "",
    spark="""
SELECT k.doc_id, p.last_page + 1 + CAST(floor(k.i / 20.0) AS INT) AS page, CAST(6000000000 + k.i AS BIGINT) AS seq, CAST(64 + k.i % 20 * 32 AS DOUBLE) AS y_top, CAST(76 + k.i % 20 * 32 AS DOUBLE) AS y_bottom, CAST(32 AS DOUBLE) AS x_left, CAST(608 AS DOUBLE) AS x_right, k.text
FROM (SELECT doc_id, CAST(floor(num / 10.0) AS BIGINT) AS i, array_join(transform(array_sort(collect_list(struct(num, letter))), x -> concat(x.num, '-', x.letter)), '  ') AS text FROM {key_pairs} WHERE num <= 999 GROUP BY doc_id, floor(num / 10.0)) k
JOIN (SELECT DISTINCT doc_id, last_page FROM {paper_pages}) p ON k.doc_id = p.doc_id""",
    other="""
SELECT k.doc_id, CAST(p.last_page + 1 + floor(k.i / 20.0) AS INT) AS page, CAST(6000000000 + k.i AS BIGINT) AS seq, CAST(64 + k.i % 20 * 32 AS DOUBLE) AS y_top, CAST(76 + k.i % 20 * 32 AS DOUBLE) AS y_bottom, CAST(32 AS DOUBLE) AS x_left, CAST(608 AS DOUBLE) AS x_right, k.text
FROM (SELECT doc_id, CAST(floor(num / 10.0) AS BIGINT) AS i, string_agg(num || '-' || letter, '  ' ORDER BY num) AS text FROM {key_pairs} WHERE num <= 999 GROUP BY doc_id, floor(num / 10.0)) k
JOIN (SELECT DISTINCT doc_id, last_page FROM {paper_pages}) p ON k.doc_id = p.doc_id""")  # fmt: skip

relation("banner_lines", "A title of its own above the right column of some pages.", """
SELECT doc_id, page, CAST(7000000000 + page AS BIGINT) AS seq, CAST(36 AS DOUBLE) AS y_top, CAST(42 AS DOUBLE) AS y_bottom, CAST(352 AS DOUBLE) AS x_left, CAST(608 AS DOUBLE) AS x_right,
  concat('Chapter on ', translate(md5(concat(CAST(doc_id AS STRING), ':', CAST(page AS STRING))), '0123456789', 'ghijklmnop')) AS text FROM {paper_pages} WHERE page % 4 = 2""")

relation("more_lines", "The lines of a paper that are not its text's.", """
SELECT * FROM {section_lines} UNION ALL SELECT * FROM {margin_lines}
UNION ALL SELECT * FROM {twin_lines} UNION ALL SELECT * FROM {numbered_options} UNION ALL SELECT * FROM {key_cells} UNION ALL SELECT * FROM {key_rows} UNION ALL SELECT * FROM {banner_lines}""")

relation("page_lines", "All lines of a paper.", """
SELECT * FROM {lines} UNION ALL SELECT * FROM {section_lines} UNION ALL SELECT * FROM {margin_lines}
UNION ALL SELECT * FROM {twin_lines} UNION ALL SELECT * FROM {numbered_options} UNION ALL SELECT * FROM {key_cells} UNION ALL SELECT * FROM {key_rows} UNION ALL SELECT * FROM {banner_lines}""", spark="SELECT * FROM {lines} UNION ALL SELECT * FROM {more_lines}")

relation("key_pairs", "An answer key of the questions, with holes.", """
SELECT DISTINCT l.doc_id, CAST(floor(l.seq/5.0) AS INT)+1 AS num, substring('ABCD', CAST((floor(l.seq/5.0)*7)%4 AS INT)+1, 1) AS letter
FROM {lines} l JOIN {paper_pages} p ON l.doc_id = p.doc_id AND l.page = p.page WHERE (CAST(floor(l.seq/5.0) AS INT)+1)%9 <> 0 AND p.page <= floor(p.last_page/2.0)""")

_WORD = "doc_id, page, seq, CAST(pos AS BIGINT) AS pos, word, CAST((seq * 7 + pos) % 103 - 2 AS DOUBLE) AS conf, x_left + 6 * pos % 240 AS x0, x_left + 6 * pos % 240 + 5 AS x1, y_top AS y0, y_bottom AS y1, 1 AS block, CAST(floor(seq / 40.0) AS INT) % 2 AS par, CAST(seq % 20 AS INT) AS line"
relation("words", "Words of lines with places and confidences; an engine read the two columns' rows as one.", "",
    spark=f"SELECT {_WORD} FROM {{lines}} LATERAL VIEW posexplode(split(text, ' ')) t AS pos, word",
    other=f"SELECT {_WORD} FROM (SELECT *, unnest(range(len(a))) AS pos, unnest(a) AS word FROM (SELECT *, string_split(text, ' ') AS a FROM {{lines}}) x) y")

relation("page_geom", "Page sizes in points.", """
SELECT CAST(floor(p_partkey/10.0) AS BIGINT) AS doc_id, CAST(p_partkey%10 AS INT)+1 AS page,
  CAST(CASE WHEN p_size%7=0 THEN 612 ELSE 595 END AS DOUBLE) AS width, CAST(CASE WHEN p_size%7=0 THEN 792 ELSE 842 END AS DOUBLE) AS height
FROM {part}""")

relation("boxes", "Scored detection boxes in per cent of the page.", """
SELECT CAST(floor(l_orderkey/50.0) AS BIGINT) AS doc_id, l_linenumber AS page,
  row_number() OVER (PARTITION BY CAST(floor(l_orderkey/50.0) AS BIGINT) ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS box_id,
  CASE WHEN l_returnflag='R' THEN 'solution' ELSE 'question' END AS label, round(l_discount + l_tax, 2) AS score,
  CAST((l_partkey%5)*16 AS DOUBLE) AS x0, CAST((l_partkey%5)*16 + 24 AS DOUBLE) AS x1,
  CAST((l_suppkey%10)*9 AS DOUBLE) AS y0, CAST(CASE WHEN l_suppkey%10 < 4 AND l_orderkey%13 = 0 THEN (l_suppkey%10)*9 + 64 ELSE (l_suppkey%10)*9 + CASE WHEN l_orderkey%17 = 0 THEN 2 ELSE 8 + (l_partkey%3)*4 END END AS DOUBLE) AS y1
FROM {lineitem}""")

relation("segments", "Boxes as the segments of numbered items; two boxes make an item, and about half of the numbers up to 31 occur.", """
SELECT doc_id, CAST(floor((box_id+1)/2.0) AS BIGINT) AS item, CAST((box_id+1)%2 AS INT) AS seg,
  CAST((CAST(floor((box_id+1)/2.0) AS BIGINT)%31)*(CAST(floor((box_id+1)/2.0) AS BIGINT)%31)%31 + 1 + CASE WHEN CAST(floor((box_id+1)/2.0) AS BIGINT)%97 = 0 THEN 60 ELSE 0 END AS STRING) AS q_num, CAST(floor((box_id+1)/2.0) AS BIGINT)%3 = 0 AS is_solution,
  page, y0, y1, x0, x1 FROM {boxes}""")

relation("items", "One row per item.", """
SELECT doc_id, item, min(q_num) AS q_num, bool_or(is_solution) AS is_solution, min(page) AS page,
  CASE WHEN item%5=0 THEN 'BCD' WHEN item%5=1 THEN 'CD' WHEN item%5=2 THEN '' ELSE 'ABCD' END AS option_labels, count(*) AS n_segments,
  CASE item%16 WHEN 0 THEN true WHEN 1 THEN false END AS is_hindi
FROM {segments} GROUP BY doc_id, item""")

relation("files", "File names with sizes, in batches.", """
SELECT p_partkey AS idx, CAST(floor(p_partkey/100.0) AS BIGINT) AS batch, concat(replace(p_name,' ','/'), CASE WHEN p_partkey%3=0 THEN '.JPG' WHEN p_partkey%3=1 THEN '.png' ELSE '' END) AS original,
  CAST(p_size AS BIGINT)*1000 AS bytes, p_size*10 AS width, p_size*12 AS height FROM {part}""")

relation("lines_pct", "Lines in per cent of the page, with papers spread over the boxes' documents.", """
SELECT doc_id, page, seq, y_top/8.0 AS y0, y_bottom/8.0 AS y1, x_left/6.4 AS x0, x_right/6.4 AS x1, text FROM {lines}""")

relation("figures", "Figure boxes in pixels of a 640 by 800 page.", """
SELECT doc_id, page, box_id AS fig_id, x0*6 AS x0, x1*6 AS x1, y0*8 AS y0, CASE WHEN box_id%44=0 THEN y0*8 + 16 ELSE y1*8 END AS y1,
  CASE WHEN box_id%12=0 THEN 'image' WHEN box_id%20=0 THEN 'table' ELSE 'drawing' END AS kind, CAST(box_id%5 AS INT) AS n_rows, CAST(box_id%7 AS INT) AS n_columns FROM {boxes} WHERE box_id%4=0""")

relation("placed_images", "Pictures placed on pages: icons beside some lines, and a background now and then.", """
SELECT doc_id, page, seq AS image_id, x_left + 8 AS x0, CASE WHEN seq%13=0 THEN 0 ELSE y_top - 20 END AS y0, x_left + 24 AS x1, CASE WHEN seq%13=0 THEN 640 ELSE y_top - 6 END AS y1 FROM {lines} WHERE seq%6=4""")

relation("strokes", "Thin strokes: rules, fraction bars, underlines and frame sides.", """
SELECT CAST(floor(l_orderkey/400.0) AS BIGINT) AS doc_id, CAST(l_linenumber%3 AS INT)+1 AS page,
  row_number() OVER (PARTITION BY CAST(floor(l_orderkey/400.0) AS BIGINT) ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS stroke_id,
  CAST(32 + (l_partkey%4)*64 AS DOUBLE) AS x0,
  CAST(32 + (l_partkey%4)*64 + CASE WHEN l_suppkey%4=0 THEN 1 WHEN l_suppkey%4=1 THEN 30 ELSE 256 END AS DOUBLE) AS x1,
  CAST(64 + (l_orderkey%20)*32 AS DOUBLE) AS y0,
  CAST(64 + (l_orderkey%20)*32 + CASE WHEN l_suppkey%4=0 THEN 96 WHEN l_suppkey%28=3 THEN 64 ELSE 1 END AS DOUBLE) AS y1, l_suppkey%28=3 AS is_rect
FROM {lineitem}""")

relation("links", "Hyperlinks on some pages.", """
SELECT doc_id, page, seq AS link_id, y_top AS y0, y_bottom AS y1, x_left AS x0, x_right AS x1,
  CASE WHEN seq%3=0 THEN 'https://bit.ly/abc' WHEN seq%3=1 THEN 'https://example.org/x' ELSE 'https://PLAY.google.com/store' END AS uri
FROM {lines} WHERE seq%17=5""")

relation("fonts", "Fonts named on pages.", """
SELECT CAST(floor(p_partkey/10.0) AS BIGINT) AS doc_id, CAST(p_partkey%10 AS INT)+1 AS page, CAST(p_size%6 AS INT) AS xref,
  concat(CASE WHEN p_size%4=0 THEN 'ABCDEF+' ELSE '' END, 'Font', CAST(p_size%6 AS STRING)) AS basefont,
  CASE WHEN p_size%5=0 THEN 'n/a' ELSE 'ttf' END AS ext FROM {part}""")

relation("page_images", "Images placed on pages, in pixels and points.", """
SELECT CAST(floor(p_partkey/10.0) AS BIGINT) AS doc_id, CAST(p_partkey%10 AS INT)+1 AS page, p_partkey AS image_id,
  p_size*20 AS w_px, p_size*24 AS h_px, CAST(60 + p_size*8 AS DOUBLE) AS w_pt, CAST(72 + p_size*8 AS DOUBLE) AS h_pt, CASE WHEN p_partkey%40=1 THEN 'DeviceRGB' ELSE 'DeviceGray' END AS colorspace FROM {part} WHERE p_partkey%3<>0""")

relation("model_json", "Raw answers of a page model: wrapped, bare, single, fenced and broken.", """
SELECT doc_id, box_id AS answer_id, page AS first_page, page + 3 AS last_page,
  CASE WHEN box_id%5=0 THEN concat('{"questions":[', body, ']}') WHEN box_id%5=1 THEN concat('[', body, ']') WHEN box_id%5=2 THEN body
       WHEN box_id%5=3 THEN concat('```json', chr(10), '{"questions":[', body, ']}', chr(10), '```') ELSE concat('no answer ', body, ' {') END AS raw
FROM (SELECT *, concat('{"q_num":"', CASE WHEN box_id%23=0 THEN ' ' ELSE CAST(box_id%50 AS STRING) END, '","is_solution":', CASE WHEN label = 'solution' THEN 'true' ELSE 'false' END, ',"segments":[{"page":', CAST(page + CAST(box_id%6 AS INT) AS STRING),
  ',"y_start_pct":', CAST(CAST(y0 AS INT) AS STRING), ',"y_end_pct":', CAST(CAST(y1 AS INT) - CAST(box_id%11=0 AS INT)*40 AS STRING), '},{"page":', CAST(page AS STRING), ',"y_start_pct":2,"y_end_pct":"3.5"},{"page":null,"y_start_pct":1,"y_end_pct":2}]}') AS body FROM {boxes}) b""")

relation("page_specs", "Page-range texts, some malformed.", """
SELECT p_partkey AS spec_id, CASE WHEN p_size%7=0 THEN 'x-3' WHEN p_size%7=1 THEN concat(CAST(p_size AS STRING), ' to ', CAST(p_size%9+1 AS STRING))
  WHEN p_size%7=2 THEN '' WHEN p_size%7=3 THEN concat('1-3, ', CAST(p_size AS STRING)) ELSE concat(CAST(p_size%5+1 AS STRING), '-', CAST(p_size AS STRING), ',8') END AS spec, 30 AS max_page FROM {part}""")

relation("tiny_boxes", "Boxes, some shrunk.", """
SELECT doc_id, page, box_id, x0, CASE WHEN box_id%7=0 THEN x0 + 1.25 WHEN box_id%7=1 THEN x0 + 1.5 ELSE x1 END AS x1, y0, CASE WHEN box_id%5=0 THEN y0 + 1.0 ELSE y1 END AS y1 FROM {boxes}""")

relation("letterboxes", "How each page was fitted into a detector's square: its scale and padding, and the page's own pixels.", """
SELECT DISTINCT doc_id, page, CAST(CASE WHEN page%2=0 THEN 0.5 ELSE 0 END AS DOUBLE) AS scale, CAST(CASE WHEN page%2=0 THEN 120 ELSE 0 END AS DOUBLE) AS pad_x, CAST(32 AS DOUBLE) AS pad_y, CAST(400 AS DOUBLE) AS width, CAST(800 AS DOUBLE) AS height FROM {boxes}""")
relation("class_names", "Names of a detector's classes.", "SELECT 0 AS class_id, 'Question' AS label UNION ALL SELECT 1, ' solution' UNION ALL SELECT 2, 'logo'")
relation("tensor_rows", "Detector output in three layouts, a third of it in shares of the square.", """
SELECT doc_id, page, box_id, CASE box_id%3
  WHEN 0 THEN VALUES_OF(cx, cy, w, h, conf, CASE WHEN label = 'solution' THEN 1.0D ELSE 0.0D END)
  WHEN 1 THEN VALUES_OF(cx / 640, cy / 640, w / 640, h / 640, CASE WHEN label = 'question' THEN conf ELSE conf / 2 END, CASE WHEN label = 'question' THEN conf / 2 ELSE conf END, CASE WHEN box_id%7=0 THEN conf * 2 ELSE 0.0D END)
  ELSE VALUES_OF(cx, cy, w, h, conf, CASE WHEN label = 'question' THEN 0.75D ELSE 0.25D END, CASE WHEN label = 'question' THEN 0.25D ELSE 0.75D END) END AS vals
FROM (SELECT *, CAST((x0 + x1) * 2 AS DOUBLE) AS cx, CAST((y0 + y1) * 4 + 32 AS DOUBLE) AS cy, CAST((x1 - x0) * 4 AS DOUBLE) AS w, CAST((y1 - y0) * 8 AS DOUBLE) AS h, CAST(score AS DOUBLE) AS conf FROM {boxes}) b""".replace("1.0D", "CAST(1 AS DOUBLE)").replace("0.0D", "CAST(0 AS DOUBLE)").replace("0.75D", "CAST(0.75 AS DOUBLE)").replace("0.25D", "CAST(0.25 AS DOUBLE)"))

relation("variants", "Sizes of each file by strength of compression.", """
SELECT batch, idx, bytes AS original_bytes, level, CAST(floor(bytes * (1.1 - 0.2 * level)) AS BIGINT) AS size FROM {files} CROSS JOIN (SELECT 0 AS level UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) x""")

# Inputs of single operators: what a user selects, other sources and tiers. A caller passes its own.
_INPUTS = {
    "solution_lines": ("Worked solutions, each with its answer on its last line.", """
SELECT doc_id, CAST(num AS BIGINT) * 10 + k AS seq, CASE k WHEN 0 THEN concat(CASE num % 4 WHEN 1 THEN 'Sol. ' WHEN 2 THEN 'Q ' ELSE '' END, CAST(num AS STRING), CASE num % 4 WHEN 1 THEN ' As shown,' ELSE '. As shown,' END) WHEN 1 THEN 'it follows.'
  ELSE CASE num % 3 WHEN 0 THEN concat('Ans. (', letter, ')') WHEN 1 THEN concat('Correct option is ', letter) ELSE concat('Answer: ', lower(letter), '.') END END AS text
FROM {key_pairs} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) x WHERE num <= 999"""),
    "other_segments": ("Segments in a second language of items that hold both.", "SELECT doc_id, item, seg, page, y0, y1, x0 + 4 AS x0, x1 + 4 AS x1 FROM {segments} WHERE item % 4 = 3"),
    "model_key": ("A key as a model read it.", "SELECT doc_id, num, letter FROM {key_pairs} WHERE num <= 999"),
    "document_keys": ("Keys found, in three of four documents.", "SELECT doc_id, num, letter FROM {key_pairs} WHERE doc_id % 4 <> 1"),
    "selected_items": ("Items a user has selected.", "SELECT doc_id, item FROM {items} WHERE item % 4 = 1"),
    "points": ("Points a user has clicked.", "SELECT DISTINCT doc_id, page, x0 + 4 AS px, y0 + 3 AS py FROM {segments} WHERE item % 7 = 0"),
    "page_scope": ("Pages in scope, and whether they hold answers.", "SELECT DISTINCT doc_id, page, page % 2 = 0 AS answers FROM {segments} WHERE page <= 4"),
    "question_scope": ("Pages that may hold questions.", "SELECT doc_id, page FROM {paper_pages} WHERE page <= last_page / 2"),
    "answer_scope": ("Pages that may hold answers; some documents name none.", "SELECT doc_id, page FROM {paper_pages} WHERE page > last_page - 2 AND doc_id % 2 = 0"),
    "skipped_pages": ("Pages a user leaves out.", "SELECT doc_id, page FROM {paper_pages} WHERE page % 5 = 0"),
    "requested_pages": ("Pages asked for, in order.", "SELECT batch, CAST(idx % 100 AS INT) AS pos, CAST(width % 13 AS INT) + 1 AS page FROM {files}"),
    "given_stems": ("Names that a user gave for a batch's pages, in order; one batch gives too few.", "SELECT batch, pos, concat('chapter ', CAST(pos AS STRING)) AS stem FROM {requested_pages} WHERE batch % 3 = 1 OR (batch % 3 = 2 AND pos > 0)"),
    "text_lines": ("Lines of the text layer, which some pages lack.", "SELECT doc_id, page, seq FROM {lines} WHERE page % 3 <> 0"),
    "ocr_lines": ("Lines that OCR read.", "SELECT doc_id, page, seq FROM {lines} WHERE seq % 2 = 0"),
    "tier_pages": ("Pages of each document with their class and OCR's confidence.", """
SELECT doc_id, page, CASE WHEN (doc_id + page) % 5 = 0 OR doc_id % 7 = 3 AND page % 3 > 0 THEN 'ocr' WHEN page % 3 = 0 THEN 'text_then_ocr' ELSE 'text' END AS class, CAST(CASE WHEN page = 2 THEN 40 WHEN page = 5 THEN 0 ELSE 90 END AS DOUBLE) AS conf
FROM (SELECT DISTINCT doc_id, page FROM {segments}) p"""),
    "tier_text": ("Segments by the text layer: few in some documents.", "SELECT * FROM {segments} WHERE item % 3 = 0 AND (doc_id % 3 > 0 OR item % 60 = 0)"),
    "tier_ocr": ("Segments by OCR.", "SELECT * FROM {segments} WHERE item % 2 = 0 AND (doc_id % 4 > 0 OR item % 40 = 0)"),
    "tier_local": ("Segments by a local model.", "SELECT * FROM {segments} WHERE item % 5 = 0 AND doc_id % 5 = 0"),
    "tier_model": ("Segments by a page model.", "SELECT * FROM {segments} WHERE doc_id % 6 < 5"),
    "encrypted_documents": ("Documents that need a password.", "SELECT DISTINCT doc_id FROM {page_geom} WHERE doc_id % 9 = 4"),
    "kept_pages": ("Pages a user leaves at their size.", "SELECT doc_id, page FROM {page_geom} WHERE page % 4 = 0"),
    "queue": ("Files in a queue with their status.", """
SELECT batch, original, CASE WHEN idx%4=0 THEN 'pending' WHEN idx%4=1 THEN 'processing' WHEN idx%4=2 THEN 'done' ELSE 'error' END AS status FROM {files}"""),
    "named_files": ("Names given to files.", "SELECT batch, idx, concat('item', CAST(width % 70 AS STRING)) AS name FROM {files}"),
}
for _name, (_doc, _sql) in _INPUTS.items():
    relation(_name, _doc, _sql)
