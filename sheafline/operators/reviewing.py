"""Joins, scores and notes over found items: overlaps, coverage, confidence, duplicates, gaps, answers."""

from ..relations import SETTINGS, SHARED, relation

SHARED |= {
    "segments", "items", "item_numbers", "d_extent_stats", "c_overlaps", "cover", "boxes", "free_room", "d_expected_numbers", "number_runs", "d_undercovered",
    "d_uncovered_head", "cut_reasons", "item_reasons", "d_orphan_pages", "e_duplicates", "c_missing_option_hint",
    "item_languages", "language_places", "language_pairs", "page_margins", "read_documents",
}

# Limits of the review's rules, in per cent of the page unless they are shares of a median or counts.
SETTINGS |= {
    "phantom_gap": 10, "phantom_run": 4,
    "tiny_extent": 4.0, "short_share": 0.45, "short_below": 10.0, "tall_share": 1.9, "tall_from": 55.0, "page_edge": 92.0, "page_edge_below": 35.0,
    "overlap_from": 6.0, "cover_play": 1.5, "body_top": 6.0, "body_bottom": 94.0, "uncovered_gap": 14.0, "tail_band": 8.0, "head_band": 2.0, "orphan_band": 6.0,
}

W, H = "$(page_width)", "$(page_height)"
#: A number's first digits; null where it has none.
NUMBER = "TRY_CAST(regexp_extract({q}, '([0-9]+)', 1) AS INT)"
relation("item_numbers", "Items with their number, how many of the options A to D they show, and their last segment's bottom.", f"""
SELECT i.doc_id, i.item, i.q_num, i.is_solution, i.page, i.n_segments, {NUMBER.format(q="i.q_num")} AS num, s.bottom, s.last_page,
  {" + ".join(f"CAST(contains(coalesce(i.option_labels, ''), '{c}') AS INT)" for c in "ABCD")} AS n_options, coalesce(i.option_labels, '') AS option_labels
FROM {{items}} i JOIN (SELECT doc_id, item, max(y1) AS bottom, max(page) AS last_page FROM {{segments}} GROUP BY doc_id, item) s ON i.doc_id = s.doc_id AND i.item = s.item""")

relation("c_overlaps", "Items whose segments overlap a sibling's on a page by 6 per cent of its height.", "",
    spark="""
SELECT DISTINCT doc_id, EXPLODE(both) AS item FROM (
  SELECT a.doc_id, array(a.item, b.item) AS both FROM {segments} a JOIN {segments} b ON a.doc_id = b.doc_id AND a.page = b.page AND a.is_solution = b.is_solution AND a.item < b.item
    AND least(a.x1, b.x1) - greatest(a.x0, b.x0) > 0 AND least(a.y1, b.y1) - greatest(a.y0, b.y0) >= $(overlap_from)) p""",
    other="""
SELECT DISTINCT doc_id, unnest([i, j]) AS item FROM (
  SELECT a.doc_id, a.item AS i, b.item AS j FROM {segments} a JOIN {segments} b ON a.doc_id = b.doc_id AND a.page = b.page AND a.is_solution = b.is_solution AND a.item < b.item
    AND least(a.x1, b.x1) - greatest(a.x0, b.x0) > 0 AND least(a.y1, b.y1) - greatest(a.y0, b.y0) >= $(overlap_from)) p""")  # fmt: skip

relation("d_extent_stats", "Vertical extent of each item and the median of its side.", """
SELECT doc_id, item, is_solution, extent, median(extent) OVER (PARTITION BY doc_id, is_solution) AS median_extent
FROM (SELECT doc_id, item, bool_or(is_solution) AS is_solution, sum(greatest(0.0, y1 - y0)) AS extent FROM {segments} GROUP BY doc_id, item) x""")

#: Whether an item i with extents e is short, tall or ends at the page's edge.
_SHORT = "(e.median_extent > 0 AND e.extent < $(short_share) * e.median_extent AND e.extent < $(short_below))"
_TALL = "(i.n_segments = 1 AND e.median_extent > 0 AND e.extent > $(tall_share) * e.median_extent AND e.extent >= $(tall_from))"
_EDGE = "(i.n_segments = 1 AND i.bottom >= $(page_edge) AND e.extent <= $(page_edge_below))"
#: What is found of one item holds for all of its document with the same side and number.
_KEYS = "(SELECT DISTINCT s.doc_id, s.is_solution, s.q_num FROM {{{name}}} f JOIN {{items}} s ON f.doc_id = s.doc_id AND f.item = s.item)"
_SIGNALS = " ".join(
    f"LEFT JOIN {_KEYS.format(name=name)} {a} ON i.doc_id = {a}.doc_id AND i.is_solution = {a}.is_solution AND i.q_num = {a}.q_num"
    for a, name in (("o", "c_overlaps"), ("u", "d_undercovered"), ("h", "d_uncovered_head"))
)

relation("d_confidence", "A score from 0 to 1 for each item: the product of its signals.", f"""
SELECT doc_id, item, BROUND(greatest(0.0, least(1.0, tiny * tall * over * opts * edge * under * head)), 2) AS confidence FROM (
  SELECT i.doc_id, i.item, CASE WHEN e.extent < $(tiny_extent) THEN 0.2E0 WHEN {_SHORT} THEN 0.5E0 ELSE 1.0E0 END AS tiny,
    CASE WHEN {_TALL} THEN 0.6E0 ELSE 1.0E0 END AS tall, CASE WHEN o.q_num IS NULL THEN 1.0E0 ELSE 0.4E0 END AS over, CASE WHEN i.n_options BETWEEN 2 AND 3 THEN 0.6E0 ELSE 1.0E0 END AS opts,
    CASE WHEN {_EDGE} THEN 0.3E0 ELSE 1.0E0 END AS edge, CASE WHEN u.q_num IS NULL THEN 1.0E0 ELSE 0.4E0 END AS under, CASE WHEN h.q_num IS NULL THEN 1.0E0 ELSE 0.5E0 END AS head
  FROM {{item_numbers}} i JOIN {{d_extent_stats}} e ON i.doc_id = e.doc_id AND i.item = e.item {_SIGNALS}) x""")

relation("cover", "Each line in per cent with whether some segment holds it: its centre across, its middle within 1.5 per cent.", """
SELECT l.doc_id, l.page, l.seq, l.y0, l.y1, l.x0, l.x1, EXISTS (SELECT 1 FROM {segments} s WHERE s.doc_id = l.doc_id AND s.page = l.page
  AND (l.x0 + l.x1) / 2 BETWEEN s.x0 AND s.x1 AND (l.y0 + l.y1) / 2 BETWEEN s.y0 - $(cover_play) AND s.y1 + $(cover_play)) AS covered FROM {lines_pct} l""")

relation("c_cover_lines", "Lines that no segment holds.", "SELECT doc_id, page, seq FROM {cover} WHERE NOT covered")

relation("free_room", "How far the page is free below each segment, and whether another item's segment begins above it, within its width.", """
SELECT o.doc_id, o.item, o.seg, o.page, o.x0, o.x1, o.y0, o.y1, least($(body_bottom), coalesce(min(CASE WHEN s.y0 >= o.y1 THEN s.y0 END), $(body_bottom))) AS bottom, coalesce(bool_or(s.y0 < o.y0), false) AS has_above
FROM {segments} o LEFT JOIN {segments} s ON s.doc_id = o.doc_id AND s.page = o.page AND NOT (s.is_solution = o.is_solution AND s.q_num = o.q_num) AND (s.x0 + s.x1) / 2 BETWEEN o.x0 AND o.x1
GROUP BY o.doc_id, o.item, o.seg, o.page, o.x0, o.x1, o.y0, o.y1""")

_TAIL = """
SELECT r.doc_id, r.item, r.seg, r.page, greatest(0, min(l.y0)) AS y0, least(100, max(l.y1)) AS y1, r.x0, r.x1, sum(l.y1 - l.y0) AS band
FROM {{free_room}} r JOIN (SELECT *, (y0 + y1) / 2 AS mid FROM {{cover}} WHERE NOT covered) l ON l.doc_id = r.doc_id AND l.page = r.page AND (l.x0 + l.x1) / 2 BETWEEN r.x0 AND r.x1 AND {place}
GROUP BY r.doc_id, r.item, r.seg, r.page, r.x0, r.x1, r.y0, r.y1 HAVING {keep}"""
relation("d_undercovered", "Segments with a band of uncovered text that begins close below them, and where it stands.",
    _TAIL.format(place="l.mid > r.y1 AND l.mid >= $(body_top) AND l.mid <= r.bottom", keep="min(l.y0) - r.y1 <= $(uncovered_gap) AND sum(l.y1 - l.y0) >= $(tail_band)"))
relation("d_uncovered_head", "A column's topmost segments with uncovered text that ends close above them, and where it stands.",
    _TAIL.format(place="NOT r.has_above AND l.mid < r.y0 AND l.mid BETWEEN $(body_top) AND $(body_bottom)", keep="r.y0 - max_by(l.y1, l.y0 * 1E6 + l.y1) <= $(uncovered_gap) AND sum(l.y1 - l.y0) >= $(head_band)"))

relation("d_orphan_pages", "Pages with a band of body text that no segment covers or stands close above or below of in its column.", """
SELECT l.doc_id, l.page, sum(l.y1 - l.y0) AS band FROM {cover} l
WHERE NOT l.covered AND (l.y0 + l.y1) / 2 BETWEEN $(body_top) AND $(body_bottom) AND NOT EXISTS (SELECT 1 FROM {segments} s WHERE s.doc_id = l.doc_id AND s.page = l.page AND (l.x0 + l.x1) / 2 BETWEEN s.x0 AND s.x1
  AND (l.y0 - s.y1 BETWEEN -$(cover_play) AND $(uncovered_gap) OR s.y0 - l.y1 BETWEEN -$(cover_play) AND $(uncovered_gap)))
GROUP BY l.doc_id, l.page HAVING sum(l.y1 - l.y0) >= $(orphan_band)""")

relation("e_duplicates", "Items whose number and side an earlier item has.", """
SELECT doc_id, item, q_num, is_solution, page FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, is_solution, num ORDER BY item) AS rn FROM {item_numbers} WHERE num IS NOT NULL) x WHERE rn > 1""")

relation("cut_reasons", "Each item that looks cut off by its shape, with the first reason: at the page's edge, shorter or taller than its side's others, very small.", f"""
SELECT i.doc_id, i.item, CASE WHEN {_EDGE} THEN 'ends at the page edge' WHEN {_SHORT} AND i.n_options < 4 THEN 'shorter than the others' WHEN {_TALL} THEN 'taller than the others' ELSE 'very small' END AS reason
FROM {{item_numbers}} i JOIN {{d_extent_stats}} e ON i.doc_id = e.doc_id AND i.item = e.item
WHERE {_EDGE} OR ({_SHORT} AND i.n_options < 4) OR {_TALL} OR e.extent < $(tiny_extent)""")

relation("item_reasons", "Each item with the first reason to look at its crop: its shape, uncovered text below or above, an overlap, a question's missing options.", f"""
SELECT i.doc_id, i.item, i.q_num, i.is_solution, i.page, coalesce(c.reason, CASE WHEN u.q_num IS NOT NULL THEN 'text below is not covered' WHEN h.q_num IS NOT NULL THEN 'text above is not covered'
  WHEN o.q_num IS NOT NULL THEN 'overlaps another item' WHEN NOT i.is_solution AND i.n_options BETWEEN 2 AND 3 THEN 'options may be missing' END) AS reason
FROM {{item_numbers}} i LEFT JOIN {{cut_reasons}} c ON i.doc_id = c.doc_id AND i.item = c.item {_SIGNALS}""")

relation("d_flag_items", "Each item with the first reason to look at it; a number that an earlier item has comes before all others.", """
SELECT i.doc_id, i.item, d.item IS NOT NULL OR i.reason IS NOT NULL AS flagged, CASE WHEN d.item IS NOT NULL THEN 'duplicate number' ELSE i.reason END AS reason
FROM {item_reasons} i LEFT JOIN {e_duplicates} d ON i.doc_id = d.doc_id AND i.item = d.item""")

relation("g_number_gaps", "Numbers missing between a side's lowest and highest.", """
SELECT r.doc_id, r.is_solution, CAST(r.n AS BIGINT) AS num FROM {number_runs} r
WHERE NOT EXISTS (SELECT 1 FROM {item_numbers} i WHERE i.doc_id = r.doc_id AND i.is_solution = r.is_solution AND i.num = r.n)""")

relation("number_runs", "Every number between a side's lowest and highest.", """
SELECT doc_id, is_solution, EXPLODE(SEQ(lo, hi)) AS n, n_items, hi - lo AS span FROM (SELECT doc_id, is_solution, min(num) AS lo, max(num) AS hi, count(*) AS n_items FROM {item_numbers} WHERE num IS NOT NULL GROUP BY doc_id, is_solution) x""")

relation("d_expected_numbers", "The run of numbers that a key implies.", """
SELECT doc_id, CAST(n AS BIGINT) AS num FROM (SELECT doc_id, EXPLODE(SEQ(lo, hi)) AS n FROM (SELECT doc_id, min(num) AS lo, max(num) AS hi FROM {key_pairs} GROUP BY doc_id) x) y""")

relation("c_key_minus_found", "Expected numbers that no question has.", """
SELECT e.doc_id, e.num FROM {d_expected_numbers} e WHERE NOT EXISTS (SELECT 1 FROM {item_numbers} i WHERE i.doc_id = e.doc_id AND NOT i.is_solution AND CAST(i.num AS BIGINT) = e.num)""")

#: The first few numbers of a list, in order, and how many more there are.
_LISTED = "concat(AJOIN(ASORT(COLLECT(lpad(CAST({c} AS STRING), 3, '0'))), ', '), CASE WHEN max(n) > {k} THEN concat(' and ', CAST(max(n) - {k} AS STRING), ' more') ELSE '' END)"
relation("d_review_notes", "What a reviewer should know: crops to look at, with the band of text that may belong to them; numbers found twice, missing from a run or from the key; pages with text but no crop; documents without items.", f"""
WITH bands AS (
  SELECT doc_id, item, 'text below is not covered' AS reason, min(y0) AS y0, max(y1) AS y1, count(*) AS n FROM {{d_undercovered}} GROUP BY doc_id, item
  UNION ALL SELECT doc_id, item, 'text above is not covered', min(y0), max(y1), count(*) FROM {{d_uncovered_head}} GROUP BY doc_id, item
  UNION ALL SELECT doc_id, item, 'options may be missing', min(y0), max(y1), count(*) FROM {{c_missing_option_hint}} GROUP BY doc_id, item
), gaps AS (
  SELECT g.doc_id, g.is_solution, g.num, r.n_items, r.span, row_number() OVER (PARTITION BY g.doc_id, g.is_solution ORDER BY g.num) AS rn, count(*) OVER (PARTITION BY g.doc_id, g.is_solution) AS n
  FROM {{g_number_gaps}} g JOIN (SELECT DISTINCT doc_id, is_solution, n_items, span FROM {{number_runs}}) r ON g.doc_id = r.doc_id AND g.is_solution = r.is_solution
), in_key AS (SELECT doc_id, num, row_number() OVER (PARTITION BY doc_id ORDER BY num) AS rn, count(*) OVER (PARTITION BY doc_id) AS n FROM {{c_key_minus_found}}
), orphans AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS rn, count(*) OVER (PARTITION BY doc_id) AS n FROM {{d_orphan_pages}}
)
SELECT i.doc_id, 'incomplete' AS kind, concat(CASE WHEN i.is_solution THEN 'S' ELSE 'Q' END, i.q_num, ': ', i.reason) AS message, i.item, i.page, b.y0, b.y1, coalesce(b.n, 0) AS n_suggested
FROM {{item_reasons}} i LEFT JOIN bands b ON i.doc_id = b.doc_id AND i.item = b.item AND i.reason = b.reason WHERE i.reason IS NOT NULL
UNION ALL
SELECT doc_id, 'duplicate', concat(CASE WHEN is_solution THEN 'S' ELSE 'Q' END, q_num, ' appears again'), item, page, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), 0 FROM {{e_duplicates}}
UNION ALL
SELECT doc_id, 'gap', concat(CASE WHEN is_solution THEN 'solutions' ELSE 'questions' END, ' may be missing: ', {_LISTED.format(c="num", k=8)}), CAST(NULL AS BIGINT), CAST(NULL AS INT), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), 0
FROM gaps WHERE rn <= 8 AND n_items >= 3 AND n <= greatest(5, CAST(floor(span / 2.0) AS INT)) GROUP BY doc_id, is_solution
UNION ALL
SELECT doc_id, 'gap', concat('in the key but not found: ', {_LISTED.format(c="num", k=10)}), CAST(NULL AS BIGINT), CAST(NULL AS INT), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), 0 FROM in_key WHERE rn <= 10 GROUP BY doc_id
UNION ALL
SELECT doc_id, 'incomplete', concat('text without an item on pages ', {_LISTED.format(c="page", k=8)}), CAST(NULL AS BIGINT), min(page), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), 0 FROM orphans WHERE rn <= 8 GROUP BY doc_id
UNION ALL
SELECT p.doc_id, 'low_confidence', 'nothing was found', CAST(NULL AS BIGINT), CAST(NULL AS INT), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), 0 FROM (SELECT DISTINCT doc_id FROM {{paper_pages}}) p
WHERE NOT EXISTS (SELECT 1 FROM {{items}} i WHERE i.doc_id = p.doc_id)""")

relation("c_answers_join", "One row for each question number with its answer, blank if unknown.", """
SELECT q.doc_id, q.num, coalesce(k.letter, '') AS answer FROM (SELECT DISTINCT doc_id, CAST(q_num AS INT) AS num FROM {items} WHERE NOT is_solution) q
LEFT JOIN {key_pairs} k ON q.doc_id = k.doc_id AND q.num = k.num""")

relation("d_job_summary", "Counts of a document's items, stitched items and answers, whether any of it needs a look, and whether any item stands in two languages.", """
SELECT i.doc_id, count(*) AS total, count_if(i.is_solution IS NOT TRUE) AS questions, count_if(i.is_solution) AS solutions, count_if(i.n_segments > 1) AS stitched, coalesce(max(a.answered), 0) AS answered,
  bool_or(f.flagged) OR bool_or(n.doc_id IS NOT NULL) AS needs_review, bool_or(b.doc_id IS NOT NULL) AS two_languages
FROM {items} i JOIN {d_flag_items} f ON i.doc_id = f.doc_id AND i.item = f.item LEFT JOIN (SELECT doc_id, count_if(answer <> '') AS answered FROM {c_answers_join} GROUP BY doc_id) a ON i.doc_id = a.doc_id
LEFT JOIN (SELECT DISTINCT doc_id FROM {d_review_notes}) n ON i.doc_id = n.doc_id LEFT JOIN (SELECT DISTINCT doc_id FROM {c_bilingual_exact}) b ON i.doc_id = b.doc_id GROUP BY i.doc_id""")

relation("e_phantoms", "Items without lone numbers far above their run; items without a number stay.", f"""
WITH numbered AS (SELECT doc_id, item, is_solution, q_num, {NUMBER.format(q="q_num")} AS num FROM {{items}}), nums AS (
  SELECT doc_id, is_solution, num, row_number() OVER (PARTITION BY doc_id, is_solution ORDER BY num) AS r, num - lag(num) OVER (PARTITION BY doc_id, is_solution ORDER BY num) AS gap
  FROM (SELECT DISTINCT doc_id, is_solution, num FROM numbered WHERE num IS NOT NULL) x
), peeled AS (
  SELECT *, min(CASE WHEN gap >= $(phantom_gap) AND r > $(phantom_run) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, is_solution ORDER BY num DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS phantom FROM nums
)
SELECT i.doc_id, i.item, i.num, i.is_solution FROM numbered i LEFT JOIN peeled p ON i.doc_id = p.doc_id AND i.is_solution = p.is_solution AND i.num = p.num WHERE coalesce(p.phantom, 0) = 0""")

relation("e_clip_overlaps", "Segments cut where a later one of their page and side begins under them.", """
SELECT a.doc_id, a.item, a.seg, a.page, a.y0, least(a.y1, coalesce(min(b.y0), a.y1)) AS y1, a.x0, a.x1
FROM {segments} a LEFT JOIN {segments} b ON a.doc_id = b.doc_id AND a.page = b.page AND a.is_solution = b.is_solution AND a.item <> b.item AND b.y0 > a.y0 AND b.y0 < a.y1 AND least(a.x1, b.x1) - greatest(a.x0, b.x0) > 5
GROUP BY a.doc_id, a.item, a.seg, a.page, a.y0, a.y1, a.x0, a.x1""")

relation("e_number_boxes", "Boxes numbered by side in reading order.", """
SELECT doc_id, page, box_id, label, CAST(row_number() OVER (PARTITION BY doc_id, label ORDER BY page, CASE WHEN (x0 + x1) / 2 >= 50 THEN 1 ELSE 0 END, y0, x0, box_id) AS BIGINT) AS num FROM {boxes}""")

relation("e_name_collisions", "File names made different: the second of a name gets _2, the third _3.", """
SELECT batch, idx, CASE WHEN rn = 1 THEN name ELSE concat(name, '_', CAST(rn AS STRING)) END AS name FROM (
  SELECT batch, idx, name, row_number() OVER (PARTITION BY batch, lower(name) ORDER BY idx) AS rn FROM {named_files}) y""")

relation("e_page_batches", "Pages in windows of four, three apart.", """
SELECT doc_id, CAST(b AS BIGINT) AS batch, page FROM (SELECT doc_id, page, EXPLODE(SEQ(greatest(0, CAST(ceil((page - 4) / 3.0) AS INT)), CAST(floor((page - 1) / 3.0) AS INT))) AS b FROM {paper_pages} WHERE ceil((page - 4) / 3.0) <= floor((page - 1) / 3.0)) x""")

relation("e_split", "A stable split into train, val and test by a hash of the key.", """
SELECT doc_id, item, CASE WHEN h < 'cc' THEN 'train' WHEN h < 'e6' THEN 'val' ELSE 'test' END AS split FROM (SELECT doc_id, item, substring(md5(concat('7:', CAST(doc_id AS STRING), ':', CAST(item AS STRING))), 1, 2) AS h FROM {items}) x""")

relation("f_natural_order", "Items ranked by side, number, then text.", """
SELECT doc_id, item, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY is_solution, coalesce(TRY_CAST(regexp_extract(q_num, '([0-9]+)', 1) AS INT), 1000000000), q_num, item) AS BIGINT) AS rank FROM {items}""")

relation("f_last_pages", "The last six pages of each paper.", """
SELECT doc_id, page FROM (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY page DESC) AS rn FROM {paper_pages}) x WHERE rn <= 6""")

# How many of each list a report shows.
SETTINGS |= {"shown_fonts": 6, "shown_sizes": 20, "shown_images": 200, "scanned_images": 500, "shown_distinct_sizes": 4, "shown_gaps": 8, "shown_key_gaps": 10}
relation("f_report_caps", "What a report lists of each document: the first six font names, twenty page sizes, 200 of at most 500 pictures, four distinct sizes, eight numbers missing from a side's run and ten from the key.", """
WITH sizes AS (SELECT doc_id, page, concat(CAST(CAST(width AS INT) AS STRING), 'x', CAST(CAST(height AS INT) AS STRING)) AS value FROM {page_geom}),
entries AS (
  SELECT doc_id, 'font' AS kind, basefont AS value, row_number() OVER (PARTITION BY doc_id ORDER BY basefont) AS rn, $(shown_fonts) AS most FROM (SELECT DISTINCT doc_id, basefont FROM {fonts}) a
  UNION ALL SELECT doc_id, 'size', value, row_number() OVER (PARTITION BY doc_id ORDER BY page), $(shown_sizes) FROM sizes
  UNION ALL SELECT doc_id, 'distinct size', value, row_number() OVER (PARTITION BY doc_id ORDER BY value), $(shown_distinct_sizes) FROM (SELECT DISTINCT doc_id, value FROM sizes) b
  UNION ALL SELECT doc_id, 'image', CAST(image_id AS STRING), row_number() OVER (PARTITION BY doc_id ORDER BY page, image_id), least($(shown_images), $(scanned_images)) FROM {page_images}
  UNION ALL SELECT doc_id, CASE WHEN is_solution THEN 'solution gap' ELSE 'question gap' END, CAST(num AS STRING), row_number() OVER (PARTITION BY doc_id, is_solution ORDER BY num), $(shown_gaps) FROM {g_number_gaps}
  UNION ALL SELECT doc_id, 'key gap', CAST(num AS STRING), row_number() OVER (PARTITION BY doc_id ORDER BY num), $(shown_key_gaps) FROM {c_key_minus_found}
)
SELECT doc_id, kind, CAST(rn AS BIGINT) AS place, value FROM entries WHERE rn <= most""")

relation("g_scope_pages", "Pages of either scope without the skipped ones; an empty scope stands for all pages.", """
WITH s AS (SELECT doc_id, page FROM {question_scope} UNION SELECT doc_id, page FROM {answer_scope}
  UNION SELECT doc_id, page FROM {paper_pages} p WHERE NOT EXISTS (SELECT 1 FROM {question_scope} q WHERE q.doc_id = p.doc_id) OR NOT EXISTS (SELECT 1 FROM {answer_scope} a WHERE a.doc_id = p.doc_id))
SELECT * FROM s EXCEPT SELECT doc_id, page FROM {skipped_pages}""")

SETTINGS |= {"per_output": "one", "strict_scope": 1, "zoom": 2.0, "paint_pad": 2.0}
relation("d_best_per_output", "For each side and number the item of the largest extent, the first of equals; with per_output 'two' the first two by place, as papers in two languages have them. Items without a number share one output.", f"""
WITH numbered AS (SELECT i.doc_id, i.is_solution, i.q_num, i.item, coalesce({NUMBER.format(q="i.q_num")}, 0) AS num, e.extent, i.is_hindi, s.page, s.x0, s.y0, (s.x0 + s.x1) / 2 AS mid FROM {{items}} i JOIN {{d_extent_stats}} e ON i.doc_id = e.doc_id AND i.item = e.item
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id, item ORDER BY seg) AS rn FROM {{segments}}) s ON i.doc_id = s.doc_id AND i.item = s.item AND s.rn = 1
), wide AS (SELECT *, max(x0) OVER w - min(x0) OVER w > 15 OR max(mid) OVER w - min(mid) OVER w > 15 AS beside FROM numbered WINDOW w AS (PARTITION BY doc_id, is_solution, num, page)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, is_solution, num ORDER BY extent DESC, item) AS by_extent,
    row_number() OVER (PARTITION BY doc_id, is_solution, num ORDER BY CASE WHEN is_hindi THEN 2 WHEN NOT is_hindi THEN 0 ELSE 1 END, page, CASE WHEN beside THEN x0 ELSE y0 END, item) AS by_place FROM wide
)
SELECT doc_id, is_solution, q_num, item FROM ranked WHERE CASE WHEN $(per_output) = 'two' THEN by_place <= 2 ELSE by_extent = 1 END""")

relation("d_column_spread", "Columns that a document's items use.", """
SELECT doc_id, AJOIN(ASORT(COLLECT(c)), ',') AS cols FROM (SELECT DISTINCT doc_id, CASE WHEN (x0 + x1) / 2 < 48 THEN 'left' WHEN (x0 + x1) / 2 > 52 THEN 'right' ELSE 'middle' END AS c FROM {segments}) x GROUP BY doc_id""")

relation("item_languages", "Numbered items with their language: as marked, else by the half of the page their first segment stands in.", f"""
SELECT i.doc_id, i.item, i.is_solution, {NUMBER.format(q="i.q_num")} AS num, coalesce(i.is_hindi, s.mid > 50, false) AS second FROM {{items}} i
LEFT JOIN (SELECT doc_id, item, mid FROM (SELECT doc_id, item, (x0 + x1) / 2 AS mid, row_number() OVER (PARTITION BY doc_id, item ORDER BY seg) AS rn FROM {{segments}}) x WHERE rn = 1) s ON i.doc_id = s.doc_id AND i.item = s.item""")

relation("d_next_number", "The next number of each side. Plain: the highest and one. Paired, without a language: the highest again if one item has it. For a language: the lowest number that only the other one has, else the highest if this one lacks it, else that and one.", """
WITH n AS (SELECT doc_id, is_solution, num, count(*) AS items, bool_or(second) AS has_second, bool_or(NOT second) AS has_first FROM {item_languages} WHERE num IS NOT NULL GROUP BY doc_id, is_solution, num),
sides AS (SELECT doc_id, is_solution FROM (SELECT DISTINCT doc_id FROM {items}) d JOIN {two_sides} s ON s.is_solution IS NOT NULL),
top AS (SELECT doc_id, is_solution, max(num) AS num FROM n GROUP BY doc_id, is_solution),
lacking AS (SELECT doc_id, is_solution, min(CASE WHEN NOT has_first THEN num END) AS first_lacks, min(CASE WHEN NOT has_second THEN num END) AS second_lacks FROM n GROUP BY doc_id, is_solution)
SELECT s.doc_id, s.is_solution, m.mode, CAST(CASE WHEN t.num IS NULL OR t.num = 0 THEN 1 WHEN m.mode = 'plain' THEN t.num + 1 WHEN m.mode = 'paired' THEN CASE WHEN n.items = 1 THEN t.num ELSE t.num + 1 END
  WHEN m.mode = 'first' THEN coalesce(l.first_lacks, CASE WHEN n.has_first THEN t.num + 1 ELSE t.num END) ELSE coalesce(l.second_lacks, CASE WHEN n.has_second THEN t.num + 1 ELSE t.num END) END AS BIGINT) AS next_number
FROM sides s JOIN {number_modes} m ON m.mode IS NOT NULL LEFT JOIN top t ON s.doc_id = t.doc_id AND s.is_solution = t.is_solution LEFT JOIN n ON n.doc_id = t.doc_id AND n.is_solution = t.is_solution AND n.num = t.num
LEFT JOIN lacking l ON s.doc_id = l.doc_id AND s.is_solution = l.is_solution""")
relation("two_sides", "Questions and solutions.", "SELECT false AS is_solution UNION ALL SELECT true")
relation("number_modes", "Ways of numbering a new item.", "SELECT 'plain' AS mode UNION ALL SELECT 'paired' UNION ALL SELECT 'first' UNION ALL SELECT 'second'")

relation("d_merge_items", "Selected items of a document made one: the first keeps its number and gets all segments.", """
SELECT s.doc_id, m.first AS item, CAST(row_number() OVER (PARTITION BY s.doc_id ORDER BY s.page, s.y0, s.x0, s.item, s.seg) AS BIGINT) AS ord, s.page, s.y0, s.y1, s.x0, s.x1
FROM {segments} s JOIN {selected_items} i ON s.doc_id = i.doc_id AND s.item = i.item JOIN (SELECT doc_id, min(item) AS first FROM {selected_items} GROUP BY doc_id) m ON s.doc_id = m.doc_id""")

relation("c_hit_test", "The topmost segment at each point.", """
SELECT doc_id, page, px, py, item, seg FROM (
  SELECT p.doc_id, p.page, p.px, p.py, s.item, s.seg, row_number() OVER (PARTITION BY p.doc_id, p.page, p.px, p.py ORDER BY s.item DESC, s.seg DESC) AS rn
  FROM {points} p JOIN {segments} s ON s.doc_id = p.doc_id AND s.page = p.page AND p.px BETWEEN s.x0 AND s.x1 AND p.py BETWEEN s.y0 AND s.y1) x WHERE rn = 1""")

relation("c_page_scope", "Segments of items kept by page scope. An item's first page decides its side: on an answers page it is a solution, on a questions page a question; on neither it goes where scope is strict or names both, and keeps its side otherwise. Then segments on the other side's pages go. Documents without a scope stay as they are.", """
WITH scope AS (SELECT doc_id, page, bool_or(answers) AS answers, bool_or(NOT answers) AS questions FROM {page_scope} GROUP BY doc_id, page),
named AS (SELECT doc_id, bool_or(answers) AS has_answers, bool_or(questions) AS has_questions FROM scope GROUP BY doc_id),
start AS (SELECT doc_id, item, min(page) AS page FROM {segments} GROUP BY doc_id, item),
sided AS (
  SELECT t.doc_id, t.item, n.has_answers, n.has_questions, n.doc_id IS NULL AS free, CASE WHEN p.answers THEN true WHEN p.questions THEN false END AS side
  FROM start t LEFT JOIN named n ON t.doc_id = n.doc_id LEFT JOIN scope p ON t.doc_id = p.doc_id AND t.page = p.page
), judged AS (
  SELECT s.doc_id, s.item, s.seg, s.page, coalesce(d.side, s.is_solution) AS is_solution, d.free, d.has_answers, d.has_questions, coalesce(p.answers, false) AS on_answers, coalesce(p.questions, false) AS on_questions
  FROM {segments} s JOIN sided d ON s.doc_id = d.doc_id AND s.item = d.item LEFT JOIN scope p ON s.doc_id = p.doc_id AND s.page = p.page
  WHERE d.free OR d.side IS NOT NULL OR NOT ($(strict_scope) = 1 OR (d.has_answers AND d.has_questions))
)
SELECT doc_id, item, seg, page, is_solution FROM judged
WHERE free OR CASE WHEN is_solution THEN CASE WHEN has_answers THEN on_answers ELSE NOT on_questions END ELSE CASE WHEN has_questions THEN on_questions ELSE NOT on_answers END END""")

relation("c_select_entries", "Requested pages with their names: those a user gave, by place, else by number. A batch is rejected as a whole where names differ in number from pages, or a page was not rendered.", """
WITH asked AS (SELECT batch, pos, page, row_number() OVER (PARTITION BY batch ORDER BY pos) AS rn, count(*) OVER (PARTITION BY batch) AS n FROM {requested_pages}),
named AS (SELECT batch, stem, row_number() OVER (PARTITION BY batch ORDER BY pos) AS rn, count(*) OVER (PARTITION BY batch) AS n FROM {given_stems}),
counted AS (SELECT DISTINCT batch, n FROM named),
found AS (SELECT r.*, p.page IS NULL AS missing, bool_or(p.page IS NULL) OVER (PARTITION BY r.batch) AS some_missing, c.n AS names FROM asked r
  LEFT JOIN (SELECT DISTINCT doc_id, page FROM {paper_pages}) p ON p.doc_id = r.batch AND p.page = r.page LEFT JOIN counted c ON r.batch = c.batch)
SELECT f.batch, f.pos, f.page, CASE WHEN f.names <> f.n THEN 'names differ in number' WHEN f.missing THEN 'missing' WHEN f.some_missing THEN 'in a batch with missing pages' ELSE 'ok' END AS status,
  coalesce(s.stem, concat('page_', lpad(CAST(f.pos AS STRING), 2, '0'))) AS stem
FROM found f LEFT JOIN named s ON f.batch = s.batch AND f.rn = s.rn""")

_LABEL_PAIRS = """
SELECT i.idx AS image, l.idx AS label, i.stem FROM (SELECT idx, regexp_replace(original, r'\\.[^.]*$', '') AS stem FROM {files} WHERE LIKE_RE(original, r'(?i)\\.(jpg|png)$')) i
JOIN (SELECT idx, regexp_replace(original, r'\\.[^.]*$', '') AS stem FROM {files} WHERE NOT LIKE_RE(original, r'(?i)\\.(jpg|png)$')) l ON i.stem = l.stem"""
#: In Spark a stem's pictures are dealt out to 16 parts, each of which meets all label files, so that no task makes all pairs of a stem.
relation("c_label_pairs", "Pictures and label files with the same stem.", _LABEL_PAIRS,
    spark=_LABEL_PAIRS.replace("SELECT i.idx", "SELECT /*+ MERGE(l) */ i.idx").replace("AS stem FROM", "AS stem, pmod(hash(idx), 16) AS part FROM", 1)
    .replace("JOIN (SELECT idx,", "JOIN (SELECT idx, explode(sequence(0, 15)) AS part,").replace("ON i.stem = l.stem", "ON i.stem = l.stem AND i.part = l.part"))

relation("c_span_match", "For each edit the text span it overlaps most.", """
SELECT doc_id, page, edit_id, seq, iou FROM (
  SELECT e.*, l.seq, inter / (area + (l.y1 - l.y0) * (l.x1 - l.x0) - inter) AS iou, row_number() OVER (PARTITION BY e.doc_id, e.page, e.edit_id ORDER BY inter / (area + (l.y1 - l.y0) * (l.x1 - l.x0) - inter) DESC, l.seq) AS rn FROM (
    SELECT b.doc_id, b.page, b.box_id AS edit_id, l.seq AS s, (b.x1 - b.x0) * (b.y1 - b.y0) AS area, (least(b.x1, l.x1) - greatest(b.x0, l.x0)) * (least(b.y1, l.y1) - greatest(b.y0, l.y0)) AS inter
    FROM {boxes} b JOIN {lines_pct} l ON b.doc_id = l.doc_id AND b.page = l.page AND least(b.x1, l.x1) > greatest(b.x0, l.x0) AND least(b.y1, l.y1) > greatest(b.y0, l.y0)) e
  JOIN {lines_pct} l ON l.doc_id = e.doc_id AND l.page = e.page AND l.seq = e.s) x WHERE rn = 1""")

relation("c_pad_clamp", "Room above and below each segment, up to 3 per cent, that reaches no other line of its columns.", """
SELECT s.doc_id, s.item, s.seg, least(3.0, coalesce(min(CASE WHEN l.y1 <= s.y0 THEN s.y0 - l.y1 END), 3.0)) AS pad_top, least(3.0, coalesce(min(CASE WHEN l.y0 >= s.y1 THEN l.y0 - s.y1 END), 3.0)) AS pad_bottom
FROM {segments} s LEFT JOIN {lines_pct} l ON l.doc_id = s.doc_id AND l.page = s.page AND least(l.x1, s.x1) > greatest(l.x0, s.x0) GROUP BY s.doc_id, s.item, s.seg""")

relation("c_option_column_x", "The leftmost option label in each segment, and the indent that lines up a document's options.", r"""
SELECT doc_id, item, seg, x, max(x) OVER (PARTITION BY doc_id, item) - x AS pad FROM (
  SELECT s.doc_id, s.item, s.seg, min(l.x0) AS x FROM {segments} s JOIN {lines_pct} l ON l.doc_id = s.doc_id AND l.page = s.page AND LIKE_RE(l.text, r'^\s*\(?[A-Da-d][.)]')
    AND (l.y0 + l.y1) / 2 BETWEEN s.y0 AND s.y1 AND (l.x0 + l.x1) / 2 BETWEEN s.x0 AND s.x1 GROUP BY s.doc_id, s.item, s.seg) x""")

relation("c_missing_option_hint", "For each option that a question with two or three of them lacks the first line that begins with its letter: on the question's last page or the next, outside its own segments.", r"""
WITH lacking AS (SELECT i.doc_id, i.item, i.last_page, c.letter FROM {item_numbers} i JOIN {option_names} c ON NOT contains(i.option_labels, c.letter) AND NOT i.is_solution AND i.n_options BETWEEN 2 AND 3),
labelled AS (SELECT doc_id, page, seq, y0, y1, x0, x1, upper(regexp_extract(text, r'^\s*\(?\s*([A-Da-d])\s*[.)]', 1)) AS letter FROM {lines_pct})
SELECT doc_id, item, letter, page, seq, y0, y1, x0, x1 FROM (
  SELECT k.doc_id, k.item, k.letter, l.page, l.seq, l.y0, l.y1, l.x0, l.x1, row_number() OVER (PARTITION BY k.doc_id, k.item, k.letter ORDER BY l.page, l.y0, l.x0, l.seq) AS rn
  FROM lacking k JOIN labelled l ON l.doc_id = k.doc_id AND l.letter = k.letter AND l.page BETWEEN k.last_page AND k.last_page + 1
  WHERE NOT EXISTS (SELECT 1 FROM {segments} o WHERE o.doc_id = k.doc_id AND o.item = k.item AND o.page = l.page AND l.y0 < o.y1 AND l.y1 > o.y0 AND l.x0 < o.x1 AND l.x1 > o.x0)) x WHERE rn = 1""")
relation("option_names", "The options a question has.", "SELECT 'A' AS letter UNION ALL SELECT 'B' UNION ALL SELECT 'C' UNION ALL SELECT 'D'")

relation("c_redact_rects", "Furniture of every kind within each segment as whole pixels of its picture: padded by 2 points, moved to the segment's corner, zoomed and clipped; what has no pixel left goes.", f"""
WITH clips AS (SELECT doc_id, item, seg, page, x0 / 100.0 * {W} AS left_pt, y0 / 100.0 * {H} AS top_pt, BROUND((x1 - x0) / 100.0 * {W} * $(zoom), 0) AS w, BROUND((y1 - y0) / 100.0 * {H} * $(zoom), 0) AS h, x0, x1, y0, y1 FROM {{segments}}),
painted AS (
  SELECT s.doc_id, s.item, s.seg, f.kind, greatest(0, least(s.w, floor((f.x0 - $(paint_pad) - s.left_pt) * $(zoom)))) AS px0, greatest(0, least(s.w, floor((f.x1 + $(paint_pad) - s.left_pt) * $(zoom)))) AS px1,
    greatest(0, least(s.h, floor((f.y0 - $(paint_pad) - s.top_pt) * $(zoom)))) AS py0, greatest(0, least(s.h, floor((f.y1 + $(paint_pad) - s.top_pt) * $(zoom)))) AS py1
  FROM clips s JOIN {{c_furniture_rects}} f ON f.doc_id = s.doc_id AND f.page = s.page
)
SELECT doc_id, item, seg, kind, CAST(px0 AS BIGINT) AS px0, CAST(py0 AS BIGINT) AS py0, CAST(px1 AS BIGINT) AS px1, CAST(py1 AS BIGINT) AS py1 FROM painted WHERE px1 > px0 AND py1 > py0""")

relation("c_line_fallback", "Text-layer lines, and OCR lines on pages that have none.", """
SELECT doc_id, page, seq, 'text' AS origin FROM {text_lines}
UNION ALL SELECT o.doc_id, o.page, o.seq, 'ocr' FROM {ocr_lines} o WHERE NOT EXISTS (SELECT 1 FROM {text_lines} t WHERE t.doc_id = o.doc_id AND t.page = o.page)""")

SETTINGS |= {"language_mode": "separate", "first_question": "EQ", "first_solution": "ES", "second_question": "HQ", "second_solution": "HS"}
relation("language_places", "Items as candidates of their number: where they begin, whether they hold both languages, and their place among the number's items (page; left to right where they stand side by side, else top to bottom).", """
WITH one AS (
  SELECT i.doc_id, i.item, i.is_solution, i.q_num, i.is_hindi, s.page, s.x0, s.y0, (s.x0 + s.x1) / 2 AS mid, EXISTS (SELECT 1 FROM {other_segments} o WHERE o.doc_id = i.doc_id AND o.item = i.item) AS holds_both,
    count(*) OVER (PARTITION BY i.doc_id, i.is_solution, i.q_num) AS n, count_if(i.is_hindi) OVER (PARTITION BY i.doc_id, i.is_solution, i.q_num) AS n_second, count_if(NOT i.is_hindi) OVER (PARTITION BY i.doc_id, i.is_solution, i.q_num) AS n_first
  FROM {items} i LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item ORDER BY seg) AS rn FROM {segments}) x WHERE rn = 1) s ON i.doc_id = s.doc_id AND i.item = s.item
), before AS (
  SELECT a.doc_id, a.item, count(*) AS k FROM one a JOIN one b ON a.doc_id = b.doc_id AND a.is_solution = b.is_solution AND a.q_num = b.q_num AND a.item <> b.item AND (b.page < a.page OR (b.page = a.page
    AND CASE WHEN abs(a.x0 - b.x0) > 15 OR abs(a.mid - b.mid) > 15 THEN b.x0 < a.x0 OR (b.x0 = a.x0 AND b.item < a.item) ELSE b.y0 < a.y0 OR (b.y0 = a.y0 AND b.item < a.item) END)) GROUP BY a.doc_id, a.item
)
SELECT o.*, row_number() OVER (PARTITION BY o.doc_id, o.is_solution, o.q_num ORDER BY coalesce(b.k, 0), o.item) AS place FROM one o LEFT JOIN before b ON o.doc_id = b.doc_id AND o.item = b.item""")

relation("language_pairs", "For each number its item of the first and of the second language (one item may hold both), or its only item.", """
SELECT doc_id, is_solution, q_num, max(n) AS n,
  CASE WHEN max(n) = 1 THEN min(item) WHEN max(n_first) = 1 AND max(n_second) = 1 THEN min(CASE WHEN NOT is_hindi THEN item END) ELSE min(CASE WHEN place = 1 THEN item END) END AS first_item,
  CASE WHEN max(n) = 1 THEN CASE WHEN bool_or(holds_both) THEN min(item) END WHEN max(n_first) = 1 AND max(n_second) = 1 THEN min(CASE WHEN is_hindi THEN item END) ELSE min(CASE WHEN place = 2 THEN item END) END AS second_item,
  bool_or(holds_both) AND max(n) = 1 AS holds_both, CASE WHEN max(n) = 1 THEN bool_or(is_hindi) END AS marked, CASE WHEN max(n) = 1 THEN bool_or(x0 > 50) END AS on_right
FROM {language_places} GROUP BY doc_id, is_solution, q_num""")

relation("d_language_partition", "What each number gives in a mode: first or second (that language's item), separate (two outputs), horizontal or vertical (one output of both). An unpaired item is of the language it is marked with, else of the mode's, else of the page's half it begins in.", """
WITH outputs AS (
  SELECT p.*, m.lang FROM {language_pairs} p JOIN {languages} m ON p.second_item IS NOT NULL AND (m.lang = $(language_mode) OR ($(language_mode) = 'separate' AND m.lang <> 'both') OR ($(language_mode) IN ('horizontal', 'vertical') AND m.lang = 'both'))
  UNION ALL
  SELECT p.*, CASE WHEN marked IS NOT NULL THEN CASE WHEN marked THEN 'second' ELSE 'first' END WHEN $(language_mode) IN ('first', 'second') THEN $(language_mode) WHEN on_right THEN 'second' ELSE 'first' END FROM {language_pairs} p WHERE p.second_item IS NULL
)
SELECT doc_id, is_solution, q_num, lang, CASE WHEN lang = 'second' THEN coalesce(second_item, first_item) ELSE first_item END AS item, CASE WHEN lang = 'both' THEN second_item END AS beside, holds_both AND lang <> 'first' AS uses_other_segments,
  concat(CASE WHEN lang = 'second' THEN CASE WHEN is_solution THEN $(second_solution) ELSE $(second_question) END ELSE CASE WHEN is_solution THEN $(first_solution) ELSE $(first_question) END END, q_num) AS name
FROM outputs""")
relation("languages", "A number's outputs: in either language or both.", "SELECT 'first' AS lang UNION ALL SELECT 'second' UNION ALL SELECT 'both'")

relation("d_queue_status", "Files in a queue counted by status, each path once.", """
SELECT batch, status, count(*) AS n FROM (SELECT DISTINCT batch, original, status FROM {queue}) x GROUP BY batch, status""")

#: Spark folds a page's lines in one row, so a box is moved and sorted once and never grouped.
relation("d_snap_boxes", "Boxes drawn in to the lines they hold: right, top and bottom, never the left; boxes without lines stay.", """
SELECT b.doc_id, b.page, b.box_id, b.x0, least(b.x1, coalesce(max(l.x1) + 0.8, b.x1)) AS x1, greatest(b.y0, coalesce(min(l.y0) - 0.8, b.y0)) AS y0, least(b.y1, coalesce(max(l.y1) + 0.8, b.y1)) AS y1
FROM {boxes} b LEFT JOIN {lines_pct} l ON l.doc_id = b.doc_id AND l.page = b.page AND l.y1 > b.y0 AND l.y0 < b.y1 AND l.x1 > b.x0 AND l.x0 < b.x1 GROUP BY b.doc_id, b.page, b.box_id, b.x0, b.x1, b.y0, b.y1""",
    spark="""
SELECT doc_id, page, box_id, x0, least(x1, coalesce(array_max(transform(held, l -> l.x1)) + 0.8, x1)) AS x1, greatest(y0, coalesce(array_min(transform(held, l -> l.y0)) - 0.8, y0)) AS y0, least(y1, coalesce(array_max(transform(held, l -> l.y1)) + 0.8, y1)) AS y1
FROM (SELECT /*+ MERGE(p) */ b.doc_id, b.page, b.box_id, b.x0, b.x1, b.y0, b.y1, filter(p.ls, l -> l.y1 > b.y0 AND l.y0 < b.y1 AND l.x1 > b.x0 AND l.x0 < b.x1) AS held FROM {boxes} b LEFT JOIN (
  SELECT doc_id, page, collect_list(named_struct('x0', x0, 'x1', x1, 'y0', y0, 'y1', y1)) AS ls FROM {lines_pct} GROUP BY doc_id, page) p ON p.doc_id = b.doc_id AND p.page = b.page) x""")  # fmt: skip

# Limits of alignment, in the page's units or per cent of it.
SETTINGS |= {"align_edge": 5.0, "align_gap": 15.0, "align_half": 0.45, "align_margin": 0.10, "align_most": 15.0, "align_least_most": 10.0}
relation("page_margins", "The usual left margin of each half of a page: the middle of its largest cluster of lines' left edges, those at the paper's edge left out; a tenth of the page where the left half has none.", """
WITH edges AS (SELECT doc_id, page, x_left AS x, seq FROM {page_lines} WHERE trim(text) <> '' AND x_left >= $(align_edge) AND x_right <= $(page_width) - $(align_edge)),
clusters AS (SELECT doc_id, page, g, count(*) AS n, median(x) AS mid FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, page ORDER BY x, seq) AS g FROM (
  SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY doc_id, page ORDER BY x, seq) > $(align_gap) THEN 1 ELSE 0 END AS fresh FROM edges) a) b GROUP BY doc_id, page, g),
best AS (SELECT doc_id, page, half, mid FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page, half ORDER BY n DESC, mid) AS rn FROM (SELECT *, CASE WHEN mid < $(align_half) * $(page_width) THEN 0 ELSE 1 END AS half FROM clusters) c) d WHERE rn = 1)
SELECT doc_id, page, half, mid FROM best
UNION ALL SELECT p.doc_id, p.page, 0, CAST($(align_margin) * $(page_width) AS DOUBLE) FROM (SELECT DISTINCT doc_id, page FROM {segments}) p WHERE NOT EXISTS (SELECT 1 FROM best b WHERE b.doc_id = p.doc_id AND b.page = p.page AND b.half = 0)""")

_STEPS = """
WITH own AS (
  SELECT doc_id, item, seg, x0, mid FROM (SELECT s.doc_id, s.item, s.seg, s.x0, m.mid / $(page_width) * 100 AS mid, row_number() OVER (PARTITION BY s.doc_id, s.item, s.seg ORDER BY abs(m.mid - s.x0 / 100 * $(page_width)), m.half) AS rn
    FROM {{segments}} s JOIN {{page_margins}} m ON s.doc_id = m.doc_id AND s.page = m.page) x WHERE rn = 1
), head AS (SELECT doc_id, item, x0, mid FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item ORDER BY seg) AS rn FROM own) x WHERE rn = 1
), unread AS (SELECT s.doc_id, s.item, {rows} AS rows FROM {{segments}} s WHERE NOT EXISTS (SELECT 1 FROM {{read_documents}} r WHERE r.doc_id = s.doc_id) GROUP BY s.doc_id, s.item
)
SELECT o.doc_id, o.item, o.seg, BROUND(greatest(-$(align_most), least($(align_most), (o.x0 - o.mid) - (h.x0 - h.mid))), 2) AS dx, 'margins' AS rule
FROM own o JOIN head h ON o.doc_id = h.doc_id AND o.item = h.item JOIN {{read_documents}} r ON o.doc_id = r.doc_id
UNION ALL """
relation("d_align_offsets", "For each segment the shift, in per cent and at most 15, that puts it as far from its page's usual margin as the item's first one is from its own. Of documents whose lines are unknown: the distance to the first segment, at most 10; one over 15 away stands in another column, and those after it are measured from it.", "",
    spark=_STEPS.format(rows="array_sort(collect_list(struct(s.seg, s.x0)))") + """
SELECT doc_id, item, f.seg, f.dx, 'segments' FROM (SELECT doc_id, item, explode(aggregate(rows, array(named_struct('seg', CAST(NULL AS INT), 'base', rows[0].x0, 'dx', 0.0E0)), (done, r) ->
  array_append(done, named_struct('seg', r.seg, 'base', CASE WHEN abs(r.x0 - element_at(done, -1).base) > $(align_most) THEN r.x0 ELSE element_at(done, -1).base END,
    'dx', CASE WHEN abs(r.x0 - element_at(done, -1).base) > $(align_most) THEN 0.0E0 ELSE greatest(-$(align_least_most), least($(align_least_most), r.x0 - element_at(done, -1).base)) END)))) AS f FROM unread) x WHERE f.seg IS NOT NULL""",
    other=_STEPS.format(rows="list(struct_pack(seg := s.seg, x0 := s.x0) ORDER BY s.seg)") + """
SELECT doc_id, item, f.seg, f.dx, 'segments' FROM (SELECT doc_id, item, unnest(list_reduce(list_concat([[struct_pack(seg := CAST(NULL AS INT), base := rows[1].x0, dx := CAST(0 AS DOUBLE))]], list_transform(rows, lambda r: [struct_pack(seg := r.seg, base := r.x0, dx := CAST(0 AS DOUBLE))])), lambda done, r:
  list_append(done, struct_pack(seg := r[1].seg, base := CASE WHEN abs(r[1].base - done[-1].base) > $(align_most) THEN r[1].base ELSE done[-1].base END,
    dx := CASE WHEN abs(r[1].base - done[-1].base) > $(align_most) THEN CAST(0 AS DOUBLE) ELSE CAST(greatest(-$(align_least_most), least($(align_least_most), r[1].base - done[-1].base)) AS DOUBLE) END)))) AS f FROM unread) x WHERE f.seg IS NOT NULL""")  # fmt: skip
relation("read_documents", "Documents whose lines are known.", "SELECT DISTINCT doc_id FROM {page_lines}")
