"""Answer keys, page classes, fonts, sizes and other facts of a document."""

from ..functions import fixed as fx
from ..relations import SETTINGS, SHARED, relation

SHARED |= {"key_text_pairs", "solution_lines", "words"}

_KEY_LINES = """
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, y_top, x_left, seq) AS BIGINT) AS seq, text FROM {e_section_state}"""
#: Spark numbers only lines that hold a pair; their order is the same.
relation("key_lines", "A document's lines in order, as the text an answer key is looked for in.", _KEY_LINES, spark=_KEY_LINES + f" WHERE regexp_like(text, r'{fx.KEY_PAIR}')")

#: Separators are doubled for an engine without look-ahead, so that one serves as the end of a pair and the start of the next;
#: a pair takes as few of them as it can, or a run of them would leave the next pair none.
_TWICE = r"regexp_replace(text, '([\s,;|])', '\1\1', 'g')"
_PAIR = fx.KEY_PAIR.replace(r"\s*\)?(?=$|", r"\s*?\)?(?:$|")
relation("key_text_pairs", "Number and letter pairs of key texts, in order.", "",
    spark=f"""
SELECT doc_id, seq, CAST(pos AS BIGINT) AS pos, CAST(p['0'] AS INT) AS num, upper(p['1']) AS letter FROM {{key_lines}}
LATERAL VIEW posexplode(arrays_zip(regexp_extract_all(text, r'{fx.KEY_PAIR}', 1), regexp_extract_all(text, r'{fx.KEY_PAIR}', 2))) t AS pos, p""",
    other=f"""
SELECT doc_id, seq, pos, CAST(a[pos + 1] AS INT) AS num, upper(b[pos + 1]) AS letter FROM (
  SELECT *, unnest(range(len(a))) AS pos FROM (SELECT doc_id, seq, regexp_extract_all({_TWICE}, r'{_PAIR}', 1) AS a, regexp_extract_all({_TWICE}, r'{_PAIR}', 2) AS b FROM {{key_lines}}) x) y""")  # fmt: skip

relation("d_answer_key", "Number and letter pairs of a key text, if there are four or more and they cover 70 per cent of their run; the first of a number wins.", """
WITH first AS (SELECT doc_id, num, letter FROM (
  SELECT doc_id, num, letter, row_number() OVER (PARTITION BY doc_id, num ORDER BY seq, pos) AS rn FROM {key_text_pairs} WHERE num BETWEEN 1 AND 999) x WHERE rn = 1)
SELECT doc_id, num, letter FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, max(num) OVER (PARTITION BY doc_id) AS hi, min(num) OVER (PARTITION BY doc_id) AS lo FROM first) x
WHERE n >= 4 AND n / (hi - lo + 1) >= 0.7""")

#: A block runs from one opener to the next; its lines are joined, since a label and its letter may stand on two of them.
_BLOCKS = rf"""
WITH opened AS (
  SELECT doc_id, seq, text, coalesce(TRY_CAST(regexp_extract(text, r'{fx.SOLUTION_OPENER}', 1) AS INT), TRY_CAST(regexp_extract(text, r'{fx.SOLUTION_OPENER}', 2) AS INT)) AS num FROM {{solution_lines}}
), numbered AS (
  SELECT *, sum(CASE WHEN num IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY seq) AS block FROM opened
), blocks AS (
  SELECT doc_id, block, max(num) AS num, @ AS text FROM numbered WHERE block > 0 GROUP BY doc_id, block
), first AS (SELECT doc_id, num, letter FROM (
  SELECT doc_id, num, letter, row_number() OVER (PARTITION BY doc_id, num ORDER BY block) AS rn FROM (
    SELECT doc_id, block, num, upper(regexp_extract(text, r'{fx.LABELLED_ANSWER}', 1)) AS letter FROM blocks WHERE num BETWEEN 1 AND 999) x WHERE letter <> '') y WHERE rn = 1)
SELECT doc_id, num, letter FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM first) x WHERE n >= 2"""
relation("d_solution_answers", "Answers named within numbered solutions, label and letter on one line or several; documents with two or more.", "",
    spark=_BLOCKS.replace("@", "array_join(transform(array_sort(collect_list(struct(seq, text))), x -> x.text), '\\n')"), other=_BLOCKS.replace("@", "string_agg(text, chr(10) ORDER BY seq)"))

relation("d_resolve_key", "Each document's key from the first source that has one: grid, prose, model.", """
WITH s AS (
  SELECT doc_id, num, letter, 1 AS prio FROM {d_answer_key} UNION ALL SELECT doc_id, num, letter, 2 FROM {d_solution_answers} UNION ALL SELECT doc_id, num, letter, 3 FROM {model_key})
SELECT doc_id, num, letter, CASE prio WHEN 1 THEN 'grid' WHEN 2 THEN 'prose' ELSE 'model' END AS source FROM (SELECT *, min(prio) OVER (PARTITION BY doc_id) AS best FROM s) x WHERE prio = best""")

relation("d_ocr_confidence", "Mean confidence of each page's words; blanks and negative values do not count.", """
SELECT p.doc_id, p.page, coalesce(w.conf, 0.0) AS conf FROM {paper_pages} p LEFT JOIN (SELECT doc_id, page, avg(conf) AS conf FROM {words} WHERE conf >= 0 AND trim(word) <> '' GROUP BY doc_id, page) w ON p.doc_id = w.doc_id AND p.page = w.page""")

relation("d_weak_pages", "Pages whose confidence is above 0 and below a threshold.", "SELECT doc_id, page, conf FROM {d_ocr_confidence} WHERE conf > 0 AND conf < $(ocr_confidence)")

relation("d_page_class", "Pages by source of text (text, OCR, or text then OCR), and whether the document can be searched.", """
WITH c AS (
  SELECT g.doc_id, g.page, coalesce(t.chars, 0) AS chars, coalesce(i.large, 0) AS large FROM {page_geom} g
  LEFT JOIN (SELECT doc_id, page, sum(length(text)) AS chars FROM {lines} GROUP BY doc_id, page) t ON g.doc_id = t.doc_id AND g.page = t.page
  LEFT JOIN (SELECT i.doc_id, i.page, count(*) AS large FROM {page_images} i JOIN {page_geom} p ON i.doc_id = p.doc_id AND i.page = p.page WHERE i.w_pt * i.h_pt > 0.05 * p.width * p.height OR i.w_pt > 0.3 * p.width GROUP BY i.doc_id, i.page) i ON g.doc_id = i.doc_id AND g.page = i.page)
SELECT doc_id, page, class, avg(CASE WHEN class = 'ocr' THEN 0.0 ELSE 1.0 END) OVER (PARTITION BY doc_id) >= 0.5 AS searchable FROM (
  SELECT doc_id, page, CASE WHEN chars > 50 AND large = 0 THEN 'text' WHEN large >= 1 AND chars < 10 THEN 'ocr' ELSE 'text_then_ocr' END AS class FROM c) x""")

relation("d_font_audit", "Each font of a document once, with whether it is embedded and a subset.", """
SELECT doc_id, xref, basefont, min(page) AS first_page, bool_or(ext <> 'n/a') AS embedded, contains(basefont, '+') AS subset FROM {fonts} GROUP BY doc_id, xref, basefont""")

# Resolutions of print, characters of a text layer, its first pages, and sizes in points (portrait).
SETTINGS |= {"critical_dpi": 72, "low_dpi": 150, "text_layer": 50, "text_pages": 5, "target": "auto", "fill": "fit", "size_play": 1.0, "target_bytes": 20000}
SIZES = {"a3": (841.89, 1190.55), "a4": (595.28, 841.89), "a5": (419.53, 595.28), "letter": (612.0, 792.0), "legal": (612.0, 1008.0), "square": (612.0, 612.0), "pptx": (960.0, 540.0)}
TURNED = ("a3", "a4", "a5", "letter", "legal")

relation("d_preflight", "Six checks of each document (encryption, fonts, resolution, colours, page sizes, text layer) as ok, info, warn or fail, and their verdict, the worst of them.", """
WITH docs AS (SELECT doc_id, count(DISTINCT concat(CAST(BROUND(width, 0) AS STRING), 'x', CAST(BROUND(height, 0) AS STRING))) AS sizes FROM {page_geom} GROUP BY doc_id),
f AS (SELECT doc_id, count_if(NOT embedded) AS missing FROM {d_font_audit} GROUP BY doc_id),
i AS (SELECT doc_id, count_if(dpi > 0 AND dpi < $(critical_dpi)) AS critical, count_if(dpi >= $(critical_dpi) AND dpi < $(low_dpi)) AS low FROM {b_image_dpi} GROUP BY doc_id),
k AS (SELECT doc_id, count_if(contains(lower(colorspace), 'rgb')) AS rgb FROM {page_images} GROUP BY doc_id),
t AS (SELECT doc_id, sum(length(trim(text))) AS chars FROM {lines} WHERE page <= $(text_pages) GROUP BY doc_id),
c AS (
  SELECT d.doc_id, 'encryption' AS chk, CASE WHEN e.doc_id IS NOT NULL THEN 'fail' ELSE 'ok' END AS status FROM docs d LEFT JOIN (SELECT DISTINCT doc_id FROM {encrypted_documents}) e ON d.doc_id = e.doc_id
  UNION ALL SELECT d.doc_id, 'fonts_embedded', CASE WHEN f.doc_id IS NULL THEN 'info' WHEN f.missing > 0 THEN 'fail' ELSE 'ok' END FROM docs d LEFT JOIN f ON d.doc_id = f.doc_id
  UNION ALL SELECT d.doc_id, 'image_dpi', CASE WHEN i.doc_id IS NULL THEN 'info' WHEN i.critical > 0 THEN 'fail' WHEN i.low > 0 THEN 'warn' ELSE 'ok' END FROM docs d LEFT JOIN i ON d.doc_id = i.doc_id
  UNION ALL SELECT d.doc_id, 'colorspace', CASE WHEN coalesce(k.rgb, 0) > 0 THEN 'warn' ELSE 'ok' END FROM docs d LEFT JOIN k ON d.doc_id = k.doc_id
  UNION ALL SELECT doc_id, 'page_sizes', CASE WHEN sizes > 1 THEN 'warn' ELSE 'ok' END FROM docs
  UNION ALL SELECT d.doc_id, 'text_layer', CASE WHEN coalesce(t.chars, 0) > $(text_layer) THEN 'ok' ELSE 'info' END FROM docs d LEFT JOIN t ON d.doc_id = t.doc_id
)
SELECT doc_id, chk, status, CASE max(CASE status WHEN 'fail' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) WHEN 0 THEN 'pass' WHEN 1 THEN 'warn' ELSE 'fail' END AS verdict FROM c""")

_CUSTOM = [f"TRY_CAST(regexp_extract(lower(trim($(target))), r'^custom:\\s*([0-9.]+)\\s*x\\s*([0-9.]+)\\s*$', {i}) AS DOUBLE) * 72.0 / 25.4" for i in (1, 2)]
_NAMES = " UNION ALL ".join(f"SELECT '{n}' AS name, {w} AS w, {h} AS h, {str(n in TURNED).lower()} AS turned" for n, (w, h) in SIZES.items())
relation("named_sizes", "Named sizes in points, and whether they are turned to a document's usual orientation.", f"SELECT name, CAST(w AS DOUBLE) AS w, CAST(h AS DOUBLE) AS h, turned FROM ({_NAMES}) x")
relation("d_target_size", "The size a document's pages are to have. auto: the one most pages have, of equals the larger, as its first page has it; max: the largest page's; a name: that size, turned if over half of the pages are landscape; custom:WxH in millimetres. What is none of these counts as auto.", f"""
WITH pages AS (SELECT *, BROUND(width, 0) AS rw, BROUND(height, 0) AS rh FROM {{page_geom}}),
most AS (SELECT doc_id, rw, rh FROM (SELECT doc_id, rw, rh, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, rw * rh DESC, min(page)) AS rn FROM pages GROUP BY doc_id, rw, rh) x WHERE rn = 1),
usual AS (SELECT doc_id, width AS w, height AS h FROM (SELECT p.doc_id, p.width, p.height, row_number() OVER (PARTITION BY p.doc_id ORDER BY p.page) AS rn FROM pages p JOIN most m ON p.doc_id = m.doc_id AND p.rw = m.rw AND p.rh = m.rh) x WHERE rn = 1),
largest AS (SELECT doc_id, width AS w, height AS h, row_number() OVER (PARTITION BY doc_id ORDER BY width * height DESC, page) AS rn FROM pages),
votes AS (SELECT doc_id, count_if(width > height) > count(*) / 2.0 AS landscape FROM pages GROUP BY doc_id),
custom AS (SELECT {_CUSTOM[0]} AS w, {_CUSTOM[1]} AS h)
SELECT u.doc_id, CASE WHEN lower(trim($(target))) = 'max' THEN l.w WHEN n.name IS NOT NULL THEN CASE WHEN n.turned AND v.landscape THEN n.h ELSE n.w END WHEN c.w > 0 AND c.h > 0 THEN c.w ELSE u.w END AS w,
  CASE WHEN lower(trim($(target))) = 'max' THEN l.h WHEN n.name IS NOT NULL THEN CASE WHEN n.turned AND v.landscape THEN n.w ELSE n.h END WHEN c.w > 0 AND c.h > 0 THEN c.h ELSE u.h END AS h
FROM usual u JOIN largest l ON u.doc_id = l.doc_id AND l.rn = 1 JOIN votes v ON u.doc_id = v.doc_id LEFT JOIN {{named_sizes}} n ON n.name = lower(trim($(target))) LEFT JOIN custom c ON u.doc_id IS NOT NULL""")

relation("d_normalize_plan", "How each page is placed on the target size: left as it is if it is excluded or within a point; else scaled to fit and centred, or stretched to fill.", """
SELECT doc_id, page, changed, CASE WHEN changed THEN kx ELSE 1.0 END AS scale_x, CASE WHEN changed THEN ky ELSE 1.0 END AS scale_y, CASE WHEN changed THEN (w - width * kx) / 2 ELSE 0.0 END AS dx, CASE WHEN changed THEN (h - height * ky) / 2 ELSE 0.0 END AS dy FROM (
  SELECT *, CASE WHEN $(fill) = 'stretch' THEN w / width ELSE least(w / width, h / height) END AS kx, CASE WHEN $(fill) = 'stretch' THEN h / height ELSE least(w / width, h / height) END AS ky FROM (
    SELECT g.doc_id, g.page, g.width, g.height, t.w, t.h, (abs(g.width - t.w) > $(size_play) OR abs(g.height - t.h) > $(size_play)) AND s.page IS NULL AS changed FROM {page_geom} g JOIN {d_target_size} t ON g.doc_id = t.doc_id
    LEFT JOIN (SELECT DISTINCT doc_id, page FROM {kept_pages}) s ON g.doc_id = s.doc_id AND g.page = s.page) x) y""")

relation("d_pick_variant", "The gentlest variant of a file that fits a target, else the smallest, never over the original.", """
SELECT batch, idx, CASE WHEN size >= original_bytes THEN -1 ELSE level END AS level, least(size, original_bytes) AS size, 1 - least(size, original_bytes) / CAST(original_bytes AS DOUBLE) AS saved FROM (
  SELECT *, row_number() OVER (PARTITION BY batch, idx ORDER BY CASE WHEN size <= $(target_bytes) THEN level ELSE 100 END, size, level) AS rn FROM {variants}) x WHERE rn = 1""")

SETTINGS |= {"sheet_wanted": 1, "ask_model": 0, "some_text": 100}
relation("d_key_diagnosis", "Why a document has a key or not: sheets are off; the text gave one; it is a scan, which a model reads if one may be asked; or its text has no key. A model's answers count only where it was asked and the text gave none.", """
WITH found AS (
  SELECT p.doc_id, coalesce(t.chars, 0) > $(some_text) AS has_text, coalesce(k.n, 0) AS n, $(ask_model) = 1 AND $(model_ready) = 1 AND coalesce(k.n, 0) = 0 AS asked, coalesce(m.n, 0) AS read
  FROM (SELECT DISTINCT doc_id FROM {paper_pages}) p
  LEFT JOIN (SELECT doc_id, sum(chars) AS chars FROM (SELECT doc_id, page, sum(length(trim(text))) AS chars FROM {lines} WHERE page <= $(text_pages) GROUP BY doc_id, page) x GROUP BY doc_id) t ON p.doc_id = t.doc_id
  LEFT JOIN (SELECT doc_id, count(*) AS n FROM {document_keys} GROUP BY doc_id) k ON p.doc_id = k.doc_id LEFT JOIN (SELECT doc_id, count(*) AS n FROM {model_key} GROUP BY doc_id) m ON p.doc_id = m.doc_id
)
SELECT doc_id, has_text, n, asked, CASE WHEN asked THEN read ELSE 0 END AS n_model,
  CASE WHEN $(sheet_wanted) = 0 THEN 'sheets are off' WHEN n > 0 THEN 'found' WHEN NOT has_text AND $(ask_model) = 1 AND $(model_ready) = 1 THEN 'a scan, left to the model' WHEN NOT has_text THEN 'a scan, and no model' ELSE 'text without a key' END AS verdict
FROM found""")