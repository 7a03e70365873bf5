"""Detection in tiers: the cheap ones first, each later one only for documents and pages whose items did not pass a gate.

The order is text layer, OCR, local model, repair of weak pages, page model. Each tier's items are a table of segments
(`tier_text`, `tier_ocr`, `tier_local`, `tier_model`); a scope names the documents it is read for, found by anti joins with
the documents accepted before. `detected` runs detectors scope by scope, so that a costly one never sees other pages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..relations import SETTINGS, SHARED, frame, relation
from .reviewing import NUMBER

SHARED |= {"tier_pages", "searchable_documents", "d_gates", "preferred", "text_scope", "ocr_scope", "local_scope", "repair_scope", "model_scope", "c_page_router", "c_repair_pages", "accepted_early"}

# Items a page that suffice, the density and share of a run that can be trusted, the confidence of a weak page.
SETTINGS |= {"enough_items": 0.5, "trusted_items": 0.75, "trusted_run": 0.8, "least_numbers": 3, "ocr_confidence": 75.0}
#: 1 or 0: whether cheap results must be trusted before a model may be skipped; whether a model and a local one can be
#: asked; whether the model comes first.
SETTINGS |= {"smart": 1, "model_ready": 1, "local_ready": 1, "prefer_model": 0}

TIERS = ("text", "ocr", "local", "model")
_COUNTED = """
SELECT t.doc_id, '{tier}' AS tier, count(*) AS items, count(num) AS numbers, count(DISTINCT num) AS distinct_numbers, min(num) AS lo, max(num) AS hi FROM (
  SELECT DISTINCT doc_id, item, CASE WHEN is_solution THEN NULL ELSE {number} END AS num FROM {source}) t GROUP BY t.doc_id"""


def _counted(tier: str, source: str) -> str:
    return _COUNTED.format(tier=tier, source=source, number=NUMBER.format(q="q_num"))


_GATED = """
SELECT c.doc_id, c.tier, c.items, p.pages, CAST(c.items AS DOUBLE) / p.pages >= $(enough_items) AS sufficient,
  CAST(c.items AS DOUBLE) / p.pages >= greatest($(enough_items), $(trusted_items)) AND (c.numbers < $(least_numbers) OR c.distinct_numbers / CAST(c.hi - c.lo + 1 AS DOUBLE) >= $(trusted_run)) AS confident
FROM ({counted}) c JOIN {{searchable_documents}} p ON c.doc_id = p.doc_id"""
_SOURCES = {t: "{" + f"scoped_{t}" + "}" for t in TIERS}
relation("d_gates", "For each document and tier it was read by, whether its items suffice, and whether they can be trusted: dense enough and numbered in a run without large holes.",
    _GATED.format(counted=" UNION ALL ".join(_counted(t, s) for t, s in _SOURCES.items() if t != "model")))

relation("searchable_documents", "Pages of each document, and whether at least half of them have a text layer.", """
SELECT doc_id, count(*) AS pages, avg(CASE WHEN class = 'ocr' THEN 0.0E0 ELSE 1.0E0 END) >= 0.5 AS searchable FROM {tier_pages} GROUP BY doc_id""")

relation("preferred", "Documents that a model asked first has answered for.", """
SELECT DISTINCT doc_id FROM {tier_model} WHERE $(prefer_model) = 1 AND $(model_ready) = 1""")

#: Whether a document's gate is the strict one, and whether its model can still be asked: not if it came first, in vain.
_STRICT = "$(smart) = 1 AND $(model_ready) = 1 AND $(prefer_model) = 0"
_MODEL = "$(model_ready) = 1 AND $(prefer_model) = 0"
_PASSED = "(SELECT doc_id FROM ({gated}) g WHERE CASE WHEN " + _STRICT + " THEN confident ELSE sufficient END)"


def _passed(tier: str) -> str:
    return _PASSED.format(gated=_GATED.format(counted=_counted(tier, _SOURCES[tier])))


def _without(source: str, others: str) -> str:
    return f"SELECT s.doc_id FROM {source} s WHERE NOT EXISTS (SELECT 1 FROM {others} o WHERE o.doc_id = s.doc_id)"


relation("text_scope", "Documents whose text layer is read: those that can be searched.", _without("{searchable_documents}", "{preferred}") + " AND s.searchable")
relation("ocr_scope", "Documents that OCR reads whole: those whose text tier was not accepted.", f"""
SELECT s.doc_id FROM {{searchable_documents}} s WHERE NOT EXISTS (SELECT 1 FROM {{preferred}} o WHERE o.doc_id = s.doc_id) AND NOT EXISTS (SELECT 1 FROM {_passed("text")} o WHERE o.doc_id = s.doc_id)""")
relation("local_scope", "Documents that a local model reads: those whose OCR was not accepted.", _without("{ocr_scope}", _passed("ocr")) + " AND $(local_ready) = 1")
for _t in ("text", "ocr", "local"):
    relation(f"scoped_{_t}", f"Segments of the tier {_t} for the documents in its scope.", f"SELECT s.* FROM {{tier_{_t}}} s JOIN {{{_t}_scope}} d ON s.doc_id = d.doc_id")

relation("accepted_early", "Documents accepted before a repair, with their tier: text and OCR by their gates, the local model if it suffices or finds no less than the others where no other model can be asked.", f"""
WITH n AS (SELECT doc_id, max(CASE WHEN tier = 'local' THEN items END) AS own, max(CASE WHEN tier <> 'local' THEN items END) AS others FROM {{d_gates}} GROUP BY doc_id)
SELECT doc_id, 'ai' AS method FROM {{preferred}}
UNION ALL SELECT doc_id, CASE tier WHEN 'text' THEN 'text' ELSE 'ocr' END FROM {{d_gates}} WHERE tier <> 'local' AND CASE WHEN {_STRICT} THEN confident ELSE sufficient END
UNION ALL SELECT g.doc_id, 'local_ml' FROM {{d_gates}} g JOIN n ON g.doc_id = n.doc_id WHERE g.tier = 'local' AND (g.sufficient OR (NOT ({_MODEL}) AND n.own >= coalesce(n.others, 0)))""")

relation("weak_pages", "Pages that OCR read with little confidence.", "SELECT doc_id, page FROM {tier_pages} WHERE conf > 0 AND conf < $(ocr_confidence)")
relation("repair_scope", "Documents of which only weak pages are read again: OCR found items, and some pages are weak but not all.", f"""
SELECT s.doc_id FROM {{ocr_scope}} s JOIN {{searchable_documents}} p ON s.doc_id = p.doc_id JOIN (SELECT doc_id, count(*) AS n FROM {{weak_pages}} GROUP BY doc_id) w ON s.doc_id = w.doc_id AND w.n < p.pages
WHERE {_STRICT} AND NOT EXISTS (SELECT 1 FROM {{accepted_early}} a WHERE a.doc_id = s.doc_id) AND EXISTS (SELECT 1 FROM {{tier_ocr}} o WHERE o.doc_id = s.doc_id)""")

relation("c_repair_pages", "OCR's items that touch no weak page, with the model's items of the weak pages; of documents for which the model found some.", """
WITH weak AS (SELECT w.doc_id, w.page FROM {weak_pages} w JOIN {repair_scope} s ON w.doc_id = s.doc_id
), again AS (SELECT m.* FROM {tier_model} m JOIN weak w ON m.doc_id = w.doc_id AND m.page = w.page
), touched AS (SELECT DISTINCT o.doc_id, o.item FROM {tier_ocr} o JOIN weak w ON o.doc_id = w.doc_id AND o.page = w.page
)
SELECT o.doc_id, 'kept' AS pass, o.item, o.seg, o.q_num, o.is_solution, o.page, o.y0, o.y1, o.x0, o.x1 FROM {tier_ocr} o JOIN (SELECT DISTINCT doc_id FROM again) d ON o.doc_id = d.doc_id
WHERE NOT EXISTS (SELECT 1 FROM touched t WHERE t.doc_id = o.doc_id AND t.item = o.item)
UNION ALL SELECT doc_id, 'repaired', item, seg, q_num, is_solution, page, y0, y1, x0, x1 FROM again""")

relation("repaired", "Items of each repaired document, and whether they suffice.", """
SELECT r.doc_id, r.items, CAST(r.items AS DOUBLE) / p.pages >= $(enough_items) AS sufficient FROM (SELECT doc_id, count(*) AS items FROM (SELECT DISTINCT doc_id, pass, item FROM {c_repair_pages}) x GROUP BY doc_id) r
JOIN {searchable_documents} p ON r.doc_id = p.doc_id""")

relation("model_scope", "Documents that the page model reads whole: those that nothing before was accepted for.", f"""
SELECT s.doc_id FROM {{searchable_documents}} s WHERE {_MODEL} AND NOT EXISTS (SELECT 1 FROM {{accepted_early}} a WHERE a.doc_id = s.doc_id) AND NOT EXISTS (SELECT 1 FROM {{repaired}} r WHERE r.doc_id = s.doc_id AND r.sufficient)""")

relation("d_pick_method", "The tier whose items a document keeps: the first accepted; else the model's, if it found any; else the tier with the most items, of equals the earlier.", """
WITH found AS (
  SELECT doc_id, CASE tier WHEN 'local' THEN 'local_ml' ELSE tier END AS method, CASE tier WHEN 'text' THEN 1 WHEN 'ocr' THEN 2 ELSE 3 END AS place, items FROM {d_gates}
  UNION ALL SELECT doc_id, 'ocr', 4, items FROM {repaired}
), best AS (SELECT doc_id, method, place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY items DESC, place) AS rn FROM found) x WHERE rn = 1
), model AS (SELECT DISTINCT m.doc_id FROM {tier_model} m JOIN {model_scope} s ON m.doc_id = s.doc_id
)
SELECT p.doc_id, coalesce(a.method, CASE WHEN r.doc_id IS NOT NULL THEN 'ocr' WHEN m.doc_id IS NOT NULL THEN 'ai' END, b.method, 'text') AS method,
  CASE WHEN a.doc_id IS NOT NULL THEN 'accepted' WHEN r.doc_id IS NOT NULL OR (m.doc_id IS NULL AND b.place = 4) THEN 'repaired' WHEN m.doc_id IS NOT NULL THEN 'model' ELSE 'most items' END AS stage
FROM {searchable_documents} p LEFT JOIN {accepted_early} a ON p.doc_id = a.doc_id LEFT JOIN (SELECT doc_id FROM {repaired} WHERE sufficient) r ON p.doc_id = r.doc_id
LEFT JOIN model m ON p.doc_id = m.doc_id LEFT JOIN best b ON p.doc_id = b.doc_id""")

_SPREAD = "CASE WHEN (x0 + x1) / 2 < 48 THEN 0 WHEN (x0 + x1) / 2 > 52 THEN 1 ELSE 2 END"
relation("c_page_router", "For each page of a document accepted by its text the tier that its items come from. OCR is asked where the page is a picture, or has both text and pictures and its text shows no items, or items without a number twice and in one column; it is used for pictures, and where it finds more items or columns.", f"""
WITH own AS (SELECT t.* FROM {{tier_text}} t JOIN {{accepted_early}} a ON t.doc_id = a.doc_id AND a.method = 'text'
), spread AS (
  SELECT p.doc_id, p.page, count(DISTINCT {_SPREAD}) AS cols, count(DISTINCT CASE WHEN {_SPREAD} < 2 THEN {_SPREAD} END) AS sides FROM (SELECT DISTINCT doc_id, page, item FROM own) p JOIN (SELECT doc_id, item, x0, x1 FROM own) s ON p.doc_id = s.doc_id AND p.item = s.item GROUP BY p.doc_id, p.page
), text AS (
  SELECT doc_id, page, count(*) AS n, count_if(NOT is_solution) - count(DISTINCT CASE WHEN NOT is_solution THEN q_num END) AS twice FROM (SELECT DISTINCT doc_id, page, item, q_num, is_solution FROM own) x GROUP BY doc_id, page
), asked AS (
  SELECT p.doc_id, p.page, p.class, coalesce(t.n, 0) AS n, coalesce(s.cols, 0) AS cols, p.class = 'ocr' OR (p.class = 'text_then_ocr' AND (t.n IS NULL OR (t.twice = 0 AND s.sides < 2))) AS ask
  FROM {{tier_pages}} p JOIN {{accepted_early}} a ON p.doc_id = a.doc_id AND a.method = 'text' LEFT JOIN text t ON p.doc_id = t.doc_id AND p.page = t.page LEFT JOIN spread s ON p.doc_id = s.doc_id AND p.page = s.page
), seen AS (
  SELECT o.doc_id, o.page, count(DISTINCT o.item) AS n, count(DISTINCT {_SPREAD}) AS cols FROM {{tier_ocr}} o JOIN (SELECT doc_id, page FROM asked WHERE ask) k ON o.doc_id = k.doc_id AND o.page = k.page GROUP BY o.doc_id, o.page
)
SELECT k.doc_id, k.page, k.ask AS asked, CASE WHEN k.ask AND (k.class = 'ocr' OR coalesce(o.n, 0) > k.n OR coalesce(o.cols, 0) > k.cols) THEN 'ocr' ELSE 'text' END AS tier
FROM asked k LEFT JOIN seen o ON k.doc_id = o.doc_id AND k.page = o.page""")

relation("tier_segments", "The segments that each document keeps: of its tier, whole items once; where pages are routed, text items that touch a page of the text tier, and OCR's segments of the other pages.", """
WITH chosen AS (SELECT doc_id, CASE WHEN stage = 'repaired' THEN 'repaired' ELSE method END AS method FROM {d_pick_method}
), routed AS (SELECT DISTINCT t.doc_id, t.item FROM {tier_text} t JOIN {c_page_router} r ON t.doc_id = r.doc_id AND t.page = r.page AND r.tier = 'text'
), kept AS (
  SELECT t.doc_id, 'text' AS tier, t.item, t.seg, t.q_num, t.is_solution, t.page, t.y0, t.y1, t.x0, t.x1 FROM {tier_text} t JOIN routed r ON t.doc_id = r.doc_id AND t.item = r.item
  UNION ALL SELECT o.doc_id, 'ocr', o.item, o.seg, o.q_num, o.is_solution, o.page, o.y0, o.y1, o.x0, o.x1 FROM {tier_ocr} o JOIN {c_page_router} r ON o.doc_id = r.doc_id AND o.page = r.page AND r.tier = 'ocr'
  UNION ALL SELECT doc_id, pass, item, seg, q_num, is_solution, page, y0, y1, x0, x1 FROM {c_repair_pages} WHERE doc_id IN (SELECT doc_id FROM chosen WHERE method = 'repaired')
  UNION ALL SELECT t.doc_id, 'text', t.item, t.seg, t.q_num, t.is_solution, t.page, t.y0, t.y1, t.x0, t.x1 FROM {tier_text} t JOIN chosen c ON t.doc_id = c.doc_id AND c.method = 'text' WHERE NOT EXISTS (SELECT 1 FROM {c_page_router} r WHERE r.doc_id = t.doc_id)
  UNION ALL SELECT t.doc_id, 'ocr', t.item, t.seg, t.q_num, t.is_solution, t.page, t.y0, t.y1, t.x0, t.x1 FROM {tier_ocr} t JOIN chosen c ON t.doc_id = c.doc_id AND c.method = 'ocr'
  UNION ALL SELECT t.doc_id, 'local', t.item, t.seg, t.q_num, t.is_solution, t.page, t.y0, t.y1, t.x0, t.x1 FROM {tier_local} t JOIN chosen c ON t.doc_id = c.doc_id AND c.method = 'local_ml'
  UNION ALL SELECT t.doc_id, 'model', t.item, t.seg, t.q_num, t.is_solution, t.page, t.y0, t.y1, t.x0, t.x1 FROM {tier_model} t JOIN chosen c ON t.doc_id = c.doc_id AND c.method = 'ai'
)
SELECT * FROM kept""")

SEGMENT = "doc_id long, item long, seg int, q_num string, is_solution boolean, page int, y0 double, y1 double, x0 double, x1 double"
Detector = Callable[[DataFrame], DataFrame]


def detected(pages: DataFrame, detectors: dict[str, Detector], settings: dict[str, int | float] | None = None) -> DataFrame:
    """The segments each document keeps, from detectors that are each run only on the pages they are needed for.

    pages: (doc_id, page, class, conf). A detector of TIERS takes rows of pages and returns SEGMENT rows for them; a tier
    without one is not ready. OCR also reads the pages of accepted text that call for it, the model the weak pages.
    """
    spark = pages.sparkSession
    own = {**(settings or {}), "model_ready": int("model" in detectors), "local_ready": int("local" in detectors)}
    empty = spark.createDataFrame([], SEGMENT)
    given: dict[str, DataFrame] = {"tier_pages": pages, **{f"tier_{t}": empty for t in TIERS}}

    def look(name: str) -> DataFrame:
        """A relation over what has been read so far; nothing that depends on a tier still to be read is kept."""
        return frame(spark, "", name, dict(given), own)

    def read(tier: str, scope: DataFrame, keys: list[str]) -> None:
        if tier in detectors:
            found = detectors[tier](pages.join(scope.distinct().hint("merge"), keys, "left_semi"))
            given[f"tier_{tier}"] = given[f"tier_{tier}"].unionByName(found)

    if own.get("prefer_model", SETTINGS["prefer_model"]):
        read("model", pages.select("doc_id"), ["doc_id"])
    read("text", look("text_scope"), ["doc_id"])
    read("ocr", look("ocr_scope"), ["doc_id"])
    read("ocr", look("c_page_router").filter("asked"), ["doc_id", "page"])
    read("local", look("local_scope"), ["doc_id"])
    if not own.get("prefer_model", SETTINGS["prefer_model"]):
        read("model", look("weak_pages").join(look("repair_scope").hint("merge"), "doc_id"), ["doc_id", "page"])
        repaired = given["tier_model"]
        scope = look("model_scope")
        given["tier_model"] = repaired.join(scope.hint("merge"), "doc_id", "left_anti")  # those documents are read whole
        read("model", scope, ["doc_id"])
    return look("tier_segments")
