"""Greedy rules, where what is kept depends on what was kept before.

Each folds a sorted array of one page or document with `aggregate`, inside the JVM; the one that changes its own state in
ways an expression cannot say runs on Arrow batches of many pages' arrays. A group is one page or document, so it stays small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..relations import SETTINGS, SHARED, built, relation
from .itemising import detect

SHARED |= {"read_words", "word_extents", "word_columns"}

_INTER = "greatest(0E0, least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0)) * greatest(0E0, least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0))"
_AREA = "({a}.x1 - {a}.x0) * ({a}.y1 - {a}.y0)"


def _iou(a: str, b: str) -> str:
    i = _INTER.format(a=a, b=b)
    return f"({i}) / ({_AREA.format(a=a)} + {_AREA.format(a=b)} - ({i}))"


def _rows(fields: dict[str, str], i: int) -> str:
    """The sorted array of a group's rows; its fields are the order. i: 0 Spark, 1 the other engine."""
    if i:
        return "list_sort(list(struct_pack(" + ", ".join(f"{n} := {e}" for n, e in fields.items()) + ")))"
    return "array_sort(collect_list(struct(" + ", ".join(f"{e} AS {n}" for n, e in fields.items()) + ")))"


def greedy(name: str, doc: str, source: str, keys: str, fields: dict[str, str], hit: str) -> None:
    """Register a fold that drops a row where `hit`, a test of a kept row {k} and the row {r}, holds for some kept row."""
    groups = [f"(SELECT {keys}, {_rows(fields, i)} AS b FROM {{{source}}} GROUP BY {keys}) x" for i in (0, 1)]
    cols = ", ".join(f"r.{n}" for n in fields)
    relation(name, doc, "",
        spark=f"""
SELECT {keys}, inline(aggregate(b, slice(b, 1, 0), (kept, r) -> CASE WHEN exists(kept, k -> {hit.format(k="k", r="r")}) THEN kept ELSE array_append(kept, r) END)) FROM {groups[0]}""",
        other=f"""
SELECT {keys}, {cols} FROM (SELECT {keys}, unnest(list_reduce(list_transform(b, lambda r: [r]), lambda kept, r: CASE WHEN len(list_filter(kept, lambda k: {hit.format(k="k", r="r[1]")})) > 0 THEN kept ELSE list_concat(kept, r) END)) AS r
FROM {groups[1]}) y""")  # fmt: skip


_BOX = {c: c for c in ("x0", "y0", "x1", "y1")}
greedy("d_nms", "Boxes of a page and label without those that a better-scored kept one overlaps by half.", "boxes", "doc_id, page, label",
    {"neg_score": "-score", "box_id": "box_id", **_BOX}, _iou("{k}", "{r}") + " >= 0.5E0")
greedy("c_drop_nested_rects", "Rectangles of a page that lie in no larger kept one, one unit of play.", "boxes", "doc_id, page",
    {"neg_area": "-(x1 - x0) * (y1 - y0)", "box_id": "box_id", **_BOX}, "{r}.x0 >= {k}.x0 - 1 AND {r}.x1 <= {k}.x1 + 1 AND {r}.y0 >= {k}.y0 - 1 AND {r}.y1 <= {k}.y1 + 1")
greedy("d_merge_batches", "Segments of an item found by overlapping page batches, without those within three per cent of a kept one of the page.", "segments",
    "doc_id, q_num, is_solution", {c: c for c in ("page", "y0", "y1", "item", "seg")}, "{k}.page = {r}.page AND abs({k}.y0 - {r}.y0) < 3 AND abs({k}.y1 - {r}.y1) < 3")

_ITEM = {c: c for c in ("item", "page", "x0", "y0", "x1", "y1")}
_ALIKE = "{k}.page = {r}.page AND " + _iou("{k}", "{r}") + " >= 0.6E0"
relation("c_iou_dedupe", "Items of a side without those that overlap a kept one by 0.6 of their union; a larger one takes the kept one's place.", "",
    spark=f"""
SELECT doc_id, is_solution, inline(aggregate(b, slice(b, 1, 0), (kept, r) -> CASE WHEN exists(kept, k -> {_ALIKE.format(k="k", r="r")})
  THEN transform(kept, (k, i) -> CASE WHEN i = array_position(transform(kept, z -> {_ALIKE.format(k="z", r="r")}), true) - 1 AND r.y1 - r.y0 > k.y1 - k.y0 THEN r ELSE k END)
  ELSE array_append(kept, r) END))
FROM (SELECT doc_id, is_solution, {_rows(_ITEM, 0)} AS b FROM {{segments}} WHERE seg = 0 GROUP BY doc_id, is_solution) x""",
    other=f"""
SELECT doc_id, is_solution, {", ".join(f"r.{c}" for c in _ITEM)} FROM (SELECT doc_id, is_solution, unnest(list_reduce(list_transform(b, lambda r: [r]), lambda kept, r:
  CASE WHEN len(list_filter(kept, lambda k: {_ALIKE.format(k="k", r="r[1]")})) > 0
  THEN list_transform(kept, lambda k, i: CASE WHEN i = list_position(list_transform(kept, lambda z: {_ALIKE.format(k="z", r="r[1]")}), true) AND r[1].y1 - r[1].y0 > k.y1 - k.y0 THEN r[1] ELSE k END)
  ELSE list_concat(kept, r) END)) AS r
FROM (SELECT doc_id, is_solution, {_rows(_ITEM, 1)} AS b FROM {{segments}} WHERE seg = 0 GROUP BY doc_id, is_solution) x) y""")  # fmt: skip

_WORD = {c: c for c in ("y0", "x0", "y1", "seq", "pos")}
relation("d_baseline_lines", "Lines of a page from words: a word joins the line whose middle it is within 45 per cent of its height of, and widens it.", "",
    spark=f"""
SELECT doc_id, page, inline(aggregate(b, transform(slice(b, 1, 0), r -> named_struct('y0', r.y0, 'y1', r.y1, 'n', 0L)), (kept, r) -> CASE
  WHEN size(kept) > 0 AND abs((r.y0 + r.y1) / 2 - (element_at(kept, -1).y0 + element_at(kept, -1).y1) / 2) <= 0.45E0 * greatest(r.y1 - r.y0, element_at(kept, -1).y1 - element_at(kept, -1).y0)
  THEN array_append(slice(kept, 1, size(kept) - 1), named_struct('y0', least(r.y0, element_at(kept, -1).y0), 'y1', greatest(r.y1, element_at(kept, -1).y1), 'n', element_at(kept, -1).n + 1L))
  ELSE array_append(kept, named_struct('y0', r.y0, 'y1', r.y1, 'n', 1L)) END))
FROM (SELECT doc_id, page, {_rows(_WORD, 0)} AS b FROM {{words}} GROUP BY doc_id, page) x""",
    other=f"""
SELECT doc_id, page, r.y0, r.y1, r.n FROM (SELECT doc_id, page, unnest(list_reduce(list_transform(b, lambda r: [struct_pack(y0 := r.y0, y1 := r.y1, n := CAST(1 AS BIGINT))]), lambda kept, r:
  CASE WHEN abs((r[1].y0 + r[1].y1) / 2 - (kept[-1].y0 + kept[-1].y1) / 2) <= 0.45E0 * greatest(r[1].y1 - r[1].y0, kept[-1].y1 - kept[-1].y0)
  THEN list_concat(kept[1:len(kept) - 1], [struct_pack(y0 := least(r[1].y0, kept[-1].y0), y1 := greatest(r[1].y1, kept[-1].y1), n := kept[-1].n + 1)])
  ELSE list_concat(kept, r) END)) AS r
FROM (SELECT doc_id, page, {_rows(_WORD, 1)} AS b FROM {{words}} GROUP BY doc_id, page) x) y""")  # fmt: skip

SETTINGS |= {"words_for_columns": 12}
#: Word boxes of a page, scaled so that its rightmost word ends at 200; a page of few words counts as one column.
relation("read_words", "Words that say something and were read with some confidence.", """
SELECT doc_id, page, block, par, line, pos, word, x0, greatest(x1, x0) AS x1, y0, greatest(y1, y0) AS y1 FROM {words} WHERE trim(word) <> '' AND conf >= 0""")
relation("word_extents", "Extents of words as shares of 200 of a page's text, on pages of twelve words or more; Spark counts alike ones.", "",
    spark="""
SELECT doc_id, page, x0 * 200.0 / reach AS x_left, x1 * 200.0 / reach AS x_right, k FROM (
  SELECT *, max(x1) OVER (PARTITION BY doc_id, page) AS reach, sum(k) OVER (PARTITION BY doc_id, page) AS n FROM (
    SELECT doc_id, page, x0, x1, count(*) AS k FROM {read_words} GROUP BY doc_id, page, x0, x1) a) x WHERE n >= $(words_for_columns) AND reach > 0 AND x1 > x0""",
    other="""
SELECT doc_id, page, x0 * 200.0 / reach AS x_left, x1 * 200.0 / reach AS x_right FROM (
  SELECT *, max(x1) OVER (PARTITION BY doc_id, page) AS reach, count(*) OVER (PARTITION BY doc_id, page) AS n FROM {read_words}) x WHERE n >= $(words_for_columns) AND reach > 0 AND x1 > x0""")
relation("word_columns", "Columns of a page by the density of its words.", "", **detect("word_extents", "200", "k"))
_MID = "((w.x0 + w.x1) / 2 * 200.0 / p.reach)"
#: In Spark a page's columns are one row, so a word stays one row and is moved once.
relation("word_column_of", "Words with their column: the one that holds their centre, else the nearest; the last has no right end.", "",
    spark=f"""
SELECT doc_id, page, block, par, line, pos, word, x0, x1, y0, y1, coalesce(near.col, 0) AS col FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, page, block, par, line, pos, x0, y0 ORDER BY near.dist, near.col) AS rn FROM (
    SELECT w.*, array_min(transform(p.cols, c -> struct(CASE WHEN {_MID} >= c.x0 AND ({_MID} <= c.x1 OR c.col = p.last) THEN -1.0 ELSE least(abs({_MID} - c.x0), abs({_MID} - c.x1)) END AS dist, c.col AS col))) AS near
    FROM {{read_words}} w LEFT JOIN (
      SELECT r.doc_id, r.page, r.reach, c.cols, c.last FROM (SELECT doc_id, page, max(x1) AS reach FROM {{read_words}} GROUP BY doc_id, page) r
      LEFT JOIN (SELECT doc_id, page, collect_list(struct(col, x0, x1)) AS cols, max(col) AS last FROM {{word_columns}} GROUP BY doc_id, page) c ON r.doc_id = c.doc_id AND r.page = c.page) p
    ON w.doc_id = p.doc_id AND w.page = p.page) x) y WHERE rn = 1""",
    other="""
SELECT doc_id, page, block, par, line, pos, word, x0, x1, y0, y1, coalesce(col, 0) AS col FROM (
  SELECT w.*, c.col, row_number() OVER (PARTITION BY w.doc_id, w.page, w.block, w.par, w.line, w.pos, w.x0, w.y0 ORDER BY
    CASE WHEN w.mid >= c.x0 AND (w.mid <= c.x1 OR c.col = c.last) THEN -1.0 ELSE least(abs(w.mid - c.x0), abs(w.mid - c.x1)) END, c.col) AS rn
  FROM (SELECT *, (x0 + x1) / 2 * 200.0 / max(x1) OVER (PARTITION BY doc_id, page) AS mid FROM {read_words}) w
  LEFT JOIN (SELECT *, max(col) OVER (PARTITION BY doc_id, page) AS last FROM {word_columns}) c ON w.doc_id = c.doc_id AND w.page = c.page) x WHERE rn = 1""")

_LINES = """
SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY y0, col, block, par, line) AS BIGINT) AS seq, col, block, par, line, x0, greatest(x1, x0 + 1) AS x1, y0, greatest(y1, y0 + 1) AS y1, text FROM (
  SELECT doc_id, page, col, block, par, line, min(x0) AS x0, max(x1) AS x1, min(y0) AS y0, max(y1) AS y1, {text} AS text FROM {{word_column_of}} GROUP BY doc_id, page, col, block, par, line) x"""
relation("d_words_to_lines", "Lines from words: those of a column, block, paragraph and line, in order. Columns come from the words themselves, so a row that an engine read across the gutter is cut into two lines.", "",
    spark=_LINES.format(text="array_join(transform(array_sort(collect_list(struct(pos, x0, word))), x -> x.word), ' ')"), other=_LINES.format(text="string_agg(word, ' ' ORDER BY pos, x0, word)"))


def merged_clusters(rects: list[tuple[float, float, float, float]], gap: float) -> list[tuple[float, float, float, float]]:
    """Unions of rectangles no further apart than gap, until none are."""
    done: list[list[float]] = []
    for r in sorted(rects):
        now = list(r)
        while True:
            near = [d for d in done if now[0] <= d[2] + gap and d[0] <= now[2] + gap and now[1] <= d[3] + gap and d[1] <= now[3] + gap]
            if not near:
                break
            done = [d for d in done if d not in near]
            for d in near:
                now = [min(now[0], d[0]), min(now[1], d[1]), max(now[2], d[2]), max(now[3], d[3])]
        done.append(now)
    return sorted(tuple(d) for d in done)


def cluster_rects(figures: DataFrame, gap: float = 24.0) -> DataFrame:
    """(doc_id, page, x0, y0, x1, y1) of clusters of figures on a page."""
    sides = ("x0", "y0", "x1", "y1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, rects = b.column("r").offsets.to_numpy(), b.column("r").flatten()
            rows = list(zip(*(rects.field(c).to_numpy(zero_copy_only=False).tolist() for c in sides), strict=True))
            found = [merged_clusters(rows[i - of[0] : j - of[0]], gap) for i, j in zip(of, of[1:], strict=False)]
            page = np.repeat(np.arange(b.num_rows), [len(f) for f in found])
            done = np.array([r for f in found for r in f], dtype=float).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(page)), b.column("page").take(pa.array(page)), *(pa.array(x, from_pandas=True) for x in done.T)], ["doc_id", "page", *sides])

    pages = figures.groupBy("doc_id", "page").agg(F.collect_list(F.struct(*[F.col(c).cast("double").alias(c) for c in sides])).alias("r"))
    return pages.select(F.col("doc_id").cast("long"), F.col("page").cast("int"), "r").mapInArrow(run, "doc_id long, page int, x0 double, y0 double, x1 double, y1 double")


def nearest_pairs(left: list[tuple[int, float]], right: list[tuple[int, float]], tolerance: float) -> list[tuple[int, int]]:
    """Pairs (left id, right id): each left one in order of height takes the nearest unused right one within tolerance."""
    free, out = sorted(right, key=lambda r: (r[1], r[0])), []
    for i, y in sorted(left, key=lambda r: (r[1], r[0])):
        best = min(free, key=lambda r: abs(r[1] - y), default=None)
        if best and abs(best[1] - y) <= tolerance:
            free.remove(best)
            out.append((i, best[0]))
    return out


#: As nearest_pairs, over a group's arrays; the state is the pairs made and the right ones that are free.
_NEAREST = """
aggregate(lefts, named_struct('made', CAST(array() AS array<struct<first: bigint, second: bigint>>), 'free', rights), (s, l) ->
  transform(array(array_min(transform(s.free, (r, i) -> named_struct('d', abs(r.y - l.y), 'y', r.y, 'id', r.id, 'i', i)))), b -> CASE WHEN b.d <= {tolerance}
    THEN named_struct('made', array_append(s.made, named_struct('first', l.id, 'second', b.id)), 'free', filter(s.free, (r, i) -> i <> b.i)) ELSE s END)[0], s -> s.made)"""


def _paired(rows: DataFrame, keys: list[str], tolerance: float, middle: float, play: float) -> DataFrame:
    """(keys, first, second) of rows (keys, id, x0, x1, y0, y1) left and right of the middle."""
    x = rows.select(*keys, F.col("id").cast("long").alias("id"), ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).cast("double").alias("y"))
    side = lambda test: F.array_sort(F.collect_list(F.when(test, F.struct("y", "id"))))
    x = x.filter(F.col("y").isNotNull() & ~F.isnan("y"))
    sides = x.groupBy(*keys).agg(side(F.col("x") < middle - play).alias("lefts"), side(F.col("x") > middle + play).alias("rights"))
    met = sides.filter((F.size("lefts") > 0) & (F.size("rights") > 0)).select(*keys, F.explode(F.expr(_NEAREST.format(tolerance=tolerance))).alias("p"))
    return met.select(*keys, "p.first", "p.second")


def bilingual_nearest(segments: DataFrame) -> DataFrame:
    """Items left and right of a page's middle that stand side by side within 6 per cent."""
    rows = segments.filter("seg = 0").select("doc_id", "page", "is_solution", F.col("item").alias("id"), "x0", "x1", "y0", "y1")
    return _paired(rows, ["doc_id", "page", "is_solution"], 6.0, 50.0, 2.0)


def bilingual_boxes(boxes: DataFrame) -> DataFrame:
    """Detector boxes left and right of a page's middle whose middles are within 10 per cent."""
    rows = boxes.select("doc_id", "page", "label", F.col("box_id").alias("id"), "x0", "x1", "y0", "y1")
    return _paired(rows, ["doc_id", "page", "label"], 10.0, 50.0, 0.0)


built("d_cluster_rects", "Clusters of figures no further apart than three per cent of the page.", ["figures"], cluster_rects)
#: Each left row in order takes the nearest free right one; the fold's state is the pairs made so far.
_PAIRS = """
WITH rows AS (SELECT {keys}, {id} AS id, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y FROM {{{source}}} {where}),
sides AS (SELECT {keys}, list_sort(list(struct_pack(y := y, id := id)) FILTER (WHERE x < 50 - {play})) AS lefts, list(struct_pack(y := y, id := id)) FILTER (WHERE x > 50 + {play}) AS rights FROM rows GROUP BY {keys}),
made AS (SELECT {keys}, list_reduce(list_concat([[struct_pack(y := CAST(0 AS DOUBLE), id := CAST(-1 AS BIGINT), other := CAST(-1 AS BIGINT))]], list_transform(lefts, lambda l: [struct_pack(y := l.y, id := CAST(l.id AS BIGINT), other := CAST(-1 AS BIGINT))])),
  lambda kept, l: list_append(kept, struct_pack(y := l[1].y, id := l[1].id, other := coalesce(list_sort(list_transform(list_filter(rights, lambda r: NOT list_contains(list_transform(kept, lambda q: q.other), r.id)), lambda r: struct_pack(d := abs(r.y - l[1].y), y := r.y, id := CAST(r.id AS BIGINT))))[1], struct_pack(d := CAST(1e9 AS DOUBLE), y := CAST(0 AS DOUBLE), id := CAST(-1 AS BIGINT))).id * CAST(coalesce(list_min(list_transform(list_filter(rights, lambda r: NOT list_contains(list_transform(kept, lambda q: q.other), r.id)), lambda r: abs(r.y - l[1].y))) <= {tolerance}, false) AS INT) - CAST(NOT coalesce(list_min(list_transform(list_filter(rights, lambda r: NOT list_contains(list_transform(kept, lambda q: q.other), r.id)), lambda r: abs(r.y - l[1].y))) <= {tolerance}, false) AS INT)))) AS pairs
  FROM sides WHERE lefts IS NOT NULL AND rights IS NOT NULL)
SELECT {keys}, p.id AS first, p.other AS second FROM (SELECT {keys}, unnest(pairs) AS p FROM made) z WHERE p.other >= 0"""
built("c_bilingual_nearest", "Items paired with the nearest across the page's middle.", ["segments"], bilingual_nearest,
    other=_PAIRS.format(keys="doc_id, page, is_solution", id="item", source="segments", where="WHERE seg = 0", play=2, tolerance="6.0"))
built("c_bilingual_boxes", "Boxes paired across the page's middle.", ["boxes"], bilingual_boxes,
    other=_PAIRS.format(keys="doc_id, page, label", id="box_id", source="boxes", where="", play=0, tolerance="10.0"))


def score_pages(pages: DataFrame, score: callable, schema: str = "doc_id long, page int, raw string") -> DataFrame:
    """Raw answers of a page model: `score` takes a batch of pages (pandas) and returns a JSON text for each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield pd.DataFrame({"doc_id": p["doc_id"], "page": p["page"], "raw": score(p)})

    return pages.select("doc_id", "page", "n_lines").mapInPandas(run, schema)


def line_boxes(p: pd.DataFrame) -> list[str]:
    """A stand-in for a model: one box per four lines of a page."""
    return [
        '{"boxes":[' + ",".join(f'{{"label":"question","score":{0.5 + k / 64},"box":[5,{10 * k},45,{10 * k + 8}]}}' for k in range(n // 4)) + "]}"
        for n in p["n_lines"]
    ]


built("j_score_pages", "Boxes that a pluggable page scorer returns as JSON, parsed.", ["page_counts"], lambda pages: parse_boxes(score_pages(pages, line_boxes)),
    other="""SELECT doc_id, page, k AS pos, 'question' AS label, 0.5E0 + k / 64.0E0 AS score, 5.0E0 AS x0, 10.0E0 * k AS y0, 45.0E0 AS x1, 10.0E0 * k + 8 AS y1 FROM (SELECT doc_id, page, CAST(unnest(range(CAST(floor(n_lines / 4.0) AS BIGINT))) AS INT) AS k FROM {page_counts}) x""")
relation("page_counts", "Lines on each page.", "SELECT doc_id, page, CAST(count(*) AS BIGINT) AS n_lines FROM {lines} GROUP BY doc_id, page")


def parse_boxes(raw: DataFrame) -> DataFrame:
    """(doc_id, page, pos, label, score, x0, y0, x1, y1) of raw answers {"boxes": [{label, score, box}]}."""
    kind = "struct<boxes: array<struct<label: string, score: double, box: array<double>>>>"
    b = raw.select("doc_id", "page", F.posexplode(F.from_json("raw", kind)["boxes"]).alias("pos", "b"))
    return b.select("doc_id", "page", "pos", "b.label", "b.score", *[F.col("b.box")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])
