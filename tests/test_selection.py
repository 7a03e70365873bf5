"""Choices on literal rows: detector output, answers of box models, pairs, outputs, scopes, names, redaction, report lists."""

import json

import pytest

from sheafline.catalog import apply
from tests.support import rows

SEGMENT = "doc_id long, item long, seg int, q_num string, is_solution boolean, page int, y0 double, y1 double, x0 double, x1 double"
ITEM = "doc_id long, item long, q_num string, is_solution boolean, page int, option_labels string, n_segments long, is_hindi boolean"
BOX = "doc_id long, page int, scale double, pad_x double, pad_y double, width double, height double"


def papers(spark, items):
    """items: (document, number, side, labels, hindi, [(page, y0, y1, x0, x1)...])"""
    segs, rows_ = [], []
    for i, (d, q, sol, labels, hindi, parts) in enumerate(items, 1):
        rows_.append((d, i, q, sol, parts[0][0], labels, len(parts), hindi))
        segs += [(d, i, k, q, sol, p, *map(float, x)) for k, (p, *x) in enumerate(parts)]
    return {"segments": spark.createDataFrame(segs, SEGMENT), "items": spark.createDataFrame(rows_, ITEM)}


def test_detector_rows(spark):
    """A page of 400 x 800 at half scale, 120 to the left and 32 above; classes: question, solution, logo."""
    page = spark.createDataFrame([(1, 1, 0.5, 120.0, 32.0, 400.0, 800.0), (1, 2, 0.0, 0.0, 0.0, 400.0, 800.0)], BOX)
    at, share = [220.0, 132.0, 100.0, 50.0], [220 / 640, 132 / 640, 100 / 640, 50 / 640]
    cases = {
        1: (1, [*at, 0.9, 1.0]), 2: (1, [*at, 0.2, 0.7, 0.1]), 3: (1, [*share, 0.8, 0.1, 0.1]), 4: (1, [*at, 0.9, 2.0]), 5: (1, [*at, 0.02, 0.01, 0.0]), 6: (1, [*at, 0.9]),
        7: (2, [390.0, 790.0, 100.0, 100.0, 0.9, 0.0]), 8: (1, [20.0, 132.0, 100.0, 50.0, 0.9, 0.0]), 9: (1, [*at, 0.5, 0.1, 3.0]), 10: (1, [*at, 0.03, 0.0, 0.0]), 11: (3, [*at, 0.9, 1.0]), 12: (1, [*at, 0.4, 0.4, 0.1]),
    }
    df = spark.createDataFrame([(1, p, i, v) for i, (p, v) in cases.items()] + [(1, 1, 99, None)], "doc_id long, page int, box_id long, vals array<double>")
    names = spark.createDataFrame([(0, " Question"), (1, "solution"), (2, "logo")], "class_id int, label string")
    got = {r["box_id"]: r for r in apply("b_decode_detections", tensor_rows=df, letterboxes=page, class_names=names).collect()}
    assert sorted(got) == [1, 2, 3, 7, 10, 12]
    box = lambda i: tuple(round(got[i][c], 9) for c in ("x0", "x1", "y0", "y1"))
    assert box(1) == box(2) == box(3) == (100, 300, 150, 250)  # twice the square's pixels, padding off
    assert box(7) == (340, 400, 740, 800)  # clipped; a scale of 0 counts as 1
    assert [(got[i]["label"], got[i]["score"]) for i in (1, 2, 3, 10, 12)] == [("solution", 0.9), ("solution", 0.7), ("question", 0.8), ("question", 0.03), ("question", 0.4)]
    low = apply("b_decode_detections", {"least_score": 0.5}, tensor_rows=df, letterboxes=page, class_names=names)
    assert {r["box_id"] for r in low.collect()} == {1, 2, 3, 7}


def test_objectness_by_class(spark):
    """The product counts only where it is the higher score, and not for an objectness over one."""
    page = spark.createDataFrame([(1, 1, 1.0, 0.0, 0.0, 400.0, 800.0)], BOX)
    df = spark.createDataFrame([(1, 1, i, [220.0, 132.0, 100.0, 50.0, *v]) for i, v in enumerate([[1.0, -1.0, 2.0], [0.9, 0.5, 0.8], [1.5, 0.1, 0.2]])], "doc_id long, page int, box_id long, vals array<double>")
    names = spark.createDataFrame([(0, "question"), (1, "solution"), (2, "explanation")], "class_id int, label string")
    assert rows(apply("b_decode_detections", tensor_rows=df, letterboxes=page, class_names=names), "box_id", "label", "score") == {(0, "explanation", 2.0): 1, (1, "question", 0.9): 1, (2, "question", 1.5): 1}


@pytest.mark.parametrize(
    ("answer", "want"),
    [
        ([{"label": "question", "box": {"xmin": 40, "ymin": 80, "xmax": 200, "ymax": 160}}], (10, 10, 50, 20)),
        ([{"label": " Solution ", "score": 0.05, "box": {"xmin": 0.1, "ymin": 0.1, "xmax": 0.5, "ymax": 1.001}}], (10, 10, 50, 100)),
        ([{"box": {"xmin": 40, "ymin": 80, "xmax": 500, "ymax": 160}}], (10, 10, 100, 20)),
        ({"boxes": [{"class": "mcq", "x1": 40, "y1": "80", "x2": 200, "y2": 160}]}, (10, 10, 50, 20)),
        ({"boxes": [{"x1": 40, "y_start_pct": 10, "y_end_pct": 20, "x_end_pct": 50}]}, (0, 10, 50, 20)),
        ({"boxes": [{"y_start_pct": 10}]}, (0, 10, 100, 100)),
        ({"boxes": [{"label": "q", "box": [0.1, 0.1, 0.5, 0.2]}]}, (10, 10, 50, 20)),
        ({"boxes": [{"page": "2", "y_start_pct": 10, "y_end_pct": 20}]}, None),
        ({"boxes": [{"y_start_pct": 10, "y_end_pct": 12.9}]}, None),
        ({"boxes": [{"y_start_pct": 10, "y_end_pct": 13, "x_end_pct": 4.9}]}, None),
        ({"boxes": [{"label": "logo", "y_start_pct": 10}]}, None),
        ({"boxes": [{"score": 0.04, "y_start_pct": 10}]}, None),
        ({"boxes": [{"x1": "wide", "y1": 80, "x2": 200, "y2": 160}]}, None),
        ({"boxes": []}, None),
        ("no answer", None),
        (None, None),
    ],
)
def test_answers_of_box_models(spark, answer, want):
    """Pictures of 400 x 800; a page that has none gives no row."""
    raw = spark.createDataFrame([(1, 1, 7, answer if answer is None or isinstance(answer, str) else json.dumps(answer))], "doc_id long, page int, box_id long, raw string")
    got = apply("a_boxes_from_model_json", box_json=raw, letterboxes=spark.createDataFrame([(1, 1, 1.0, 0.0, 0.0, 400.0, 800.0)], BOX)).collect()
    assert [tuple(r[c] for c in ("x0", "y0", "x1", "y1")) for r in got] == ([] if want is None else [want])


LEFT, RIGHT = (1, 10, 20, 0, 45), (1, 10, 20, 50, 95)


def test_pairs_in_two_languages(spark):
    items = [
        (1, "1", False, "ABCD", None, [RIGHT, (2, 5, 9, 0, 9)]), (1, "1", False, "", None, [LEFT]), (1, "2", False, "", None, [RIGHT]), (1, "2", False, "", None, [LEFT]),
        (1, "3", False, "", None, [LEFT]), (1, "3", True, "", None, [RIGHT]), (1, "4", False, "", None, [LEFT]), (1, "4", False, "", None, [(1, 30, 40, 15, 60)]), (1, "5", False, "", None, [LEFT]), (1, "5", False, "", None, [(2, *RIGHT[1:])]),
        *[(2, str(n), False, "", None, [LEFT]) for n in (1, 1, 2, 3, 4, 5)], (3, "1", False, "cd", None, [RIGHT]), (3, "1", False, "ab", None, [LEFT]), (3, "2", False, "", None, [LEFT]),
    ]
    items[10] = (2, "1", False, "", None, [RIGHT])
    got = rows(apply("c_bilingual_exact", **papers(spark, items)), "doc_id", "q_num", "first", "second")
    assert got == {(1, "1", 1, 2): 1, (1, "2", 4, 3): 1, (3, "1", 18, 17): 1}  # one pair among five numbers is none; 15 apart is not enough


def test_one_or_two_items_an_output(spark):
    items = [
        (1, "7", False, "", None, [RIGHT]), (1, "Q7", False, "", None, [LEFT]), (1, "7", False, "", None, [(2, 10, 60, 0, 45)]), (1, "7", True, "", None, [LEFT]),
        (1, "8", False, "", True, [LEFT]), (1, "8", False, "", False, [RIGHT]), (1, "x", False, "", None, [LEFT]), (1, "y", False, "", None, [(1, 50, 60, 0, 45)]),
    ]
    assert {r["item"] for r in apply("d_best_per_output", **papers(spark, items)).collect()} == {3, 4, 5, 7}
    assert {r["item"] for r in apply("d_best_per_output", {"per_output": "two"}, **papers(spark, items)).collect()} == {1, 2, 4, 5, 6, 7, 8}


def test_scope_decides_sides(spark):
    at = lambda *pages: [(p, 10, 20, 0, 45) for p in pages]
    items = [(1, "1", True, "", None, at(1, 2)), (1, "2", False, "", None, at(2, 3)), (1, "3", True, "", None, at(3)), (2, "1", True, "", None, at(1)), (1, "4", True, "", None, at(4))]
    own = papers(spark, items)
    scope = lambda *r: spark.createDataFrame([(1, *x) for x in r], "doc_id long, page int, answers boolean")
    kept = lambda s, strict: rows(apply("c_page_scope", {"strict_scope": strict}, segments=own["segments"], page_scope=s), "item", "page", "is_solution")
    free = {(4, 1, True): 1}  # a document without a scope
    both = scope((1, False), (2, False), (4, True))
    assert kept(both, 1) == kept(both, 0) == {(1, 1, False): 1, (1, 2, False): 1, (2, 2, False): 1, (5, 4, True): 1} | free
    asked = scope((1, False), (2, False))
    assert kept(asked, 1) == {(1, 1, False): 1, (1, 2, False): 1, (2, 2, False): 1} | free
    assert kept(asked, 0) == {(1, 1, False): 1, (1, 2, False): 1, (2, 2, False): 1, (3, 3, True): 1, (5, 4, True): 1} | free
    answers = scope((2, True))
    assert kept(answers, 0) == {(1, 2, True): 1, (2, 2, True): 1} | free  # the rest are solutions on no answers page
    assert kept(scope((1, True), (1, False)), 1) == {(1, 1, True): 1} | free


def test_batches_of_names(spark):
    asked = spark.createDataFrame([(b, k, p) for b, pages in {1: (2, 1), 2: (1, 9), 3: (1, 2), 4: (1,)}.items() for k, p in enumerate(pages)], "batch long, pos int, page int")
    pages = spark.createDataFrame([(b, p, 2) for b in (1, 2, 3, 4) for p in (1, 2)], "doc_id long, page int, last_page int")
    stems = spark.createDataFrame([(1, 5, "a"), (1, 8, "b"), (3, 0, "only")], "batch long, pos int, stem string")
    got = rows(apply("c_select_entries", requested_pages=asked, paper_pages=pages, given_stems=stems), "batch", "page", "status", "stem")
    assert got == {
        (1, 2, "ok", "a"): 1, (1, 1, "ok", "b"): 1, (2, 1, "in a batch with missing pages", "page_00"): 1, (2, 9, "missing", "page_01"): 1,
        (3, 1, "names differ in number", "only"): 1, (3, 2, "names differ in number", "page_01"): 1, (4, 1, "ok", "page_00"): 1,
    }


def test_redaction_in_pixels(spark):
    """A page of 640 x 800; the crop's corner is at (64, 80), its size 256 x 80 points."""
    seg = papers(spark, [(1, "1", False, "", None, [(1, 10, 20, 10, 50)])])["segments"]
    rect = lambda *r: spark.createDataFrame([(1, 1, *map(float, x), "link") for x in r], "doc_id long, page int, x0 double, y0 double, x1 double, y1 double, kind string")
    found = lambda zoom, *r: [tuple(x)[-4:] for x in apply("c_redact_rects", {"zoom": zoom}, segments=seg, c_furniture_rects=rect(*r)).collect()]
    assert found(2.0, (100, 100, 120.3, 110)) == [(68, 36, 116, 64)]
    assert found(1.0, (0, 0, 700, 90)) == [(0, 0, 256, 12)]
    assert found(1.0, (321, 100, 330, 110)) == [(255, 18, 256, 32)] and found(1.0, (322, 100, 330, 110)) == [] and found(1.0, (0, 0, 62, 800)) == [] and found(1.0, (0, 0, 63, 800)) == [(0, 0, 1, 80)]


def test_why_there_is_no_key(spark):
    pages = spark.createDataFrame([(d, 1, 1) for d in (1, 2, 3)], "doc_id long, page int, last_page int")
    text = [(1, 1, "a" * 101), (2, 1, " " * 50 + "a" * 100), (3, 5, "a" * 101), (2, 6, "a" * 101)]
    lines = spark.createDataFrame([(d, p, i, 0.0, 9.0, 0.0, 9.0, t) for i, (d, p, t) in enumerate(text)], "doc_id long, page int, seq long, y_top double, y_bottom double, x_left double, x_right double, text string")
    keys = lambda *r: spark.createDataFrame([(d, 1, "A") for d in r], "doc_id long, num int, letter string")
    found = lambda **s: {r["doc_id"]: (r["verdict"], r["n_model"]) for r in apply("d_key_diagnosis", s, paper_pages=pages, lines=lines, document_keys=keys(1), model_key=keys(1, 2, 2)).collect()}
    assert found() == {1: ("found", 0), 2: ("a scan, and no model", 0), 3: ("text without a key", 0)}
    assert found(ask_model=1) == {1: ("found", 0), 2: ("a scan, left to the model", 2), 3: ("text without a key", 0)}
    assert found(ask_model=1, model_ready=0)[2] == ("a scan, and no model", 0)
    assert {v for v, _ in found(sheet_wanted=0).values()} == {"sheets are off"}


def test_lists_of_reports(spark):
    n = 25
    geom = spark.createDataFrame([(1, p, 500.0 + p % 6, 800.0) for p in range(1, n + 1)], "doc_id long, page int, width double, height double")
    fonts = spark.createDataFrame([(1, 1, f"F{k}") for k in (*range(9), 0)], "doc_id long, page int, basefont string")
    images = spark.createDataFrame([(1, 1, k) for k in range(203)], "doc_id long, page int, image_id long")
    gaps = spark.createDataFrame([(1, s, k) for s in (True, False) for k in range(20, 0, -1)], "doc_id long, is_solution boolean, num long")
    key = spark.createDataFrame([(1, k) for k in range(30)], "doc_id long, num long")
    got = apply("f_report_caps", page_geom=geom, fonts=fonts, page_images=images, g_number_gaps=gaps, c_key_minus_found=key).collect()
    lists = {}
    for r in sorted(got, key=lambda r: r["place"]):
        lists.setdefault(r["kind"], []).append(r["value"])
    assert {k: len(v) for k, v in lists.items()} == {"font": 6, "size": 20, "distinct size": 4, "image": 200, "solution gap": 8, "question gap": 8, "key gap": 10}
    assert lists["question gap"] == [str(k) for k in range(1, 9)] and lists["distinct size"] == ["500x800", "501x800", "502x800", "503x800"]


def test_uploads_from_files(spark, tmp_path):
    from sheafline.sources.tables import read_uploads, upload_heads

    for name, content in {"a": b"%PDF-1.7", "b": b"GIF89a..", "c": b"%PDF-1.4 broken", "d": b"", "e": b"%PDF" + b"x" * 100, "f": b"GIF8" + b"x" * 100, "g": b"%PDF-many"}.items():
        (tmp_path / name).write_bytes(content)
    uploads = read_uploads(spark, str(tmp_path))  # without the empty file
    at = {r["path"].rsplit("/", 1)[1]: r["path"] for r in uploads.collect()}
    pages = spark.createDataFrame([(at["a"], 1), (at["a"], 1), (at["a"], 2), (at["b"], 1), (at["e"], 1), *[(at["g"], p) for p in range(3)]], "path string, page int")
    got = apply("a_validate_files", {"most_bytes": 100, "most_pages": 2}, file_heads=upload_heads(uploads, pages)).collect()
    assert {r["idx"].rsplit("/", 1)[1]: r["reason"] for r in got} == {"a": None, "b": "not a PDF", "c": "not a PDF", "e": "too large", "f": "too large", "g": "too many pages"}
