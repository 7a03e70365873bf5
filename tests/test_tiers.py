"""Tiers on literal documents: which is kept, and which pages each detector is asked for."""

from sheafline.operators import tiers

PAGE = "doc_id long, page int, class string, conf double"


class Detectors:
    """Stand-ins that give out the items of a table and write down the pages they were asked for."""

    def __init__(self, spark, **items):
        self.spark, self.asked, self.calls = spark, {}, {}
        for tier, rows in items.items():
            self.calls[tier] = self.detector(tier, rows)

    def detector(self, tier, rows):
        table = self.spark.createDataFrame([(d, i, 0, str(n), sol, p, 10.0, 20.0, float(x), x + 40.0) for i, (d, p, n, sol, x) in enumerate(rows, 1)], tiers.SEGMENT)

        def run(pages):
            self.asked[tier] = self.asked.get(tier, []) + sorted((r["doc_id"], r["page"]) for r in pages.collect())
            return table.join(pages.select("doc_id", "page"), ["doc_id", "page"], "left_semi").select(table.columns)

        return run

    def kept(self, pages, **settings):
        got = tiers.detected(self.spark.createDataFrame(pages, PAGE), self.calls, settings).collect()
        return sorted({(r["doc_id"], r["tier"], r["q_num"], r["page"]) for r in got})


def run_of(doc, numbers, per_page=1, x=5):
    return [(doc, 1 + k // per_page, n, False, x) for k, n in enumerate(numbers)]


def test_a_confident_text_layer_asks_no_other(spark):
    d = Detectors(spark, text=run_of(1, [1, 2, 3, 4]), ocr=run_of(1, [1, 2]), local=run_of(1, [1]), model=run_of(1, range(1, 9)))
    assert {t for _, t, *_ in d.kept([(1, p, "text", 90.0) for p in range(1, 5)])} == {"text"}
    assert [d.asked[t] for t in ("ocr", "local", "model")] == [[], [], []] or all(not v for t, v in d.asked.items() if t != "text")


def test_each_later_tier_is_asked_for_what_failed_before(spark):
    """1: good text. 2: text with holes, good OCR. 3: a scan whose weak page alone is read again. 4: nothing but the model."""
    pages = [(1, p, "text", 90.0) for p in (1, 2)] + [(2, p, "text", 90.0) for p in (1, 2, 3)] + [(3, p, "ocr", 40.0 if p == 2 else 90.0) for p in (1, 2, 3, 4)] + [(4, 1, "ocr", 0.0), (4, 2, "ocr", 90.0)]
    d = Detectors(
        spark, text=[*run_of(1, [1, 2]), *run_of(2, [1, 9, 17])], ocr=[*run_of(2, [1, 2, 3]), *run_of(3, [1, 7, 30, 40])], local=[],
        model=[*run_of(3, [1, 2, 3, 4]), *run_of(4, [1, 2])],
    )
    got = d.kept(pages)
    assert {(doc, t) for doc, t, *_ in got} == {(1, "text"), (2, "ocr"), (3, "kept"), (3, "repaired"), (4, "model")}
    assert [x for x in got if x[0] == 3] == [(3, "kept", "1", 1), (3, "kept", "30", 3), (3, "kept", "40", 4), (3, "repaired", "2", 2)]
    assert set(d.asked["text"]) == {(1, 1), (1, 2), (2, 1), (2, 2), (2, 3)}
    assert {doc for doc, _ in d.asked["ocr"]} == {2, 3, 4} and {doc for doc, _ in d.asked["local"]} == {3, 4}
    assert sorted(d.asked["model"]) == [(3, 2), (4, 1), (4, 2)]


def test_without_a_model_the_gate_is_the_lenient_one(spark):
    d = Detectors(spark, text=run_of(1, [1, 9, 17]), ocr=run_of(1, [1, 2, 3]))
    assert {t for _, t, *_ in d.kept([(1, p, "text", 90.0) for p in (1, 2, 3)])} == {"text"}


def test_half_an_item_a_page_suffices(spark):
    pages = [(1, p, "ocr", 90.0) for p in (1, 2, 3, 4)]
    assert {t for _, t, *_ in Detectors(spark, ocr=run_of(1, [1, 2]), local=run_of(1, [1, 2, 3])).kept(pages)} == {"ocr"}
    assert {t for _, t, *_ in Detectors(spark, ocr=run_of(1, [1]), local=run_of(1, [1, 2, 3])).kept(pages)} == {"local"}


def test_a_model_asked_first_is_the_only_one(spark):
    d = Detectors(spark, text=run_of(1, [1, 2]), ocr=[], model=run_of(1, [1, 2]))
    assert {t for _, t, *_ in d.kept([(1, 1, "text", 90.0), (1, 2, "text", 90.0)], prefer_model=1)} == {"model"}
    empty = Detectors(spark, text=run_of(1, [1, 9]), ocr=[], model=[])
    assert {t for _, t, *_ in empty.kept([(1, 1, "text", 90.0), (1, 2, "text", 90.0)], prefer_model=1)} == {"text"}
    assert empty.asked["model"] == [(1, 1), (1, 2)]


def test_pictures_among_text_pages_are_read_by_ocr(spark):
    """Page 2 is a picture; page 3 has both and its text two columns, so OCR isn't asked; page 4 has both and no items."""
    pages = [(1, 1, "text", 90.0), (1, 2, "ocr", 90.0), (1, 3, "text_then_ocr", 90.0), (1, 4, "text_then_ocr", 90.0)]
    text = [(1, 1, 1, False, 5), (1, 1, 2, False, 5), (1, 3, 4, False, 5), (1, 3, 5, False, 55)]
    d = Detectors(spark, text=text, ocr=[(1, 2, 3, False, 5), (1, 3, 9, False, 5), (1, 4, 6, False, 5)])
    assert d.kept(pages) == [(1, "ocr", "3", 2), (1, "ocr", "6", 4), (1, "text", "1", 1), (1, "text", "2", 1), (1, "text", "4", 3), (1, "text", "5", 3)]
    assert sorted(set(d.asked["ocr"])) == [(1, 2), (1, 4)]
