"""The words of a page's arrays are those of its lines, in order, and no word is moved by itself."""

from sheafline.catalog import apply
from sheafline.relations import RELATIONS
from tests.support import rows

LINE = "doc_id long, page int, seq long, y_top double, y_bottom double, x_left double, x_right double, text string"


def test_words_of_lines(spark):
    texts = ["a b  c", " d", "e", None, "x " * 14]
    df = spark.createDataFrame([(1, 1 + i // 3, 20 - i, 8.0 * i, 8.0 * i + 7, 32.0, 288.0, t) for i, t in enumerate(texts)], LINE)
    want = apply("words", lines=df).filter("trim(word) <> '' AND conf >= 0 AND pos <> 11").selectExpr("doc_id", "page", "seq", "pos", "word", "conf", "CAST(x0 AS INT) AS x0", "CAST(y0 AS INT) AS y0")
    assert rows(apply("a_words_from_ocr", lines=df)) == rows(want)
    assert RELATIONS["ocr_json"].inputs() == ["lines"]
