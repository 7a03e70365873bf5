"""What the marker chain reads and writes: texts go no further than they are needed, with the same rows."""

from sheafline.operators.itemising import _NUMBERS
from sheafline.relations import RELATIONS, SHARED, _run, _spelled, apply
from tests.support import rows


def test_lines_are_read_once_for_numbers(spark):
    texts = ["2O. x", "..12) y", "1.2 z", "Q1 a", "123", "1234 b", "a.", "S)", "7:", None, "", "-B- c", "5 - d", "12\tx", "I2", ".)(3"]
    df = spark.createDataFrame([(1, 1, i, 1.0 * i, 0.0, 9.0, t) for i, t in enumerate(texts)], "doc_id long, page int, seq long, y_top double, x_left double, x_right double, text string")
    got = apply("line_numbers", e_section_state=df)
    want = _run(spark, _spelled(_NUMBERS, 0), {"e_section_state": df})  # the rule as it stands in SQL, three readings of the text
    assert rows(got) == rows(want)
    assert {(0, 20), (1, 12), (4, 123), (8, 7), (12, 5), (13, 12), (14, 12)} <= {(r["seq"], r["num"]) for r in got.collect()}
    assert RELATIONS["line_numbers"].spark.count("FROM {e_section_state}") == 1


def test_furniture_is_judged_without_texts():
    assert "furniture_keys" in SHARED and "content_lines" not in SHARED
    assert RELATIONS["d_find_furniture"].inputs() == ["page_lines", "furniture_keys"]
    assert RELATIONS["d_find_furniture"].inputs(RELATIONS["d_find_furniture"].other) == ["b_tag_headers", "b_tag_markers", "page_lines"]
