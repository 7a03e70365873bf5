"""Pictures and label files of one stem: every pair of them is a row."""

from sheafline.catalog import apply


def test_every_pair_is_a_row(spark):
    names = [f"a.{x}" for x in ("jpg", "PNG", "png", "txt", "xml")] * 20 + ["b.jpg", "c.txt", "d", "d.jpg", "e.f.jpg", "e.f.txt", None]
    files = [*enumerate(names), (None, "d.png")]
    got = apply("c_label_pairs", files=spark.createDataFrame(files, "idx long, original string")).collect()
    stem = lambda n: n.rsplit(".", 1)[0]
    image = lambda n: n.lower().endswith((".jpg", ".png"))
    named = [(i, n) for i, n in files if n]
    want = [(i, j, stem(a)) for i, a in named for j, b in named if image(a) and not image(b) and stem(a) == stem(b)]
    assert len(want) == 60 * 40 + 3
    assert sorted(map(str, got)) == sorted(f"Row(image={i}, label={j}, stem={s!r})" for i, j, s in want)
