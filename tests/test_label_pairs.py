"""Pictures and label files of one stem: a row a file, from which every pair follows."""

from sheafline.relations import apply


def test_rows_grow_with_files_and_give_every_pair(spark):
    names = [f"a.{x}" for x in ("jpg", "PNG", "png", "txt", "xml")] * 20 + ["b.jpg", "c.txt", "d", "d.jpg", "e.f.jpg", "e.f.txt", None]
    df = spark.createDataFrame(list(enumerate(names)), "idx long, original string")
    got = apply("c_label_pairs", files=df).collect()
    assert len(got) <= len(names)
    kinds = {k: {(r["stem"], r["idx"]) for r in got if r["is_image"] is k} for k in (True, False)}
    stem = lambda n: n.rsplit(".", 1)[0]
    image = lambda n: n.lower().endswith((".jpg", ".png"))
    files = [(i, n) for i, n in enumerate(names) if n]
    want = {(i, j) for i, a in files for j, b in files if image(a) and not image(b) and stem(a) == stem(b)}
    assert {(i, j) for s, i in kinds[True] for t, j in kinds[False] if s == t} == want
    of = {r["stem"]: (r["image"], r["label"], r["n_images"], r["n_labels"]) for r in got}
    assert of == {"a": (0, 3, 60, 40), "d": (103, 102, 1, 1), "e.f": (104, 105, 1, 1)}
