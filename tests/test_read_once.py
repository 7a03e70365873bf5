"""What is parsed, moved or grouped once: plans of a_boxes_from_model_json and d_snap_boxes, and odd values in both."""

from sheafline.catalog import apply

LETTER = "doc_id long, page int, scale double, pad_x double, pad_y double, width double, height double"
LINES = "doc_id long, page int, seq long, y0 double, y1 double, x0 double, x1 double, text string"
BOXES = "doc_id long, page int, box_id long, label string, score double, x0 double, x1 double, y0 double, y1 double"


def test_answers_parsed_once(spark):
    raws = [
        '[{"label":"question","box":{"xmin":0.1,"ymin":0.2,"xmax":0.5,"ymax":0.9}}]', '{"boxes":[{"box":[10,20,30]},{"box":[10,20,30,40]},{"score":"n/a"}]}',
        '{"boxes":[{"x1":"?","y1":1,"x2":90,"y2":90},{"x1":"40","y1":80,"x2":200,"y2":"4e2","score":" 0.5 "}]}', '{"boxes":[{"y_start_pct":5,"y_end_pct":"x"},{"y_start_pct":5,"y_end_pct":25,"page":"1.0"}]}', "none", None,
    ]
    raw = spark.createDataFrame([(1, 1, i, r) for i, r in enumerate(raws)], "doc_id long, page int, box_id long, raw string")
    got = apply("a_boxes_from_model_json", box_json=raw, letterboxes=spark.createDataFrame([(1, 1, 1.0, 0.0, 0.0, 400.0, 800.0)], LETTER))
    assert sorted((r["box_id"], r["score"], r["x0"], r["y0"], r["x1"], r["y1"]) for r in got.collect()) == [
        (0, 1.0, 10.0, 20.0, 50.0, 90.0), (1, 1.0, 10.0, 20.0, 30.0, 40.0), (2, 0.5, 10.0, 10.0, 50.0, 50.0), (3, 1.0, 0.0, 5.0, 100.0, 25.0)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("from_json(") <= 4


def test_boxes_are_not_grouped(spark):
    boxes = spark.createDataFrame([(1, 1, 1, "question", 1.0, 10.0, 60.0, 10.0, 40.0), (1, 1, 2, "question", 1.0, 70.0, 90.0, 10.0, 40.0), (2, 1, 1, "question", 1.0, 0.0, 9.0, 0.0, 9.0)], BOXES)
    lines = spark.createDataFrame([(1, 1, 0, 12.0, 14.0, 12.0, 50.0, "a"), (1, 1, 1, 20.0, 22.0, 12.0, 40.0, "b"), (1, 2, 2, 20.0, 22.0, 12.0, 40.0, "c"), (1, 1, 3, 30.0, 31.0, None, 40.0, "d")], LINES)
    got = apply("d_snap_boxes", boxes=boxes, lines_pct=lines)
    assert sorted((r["doc_id"], r["box_id"], r["x1"], round(r["y0"], 6), r["y1"]) for r in got.collect()) == [(1, 1, 50.8, 11.2, 22.8), (1, 2, 90.0, 10.0, 40.0), (2, 1, 9.0, 0.0, 9.0)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftOuter") < plan.index("Aggregate")  # lines are grouped below the join, boxes nowhere
