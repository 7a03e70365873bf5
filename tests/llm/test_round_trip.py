"""The pipeline's last stage decodes what it has encoded."""

from sheafline.llm.pipeline_stages import encode


def test_ids_are_decoded_again(spark):
    texts = ["a b  c", "", None, "\u2581x\n\n  y", "\u20ac \U0001f600", "a b  c"]
    docs = spark.createDataFrame([(i, t, "en", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, n_chars long")
    got = {r["doc_id"]: r for r in encode(spark, docs, "").collect()}
    assert len(got) == 6 and all(r["round_trip"] for r in got.values())
    assert got[2]["ids"] is None and got[1]["ids"] == [] and got[0]["ids"] == got[5]["ids"]
