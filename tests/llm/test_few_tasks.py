"""Small tables are written by few tasks and joined without a shuffle, however many partitions a shuffle has."""

import glob

from pyspark.sql import functions as F

from sheafline.llm import bottom_k
from sheafline.llm.common import components
from sheafline.staging import PARTS, run_folder

MANY = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}


def files(folder, label):
    return [len(glob.glob(f"{d}/part-*")) for d in glob.glob(f"{folder.removeprefix('file://')}/{label}-*")]


def test_few_files(spark):
    before = {k: spark.conf.get(k) for k in MANY}
    words = [" ".join(f"w{(i // 3) * 40 + j}" for j in range(40)) for i in range(300)]
    rows = [(i, w if i % 3 else w + " more") for i, w in enumerate(words)]
    try:
        for k, v in MANY.items():
            spark.conf.set(k, v)
        with run_folder(spark) as folder:
            docs = spark.createDataFrame(rows, "doc_id long, text string")
            kept = sorted(r["doc_id"] for r in bottom_k.representatives(docs).select("doc_id").collect())
            assert kept == [i for i in range(300) if i % 3 == 0]
            for label in ("bottomk-labels", "bottomk-roots"):
                assert files(folder, label) and max(files(folder, label)) <= PARTS, label
        with run_folder(spark) as folder:
            chain = spark.range(400).select(F.col("id").alias("a"), F.when(F.col("id") == 199, 199).otherwise(F.col("id") + 1).alias("b"))
            got = {r["node"]: r["root"] for r in components(chain, "chain").collect()}
            assert got == {i: 0 if i < 200 else 200 for i in range(401)}
            assert max(files(folder, "chain")) <= PARTS
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
