"""Reading files and writing results, each read back by its query so that what was written is what is checked."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..relations import built, relation
from ..staging import shared_dir


def _place(df: DataFrame, name: str) -> str:
    return f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """(path, head, bytes) of the files under path; only the first bytes of the content are kept. Spark lists no empty files, so these have no row."""
    return spark.read.format("binaryFile").load(path).select("path", F.substring("content", 1, 4).cast("string").alias("head"), F.col("length").alias("bytes"))


def upload_heads(uploads: DataFrame, pages: DataFrame) -> DataFrame:
    """The input of a_validate_files (idx is the path) from read_uploads and a table (path, page) of the pages that a reader could open."""
    counted = pages.groupBy("path").agg(F.countDistinct("page").alias("pages"))
    return uploads.join(counted.hint("merge"), "path", "left").select(F.col("path").alias("idx"), "head", "bytes", "pages")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Files of a JSON-lines manifest (pos, stored, original), pictures only, in order of arrival."""
    rows = spark.read.schema("pos long, stored string, original string").json(path)
    return rows.filter(F.lower(F.regexp_extract("original", r"\.([^.]*)$", 1)).isin("jpg", "jpeg", "png", "webp"))


def manifest(files: DataFrame) -> DataFrame:
    path = _place(files, "manifest")
    files.select(F.col("idx").alias("pos"), F.format_string("f%06d", "idx").alias("stored"), "original").write.json(path)
    return read_manifest(files.sparkSession, path)


def write_answer_sheet(answers: DataFrame, path: str) -> None:
    """The answers of documents that have any, as CSV and as JSON with counts."""
    some = answers.withColumn("any", F.max(F.expr("answer <> ''")).over(_by_doc())).filter("any").drop("any")
    some.write.option("header", True).csv(f"{path}/csv")
    some.groupBy("doc_id").agg(F.count("*").alias("count"), F.count_if(F.col("answer") != "").alias("answered"), F.sort_array(F.collect_list(F.struct("num", "answer"))).alias("answers")).write.json(f"{path}/json")


def _by_doc():  # noqa: ANN202
    from pyspark.sql import Window

    return Window.partitionBy("doc_id")


def answer_sheet(answers: DataFrame) -> DataFrame:
    path = _place(answers, "sheet")
    write_answer_sheet(answers, path)
    spark = answers.sparkSession
    rows = spark.read.option("header", True).schema("doc_id long, num int, answer string").csv(f"{path}/csv").withColumn("answer", F.coalesce("answer", F.lit("")))
    sums = spark.read.schema("doc_id long, count long, answered long").json(f"{path}/json")
    return rows.join(sums, "doc_id").select("doc_id", "num", "answer", "count", "answered")


def export_split(items: DataFrame) -> DataFrame:
    """Items in three archives: questions, solutions, and both."""
    path = _place(items, "export")
    side = items.withColumn("archive", F.when(F.col("is_solution"), "solutions").otherwise("questions"))
    side.unionByName(items.withColumn("archive", F.lit("combined"))).select("doc_id", "item", "q_num", "archive").write.partitionBy("archive").parquet(path)
    return items.sparkSession.read.parquet(path).select("doc_id", "item", "q_num", F.col("archive").cast("string").alias("archive"))


def rename_sheet(files: DataFrame) -> DataFrame:
    path = _place(files, "renames")
    files.select(F.expr("row_number() over (partition by batch order by idx)").alias("Serial Number"), F.format_string("slide_%03d", F.col("idx").cast("int")).alias("Slide Name"),
        F.lit("").alias("Solution URL"), F.lit("").alias("Custom Message"), "batch").write.option("header", True).csv(path)
    rows = files.sparkSession.read.option("header", True).csv(path)
    return rows.select(F.col("batch").cast("long").alias("batch"), F.col("Serial Number").cast("long").alias("serial"), F.col("Slide Name").alias("slide"))


def training_records(segments: DataFrame) -> DataFrame:
    path = _place(segments, "training")
    item = segments.groupBy("doc_id", "item").agg(F.first("is_solution").alias("is_solution"), F.sort_array(F.collect_list(F.struct("page", "y0", "y1", "x0", "x1"))).alias("segments"))
    item.select("doc_id", "item", F.when(F.col("is_solution"), "solution").otherwise("question").alias("label"), "segments").write.json(path)
    kind = "doc_id long, item long, label string, segments array<struct<page: int, y0: double, y1: double, x0: double, x1: double>>"
    return segments.sparkSession.read.schema(kind).json(path).select("doc_id", "item", "label", F.size("segments").cast("long").alias("n"), F.aggregate("segments", F.lit(0.0), lambda a, s: a + s["y1"] - s["y0"]).alias("extent"))


def label_export(segments: DataFrame) -> DataFrame:
    """One line for each box after its document and page, which are columns of the files: no folder for a document."""
    path = _place(segments, "labels")
    part = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c) / 100))
    x0, x1, y0, y1 = (part(c) for c in ("x0", "x1", "y0", "y1"))
    line = F.format_string("%d %.6f %.6f %.6f %.6f", F.col("is_solution").cast("int"), (x0 + x1) / 2, (y0 + y1) / 2, x1 - x0, y1 - y0)
    segments.filter((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))).select("doc_id", "page", line.alias("value")).write.option("sep", "\t").csv(path)
    return segments.sparkSession.read.option("sep", "\t").schema("doc_id long, page int, value string").csv(path)


built("a_manifest", "Pictures of a JSON-lines manifest in order of arrival.", ["files"], manifest,
    other=r"SELECT idx AS pos, printf('f%06d', idx) AS stored, original FROM {files} WHERE LIKE_RE(original, r'(?i)\.(jpg|jpeg|png|webp)$')")
built("a_answer_sheet_sink", "Answer sheets written as CSV and JSON.", ["c_answers_join"], answer_sheet,
    other="""SELECT doc_id, num, answer, count(*) OVER (PARTITION BY doc_id) AS count, count(CASE WHEN answer <> '' THEN 1 END) OVER (PARTITION BY doc_id) AS answered FROM {c_answers_join} WHERE doc_id IN (SELECT doc_id FROM {c_answers_join} WHERE answer <> '')""")
built("a_export_split_sink", "Items written to three archives.", ["items"], export_split,
    other="SELECT doc_id, item, q_num, CASE WHEN is_solution THEN 'solutions' ELSE 'questions' END AS archive FROM {items} UNION ALL SELECT doc_id, item, q_num, 'combined' FROM {items}")
built("a_rename_sheet_sink", "Sheets of new names with serial numbers.", ["files"], rename_sheet,
    other="SELECT batch, row_number() OVER (PARTITION BY batch ORDER BY idx) AS serial, printf('slide_%03d', idx) AS slide FROM {files}")
built("a_training_sink", "Training records as nested JSON.", ["segments"], training_records,
    other="SELECT doc_id, item, CASE WHEN bool_or(is_solution) THEN 'solution' ELSE 'question' END AS label, count(*) AS n, sum(y1 - y0) AS extent FROM {segments} GROUP BY doc_id, item")
built("a_label_export", "Detector labels as text, one line for each box with its document and page.", ["segments"], label_export,
    other="SELECT doc_id, page, printf('%d %.6f %.6f %.6f %.6f', is_solution::INT, (a0 + a1) / 2, (b0 + b1) / 2, a1 - a0, b1 - b0) AS value FROM (SELECT *, greatest(0, least(1, x0 / 100)) AS a0, greatest(0, least(1, x1 / 100)) AS a1, greatest(0, least(1, y0 / 100)) AS b0, greatest(0, least(1, y1 / 100)) AS b1 FROM {segments} WHERE x1 > x0 AND y1 > y0) s")
