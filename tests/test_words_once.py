"""Columns from words: alike extents are one counted row, a word is moved once, and words without a place stay."""

import os

from sheafline.catalog import apply
from sheafline.staging import staged

SCHEMA = "doc_id long, page int, seq long, pos long, word string, conf double, x0 double, x1 double, y0 double, y1 double, block int, par int, line int"


def words(spark, page=1):
    rows = [(1, page, i, p, f"w{p}", 90.0, 10.0 * p + (300 if p > 4 else 0), 10.0 * p + 9 + (300 if p > 4 else 0), 20.0 * i, 20.0 * i + 9, 1, 1, i) for i in range(6) for p in range(10)]
    return spark.createDataFrame(rows, SCHEMA)


def test_extents_are_counted(spark):
    got = apply("word_extents", words=words(spark)).collect()
    assert len(got) == 10 and {r["k"] for r in got} == {6}


def test_words_go_to_their_columns(spark):
    got = apply("word_column_of", words=words(spark)).collect()
    assert len(got) == 60 and all(r["col"] == int(r["pos"] > 4) for r in got)
    assert {r["text"] for r in apply("d_words_to_lines", words=words(spark)).collect()} == {"w0 w1 w2 w3 w4", "w5 w6 w7 w8 w9"}


def test_words_without_a_page_stay(spark):
    got = apply("word_column_of", words=words(spark, None)).collect()
    assert len(got) == 60 and {r["col"] for r in got} == {0}


def test_intermediate_tables_are_packed(spark):
    assert all(".zstd" in f for f in os.listdir(staged(spark.range(3), "packed").staged_path) if f.endswith(".parquet"))
