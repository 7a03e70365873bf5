"""Key pairs a run of blanks apart, in Spark and in the other engine's text of the rule."""

import duckdb

from sheafline.operators.answers import _PAIR
from sheafline.relations import RELATIONS, apply

TEXTS = ["60-B  61-A  62-D  64-B", "1. (a)   2. (b) 3)c , 4 - D", "7 A;;8 B||9 C", "1-B )2-A", "5-C ) 6-D", " 12 b\t\t13 (C )  14-a", "Q.3-A  Q4 b", "1-A2-B"]


def test_pairs_after_runs_of_separators(spark):
    assert "(?=" not in _PAIR
    data = [(1, i, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(data, "doc_id long, seq long, text string")
    mine = sorted(tuple(r) for r in apply("key_text_pairs", key_lines=df).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE key_lines (doc_id BIGINT, seq BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO key_lines VALUES (?, ?, ?)", data)
    other = sorted(tuple(r) for r in con.execute(RELATIONS["key_text_pairs"].other.replace("{key_lines}", "key_lines")).fetchall())
    assert [(n, x) for _, s, _, n, x in mine if s == 0] == [(60, "B"), (61, "A"), (62, "D"), (64, "B")]
    assert mine == other
