"""Staged tables are broadcast by their rows, not by their files, which may be some hundred times smaller."""

import re

from sheafline import catalog, relations, staging  # noqa: F401
from sheafline.staging import bytes_of, counted, staged


def broadcasts(df) -> int:
    return len(re.findall(r"BroadcastHashJoin|BroadcastExchange", df._jdf.queryExecution().sparkPlan().toString()))


def test_many_alike_rows_are_merged(spark):
    many = staged(spark.range(1_000_000).selectExpr("id div 1000 AS doc_id", "CAST(id div 100 AS INT) AS page", "1D AS y"), "alike")
    few = staged(spark.range(100).selectExpr("id AS doc_id", "2D AS z"), "few")
    limit = int(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())
    assert bytes_of(many) < limit  # by its files it would be broadcast
    assert broadcasts(many.alias("a").join(many.alias("b"), "doc_id")) and not broadcasts(counted(many).join(counted(many), "doc_id"))
    assert broadcasts(counted(many).join(many.limit(1), "doc_id")) == 0 and broadcasts(counted(few).join(few.withColumnRenamed("z", "w"), "doc_id"))


def test_chain_gathers_no_large_table(spark, monkeypatch):
    """With no table counted as few, no step of the marker chain is planned with a broadcast of a staged table or of a query over one."""
    monkeypatch.setattr(staging, "HELD", -1)
    planned = {}

    def kept(df, label, of=()):
        planned[label] = broadcasts(df)
        return staged(df, label, of)

    monkeypatch.setattr(relations, "staged", kept)
    made = {}
    for name in ("d_segments", "c_assign_lines", "e_section_cutoff"):
        planned[name] = broadcasts(relations.frame(spark, "/root/testdata/sf0.001", name, made))
    assert {"e_row_top", "d_find_furniture", "d_validate_columns"} <= set(planned) and not any(planned.values()), planned
