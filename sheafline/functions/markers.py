"""Marker rules as column expressions, for callers with their own pattern or style."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed as fx


def usable_pattern(pattern: str | None) -> str | None:
    """The pattern, if it is one; a bad one is ignored."""
    if not pattern:
        return None
    try:
        re.compile(pattern)
    except re.error:
        return None
    return pattern


def _number(c: Column) -> Column:
    stripped = F.regexp_replace(c, r"^0+(?=.)", "")
    return F.when(c != "", stripped)


def marker(text: Column, style: str = "auto", pattern: str | None = None) -> Column:
    """struct(q_num, is_strong), or null where text opens no item. A user's pattern comes first and counts as strong."""
    t = F.trim(text)
    strong = F.regexp_extract(t, fx.STRONG, 1)
    formula = t.rlike(r"^q\d") | (t.rlike(r"^[Qq]\d+(?:\s|$)") & t.rlike(r"[=+*-]"))
    q = _number(F.when(~formula, strong).otherwise(F.lit("")))
    dot, paren, opened = (F.regexp_extract(t, p, 1) for p in (fx.WEAK_DOT, fx.WEAK_PAREN, fx.WEAK_OPEN))
    weak = _number(F.when(dot != "", dot).when((paren != "") & t.rlike(r"\p{L}"), paren).otherwise(opened))
    found = F.lit(None).cast("struct<q_num: string, is_strong: boolean>")
    if style != "q":
        found = F.when(weak.isNotNull(), F.struct(weak.alias("q_num"), F.lit(False).alias("is_strong")))
    if style != "numbered":
        found = F.when(q.isNotNull(), F.struct(q.alias("q_num"), F.lit(True).alias("is_strong"))).otherwise(found)
    own = usable_pattern(pattern)
    if own:
        whole = f"(?i)^(?:{own})"
        value = _number(F.trim(F.regexp_extract(t, whole, 1 if re.compile(own).groups else 0)))
        found = F.when(t.rlike(whole), F.struct(value.alias("q_num"), F.lit(True).alias("is_strong"))).otherwise(found)
    return F.when(t != "", found)


def tag_markers(lines: DataFrame, style: str = "auto", pattern: str | None = None) -> DataFrame:
    """lines (with text) that open an item, with q_num and is_strong."""
    return lines.withColumn("__m", marker(F.col("text"), style, pattern)).filter("__m.q_num IS NOT NULL").select(*lines.columns, "__m.q_num", "__m.is_strong")
