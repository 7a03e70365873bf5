"""All registered layout queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from . import relations
from .operators import answers, folds, itemising, languages, noise, reviewing, tagging, tiers  # noqa: F401
from .plans import fixtures  # noqa: F401
from .sources import json, tables  # noqa: F401
from .streaming import jobs

apply = relations.apply
FLAGSHIP = "d_segments"


def _query(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.frame(spark, sf_dir, name)


#: Operators have names such as b_tag_markers; other relations are inputs.
NAMES = [n for n in relations.RELATIONS if n[1] == "_"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: partial(_query, n) for n in NAMES} | jobs.QUERIES
ORACLES: dict[str, str] = {n: sql for n in NAMES if (sql := relations.oracle(n))} | jobs.ORACLES
