"""Named relations: each operator is a query over other relations, which a caller may replace with tables of its own.

An operator's text is SQL with its inputs in braces. Spark runs it on DataFrames (as temporary views), so
Catalyst sees one plan from the scan to the result. The few words that SQL dialects spell differently are written in
capitals (see DIALECT); the second spelling is only for checking results against another engine.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .staging import counted, staged

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: word: (Spark, other engine)
DIALECT = {
    "LIKE_RE(": ("regexp_like(", "regexp_matches("),
    "EXTRACT_ALL(": ("regexp_extract_all(", "regexp_extract_all("),
    "/*G*/": ("", ", 'g'"),
    "BROUND(": ("bround(", "round_even("),
    "COLLECT(": ("collect_list(", "list("),
    "COLLECT_SET(": ("collect_set(", "list(DISTINCT "),
    "ASORT(": ("array_sort(", "list_sort("),
    "AJOIN(": ("array_join(", "array_to_string("),
    "ADISTINCT(": ("array_distinct(", "list_distinct("),
    "SIZE(": ("size(", "len("),
    "NTH(": ("element_at(", "list_extract("),
    "MOST(": ("array_max(", "list_max("),
    "VALUES_OF(": ("array(", "list_value("),
    "EXPLODE(": ("explode(", "unnest("),
    "SEQ(": ("sequence(", "generate_series("),
    "STRUCT(": ("struct(", "row("),
    "LASTNN(": ("last(", "last_value("),
    " NN)": (", true)", " IGNORE NULLS)"),
    "SPLIT(": ("split(", "regexp_split_to_array("),
    "EPOCH(": ("unix_timestamp(", "epoch("),
}


@dataclass(frozen=True)
class Relation:
    name: str
    doc: str
    spark: str
    other: str | None
    build: Callable[..., DataFrame] | None = None

    def inputs(self, text: str | None = None) -> list[str]:
        return list(dict.fromkeys(re.findall(r"\{([a-z]\w*)\}", self.spark if text is None else text)))


RELATIONS: dict[str, Relation] = {}
#: Relations that several steps of one plan read; they are written once to the shared folder and read from there, so
#: that a step's plan stays small, its inputs' sizes are known, and a lost executor costs one step.
SHARED: set[str] = set()


#: Values that a caller may set, with their defaults; an operator's text names them as $(name).
SETTINGS: dict[str, str | int | float] = {}


def _set(text: str, i: int, own: dict[str, str | int | float]) -> str:
    """text with its settings as literals of engine i."""

    def literal(m: re.Match) -> str:
        v = own.get(m[1], SETTINGS[m[1]])
        if not isinstance(v, str):
            return repr(v)
        return "'" + (v.replace("\\", "\\\\").replace("'", "\\'") if i == 0 else v.replace("'", "''")) + "'"

    return re.sub(r"\$\((\w+)\)", literal, text)


def _spelled(text: str, i: int) -> str:
    """text in the words of engine i. `/*M a, b*/ ` behind SELECT has Spark merge a and b, queries named by WITH, which hints of tables within do not leave."""
    text = re.sub(r"/\*M ([\w, ]+)\*/ ", "" if i else r"/*+ MERGE(\1) */ ", text)
    for word, forms in DIALECT.items():
        text = text.replace(word, forms[i])
    return re.sub(r"\br'", "'", text) if i else text


def relation(name: str, doc: str, sql: str, spark: str | None = None, other: str | None = None, exact: bool = True) -> None:
    """Register an operator. `spark` and `other` replace `sql` for one engine; exact=False: no other engine can run it."""
    _register(Relation(name, doc, _spelled(spark or sql, 0), _spelled(other or sql, 1) if exact else None))


def _register(r: Relation) -> None:
    if r.name in RELATIONS:
        raise ValueError(f"two relations are called {r.name}")
    RELATIONS[r.name] = r


def built(name: str, doc: str, inputs: list[str], build: Callable[..., DataFrame], other: str | None = None) -> None:
    """Register an operator written with DataFrame functions, which takes its inputs in order."""
    text = " ".join(f"{{{x}}}" for x in inputs)
    _register(Relation(name, doc, text, _spelled(other, 1) if other else None, build))


def _run(spark: SparkSession, text: str, args: dict[str, DataFrame]) -> DataFrame:
    """The query over args. Regular expressions have braces too, so frames are named by views, gone once it is analysed."""
    views = {x: f"{x}_{uuid.uuid4().hex}" for x in args}
    for x, df in args.items():
        df.createOrReplaceTempView(views[x])
    try:
        return spark.sql(re.sub(r"\{([a-z]\w*)\}", lambda m: views[m[1]], text))
    finally:
        for v in views.values():
            spark.catalog.dropTempView(v)


def frame(
    spark: SparkSession, sf_dir: str, name: str, given: dict[str, DataFrame] | None = None, settings: dict[str, str | int | float] | None = None
) -> DataFrame:
    """The relation `name` over the tables of sf_dir, with the frames in `given` in place of relations of their names."""
    made = {} if given is None else given
    if name not in made:
        if name in RELATIONS:
            r = RELATIONS[name]
            args = {x: frame(spark, sf_dir, x, made, settings) for x in r.inputs()}
            made[name] = r.build(*args.values()) if r.build else _run(spark, _set(r.spark, 0, settings or {}), args)
            if name in SHARED:
                made[name] = counted(staged(made[name], name))
        elif name in TABLES:
            made[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        else:
            raise KeyError(name)
    return made[name]


def apply(name: str, settings: dict[str, str | int | float] | None = None, **inputs: DataFrame) -> DataFrame:
    """The operator `name` on the caller's own tables; every table it needs, directly or not, must follow from `inputs`."""
    spark = next(iter(inputs.values())).sparkSession
    return frame(spark, "", name, dict(inputs), settings)


def oracle(name: str) -> str | None:
    """One statement for the other engine, with each relation as a common table expression."""
    order: list[str] = []

    def visit(n: str) -> bool:
        if n in TABLES or n in order:
            return True
        r = RELATIONS[n]
        if r.other is None or not all(visit(x) for x in r.inputs(r.other)):
            return False
        order.append(n)
        return True

    if not visit(name):
        return None
    text = lambda n: re.sub(r"\{([a-z]\w*)\}", r"\1", _set(RELATIONS[n].other, 1, {}))
    ctes = ",\n".join(f"{n} AS MATERIALIZED (\n{text(n)}\n)" for n in order[:-1])
    return f"WITH {ctes}\nSELECT * FROM (\n{text(name)}\n) q" if ctes else text(name)
