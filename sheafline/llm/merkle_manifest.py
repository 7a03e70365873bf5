"""A Merkle manifest of a dataset: a digest for every row, subtree and the whole, and each row's proof.

H is the lowercase hex SHA-256 of its inputs' text, concatenated. Leaves of one group (lang) ascend by id; while more than
one node remains, each run of 8 consecutive ones becomes their H. Group roots, ordered by group, give the root alike.

A leaf's rank within its group, written in base 8, is DIGITS digits of its place in a block and the block's number. Grouping
by all but the last digit nests 8 leaves in a node, grouping that by all but the next nests 8 nodes, and so on: a block is
one row of nested structs, 8 ** DIGITS leaves at most. Blocks' digests are leaves of the next tier until each group is one
row; the group roots' tiers are the same with one group. On the way down a block's row meets the path above it by grouping,
and its structs are opened level by level, each child taking its siblings along, so proofs need no joins.

Ranks: rows are range partitioned by group and id, written, and numbered by their place in the written file; a table of
file counts gives each file's offset.

Defined cases: a null field counts as `-`; null ids come first and are never altered by the check; rows of one id are
ordered by their digests; repeated rows are leaves of their own; an empty table has no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, released, staged

FAN, DIGITS = 8, 3
BLOCK = FAN**DIGITS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def hashed(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def leaf_digest(fields: list[Column]) -> Column:
    """H of the fields, each `-` if null, else its length in bytes, a colon and its value."""
    texts = [c.cast("string") for c in fields]
    return hashed(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]))


def _ranked(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """rows (g, ...) with r, the rank from 0 within g by `order`, and n, the group's rows."""
    spark = rows.sparkSession
    own = staged(rows.withColumn("__tie", F.monotonically_increasing_id()), f"{label}-rows")  # splits rows that agree on the rest
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_first() for c in ("g", *order, "__tie")]
    spread = staged(own.repartitionByRange(n, *keys).sortWithinPartitions(*keys), f"{label}-spread")
    placed = spread.select(*rows.columns, F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__at"))
    counts = placed.groupBy("g", "__file").agg(F.count("*").alias("__c"), F.min("__at").alias("__first"), F.min(F.struct(*order)).alias("__o"))
    before = Window.partitionBy("g").orderBy("__o", "__file").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("__c").over(before), F.lit(0)) - F.col("__first")
    offsets = staged(counts.select("g", "__file", shift.alias("__shift"), F.sum("__c").over(Window.partitionBy("g")).alias("n")), f"{label}-offsets")
    offsets = offsets.withColumnsRenamed({"g": "__g", "__file": "__f"}).hint("broadcast" if offsets.count() <= BROADCAST_ROWS else "merge")
    both = placed.join(offsets, F.col("g").eqNullSafe(F.col("__g")) & (F.col("__file") == F.col("__f")))
    ranked = staged(both.select(*rows.columns, (F.col("__at") + F.col("__shift")).alias("r"), "n"), label)
    released(own, spread)
    return ranked


def _node(children: Column, several: Column) -> Column:
    """The digest of a run of nodes: their H, or the only node's own where its level has no other."""
    return F.when(several, hashed(F.array_join(F.transform(children, lambda x: x["h"]), ""))).otherwise(children[0]["h"])


def _level(n: Column, level: int) -> Column:
    """How many nodes a group of n leaves has at a level."""
    return F.ceil(n / F.lit(FAN**level))


def _nested(leaves: DataFrame) -> DataFrame:
    """A row (g, r, n, h, c) for each block of leaves (g, r, n, h, ...): r its number, n of blocks in g, c the nested structs."""
    own = [c for c in leaves.columns if c not in ("g", "r", "n")]
    digit = lambda i: F.pmod(F.floor(F.col("r") / FAN**i), F.lit(FAN)).cast("int").alias(f"d{i}")
    rows = leaves.select("g", "n", F.floor(F.col("r") / BLOCK).alias("block"), *map(digit, range(DIGITS)), F.struct(*own).alias("x"))
    rows = rows.repartition("g", "block")  # one shuffle: each grouping below has these among its keys
    for i in range(DIGITS):
        keys = ["g", "n", "block", *(f"d{j}" for j in range(i + 1, DIGITS))]
        run = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(f"d{i}").alias("d"), "x"))).alias("run"))
        c = F.transform("run", lambda y: y["x"])
        rows = run.select(*keys, c.alias("c")).select(*keys, F.struct(_node(F.col("c"), _level(F.col("n"), i) > 1).alias("h"), "c").alias("x"))
    return rows.select("g", F.col("block").alias("r"), _level(F.col("n"), DIGITS).alias("n"), "n", "x.h", "x.c").toDF("g", "r", "n", "leaves", "h", "c")


def _opened(blocks: DataFrame) -> DataFrame:
    """The leaves (g, r, n, leaf, path) of blocks (g, r, n, leaves, h, c, path): path.steps has one for each level, lowest first.

    A step is what stands before and after a node in its run. Levels of a single node have none.
    """
    rows = blocks.select("g", "r", F.col("leaves").alias("n"), "c", "path")
    for i in reversed(range(DIGITS)):
        several = _level(F.col("n"), i) > 1
        digests = F.transform("c", lambda x: x["h"])
        step = lambda at: F.struct(F.array_join(F.slice("hs", 1, at), "").alias("before"), F.array_join(F.slice("hs", at + 2, FAN), "").alias("after"))  # noqa: B023, E731
        placed = rows.withColumn("hs", digests).select("g", "r", "n", "path", F.explode(F.transform("c", lambda x, at: F.struct(at.alias("d"), x.alias("x"), step(at).alias("step")))).alias("y"))
        steps = F.when(several, F.concat(F.array("y.step"), F.col("path.steps"))).otherwise(F.col("path.steps"))
        path = F.struct("path.subroot", steps.alias("steps"))
        rows = placed.select("g", (F.col("r") * FAN + F.col("y.d")).alias("r"), "n", path.alias("path"), F.col("y.x").alias("x"))
        rows = rows.withColumn("c", F.col("x.c")).drop("x") if i else rows.withColumnRenamed("x", "leaf")
    return rows


_PATH = "struct<subroot: string, steps: array<struct<before: string, after: string>>>"


def _met(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    """blocks with the path of the row of paths (g, r, path) of the same group and number: two rows a group, no join."""
    kinds = dict(blocks.dtypes)
    above = paths.select("g", "r", *[F.lit(None).cast(kinds[c]).alias(c) for c in ("n", "leaves", "h", "c")], "path")
    both = blocks.withColumn("path", F.lit(None).cast(_PATH)).unionByName(above)
    value = lambda c: F.first(c, ignorenulls=True).alias(c)
    return both.groupBy("g", "r").agg(*map(value, ("n", "leaves", "h", "c", "path")))


def _tree(leaves: DataFrame, label: str) -> tuple[list[DataFrame], DataFrame]:
    """All tiers of blocks over leaves (g, r, n, h, ...), written, and the top one's (g, h): a root for each group."""
    tiers, largest = [], leaves.agg(F.max("n")).first()[0] or 0
    while True:
        tiers.append(staged(_nested(leaves), f"{label}-tier"))
        if largest <= BLOCK:
            return tiers, tiers[-1].select("g", "h")
        leaves, largest = tiers[-1].select("g", "r", "n", "h"), -(-largest // BLOCK)


def _proofs(tiers: list[DataFrame], above: DataFrame) -> DataFrame:
    """The leaves (g, r, n, leaf, path) of the lowest tier; above (g, path) holds the paths of the groups' roots."""
    paths = above.select("g", F.lit(0).cast("long").alias("r"), "path")
    for blocks in reversed(tiers):
        opened = _opened(_met(blocks, paths))
        paths = opened.select("g", "r", "path")
    return opened


def manifest(
    docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", id_col: str = "doc_id", text_col: str = "text", altered: Column | None = None
) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof, proof_sha256, folded_root, verified) of each row of docs.

    `proof` holds what stands before and after the node at each level, from leaf to root. Where `altered` is true the proof
    is folded from the leaf of a text whose A-Z are lower-cased, so `verified` shows whether tampering is found.
    """
    lowered = F.translate(F.col(text_col).cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    other = leaf_digest([lowered if f == text_col else F.col(f) for f in fields])
    changed = F.lit(False) if altered is None else F.coalesce(altered, F.lit(False))
    leaf = leaf_digest([F.col(f) for f in fields])
    leaves = docs.select(F.col(group).cast("string").alias("g"), F.col(id_col).alias("doc_id"), leaf.alias("h"), F.when(changed, other).alias("t"))
    tiers, subroots = _tree(_ranked(leaves, ["doc_id", "h"], "merkle-leaves"), "merkle")
    groups = _ranked(subroots.select(F.lit(0).alias("g"), F.col("g").alias("name"), "h"), ["name"], "merkle-groups")
    upper, top = _tree(groups, "merkle-groups")
    root = F.lit((top.first() or {"h": None})["h"]).cast("string")
    start = F.struct(F.lit(None).cast("string").alias("subroot"), F.array().cast("array<struct<before: string, after: string>>").alias("steps"))
    named = _proofs(upper, top.select("g", start.alias("path")))
    path = F.struct(F.col("leaf.h").alias("subroot"), "path.steps")
    found = _proofs(tiers, staged(named.select(F.col("leaf.name").alias("g"), path.alias("path")), "merkle-paths"))
    folded = F.aggregate("path.steps", F.coalesce("leaf.t", "leaf.h"), lambda h, s: hashed(F.concat(s["before"], h, s["after"])))
    siblings = F.array_join(F.transform("path.steps", lambda s: F.concat(s["before"], s["after"])), "")
    out = found.select(
        "leaf.doc_id", F.col("leaf.h").alias("leaf"), "path.subroot", root.alias("root"), F.col("path.steps").alias("proof"),
        hashed(siblings).alias("proof_sha256"), folded.alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _levels(name: str, keys: str, count: int) -> str:
    """Common table expressions: name1 to name<count>, the nodes of each level (keys, r, h), and what stands around those below."""
    out = []
    for i in range(1, count + 1):
        below = f"(SELECT *, count(*) OVER (PARTITION BY {keys}) AS c FROM {name}{i - 1})"
        run = f"OVER (PARTITION BY {keys}, r // 8 ORDER BY r ROWS BETWEEN"
        out.append(f"{name}{i} AS (SELECT {keys}, r // 8 AS r, CASE WHEN max(c) > 1 THEN sha256(string_agg(h, '' ORDER BY r)) ELSE min(h) END AS h FROM {below} GROUP BY {keys}, r // 8)")
        out.append(
            f"{name}s{i} AS (SELECT {keys}, r, c > 1 AS several, coalesce(string_agg(h, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b, coalesce(string_agg(h, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a FROM {below})"
        )
    return ",\n".join(out)


def _folded(name: str, source: str, key: str, count: int) -> str:
    """source (..., r, folded, siblings) with folded and siblings taken up `count` levels of name."""
    for i in range(1, count + 1):
        source = (
            f"(SELECT t.* REPLACE (CASE WHEN s.several THEN sha256(s.b || t.folded || s.a) ELSE t.folded END AS folded, CASE WHEN s.several THEN t.siblings || s.b || s.a ELSE t.siblings END AS siblings, t.r // 8 AS r)"
            f" FROM {source} t JOIN {name}s{i} s ON s.r = t.r AND s.{key} IS NOT DISTINCT FROM t.{key})"
        )
    return source


def _sql() -> str:
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(text if f == "text" else f) for f in FIELDS) + ")"
    bits = "list_reduce(range(8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b))"
    crc = f"xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT)), lambda c, b: {bits}, CAST(4294967295 AS BIGINT)), 4294967295)"
    return f"""
WITH hashed AS (SELECT doc_id, lang, {leaf("text")} AS h, CASE WHEN {crc} % 3 = 0 THEN {leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} END AS t FROM documents),
n0 AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS r FROM hashed),
{_levels("n", "lang", 8)},
g0 AS (SELECT 0 AS one, lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS r FROM n8),
{_levels("g", "one", 4)},
inner_paths AS (SELECT * FROM {_folded("n", "(SELECT doc_id, lang, h AS leaf, r, coalesce(t, h) AS folded, '' AS siblings FROM n0)", "lang", 8)}),
named AS (SELECT p.* REPLACE (g.r AS r), 0 AS one, g.h AS subroot FROM inner_paths p JOIN g0 g ON g.lang IS NOT DISTINCT FROM p.lang),
outer_paths AS (SELECT * FROM {_folded("g", "(SELECT * FROM named)", "one", 4)})
SELECT doc_id, leaf, subroot, (SELECT h FROM g4) AS root, sha256(siblings) AS proof_sha256, folded AS folded_root, folded = (SELECT h FROM g4) AS verified FROM outer_paths"""


#: The same manifest of `documents` for another engine, up to 8 ** 8 rows of a language and 8 ** 4 languages.
SQL = _sql()
