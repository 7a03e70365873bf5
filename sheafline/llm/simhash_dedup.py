"""SimHash near-duplicates by pigeonring filtering.

Fingerprints have 64 bits on a ring of 8 segments. If two of them differ in at most 3 bits, some start on the ring has a
chain of l segments with at most floor(3 l / 8) differing bits for every l from 1 to 8: none in two segments, at most one
in five. So two segments are equal and of the next three at least two are, which makes 32 equal bits: 8 starts times 3
choices are the 24 index keys. A pair that meets under a key is checked along the whole chain, then by its full distance.

Equal fingerprints are one node with the smallest doc_id. A key that more than `bucket_rows` different fingerprints share
is refined exactly: of the other 32 bits' 8 nibbles at least 5 are equal, so 56 finer keys with 52 equal bits keep every
pair, and no finer key can hold more than 4096 fingerprints.

Defined cases: a null, empty or blank text has fingerprint zero and is linked like any other; a null doc_id stays a row
and is never a component's id; repeated rows come back as often as they are; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, staged

SEGMENTS, BITS = 8, 3
BUDGETS = [BITS * n // SEGMENTS for n in range(1, SEGMENTS + 1)]
CHUNK = 1 << 16
_OFFSETS = (np.arange(8) * 256).astype(np.int64)
_SET = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)


def fingerprint(text: bytes | None, shingle_words: int = 3) -> int:
    """The unsigned fingerprint of a text's UTF-8 bytes; a long text is hashed in pieces of CHUNK shingles."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    n = max(1, len(words) - shingle_words + 1)
    counts = np.zeros(2048, dtype=np.int64)
    join, digest = b" ".join, xxhash.xxh64_intdigest
    for i in range(0, n, CHUNK):
        hashes = [digest(join(words[j : j + shingle_words]), 42) for j in range(i, min(n, i + CHUNK))]
        octets = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8) + _OFFSETS
        counts += np.bincount(octets.ravel(), minlength=2048)
    ones = (counts.reshape(8, 256).astype(np.float64) @ _SET).ravel()
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle_words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [f"{fingerprint(t, shingle_words):016x}" for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    return src.mapInArrow(run, "doc_id long, fingerprint string")


def _turned(f: Column, start: int) -> Column:
    n = 8 * start
    return f if n == 0 else F.shiftrightunsigned(f, n).bitwiseOR(F.shiftleft(f, 64 - n))


def _part(r: Column, first: int, n: int) -> Column:
    """n segments of r from the first."""
    return F.shiftrightunsigned(r, 8 * first).bitwiseAND(F.lit((1 << 8 * n) - 1))


def _keys(f: Column) -> Column:
    """An array of (key, rest): key holds the 32 equal bits below the number of start and choice, rest the other 32 bits."""
    out = []
    for start in range(SEGMENTS):
        r = _turned(f, start)
        choices = [
            (_part(r, 0, 4), _part(r, 4, 4)),
            (_part(r, 0, 2).bitwiseOR(F.shiftleft(_part(r, 3, 2), 16)), _part(r, 2, 1).bitwiseOR(F.shiftleft(_part(r, 5, 3), 8))),
            (_part(r, 0, 3).bitwiseOR(F.shiftleft(_part(r, 4, 1), 24)), _part(r, 3, 1).bitwiseOR(F.shiftleft(_part(r, 5, 3), 8))),
        ]
        for i, (equal, rest) in enumerate(choices):
            out.append(F.struct(equal.bitwiseOR(F.lit((start * 3 + i) << 32)).alias("key"), rest.alias("rest")))
    return F.array(*out)


def _linked(x: Column, key: Column) -> Column:
    """Whether the chain from the key's start keeps to its budgets, then whether the whole distance does."""
    start = F.shiftright(key, 32) / 3
    turned = F.lit(None).cast("long")
    for s in range(SEGMENTS):
        turned = F.when(start.cast("int") == s, _turned(x, s)).otherwise(turned)
    chain = F.lit(True)
    for n in range(3, SEGMENTS):
        chain = chain & (F.bit_count(_part(turned, 0, n)) <= BUDGETS[n - 1])
    return chain & (F.bit_count(x) <= BITS)


def _pairs(rows: DataFrame, by: list[str]) -> DataFrame:
    a = rows.select(*by, F.col("f").alias("a"))
    b = rows.select(*by, F.col("f").alias("b"))
    met = a.hint("merge").join(b, by).filter(F.col("a") < F.col("b"))
    return met.filter(_linked(F.col("a").bitwiseXOR(F.col("b")), F.col("key"))).select("a", "b")


def links(distinct: DataFrame, bucket_rows: int = 512) -> DataFrame:
    """Pairs (a, b) of different fingerprints (column f, long) at 3 or fewer differing bits, each once."""
    keyed = distinct.select("f", F.explode(_keys(F.col("f"))).alias("k")).select("f", "k.key", "k.rest")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    met = staged(keyed.join(sizes.hint("merge"), "key"), "simhash-met")
    masks = [sum(15 << 4 * i for i in c) for c in combinations(range(8), 5)]
    finer = F.array(*[F.struct(F.lit(i).alias("m"), F.col("rest").bitwiseAND(F.lit(m)).alias("part")) for i, m in enumerate(masks)])
    large = met.filter(F.col("n") > bucket_rows).select("f", "key", F.explode(finer).alias("x")).select("f", "key", "x.m", "x.part")
    small = _pairs(met.filter(F.col("n") <= bucket_rows), ["key"])
    return small.unionByName(_pairs(large, ["key", "m", "part"])).distinct()


def _classes(found: DataFrame, least: Column, bucket_rows: int) -> DataFrame:
    """(fingerprint, least over the fingerprint's component) of found (fingerprint, ...)."""
    as_long = F.conv("fingerprint", 16, -10).cast("long")
    groups = staged(found.groupBy("fingerprint").agg(F.min(least).alias("least")).withColumn("f", as_long), "simhash-groups")
    roots = components(links(groups.select("f"), bucket_rows), "simhash-components")
    joined = groups.join(roots.withColumnRenamed("node", "f").hint("merge"), "f", "left").withColumn("root", F.coalesce("root", "f"))
    lowest = joined.groupBy("root").agg(F.min("least").alias("lowest"))
    return joined.select("fingerprint", "root").join(lowest.hint("merge"), "root").select("fingerprint", "lowest")


def near_duplicates(
    docs: DataFrame, shingle_words: int = 3, bucket_rows: int = 512, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row of docs."""
    found = staged(fingerprints(docs, shingle_words, id_col, text_col), "simhash-fingerprints")
    classes = _classes(found, F.col("doc_id"), bucket_rows)
    return found.join(classes.hint("merge"), "fingerprint").select("doc_id", "fingerprint", F.col("lowest").alias("component_id"))


def representatives(
    docs: DataFrame, shingle_words: int = 5, bucket_rows: int = 512, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row of docs from each component: that of the smallest id (null ids last), of equal ids that of the lower text hash."""
    keys = {"__k": F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)), "__r": F.xxhash64(text_col)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [f"{fingerprint(t, shingle_words):016x}" for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.string())], ["__k", "__r", "fingerprint"])

    keyed = docs.withColumns(keys)
    src = keyed.select("__k", "__r", F.col(text_col).cast("binary").alias("t"))
    found = staged(src.mapInArrow(run, "__k long, __r long, fingerprint string"), "simhash-fingerprints")
    winners = _classes(found, F.struct("__k", "__r"), bucket_rows).select("lowest.*").distinct()
    first = keyed.hint("merge").join(winners, ["__k", "__r"], "left_semi")
    one = F.row_number().over(Window.partitionBy("__k", "__r").orderBy(F.lit(0)))  # rows that agree on both are alike
    return first.withColumn("__i", one).filter("__i = 1").select(*docs.columns)
