"""Vector codes by product quantisation in exact integers.

Components become integers floor(256 x). A part's squared distance to a codebook entry is |x|^2 - 2 x.c + |c|^2; the dot
products come from float64 matrix products of limbs: integers are cut into limbs short enough that a sum of their products
stays below 2^53, so every product is exact, and limbs' products are shifted and added in int64. The first smallest distance
wins. Codebooks start as the parts of the smallest ids, and each round replaces an entry by the floor of its parts' mean:
tasks return sums and counts, one row for each part, entry and position, which are added up in Spark; the driver holds
codebooks only, `entries` times the vector's length.

Defined cases: vectors that are null or hold null or non-finite components take no part; zero vectors do. Vectors are padded
with zeros to the longest one's length, rounded up to a multiple of `parts`. Null ids come last among the first codebook's;
rows of one id are ordered by their vectors; with fewer rows than entries codebooks are smaller. Integers too large for int64
distances are computed with Python's, and errors end at 2^63 - 1. Repeated rows come back as often as they are; null labels
are equal to each other; an empty table has no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, staged

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
MOST = (1 << 63) - 1
#: Distances are computed for so many components at once.
CHUNK = 1 << 18
#: Bits of the limbs in which tasks return sums.
LIMB = 48


def integers(flat: np.ndarray) -> np.ndarray:
    """floor(256 x) of finite float64 values: int64, or Python's integers where one is larger."""
    if not len(flat) or np.abs(flat).max() < 2.0**54:
        return np.floor(flat * SCALE).astype(np.int64)
    return np.array([math.floor(v * SCALE) if abs(v) < 2.0**53 else int(v) * SCALE for v in flat.tolist()], dtype=object)


def limbs(x: np.ndarray, bits: int, n: int) -> list[np.ndarray]:
    """n float64 arrays, the sum of whose 2^(bits i) multiples is x; all but the last are from 0 to 2^bits - 1."""
    low = [(x >> bits * i) & ((1 << bits) - 1) for i in range(n - 1)]
    return [a.astype(np.float64) for a in (*low, x >> bits * (n - 1))]


def dots(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact dot products of the int64 rows of x with those of c, if they fit into int64."""
    bits = (52 - max(1, x.shape[1] - 1).bit_length()) // 2
    wide = max([int(np.abs(a).max()).bit_length() for a in (x, c) if a.size] or [0]) + 1
    n = max(1, -(-wide // bits))
    out = np.zeros((len(x), len(c)), np.int64)
    of_c = limbs(c, bits, n)
    for i, a in enumerate(limbs(x, bits, n)):
        for j, b in enumerate(of_c):
            out += (a @ b.T).astype(np.int64) << bits * (i + j)
    return out


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the first of the nearest rows of c, and its squared distance."""
    largest = max([int(np.abs(a).max()) for a in (x, c) if a.size] or [0])
    if x.dtype == object or c.dtype == object or 4 * largest * largest * max(1, x.shape[1]) > MOST:
        d = np.array([[sum((int(p) - int(q)) ** 2 for p, q in zip(row, e, strict=True)) for e in c] for row in x], dtype=object)
        at = np.array([min(range(len(c)), key=row.__getitem__) for row in d], dtype=np.int64)
        return at, d[np.arange(len(x)), at]
    d = (c * c).sum(axis=1)[None, :] - 2 * dots(x, c)
    at = d.argmin(axis=1)
    return at, d[np.arange(len(x)), at] + (x * x).sum(axis=1)


def vectors(column: pa.Array, width: int) -> np.ndarray:
    """The integers of a list column without nulls, padded to width."""
    lengths = np.array(column.value_lengths())
    flat = integers(column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False))
    out = np.zeros((len(column), width), flat.dtype)
    starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(np.arange(len(column)), lengths), np.arange(len(flat)) - starts] = flat
    return out


def _slices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    rows = max(1, CHUNK // max(1, width))
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def _means(kept: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks (part, entry, position) after one round."""
    parts, entries, size = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, object), np.zeros((parts, entries), np.int64)
        for b in _slices(batches, parts * size):
            x = vectors(b.column(0), parts * size)
            for p in range(parts):
                own = x[:, p * size : (p + 1) * size]
                at, _ = nearest(own, books[p])
                few = own.dtype != object and (not own.size or int(np.abs(own).max()) < 1 << 40)
                added = np.zeros((entries, size), np.int64 if few else object)
                np.add.at(added, at, own)
                sums[p] += added
                counts[p] += np.bincount(at, minlength=entries)
        p, e = np.nonzero(counts)
        columns = [pa.array(v) for v in (p.astype(np.int32), e.astype(np.int32), counts[p, e])]
        cut = pa.array([[_cut(int(v)) for v in sums[i, j]] for i, j in zip(p, e, strict=True)], pa.list_(pa.list_(pa.int64())))
        yield pa.RecordBatch.from_arrays([*columns, cut], ["p", "e", "n", "s"])

    rows = kept.select("vector").mapInArrow(run, "p int, e int, n long, s array<array<long>>")
    at = rows.select("p", "e", "n", F.posexplode("s").alias("i", "s")).select("p", "e", "i", "n", F.posexplode("s").alias("j", "s"))
    added = at.groupBy("p", "e", "i", "j").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    sums: dict[tuple[int, int, int], int] = defaultdict(int)
    counts: dict[tuple[int, int], int] = {}
    for r in added.collect():  # a row for each number of the codebooks, more only where sums exceed 47 bits
        sums[r["p"], r["e"], r["i"]] += int(r["s"]) << LIMB * r["j"]
        if r["j"] == 0:
            counts[r["p"], r["e"]] = r["n"]
    new = books.tolist()
    for (p, e, i), v in sums.items():
        new[p][e][i] = v // counts[p, e]
    return _books(new)


def _cut(v: int) -> list[int]:
    """Limbs of LIMB bits, the last with v's sign."""
    out = []
    while not -(1 << LIMB - 1) <= v < 1 << LIMB - 1:
        out.append(v & ((1 << LIMB) - 1))
        v >>= LIMB
    return [*out, v]


def _books(rows: list) -> np.ndarray:
    try:
        return np.array(rows, dtype=np.int64)
    except OverflowError:
        return np.array(rows, dtype=object)


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(int(v)) for v in books.reshape(-1)).encode()).hexdigest()


def codes(
    rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of each row that takes part, code an array of entries in part order; the codebooks."""
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    own = rows.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    kept = own.filter(F.col("vector").isNotNull() & ~bad)
    longest = kept.agg(F.max(F.size("vector"))).first()[0] or 0
    width = max(1, -(-longest // parts)) * parts
    first = [r["vector"] for r in kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()]
    x = vectors(pa.array(first, pa.list_(pa.float64())), width)
    books = x.reshape(len(first), parts, width // parts).transpose(1, 0, 2)
    for _ in range(rounds if first else 0):
        books = _means(kept, books)
    size = width // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, width):
            x, found, error = vectors(b.column(2), width), [], 0
            for p in range(parts):
                at, d = nearest(x[:, p * size : (p + 1) * size], books[p])
                found.append(at)
                error = error + d.astype(object)
            code = pa.array(np.stack(found, axis=1).tolist(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), code, pa.array([min(int(v), MOST) for v in error], pa.int64())], ["vec_id", "label", "code", "error"])

    kinds = dict(kept.dtypes)
    return kept.select("vec_id", "label", "vector").mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code array<int>, error long"), books


def coded(rows: DataFrame, **options) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256): code in hexadecimal, label_error the sum over equal labels."""
    found, books = codes(rows, **options)
    found = staged(found, "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST)).cast("long")
    per_label = staged(found.groupBy("label").agg(total.alias("label_error")).withColumnRenamed("label", "__l"), "codes-labels")
    few = per_label.count() <= BROADCAST_ROWS
    salts = 1 if few else 16
    salted = per_label.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("broadcast" if few else "merge")
    at = F.col("label").eqNullSafe(F.col("__l")) & (F.pmod(F.hash("vec_id", "code"), F.lit(salts)) == F.col("__s"))
    text = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return found.join(salted, at).select("vec_id", text.alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    best = lambda books: f"""
SELECT id, p, x, m % {ENTRIES} AS e, m // {ENTRIES} AS d FROM (
  SELECT q.id, q.p, any_value(q.x) AS x, min(CAST(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: (q.x[i] - b.c[i]) * (q.x[i] - b.c[i]))) AS BIGINT) * {ENTRIES} + b.e) AS m
  FROM parts q JOIN {books} b ON q.p = b.p GROUP BY q.id, q.p) n"""  # noqa: E731
    ctes, books = [], "b0"
    for k in range(1, ROUNDS + 1):
        ctes.append(f"a{k} AS MATERIALIZED ({best(books)})")
        mean = f"SELECT p, e, list(v ORDER BY i) AS c FROM (SELECT p, e, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS v FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM a{k}) u GROUP BY p, e, i) s GROUP BY p, e"
        ctes.append(f"b{k} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM {books} b LEFT JOIN ({mean}) m ON b.p = m.p AND b.e = m.e)")
        books = f"b{k}"
    steps = ",\n".join(ctes)
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS id, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
wide AS (SELECT greatest(1, CAST(ceil(max(len(v)) / {PARTS}.0) AS BIGINT)) AS n FROM kept),
parts AS MATERIALIZED (SELECT id, p, list_resize(v, n * {PARTS}, 0)[p * n + 1:(p + 1) * n] AS x FROM (SELECT *, unnest(range({PARTS})) AS p FROM kept) k, wide),
b0 AS (SELECT p, id AS e, x AS c FROM parts WHERE id < {ENTRIES}),
{steps},
found AS ({best(books)}),
coded AS (SELECT k.vec_id, k.label, c.code, c.error FROM kept k JOIN (SELECT id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM found GROUP BY id) c ON k.id = c.id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(c[i] AS VARCHAR), ',' ORDER BY p, e, i)) FROM (SELECT *, unnest(range(1, len(c) + 1)) AS i FROM {books}) u) AS codebooks_sha256 FROM coded"""


#: The same codes of `embeddings` for another engine.
SQL = _sql()
