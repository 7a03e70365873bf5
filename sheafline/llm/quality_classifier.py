"""Quality scores: ridge regression on random Fourier features of document statistics, calibrated by isotonic regression.

Statistics of the whole text (never its label, language, source or id) are standardised and mapped to `FEATURES` random
cosines, which approximate a Gaussian kernel. Each partition sums its normal equations; the sums are summed by matrix row
and only the finished matrix, whose size is fixed, comes to the driver. Two half models score each other's rows; these
scores, rounded to 1/1000, give the counts from which pooled adjacent violators make the calibration.

Defined cases: null and empty texts have zero statistics and get a score; labels other than 0 and 1 and labels without a
document are not used; repeated label rows count as often as they occur; without any label every score is 0.5; a null
doc_id is never held out nor learnt from; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

FEATURES, RIDGE, SEED, THRESHOLD = 256, 1.0, 7, 0.3
#: `kept` learns from about so many labelled rows, drawn by a hash of their ids; their ids are broadcast (16 bytes each).
FIT_ROWS = 200_000
_SYMBOLS = np.frombuffer(b"#*$%&|<>{}[]~^_=+\\/@", dtype=np.uint8)
_STOPS = np.frombuffer(b".,;:?", dtype=np.uint8)
N_STATS = 22


def statistics(text: bytes | None) -> list[float]:
    """N_STATS numbers on the shape of a text."""
    if not text:
        return [0.0] * N_STATS
    words = text.split()
    if not words:
        return [float(np.log1p(len(text)))] + [0.0] * (N_STATS - 1)
    h = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    n, nw = len(text), len(words)
    upper, lower = int(h[65:91].sum()), int(h[97:123].sum())
    counts = Counter(words)
    number = dict(zip(counts, range(len(counts)), strict=True))
    ids = np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=nw)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=nw)
    lines = [x for x in text.split(b"\n") if x.strip()]
    share = h[h > 0] / n
    return [
        float(np.log1p(n)), float(np.log1p(nw)), upper / max(1, upper + lower), float(h[48:58].sum()) / n,
        float(h[_SYMBOLS].sum()) / n, float(h[33]) / n, float(h[124]) / n, float(h[_STOPS].sum()) / n,
        float(h[[32, 9, 10, 11, 12, 13]].sum()) / n, float(h[128:].sum()) / n, len(counts) / nw,
        float(np.log1p(len(counts)) / np.log1p(nw)), int((ids[1:] == ids[:-1]).sum()) / nw, max(counts.values()) / nw,
        len(np.unique(ids[:-1] * len(counts) + ids[1:])) / max(1, nw - 1), float(sizes.mean()), float(sizes.std()),
        float(np.log1p(sizes.max())), float(np.log1p(len(lines))), len(set(lines)) / len(lines),
        float(np.log1p(nw / len(lines))), float(-(share * np.log(share)).sum()),
    ]


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x: array of N_STATS doubles) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [statistics(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.float64()))], ["doc_id", "x"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    return src.mapInArrow(run, "doc_id long, x array<double>")


class Cosines:
    """The random map; a seed gives the same directions everywhere."""

    def __init__(self, mean: list[float], spread: list[float], n: int = FEATURES, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.spread = np.array(mean), np.array(spread)
        self.w = rng.normal(size=(len(mean), n)) * np.sqrt(2.0 / len(mean))
        self.b = rng.uniform(0, 2 * np.pi, size=n)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.hstack([np.cos(z @ self.w + self.b) * np.sqrt(2.0 / len(self.b)), np.ones((len(x), 1))])


def _normal_equations(rows: DataFrame, cosines: Cosines) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per half (0, 1) the sums of f f' and f y over rows (x, y, half)."""

    def partial(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for p in frames:
            if len(p):
                f = cosines(np.stack(p["x"].to_numpy()))
                y = p["y"].to_numpy(dtype=float)
                for half in (0, 1):
                    own = p["half"].to_numpy() == half
                    g = np.column_stack([f[own].T @ f[own], f[own].T @ y[own]])
                    sums[half] = sums.get(half, 0) + g
        for half, g in sums.items():
            yield pd.DataFrame({"half": half, "i": np.arange(len(g)), "v": list(g)})

    def total(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for p in frames:
            for half, i, v in zip(p["half"], p["i"], p["v"], strict=True):
                sums[half, i] = sums.get((half, i), 0) + np.asarray(v)
        if sums:
            yield pd.DataFrame([{"half": h, "i": i, "v": v} for (h, i), v in sums.items()])

    schema = "half int, i int, v array<double>"
    got = rows.mapInPandas(partial, schema).repartition("half", "i").mapInPandas(total, schema).collect()
    size = len(cosines.b) + 1
    out = {h: (np.zeros((size, size)), np.zeros(size)) for h in (0, 1)}
    for r in got:
        out[r["half"]][0][r["i"]] = r["v"][:-1]
        out[r["half"]][1][r["i"]] = r["v"][-1]
    return out


def _solved(g: np.ndarray, b: np.ndarray) -> np.ndarray:
    penalty = RIDGE * np.eye(len(b))
    penalty[-1, -1] = 1e-6  # the constant
    return np.linalg.solve(g + penalty, b)


def isotonic(at: np.ndarray, mean: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: centres and levels of the blocks, both rising."""
    blocks: list[list[float]] = []
    for x, m, w in zip(at, mean, weight, strict=True):
        blocks.append([x * w, m * w, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    b = np.array(blocks)
    return b[:, 0] / b[:, 2], b[:, 1] / b[:, 2]


def held_out(c: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


class Model:
    """Weights of the cosines and the calibration; its size does not depend on the data."""

    def __init__(self, cosines: Cosines, weights: np.ndarray, centres: np.ndarray, levels: np.ndarray) -> None:
        self.cosines, self.weights, self.centres, self.levels = cosines, weights, centres, levels

    def __call__(self, x: list[list[float]] | np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        return np.clip(np.interp(self.cosines(np.asarray(x)) @ self.weights, self.centres, self.levels), 0, 1)


class Undecided:
    """The model where no label is known."""

    def __call__(self, x: list[list[float]] | np.ndarray) -> np.ndarray:
        return np.full(len(x), 0.5)


def fitted(stats: DataFrame, labels: DataFrame) -> Model | Undecided:
    """The model of stats (doc_id, x) that labels (doc_id, quality) mark and that are not held out."""
    marked = labels.filter("quality in (0, 1)").select("doc_id", F.col("quality").cast("double").alias("y"))
    half = F.pmod(F.xxhash64("x"), F.lit(2)).cast("int").alias("half")
    known = staged(stats.filter(~held_out()).join(marked.hint("merge"), "doc_id").select("x", "y", half), "quality-known")
    moments = known.agg(*[f(F.col("x")[i]).alias(f"{n}{i}") for i in range(N_STATS) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if moments["m0"] is None:
        return Undecided()
    cosines = Cosines([moments[f"m{i}"] for i in range(N_STATS)], [moments[f"s{i}"] or 1.0 for i in range(N_STATS)])
    sums = _normal_equations(known, cosines)
    halves = [_solved(*sums[1]), _solved(*sums[0])]  # each half is scored by the other's model

    def cross(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in frames:
            if len(p):
                f, own = cosines(np.stack(p["x"].to_numpy())), p["half"].to_numpy()
                s = np.where(own == 0, f @ halves[0], f @ halves[1])
                yield pd.DataFrame({"at": np.round(np.clip(s, -1, 2) * 1000).astype(int), "y": p["y"]})

    # at most 3001 rows
    bins = known.mapInPandas(cross, "at int, y double").groupBy("at").agg(F.avg("y").alias("m"), F.count("*").alias("w")).toPandas()
    bins = bins.sort_values("at")
    centres, levels = isotonic(bins["at"].to_numpy() / 1000, bins["m"].to_numpy(), bins["w"].to_numpy(dtype=float))
    return Model(cosines, _solved(sums[0][0] + sums[1][0], sums[0][1] + sums[1][1]), centres, levels)


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs."""
    stats = staged(with_statistics(docs, id_col, text_col), "quality-statistics")
    model = fitted(stats, labels)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model(b.column("x").to_pylist())
            cols = [b.column("doc_id"), b.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "score", "predicted"])

    return stats.withColumn("held_out", held_out()).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def kept(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of docs that are not predicted to be of low quality, judged by their whole texts.

    Only the statistics of about fit_rows labelled rows are taken for the fit. Rows are never moved.
    """
    known = labels.filter("quality in (0, 1)").withColumn("doc_id", F.col("doc_id").cast("long")).filter(~held_out())
    n = known.count()
    if n > fit_rows:
        parts = 1_000_000
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) < parts * fit_rows // n)
    known = staged(known.select("doc_id", "quality"), "quality-labels")
    ids = known.select("doc_id").distinct().hint("broadcast")
    learnt = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(ids, "doc_id", "left_semi")
    model = fitted(staged(with_statistics(learnt), "quality-statistics"), known)
    at = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            yield b.filter(pa.array(model([statistics(None if t is None else t.encode()) for t in texts]) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
