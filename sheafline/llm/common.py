"""Helpers that several of these operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..staging import released, shared_dir, sized, staged

__all__ = ["BROADCAST_ROWS", "bounded_batches", "components", "ranked", "released", "shared_dir", "sized", "staged", "table"]


#: A table of so few narrow rows, counted before, may be broadcast.
BROADCAST_ROWS = 1 << 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes of one Arrow batch between the JVM and Python where the session names no limits of its own.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("2147483647b", str(8 << 20))}


def bounded_batches(spark: SparkSession) -> None:
    """Keep batches of whole texts small. Plans read these settings when they run, so they stay set for the session."""
    for name, (usual, own) in BATCH.items():
        if spark.conf.get(name, usual) == usual:
            spark.conf.set(name, own)


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str, buckets: int = 1024) -> DataFrame:
    """A gapless rank from 0 within keys, without one task for a hot key.

    Rows go to `buckets` buckets by a hash of the order columns; bucket counts (at most `buckets` per key) give each
    bucket's offset, and only rows of one bucket are numbered together. The order is by bucket, then by `order`.
    """
    b = F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int")
    with_bucket = df.withColumn("__b", b)
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        with_bucket.groupBy(*keys, "__b").agg(F.count("*").alias("__n"))
        .withColumn("__offset", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    )
    inside = with_bucket.withColumn("__i", F.row_number().over(Window.partitionBy(*keys, "__b").orderBy(*order)))
    return (
        inside.join(offsets.hint("merge"), [*keys, "__b"])
        .withColumn(name, F.col("__offset") + F.col("__i") - 1).drop("__b", "__i", "__offset")
    )


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) of each node of edges (a, b), root the smallest node it can reach.

    Alternating stars: every node hangs its larger neighbours on its smallest neighbour, then its smaller ones, until
    nothing moves; rounds grow with the logarithm of the longest chain. Minima are pre-aggregated before the shuffle and
    written before they are joined back: both sides of that join are then plain shuffles, in which adaptive execution
    splits a node with very many neighbours, or the minima are few and broadcast.
    """
    e = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), label)
    before = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = staged(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), f"{label}-least", (e,))
        large = both.join(sized(least), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        large = staged(large.distinct(), f"{label}-large", (e,))
        down = staged(large.groupBy("a").agg(F.min("b").alias("m")), f"{label}-down", (e,))
        small = (
            large.join(sized(down), "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("x"))
            .select(F.col("x.b").alias("a"), F.col("x.m").alias("b")).filter("a <> b").distinct()
        )
        last, e = e, staged(small, label, (e,))
        released(last, least, large, down)
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
