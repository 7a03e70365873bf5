"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_run = ""  # the folder of the run within the shared one
#: Bytes of the tables that a table is made of for each task that writes it, the number of tasks there are at least, and
#: the bytes up to which a staged table is broadcast.
PART, PARTS, SMALL = 4 << 20, 24, 256 << 10
#: Bytes in memory, by rows and their width, up to which a staged table may be broadcast (see `counted`).
HELD = 10 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only a local session without that setting gets a new one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def bytes_of(table: DataFrame) -> int:
    """Bytes of a staged table's files."""
    place = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.staged_path)
    return place.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).getContentSummary(place).getLength()


def sized(table: DataFrame, as_read: DataFrame | None = None) -> DataFrame:
    """A staged table, or columns of it, with the hint that its size asks for: broadcast if it is small, else merge."""
    return (table if as_read is None else as_read).hint("broadcast" if bytes_of(table) <= SMALL else "merge")


def counted(table: DataFrame) -> DataFrame:
    """A staged table with a merge hint, unless its rows are few.

    Files of ordered keys and alike places are some hundred times smaller than the rows that a broadcast of them holds. By
    its bytes a table of millions of rows would be gathered in the driver.
    """
    return table if table.count() * (16 + table._jdf.schema().defaultSize()) <= HELD else table.hint("merge")


def staged(df: DataFrame, label: str, of: tuple[DataFrame, ...] = ()) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, sizes are known, lost executors lose nothing.

    `of`: staged tables that df is made of. If they are small, few tasks write df, however many partitions a shuffle has.
    """
    path = f"{shared_dir(df.sparkSession)}/{_run}{label}-{uuid.uuid4().hex}"
    if of:
        n = max(PARTS, -(-sum(map(bytes_of, of)) // PART))
        if n < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
            df = df.coalesce(n)
    df.write.parquet(path, compression="zstd")
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.staged_path = path
    return back


def _deleted(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def released(*tables: DataFrame) -> None:
    """Delete staged tables that no later step reads."""
    for t in tables:
        _deleted(t.sparkSession, t.staged_path)


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """What is staged within goes to one new folder of the shared one, deleted at the end. Write results out before."""
    global _run
    outer, _run = _run, f"{_run}run-{uuid.uuid4().hex}/"
    path = f"{shared_dir(spark)}/{_run}"
    try:
        yield path
    finally:
        _run = outer
        _deleted(spark, path)
