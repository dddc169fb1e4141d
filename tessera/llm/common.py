"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the operators' contracts define it; bytes.split() and bytes.strip() use the same set.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, as spark.checkpoint.dir names it. Where that is unset, a new one on this machine if it
    is the only one (a local master); on a cluster, whose executors wouldn't see it, an error."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not named and sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir: executors of a local cluster have folders of their own")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera-"))
    return sc.getCheckpointDir()


def discard(spark: SparkSession, folder: str) -> None:
    """Deletes a folder through Spark's own file systems, wherever it lies."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that start as asked for and clash with none of df's (case ignored)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def slices(batches, rows: int = 1000):
    """Record batches in smaller ones, so that few texts are Python values at a time. A worker that remembers words for
    the tokenizer drops them first and gives their memory back: stages that don't encode need it."""
    tokens = sys.modules.get(f"{__package__}.tokens")
    if tokens and tokens.encoder.cache_info().currsize:
        tokens.encoder.cache_clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)
    for batch in batches:
        for lo in range(0, max(1, batch.num_rows), rows):  # an empty one passes too
            yield batch.slice(lo, rows)


def column_of(batch, name: str, kind=None) -> list:
    """A record batch's column as Python values; kind "binary" gives a string column as UTF-8 bytes."""
    col = batch.column(batch.schema.get_field_index(name))
    return (col.cast(kind) if kind else col).to_pylist()
