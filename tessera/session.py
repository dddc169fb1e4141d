"""Session helpers shared by the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a temporary folder serves on a local master; on a
    cluster, whose executors wouldn't see it, that is an error."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


_STORED: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, source: str, name: str, save) -> str:
    """Path of what `save(path)` writes for a source of data: written once a session to the shared folder, then read by all."""
    key = (spark.sparkContext.applicationId, source, name)
    if key not in _STORED:
        path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        save(path)
        _STORED[key] = path
    return _STORED[key]
