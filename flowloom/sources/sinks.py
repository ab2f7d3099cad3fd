"""Partitioned tables and the shared folder that intermediate tables go to."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, visible to every executor.

    A session without the setting gets a fresh temporary folder in local mode
    only; on a cluster that is an error, since such a folder is not shared.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="flowloom-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


# Paths given out by this process and not yet removed.
_paths: set[str] = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for one intermediate table."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _paths.add(path)
    return path


def known_paths() -> list[str]:
    """The scratch paths that may hold something."""
    return sorted(_paths)


def forget(path: str) -> None:
    _paths.discard(path)


def write_partitioned(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Write parquet with one folder per key value.

    The rebalance hint brings the rows of a folder together, so that files are
    large, and lets adaptive execution split a folder that outgrows one task.
    """
    df.hint("rebalance", *keys).write.mode("errorifexists").partitionBy(*keys).parquet(path)


def read_partition(spark: SparkSession, path: str, **values: object) -> DataFrame:
    """Read the folders that match ``values``; other folders are not listed as input."""
    df = spark.read.parquet(path)
    for key, value in values.items():
        df = df.filter(F.col(key) == F.lit(value))
    return df
