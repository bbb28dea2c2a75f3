"""Intermediate tables in the folder that all machines of a cluster share."""

from __future__ import annotations

import atexit
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

#: Folders of intermediate tables that this process has made.
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder that the driver and all executors reach, below spark.checkpoint.dir; deleted when the driver ends.

    Where the setting and the context's checkpoint folder are unset, a local master gets a folder of its
    own machine; a cluster is an error, since its machines share no such folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file:///tmp/checkpoints"
    if "://" not in base:
        base = base.replace("file:", "file://", 1) if base.startswith("file:") else f"file://{base}" if base.startswith("/") else base
    _made.append(f"{base.rstrip('/')}/work-{uuid.uuid4().hex}")
    return _made[-1]


def drop(where: str) -> None:
    """Deletes a folder of an intermediate table; one that isn't there, or in a store that only Spark knows, stays."""
    try:
        store, path = fs.FileSystem.from_uri(where)
        store.delete_dir(path)
    except (OSError, ValueError, pa.ArrowException):
        pass


@atexit.register
def release() -> None:
    """Deletes the intermediate tables made so far; results that were not saved can't be computed any more."""
    while _made:
        where = _made.pop()
        for name in (where, f"{where}-manifest"):
            drop(name)


def written(df: DataFrame, where: str | None = None) -> DataFrame:
    """The rows written to the shared folder and read again: lineage ends here, and lost executors lose nothing."""
    spark = df.sparkSession
    where = where or shared_dir(spark)
    df.write.mode("overwrite").parquet(where)
    return spark.read.schema(df.schema).parquet(where)
