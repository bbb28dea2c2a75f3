"""Pieces that several operators share: Arrow buffers, shared folders and sizes."""

from __future__ import annotations

import atexit
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lower-cases A-Z only, as every contract of this subpackage asks.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its row offsets; null rows are empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def texts(column: pa.Array) -> list[bytes]:
    """Each row's UTF-8 bytes; null rows are empty."""
    data, at = utf8(column)
    whole = data.tobytes()
    return [whole[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def slices(batch: pa.RecordBatch, text: str, most: int = 4 << 20):
    """The batch in pieces of at most ``most`` bytes of ``text`` (one row at least), so that long texts bound no memory but their own."""
    _, at = utf8(batch.column(batch.schema.get_field_index(text)))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(at, at[start] + most, side="right")) - 1)
        end = min(end, batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


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


def save(where: str, name: str, data: bytes) -> None:
    """Writes a file of a shared folder."""
    store, base = fs.FileSystem.from_uri(where)
    store.create_dir(base, recursive=True)
    with store.open_output_stream(f"{base}/{name}") as f:
        f.write(data)


def load_file(where: str, name: str) -> bytes:
    store, base = fs.FileSystem.from_uri(where)
    with store.open_input_stream(f"{base}/{name}") as f:
        return f.read()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that other columns of the input clash with nothing.

    Batches that go to Python are bounded by Spark itself (64 MB or one row, by its default
    spark.sql.execution.arrow.maxBytesPerBatch); operators cut them further with ``slices``.
    """
    return df.select(*(F.col(c) for c in columns))
