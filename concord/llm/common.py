"""Helpers shared by the training-data operators: durable cuts of lineage, scratch paths, Arrow access."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). In local mode a temporary one where none is set; elsewhere none
    is an error, since no other machine would see it."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="concord-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def durable(df: DataFrame) -> DataFrame:
    """Cuts lineage with a checkpoint in the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is made durable within has its shuffle files deleted as soon as it is written, not when the driver collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


FIXED = {"boolean": 1, "int": 4, "bigint": 8, "double": 8}


def measured(df: DataFrame, most: int = 8 << 20) -> tuple[DataFrame, bool]:
    """Checkpoints a table, and tells whether its rows were measured to have at most so many bytes.

    Columns of a fixed width count by the row; only the others are looked into.
    """
    df = durable(df)
    loose = [c for c, kind in df.dtypes if kind not in FIXED]
    width = sum(FIXED.get(kind, 0) for _, kind in df.dtypes)
    size = [F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in loose]))))] if loose else []
    rows, *more = df.agg(F.count("*"), *size).first()
    return df, rows * width + sum(x or 0 for x in more) <= most


def sized(df: DataFrame, most: int = 8 << 20) -> DataFrame:
    """The checkpointed table, marked for broadcast only if it was measured to be small."""
    df, small = measured(df, most)
    return F.broadcast(df) if small else df


def small_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Lowers the bytes of an Arrow batch (64 MB unless set), so that the texts of several Python workers fit one executor.

    The setting stays, as frames that are run later need it too. It bounds memory only: no operator's result depends on it.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = re.fullmatch(r"(\d+)b?", spark.conf.get(key))
    if not held or int(held[1]) > size:
        spark.conf.set(key, str(size))


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a scratch folder that no frame reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def binary_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary or string Arrow column without copying; nulls have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32, n + 1 + column.offset)[column.offset :].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if column.null_count:
        valid = np.asarray(column.is_valid())
        lengths = np.diff(offs)
        if lengths[~valid].any():  # a writer may leave bytes under a null
            return binary_column(pa.array([v.as_buffer().to_pybytes() if v.is_valid else b"" for v in column], pa.binary()))
    return raw, offs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
