"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset and everything runs in one process (tests), a temporary folder is made once
    and set as the checkpoint folder of the context; on a cluster that is an error.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    set_dir = spark.sparkContext.getCheckpointDir()
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="footgrid-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


#: Folders made inside each open ``cleared`` block, the innermost last.
_made: list[list[str]] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _made:
        _made[-1].append(path)
    return path


def deleted(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Spark's own file system classes."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the step folders made inside; what is still needed then is written outside the block
    from a table that the block leaves behind (``leave``)."""
    _made.append([])
    try:
        yield
    finally:
        for path in _made.pop():
            deleted(spark, path)


def leave(df: DataFrame, name: str) -> DataFrame:
    """``written``, but not deleted with the open block."""
    own = _made.pop() if _made else None
    try:
        path = new_folder(df.sparkSession, name)
    finally:
        if own is not None:
            _made.append(own)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back: a cut of the lineage
    that outlives any executor."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Whole texts of an Arrow batch; null counts as empty."""
    return ["" if x is None else x for x in batch.column(column).to_pylist()]


def encoded(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """Whole texts as UTF-8; null counts as empty."""
    return ["".encode() if x is None else x for x in batch.column(column).cast(pa.large_binary()).to_pylist()]


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
