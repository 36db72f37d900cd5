"""Tables in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Folders of the innermost open ``scope``.
_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)


def _place(spark: SparkSession, path: str):
    """(file system, path) as Spark's own readers and writers have them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which ``spark.checkpoint.dir`` names; only a local session may go without that setting.

    What is written there is deleted when the ``scope`` is left in which the path was made, or else when the application ends: a result that
    isn't read yet may need it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    own = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    paths = _scope.get()
    if paths is None:
        files, where = _place(spark, own)
        files.mkdirs(where)
        files.deleteOnExit(where)  # of what exists
    else:
        paths.append(own)
    return f"{own}/rows"


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """What operators and queries write inside goes when this is left: results must be read, or written elsewhere, by then.

    For streams that go on for ever, whose batches would else leave tables until the application ends, and for sessions of many queries.
    """
    paths: list[str] = []
    before = _scope.set(paths)
    try:
        yield
    finally:
        _scope.reset(before)
        for path in paths:
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder now, in whatever file system that is."""
    files, where = _place(spark, path)
    files.delete(where, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read again: all that follows sees the same ones, whatever executors are lost."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def batch_before(spark: SparkSession, path: str, batch_id: int) -> int | None:
    """The last micro-batch before a given one that has left a whole table in ``path/batch=N``; None if none has."""
    files, where = _place(spark, f"{path}/batch=*/_SUCCESS")
    found = files.globStatus(where) or []
    done = [int(f.getPath().getParent().getName().split("=")[1]) for f in found]
    return max((i for i in done if i < batch_id), default=None)
