"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: With this setting a step's shuffle files go when the step is done, not when the driver happens to collect garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every machine shares, as ``spark.checkpoint.dir`` names it.

    Only a local session without that setting (a test) gets a temporary folder; on a cluster its absence is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        named = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def cleaning(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the steps inside are deleted as each step ends."""
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared folder, in whatever file system that is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Delete a folder that exists when the application ends, for what a result that isn't read yet still needs."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


class Steps:
    """Tables that an operator writes on its way and deletes when their successors are written; the last ones go when the application ends.

    ``write`` cuts the lineage: what a lost executor held is read again from the shared folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, scratch(spark, name)
        self.written: list[tuple[DataFrame, str]] = []
        self.count = 0

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{self.count}"
        self.count += 1
        with cleaning(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        if self.count == 1:
            delete_at_exit(self.spark, self.folder)
        made = self.spark.read.schema(df.schema).parquet(path)
        self.written.append((made, path))
        return made

    def drop(self, *frames: DataFrame) -> None:
        for made, path in [w for w in self.written if any(w[0] is f for f in frames)]:
            delete(self.spark, path)
            self.written = [w for w in self.written if w[1] != path]


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read again, for results that go on to be used by the caller."""
    return Steps(df.sparkSession, "cut").write(df)


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone: further columns of the input can't clash with an operator's own."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def numbered(df: DataFrame) -> DataFrame:
    """The columns by number, ``c0`` and on: whatever their names were, they clash with nothing and need no quoting."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
