"""Minutes, hours and days under late data: mergeable partials, kept by day and batch.

A micro-batch's readings become the latest reading of each (sensor, minute), which is a maximum and so merges in any order.  Its
partials go to a folder of their own, named for the batch: a batch that is tried again writes the same folder anew, and a late reading
adds a partial to its old day.  Hours and days of the days a batch touched are then made from all their partials and overwritten.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calorine.functions import scalar as S
from calorine.operators import grid, rollup
from calorine.sources.shared import delete


def _dated(minutes: DataFrame, zone: str) -> DataFrame:
    return minutes.withColumn("day", F.date_format(S.local_day(F.col("hour_min"), zone), "yyyyMMdd").cast("int"))


def read_minutes(spark: SparkSession, path: str, days: list[int] | None = None) -> DataFrame:
    """The minutes of all partials of some days, or of all: each minute's latest reading over all batches."""
    rows = spark.read.parquet(f"{path}/minutes").drop("batch")
    rows = rows if days is None else rows.where(F.col("day").isin(days))
    # Dealt once, by sensor and hour: for the minute's choice here and a rollup by hour after it.
    return grid.finish_minutes(grid.latest_readings(rows.repartition("node_id", "addr", "hour_min")))


def upsert_days(path: str, zone: str = "UTC") -> Callable[[DataFrame, int], None]:
    """A micro-batch sink that keeps hours and days right whatever order readings come in.

    For ``foreachBatch``, with samples as a batch.  Nothing is dropped as late, and a replay changes nothing.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        own = f"{path}/minutes/batch={batch_id}"
        _dated(grid.minute_readings(batch), zone).hint("rebalance", "day").write.partitionBy("day").mode("overwrite").parquet(own)
        days = day_folders(spark, own)
        if not days:
            return
        hours = rollup.hourly_rollup(read_minutes(spark, path, days))
        _overwrite(_dated(hours, zone), f"{path}/hours")
        stored = spark.read.parquet(f"{path}/hours").where(F.col("day").isin(days)).drop("day")
        _overwrite(rollup.daily_rollup(stored, zone).withColumn("day", F.date_format("day", "yyyyMMdd").cast("int")), f"{path}/days")

    return sink


def day_folders(spark: SparkSession, path: str) -> list[int]:
    """The days of a table that is kept by day; none of an empty one."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/day=*")
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where) or []
    return sorted(int(f.getPath().getName().split("=")[1]) for f in found)


def _overwrite(rows: DataFrame, path: str) -> None:
    """The days that ``rows`` holds replace the stored ones; other days stay.  A day's rows come together, and a large day is split."""
    rows.hint("rebalance", "day").write.partitionBy("day").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def compact(spark: SparkSession, path: str, below: int, zone: str = "UTC") -> None:
    """Merge the partials of batches before ``below`` into one.  Maxima count once however often they stand, so a crash between the steps harms nothing."""
    rows = spark.read.parquet(f"{path}/minutes").where(F.col("batch") < below)
    old = [r["batch"] for r in rows.select("batch").distinct().collect()]
    if len(old) < 2:
        return
    spot = f"{path}/minutes/batch={min(old) - 1}"
    _dated(grid.latest_readings(rows), zone).hint("rebalance", "day").write.partitionBy("day").mode("overwrite").parquet(spot)
    for batch in old:
        delete(spark, f"{path}/minutes/batch={batch}")


def read_days(spark: SparkSession, path: str) -> DataFrame:
    """The daily rollup as it stands: ``day`` as a date."""
    return spark.read.parquet(f"{path}/days").withColumn("day", F.to_date(F.col("day").cast("string"), "yyyyMMdd"))
