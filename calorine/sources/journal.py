"""The hour journal: a frame a minute with a checksum of its own, recovered up to the first that is missing or unsound.

An hour's sensors lie in blocks of at most 100 slots; a block's layout is a hash of them in order.  Frames go to the journal minute by minute,
and a minute without a sample gets an empty frame once a later one is written.  After a crash a block's journal holds to the longest run of sound
frames from the hour's start; it goes on from there only where the layout is still the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calorine.operators.registry import newest_valid_slot, row_crc
from calorine.sources.codec import blocked, sensor_hours

BLOCK = ["hour_min", "block"]
SUMMED = ["hour_min", "block", "layout", "minute", "cells", "sequence"]


def slots(grid: DataFrame) -> DataFrame:
    """(hour_min, block, slot, node_id, addr, minutes) of a minute grid; ``slot`` is the place in its block."""
    rows = blocked(sensor_hours(grid.where("present")), "hour_min")
    return rows.withColumn("slot", F.pmod("slot", F.lit(100)).cast("int"))


def layouts(placed: DataFrame) -> DataFrame:
    """(hour_min, block, layout): a hash of the block's sensors in order."""
    sensors = F.array_sort(F.collect_list(F.struct("slot", "node_id", "addr")))
    return placed.groupBy(*BLOCK).agg(F.xxhash64(sensors.cast("string")).alias("layout"))


def frames(placed: DataFrame, sequence: int = 1) -> DataFrame:
    """The journal's frames: (hour_min, block, layout, minute, cells, sequence, crc), one for every minute up to the block's last.

    cells: the minute's (slot, centi) in order of slots; a value out of range has none.
    """
    cells = placed.select(*BLOCK, "slot", F.explode("minutes").alias("m")).select(*BLOCK, F.col("m.minute").alias("minute"), F.struct("slot", F.col("m.centi").alias("centi")).alias("cell"))
    written = cells.groupBy(*BLOCK, "minute").agg(F.array_sort(F.collect_list("cell")).alias("cells"))
    filled = cells.groupBy(*BLOCK).agg(F.max("minute").alias("last")).select(*BLOCK, F.explode(F.sequence(F.lit(0), F.col("last"))).alias("minute"))
    rows = filled.join(written, [*BLOCK, "minute"], "left").join(layouts(placed), BLOCK)
    empty = F.array().cast("array<struct<slot:int,centi:int>>")
    made = rows.select(*BLOCK, "layout", "minute", F.coalesce("cells", empty).alias("cells"), F.lit(sequence).cast("long").alias("sequence"))
    return made.withColumn("crc", row_crc(SUMMED))


def append(made: DataFrame, path: str) -> None:
    """Frames are added; what is there stays.  A frame written again has a higher sequence."""
    made.write.mode("append").parquet(path)


def recovered(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """(hour_min, block, layout, minute, cells): of each block the frames of the longest sound run from its first minute.

    expected: (hour_min, block, layout); frames of another layout don't count.  Of frames of one minute the sound one of the highest sequence counts.
    """
    stored = spark.read.parquet(path)
    checked = stored.withColumn("valid", F.col("crc") == row_crc(SUMMED)).drop("crc")
    sound = newest_valid_slot(checked.join(expected, [*BLOCK, "layout"]), [*BLOCK, "layout", "minute"]).drop("sequence")
    one = F.lit(1).cast("long")
    held = sound.groupBy(*BLOCK).agg(F.bit_or(F.call_function("shiftleft", one, F.col("minute"))).alias("mask"))
    # The lowest bit that isn't set ends the run; below it there are as many ones as the run has frames.
    run = F.bit_count(F.bitwise_not("mask").bitwiseAND(F.col("mask") + one) - one)
    return sound.join(held.select(*BLOCK, run.alias("run")), BLOCK).where("minute < run").drop("run")


def readings(kept: DataFrame, placed: DataFrame) -> DataFrame:
    """(node_id, addr, epoch_minute, centi): what recovered frames hold."""
    cells = kept.select(*BLOCK, "minute", F.explode("cells").alias("c")).select(*BLOCK, "minute", "c.slot", "c.centi")
    return cells.join(placed.select(*BLOCK, "slot", "node_id", "addr"), [*BLOCK, "slot"]).select("node_id", "addr", (F.col("hour_min") + F.col("minute")).alias("epoch_minute"), "centi")


def resumed(made: DataFrame, kept: DataFrame) -> DataFrame:
    """Of frames that should stand in the journal those that recovery didn't find, to be appended."""
    return made.join(kept.select(*BLOCK, "minute"), [*BLOCK, "minute"], "left_anti")
