"""The driver's ``events`` table as telemetry: samples, frames and lines."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def address(node_id, label):
    """A 16-digit address made of the node and the label's first letter, with the probe family's code in front."""
    return F.concat(F.lit("28"), F.lpad(F.hex(node_id), 12, "0"), F.lpad(F.hex(F.ascii(label)), 2, "0"))


def to_samples(events: DataFrame) -> DataFrame:
    """(event_id, node_id, addr, label, rx_ms, temp_c, seq): the event's user is a node, its type a sensor of it."""
    # Of the wall-clock fields: no session time zone bears on it.
    ts = F.col("ts").cast("timestamp_ntz")
    millis = F.unix_date(ts.cast("date")).cast("long") * 86_400_000 + F.hour(ts) * 3_600_000 + F.minute(ts) * 60_000 + F.floor(F.expr("extract(SECOND FROM CAST(ts AS TIMESTAMP_NTZ))") * 1000)
    return events.select(
        "event_id",
        F.col("user_id").alias("node_id"),
        address(F.col("user_id"), F.col("event_type")).alias("addr"),
        F.col("event_type").alias("label"),
        millis.cast("long").alias("rx_ms"),
        F.col("value").cast("float").alias("temp_c"),
        F.get_json_object("props", "$.k").cast("long").alias("seq"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_samples(read_events(spark, sf_dir))


def samples_between(spark: SparkSession, sf_dir: str, start_ms: int, end_ms: int) -> DataFrame:
    """the samples of [start, end), by a filter that reaches the scan's row-group statistics."""
    literal = lambda ms: F.expr(f"TIMESTAMP_NTZ'{(datetime(1970, 1, 1) + timedelta(milliseconds=ms)).isoformat(sep=' ')}'")
    return to_samples(read_events(spark, sf_dir).where((F.col("ts") >= literal(start_ms)) & (F.col("ts") < literal(end_ms))))
