"""Schemas of the telemetry tables and messages."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    BooleanType,
    FloatType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)


def _struct(**fields) -> StructType:
    return StructType([StructField(k, t) for k, t in fields.items()])


SENSOR = _struct(addr=StringType(), tC=FloatType(), corr=BooleanType())
#: A telemetry frame: one JSON line of a node.
FRAME = _struct(type=StringType(), nodeId=LongType(), busGpio=IntegerType(), uptimeMs=LongType(), seq=LongType(), sensors=ArrayType(SENSOR))
#: The superset of all messages between bridge and GUI, told apart by ``type``.
ENVELOPE = StructType(
    [
        StructField("type", StringType()), StructField("from", LongType()), StructField("rxMs", LongType()), StructField("payload", FRAME),
        StructField("rootId", LongType()), StructField("uptimeMs", LongType()), StructField("connections", IntegerType()),
        StructField("nodes", ArrayType(_struct(id=LongType(), lastSeenMs=LongType()))), StructField("reason", StringType()),
        StructField("epoch", LongType()), StructField("tzMinutes", IntegerType()), StructField("dst", BooleanType()), StructField("source", StringType()),
        StructField("ntp", BooleanType()), StructField("ssid", StringType()), StructField("ip", StringType()), StructField("seq", LongType()),
        StructField("message", StringType()), StructField("title", StringType()), StructField("summary", BooleanType()), StructField("cache", BooleanType()), StructField("force", BooleanType()),
    ]
)
#: One reading of one sensor.
SAMPLE = _struct(event_id=LongType(), node_id=LongType(), addr=StringType(), label=StringType(), rx_ms=LongType(), temp_c=FloatType(), seq=LongType())
MINUTE = _struct(node_id=LongType(), addr=StringType(), epoch_minute=LongType(), present=BooleanType(), centi=IntegerType())
ROLLUP = _struct(node_id=LongType(), addr=StringType(), bucket=LongType(), mean_centi=IntegerType(), min_centi=IntegerType(), max_centi=IntegerType(), sample_count=IntegerType())
DAILY_STATE = _struct(node_id=LongType(), addr=StringType(), sum=LongType(), count=IntegerType(), min=IntegerType(), max=IntegerType())
CALIBRATION = _struct(addr=StringType(), a1=FloatType(), a0=FloatType())
CAL_POINT = _struct(addr=StringType(), stage=StringType(), raw=FloatType(), actual=FloatType())
ALERT = _struct(arrival=LongType(), is_summary=BooleanType(), next_attempt_ms=LongType(), backoff_ms=LongType(), seq=LongType(), cache=BooleanType(), message=StringType(), title=StringType())
BLOCK = _struct(kind=StringType(), start_min=LongType(), record=BinaryType())
