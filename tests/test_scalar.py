"""Scalar expressions against the fixtures' golden values."""

import math

import pytest
from pyspark.sql import functions as F

from calorine.functions import scalar as S
from calorine.functions.crc import crc16, crc16_bytes


def one(spark, expr, **columns):
    row = spark.createDataFrame([tuple(v for v, _ in columns.values())], ", ".join(f"{k} {t}" for k, (_, t) in columns.items())) if columns else spark.range(1)
    return row.select(expr.alias("x")).first()["x"]


def test_identity_and_calibration(spark):
    assert one(spark, S.is_identity(F.lit(1.0), F.lit(0.0)))
    assert not one(spark, S.is_identity(F.lit(1.00001), F.lit(0.0)))
    assert one(spark, S.calibrated(F.col("t"), F.lit(None).cast("float"), F.lit(None).cast("float")), t=(20.5, "float")) == 20.5


def test_boiling_point(spark):
    assert one(spark, S.boiling_point(F.lit(29.92))) == pytest.approx(99.99566, abs=1e-3)
    assert one(spark, S.station_pressure(F.lit(29.92), F.lit(5280))) == pytest.approx(24.63511, abs=1e-4)
    assert one(spark, S.boiling_point_at(F.lit(29.92), F.lit(5280))) == pytest.approx(94.66039, abs=1e-3)
    assert one(spark, S.boiling_point(F.lit(0.0))) is None
    assert one(spark, S.boiling_point(F.lit(-1.0))) is None


@pytest.mark.parametrize(("t", "want"), [(21.005, 2101), (305.0, None), (-300.0, None), (-0.005, -1), (0.0, 0), (None, None)])
def test_quantize(spark, t, want):
    assert one(spark, S.centi(F.col("t")), t=(t, "float")) == want


@pytest.mark.parametrize(("t", "want"), [(23.45, "23.5C"), (-3.25, "-3.3C"), (None, "--"), (math.nan, "--"), (0.04, "0.0C")])
def test_display(spark, t, want):
    assert one(spark, S.display(F.col("t"), "C"), t=(t, "double")) == want


@pytest.mark.parametrize(
    ("ms", "anchor", "want"),
    [(160_500, 100_000, 1_700_000_160), (40_000, 100_000, 1_700_000_040), (704, 4_294_967_000, 1_700_000_101)],
)
def test_time_mapping(spark, ms, anchor, want):
    assert one(spark, S.millis_to_epoch(F.lit(ms), F.lit(anchor), F.lit(1_700_000_100))) == want


def test_hex_and_keys(spark):
    assert one(spark, S.node_key(F.lit(268435457).cast("long"))) == "10000001"
    assert one(spark, S.node_key(F.lit(4294967295).cast("long"))) == "FFFFFFFF"
    assert one(spark, S.parse_hex16(F.lit("28175e57000000a9"))) == "28175E57000000A9"
    assert one(spark, S.parse_hex16(F.lit("28"))) is None
    assert int(one(spark, S.hex_to_number(F.lit("FFFFFFFFFFFFFFFF")))) == 2**64 - 1


def test_checksums(spark):
    data = F.lit("123456789")
    assert crc16_bytes(b"123456789") == 0x29B1
    assert one(spark, crc16(data.cast("binary"))) == 0x29B1
    assert one(spark, S.crc32_seeded(data)) == 0xD202D277
    assert one(spark, F.crc32(data)) == 0xCBF43926


def test_zones_and_flags(spark):
    assert one(spark, S.zone_text(F.lit(-330))) == "-05:30"
    assert one(spark, S.zone_text(F.lit(60), F.lit(True))) == "+02:00"
    flags = S.pack_flags(F.lit(True), F.lit(False), F.lit(True))
    assert one(spark, flags) == 5
    assert one(spark, S.has_flag(flags, S.CORRECTED))
    assert [one(spark, S.presence_bit(F.unhex(F.lit("A5C3")), F.lit(i))) for i in range(16)] == [bool(0xC3A5 >> i & 1) for i in range(16)]


def test_misc(spark):
    assert one(spark, S.ring_capacity(F.lit(7), F.lit(60_000))) == 10_080
    assert one(spark, S.ring_capacity(F.lit(7), F.lit(0))) == 0
    assert one(spark, S.raw_tail(F.lit("ntfy send  hello  there "))) == "hello  there"
    assert one(spark, S.raw_tail(F.lit("ntfy send "))) is None
    assert [one(spark, S.backoff(15_000, F.lit(n), 600_000)) for n in range(7)] == [15_000, 30_000, 60_000, 120_000, 240_000, 480_000, 600_000]
    assert one(spark, S.age_minutes(F.lit(100), F.lit(200))) == 0
    assert one(spark, S.fresh(F.lit(180_000), F.lit(0), F.lit(True)))
    assert not one(spark, S.fresh(F.lit(180_001), F.lit(0), F.lit(True)))
    # A day of 25 hours: both readings are of one local day.
    first, last = 28_837_920, 28_839_415
    assert one(spark, S.local_day(F.lit(first).cast("long"), "America/New_York")) is not None
    assert one(spark, S.local_day_start(F.lit(last).cast("long"), "America/New_York")) % 60 == 0
