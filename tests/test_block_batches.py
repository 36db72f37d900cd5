"""Python holds a few blocks at a time, however many a task has."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from calorine.sources import codec


class Caught:
    """Stands for a table and runs what it is mapped by on given batches."""

    def __init__(self, batches):
        self.batches = batches

    def select(self, *names):
        return self

    def mapInArrow(self, step, schema):
        return list(step(iter(self.batches)))


def given(blocks):
    """The columns of the rows that go to Python."""
    return blocks._jdf.queryExecution().analyzed().children().apply(0).schema().fieldNames()


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def grid_of(spark):
    """Three hours of 250, 100 and 1 sensors, some minutes without a number or not present."""
    rows = spark.range(250 * 60).select((F.col("id") % 250).alias("node_id"), (F.col("id") / 250).cast("long").alias("m")).withColumn("hour_min", F.explode(F.array(*[F.lit(h).cast("long") for h in (6000, 6060, 6120)])))
    kept = rows.where("node_id < CASE hour_min WHEN 6000 THEN 250 WHEN 6060 THEN 100 ELSE 1 END AND (node_id + m) % 7 < 5")
    centi = F.when((F.col("m") % 11 != 0) & (F.col("m") % 5 != 0), (F.col("node_id") * 60 + F.col("m") - 9000).cast("int"))
    return kept.select("node_id", F.format_string("28%014X", "node_id").alias("addr"), (F.col("hour_min") + F.col("m")).alias("epoch_minute"), "hour_min", (F.col("m") % 5 != 0).alias("present"), centi.alias("centi"))


def test_minute_blocks_across_batches(spark, small_batches):
    grid = grid_of(spark)
    blocks = codec.minute_blocks(grid)
    assert {"node_id", "minutes"} <= set(given(blocks))  # a row a sensor, not a block
    assert sorted((r.hour_min, r.block, r.sensors) for r in blocks.collect()) == [(6000, 0, 100), (6000, 1, 100), (6000, 2, 50), (6060, 0, 100), (6120, 0, 1)]
    names = ["node_id", "addr", "epoch_minute", "present", "centi"]
    every = codec.decode_minutes(blocks)
    assert every.count() == 351 * 60 and every.where("NOT frame_ok").count() == 0
    want = sorted(map(tuple, grid.where("present").select(names).collect()), key=str)
    assert sorted(map(tuple, codec.decode_minutes(blocks, present_only=True).select(names).collect()), key=str) == want
    assert sorted(map(tuple, every.where("present").select(names).collect()), key=str) == want


def test_minutes_are_decoded_few_blocks_at_a_time():
    import numpy as np

    record = codec.encode_minute_block(6000, range(100), [f"28{i:014X}" for i in range(100)], np.ones((60, 100), bool), np.ones((60, 100), np.int64))
    batches = [pa.RecordBatch.from_pydict({"record": pa.array([record] * 100, pa.binary())})]
    out = codec.decode_minutes(Caught(batches))
    assert sum(b.num_rows for b in out) == 600_000 and max(b.num_rows for b in out) <= 16 * 6000


def test_rollup_blocks_across_batches(spark, small_batches):
    hours = grid_of(spark).groupBy("hour_min", "node_id", "addr").agg(F.min("centi").alias("min_centi"), F.max("centi").alias("max_centi"), F.count("centi").cast("int").alias("sample_count"))
    hours = hours.withColumn("mean_centi", F.when(F.col("node_id") % 3 != 0, F.col("max_centi")))
    for daily in (False, True):
        blocks = codec.rollup_blocks(hours, "hour_min", daily)
        assert {"node_id", "mean_centi"} <= set(given(blocks))  # a row a sensor, not a block
        names = ["node_id", "addr", "mean_centi", "min_centi", "max_centi", "sample_count"]
        got = sorted(map(tuple, codec.decode_rollups(blocks).select("start_min", *names).collect()), key=str)
        assert got == sorted(map(tuple, hours.select("hour_min", *names).collect()), key=str) and len(got) == 351
        assert sorted(map(tuple, codec.verify(blocks).select("start_min", "block", "header_ok", "payload_ok").collect())) == [(6000, 0, True, True), (6000, 1, True, True), (6000, 2, True, True), (6060, 0, True, True), (6120, 0, True, True)]


def test_rollups_are_decoded_few_blocks_at_a_time():
    one = [1] * 100
    record = codec.encode_rollup_block(codec.HROL, 6000, range(100), [f"28{i:014X}" for i in range(100)], one, one, one, one)
    out = codec.decode_rollups(Caught([pa.RecordBatch.from_pydict({"record": pa.array([record] * 1000, pa.binary())})]))
    assert sum(b.num_rows for b in out) == 100_000 and max(b.num_rows for b in out) <= 1600


def test_hours_of_frames_have_a_row_a_slot():
    import numpy as np

    minutes, slots = np.arange(60)[:, None], np.arange(100)[None, :]
    present = (minutes * 7 + slots * 3) % 5 < 3
    record = codec.encode_minute_block(6000, range(100), [f"28{i:014X}" for i in range(100)], present, np.ones((60, 100), np.int64))
    torn = bytearray(codec.encode_minute_block(6060, [7], ["28" + "0" * 14], np.ones((60, 1), bool), np.ones((60, 1), np.int64)))
    torn[codec.MINUTE_HEADER.size + 12 + 59 * codec.frame_layout(1)[1]] ^= 2  # a bad frame in a payload whose checksum is made to hold
    f = list(codec.MINUTE_HEADER.unpack(bytes(torn[: codec.MINUTE_HEADER.size])))
    f[12] = codec.seeded_crc(bytes(torn[codec.MINUTE_HEADER.size :]))
    torn[: codec.MINUTE_HEADER.size] = codec._sealed(codec.MINUTE_HEADER, *f[:-1])
    spoilt = record[:-1] + bytes([record[-1] ^ 1])
    out = codec.frame_hours(Caught([pa.RecordBatch.from_pydict({"record": pa.array([record] * 40 + [spoilt, b""] + [bytes(torn)], pa.binary())})]))
    assert max(b.num_rows for b in out) <= 16 * 100  # not 60 times that
    rows = [tuple(r.values()) for b in out for r in b.to_pylist()]
    want = [(i, f"28{i:014X}", 6000, 60, 60 - int(present[:, i].sum()), sum(1 << m for m in range(60) if present[m, i])) for i in range(100)]
    assert rows == want * 40 + [(7, "28" + "0" * 14, 6060, 60, 1, (1 << 59) - 1)]


def test_missing_frames_are_not_expanded(spark):
    from calorine.plans.queries import QUERIES

    plan = QUERIES["s13_missing_frames"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # an hour's frames are counted where they are decoded


@pytest.mark.parametrize("name", ["s8_hourly_blocks", "s9_daily_blocks", "s11_verify_blocks"])
def test_a_task_has_one_python_worker(spark, name):
    from calorine.plans.queries import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") + plan.count("ArrowEvalPython") == 1, plan


def test_s7_python_takes_no_more_for_more_blocks(spark, tmp_path, monkeypatch):
    """A task of 100 whole minute blocks, 600,000 minutes: what encoding and decoding add to a worker's memory."""
    folder = str(tmp_path)

    def measured(step):
        def run(stream):
            import os
            import re

            def peak():
                return int(re.search(r"VmHWM:\s+(\d+)", open("/proc/self/status").read())[1]) // 1024

            open("/proc/self/clear_refs", "w").write("5")  # the peak starts at what the worker holds now
            before = peak()
            yield from step(stream)
            open(f"{folder}/{os.getpid()}-{peak() - before}.mb", "w").close()

        return run

    for name in ("mapInArrow", "mapInPandas"):
        plain = getattr(type(spark.range(1)), name)
        monkeypatch.setattr(type(spark.range(1)), name, lambda df, step, schema, plain=plain: plain(df, measured(step), schema))
    cell = spark.range(600_000).selectExpr("id % 100 AS node_id", "id DIV 6000 * 60 AS hour_min", "id DIV 100 % 60 AS m")
    grid = cell.selectExpr("node_id", "lpad(hex(node_id), 16, '0') AS addr", "hour_min + m AS epoch_minute", "hour_min", "true AS present", "CAST(m AS INT) AS centi")
    monkeypatch.setattr(codec, "blocked", lambda rows, *keys: rows.selectExpr("*", "node_id AS slot", "0 AS block").coalesce(1))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        codec.minute_blocks(grid).write.parquet(f"{folder}/blocks")
        back = codec.decode_minutes(spark.read.parquet(f"{folder}/blocks"), present_only=True)
        assert back.selectExpr("count(*)", "sum(centi)", "count(DISTINCT epoch_minute)").first() == (600_000, 17_700_000, 6000)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    grown = [int(f.stem.split("-")[1]) for f in tmp_path.glob("*.mb")]
    assert len(grown) >= 2 and max(grown) < 80, grown
