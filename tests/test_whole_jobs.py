"""Queries that must cover all of their input, against plain loops over all of it."""

import zlib
from collections import defaultdict

from calorine.operators import alerts, grid, registry
from calorine.plans.queries import QUERIES
from calorine.sources import codec
from calorine.sources.events import samples
from calorine.streaming import telemetry

D = "/root/testdata/sf0.001"


def test_a11_covers_every_event(spark):
    pieces = defaultdict(bytes)
    for r in samples(spark, D).orderBy("event_id").collect():
        pieces[r.node_id, r.rx_ms // 3_600_000 * 60] += r.seq.to_bytes(2, "big")
    want = {k: zlib.crc32(b"\xff\xff\xff\xff" + v) for k, v in pieces.items()}
    rows = QUERIES["a11_ordered_checksum"](spark, D).collect()
    assert len(rows) == len(want)
    assert {(r.node_id, r.hour_min): r.crc for r in rows} == want


def test_w14_gives_every_request_its_attempts(spark):
    got = defaultdict(list)
    for r in QUERIES["w14_retry_schedule"](spark, D).orderBy("seq", "attempt").collect():
        got[r.seq].append(r.next_attempt_ms - r.seq)
    assert set(got) == {r.event_id for r in samples(spark, D).collect()}
    assert all(v == [15_000, 45_000, 105_000, 225_000, 465_000, 945_000, 1_545_000, 2_145_000] for v in got.values())


def test_w14_requests_of_one_seq_are_apart(spark):
    requests = spark.createDataFrame([(10, 0), (500, 0)], "arrival long, seq long")
    assert {(r.arrival, r.attempt, r.next_attempt_ms) for r in alerts.retry_schedule(requests, 2).collect()} == {(10, 0, 15_010), (10, 1, 45_010), (500, 0, 15_500), (500, 1, 45_500)}


def test_s7_blocks_of_all_minutes(spark):
    want = grid.minute_samples(samples(spark, D)).where("present").select("node_id", "addr", "epoch_minute", "present", "centi")
    got = QUERIES["s7_minute_blocks"](spark, D).select(want.columns)
    days = {r[0] for r in got.selectExpr("epoch_minute DIV 1440").distinct().collect()}
    assert len(days) == 30  # 2024-01-01 to 2024-01-30
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_s13_exports_every_frame(spark):
    want = grid.minute_samples(samples(spark, D)).where("present").select("node_id", "addr", "epoch_minute", "centi")
    got = sorted(map(tuple, QUERIES["s13_frame_export"](spark, D).collect()))
    assert {r[2] % 60 for r in got} == set(range(60))
    assert got == sorted(map(tuple, want.collect()))


def test_s13_reads_one_frame(spark):
    minutes = grid.minute_samples(samples(spark, D))
    minute = minutes.where("present").agg({"epoch_minute": "max"}).first()[0]
    got = codec.read_frames(codec.minute_blocks(minutes), minute).select("node_id", "addr", "epoch_minute", "centi")
    want = minutes.where(f"present AND epoch_minute = {minute}").select(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_w8_has_every_slot_in_every_minute_of_the_data(spark):
    s = samples(spark, D)
    first, last = s.selectExpr("min(rx_ms)", "max(rx_ms)").first()
    dense = QUERIES["w8_dense_grid_all"](spark, D)
    r = dense.selectExpr("count(*)", "count(DISTINCT slot)", "count(DISTINCT epoch_minute)", "min(epoch_minute)", "max(epoch_minute)", "count_if(present)").first()
    minutes = (last + 180_000) // 60_000 - first // 60_000 + 1
    slots = grid.descriptor(s)
    assert tuple(r)[:5] == (slots.count() * minutes, slots.count(), minutes, first // 60_000, (last + 180_000) // 60_000)
    assert r[5] == grid.minute_samples(s).join(slots, ["node_id", "addr"], "left_semi").where("present").count() > 0
    assert grid.span(s.where("false")) == (0, 0)


def test_x7_sink_is_given_every_payload_once(spark, tmp_path):
    stored = []

    def sink(batch, batch_id):
        stored.extend((batch_id, bytes(r.payload)) for r in batch.collect())

    payloads = telemetry.event_stream(spark, D).selectExpr("CAST(CONCAT_WS(' ', event_id, addr, rx_ms, temp_c) AS BINARY) AS payload")
    telemetry.run_once(payloads, sink, str(tmp_path / "state"))
    telemetry.run_once(payloads, sink, str(tmp_path / "state"))
    want = [f"{r.event_id} {r.addr} {r.rx_ms} {r.t}".encode() for r in samples(spark, D).selectExpr("event_id", "addr", "rx_ms", "CAST(temp_c AS STRING) AS t").collect()]
    assert sorted(p for _, p in stored) == sorted(want)
    assert {i for i, _ in stored} == set(range(len({i for i, _ in stored})))


def test_slots_are_stored_and_recovered(spark, tmp_path):
    path, schema = str(tmp_path / "slots"), "k long, v double"
    registry.save_slot(spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None)], schema), path, 6)
    registry.save_slot(spark.createDataFrame([(1, 10.0), (2, 20.0)], schema), path, 7)
    assert spark.read.parquet(path).count() == 5
    assert {r.k: (r.sequence, r.v) for r in registry.load_newest(spark, path, ["k"]).collect()} == {1: (7, 10.0), 2: (7, 20.0), 3: (6, None)}
    torn = spark.read.parquet(path).selectExpr("k", "IF(k = 2 AND sequence = 7, 21.0D, v) AS v", "sequence", "crc")
    torn.write.parquet(str(tmp_path / "torn"))
    assert {r.k: (r.sequence, r.v) for r in registry.load_newest(spark, str(tmp_path / "torn"), ["k"]).collect()} == {1: (7, 10.0), 2: (6, 2.0), 3: (6, None)}


def test_s14_and_s16_store_what_they_return(spark):
    for name in ("s14_daily_state_records", "s16_calibration_blob"):
        files = QUERIES[name](spark, D).inputFiles()
        assert files and not any("events.parquet" in f for f in files)


def test_a_scope_leaves_nothing_behind(spark):
    from pathlib import Path

    from calorine.sources.shared import scope

    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before = {p.name for p in shared.iterdir()}
    for name in ("s8_hourly_blocks", "o3_node_order", "s13_missing_frames", "w2_stream_throttled", "t4_late_upserts"):
        with scope(spark):
            assert QUERIES[name](spark, D).count() > 0
        assert {p.name for p in shared.iterdir()} <= before
