"""Grid, rollups, health, history, alerts, sources and codecs on small fixtures."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from calorine.operators import alerts, calibration, grid, health, history, registry, rollup
from calorine.sources import codec, ndjson
from calorine.sources.events import to_samples

A = "28175E57000000A9"
BASE = 28_400_040 * 60_000  # the start of an hour, in ms
SAMPLE = "event_id long, node_id long, addr string, label string, rx_ms long, temp_c float, seq long"


def samples(spark, rows):
    return spark.createDataFrame([(i, 1, A, "a", BASE + s * 1000, t, 1) for i, (s, t) in enumerate(rows)], SAMPLE)


def minutes(spark, rows):
    return {r.epoch_minute - BASE // 60_000: (r.present, r.centi) for r in grid.minute_samples(samples(spark, rows)).collect()}


def test_snapshots(spark):
    assert minutes(spark, [(30, 20.0)]) == {m: (True, 2000) for m in (1, 2, 3)}
    assert minutes(spark, [(30, 20.0), (90, None)]) == {1: (True, 2000), 2: (False, None), 3: (False, None), 4: (False, None)}
    assert minutes(spark, [(20, 20.0), (40, 305.0)])[1] == (True, None)
    assert set(minutes(spark, [(0, 1.0)])) == {0, 1, 2, 3}  # exactly at the minute, and exactly 180 s old


def test_hourly_rounding(spark):
    rows = [(1, A, m, 0, True, c) for m, c in enumerate((100, 101))] + [(2, A, m, 0, True, c) for m, c in enumerate((-100, -101))] + [(3, A, 0, 0, True, None)]
    grid_rows = spark.createDataFrame(rows, "node_id long, addr string, epoch_minute long, hour_min long, present boolean, centi int")
    got = {r.node_id: (r.mean_centi, r.min_centi, r.max_centi, r.sample_count) for r in rollup.hourly_rollup(grid_rows).collect()}
    assert got == {1: (101, 100, 101, 2), 2: (-101, -101, -100, 2), 3: (None, None, None, 0)}


HOUR = "node_id long, addr string, hour_min long, mean_centi int, min_centi int, max_centi int, sample_count int"


def test_daily_mean_of_rounded_means(spark):
    hours = spark.createDataFrame([(1, A, 0, 101, 100, 101, 2), (1, A, 60, 50, 50, 50, 1), (1, A, 120, None, None, None, 0)], HOUR)
    r = rollup.daily_rollup(hours).first()
    assert (r.mean_centi, r.sample_count, r.min_centi, r.max_centi) == (84, 3, 50, 101)
    halves = [rollup.daily_state(hours.where(c)) for c in ("hour_min = 0", "hour_min > 0")]
    m = rollup.finalize_states(rollup.merge_states(*halves)).first()
    assert (m.mean_centi, m.sample_count) == (84, 3)


def test_day_count_is_clamped_and_the_long_day_is_whole(spark):
    # 2024-11-03 in New York has 25 hours, from 04:00 UTC on.
    start = 28_843_440
    hours = spark.createDataFrame([(1, A, start + 60 * h, 10, 10, 10, 60) for h in range(25)], HOUR)
    r = rollup.daily_rollup(hours, "America/New_York").collect()
    assert len(r) == 1
    assert r[0].sample_count == 1440
    assert r[0].mean_centi == 10  # round(15000 / 1440)


def test_rebuild_takes_the_last_record(spark):
    stored = spark.createDataFrame([(1, A, 0, 10, 10, 10, 1, 0), (1, A, 0, 30, 30, 30, 1, 1)], HOUR + ", place int")
    assert rollup.rebuild_day(stored, "place", "1970-01-01").first().mean_centi == 30


def test_sequence_health(spark):
    rows = [(1, t, t, s) for t, s in ((0, 5), (10, 6), (20, 6), (30, 6), (40, 3), (50, 0), (60, 4))]
    frames = spark.createDataFrame(rows, "node_id long, rx_ms long, event_id long, seq long")
    got = {r.rx_ms: (r["class"], r.dup_run) for r in health.classify_sequence(frames).collect()}
    assert got == {0: ("first", 0), 10: ("advance", 0), 20: ("duplicate", 1), 30: ("duplicate", 2), 40: ("reset", 0), 60: ("advance", 0)}
    assert health.sequence_stuck(frames, 35, 20).first().stuck
    assert not health.sequence_stuck(frames, 45, 20).first().stuck


def test_severity_order(spark):
    flags = [F.lit(x) for x in (True, True, True, True, True)]
    assert spark.range(1).select(health.severity(*flags).alias("x")).first().x == "alert"
    assert spark.range(1).select(health.severity(F.lit(False), F.lit(False), F.lit(False), F.lit(False), F.lit(True)).alias("x")).first().x == "missing"


def test_masks(spark):
    frames = spark.createDataFrame([(60 + m, v) for m, v in ((0, True), (1, True), (4, False))], "epoch_minute long, valid boolean")
    r = grid.bad_minutes(frames).first()
    assert r.bad_frame_mask == ((1 << 60) - 1) ^ 3
    assert r.bad_count == 58


def test_descriptor_cap_and_equality(spark):
    s = spark.createDataFrame([(n, f"{n:016X}") for n in range(101)] + [(0, "28")], "node_id long, addr string")
    d = grid.descriptor(s)
    assert d.count() == 100
    assert d.agg(F.max("node_id")).first()[0] == 99
    assert grid.same_descriptor(d, d).first().same
    assert not grid.same_descriptor(d, d.where("slot > 0")).first().same


def test_dense_grid_fills_gaps(spark):
    s = samples(spark, [(30, 20.0)])
    start = BASE // 60_000
    got = grid.dense_grid(grid.descriptor(s), grid.minute_samples(s), start, start + 60).collect()
    assert len(got) == 60
    assert sum(r.present for r in got) == 3


def test_two_point_solve(spark):
    points = spark.createDataFrame(
        [("a", "ICE", 0.25, 0.0), ("a", "BOIL", 99.5, 100.0), ("b", "ICE", 0.0, 0.0), ("c", "ICE", 50.0, 0.0), ("c", "BOIL", 50.00005, 100.0)], "addr string, stage string, raw double, actual double"
    )
    (r,) = calibration.solve_two_point(points).collect()
    assert (r.addr, r.a1, r.a0) == ("a", pytest.approx(1.0075566750629723), pytest.approx(-0.2518891687657431))


def test_apply_and_attachment(spark):
    s = spark.createDataFrame([("AA", 10.0), ("BB", 10.0), ("CC", None)], "addr string, temp_c float")
    table = spark.createDataFrame([("aa", 2.0, 1.0), ("BB", 1.0, 0.0), ("DD", 1.0, 1.0)], "addr string, a1 float, a0 float")
    got = {r.addr: (r.temp_c, r.corrected) for r in calibration.apply_calibration(s, table).collect()}
    assert got == {"AA": (21.0, True), "BB": (10.0, False), "CC": (None, False)}
    assert {(r.addr, r.state) for r in calibration.attachment(s, table).collect()} == {("AA", "calibrated"), ("BB", "calibrated"), ("CC", "uncalibrated"), ("DD", "orphan")}


def test_steady_is_against_the_anchor(spark):
    drift = [(t * 5_000, 20.0 + 0.0004 * t) for t in range(20)]
    rows = spark.createDataFrame([("a", ms, i, v) for i, (ms, v) in enumerate(drift)], "addr string, rx_ms long, event_id long, temp_c double")
    got = [r.steady for r in calibration.steady(rows).orderBy("rx_ms").collect()]
    assert not any(got)  # a change every third reading, though no two neighbours differ by more than eps
    still = spark.createDataFrame([("a", t * 10_000, t, 20.0) for t in range(5)] + [("a", 50_000, 5, None)], "addr string, rx_ms long, event_id long, temp_c double")
    assert [r.steady for r in calibration.steady(still).orderBy("rx_ms").collect()] == [False, False, False, True, True, False]


def test_throttle_against_a_plain_loop(spark):
    rng = random.Random(4)
    rows, ms = [], 0
    for i in range(300):
        ms += rng.choice((0, 1, 5, 9))
        rows.append((i, rng.randrange(3), rng.choice("ab"), "x", ms, rng.choice((None, 1.0, 2.0, 3.0)), 1))
    want = []
    for n in range(3):
        last, values = None, {}
        times = sorted({r[4] for r in rows if r[1] == n})
        for t in times:
            for r in rows:
                if r[1] == n and r[4] == t:
                    values[r[2]] = r[5]
            if last is None or t - last >= 10:
                last = t
                want += [(n, t, a, v) for a, v in values.items() if v is not None]
    got = [tuple(r) for r in history.throttled(spark.createDataFrame(rows, SAMPLE), 10).collect()]
    assert sorted(got) == sorted(want)
    assert history.throttled(spark.createDataFrame(rows, SAMPLE), 0).count() == 0


def test_ring_and_backfill(spark):
    s = samples(spark, [(i, float(i)) for i in range(8)])
    kept = history.retain(s, 3)
    assert {r.temp_c for r in kept.collect()} == {5.0, 6.0, 7.0}
    assert [r.temp_c for r in history.view(s, A, 2).collect()] == [6.0, 7.0]
    rows = spark.createDataFrame([(1, "a", 160_500, None), (1, "b", 40_000, None), (1, "a", 1, 5), (2, "a", 1, None)], "node_id long, addr string, ms long, epoch long")
    anchors = spark.createDataFrame([(1, 100_000, 1_700_000_100)], "node_id long, anchor_ms long, anchor_epoch long")
    filled = history.backfill_epochs(rows, anchors)
    assert {(r.node_id, r.ms): r.epoch for r in filled.collect()} == {(1, 160_500): 1_700_000_160, (1, 40_000): 1_700_000_040, (1, 1): 5, (2, 1): None}
    r = history.backfill_report(filled).first()
    assert (r.samples, r.sensors, r.example_addr) == (2, 2, "b")


def test_queue(spark):
    rows = [(i, i % 3 != 0, 100 + i, 15_000, i, True, "m" if i != 4 else "", "t") for i in range(30)]
    queue = spark.createDataFrame(rows, "arrival long, is_summary boolean, next_attempt_ms long, backoff_ms long, seq long, cache boolean, message string, title string")
    admitted = alerts.admit(queue)
    assert admitted.count() == 20
    assert admitted.agg(F.max("arrival")).first()[0] == 20
    late = queue.withColumn("next_attempt_ms", F.when(F.col("is_summary"), 1).otherwise(50))
    assert not alerts.next_due(late, 60).first().is_summary
    assert alerts.next_due(late, 10).first().is_summary
    assert alerts.next_due(late, 0).count() == 0
    failed = alerts.after_failure(queue.withColumn("backoff_ms", F.lit(400_000)), 7).first()
    assert (failed.next_attempt_ms, failed.backoff_ms) == (400_007, 600_000)
    sent = {r.seq: r.ok for r in alerts.deliver(queue.where("arrival < 3"), lambda title, message: message == "m").collect()}
    assert sent == {0: True, 1: True, 2: True}


def test_frames(spark):
    lines = [
        '{"type":"temps","nodeId":4294967295,"seq":1,"sensors":[{"addr":"28175E57000000A9","tC":23.5,"corr":true},{"addr":"28","tC":1},{"addr":"28175E57000000AA"}]}',
        '{"sensors":[{"addr":"28175E57000000AB","tC":"x"},{"addr":"28175E57000000AC","tC":-127}]}',
        '{"type":',
        '{"type":"root_probe"}',
    ]
    df = spark.createDataFrame([(7, i, x) for i, x in enumerate(lines)], "`from` long, rx_ms long, line string")
    routed = ndjson.route(df)
    assert routed.count() == 3
    got = {r.addr[-2:]: (r.node_id, r.bus_gpio, r.seq, r.temp_c, r.has_value, r.corrected) for r in ndjson.frames_to_samples(routed).collect()}
    assert got == {"A9": (4294967295, -1, 1, 23.5, True, True), "AA": (4294967295, -1, 1, None, False, False), "AB": (7, -1, 0, None, False, False), "AC": (7, -1, 0, None, False, False)}


def test_lines(spark):
    df = spark.createDataFrame([("a\r\n\nb\n",), (None,), ("",)], "t string")
    assert sorted(r.line for r in ndjson.split_lines(df, "t").collect()) == ["a", "b"]


@pytest.mark.parametrize(("n", "want"), [(1, (4, 8)), (2, (4, 12)), (8, (4, 24)), (32, (4, 72)), (33, (8, 76)), (100, (16, 220))])
def test_frame_layout(n, want):
    assert codec.frame_layout(n) == want


def test_blocks_round_trip_and_damage():
    rng = np.random.default_rng(1)
    n = 33
    nodes, addrs = np.arange(n), [f"{0x28 << 56 | i:016X}" for i in range(n)]
    present, values = rng.random((60, n)) < 0.5, rng.integers(-30_000, 30_000, (60, n))
    record = codec.encode_minute_block(28_400_040, nodes, addrs, present, values, 5)
    assert len(record) == 48 + 12 * n + 60 * 76
    assert record[:4] == b"MINH"
    hour, slots, p, v, ok, sound = codec.decode_minute_block(record)
    assert hour == 28_400_040 and sound and ok.all() and (p == present).all() and (v == values).all() and slots["node"].tolist() == nodes.tolist()
    bad = bytearray(record)
    bad[48 + 12 * n + 76 * 3] ^= 1
    _, _, _, _, ok, sound = codec.decode_minute_block(bytes(bad))
    assert not sound and not ok[3] and ok.sum() == 59
    bad = bytearray(record)
    bad[12] ^= 1
    assert codec.decode_minute_block(bytes(bad)) is None
    assert codec.decode_minute_block(record[:40]) is None
    rolled = codec.encode_rollup_block(codec.HROL, 60, [1, 2], addrs[:2], [5, None], [4, None], [6, None], [2, 0])
    assert len(rolled) == 36 + 2 * 20 and rolled[:4] == b"HROL"
    magic, start, _, rows, sound = codec.decode_rollup_block(rolled)
    assert (magic, start, sound, rows["mean"].tolist(), rows["count"].tolist()) == (codec.HROL, 60, True, [5, -32768], [2, 0])
    with pytest.raises(ValueError):
        codec.encode_rollup_block(codec.HROL, 0, [], [], [], [], [], [])


def test_state_journal_and_calibration_records():
    old, new = codec.encode_daily_state(1, 10, []), codec.encode_daily_state(2, 20, [(1, A, -5, 3, -4, 9)])
    assert len(new) == 64 + 32
    assert codec.newest_slot(old, new) == (2, 20, [(1, A, -5, 3, -4, 9)])
    assert codec.newest_slot(old, new[:-1] + b"x") == (1, 10, [])
    assert codec.newest_slot(b"", b"") is None
    head = codec.encode_journal_header(3, 8, 60, 5, 64)
    assert len(head) == 32
    assert codec.decode_journal_header(head) == (3, 8, 60, 5, 64)
    assert codec.decode_journal_header(codec.encode_journal_header(3, 8, 60, 61, 64)) is None
    blob = codec.encode_calibration([(A, 1.5, -0.25), ("28", 1.0, 0.0)])
    assert len(blob) == 12 + 16 and struct.unpack("<I", blob[:4])[0] == 0x43414C31
    assert codec.decode_calibration(blob) == [(A, 1.5, -0.25)]
    assert codec.decode_calibration(blob[:-1] + b"\x00") is None or blob[-1] == 0
    assert codec.decode_calibration(blob + b"x") is None


def test_registry(spark):
    scans = spark.createDataFrame([("n", 6, -70, 1), ("n", 11, -50, 2), ("n", 0, -10, 3)], "ssid string, channel long, rssi long, seen_ms long")
    assert registry.best_channel(scans).first().channel == 11
    assert {r.channel for r in registry.scan_channels(scans).collect()} == {6, 11}
    stored, new = spark.createDataFrame([(1,)], "k long"), spark.createDataFrame([(1,), (2,)], "k long")
    assert [r.k for r in registry.insert_absent(stored, new, ["k"]).collect()] == [2]


def test_tiers_and_range_scan(spark, tmp_path):
    hours = spark.createDataFrame([(1, A, h * 60, h, h, h, 1) for h in range(0, 24 * 100, 5)], HOUR)
    month = F.date_format(F.timestamp_seconds(F.col("hour_min") * 60), "yyyyMM")
    codec.write_tier(hours.withColumn("month", month), str(tmp_path / "t"), "month", "hour_min")
    # A range over more than two months loses none in between.
    assert codec.scan_tier(spark, str(tmp_path / "t"), "month", "hour_min", 60, 24 * 95 * 60, "197001", "197004").count() == hours.where("hour_min >= 60 AND hour_min < 136800").count()


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SAMPLE)
    hours = rollup.hourly_rollup(grid.minute_samples(empty))
    assert hours.count() == 0
    assert rollup.daily_rollup(hours).count() == 0
    assert health.latest_state(empty).count() == 0
    assert codec.minute_blocks(grid.minute_samples(empty)).count() == 0
    assert history.throttled(empty, 5).count() == 0


def test_events_map(spark):
    df = spark.sql("SELECT 7L AS event_id, TIMESTAMP_NTZ'2024-01-01 00:00:01.5' AS ts, 10L AS user_id, 'click' AS event_type, 1.5D AS value, '{\"k\": 3}' AS props")
    assert tuple(to_samples(df).first()) == (7, 10, "2800000000000A63", "click", 1_704_067_201_500, 1.5, 3)
