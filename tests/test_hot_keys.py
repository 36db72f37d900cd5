"""Hot keys in ranges against the whole keys and plain loops: classes, throttling, steadiness, last values, gaps, descriptor spans."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from calorine.operators import calibration, grid, health, history, ranges, registry
from calorine.operators.order import ranked
from calorine.sources.events import samples

D = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def hot_samples(spark, n=3000, keys=3, seed=1):
    """One node and one address with most of the rows, runs of equal numbers and of near values."""
    rng = random.Random(seed)
    out, seq, t = [], 0, 20.0
    for i in range(n):
        seq = rng.choice((seq, seq, seq, seq + 1, max(seq - 3, 0), 0))
        t = rng.choice((t, t + 0.0004, t - 0.0004, t + 0.0012, None if rng.random() < 0.1 else t)) if t is not None else rng.choice((None, 20.0))
        node = 1 if rng.random() < 0.7 else rng.randrange(2, 2 + keys)
        out.append((i, node, f"28{node:014X}" if rng.random() < 0.6 else f"29{node:014X}", rng.randrange(n) * 400, None if t is None else float(np.float32(t)), seq))
    return spark.createDataFrame(out, "event_id long, node_id long, addr string, rx_ms long, temp_c float, seq long")


def spread_over(spark, df, keys, order, hot):
    """How many ranges the rows of the largest key lie in."""
    dealt, several = ranges.in_ranges(df, keys, order, hot)
    assert several
    return dealt.groupBy(*keys).agg(F.count_distinct(ranges.PART).alias("n"), F.count(F.lit(1)).alias("c")).orderBy(F.desc("c")).first()["n"]


def test_a_hot_nodes_rows_are_spread(spark):
    assert spread_over(spark, hot_samples(spark), ["node_id"], ["rx_ms", "event_id"], 100) > 1


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_classes(spark, seed):
    frames = hot_samples(spark, seed=seed).select("node_id", "rx_ms", "event_id", "seq")
    state, want = {}, []
    for r in sorted(frames.collect(), key=lambda r: (r.node_id, r.rx_ms, r.event_id)):
        if r.seq:
            last, run = state.get(r.node_id, (None, 0))
            kind = "first" if last is None else "advance" if r.seq > last else "duplicate" if r.seq == last else "reset"
            run = run + 1 if kind == "duplicate" else 0
            state[r.node_id] = (r.seq, run)
            want.append((r.node_id, r.rx_ms, r.event_id, r.seq, kind, run))
    for hot in (10, 10_000):
        assert rows(health.classify_sequence(frames, hot).select("node_id", "rx_ms", "event_id", "seq", "class", "dup_run")) == sorted(want, key=repr)
    assert rows(health.sequence_stuck(frames, 900_000, 60_000, 10)) == rows(health.sequence_stuck(frames, 900_000, 60_000))


def test_one_number_over_all_ranges(spark):
    frames = spark.range(2000).selectExpr("1L AS node_id", "id AS rx_ms", "id AS event_id", "IF(id < 5, 1L, 7L) AS seq")
    assert max(r.dup_run for r in health.classify_sequence(frames, 10).collect()) == 1994


@pytest.mark.parametrize("interval", [1, 900, 50_000, 10_000_000])
def test_throttling(spark, interval):
    s = hot_samples(spark, 1500)
    want = rows(history.throttled(s, interval))
    assert want and rows(history.throttled(s, interval, hot=10)) == want
    logs, last = [], {}
    for node, ms in sorted({(r.node_id, r.rx_ms) for r in s.collect()}):
        if node not in last or ms >= last[node] + interval:
            last[node] = ms
            logs.append((node, ms))
    assert rows(history.log_chain(s.select("node_id", "rx_ms").distinct(), interval, hot=10)) == sorted(logs, key=repr)
    assert history.throttled(s, 0, hot=10).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_steadiness(spark, seed):
    s = hot_samples(spark, 2000, seed=seed)
    assert rows(calibration.steady(s, hold_ms=2000, hot=10)) == rows(calibration.steady(s, hold_ms=2000))


def test_steadiness_of_drift_and_of_still_values(spark):
    drift = spark.range(1200).selectExpr("'28A' AS addr", "id * 1000 AS rx_ms", "id AS event_id", "CAST(20 + id * 0.0003 AS FLOAT) AS temp_c")
    still = drift.selectExpr("'28B' AS addr", "rx_ms", "event_id + 5000 AS event_id", "CAST(IF(event_id = 3, 21, 20) AS FLOAT) AS temp_c")
    gone = drift.selectExpr("'28C' AS addr", "rx_ms", "event_id + 9000 AS event_id", "CAST(IF(event_id < 3, 21, NULL) AS FLOAT) AS temp_c")
    both = drift.unionByName(still).unionByName(gone)
    got = rows(calibration.steady(both, hot=10))
    assert got == rows(calibration.steady(both))
    assert sum(r[-1] for r in got) > 1000


@pytest.mark.parametrize("backwards", [False, True])
@pytest.mark.parametrize("strict", [False, True])
def test_last_known(spark, backwards, strict):
    rng = random.Random(3)
    data = [(k, i, rng.choice((None, None, i))) for k in (1, 2, None) for i in range(400 if k == 1 else 20)]
    df = spark.createDataFrame(data, "k long, at long, v long")
    want = []
    for k, i, _ in data:
        own = [(a, v) for kk, a, v in data if kk == k and v is not None and ((a > i if strict else a >= i) if backwards else (a < i if strict else a <= i))]
        want.append((k, i, (min if backwards else max)(own)[1] if own else None))
    for hot in (50, 10_000):
        assert rows(ranges.last_known(df, ["k"], ["at"], F.col("v"), hot, backwards, strict).select("k", "at", "known")) == sorted(want, key=repr)


def test_places_in_order(spark):
    df = spark.createDataFrame([(k, i * 7 % 500) for k in (1, None) for i in range(500 if k else 3)], "k long, v long")
    got = {(r.k, r.v): r.place for r in ranked(df, ["k"], ["v"], "place").collect()}
    assert len(got) == 503 and all(got[1, v] == v for v in range(500)) and [got[None, v] for v in (0, 7, 14)] == [0, 1, 2]


def test_gap_runs_expand_to_the_dense_grid(spark):
    s = samples(spark, D)
    slots, minutes = grid.descriptor(s), grid.minute_samples(s)
    start, end = grid.span(s)
    dense = grid.dense_grid(slots, minutes, start, end).where("NOT present").selectExpr("slot", "epoch_minute")
    for hot in (3, 2_000_000):
        runs = grid.gap_runs(slots, minutes, *grid.minute_span(s), hot=hot)
        spread = runs.selectExpr("slot", "explode(sequence(from_minute, to_minute)) AS epoch_minute")
        assert runs.count() < 4 * s.count() and spread.exceptAll(dense).count() == 0 and dense.exceptAll(spread).count() == 0


@pytest.mark.parametrize("cap", [1, 5, 100])
def test_descriptor_spans(spark, cap):
    rng = random.Random(cap)
    first = [(rng.randrange(60), f"28{i:04X}", 60 * rng.randrange(50)) for i in range(250)]
    got = {(r.node_id, r.addr): (r.from_hour_min, r.to_hour_min, r.slot, list(r.moves)) for r in grid.descriptor_spans(spark.createDataFrame(first, "node_id long, addr string, first_hour_min long"), cap).collect()}
    want = {}
    for n, a, h in first:
        slots = {}
        for hour in range(h, 60 * 51, 60):
            smaller = sum(1 for m, b, g in first if (m, b) < (n, a) and g <= hour)
            if smaller < cap:
                slots[hour] = smaller
        if slots:
            moves = [hour for hour in sorted(slots) if hour > h for _ in range(slots[hour] - slots[hour - 60])]
            gone = max(slots) + 60 if max(slots) < 60 * 50 else None
            if gone is not None:  # the last arrivals below the cap come with the one that pushes out
                moves += [gone] * (cap - 1 - slots[gone - 60])
            want[n, a] = (h, gone, slots[h], moves)
    assert got == want


@pytest.mark.parametrize("hot", [5, 1_000_000])
def test_ordered_checksums(spark, hot):
    import zlib

    rng = random.Random(2)
    rows_ = [(k, i, rng.randbytes(rng.randrange(5))) for k in range(3) for i in range((900, 40, 3)[k])]
    df = spark.createDataFrame(rows_, "k int, at long, piece binary").repartition(3)
    want = {k: zlib.crc32(b"\xff\xff\xff\xff" + b"".join(p for kk, _, p in rows_ if kk == k)) for k in range(3)}
    assert {r.k: r.crc for r in registry.ordered_checksum(df, ["k"], "at", "piece", hot).collect()} == want
