"""Streams against their batch forms on the smallest tables."""

import pytest

from calorine.operators import health, history
from calorine.plans.queries import QUERIES, query
from calorine.sources.events import samples
from calorine.streaming import telemetry

D = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_latest(spark):
    batch = health.latest_state(samples(spark, D)).select("node_id", "addr", "last_ms", "temp_c")
    assert rows(QUERIES["t1_stream_latest"](spark, D)) == rows(batch)


def test_throttled(spark):
    assert rows(QUERIES["w2_stream_throttled"](spark, D)) == rows(history.throttled(samples(spark, D), 6 * 3_600_000))


def test_replay_adds_nothing(spark):
    assert QUERIES["t8_idempotent_sink"](spark, D).count() == samples(spark, D).count()


def test_resumes_where_it_stopped(spark, tmp_path):
    seen = []
    for _ in range(2):
        telemetry.run_once(telemetry.event_stream(spark, D), lambda batch, i: seen.append(batch.count()), str(tmp_path / "state"))
    assert sum(seen) == samples(spark, D).count()  # the second run finds nothing new


def test_ticks(spark, tmp_path):
    seen = []
    running = telemetry.run_every(telemetry.event_stream(spark, D), lambda batch, i: seen.append(batch.count()), str(tmp_path / "state"), seconds=1)
    running.processAllAvailable()
    running.stop()
    assert sum(seen) == samples(spark, D).count()


def test_names_are_taken_once():
    with pytest.raises(ValueError):
        query("a1_hourly_rollup")(None)
