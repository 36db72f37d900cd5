"""Streams under late and repeated data, stored queues that fail, torn journals: against batch forms and plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from calorine.operators import grid, history, rollup
from calorine.plans.queries import QUERIES
from calorine.sources import journal
from calorine.sources.events import samples
from calorine.streaming import delivery, telemetry, upserts

D = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def in_files(spark, df, path, n, order):
    """``n`` files, of which a stream takes one a batch, in order of their names."""
    for i in range(n):
        df.where(order(n) == i).coalesce(1).write.mode("append").parquet(path)


def by_time(n):
    return F.floor((F.col("rx_ms") - 1_704_067_200_000) * n / (31 * 86_400_000)).cast("int")


def scattered(n):
    return F.pmod(F.xxhash64("event_id"), F.lit(n)).cast("int")


def test_minute_exact_hours_over_batches(spark, tmp_path):
    s, path = samples(spark, D), str(tmp_path / "in")
    in_files(spark, s, path, 4, by_time)
    out = []
    telemetry.run_once(telemetry.minute_exact_hours(telemetry.sample_stream(spark, path)), lambda b, i: out.extend(map(tuple, b.collect())), str(tmp_path / "state"))
    closed = (s.agg(F.max("rx_ms")).first()[0] + 180_000) // 60_000 - 6
    want = rollup.hourly_rollup(grid.minute_samples(s)).where(f"hour_min + 60 <= {closed}")
    assert sorted(out, key=repr) == rows(want) and len(out) > 900


@pytest.mark.parametrize("zone", ["UTC", "Asia/Kolkata"])
def test_days_of_scattered_files(spark, tmp_path, zone):
    s, path = samples(spark, D), str(tmp_path / "in")
    in_files(spark, s, path, 3, scattered)
    want = rows(rollup.daily_rollup(rollup.hourly_rollup(grid.minute_samples(s)), zone).select("node_id", "addr", "day", "mean_centi", "min_centi", "max_centi", "sample_count"))
    out = str(tmp_path / "out")
    read = lambda: rows(upserts.read_days(spark, out).select("node_id", "addr", "day", "mean_centi", "min_centi", "max_centi", "sample_count"))
    telemetry.run_once(telemetry.sample_stream(spark, path), upserts.upsert_days(out, zone), str(tmp_path / "state"))
    assert read() == want
    telemetry.run_once(telemetry.sample_stream(spark, path), upserts.upsert_days(out, zone), str(tmp_path / "again"))  # from the start
    assert read() == want
    upserts.upsert_days(out, zone)(s.where("event_id % 3 = 0"), 1)  # a batch tried again with fewer rows of its own ...
    upserts.upsert_days(out, zone)(s, 7)  # ... and rows that come twice
    upserts.upsert_days(out, zone)(s.limit(0), 8)
    assert read() == want
    upserts.compact(spark, out, 8, zone)
    assert len({r.batch for r in spark.read.parquet(f"{out}/minutes").select("batch").distinct().collect()}) == 1
    assert rows(upserts.read_minutes(spark, out)) == rows(grid.minute_samples(s))


def plain_queues(requests, now, send, size=20):
    """One queue after another, a millisecond event at a time."""
    log = []
    for key in sorted({r[0] for r in requests}):
        waiting, last = [], None
        own = sorted((r for r in requests if r[0] == key and r[5]), key=lambda r: (r[2], r[1]))

        def attempts(until):
            nonlocal last
            while waiting:
                t = max(min(w[0] for w in waiting), -1 if last is None else last + 2000)
                if t > until:
                    return
                due = min((w for w in waiting if w[0] <= t), key=lambda w: (w[3], w[0], w[4], w[2]))
                waiting.remove(due)
                last, n = t, due[5] + 1
                ok = send("t", due[6], n)
                log.append((key, due[2], "sent", n, t, ok))
                if not ok:
                    waiting.append((t + due[1], min(2 * due[1], 600_000), *due[2:5], n, due[6]))

        for _, seq, arrival, summary, _, message in own:
            attempts(arrival - 1)
            if len(waiting) >= size:
                log.append((key, seq, "dropped", None, None, None))
            else:
                waiting.append((arrival, 15_000, seq, summary, arrival, 0, message))
        attempts(now)
    return sorted(log, key=repr)


def test_queue_under_a_sink_that_fails(spark, tmp_path):
    rng = random.Random(4)
    requests = [(q, i * 4 + q, rng.randrange(200) * 1000 + 500_000 * (i > 150), rng.random() < 0.5, "t", rng.choice(("", "a", "b", "bad", "worse"))) for q in range(3) for i in range(300)]
    requests.sort(key=lambda r: r[2])
    shape = "queue long, seq long, arrival long, is_summary boolean, title string, message string"
    send = lambda title, message, attempt: message in "ab" or message == "bad" and attempt > 2
    end = max(r[2] for r in requests)
    want = plain_queues(requests, end + 10_000_000, send)
    assert {e[2] for e in want} == {"sent", "dropped"}
    sink = delivery.DeliverySink(str(tmp_path / "queue"), send)
    cuts = [0, 100, 101, 400, 900]
    batches = [requests[a:b] for a, b in zip(cuts, cuts[1:])]
    batches = [[r for r in requests if lo <= r[2] < hi] for lo, hi in ((0, 50_000), (50_000, 120_000), (120_000, 1 << 40))]
    for i, own in enumerate(batches):
        for _ in range(2):  # each batch is tried twice
            sink(spark.createDataFrame(own, shape), i)
    sink.drain(spark, 3, end + 10_000_000)
    got = sink.events(spark)
    assert rows(got.where("kind IN ('sent', 'dropped')").select("queue", "seq", "kind", "attempt", "at_ms", "ok")) == want
    assert got.where("kind = 'waiting'").groupBy("batch", "queue").count().agg(F.max("count")).first()[0] <= 20
    done = {(e[0], e[1]) for e in want if e[2] == "sent" and e[5]}
    assert {(r.queue, r.seq) for r in got.where("kind = 'waiting' AND batch = 3").collect()} == {(e[0], e[1]) for e in want if e[2] == "sent"} - done
    sink.forget(spark, 3)
    assert {r.batch for r in sink.events(spark).select("batch").distinct().collect()} == {3}


def test_a_batch_that_crashed_sends_again(spark, tmp_path):
    sent = spark.sparkContext.accumulator(0)

    def send(title, message, attempt):
        sent.add(1)
        return True

    shape = "queue long, seq long, arrival long, is_summary boolean, title string, message string"
    sink = delivery.DeliverySink(str(tmp_path / "queue"), send)
    batch = spark.createDataFrame([(1, 1, 10, False, None, "m"), (1, 2, 11, False, None, None), (None, 3, 12, False, None, "m")], shape)
    sink(batch, 0)
    sink(batch, 0)
    sink(batch.limit(0), 1)
    assert sent.value == 2 and [(r.seq, r.ok) for r in sink.events(spark).where("kind = 'sent'").collect()] == [(1, True)]


def test_journal_is_recovered_to_its_sound_prefix(spark, tmp_path):
    s, path = samples(spark, D), str(tmp_path / "journal")
    placed = journal.slots(grid.minute_samples(s)).persist()
    made = journal.frames(placed)
    assert made.groupBy("hour_min", "block").agg((F.max("minute") + 1 == F.count(F.lit(1))).alias("whole")).where("NOT whole").count() == 0
    hit = F.pmod(F.xxhash64("hour_min"), F.lit(30)).cast("int")
    torn = made.withColumn("cells", F.when((F.col("minute") == hit) & (F.size("cells") > 0), F.slice("cells", 2, 100)).otherwise(F.col("cells"))).where(~((F.col("minute") == hit) & (F.size("cells") == 0)))
    journal.append(torn, path)
    layouts = journal.layouts(placed)
    kept = journal.recovered(spark, path, layouts)
    assert kept.where(F.col("minute") >= hit).count() == 0 and kept.count() == made.where(F.col("minute") < hit).count() > 0
    present = grid.minute_samples(s).where("present").select("node_id", "addr", "epoch_minute", "centi")
    want = present.where(F.pmod("epoch_minute", F.lit(60)) < F.pmod(F.xxhash64(F.col("epoch_minute") - F.pmod("epoch_minute", F.lit(60))), F.lit(30)))
    assert rows(journal.readings(kept, placed)) == rows(want)
    other = layouts.withColumn("layout", F.when(F.col("hour_min") % 120 == 0, F.col("layout") + 1).otherwise(F.col("layout")))
    assert journal.recovered(spark, path, other).where("hour_min % 120 = 0").count() == 0
    # It goes on after the sound frames, and then holds everything.
    journal.append(journal.resumed(journal.frames(placed, 2), kept), path)
    assert rows(journal.readings(journal.recovered(spark, path, layouts), placed)) == rows(present)


def plain_silence(times, horizon, now):
    out = []
    for node, own in times.items():
        own = sorted(own)
        for a, b in zip(own, own[1:]):
            if b - a > horizon:
                out += [(node, "stale", a + horizon), (node, "back", b)]
        if own[-1] + horizon < now:
            out.append((node, "stale", own[-1] + horizon))
    return sorted(out, key=repr)


@pytest.mark.parametrize("files", [1, 5])
def test_silence_is_told_and_its_end(spark, tmp_path, files):
    s, path, horizon = samples(spark, D), str(tmp_path / "in"), 4 * 3_600_000
    in_files(spark, s, path, files, by_time)
    times = {}
    for r in s.select("node_id", "rx_ms").collect():
        times.setdefault(r.node_id, set()).add(r.rx_ms)
    out = []
    telemetry.run_once(telemetry.silence(telemetry.sample_stream(spark, path), horizon), lambda b, i: out.extend(map(tuple, b.collect())), str(tmp_path / "state"))
    assert sorted(out, key=repr) == plain_silence(times, horizon, max(max(t) for t in times.values()) - 180_000) and len(out) > 100


def test_backfill_waits_for_the_anchor_and_expires(spark, tmp_path):
    path, start = str(tmp_path / "in"), 1_000_000
    shape = "event_id long, node_id long, addr string, rx_ms long, ms long, epoch long, anchor_epoch long"
    own = lambda i, node, at, epoch=None, anchor=None: (i, node, "a", start + at, start + at, epoch, anchor)
    files = [
        [own(1, 1, 0), own(2, 1, 1000, 77), own(3, 2, 500), own(4, 3, 600)],
        [own(5, 1, 30_000), own(100, 1, 20_000, None, 5000), own(6, 2, 31_000)],
        [own(7, 1, 60_000), own(101, 3, 60_000, None, 9000), own(102, 3, 61_000, None, 1)],
        [own(8, 9, 10_000_000, 1)],
        [own(9, 2, 10_001_000), own(103, 2, 10_002_000, None, 50_000), own(10, 9, 99_000_000, 2)],
    ]
    for f in files:
        spark.createDataFrame(f, shape).coalesce(1).write.mode("append").parquet(path)
    out = {}
    telemetry.run_once(telemetry.backfill_stream(telemetry.sample_stream(spark, path), 3_600_000), lambda b, i: out.update({r.event_id: (r.epoch, r.backfilled) for r in b.collect()}), str(tmp_path / "state"))
    # Of node 2, samples 3 and 6 expire before its anchor comes; 9 waits for it.
    assert out == {1: (4980, True), 2: (77, False), 5: (5010, True), 7: (5040, True), 4: (8941, True), 3: (None, False), 6: (None, False), 8: (1, False), 9: (49_999, True), 10: (2, False)}


@pytest.mark.parametrize("hot", [20, 2_000_000])
def test_throttling_over_batches(spark, tmp_path, hot):
    s, path = samples(spark, D), str(tmp_path / "in")
    in_files(spark, s, path, 3, by_time)
    sink = telemetry.ThrottleSink(str(tmp_path / "out"), 6 * 3_600_000, hot)
    telemetry.run_once(telemetry.sample_stream(spark, path), sink, str(tmp_path / "state"))
    want = rows(history.throttled(s, 6 * 3_600_000))
    read = lambda: rows(spark.read.parquet(str(tmp_path / "out" / "out")).drop("batch"))
    assert read() == want
    sink(s.where(by_time(3) == 1), 1)  # tried again
    assert read() == want


def test_backfill_takes_nodes_together(spark, tmp_path):
    """Nodes of one room wait, get their anchors and expire each by itself."""
    path, start = str(tmp_path / "in"), 1_000_000
    shape = "event_id long, node_id long, addr string, rx_ms long, ms long, epoch long, anchor_epoch long"
    own = lambda i, node, at, epoch=None, anchor=None: (i, node, "a", start + at, start + at, epoch, anchor)
    nodes = range(40)
    files = [
        [own(n, n, 500 + n) for n in nodes],
        [own(100 + n, n, 5_000_000) for n in nodes if n % 4 == 1] + [own(200 + n, n, 20_000, None, 5000 + n) for n in nodes if n % 4 == 0],
        [own(300 + n, n, 5_100_000, None, 9000) for n in nodes if n % 4 == 1] + [own(400 + n, n, 5_100_000, 7) for n in nodes if n % 4 == 2],
        [own(500 + n, n, 99_000_000) for n in nodes if n % 4 == 0],
    ]
    for f in files:
        spark.createDataFrame(f, shape).coalesce(1).write.mode("append").parquet(path)
    made = telemetry.backfill_stream(telemetry.sample_stream(spark, path), 3_600_000, rooms=1)
    out = []
    telemetry.run_once(made, lambda b, i: out.extend((r.event_id, r.node_id, r.epoch, r.backfilled) for r in b.collect()), str(tmp_path / "state"))
    want = [(n, n, 5000 + n - 19, True) for n in nodes if n % 4 == 0]
    want += [(500 + n, n, 5000 + n + 98_980, True) for n in nodes if n % 4 == 0]
    want += [(n, n, 9000 - 5099, True) for n in nodes if n % 4 == 1] + [(100 + n, n, 8900, True) for n in nodes if n % 4 == 1]
    want += [(n, n, None, False) for n in nodes if n % 4 in (2, 3)] + [(400 + n, n, 7, False) for n in nodes if n % 4 == 2]
    assert sorted(out, key=str) == sorted(want, key=str)


def test_backfill_of_many_files_loses_no_row(spark, tmp_path):
    spark.read.parquet(f"{D}/events.parquet").repartition(50).write.parquet(str(tmp_path / "events.parquet"))
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")  # a task and so a file of the stream for each
    try:
        got = rows(QUERIES["w12_stream_backfill"](spark, str(tmp_path)).select("event_id", "node_id", "addr", "ms", "epoch", "backfilled"))
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == rows(QUERIES["w12_backfill_epochs"](spark, D).select("event_id", "node_id", "addr", "ms", "epoch", "backfilled"))
