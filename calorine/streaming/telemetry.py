"""The telemetry pipeline on streams.  Batch operators do the work wherever a micro-batch can be treated as a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from calorine.functions import scalar as S
from calorine.operators import history
from calorine.operators.ranges import HOT
from calorine.sources.events import to_samples
from calorine.sources.shared import batch_before, scope, written

#: How late a reading may come: the horizon of staleness (T5); the original has no such bound.
LATENESS = "3 minutes"
#: Rooms of nodes of ``backfill_stream``: a stream keeps to the number it began with.
ROOMS = 1024
NONE = -(2**63)


def event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 16) -> DataFrame:
    """The events table as a stream of samples with an event time that accepts a watermark."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", files_per_trigger).parquet(sf_dir)
    return to_samples(rows).withColumn("event_time", F.timestamp_millis("rx_ms"))


def sample_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A folder of samples, a file or several a micro-batch."""
    rows = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return rows.withColumn("event_time", F.timestamp_millis("rx_ms"))


def run_once(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there in micro-batches, resuming from the checkpoint."""
    query = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def run_every(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, seconds: int = 60, mode: str = "append") -> StreamingQuery:
    """Go on for ever, a micro-batch a tick of the clock; the caller stops the query."""
    return stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def hourly_counts(stream: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Hours are closed by the watermark: readings, least and greatest centi-degree of each."""
    centi = S.centi(F.col("temp_c"))
    hours = stream.withWatermark("event_time", lateness).groupBy(F.window("event_time", "1 hour"), "node_id", "addr")
    out = hours.agg(F.count(centi).alias("readings"), F.min(centi).alias("min_centi"), F.max(centi).alias("max_centi"))
    return out.select("node_id", "addr", F.floor(F.unix_seconds("window.start") / 60).cast("long").alias("hour_min"), "readings", "min_centi", "max_centi")


def minute_exact_hours(stream: DataFrame, lateness_ms: int = S.STALE_MS, stale_ms: int = S.STALE_MS) -> DataFrame:
    """The hours of ``a1`` on a stream: (node_id, addr, hour_min, mean_centi, min_centi, max_centi, sample_count).

    Two chained aggregations with one watermark.  The first keeps the latest reading of each (sensor, minute) that it can serve, so a value
    is carried from minute to minute until the horizon passes, whether or not anything else arrives; a minute that the watermark passes
    goes on to the second, which sums hours and gives each out once, when it is closed.  Minutes lie up to ``stale_ms`` ahead of
    their readings, so the watermark waits for that and ``lateness_ms``: readings late by no more are all counted.
    """
    first, last = F.ceil(F.col("rx_ms") / 60000).cast("long"), F.floor((F.col("rx_ms") + stale_ms) / 60000).cast("long")
    spread = stream.where(last >= first).select("node_id", "addr", "rx_ms", "event_id", "temp_c", F.explode(F.sequence(first, last)).alias("epoch_minute"))
    timed = spread.withColumn("minute_time", F.timestamp_seconds(F.col("epoch_minute") * 60)).withWatermark("minute_time", f"{lateness_ms + stale_ms} milliseconds")
    minutes = timed.groupBy(F.window("minute_time", "1 minute"), "node_id", "addr").agg(F.max(F.struct("rx_ms", "event_id", "temp_c")).alias("s"))
    t = F.col("s.temp_c")
    minutes = minutes.select("window", "node_id", "addr", F.when(t.isNotNull() & ~F.isnan(t), S.centi(t)).alias("centi"))
    hours = minutes.groupBy(F.window("window", "1 hour"), "node_id", "addr").agg(F.sum("centi").alias("total"), F.min("centi").alias("min_centi"), F.max("centi").alias("max_centi"), F.count("centi").alias("n"))
    start = F.floor(F.unix_seconds("window.start") / 60).cast("long")
    return hours.select("node_id", "addr", start.alias("hour_min"), F.round(F.col("total").cast("double") / F.col("n")).cast("int").alias("mean_centi"), "min_centi", "max_centi", F.col("n").cast("int").alias("sample_count"))


def latest_values(stream: DataFrame) -> DataFrame:
    """The last value of each sensor, as an updating table.

    The state is one struct a sensor, kept by a grouped maximum.
    """
    best = stream.groupBy("node_id", "addr").agg(F.max(F.struct("rx_ms", "event_id", "temp_c")).alias("s"))
    return best.select("node_id", "addr", F.col("s.rx_ms").alias("last_ms"), F.col("s.temp_c").alias("temp_c"))


class ThrottleSink:
    """W2 on a stream: a micro-batch sink, for ``foreachBatch``, that keeps what each batch logs in a folder named for it.

    A node's state is when it last logged and the last row of each of its sensors.  Those rows go before the batch's own, with one of a sensor without
    a name at the time of the last log, and the batch operator does the rest; it spreads hot nodes.  A batch that is tried again starts from the
    state before it and overwrites its folders.
    """

    MARK = ""
    ROW = "node_id bigint, rx_ms bigint, event_id bigint, addr string, temp_c float"

    def __init__(self, path: str, interval_ms: int, hot: int = HOT):
        self.path, self.interval_ms, self.hot = path, interval_ms, hot

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        with scope(batch.sparkSession):
            self._step(batch, batch_id)

    def _step(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        names = ["node_id", "rx_ms", "event_id", "addr", "temp_c"]
        last = batch_before(spark, f"{self.path}/state", batch_id)
        state = spark.createDataFrame([], self.ROW) if last is None else spark.read.schema(self.ROW).parquet(f"{self.path}/state/batch={last}")
        rows = written(batch.select("node_id", "rx_ms", "event_id", "addr", F.col("temp_c").cast("float").alias("temp_c")), "batch")
        known = state.where(F.col("addr") == self.MARK).select("node_id", F.col("rx_ms").alias("logged_ms"))
        fresh = rows.groupBy("node_id").agg(F.min("rx_ms").alias("rx_ms")).join(known, "node_id", "left_anti")
        marks = fresh.select("node_id", "rx_ms", F.lit(-1).cast("long").alias("event_id"), F.lit(self.MARK).alias("addr"), F.lit(0.0).cast("float").alias("temp_c"))
        # What was last known before a node's last log is known at it: its chain goes on from there.
        moved = state.join(known, "node_id", "left").withColumn("rx_ms", F.greatest("rx_ms", "logged_ms")).select(names)
        seen = rows.unionByName(moved).unionByName(marks)
        logs = written(history.throttled(seen, self.interval_ms, self.hot).join(known, "node_id", "left").where("logged_ms IS NULL OR log_ms > logged_ms").drop("logged_ms"), "logs")
        logs.where(F.col("addr") != self.MARK).write.mode("overwrite").parquet(f"{self.path}/out/batch={batch_id}")
        marked = logs.where(F.col("addr") == self.MARK).select("node_id", F.col("log_ms").alias("rx_ms"), F.lit(-1).cast("long").alias("event_id"), "addr", "temp_c")
        both = rows.unionByName(state).unionByName(marked)
        latest = both.groupBy("node_id", "addr").agg(F.max(F.struct("rx_ms", "event_id", "temp_c")).alias("s"))
        latest.select("node_id", "addr", "s.*").select(names).write.mode("overwrite").parquet(f"{self.path}/state/batch={batch_id}")


def silence(stream: DataFrame, horizon_ms: int, lateness: str = LATENESS) -> DataFrame:
    """(node_id, change, at_ms): ``stale`` when nothing has come from a node for the horizon, ``back`` when it is heard again.

    A node's state is when it was last heard and whether it is stale; an event-time timer tells of its silence though nothing arrives.
    Rows later than ``lateness`` change nothing.  Within a micro-batch a node's times alone are held.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, stale = state.get if state.exists else (None, False)
        out: list[tuple[str, int]] = []
        if state.hasTimedOut:
            out, stale = [("stale", last + horizon_ms)], True
            state.update((last, stale))
        else:
            times = np.unique(np.concatenate([b["rx_ms"].to_numpy(np.int64) for b in batches]))
            if last is not None:
                times = times[times > last]
            for ms in times.tolist() if last is None or stale else []:
                if stale:
                    out.append(("back", ms))
                break
            steps = np.concatenate([[last], times]) if last is not None and not stale else times
            gaps = np.flatnonzero(np.diff(steps) > horizon_ms)
            for a, b in zip(steps[gaps].tolist(), steps[gaps + 1].tolist()):
                out += [("stale", int(a) + horizon_ms), ("back", int(b))]
            if len(times):
                last, stale = int(times[-1]), False
            if not stale and last + horizon_ms < state.getCurrentWatermarkMs():
                out.append(("stale", last + horizon_ms))
                stale = True
            state.update((last, stale))
            if not stale:
                state.setTimeoutTimestamp(max(last + horizon_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], *o) for o in out], columns=["node_id", "change", "at_ms"])

    timed = stream.withWatermark("event_time", lateness).select("node_id", "rx_ms", "event_time")
    return timed.groupBy("node_id").applyInPandasWithState(step, "node_id bigint, change string, at_ms bigint", "last bigint, stale boolean", "append", GroupStateTimeout.EventTimeTimeout)


def backfill_stream(stream: DataFrame, expiry_ms: int, lateness: str = LATENESS, rooms: int = ROOMS) -> DataFrame:
    """``backfill_epochs`` on a stream: (event_id, node_id, addr, ms, epoch, backfilled).

    stream: (event_id, node_id, addr, ms, epoch, anchor_epoch, event_time); a row with ``anchor_epoch`` is its node's anchor, at its ``ms``, and
    otherwise no sample.  Rows that have an epoch, or come after the anchor, go on at once.  Others wait in their node's state until the anchor
    comes, or for ``expiry_ms`` of event time after the node's last row of a micro-batch, and then go on without an epoch.  The first anchor of
    a node counts.

    Nodes are dealt by hash into ``rooms``, whose rows Python takes together: a call a room and micro-batch, not a call a node.  A room's
    state holds the anchors of its nodes and what waits, each node with a time of its own.  Within, ``NONE`` stands for null, so that numbers
    stay whole.
    """
    longs = ("event_id", "node_id", "ms", "epoch")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        nodes, starts, epochs, waiting, untils, ids, owners, addrs, times = state.get if state.exists else ([], [], [], [], [], [], [], [], [])
        anchors = pd.DataFrame({"anchor_ms": np.array(starts, np.int64), "anchor_epoch": np.array(epochs, np.int64)}, index=np.array(nodes, np.int64))
        held = pd.DataFrame({"event_id": np.array(ids, np.int64), "node_id": np.array(owners, np.int64), "addr": np.array(addrs, object), "ms": np.array(times, np.int64), "epoch": np.full(len(ids), NONE)})
        until, latest, mark = dict(zip(waiting, untils)), {}, state.getCurrentWatermarkMs()

        def finished(rows: pd.DataFrame) -> pd.DataFrame:
            known = anchors.reindex(rows["node_id"], fill_value=NONE)
            return rows.assign(anchor_ms=known["anchor_ms"].to_numpy(), anchor_epoch=known["anchor_epoch"].to_numpy())

        gone = held["node_id"].isin([n for n, ms in until.items() if ms < mark])
        if gone.any():
            yield finished(held[gone])
            held = held[~gone]
        for rows in [] if state.hasTimedOut else batches:
            if not len(rows):
                continue
            for node, ms in rows["at"].groupby(rows["node_id"]).max().items():
                latest[node] = max(latest.get(node, mark), ms)
            own = rows["anchor_epoch"] != NONE
            first = rows[own & ~rows["node_id"].isin(anchors.index)].sort_values("event_id").drop_duplicates("node_id")
            if len(first):
                anchors = pd.concat([anchors, first.set_index("node_id").rename(columns={"ms": "anchor_ms"})[["anchor_ms", "anchor_epoch"]]])
                ready = held["node_id"].isin(first["node_id"])
                if ready.any():
                    yield finished(held[ready])
                    held = held[~ready]
            rows = rows.loc[~own, list(held.columns)]
            waits = (rows["epoch"] == NONE) & ~rows["node_id"].isin(anchors.index)
            if waits.any():
                held = pd.concat([held, rows[waits]])
            if not waits.all():
                yield finished(rows[~waits])
        until = {n: latest[n] + expiry_ms if n in latest else until[n] for n in held["node_id"].unique().tolist()}
        waits = [held[c].tolist() for c in ("event_id", "node_id", "addr", "ms")]
        state.update((anchors.index.tolist(), anchors["anchor_ms"].tolist(), anchors["anchor_epoch"].tolist(), list(until), [int(ms) for ms in until.values()], *waits))
        if until:
            state.setTimeoutTimestamp(int(min(until.values())))

    shape = "event_id bigint, node_id bigint, addr string, ms bigint, epoch bigint, anchor_ms bigint, anchor_epoch bigint"
    kept = "nodes array<bigint>, starts array<bigint>, epochs array<bigint>, waiting array<bigint>, untils array<bigint>, ids array<bigint>, owners array<bigint>, addrs array<string>, times array<bigint>"
    whole = {c: F.coalesce(F.col(c), F.lit(NONE)) for c in (*longs, "anchor_epoch")} | {"at": F.coalesce(F.unix_millis("event_time"), F.lit(NONE)), "room": F.pmod(F.xxhash64("node_id"), F.lit(rooms))}
    given = stream.withWatermark("event_time", lateness).withColumns(whole).select(*longs, "addr", "anchor_epoch", "at", "event_time", "room")
    rows = given.groupBy("room").applyInPandasWithState(step, shape, kept, "append", GroupStateTimeout.EventTimeTimeout)
    return history.stamped(rows.withColumns({c: F.nullif(F.col(c), F.lit(NONE)) for c in (*longs, "anchor_ms", "anchor_epoch")}))


def write_absent(path: str, keys: list[str], time_ms: str = "rx_ms") -> Callable[[DataFrame, int], None]:
    """A micro-batch sink that a replay leaves as it is: rows whose key is stored are left out.

    Rows lie in folders by the day of ``time_ms``, which is one of a key's facts: a batch is held against the stored rows
    of its own days and times alone, not against the whole sink.
    """
    day = F.date_format(F.timestamp_millis(time_ms), "yyyyMMdd")

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        exists = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
        fresh = batch.dropDuplicates(keys).withColumn("day", day)
        fresh.persist()  # read twice, computed once
        try:
            if exists:
                low, high, first, last = fresh.agg(F.min(time_ms), F.max(time_ms), F.min("day"), F.max("day")).first()
                if low is None:
                    return
                stored = spark.read.schema(fresh.schema).parquet(path).where(F.col("day").between(first, last) & F.col(time_ms).between(low, high))
                fresh.join(stored.select(*keys), keys, "left_anti").write.partitionBy("day").mode("append").parquet(path)
            else:
                fresh.write.partitionBy("day").mode("append").parquet(path)
        finally:
            fresh.unpersist()

    return sink
