"""Bounded history: retention, throttled sampling, read-out, epochs assigned later."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calorine.functions import scalar as S
from calorine.operators.ranges import HOT, last_known, split
from calorine.sources.shared import written


def retain(samples: DataFrame, capacity: int) -> DataFrame:
    """The last ``capacity`` samples of each sensor, with ``age_rank`` from the newest.

    Diagnostic rows are not limited with the live ones if they carry another ``addr``.
    """
    newest = Window.partitionBy("node_id", "addr").orderBy(F.desc("rx_ms"), F.desc("event_id"))
    return samples.withColumn("age_rank", F.row_number().over(newest)).where(F.col("age_rank") <= capacity)


def view(samples: DataFrame, addr: str, most: int) -> DataFrame:
    """The newest ``most`` samples of an address (exact case), oldest first."""
    newest = samples.where(F.col("addr") == addr).orderBy(F.desc("rx_ms"), F.desc("event_id")).limit(most)
    return newest.orderBy("rx_ms", "event_id")


def log_times(times: np.ndarray, logged: int | None, interval_ms: int) -> list[int]:
    """Of sorted frame times those that log: each the first that is ``interval_ms`` after the last that did."""
    out: list[int] = []
    at = 0 if logged is None else int(np.searchsorted(times, logged + interval_ms))
    while at < len(times):
        out.append(int(times[at]))
        at = int(np.searchsorted(times, out[-1] + interval_ms))
    return out


def log_node(ms: np.ndarray, addrs: np.ndarray, temps: np.ndarray, logged: int | None, values: dict[str, float], interval_ms: int) -> tuple[list[tuple[int, str, float]], int | None]:
    """(log_ms, addr, temp_c) of one node's next rows in time order, and when it last logged.

    logged, values: when it had last logged, and the last values (NaN for none) of its sensors, which are brought up to date.
    """
    logs = np.array(log_times(np.unique(ms), logged, interval_ms), np.int64)
    out: list[tuple[int, str, float]] = []
    own = {a: np.flatnonzero(addrs == a) for a in dict.fromkeys(addrs.tolist())} if len(logs) else {}
    for addr in dict.fromkeys([*values, *own]):
        rows = own.get(addr, np.zeros(0, np.int64))
        place = np.searchsorted(ms[rows], logs, side="right")
        shown = np.concatenate([[values.get(addr, np.nan)], temps[rows]])[place]
        out += [(t, addr, float(v)) for t, v in zip(logs.tolist(), shown) if v == v]
    values.update(zip(addrs.tolist(), temps.tolist()))  # of a sensor's rows the last stays
    return out, int(logs[-1]) if len(logs) else logged


def _logged_whole(samples: DataFrame, interval_ms: int) -> DataFrame:
    """W2 of nodes that each fit a task: a node's rows stream through in order, a batch at a time."""
    schema = "node_id bigint, log_ms bigint, addr string, temp_c float"

    def walk(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, logged, values, held = None, None, {}, None

        def taken(rows: pd.DataFrame) -> pd.DataFrame:
            nonlocal node, logged, values
            out: list[tuple] = []
            for n, own in rows.groupby("node_id", sort=False):
                if n != node:
                    node, logged, values = n, None, {}
                made, logged = log_node(own["rx_ms"].to_numpy(), own["addr"].to_numpy(), own["temp_c"].to_numpy(np.float32), logged, values, interval_ms)
                out += [(n, *m) for m in made]
            return pd.DataFrame(out, columns=["node_id", "log_ms", "addr", "temp_c"])

        for rows in stream:
            rows = rows if held is None else pd.concat([held, rows])
            if not len(rows):
                continue
            # The last frame may go on in the next batch.
            last = (rows["node_id"] == rows["node_id"].iloc[-1]) & (rows["rx_ms"] == rows["rx_ms"].iloc[-1])
            held = rows[last]
            yield taken(rows[~last])
        if held is not None:
            yield taken(held)

    ordered = samples.repartition("node_id").sortWithinPartitions("node_id", "rx_ms", "event_id")
    return ordered.mapInPandas(walk, schema)


def log_chain(frames: DataFrame, interval_ms: int, hot: int = HOT) -> DataFrame:
    """(node_id, log_ms) of distinct frames (node_id, rx_ms), by jump pointers.

    Every frame points to the first one ``interval_ms`` after it.  Pointers are doubled turn by turn, and each turn the frames known to log
    reach as many again: after k turns a node's first 2**k are known.  Turns grow with the logarithm of the longest chain, and no
    key's rows meet in one task.
    """
    marks = frames.select("node_id", F.col("rx_ms").alias("at"), F.lit(1).alias("kind")).unionByName(frames.select("node_id", (F.col("rx_ms") + interval_ms).alias("at"), F.lit(0).alias("kind")))
    ahead = last_known(marks, ["node_id"], ["at", "kind"], F.when(F.col("kind") == 1, F.col("at")), hot, backwards=True)
    jumps = written(ahead.where("kind = 0 AND known IS NOT NULL").select("node_id", (F.col("at") - interval_ms).alias("at"), F.col("known").alias("to")), "jumps")
    logs = written(frames.groupBy("node_id").agg(F.min("rx_ms").alias("at")), "logs")
    while not jumps.isEmpty():
        more = logs.join(jumps, ["node_id", "at"]).select("node_id", F.col("to").alias("at"))
        logs = written(logs.unionByName(more), "logs")
        again = jumps.select("node_id", F.col("at").alias("to"), F.col("to").alias("next"))
        jumps = written(jumps.join(again, ["node_id", "to"]).select("node_id", "at", F.col("next").alias("to")), "jumps")
    return logs.select("node_id", F.col("at").alias("log_ms"))


def _logged_spread(samples: DataFrame, interval_ms: int, hot: int) -> DataFrame:
    """W2 of nodes with more rows than one task should have: chains by jump pointers, values carried over ranges."""
    logs = written(log_chain(samples.select("node_id", "rx_ms").distinct(), interval_ms, hot), "logs")
    sensors = samples.groupBy("node_id", "addr").agg(F.min("rx_ms").alias("first_ms"))
    asked = logs.join(sensors, "node_id").where("first_ms <= log_ms")
    asked = asked.select("node_id", "addr", F.col("log_ms").alias("rx_ms"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("float").alias("temp_c"))
    rows = samples.select("node_id", "addr", "rx_ms", F.lit(0).alias("kind"), "event_id", "temp_c").unionByName(asked)
    shown = last_known(rows, ["node_id", "addr"], ["rx_ms", "kind", "event_id"], F.when(F.col("kind") == 0, F.struct("temp_c")), hot).where("kind = 1")
    return shown.select("node_id", F.col("rx_ms").alias("log_ms"), "addr", F.col("known.temp_c").alias("temp_c")).where("temp_c IS NOT NULL AND NOT isnan(temp_c)")


def throttled(samples: DataFrame, interval_ms: int, hot: int = HOT) -> DataFrame:
    """(node_id, log_ms, addr, temp_c): what each node logs.

    A frame logs when ``interval_ms`` have passed since the node last *logged*; it then logs the last known value of
    every sensor of the node that has one.  Interval 0 logs nothing.  Nodes of at most ``hot`` rows stream through tasks in order: the
    next frame that logs and a sensor's value at it are found by binary search, and a node's state is one number and a value a sensor.
    The rows of others are spread: jump pointers find what logs, and values are carried over ranges.
    """
    rows = samples.select("node_id", "rx_ms", "event_id", "addr", F.col("temp_c").cast("float").alias("temp_c"))
    if interval_ms == 0:
        return rows.where(F.lit(False)).select("node_id", F.col("rx_ms").alias("log_ms"), "addr", "temp_c")
    cold, big = split(rows, ["node_id"], hot)
    whole = _logged_whole(cold, interval_ms)
    return whole if big is None else whole.unionByName(_logged_spread(written(big, "hot-rows"), interval_ms, hot))


def stamped(rows: DataFrame) -> DataFrame:
    """Rows (ms, epoch, anchor_ms, anchor_epoch) with ``epoch`` filled in from the anchor, and ``backfilled``."""
    epoch = F.when(F.col("anchor_ms").isNotNull(), S.millis_to_epoch(F.col("ms"), F.col("anchor_ms"), F.col("anchor_epoch")))
    filled = F.coalesce(F.col("epoch"), epoch)
    return rows.withColumn("backfilled", F.col("epoch").isNull() & epoch.isNotNull()).withColumn("epoch", filled).drop("anchor_ms", "anchor_epoch")


def backfill_epochs(samples: DataFrame, anchors: DataFrame) -> DataFrame:
    """Samples without an epoch get one from their node's anchor (node_id, anchor_ms, anchor_epoch)."""
    return stamped(samples.join(anchors, "node_id", "left"))


def backfill_report(filled: DataFrame) -> DataFrame:
    """One row: samples backfilled, sensors touched, and the first of them as an example."""
    own = filled.where("backfilled")
    return own.agg(F.count(F.lit(1)).alias("samples"), F.count_distinct("node_id", "addr").alias("sensors"), F.min_by("addr", F.struct("ms", "addr")).alias("example_addr"))


def diagnostic_history(spark, addrs: list[str], hours: int, low: float, high: float, end_epoch: int) -> DataFrame:
    """A synthetic sample every 5 minutes, one wave a day between ``low`` and ``high``; the wave is ours."""
    sensors = spark.createDataFrame([(0, a) for a in addrs], "node_id bigint, addr string")
    times = sensors.withColumn("epoch", F.explode(F.sequence(F.lit(end_epoch - hours * 3600).cast("long"), F.lit(end_epoch - 300).cast("long"), F.lit(300).cast("long"))))
    wave = (1 - F.cos(2 * F.pi() * F.pmod(F.col("epoch"), F.lit(86400)) / 86400)) / 2
    return times.select("node_id", "addr", "epoch", (low + (high - low) * wave).cast("float").alias("temp_c"), F.lit(True).alias("is_diagnostic"))


def downsample(samples: DataFrame, bucket_ms: int) -> DataFrame:
    """L1: chart points: least and greatest of each bucket (our choice; the original way is unknown)."""
    bucket = F.floor(F.col("rx_ms") / bucket_ms) * bucket_ms
    return samples.groupBy("node_id", "addr", bucket.cast("long").alias("bucket_ms")).agg(F.min("temp_c").alias("low"), F.max("temp_c").alias("high"), F.count(F.lit(1)).alias("n"))
