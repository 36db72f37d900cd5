"""The minute grid: snapshots of the latest values at each minute's start."""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calorine.functions import scalar as S
from calorine.operators.ranges import HOT, PART, dealt, last_known, many

MAX_SENSORS = 100


LATEST = ["node_id", "addr", "hour_min", "epoch_minute"]


def minute_readings(samples: DataFrame, stale_ms: int = S.STALE_MS) -> DataFrame:
    """(node_id, addr, hour_min, epoch_minute, rx_ms, event_id, temp_c): the latest reading that serves each minute.

    A maximum: readings of several inputs merge by ``latest_readings``, in any order and however often.

    Rows are dealt once by (sensor, hour), before they are expanded: a reading that serves minutes of two hours goes to
    both.  That serves the minute's choice here and a rollup by hour after it.
    """
    first, last = F.ceil(F.col("rx_ms") / 60000).cast("long"), F.floor((F.col("rx_ms") + stale_ms) / 60000).cast("long")
    timed = samples.select("node_id", "addr", "rx_ms", "event_id", "temp_c", first.alias("first"), last.alias("last")).where("last >= first")
    hours = F.sequence(S.hour_start(F.col("first")), S.hour_start(F.col("last")), F.lit(60).cast("long"))
    dealt = timed.select("*", F.explode(hours).alias("hour_min")).repartition("node_id", "addr", "hour_min")
    minutes = F.sequence(F.greatest("first", "hour_min"), F.least(F.col("last"), F.col("hour_min") + 59))
    return latest_readings(dealt.select("node_id", "addr", "hour_min", "rx_ms", "event_id", "temp_c", F.explode(minutes).alias("epoch_minute")))


def latest_readings(readings: DataFrame) -> DataFrame:
    """The latest reading of each (sensor, minute); of equal times that of the largest event_id."""
    latest = readings.groupBy(*LATEST).agg(F.max(F.struct("rx_ms", "event_id", "temp_c")).alias("s"))
    return latest.select(*LATEST, "s.*")


def finish_minutes(readings: DataFrame) -> DataFrame:
    """(node_id, addr, epoch_minute, hour_min, present, centi) of the latest readings of minutes."""
    t = F.col("temp_c")
    has = t.isNotNull() & ~F.isnan(t)
    return readings.select("node_id", "addr", "epoch_minute", "hour_min", has.alias("present"), F.when(has, S.centi(t)).alias("centi"))


def minute_samples(samples: DataFrame, stale_ms: int = S.STALE_MS) -> DataFrame:
    """(node_id, addr, epoch_minute, hour_min, present, centi).

    Minute m is a snapshot at m's start: of the readings at or before it and no older than the horizon, the latest.
    Each reading is expanded to the few minutes it can serve, so there is no join and no dense grid.  A later frame
    without a value wins, and the minute is then missing.  A value out of range is present without a number.
    """
    return finish_minutes(minute_readings(samples, stale_ms))


def descriptor(samples: DataFrame, max_sensors: int = MAX_SENSORS) -> DataFrame:
    """(slot, node_id, addr): the sensors of all nodes in order of (node_id, addr), the first ones only.

    The cap is the feature: a block has that many slots.
    """
    sensors = samples.where(S.whole_address(F.col("addr"))).select("node_id", "addr").distinct().orderBy("node_id", "addr").limit(max_sensors)
    return sensors.withColumn("slot", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("node_id", "addr")) - 1).select("slot", "node_id", "addr")


def descriptor_by_hour(samples: DataFrame) -> DataFrame:
    """(node_id, addr, first_hour_min): a sensor is logged from the hour after the one it is first seen in."""
    first = samples.groupBy("node_id", "addr").agg(F.min("rx_ms").alias("first_ms"))
    return first.select("node_id", "addr", (S.hour_start(S.minute_of(F.col("first_ms"))) + 60).alias("first_hour_min"))


def descriptor_spans(first: DataFrame, cap: int = MAX_SENSORS) -> DataFrame:
    """(node_id, addr, from_hour_min, to_hour_min, slot, moves): when each sensor is among the first ``cap`` by (node_id, addr).

    first: (node_id, addr, first_hour_min).  A sensor's slot is the number of smaller keys that have come; it moves up at the hours
    ``moves``, and at ``to_hour_min`` (null: never) the ``cap``-th smaller key pushes it out.  Sensors that are never among the first have no row.
    So what a sensor must know of the smaller keys is their ``cap`` earliest hours: a sweep in order of keys keeps those, and ranges of keys hand
    on as many.  There is no row an hour.
    """
    rows = dealt(first.select("node_id", "addr", "first_hour_min"), [], ["node_id", "addr"], many(first))
    earliest = Window.partitionBy(PART).orderBy("first_hour_min", "node_id", "addr")
    heads = rows.withColumn("k", F.row_number().over(earliest)).where(F.col("k") <= cap).select(PART, "first_hour_min")
    own: dict[int, list[int]] = {}
    for r in heads.collect():  # cap numbers a range
        own.setdefault(r[PART], []).append(r["first_hour_min"])
    entry, so_far = {}, []
    for part in sorted(own):
        entry[part] = so_far
        so_far = sorted(so_far + own[part])[:cap]

    def sweep(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, hours = None, []
        for batch in stream:
            out = []
            for p, node, addr, first_hour in zip(batch[PART], batch["node_id"], batch["addr"], batch["first_hour_min"]):
                if p != part:
                    part, hours = p, list(entry[p])
                before = bisect_right(hours, first_hour)
                if before < cap:
                    gone = hours[cap - 1] if len(hours) == cap else None
                    out.append((node, addr, first_hour, gone, before, hours[before : cap - 1]))
                    insort(hours, first_hour)
                    del hours[cap:]
            made = pd.DataFrame(out, columns=["node_id", "addr", "from_hour_min", "to_hour_min", "slot", "moves"])
            yield made.astype({"to_hour_min": "Int64"})

    ordered = rows.repartition(PART).sortWithinPartitions(PART, "node_id", "addr")
    return ordered.mapInPandas(sweep, "node_id bigint, addr string, from_hour_min bigint, to_hour_min bigint, slot int, moves array<bigint>")


def same_descriptor(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (same): whether both hold the same slots."""
    left, right = (x.select("slot", "node_id", "addr") for x in (a, b))
    extra = left.exceptAll(right).unionByName(right.exceptAll(left))
    return extra.agg((F.count(F.lit(1)) == 0).alias("same"))


def span(samples: DataFrame, stale_ms: int = S.STALE_MS) -> tuple[int, int]:
    """The minutes [start, end) from the first reading's to the last one that the last reading serves; (0, 0) of none."""
    first, last = samples.agg(F.min("rx_ms"), F.max("rx_ms")).first()
    return (0, 0) if first is None else (first // 60_000, (last + stale_ms) // 60_000 + 1)


def dense_grid(slots: DataFrame, minutes: DataFrame, start_minute: int | Column, end_minute: int | Column) -> DataFrame:
    """Every minute of [start, end) for every slot; minutes without a sample are missing.

    For a bounded range of minutes and at most MAX_SENSORS slots; ``gap_runs`` says the same in fewer rows.
    """
    frame = slots.withColumn("epoch_minute", F.explode(F.sequence(F.lit(start_minute), F.lit(end_minute - 1)).cast("array<bigint>")))
    known = minutes.where(S.half_open(F.col("epoch_minute"), start_minute, end_minute)).select("node_id", "addr", "epoch_minute", "present", "centi")
    joined = frame.join(known, ["node_id", "addr", "epoch_minute"], "left")
    return joined.select("slot", "node_id", "addr", "epoch_minute", F.coalesce("present", F.lit(False)).alias("present"), "centi")


def minute_span(samples: DataFrame, stale_ms: int = S.STALE_MS) -> tuple[Column, Column]:
    """``span`` as scalar subqueries: no job runs while a query is built."""
    ends = samples.agg(F.floor(F.min("rx_ms") / 60_000).alias("first"), (F.floor((F.max("rx_ms") + stale_ms) / 60_000) + 1).alias("end"))
    return ends.select("first").scalar(), ends.select("end").scalar()


def gap_runs(slots: DataFrame, minutes: DataFrame, start: Column, end: Column, hot: int = HOT) -> DataFrame:
    """(slot, node_id, addr, from_minute, to_minute): each run of minutes of [start, end) that are missing for a slot.

    What ``dense_grid`` says in a row a minute, in rows whose number follows the readings: a run lies between two present minutes, before the
    first or after the last, and a slot without any is one run.
    """
    there = minutes.where("present").select("node_id", "addr", "epoch_minute").join(slots, ["node_id", "addr"]).where((F.col("epoch_minute") >= start) & (F.col("epoch_minute") < end))
    after = last_known(there, ["slot", "node_id", "addr"], ["epoch_minute"], F.col("epoch_minute"), hot, backwards=True, strict=True)
    first = slots.join(there.groupBy("slot").agg(F.min("epoch_minute").alias("known")), "slot", "left")
    edges = after.select("slot", "node_id", "addr", (F.col("epoch_minute") + 1).alias("from_minute"), "known").unionByName(first.select("slot", "node_id", "addr", start.alias("from_minute"), "known"))
    runs = edges.select("slot", "node_id", "addr", "from_minute", (F.coalesce("known", end) - 1).alias("to_minute"))
    return runs.where("from_minute <= to_minute")


def dense_hours(slots: DataFrame, minutes: DataFrame, start: Column, end: Column) -> DataFrame:
    """(slot, node_id, addr, hour_min, frames, present_mask, sum_centi): the dense grid in a row an hour of each slot.

    frames: the hour's minutes in [start, end); present_mask: a bit for each minute that is present; sum_centi: of the values.  Only the hours are
    spread out; the minutes are those that have a reading.
    """
    there = minutes.where((F.col("epoch_minute") >= start) & (F.col("epoch_minute") < end))
    minute = F.pmod("epoch_minute", F.lit(60)).cast("int")
    bits = F.bit_or(F.when(F.col("present"), F.call_function("shiftleft", F.lit(1).cast("long"), minute)).otherwise(F.lit(0).cast("long")))
    known = there.groupBy("node_id", "addr", "hour_min").agg(bits.alias("bits"), F.sum(F.col("centi").cast("long")).alias("sum_centi"))
    hours = slots.withColumn("hour_min", F.explode(F.sequence(S.hour_start(start), S.hour_start(end - 1), F.lit(60).cast("long"))))
    frames = F.least(F.col("hour_min") + 60, end) - F.greatest("hour_min", start)
    joined = hours.join(known, ["node_id", "addr", "hour_min"], "left")
    return joined.select("slot", "node_id", "addr", "hour_min", frames.alias("frames"), F.coalesce("bits", F.lit(0).cast("long")).alias("present_mask"), "sum_centi")


def bad_minutes(frames: DataFrame) -> DataFrame:
    """(hour_min, bad_frame_mask, bad_count): a bit for each minute of the hour not written or not valid.

    frames: (epoch_minute, valid).  Gap-filled frames are valid frames.
    """
    minute = F.pmod(F.col("epoch_minute"), F.lit(60)).cast("int")
    good = frames.where("valid").select(S.hour_start(F.col("epoch_minute")).alias("hour_min"), minute.alias("m"))
    hours = frames.select(S.hour_start(F.col("epoch_minute")).alias("hour_min")).distinct()
    written = good.groupBy("hour_min").agg(F.bit_or(F.expr("shiftleft(1L, m)")).alias("written"))
    full = (1 << 60) - 1
    mask = F.coalesce(F.col("written"), F.lit(0)).bitwiseXOR(F.lit(full))
    return hours.join(written, "hour_min", "left").select("hour_min", mask.alias("bad_frame_mask"), F.bit_count(mask).alias("bad_count"))
