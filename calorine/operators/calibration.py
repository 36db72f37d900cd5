"""Calibration: solving coefficients, applying them, and what is attached or orphaned."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calorine.functions import scalar as S
from calorine.operators.ranges import HOT, PART, dealt, many, split
from calorine.sources.shared import written

#: A value is steady once it has stayed within EPS of the last change for this long.
STEADY_EPS, STEADY_MS = 0.001, 30_000
#: Raw points closer than this solve nothing.
LEAST_SPAN = 1e-4


def working_points(readings: DataFrame, locks: DataFrame) -> DataFrame:
    """V4: (addr, stage, raw, actual): at each lock (addr, stage, lock_ms, actual) the last raw reading before it; the
    last lock of a stage counts."""
    last = locks.groupBy("addr", "stage").agg(F.max(F.struct("lock_ms", "actual")).alias("l")).select("addr", "stage", "l.*")
    near = readings.join(last, "addr").where(F.col("rx_ms") <= F.col("lock_ms"))
    return near.groupBy("addr", "stage", "actual").agg(F.max_by("temp_c", "rx_ms").alias("raw")).select("addr", "stage", "raw", "actual")


def solve_two_point(points: DataFrame) -> DataFrame:
    """(addr, a1, a0) from each address's ICE and BOIL points (addr, stage, raw, actual).

    Both points are needed, and raw values at least LEAST_SPAN apart.
    """
    both = points.groupBy("addr").pivot("stage", ["ICE", "BOIL"]).agg(F.first("raw").alias("raw"), F.first("actual").alias("actual"))
    x1, y1, x2, y2 = (F.col(c).cast("double") for c in ("ICE_raw", "ICE_actual", "BOIL_raw", "BOIL_actual"))
    a1 = (y2 - y1) / (x2 - x1)
    return both.where(x1.isNotNull() & x2.isNotNull() & (F.abs(x2 - x1) >= LEAST_SPAN)).select("addr", a1.alias("a1"), (y1 - a1 * x1).alias("a0"))


def apply_calibration(samples: DataFrame, calibration: DataFrame) -> DataFrame:
    """Samples with ``temp_c`` corrected and ``corrected`` set where the coefficients change anything.

    Addresses match whatever their case.  Spark chooses the join by the calibration table's size.
    """
    table = calibration.select(F.upper("addr").alias("cal_addr"), "a1", "a0")
    joined = samples.join(table, F.upper("addr") == F.col("cal_addr"), "left")
    corrected = F.col("a1").isNotNull() & ~S.is_identity(F.col("a1"), F.col("a0"))
    t = F.when(corrected, S.calibrated(F.col("temp_c"), F.col("a1"), F.col("a0"))).otherwise(F.col("temp_c"))
    return joined.withColumns({"temp_c": t, "corrected": F.coalesce(corrected, F.lit(False))}).drop("cal_addr", "a1", "a0")


def attachment(attached: DataFrame, calibration: DataFrame) -> DataFrame:
    """(addr, state): ``calibrated``, ``uncalibrated`` (attached only) or ``orphan`` (stored only)."""
    here, stored = attached.select(F.upper("addr").alias("addr")).distinct(), calibration.select(F.upper("addr").alias("addr")).distinct()
    parts = [(here.join(stored, "addr", "left_semi"), "calibrated"), (here.join(stored, "addr", "left_anti"), "uncalibrated"), (stored.join(here, "addr", "left_anti"), "orphan")]
    frames = [df.withColumn("state", F.lit(state)) for df, state in parts]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


def change_points(start: np.ndarray, values: np.ndarray, eps: float) -> np.ndarray:
    """For each row the index of the last change up to it.

    start: where an address begins.  values: NaN for none.  A change is a value more than ``eps`` from that of the last
    change, or one that appears or vanishes.  Neighbours more than ``2 * eps`` apart can't both be within ``eps`` of one
    value, so they part the rows into stretches at once; within a stretch of small steps, changes are jumped to.
    """
    n = len(values)
    gone, step = np.isnan(values), np.abs(np.diff(values, prepend=np.nan))
    fixed = start | (gone != np.concatenate([[False], gone[:-1]])) | (step > 2 * eps)
    anchor = np.maximum.accumulate(np.where(fixed, np.arange(n), 0))
    over = np.abs(values - values[anchor]) > eps
    ends = np.append(np.flatnonzero(fixed)[1:], n)
    for at, end in zip(np.flatnonzero(fixed), ends):
        if not over[at:end].any():
            continue
        while True:
            # The next change is looked for in ever wider windows.
            low, width, found = at + 1, 16, -1
            while low < end and found < 0:
                far = np.flatnonzero(np.abs(values[low : min(low + width, end)] - values[at]) > eps)
                found, low, width = (low + int(far[0]) if len(far) else -1), low + width, 2 * width
            anchor[at : found if found >= 0 else end] = at
            if found < 0:
                break
            at = found
    return anchor


def _anchors(rows: DataFrame, eps: float) -> DataFrame:
    """Rows (addr, piece, entry, rx_ms, event_id, temp_c) with the time and value of the last change up to each.

    Pieces stream through sorted, a batch at a time, and a piece's state is two numbers.  A piece's first row is a change; an ``entry``
    row stands for the change before it, and doesn't come back.
    """

    def walk(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carried: tuple | None = None  # address, piece, value and time of the last change
        for rows in stream:
            if not len(rows):
                continue
            # The last change of the batch before goes first, as a row of its own.
            extra = 0 if carried is None else 1
            addr, piece, ms, values = rows["addr"].to_numpy(), rows["piece"].to_numpy(), rows["rx_ms"].to_numpy(), rows["temp_c"].to_numpy(np.float64)
            if extra:
                addr, piece, values, ms = (np.concatenate([[c], x]) for c, x in zip(carried, (addr, piece, values, ms)))
            start = np.concatenate([[True], (addr[1:] != addr[:-1]) | (piece[1:] != piece[:-1])])
            anchor = change_points(start, values, eps)
            carried = (addr[-1], piece[-1], values[anchor[-1]], ms[anchor[-1]])
            found = rows.assign(anchor_ms=ms[anchor][extra:].astype(np.int64), anchor_c=values[anchor][extra:].astype(np.float32), changed=(anchor == np.arange(len(ms)))[extra:])
            yield found[~rows["entry"].to_numpy()].drop(columns="entry")

    ordered = rows.select("addr", "piece", "entry", "rx_ms", "event_id", "temp_c").repartition("addr", "piece").sortWithinPartitions("addr", "piece", F.desc("entry"), "rx_ms", "event_id")
    return ordered.mapInPandas(walk, "addr string, piece int, rx_ms bigint, event_id bigint, temp_c float, anchor_ms bigint, anchor_c float, changed boolean")


def _entries(pieces: DataFrame, eps: float) -> DataFrame:
    """Adds ``known``, ``entry_ms``, ``entry_c`` to pieces (addr, piece, done, exit_ms, exit_c, low, high): the change that enters each, as far as it is known.

    A piece that is not done passes on what enters it if all its values lie within ``eps`` of that; else it is known to none but its rows.
    An address has a row a piece here.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("piece")
        known, ms, value, out = False, 0, np.nan, []
        for done, exit_ms, exit_c, low, high in zip(rows["done"], rows["exit_ms"], rows["exit_c"].astype(float), rows["low"].astype(float), rows["high"].astype(float)):
            out.append((known, ms, value))
            if done:
                known, ms, value = True, exit_ms, exit_c
            elif known:
                known = (value != value and low != low) or (abs(low - value) <= eps and abs(high - value) <= eps)
        return rows.assign(known=[k for k, _, _ in out], entry_ms=[m for _, m, _ in out], entry_c=np.array([v for *_, v in out], np.float32))

    return pieces.groupBy("addr").applyInPandas(fold, "addr string, piece int, done boolean, exit_ms bigint, exit_c float, low float, high float, known boolean, entry_ms bigint, entry_c float")


def _steady_spread(rows: DataFrame, eps: float) -> DataFrame:
    """W7 of addresses with more rows than one task should have: ranges of time as pieces.

    A value more than ``2 * eps`` from the one before, or appearing or vanishing, is a change whatever came before; a piece with such a
    row ends in a state that its own rows tell.  The others wait for their entry and are then walked, turn by turn; that takes a turn for each of
    a row of pieces that drift without any such step.
    """
    pieces = dealt(rows, ["addr"], ["rx_ms", "event_id"], many(rows)).withColumnRenamed(PART, "piece").withColumn("entry", F.lit(False))
    inside = Window.partitionBy("addr", "piece").orderBy("rx_ms", "event_id")
    value = F.when(~F.isnan("temp_c"), F.col("temp_c")).cast("double")
    step = (F.lag(value).over(inside).isNull() != value.isNull()) | (F.abs(value - F.lag(value).over(inside)) > 2 * eps)
    steps = pieces.withColumn("fixed", F.coalesce(step, F.lit(False)) & (F.row_number().over(inside) > 1))
    ends = steps.groupBy("addr", "piece").agg(F.bool_or("fixed").alias("fixed"), F.min(value).cast("float").alias("low"), F.max(value).cast("float").alias("high"))
    last = lambda df: df.groupBy("addr", "piece").agg(F.max_by(F.struct("anchor_ms", "anchor_c"), F.struct("rx_ms", "event_id")).alias("exit"))
    first = ends.groupBy("addr").agg(F.min("piece").alias("first"))
    known = ends.join(last(_anchors(pieces, eps)), ["addr", "piece"]).join(first, "addr")
    known = written(known.select("addr", "piece", (F.col("fixed") | (F.col("piece") == F.col("first"))).alias("done"), F.col("exit.anchor_ms").alias("exit_ms"), F.col("exit.anchor_c").alias("exit_c"), "low", "high"), "pieces")
    row = lambda df: df.select("addr", "piece", F.col("entry_ms").alias("rx_ms"), F.lit(0).cast("long").alias("event_id"), F.col("entry_c").alias("temp_c"), F.lit(True).alias("entry"))
    own = ["addr", "piece", "rx_ms", "event_id", "temp_c", "entry"]
    while True:
        entries = written(_entries(known, eps), "entries")
        stays = F.coalesce((F.abs(F.col("low").cast("double") - F.col("entry_c").cast("double")) <= eps) & (F.abs(F.col("high").cast("double") - F.col("entry_c").cast("double")) <= eps), F.isnan(F.coalesce("entry_c", F.lit(float("nan")))) & F.col("low").isNull())
        ready = entries.where(~F.col("done") & F.col("known") & ~stays)
        if ready.isEmpty():
            break
        walked = pieces.join(ready.select("addr", "piece"), ["addr", "piece"]).select(own).unionByName(row(ready))
        ended = last(_anchors(walked, eps)).select("addr", "piece", "exit")
        found = entries.join(ended, ["addr", "piece"], "left")
        known = written(found.select("addr", "piece", (F.col("done") | F.col("exit").isNotNull()).alias("done"), F.coalesce("exit.anchor_ms", "exit_ms").alias("exit_ms"), F.when(F.col("exit").isNotNull(), F.col("exit.anchor_c")).otherwise(F.col("exit_c")).alias("exit_c"), "low", "high"), "pieces")
    return _anchors(pieces.select(own).unionByName(row(entries.where("known"))), eps)


def steady(readings: DataFrame, eps: float = STEADY_EPS, hold_ms: int = STEADY_MS, hot: int = HOT) -> DataFrame:
    """(addr, rx_ms, event_id, temp_c, anchor_ms, steady) of each reading.

    A value is compared with the last *changed* one, not with the one before, so that a slow drift is seen; that is a
    recurrence, kept by address in time order.  Values appearing or vanishing are changes.  An address of at most ``hot`` rows streams
    through one task; the rows of others are cut into pieces, each walked from the state that enters it.
    """
    rows = readings.select("addr", "rx_ms", "event_id", F.col("temp_c").cast("float").alias("temp_c"))
    cold, big = split(rows, ["addr"], hot)
    found = _anchors(cold.withColumns({"piece": F.lit(0), "entry": F.lit(False)}), eps)
    if big is not None:
        found = found.unionByName(_steady_spread(written(big, "hot-rows"), eps))
    return found.select("addr", "rx_ms", "event_id", "temp_c", "anchor_ms", (~F.col("changed") & (F.col("rx_ms") - F.col("anchor_ms") >= hold_ms)).alias("steady"))
