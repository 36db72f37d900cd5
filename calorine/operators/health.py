"""Latest state, sequence health, staleness and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calorine.functions import scalar as S
from calorine.operators.ranges import HOT, PART, entering, in_ranges

DUPLICATE_LIMIT = (1 << 32) - 1


def latest_state(samples: DataFrame) -> DataFrame:
    """The last row of each (node_id, addr), value or not: partial maxima, no sort."""
    rest = [c for c in samples.columns if c not in ("node_id", "addr", "rx_ms", "event_id")]
    best = samples.groupBy("node_id", "addr").agg(F.max(F.struct("rx_ms", "event_id", *rest)).alias("s"))
    return best.select("node_id", "addr", F.col("s.rx_ms").alias("last_ms"), *[F.col(f"s.{c}").alias(c) for c in rest])


def last_seen(messages: DataFrame, node: str = "node_id", ms: str = "rx_ms") -> DataFrame:
    """When each node was last heard, whatever the message."""
    return messages.groupBy(node).agg(F.max(ms).alias("last_seen_ms"))


def node_age(latest: DataFrame, seen: DataFrame, now_ms: int) -> DataFrame:
    """Each node's age in minutes by the later of its last update and its sensors' last values."""
    sensors = latest.groupBy("node_id").agg(F.max("last_ms").alias("sensor_ms"), F.count(F.lit(1)).alias("sensors"))
    both = seen.join(sensors, "node_id", "left")
    return both.select("node_id", "sensors", S.age_minutes(F.lit(now_ms), F.col("last_seen_ms"), F.coalesce("sensor_ms", "last_seen_ms")).alias("age_minutes"))


def _classes(rows: DataFrame) -> DataFrame:
    """Classes and runs of rows (node_id, __part, rx_ms, event_id, seq, seq_before, run_before), range by range."""
    inside = Window.partitionBy("node_id", PART).orderBy("rx_ms", "event_id")
    last = F.coalesce(F.lag("seq").over(inside), F.col("seq_before"))
    kind = F.when(last.isNull(), "first").when(F.col("seq") > last, "advance").when(F.col("seq") == last, "duplicate").otherwise("reset")
    marked = rows.withColumn("class", kind)
    marked = marked.withColumn("island", F.sum(F.when(F.col("class") != "duplicate", 1).otherwise(0)).over(inside))
    run = F.sum(F.when(F.col("class") == "duplicate", 1).otherwise(0)).over(Window.partitionBy("node_id", PART, "island").orderBy("rx_ms", "event_id"))
    run = run + F.when(F.col("island") == 0, F.coalesce("run_before", F.lit(0))).otherwise(0)
    return marked.withColumn("dup_run", F.least(run, F.lit(DUPLICATE_LIMIT)).cast("long")).drop("island", "seq_before", "run_before")


def _range_states(rows: DataFrame) -> DataFrame:
    """Of each (node_id, __part): the sequence number and the run of duplicates that enter it.

    A range's summary: its first and last number, its rows, the duplicates at its end, and whether all of its rows are of one number.  A range
    of one number that goes on from the range before adds its rows to that one's run; any other ends with a run of its own.
    """
    alone = _classes(rows.withColumns({"seq_before": F.lit(None).cast("long"), "run_before": F.lit(0).cast("long")}))
    at = F.struct("rx_ms", "event_id")
    own = alone.groupBy("node_id", PART).agg(F.min_by("seq", at).alias("head"), F.max_by("seq", at).alias("tail"), F.count(F.lit(1)).alias("n"), F.max_by("dup_run", at).alias("run"))
    ranges = Window.partitionBy("node_id").orderBy(PART)
    own = own.withColumn("seq_before", F.lag("tail").over(ranges))
    goes_on = (F.col("run") == F.col("n") - 1) & F.coalesce(F.col("head") == F.col("seq_before"), F.lit(False))
    own = own.withColumn("stretch", F.sum(F.when(goes_on, 0).otherwise(1)).over(ranges))
    own = own.withColumn("end_run", F.sum(F.when(goes_on, F.col("n")).otherwise(F.col("run"))).over(Window.partitionBy("node_id", "stretch").orderBy(PART)))
    return own.select("node_id", PART, "seq_before", F.coalesce(F.lag("end_run").over(ranges), F.lit(0)).alias("run_before"))


def classify_sequence(frames: DataFrame, hot: int = HOT) -> DataFrame:
    """Each frame's class (first, advance, duplicate, reset) and the run of duplicates up to it.

    Frames (node_id, rx_ms, event_id, seq) with seq 0 are ignored.  The run counts duplicates since the last other frame.
    The frames of a node with more than ``hot`` are spread over ranges of time, whose summaries are put together (``ranges``).
    """
    rows, several = in_ranges(frames.where("seq <> 0").select("node_id", "rx_ms", "event_id", "seq"), ["node_id"], ["rx_ms", "event_id"], hot)
    if several:
        rows = entering(rows, _range_states(rows), ["node_id"])
    else:
        rows = rows.withColumns({"seq_before": F.lit(None).cast("long"), "run_before": F.lit(0).cast("long")})
    return _classes(rows).drop(PART)


def sequence_stuck(frames: DataFrame, now_ms: int, threshold_ms: int, hot: int = HOT) -> DataFrame:
    """(node_id, last_advance_ms, last_rx_ms, dups, stuck) as of ``now_ms``.

    Stuck: duplicates have come since the last advance, which is at least the threshold ago.  A reset counts as an advance.
    """
    seen = classify_sequence(frames.where(F.col("rx_ms") <= now_ms), hot)
    state = seen.groupBy("node_id").agg(
        F.max(F.when(F.col("class") != "duplicate", F.col("rx_ms"))).alias("last_advance_ms"), F.max("rx_ms").alias("last_rx_ms"), F.max_by("dup_run", F.struct("rx_ms", "event_id")).alias("dups")
    )
    stuck = (F.lit(now_ms) - F.col("last_advance_ms") >= threshold_ms) & (F.col("last_rx_ms") > F.col("last_advance_ms")) & (F.col("dups") > 0)
    return state.select("node_id", "last_advance_ms", "last_rx_ms", "dups", stuck.alias("stuck"))


def severity(alert: Column, stale: Column, warning: Column, stuck: Column, missing: Column) -> Column:
    """V1."""
    return F.when(alert, "alert").when(stale | warning | stuck, "warning").when(missing, "missing").otherwise("ok")


def sensor_colour(has_value: Column, sensor_alert: Column, sensor_warning: Column, node_alert: Column, node_warning: Column, missing: Column) -> Column:
    """V2: ``node_warning`` is stale, warning or stuck."""
    return F.when(~has_value, "none").when(sensor_alert, "alert").when(sensor_warning, "warning").when(node_alert, "alert").when(node_warning, "warning").when(missing, "missing").otherwise("ok")


def status(latest: DataFrame, stuck: DataFrame, now_ms: int, stale_ms: int, low: float, high: float, margin: float) -> DataFrame:
    """V1 on nodes: thresholds are parameters, ours, as their original values are unknown.

    Alert: a value at or beyond ``low`` or ``high``; warning: within ``margin`` of them; stale: no value for ``stale_ms``;
    missing: a sensor without a value.
    """
    t = F.col("temp_c")
    nodes = latest.groupBy("node_id").agg(
        F.coalesce(F.bool_or((t >= high) | (t <= low)), F.lit(False)).alias("alert"),
        F.coalesce(F.bool_or((t >= high - margin) | (t <= low + margin)), F.lit(False)).alias("warning"),
        F.bool_or(t.isNull()).alias("missing"),
        F.max("last_ms").alias("last_ms"),
    )
    joined = nodes.join(stuck.select("node_id", "stuck"), "node_id", "left")
    stale = F.lit(now_ms) - F.col("last_ms") > stale_ms
    return joined.select("node_id", severity(F.col("alert"), stale, F.col("warning"), F.coalesce("stuck", F.lit(False)), F.col("missing")).alias("severity"))


def tiles(latest: DataFrame, titles: DataFrame, per_tile: int = 2) -> DataFrame:
    """One row a node, in title order of rank: its title and the texts of at most two sensors."""
    order = Window.partitionBy("node_id").orderBy(S.effective_rank(F.col("node_rank"), F.col("global_rank")), "addr")
    shown = latest.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_tile)
    lines = shown.groupBy("node_id").agg(F.sort_array(F.collect_list(F.struct("place", F.concat_ws(" ", "label", S.display(F.col("temp_c"), "C")).alias("text")))).alias("lines"))
    joined = titles.join(lines, "node_id", "left")
    text = F.array_join(F.transform("lines", lambda x: x["text"]), " / ")
    title = F.when(F.coalesce(F.trim("title"), F.lit("")) == "", "(unnamed)").otherwise(F.col("title"))
    return joined.select("node_id", title.alias("title"), F.coalesce(text, F.lit("(no sensors)")).alias("sensors"))


def find_label(sensors: DataFrame, label: str) -> DataFrame:
    """the first sensor of a label, whatever its case; an empty label finds none."""
    hits = sensors.where((F.lower("label") == label.lower()) & (F.lit(label) != ""))
    return hits.orderBy("node_id", "addr").limit(1)
