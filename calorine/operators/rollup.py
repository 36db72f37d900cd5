"""Rollups: minutes to hours to local days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calorine.functions import scalar as S

DAY_MINUTES = 1440


def _mean(total, count):
    return F.round(total.cast("double") / count).cast("int")


def hourly_rollup(minutes: DataFrame) -> DataFrame:
    """A1: (node_id, addr, hour_min, mean_centi, min_centi, max_centi, sample_count) of ``minute_samples``.

    Minutes without a number don't count; an hour of such alone has nulls and count 0.  The minutes are already dealt
    by (sensor, hour): no further shuffle.
    """
    out = minutes.groupBy("node_id", "addr", "hour_min").agg(F.sum("centi").alias("total"), F.min("centi").alias("min_centi"), F.max("centi").alias("max_centi"), F.count("centi").alias("n"))
    return out.select("node_id", "addr", "hour_min", _mean(F.col("total"), F.col("n")).alias("mean_centi"), "min_centi", "max_centi", F.col("n").cast("int").alias("sample_count"))


def daily_rollup(hours: DataFrame, zone: str = "UTC") -> DataFrame:
    """Days from hours, by the local day of the hour's start.

    The mean is that of the hours' rounded means, weighted by counts; the count is at most 1440 while the sum is not
    cut.  ``exact_mean`` divides by the whole count.  O2: order by (node_id, addr) where an order is asked for.
    """
    valid = hours.where(S.rollup_valid(F.col("mean_centi"), F.col("sample_count"))).withColumn("day", S.local_day(F.col("hour_min"), zone))
    out = valid.groupBy("node_id", "addr", "day").agg(
        F.sum(F.col("mean_centi").cast("long") * F.col("sample_count")).alias("sum_centi"), F.sum("sample_count").alias("n"), F.min("min_centi").alias("min_centi"), F.max("max_centi").alias("max_centi")
    )
    count = F.least(F.col("n"), F.lit(DAY_MINUTES))
    return out.select("node_id", "addr", "day", _mean(F.col("sum_centi"), count).alias("mean_centi"), "min_centi", "max_centi", count.cast("int").alias("sample_count"), (F.col("sum_centi") / F.col("n")).alias("exact_mean"))


def daily_state(hours: DataFrame, zone: str = "UTC") -> DataFrame:
    """Mergeable partial states (node_id, addr, day, sum, count, min, max)."""
    valid = hours.where(S.rollup_valid(F.col("mean_centi"), F.col("sample_count"))).withColumn("day", S.local_day(F.col("hour_min"), zone))
    return valid.groupBy("node_id", "addr", "day").agg(
        F.sum(F.col("mean_centi").cast("long") * F.col("sample_count")).alias("sum"), F.sum("sample_count").cast("long").alias("count"), F.min("min_centi").alias("min"), F.max("max_centi").alias("max")
    )


def merge_states(*states: DataFrame) -> DataFrame:
    """The union of partial states, merged by key: find or create, for all keys at once."""
    union = states[0]
    for s in states[1:]:
        union = union.unionByName(s)
    return union.groupBy("node_id", "addr", "day").agg(F.sum("sum").alias("sum"), F.sum("count").alias("count"), F.min("min").alias("min"), F.max("max").alias("max"))


def finalize_states(states: DataFrame) -> DataFrame:
    """A3."""
    count = F.least(F.col("count"), F.lit(DAY_MINUTES))
    return states.where("count > 0").select("node_id", "addr", "day", _mean(F.col("sum"), count).alias("mean_centi"), F.col("min").alias("min_centi"), F.col("max").alias("max_centi"), count.cast("int").alias("sample_count"))


def last_record_by_hour(stored: DataFrame, order_col: str) -> DataFrame:
    """A4: of records of one sensor and hour, that stored last."""
    rest = [c for c in stored.columns if c not in ("node_id", "addr", "hour_min", order_col)]
    best = stored.groupBy("node_id", "addr", "hour_min").agg(F.max(F.struct(order_col, *rest)).alias("r"))
    return best.select("node_id", "addr", "hour_min", *[F.col(f"r.{c}").alias(c) for c in rest])


def rebuild_day(stored: DataFrame, order_col: str, day: str, zone: str = "UTC") -> DataFrame:
    """A4, Q3: a local day rebuilt from stored hours; its true end is taken, so a 25th hour counts."""
    own = stored.where(S.local_day(F.col("hour_min"), zone) == F.to_date(F.lit(day)))
    return daily_rollup(last_record_by_hour(own, order_col), zone)
