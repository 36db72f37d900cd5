"""Hot keys in ranges: what must be told in a key's order is told without one task that holds the key's whole life.

Rows of keys beyond ``HOT`` rows are dealt by ranges of (key, order) and written, so that every step sees the same ranges; the
others stay whole, in one range of their own.  An operator works inside (key, range), sums each range up in a row, puts the summaries of a
key in order, at most one a range, and gives every range what enters it from those before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calorine.sources.shared import written

#: Rows that a key may have in one task.
HOT = 2_000_000
PART = "__part"


def dealt(df: DataFrame, keys: list[str], order: list[str], ranges: int | None = None) -> DataFrame:
    """The rows with the number of their range of (keys, order): of ``ranges`` ranges, or of as many as Spark finds fit for their size."""
    number = [] if ranges is None else [ranges]
    return written(df.repartitionByRange(*number, *keys, *order).withColumn(PART, F.spark_partition_id()), "ranges")


def many(df: DataFrame) -> int:
    """Ranges for hot keys: as many as the session's shuffles have partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def split(df: DataFrame, keys: list[str], hot: int = HOT) -> tuple[DataFrame, DataFrame | None]:
    """(the rows of keys with at most ``hot`` rows, the others), the latter None if no key has more."""
    big = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > hot).select(*keys)
    if big.isEmpty():
        return df, None
    big = written(big, "hot-keys")
    names = [f"__{k}" for k in keys]
    renamed = big.toDF(*names)
    on = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)]
    return df.join(renamed, on, "left_anti"), df.join(renamed, on, "left_semi")


def in_ranges(df: DataFrame, keys: list[str], order: list[str], hot: int = HOT) -> tuple[DataFrame, bool]:
    """(the rows with the number of their range, whether any key has several)."""
    cold, big = split(df, keys, hot)
    whole = cold.withColumn(PART, F.lit(-1))
    return (whole, False) if big is None else (whole.unionByName(dealt(big, keys, order, many(df))), True)


def entering(rows: DataFrame, summaries: DataFrame, keys: list[str]) -> DataFrame:
    """Each row with the columns of its range's summary (keys, range, ...)."""
    renamed = summaries.select(*[F.col(k).alias(f"__{k}") for k in (*keys, PART)], *[c for c in summaries.columns if c not in (*keys, PART)])
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in (*keys, PART)]
    return rows.join(renamed, on).drop(*[f"__{k}" for k in (*keys, PART)])


def last_known(df: DataFrame, keys: list[str], order: list[str], value: Column, hot: int = HOT, backwards: bool = False, strict: bool = False) -> DataFrame:
    """Adds ``known``: the last value that isn't null up to each row in its key's order; ``backwards``: the first from it on; ``strict``: without the row's own.

    Rows of a key must be told apart by ``order``.
    """
    rows, several = in_ranges(df.withColumn("__value", value), keys, order, hot)
    inside = Window.partitionBy(*keys, PART).orderBy(*order)
    ends = (int(strict), Window.unboundedFollowing) if backwards else (Window.unboundedPreceding, -int(strict))
    nearest = (F.first if backwards else F.last)("__value", ignorenulls=True)
    if not several:
        return rows.withColumn("known", nearest.over(inside.rowsBetween(*ends))).drop("__value", PART)
    edge = (F.min_by if backwards else F.max_by)("__value", F.when(F.col("__value").isNotNull(), F.struct(*order)))
    own = rows.groupBy(*keys, PART).agg(edge.alias("edge"))
    reach = Window.partitionBy(*keys).orderBy(PART)
    reach = reach.rowsBetween(1, Window.unboundedFollowing) if backwards else reach.rowsBetween(Window.unboundedPreceding, -1)
    own = own.select(*keys, PART, (F.first if backwards else F.last)("edge", ignorenulls=True).over(reach).alias("__enters"))
    found = entering(rows, own, keys).withColumn("known", F.coalesce(nearest.over(inside.rowsBetween(*ends)), "__enters"))
    return found.drop("__value", "__enters", PART)
