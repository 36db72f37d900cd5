"""Places in an order, found without one task that orders a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calorine.operators.ranges import PART, dealt, entering


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Adds ``name``: a row's place, from 0, among those of its keys (or of all, without keys) by the ``order`` columns.

    Rows are dealt by ranges of keys and order; a place is that in the range and the counts of the ranges before, so a
    key with any share of the rows is spread.  The dealt rows are written, so that all steps see the same ranges.
    """
    rows = dealt(df, keys, order)
    counts = rows.groupBy(*keys, PART).agg(F.count(F.lit(1)).alias("__n"))  # a key has a row a range at most
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*keys, PART, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys, PART).orderBy(*order)) - 1)
    return entering(inside, counts, keys).withColumn(name, (F.col(name) + F.col("__before")).cast("long")).drop(PART, "__before")


def daily_order(days: DataFrame) -> DataFrame:
    """O2: daily rollups with their ``place`` in the day's output, by node and address."""
    return ranked(days, ["day"], ["node_id", "addr"], "place")


def node_order(nodes: DataFrame) -> DataFrame:
    """O3: nodes with their ``place`` by ascending id."""
    return ranked(nodes, [], ["node_id"], "place")


def tile_order(tiles: DataFrame) -> DataFrame:
    """Tiles with their ``place`` on the screen, by title and then node."""
    return ranked(tiles, [], ["title", "node_id"], "place")
