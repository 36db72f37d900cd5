"""Connected components by alternating large and small stars, as joins and grouped minima.

Every round rewires each node's larger neighbours to the smallest node it knows (large star), then its smaller ones
(small star), until each component is a star around its smallest node; the rounds grow with the logarithm of the
longest path.  No group is collected: minima are aggregated, and a hub's edges meet its minimum in a join that
adaptive execution splits.  Each step's table goes when the next is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calorine.llm.common import Steps, cleaning


def _stars(e: DataFrame) -> bool:
    """Whether each node has one component, and no component is a node: then all are stars already."""
    ends = e.select(F.col("node").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("component").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    seen = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    with cleaning(e.sparkSession):
        return seen.where("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def connected_components(edges: DataFrame, steps: Steps | None = None) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b) but each component's smallest, which names it.

    Nulls and loops are no edges; repeated edges count once; no edges give no rows.  The result is one of ``steps``.
    """
    steps = steps or Steps(edges.sparkSession, "components")
    u, v = F.col("node"), F.col("component")
    e = edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("component")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()
    e = steps.write(e)
    while not _stars(e):
        both = e.unionByName(e.select(v.alias("node"), u.alias("component")))
        # Minima are written out: a join of two plain inputs is one whose hot keys can be split.
        least = steps.write(both.groupBy("node").agg(F.least(F.min("component"), u).alias("m")))
        large = both.where("component > node").join(least, "node").select(v.alias("node"), F.col("m").alias("component"))
        large = steps.write(large.where("node <> component").distinct())
        steps.drop(e, least)
        least = steps.write(large.groupBy("node").agg(F.min("component").alias("m")))
        small = large.join(least, "node").where("component <> m").select(v.alias("node"), F.col("m").alias("component"))
        e = steps.write(small.unionByName(least.select("node", F.col("m").alias("component"))).distinct())
        steps.drop(large, least)
    return e
