"""Centroid clustering by ball k-means, in whole numbers.

A cluster is kept as balls: the members of one block of rows around their centroid, with the largest of their distances
as radius.  A centroid is a ball's neighbour if it is no farther from the ball's than twice the radius; no other can be
nearest to a member.  Neighbours in order of distance cut the ball into a core, whose members are nearer to their centroid
than half the way to any neighbour and so stay, and annuli: members of the k-th are compared with the first k neighbours
alone, exactly.  Distances are squared and whole, so nothing is rounded and ties are seen: of equally near centroids the
one of the smaller number wins.

A round reads the vectors with their last assignment from the shared folder, assigns, and writes them again; sums by cluster
are grouped by Spark.  The driver holds the centroids alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calorine.llm.common import Steps, cleaning, only

#: Components are held within this: squared distances of vectors of up to 64 components then fit a long.
MOST = 1 << 27
#: With all components below this, double precision holds every distance exactly.
EXACT = 1 << 22
LONG = (1 << 63) - 1


def quantised(df: DataFrame, dims: int, scale: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, v): vectors of exactly ``dims`` components, none null or non-finite, each component x as floor(scale * x)."""
    x = F.col("x")
    rows = only(df, id_col, vec_col).toDF("id", "x").withColumn("x", x.cast("array<double>"))
    kept = rows.where((F.size("x") == dims) & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    whole = F.transform("x", lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(float(MOST))), F.lit(float(-MOST)))).cast("int"))
    return kept.select("id", whole.alias("v"))


def seeds(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The components of the ``k`` vectors with the smallest sha256 of ``<seed>:<id>``: a top-k of bounded size."""
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    first = vectors.where("id IS NOT NULL").select(place.alias("place"), "v").orderBy("place", "v").limit(k)
    return np.array([r["v"] for r in first.collect()], np.int64)


def squared(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of whole numbers from one."""
    apart = points - centre
    if apart.size and np.abs(apart).max() < EXACT:
        apart = apart.astype(np.float64)
    return np.einsum("ij,ij->i", apart, apart).astype(np.int64)


def nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """``moved`` for points that have no cluster yet: all centroids are compared."""
    best, at = squared(points, centres[0]), np.zeros(len(points), np.int32)
    for j in range(1, len(centres)):
        d = squared(points, centres[j])
        closer = d < best
        best[closer], at[closer] = d[closer], j
    return at, best, len(points) * len(centres)


def moved(points: np.ndarray, at: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance, comparisons) of each point by its last cluster's ball.

    A centroid j can be as near as a point's own i only if |ci - cj| <= 2 |p - ci|, in squares D <= 4 d.
    """
    at, best, made = at.copy(), np.zeros(len(points), np.int64), 0
    for i in np.unique(at):
        rows = np.flatnonzero(at == i)
        own = squared(points[rows], centres[i])
        far = squared(centres, centres[i])
        ball = 4 * int(own.max())
        near = np.array([j for j in np.argsort(far, kind="stable") if j != i and far[j] <= ball], np.int64)
        annulus = np.searchsorted(far[near], 4 * own, side="right")  # of each member; 0: the stable core
        made += len(rows)
        top, home = own.copy(), np.full(len(rows), i, np.int32)
        for k, j in enumerate(near):
            own_rows = np.flatnonzero(annulus > k)
            d = squared(points[rows[own_rows]], centres[j])
            made += len(d)
            closer = (d < top[own_rows]) | (d == top[own_rows]) & (j < home[own_rows])
            top[own_rows[closer]], home[own_rows[closer]] = d[closer], j
        at[rows], best[rows] = home, top
    return at, best, made


def assign(vectors: DataFrame, centres: np.ndarray, first: bool = False) -> DataFrame:
    """(id, v, cluster, distance) of vectors (id, v, cluster); ``first``: they have no cluster yet."""
    held = vectors.sparkSession.sparkContext.broadcast(centres)  # k vectors
    dims = centres.shape[1]

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            if not batch.num_rows:
                continue
            column = batch.column(1)
            points = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64)
            cluster, distance, _ = nearest(points, held.value) if first else moved(points, batch.column(2).to_numpy(zero_copy_only=False), held.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), column, pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], ["id", "v", "cluster", "distance"])

    kind = dict(vectors.dtypes)["id"]
    return vectors.select("id", "v", *([] if first else ["cluster"])).mapInArrow(batches, f"id {kind}, v array<int>, cluster int, distance bigint")


def means(assigned: DataFrame, centres: np.ndarray) -> np.ndarray:
    """Each cluster's exact componentwise floor(sum / count); a cluster without vectors keeps its centroid."""
    sums = [F.sum(F.col("v")[i].cast("long")).alias(f"s{i}") for i in range(centres.shape[1])]  # a long holds 2**36 vectors' components at MOST
    out = centres.copy()
    for r in assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *sums).collect():  # k rows
        out[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(centres.shape[1])]
    return out


def digest(centre: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centre.tolist())).encode()).hexdigest()


def cluster(df: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: str = "1", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that counts.

    A vector with another number of components, or with null or non-finite ones, doesn't count; neither does a null one.
    Components beyond ``MOST`` after scaling are held at it, and inertias end at the greatest long.  Fewer vectors than ``k`` make
    fewer clusters.  Repeated rows each count and each give a row; of equal ids the smaller vector comes first as a centroid; rows
    without an id are assigned but never begin as a centroid; if no row has one, or of an empty table, there are no rows.
    Further columns are dropped.
    """
    spark = df.sparkSession
    steps = Steps(spark, "ball-kmeans")
    vectors = steps.write(quantised(df, dims, scale, id_col, vec_col))
    kind = dict(df.dtypes)[id_col]
    shape = f"`{id_col}` {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    with cleaning(spark):
        centres = seeds(vectors, k, seed)
        if not len(centres):
            steps.drop(vectors)
            return spark.createDataFrame([], shape)
        for turn in range(rounds):
            before, vectors = vectors, steps.write(assign(vectors, centres, first=turn == 0))
            steps.drop(before)
            centres = means(vectors, centres)
        last = steps.write(assign(vectors, centres, first=rounds == 0).drop("v"))
        steps.drop(vectors)
        capped = lambda total: int(min(total, LONG))
        sums = {r["cluster"]: int(r["s"]) for r in last.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    table = spark.createDataFrame([(c, capped(s), capped(sum(sums.values())), digest(centres[c])) for c, s in sums.items()], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    found = last.join(F.broadcast(table), "cluster")  # k rows: a proven bound
    return found.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
