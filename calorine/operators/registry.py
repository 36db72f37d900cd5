"""Peers, networks, and tables written once."""

from __future__ import annotations

import zlib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calorine.functions import scalar as S
from calorine.functions.crc import crc32_joined
from calorine.operators.ranges import HOT, PART, dealt, many, split


def best_channel(scans: DataFrame) -> DataFrame:
    """Each network's channel of the strongest signal; channels of 0 or less don't count."""
    return scans.where("channel > 0").groupBy("ssid").agg(F.max_by("channel", F.struct("rssi", F.negative("channel"))).alias("channel"), F.max("rssi").alias("rssi"))


def scan_channels(scans: DataFrame, low: int = 1, high: int = 11) -> DataFrame:
    """The channels in range, in order of first sight."""
    return scans.where(F.col("channel").between(low, high)).groupBy("channel").agg(F.min("seen_ms").alias("first_ms"))


def peers_with_last_seen(peers: DataFrame, seen: DataFrame) -> DataFrame:
    """Every peer; never heard: 0."""
    return peers.join(seen, "node_id", "left").select("node_id", F.coalesce("last_seen_ms", F.lit(0)).alias("last_seen_ms"))


def present(seen: DataFrame, now_ms: int, window_ms: int) -> DataFrame:
    """Nodes heard within the window."""
    return seen.where(S.seen_within(F.lit(now_ms), F.col("last_seen_ms"), window_ms))


def tile_nodes(nodes: DataFrame, tiles: DataFrame) -> DataFrame:
    """The nodes of the wanted tiles (tile), which are keyed by a node's id in 8 hex digits."""
    return nodes.withColumn("tile", S.node_key(F.col("node_id"))).join(tiles, "tile")


def insert_absent(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The new rows whose key isn't stored yet."""
    return new.join(stored.select(*keys).distinct(), keys, "left_anti")


def ordered_checksum(parts: DataFrame, keys: list[str], order: str, data: str, hot: int = HOT) -> DataFrame:
    """The seeded CRC-32 over each group's pieces in order; a group is one block, such as a node's hour.

    A group of more than ``hot`` pieces is cut into ranges, each with a checksum of its own, and those are put together.
    """
    seed = F.unhex(F.lit("FFFFFFFF"))
    joined = F.expr(f"listagg({data}, X'') WITHIN GROUP (ORDER BY {order})")
    cold, big = split(parts, keys, hot)
    whole = cold.groupBy(*keys).agg(F.crc32(F.concat(seed, joined)).alias("crc"))
    if big is None:
        return whole

    @F.pandas_udf("bigint")
    def together(ranges: pd.Series) -> pd.Series:
        start = zlib.crc32(b"\xff\xff\xff\xff")
        return ranges.map(lambda own: reduce(lambda crc, r: crc32_joined(crc, r["crc"], r["size"]), own, start))

    own = dealt(big, keys, [order], many(parts)).groupBy(*keys, PART).agg(joined.alias("bytes"))
    ranges = own.select(*keys, F.struct(F.col(PART).alias("part"), F.crc32("bytes").alias("crc"), F.length("bytes").cast("long").alias("size")).alias("r"))
    sums = ranges.groupBy(*keys).agg(F.sort_array(F.collect_list("r")).alias("rs"))  # a row a range
    return whole.unionByName(sums.select(*keys, together("rs").alias("crc")))


def newest_valid_slot(slots: DataFrame, keys: list[str]) -> DataFrame:
    """Of the slots whose checksums hold, the one of the highest sequence; none valid: no row."""
    rest = [c for c in slots.columns if c not in (*keys, "sequence", "valid")]
    best = slots.where("valid").groupBy(*keys).agg(F.max(F.struct("sequence", *rest)).alias("s"))
    return best.select(*keys, "s.*")


def row_crc(columns: list[str]) -> Column:
    """The CRC-32 of a row's columns by name; what is null is left out."""
    return F.crc32(F.to_json(F.struct(*sorted(columns))).cast("binary"))


def save_slot(table: DataFrame, path: str, sequence: int) -> None:
    """Append a table's rows to a stored one, each with the slot's sequence and a checksum."""
    rows = table.withColumn("sequence", F.lit(sequence).cast("long"))
    rows.withColumn("crc", row_crc(rows.columns)).write.mode("append").parquet(path)


def load_newest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Of each key's stored rows, the sound one of the highest sequence."""
    rows = spark.read.parquet(path)
    stored = [c for c in rows.columns if c != "crc"]
    return newest_valid_slot(rows.withColumn("valid", F.col("crc") == row_crc(stored)).drop("crc"), keys)
