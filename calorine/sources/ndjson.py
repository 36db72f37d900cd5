"""Newline-delimited JSON: lines, frames, envelopes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calorine.functions import scalar as S
from calorine.schemas import FRAME


def split_lines(df: DataFrame, text_col: str, *keep: str) -> DataFrame:
    """The lines of a text: ``\\n`` ends one, ``\\r`` is dropped, empty ones are ignored."""
    lines = F.split(F.regexp_replace(F.col(text_col), "\r", ""), "\n")
    return df.select(*keep, F.posexplode(lines).alias("line_no", "line")).where("line <> ''")


def route(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """S3: parse each line; corrupt ones go first, then a missing type means ``temps``.

    Adds ``frame`` (the parsed struct) and ``type``.
    """
    # A mistyped field nulls that field alone; only a line that is no JSON object is corrupt.
    whole = F.get_json_object(line_col, "$")
    parsed = lines.where(whole.isNotNull() & F.ltrim(F.col(line_col)).startswith("{"))
    return parsed.withColumn("frame", F.from_json(line_col, FRAME)).withColumn("type", F.coalesce("frame.type", F.lit("temps")))


def frames_to_samples(routed: DataFrame, from_col: str = "from", rx_col: str = "rx_ms") -> DataFrame:
    """One row a sensor element with an address of 16 characters.

    A missing node id is the envelope's sender, bus -1, seq 0, corr false; a missing or mistyped value keeps the
    element without a value, as does an implausible one.
    """
    temps = routed.where("type = 'temps'").select(
        F.coalesce("frame.nodeId", from_col).alias("node_id"),
        F.coalesce("frame.busGpio", F.lit(-1)).alias("bus_gpio"),
        F.coalesce("frame.seq", F.lit(0)).alias("seq"),
        F.col(rx_col).alias("rx_ms"),
        F.explode("frame.sensors").alias("s"),
    )
    t = F.when(S.plausible(F.col("s.tC")), F.col("s.tC"))
    return temps.where(S.whole_address(F.col("s.addr"))).select(
        "node_id", "bus_gpio", "seq", "rx_ms", F.upper("s.addr").alias("addr"), t.alias("temp_c"), t.isNotNull().alias("has_value"), F.coalesce("s.corr", F.lit(False)).alias("corrected")
    )


def to_frames(samples: DataFrame) -> DataFrame:
    """Readings as frame lines, one a (node, time): (from, rx_ms, line).  An implausible reading has no ``tC``."""
    sensor = F.struct("addr", F.when(S.plausible(F.col("temp_c")), F.col("temp_c")).alias("tC"), F.lit(False).alias("corr"))
    grouped = samples.groupBy("node_id", "rx_ms").agg(F.max("seq").alias("seq"), F.sort_array(F.collect_list(sensor)).alias("sensors"))
    frame = F.struct(F.lit("temps").alias("type"), F.col("node_id").alias("nodeId"), F.lit(4).alias("busGpio"), F.col("rx_ms").alias("uptimeMs"), "seq", "sensors")
    return grouped.select(F.col("node_id").alias("from"), "rx_ms", F.to_json(frame).alias("line"))


def wrap(frames: DataFrame) -> DataFrame:
    """The envelope line of each frame line."""
    head = F.concat(F.lit('{"type":"mesh_frame","from":'), F.col("from").cast("string"), F.lit(',"rxMs":'), F.col("rx_ms").cast("string"), F.lit(',"payload":'))
    return frames.select("from", "rx_ms", F.concat(head, F.col("line"), F.lit("}")).alias("envelope"))


def write_lines(df: DataFrame, path: str) -> None:
    """One document a line."""
    df.write.json(path)


def merge_config(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Fields that the new document omits keep their old values; keys of either side are kept."""
    fields = [c for c in old.columns if c != key]
    both = old.alias("o").join(new.alias("n"), key, "full")
    return both.select(key, *[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in fields])
