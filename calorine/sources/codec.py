"""The binary record formats: minute blocks, hourly and daily rollups, daily state, the hour journal, calibration.

One record is one binary value, so that records live in Parquet columns or in files of any store.  A block holds at
most 100 slots; blocks are built out of rows in their order and decoded few at a time.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calorine.functions.crc import crc16_rows
from calorine.operators.order import ranked

# Fixed values of the formats: magic numbers, header layouts (little-endian, naturally aligned), sentinels.
MINH, HROL, DROL, FRHJ, FRDS, CAL1 = 0x484E494D, 0x4C4F5248, 0x4C4F5244, 0x4A485246, 0x53445246, 0x43414C31
VERSION = 1
MINUTE_HEADER = struct.Struct("<IHHIIHHHHQIIII")
ROLLUP_HEADER = struct.Struct("<IHHIIHHIIII")
JOURNAL_HEADER = struct.Struct("<IHHIHHIB3xII")
STATE_HEADER = struct.Struct("<IHHIIHHIII32x")
STATE_ENTRY = struct.Struct("<I4xQqHhh2x")
CALIBRATION_HEADER = struct.Struct("<IHHI")
SLOT = np.dtype([("node", "<u4"), ("rom", "<u8")])
ROLLUP = np.dtype([("mean", "<i2"), ("min", "<i2"), ("max", "<i2"), ("count", "<u2")])
CAL_ENTRY = np.dtype([("addr", "u1", 8), ("a1", "<f4"), ("a0", "<f4")])
MISSING, MAX_SLOTS, MINUTES = -32768, 100, 60
#: Blocks that are decoded into rows at a time: 96,000 rows of minutes at most.
DECODED = 16


def seeded_crc(*parts: bytes) -> int:
    """The register starts at 0 rather than at all ones."""
    crc = 0xFFFFFFFF
    for p in parts:
        crc = zlib.crc32(p, crc)
    return crc


def frame_layout(n: int) -> tuple[int, int]:
    """(bytes of the padded presence bitmap, bytes of a frame) for n slots."""
    align = lambda x: -(-x // 4) * 4
    presence = align(-(-n // 8))
    return presence, align(presence + 2 * n + 2)


def pack_frames(present: np.ndarray, values: np.ndarray) -> bytes:
    """Frames of a (minutes, slots) matrix: bitmap (low bit first), values, CRC-16, padding."""
    n = present.shape[1]
    bitmap, size = frame_layout(n)
    out = np.zeros((len(present), size), np.uint8)
    bits = np.packbits(present, axis=1, bitorder="little")
    out[:, : bits.shape[1]] = bits
    out[:, bitmap : bitmap + 2 * n] = np.ascontiguousarray(values.astype("<i2")).view(np.uint8).reshape(len(present), -1)
    crc = crc16_rows(out[:, : bitmap + 2 * n])
    out[:, bitmap + 2 * n], out[:, bitmap + 2 * n + 1] = crc & 0xFF, crc >> 8
    return out.tobytes()


def unpack_frames(raw: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(present, values, whether each frame's CRC holds)."""
    bitmap, size = frame_layout(n)
    rows = np.frombuffer(raw, np.uint8).reshape(-1, size)
    present = np.unpackbits(rows[:, :bitmap], axis=1, bitorder="little")[:, :n].astype(bool)
    values = np.ascontiguousarray(rows[:, bitmap : bitmap + 2 * n]).view("<i2")
    stored = rows[:, bitmap + 2 * n].astype(np.uint32) | rows[:, bitmap + 2 * n + 1].astype(np.uint32) << 8
    return present, values, crc16_rows(rows[:, : bitmap + 2 * n]) == stored


def slots_bytes(nodes, addrs) -> bytes:
    out = np.zeros(len(nodes), SLOT)
    out["node"], out["rom"] = np.asarray(nodes, np.uint64), [int(a, 16) for a in addrs]
    return out.tobytes()


def _sealed(header: struct.Struct, *fields) -> bytes:
    """A header whose last field is the checksum of the header with 0 there."""
    empty = header.pack(*fields, 0)
    return header.pack(*fields, seeded_crc(empty))


def encode_minute_block(hour_min: int, nodes, addrs, present: np.ndarray, values: np.ndarray, bad_mask: int = 0) -> bytes:
    n = len(nodes)
    if not 1 <= n <= MAX_SLOTS:
        raise ValueError(f"a block has 1 to {MAX_SLOTS} slots, not {n}")
    slots, frames = slots_bytes(nodes, addrs), pack_frames(present, values)
    bitmap, size = frame_layout(n)
    head = _sealed(MINUTE_HEADER, MINH, VERSION, MINUTE_HEADER.size, MINUTE_HEADER.size + len(slots) + len(frames), hour_min, n, size, bitmap, 0, bad_mask, len(slots), len(frames), seeded_crc(slots, frames))
    return head + slots + frames


def encode_rollup_block(magic: int, start_min: int, nodes, addrs, mean, low, high, count) -> bytes:
    n = len(nodes)
    if not 1 <= n <= MAX_SLOTS:
        raise ValueError(f"a block has 1 to {MAX_SLOTS} slots, not {n}")
    body = np.zeros(n, ROLLUP)
    for name, column in (("mean", mean), ("min", low), ("max", high)):
        body[name] = [MISSING if pd.isna(v) else int(v) for v in column]
    body["count"] = np.asarray(count, np.int64)
    slots, rows = slots_bytes(nodes, addrs), body.tobytes()
    head = _sealed(ROLLUP_HEADER, magic, VERSION, ROLLUP_HEADER.size, ROLLUP_HEADER.size + len(slots) + len(rows), start_min, n, 0, len(slots), len(rows), seeded_crc(slots, rows))
    return head + slots + rows


def _header(record: bytes, header: struct.Struct, magics: tuple[int, ...]) -> tuple | None:
    """The fields of a sound header."""
    if len(record) < header.size:
        return None
    fields = header.unpack(record[: header.size])
    if fields[0] not in magics or fields[1] != VERSION or fields[2] != header.size or fields[-1] != seeded_crc(header.pack(*fields[:-1], 0)):
        return None
    return fields


def decode_minute_block(record: bytes):
    """(hour_min, slots, present, values, frame_ok, payload_ok), or None for an unsound header."""
    f = _header(record, MINUTE_HEADER, (MINH,))
    if f is None or len(record) < f[3] or not 1 <= f[5] <= MAX_SLOTS:
        return None
    a = MINUTE_HEADER.size
    slots, frames = record[a : a + f[10]], record[a + f[10] : a + f[10] + f[11]]
    return f[4], np.frombuffer(slots, SLOT), *unpack_frames(frames, f[5]), seeded_crc(slots, frames) == f[12]


def decode_rollup_block(record: bytes):
    """(magic, start_min, slots, rollups, payload_ok), or None for an unsound header."""
    f = _header(record, ROLLUP_HEADER, (HROL, DROL))
    if f is None or len(record) < f[3] or not 1 <= f[5] <= MAX_SLOTS:
        return None
    a = ROLLUP_HEADER.size
    slots, rows = record[a : a + f[7]], record[a + f[7] : a + f[7] + f[8]]
    return f[0], f[4], np.frombuffer(slots, SLOT), np.frombuffer(rows, ROLLUP), seeded_crc(slots, rows) == f[9]


def encode_daily_state(sequence: int, day_min: int, entries: list[tuple]) -> bytes:
    """Entries (node, addr, sum, count, min, max)."""
    body = b"".join(STATE_ENTRY.pack(n, int(a, 16), s, c, lo, hi) for n, a, s, c, lo, hi in entries)
    fields = (FRDS, VERSION, STATE_HEADER.size, sequence, day_min, len(entries), STATE_ENTRY.size, len(body), seeded_crc(body) if body else 0xFFFFFFFF)
    return STATE_HEADER.pack(*fields, seeded_crc(STATE_HEADER.pack(*fields, 0))) + body


def decode_daily_state(record: bytes):
    """(sequence, day_min, entries), or None if anything is unsound."""
    f = _header(record, STATE_HEADER, (FRDS,))
    if f is None:
        return None
    body = record[STATE_HEADER.size : STATE_HEADER.size + f[7]]
    if len(body) != f[7] or f[6] != STATE_ENTRY.size or f[5] * f[6] != f[7] or (seeded_crc(body) if body else 0xFFFFFFFF) != f[8]:
        return None
    return f[3], f[4], [(n, f"{r:016X}", s, c, lo, hi) for n, r, s, c, lo, hi in STATE_ENTRY.iter_unpack(body)]


def newest_slot(a: bytes, b: bytes):
    """The sound slot of the higher sequence."""
    sound = [s for s in map(decode_daily_state, (a, b)) if s]
    return max(sound, key=lambda s: s[0], default=None)


def encode_journal_header(sequence: int, n: int, hour_min: int, written: int, last_minute: int) -> bytes:
    """S12."""
    return _sealed(JOURNAL_HEADER, FRHJ, VERSION, JOURNAL_HEADER.size, sequence, n, frame_layout(n)[1], hour_min, written, last_minute)


def decode_journal_header(record: bytes):
    """(sequence, slots, hour_min, minutes written, last minute), or None; F8: at most 60 minutes, an hour that isn't 0."""
    f = _header(record, JOURNAL_HEADER, (FRHJ,))
    if f is None or f[7] > MINUTES or f[6] == 0 or f[5] != frame_layout(f[4])[1]:
        return None
    return f[3], f[4], f[6], f[7], f[8]


def journal_headers(rows: DataFrame) -> DataFrame:
    """Adds ``record``, the header of an hour journal (sequence, slots, hour_min, minutes, last_minute)."""

    @F.pandas_udf("binary")
    def encode(sequence: pd.Series, slots: pd.Series, hour: pd.Series, minutes: pd.Series, last: pd.Series) -> pd.Series:
        return pd.Series([encode_journal_header(*map(int, row)) for row in zip(sequence, slots, hour, minutes, last)], dtype=object)

    return rows.withColumn("record", encode("sequence", "slots", "hour_min", "minutes", "last_minute"))


def read_journal(journals: DataFrame) -> DataFrame:
    """(sequence, slots, hour_min, minutes, last_minute) of the sound headers (record)."""

    @F.pandas_udf("sequence bigint, slots bigint, hour_min bigint, minutes bigint, last_minute bigint")
    def decode(records: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decode_journal_header(bytes(r)) for r in records], columns=["sequence", "slots", "hour_min", "minutes", "last_minute"])

    return journals.where(sane_header(F.col("record"))).select(decode("record").alias("j")).select("j.*")


def sane_header(record: Column) -> Column:
    """F8: whether a journal header's magic, version, sizes and checksum hold, with at most 60 minutes and an hour that isn't 0; false for null."""

    @F.pandas_udf("boolean")
    def check(records: pd.Series) -> pd.Series:
        return records.map(lambda r: r is not None and decode_journal_header(bytes(r)) is not None).astype(bool)

    return check(record)


def encode_calibration(entries: list[tuple[str, float, float]]) -> bytes:
    """Addresses that aren't 16 hex digits are skipped; the checksum is the plain one."""
    good = [(bytes.fromhex(a), a1, a0) for a, a1, a0 in entries if len(a) == 16 and all(c in "0123456789abcdefABCDEF" for c in a)]
    body = np.zeros(len(good), CAL_ENTRY)
    for i, (a, a1, a0) in enumerate(good):
        body[i] = (np.frombuffer(a, np.uint8), a1, a0)
    return CALIBRATION_HEADER.pack(CAL1, VERSION, len(good), zlib.crc32(body.tobytes())) + body.tobytes()


def decode_calibration(record: bytes):
    """Entries, or None if the magic, version, size or checksum is wrong."""
    if len(record) < CALIBRATION_HEADER.size:
        return None
    magic, version, n, crc = CALIBRATION_HEADER.unpack(record[: CALIBRATION_HEADER.size])
    body = record[CALIBRATION_HEADER.size :]
    if magic != CAL1 or version != VERSION or len(body) != n * CAL_ENTRY.itemsize or zlib.crc32(body) != crc:
        return None
    return [(bytes(e["addr"]).hex().upper(), float(e["a1"]), float(e["a0"])) for e in np.frombuffer(body, CAL_ENTRY)]


def blocked(df: DataFrame, *keys: str) -> DataFrame:
    """Adds ``slot`` (place among the key's rows by (node_id, addr)) and ``block`` (of 100 slots) to rows, one a key and sensor.

    The rows themselves are dealt and counted, so their plan runs once.
    """
    return ranked(df, list(keys), ["node_id", "addr"], "slot").withColumn("block", F.floor(F.col("slot") / MAX_SLOTS).cast("int"))


def sensor_hours(grid: DataFrame) -> DataFrame:
    """(hour_min, node_id, addr, minutes): a row an hour and sensor, with its at most 60 minutes (minute, present, centi).

    A minute grid is dealt by (sensor, hour) already: no further shuffle.
    """
    minute = F.pmod("epoch_minute", F.lit(60))
    rows = grid.select("node_id", "addr", (F.col("epoch_minute") - minute).alias("hour_min"), F.struct(minute.cast("int").alias("minute"), "present", "centi").alias("cell"))
    return rows.groupBy("node_id", "addr", "hour_min").agg(F.collect_list("cell").alias("minutes"))


def _in_blocks(rows: DataFrame, start: str) -> DataFrame:
    """A block's rows in one partition, one after the other in order of slots."""
    return rows.repartition(start, "block").sortWithinPartitions(start, "block", "slot")


def _whole_blocks(stream: Iterator[pa.RecordBatch], start: str) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int]]]]:
    """(rows, where each of their blocks begins and ends) of rows in order of blocks: a batch's last block waits for the rest of it.

    So Python holds one batch of sensors, however many blocks a task has.
    """
    held = None
    for batch in stream:
        if not batch.num_rows:
            continue
        rows = batch if held is None else pa.concat_batches([held, batch])
        starts, blocks = rows.column(start).to_numpy(), rows.column("block").to_numpy()
        edges = [0, *(np.flatnonzero((np.diff(starts) != 0) | (np.diff(blocks) != 0)) + 1).tolist()]
        if len(edges) > 1:
            yield rows, list(zip(edges, edges[1:]))
        held = rows.slice(edges[-1])
    if held is not None:
        yield held, [(0, held.num_rows)]


def _records(rows: pa.RecordBatch, bounds: list[tuple[int, int]], columns: list[str], records: list[bytes], **more: pa.Array) -> pa.RecordBatch:
    """A row a block: key columns, those of ``more`` and the record."""
    first = rows.select(columns).take(pa.array([a for a, _ in bounds], pa.int64()))
    return pa.RecordBatch.from_arrays([*first.columns, *more.values(), pa.array(records, pa.binary())], names=[*columns, *more, "record"])


def minute_blocks(grid: DataFrame) -> DataFrame:
    """(hour_min, block, sensors, record) of a minute grid (node_id, addr, epoch_minute, hour_min, present, centi).

    A minute without a row is a missing frame: no presence, sentinel values.  Python meets batches of sensors with the hour's minutes
    of each, in order of blocks.
    """

    def encode(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in _whole_blocks(stream, "hour_min"):
            hours, nodes, addrs = (rows.column(c).to_pylist() for c in ("hour_min", "node_id", "addr"))
            lists = rows.column("minutes")
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            cells = lists.flatten()
            minute, there, centi = cells.field("minute").to_numpy(), cells.field("present").to_numpy(zero_copy_only=False), cells.field("centi").fill_null(MISSING).to_numpy()
            slot = np.repeat(np.arange(rows.num_rows), np.diff(ends))
            records = []
            for a, b in bounds:
                own = slice(ends[a], ends[b])
                present, values = np.zeros((MINUTES, b - a), bool), np.full((MINUTES, b - a), MISSING, np.int64)
                present[minute[own], slot[own] - a], values[minute[own], slot[own] - a] = there[own], centi[own]
                records.append(encode_minute_block(hours[a], nodes[a:b], addrs[a:b], present, values))
            yield _records(rows, bounds, ["hour_min", "block"], records, sensors=pa.array([b - a for a, b in bounds], pa.int32()))

    rows = _in_blocks(blocked(sensor_hours(grid), "hour_min"), "hour_min")
    return rows.mapInArrow(encode, "hour_min bigint, block int, sensors int, record binary")


def rollup_blocks(rollups: DataFrame, start_col: str, daily: bool = False) -> DataFrame:
    """(start_min, block, record) of hourly or daily rollups; ``start_col`` is an epoch minute."""
    magic = DROL if daily else HROL
    names = ("node_id", "addr", "mean_centi", "min_centi", "max_centi", "sample_count")

    def encode(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in _whole_blocks(stream, "start_min"):
            starts, *columns = (rows.column(c).to_pylist() for c in ("start_min", *names))
            records = [encode_rollup_block(magic, starts[a], *(c[a:b] for c in columns)) for a, b in bounds]
            yield _records(rows, bounds, ["start_min", "block"], records)

    rows = _in_blocks(blocked(rollups.select(F.col(start_col).alias("start_min"), *names), "start_min"), "start_min")
    return rows.mapInArrow(encode, "start_min bigint, block int, record binary")


def _few(stream: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """The records of batches, ``DECODED`` at a time."""
    for batch in stream:
        for part in range(0, batch.num_rows, DECODED):
            yield batch.column("record").slice(part, DECODED).to_pylist()


def _addresses(roms: np.ndarray) -> list[str]:
    return [f"{r:016X}" for r in roms.tolist()]


def _nullable(values: np.ndarray, gone: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.int32), mask=gone)


def decode_minutes(blocks: DataFrame, present_only: bool = False) -> DataFrame:
    """(node_id, addr, epoch_minute, present, centi, frame_ok) of sound blocks; a bad frame is missing.

    ``present_only``: without what is missing, which is most of a sparse block.
    """

    def decode(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for records in _few(stream):
            parts, addrs = [], []
            for record in records:
                got = decode_minute_block(record)
                if got is None or not got[5]:
                    continue
                hour, slots, present, values, ok, _ = got
                cells = np.flatnonzero(present & ok[:, None]) if present_only else np.arange(present.size)
                minute, slot = np.divmod(cells, len(slots))
                parts.append((slots["node"][slot].astype(np.int64), slot + len(addrs), hour + minute, present.ravel()[cells], values.ravel()[cells], ok[minute]))
                addrs += _addresses(slots["rom"])
            if parts:
                node, slot, minute, present, values, ok = (np.concatenate(c) for c in zip(*parts))
                columns = {"node_id": node, "addr": pa.array(addrs, pa.string()).take(pa.array(slot)), "epoch_minute": minute, "present": present & ok, "centi": _nullable(values, (values == MISSING) | ~ok), "frame_ok": ok}
                yield pa.RecordBatch.from_pydict(columns)

    return blocks.select("record").mapInArrow(decode, "node_id bigint, addr string, epoch_minute bigint, present boolean, centi int, frame_ok boolean")


def read_frames(blocks: DataFrame, minute: int | None = None) -> DataFrame:
    """What is present in every frame of every sound block, or in the frame of one epoch minute."""
    if minute is None:
        return decode_minutes(blocks, present_only=True)
    return decode_minutes(blocks.where(F.col("hour_min") == minute - minute % MINUTES), present_only=True).where(F.col("epoch_minute") == minute)


def frame_hours(blocks: DataFrame) -> DataFrame:
    """(node_id, addr, hour_min, frames, missing, present_mask) of sound blocks: a row a slot, not one a frame.

    Bit m of ``present_mask`` tells whether the slot is present in the frame of minute m; a bad frame is missing.
    """

    def decode(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for records in _few(stream):
            parts = []
            for record in records:
                got = decode_minute_block(record)
                if got is None or not got[5]:
                    continue
                hour, slots, present, _, ok, _ = got
                there = present & ok[:, None]
                mask = np.bitwise_or.reduce(there.astype(np.int64) << np.arange(len(ok))[:, None], axis=0)
                parts.append((slots, np.full(len(slots), hour, np.int64), np.full(len(slots), len(ok), np.int64), len(ok) - there.sum(axis=0), mask))
            if parts:
                slots, hour, frames, missing, mask = (np.concatenate(c) for c in zip(*parts))
                yield pa.RecordBatch.from_pydict({"node_id": slots["node"].astype(np.int64), "addr": pa.array(_addresses(slots["rom"]), pa.string()), "hour_min": hour, "frames": frames, "missing": missing, "present_mask": mask})

    return blocks.select("record").mapInArrow(decode, "node_id bigint, addr string, hour_min bigint, frames bigint, missing bigint, present_mask bigint")


def decode_rollups(blocks: DataFrame) -> DataFrame:
    """(node_id, addr, start_min, mean_centi, min_centi, max_centi, sample_count); bad payloads are skipped."""

    def decode(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for records in _few(stream):
            parts = []
            for record in records:
                got = decode_rollup_block(record)
                if got is not None and got[4]:
                    _, start, slots, rows, _ = got
                    parts.append((slots, np.full(len(slots), start, np.int64), rows))
            if parts:
                slots, start, rows = (np.concatenate(c) for c in zip(*parts))
                out = {"node_id": slots["node"].astype(np.int64), "addr": pa.array(_addresses(slots["rom"]), pa.string()), "start_min": start}
                for name in ("mean", "min", "max"):
                    out[f"{name}_centi"] = _nullable(rows[name], rows[name] == MISSING)
                out["sample_count"] = rows["count"].astype(np.int32)
                yield pa.RecordBatch.from_pydict(out)

    return blocks.select("record").mapInArrow(decode, "node_id bigint, addr string, start_min bigint, mean_centi int, min_centi int, max_centi int, sample_count int")


def verify(blocks: DataFrame) -> DataFrame:
    """Adds ``header_ok`` and ``payload_ok`` to rows with a ``record``."""

    @F.pandas_udf("header_ok boolean, payload_ok boolean")
    def check(records: pd.Series) -> pd.DataFrame:
        found = []
        for r in records:
            r = bytes(r)
            minute = r[:4] == struct.pack("<I", MINH)
            got = decode_minute_block(r) if minute else decode_rollup_block(r)
            found.append((got is not None, got is not None and bool(got[5] if minute else got[4])))
        return pd.DataFrame(found, columns=["header_ok", "payload_ok"])

    return blocks.withColumn("check", check("record")).select("*", "check.*").drop("check")


def write_tier(rollups: DataFrame, path: str, part: str, order: str) -> None:
    """A tier as Parquet, a folder for each value of ``part`` (a date, month or year), each in files by ranges of
    ``order``, sorted inside, so that folders, files and row groups are pruned and no task writes a whole folder."""
    rollups.repartitionByRange(part, order).sortWithinPartitions(part, order, "node_id", "addr").write.partitionBy(part).mode("append").parquet(path)


def write_blocks(blocks: DataFrame, path: str) -> None:
    """Minute blocks as Parquet, a folder for each day (UTC)."""
    day = F.date_format(F.timestamp_seconds(F.col("hour_min") * 60), "yyyyMMdd")
    blocks.withColumn("day", day).write.partitionBy("day").mode("append").parquet(path)


def scan_tier(spark, path: str, part: str, order: str, start: int, end: int, first_part: str, last_part: str) -> DataFrame:
    """Rows of [start, end): folders are pruned by ``part``, row groups by ``order``."""
    rows = spark.read.parquet(path)
    return rows.where(F.col(part).cast("string").between(first_part, last_part) & (F.col(order) >= start) & (F.col(order) < end))
