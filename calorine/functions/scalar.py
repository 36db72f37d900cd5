"""Scalar expressions and predicates over telemetry columns.  All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the telemetry format and of physics.
MISSING_CENTI = -32768
IDENTITY_EPS = 1e-6
PRESSURE_LAPSE, PRESSURE_EXPONENT, METRES_PER_FOOT = 2.25577e-5, 5.25588, 0.3048
ANTOINE_A, ANTOINE_B, ANTOINE_C, MM_PER_INCH = 8.07131, 1730.63, 233.426, 25.4
UNSET_RANK = 2147483647
VALID_EPOCH = 1_700_000_000
STALE_MS = 180_000
HAS_EPOCH, HAS_VALUE, CORRECTED = 1, 2, 4
WIFI_STATUS = {0: "IDLE", 1: "NO_SSID", 2: "SCAN_DONE", 3: "CONNECTED", 4: "CONNECT_FAILED", 5: "CONNECTION_LOST", 6: "DISCONNECTED"}
WRAP = 1 << 32


def is_identity(a1: Column, a0: Column) -> Column:
    """Coefficients that change nothing."""
    return (F.abs(a1 - 1) < IDENTITY_EPS) & (F.abs(a0) < IDENTITY_EPS)


def calibrated(t: Column, a1: Column, a0: Column) -> Column:
    """a1*t + a0; without coefficients the value itself."""
    return F.coalesce((a1 * t + a0).cast("float"), t)


def station_pressure(sea_level: Column, feet: Column) -> Column:
    """Pressure (inHg) at an elevation; null for a non-positive pressure or base."""
    base = 1 - PRESSURE_LAPSE * F.greatest(feet.cast("double"), F.lit(0.0)) * METRES_PER_FOOT
    return F.when((sea_level > 0) & (base > 0), sea_level * F.pow(base, F.lit(PRESSURE_EXPONENT)))


def boiling_point(inches: Column) -> Column:
    """P5: boiling point of water in deg C (Antoine); null for a non-positive pressure."""
    return F.when(inches > 0, F.lit(ANTOINE_B) / (ANTOINE_A - F.log10(inches * MM_PER_INCH)) - ANTOINE_C)


def boiling_point_at(inches: Column, feet: Column) -> Column:
    """P4 then P5 where an elevation is given."""
    return boiling_point(F.when(feet != 0, station_pressure(inches, feet)).otherwise(inches))


def fahrenheit(t: Column) -> Column:
    """P7."""
    return t.cast("double") * 1.8 + 32.0


def display(t: Column, unit: str) -> Column:
    """One decimal (half away from zero) with the unit; ``--`` when missing."""
    tenths = F.round(t.cast("double") * 10).cast("long")
    whole, part = F.floor(F.abs(tenths) / 10).cast("string"), F.pmod(F.abs(tenths), F.lit(10)).cast("string")
    return F.when(t.isNull() | F.isnan(t), F.lit("--")).otherwise(F.concat(F.when(tenths < 0, "-").otherwise(""), whole, F.lit("."), part, F.lit(unit)))


def in_range(t: Column) -> Column:
    """strictly within 300 degrees of zero."""
    return (t > -300) & (t < 300)


def centi(t: Column) -> Column:
    """Hundredths of a degree, multiplied in single precision, half away from zero; null outside F4."""
    return F.when(in_range(t), F.round(t.cast("float") * F.lit(100).cast("float")).cast("int"))


def parse_hex16(text: Column) -> Column:
    """A 16-digit hex address in upper case; null for anything else."""
    return F.when(text.rlike("^[0-9A-Fa-f]{16}$"), F.upper(text))


def hex_to_number(text: Column) -> Column:
    """The unsigned value of a hex address."""
    return F.conv(parse_hex16(text), 16, 10).cast("decimal(20,0)")


def node_key(node_id: Column) -> Column:
    """P10: a node id as 8 upper-case hex digits."""
    return F.lpad(F.hex(node_id), 8, "0")


def effective_rank(node_rank: Column, global_rank: Column) -> Column:
    """P11."""
    return F.coalesce(node_rank, global_rank, F.lit(UNSET_RANK))


def age_minutes(now_ms: Column, *seen_ms: Column) -> Column:
    """Whole minutes since the latest time seen; 0 if never or in the future."""
    latest = F.greatest(*seen_ms) if len(seen_ms) > 1 else seen_ms[0]
    return F.when(latest.isNull() | (latest > now_ms), F.lit(0)).otherwise(F.floor((now_ms - latest) / 60000)).cast("long")


def millis_to_epoch(ms: Column, anchor_ms: Column, anchor_epoch: Column) -> Column:
    """Epoch seconds of a 32-bit millisecond counter.

    Ahead of the anchor: add.  Behind it by more than half the counter's range: it wrapped, add.  Else: before, subtract.
    Seconds are cut toward zero.
    """
    ahead = ms - anchor_ms
    wrapped = F.pmod(ahead, F.lit(WRAP))
    seconds = lambda d: F.floor(d / 1000).cast("long")
    return F.when(ahead >= 0, anchor_epoch + seconds(ahead)).when(-ahead > (1 << 31), anchor_epoch + seconds(wrapped)).otherwise(anchor_epoch - seconds(-ahead))


def minute_of(ms: Column) -> Column:
    """Epoch minute of epoch milliseconds."""
    return F.floor(ms / 60000).cast("long")


def hour_start(minute: Column) -> Column:
    """First epoch minute of the UTC hour."""
    return minute - F.pmod(minute, F.lit(60))


def local_day(minute: Column, zone: str | Column) -> Column:
    """The local date of an epoch minute; days begin at local midnight, also across clock changes."""
    return F.to_date(F.from_utc_timestamp(F.timestamp_seconds(minute * 60), zone))


def local_day_start(minute: Column, zone: str) -> Column:
    """The epoch minute of the local midnight before."""
    midnight = F.to_utc_timestamp(F.date_trunc("day", F.from_utc_timestamp(F.timestamp_seconds(minute * 60), zone)), zone)
    return F.floor(F.unix_seconds(midnight) / 60).cast("long")


def zone_text(minutes: Column, dst: Column | None = None) -> Column:
    """+HH:MM of an offset in minutes; daylight saving adds an hour."""
    total = minutes + (F.when(dst, 60).otherwise(0) if dst is not None else 0)
    two = lambda x: F.lpad(x.cast("int").cast("string"), 2, "0")
    return F.concat(F.when(total < 0, "-").otherwise("+"), two(F.floor(F.abs(total) / 60)), F.lit(":"), two(F.pmod(F.abs(total), F.lit(60))))


def pack_flags(has_epoch: Column, has_value: Column, corrected: Column) -> Column:
    """P16."""
    bit = lambda c, v: F.when(c, v).otherwise(0)
    return (bit(has_epoch, HAS_EPOCH) + bit(has_value, HAS_VALUE) + bit(corrected, CORRECTED)).cast("int")


def has_flag(flags: Column, flag: int) -> Column:
    """P16."""
    return flags.bitwiseAND(flag) != 0


def presence_bit(bitmap: Column, slot: Column) -> Column:
    """Bit ``slot`` of a binary bitmap, low bit first."""
    byte = F.conv(F.hex(F.call_function("substring", bitmap, (F.floor(slot / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.call_function("getbit", byte, F.pmod(slot, F.lit(8)).cast("int")) == 1


def crc32_seeded(data: Column) -> Column:
    """The block checksum, whose register starts at 0: a plain CRC-32 behind four bytes of ones."""
    return F.crc32(F.concat(F.unhex(F.lit("FFFFFFFF")), data.cast("binary")))


def raw_tail(line: Column) -> Column:
    """Everything after the second token, trimmed; null if nothing is left."""
    tail = F.trim(F.regexp_extract(line, r"^\s*\S+\s+\S+\s+(.*)$", 1))
    return F.when(tail != "", tail)


def short_id(addr: Column) -> Column:
    """The last four digits."""
    return F.right(addr, F.lit(4))


def wifi_status(code: Column) -> Column:
    """P24."""
    names = F.create_map(*[x for k, v in WIFI_STATUS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(names, code.cast("int")), F.lit("UNKNOWN"))


def local_time_text(epoch: Column, zone: str) -> Column:
    """P25."""
    return F.date_format(F.from_utc_timestamp(F.timestamp_seconds(epoch), zone), "yyyy-MM-dd HH:mm:ss")


def ring_capacity(retention_days: Column, interval_ms: Column) -> Column:
    """Samples that a retention holds; at least 1, or 0 for interval 0."""
    return F.when(interval_ms == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(retention_days * 86_400_000 / interval_ms))).cast("long")


def plausible(t: Column) -> Column:
    """a raw reading that is not the probe's disconnect code."""
    return t.isNotNull() & ~F.isnan(t) & (t > -100)


def whole_address(addr: Column) -> Column:
    """F2."""
    return F.length(addr) == 16


def fresh(now_ms: Column, last_ms: Column, has_value: Column, stale_ms: int = STALE_MS) -> Column:
    """has a value, not from the future, and no older than the horizon."""
    return has_value & (now_ms >= last_ms) & (now_ms - last_ms <= stale_ms)


def rollup_valid(mean: Column, count: Column) -> Column:
    """F6."""
    return (count > 0) & mean.isNotNull() & (mean != MISSING_CENTI)


def half_open(value: Column, start, end) -> Column:
    """F7."""
    return (value >= start) & (value < end)


def valid_time(epoch: Column) -> Column:
    """F9."""
    return epoch >= VALID_EPOCH


def seen_within(now_ms: Column, seen_ms: Column, window_ms: int) -> Column:
    """F11."""
    return seen_ms.isNotNull() & (now_ms - seen_ms < window_ms)


def backoff(initial_ms: int, attempts: Column, most_ms: int) -> Column:
    """Doubling up to a cap."""
    return F.least(F.lit(float(initial_ms)) * F.pow(F.lit(2.0), attempts), F.lit(float(most_ms))).cast("long")


def linear_map(x: Column, low_in: int, high_in: int, low_out: int, high_out: int) -> Column:
    """L3: map a range onto another, clamped, whole numbers cut toward zero."""
    inside = (F.least(F.greatest(x, F.lit(low_in)), F.lit(high_in)) - low_in) * (high_out - low_out) / (high_in - low_in)
    return inside.cast("long") + low_out


def json_field(document: Column, name: str, kind: str, default) -> Column:
    """A field of a JSON text in the given type; the default where it is absent, null or of another type."""
    return F.coalesce(F.get_json_object(document, f"$.{name}").try_cast(kind), F.lit(default))


def same_address(a: Column, b) -> Column:
    """exact match, case and all."""
    return a == b
