"""Checksums without a built-in expression."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType


@lru_cache(maxsize=1)
def _table() -> np.ndarray:
    """CRC of each byte: polynomial 0x1021, highest bit first."""
    out = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        out = np.where(out & 0x8000, out << 1 ^ 0x1021, out << 1) & 0xFFFF
    return out


def crc16_rows(rows: np.ndarray) -> np.ndarray:
    """CRC-16 (start 0xFFFF) of each row of a byte matrix, all rows in step."""
    table, crc = _table(), np.full(len(rows), 0xFFFF, np.uint32)
    for column in rows.T:
        crc = (crc << 8 & 0xFFFF) ^ table[(crc >> 8 ^ column) & 0xFF]
    return crc


def crc16_bytes(data: bytes) -> int:
    return int(crc16_rows(np.frombuffer(data, np.uint8).reshape(1, -1))[0])


def _crc16_batch(data: pd.Series) -> pd.Series:
    out = pd.Series([None] * len(data), dtype="Int32", index=data.index)
    whole = data.dropna()
    for size, part in whole.groupby(whole.map(len)):
        rows = np.frombuffer(b"".join(map(bytes, part)), np.uint8).reshape(len(part), size)
        out.loc[part.index] = crc16_rows(rows).astype(np.int32)
    return out


def crc16(data: Column) -> Column:
    """P18, in Arrow batches: rows of one length are taken together.  Null for null."""
    return F.pandas_udf(_crc16_batch, IntegerType())(data)


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo the CRC-32's; the highest bit is the constant term."""
    out = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            out ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


def crc32_joined(first: int, second: int, size: int) -> int:
    """The CRC-32 of two byte strings end to end, from that of each and the second's size: the first's times x to the power of its bits."""
    power, base, bits = 1 << 31, 1 << 30, 8 * size
    while bits:
        if bits & 1:
            power = _times(power, base)
        base, bits = _times(base, base), bits >> 1
    return _times(power, first) ^ second
