"""Vectorised work on the UTF-8 buffers of Arrow string columns.

Word borders are the six ASCII whitespace bytes, so byte positions decide them exactly.
All functions take whole texts; ``slices`` only bounds how many bytes are held at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

U64 = np.uint64
#: Bytes that Spark hands to a Python worker at once, where the session has Spark's own default.
BATCH = 8 << 20
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` on batches of about BATCH bytes, so a worker's memory follows neither the rows' sizes nor their number."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key) == "67108864b":
        conf.set(key, str(BATCH))
    return df.mapInArrow(run, schema)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``most`` bytes; a longer text stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(raw: np.ndarray, offsets: np.ndarray, white: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, words before each text): byte borders of all words, in text order."""
    inside = ~white[raw]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    full = offsets[:-1][np.diff(offsets) > 0]
    before[full] = False
    after[full[1:] - 1] = False
    start = np.flatnonzero(inside & ~before)
    return start, np.flatnonzero(inside & ~after) + 1, np.searchsorted(start, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xD1B54A32D192ED03))


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, U64), np.full(n, pow(_BASE, -1, 1 << 64), U64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each byte range, from one prefix sum of a polynomial mod 2**64."""
    if not len(start):
        return np.zeros(0, U64)
    size = 1 << max(16, int(len(raw)).bit_length())
    up, down = _powers(size)
    total = np.zeros(len(raw) + 1, U64)
    np.cumsum((_BYTE[LOWER] if lower else _BYTE)[raw] * up[: len(raw)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(U64))


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first of each text) of all k-word shingles; a text of 1 to k-1 words gives one."""
    n = np.diff(first)
    counts = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    at = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(at[-1], U64)
    if not len(out):
        return out, at
    base = np.repeat(first[:-1] - at[:-1], counts) + np.arange(at[-1])
    left = np.repeat(first[1:], counts) - base
    step = 1
    for j in range(k):
        step = step * 0x2545F4914F6CDD1D % (1 << 64)
        ok = left > j
        out += np.where(ok, hashes[np.minimum(base + j, len(hashes) - 1)], U64(j + 7)) * U64(step)
    return mix(out), at
