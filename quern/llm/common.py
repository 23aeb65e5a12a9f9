"""Helpers that the operators of this subpackage share: batches, hashes over byte slices, wide codecs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that one step of a vectorised operator holds at once; a longer text makes a step of its own, within which
#: arrays of more than a byte for each byte of text are made in parts of this size.
SLICE_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_BLOCK = 1 << 16


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One contiguous string array with 32-bit offsets; nulls become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.string()), "")


def slices(n_bytes: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``limit`` bytes together, or of one row."""
    ends = np.cumsum(n_bytes)
    i, n = 0, len(n_bytes)
    while i < n:
        before = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield i, j
        i = j


def buffer_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and its offsets into them (first offset 0)."""
    if not len(text):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = text.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, offsets - offsets[0]


@cache
def _powers(base: int) -> np.ndarray:
    """The first powers of an odd number modulo 2**64; all others are products of two, so this is all that is kept."""
    steps = np.full(_BLOCK, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def _power(base: int, exponents: np.ndarray) -> np.ndarray:
    high = _powers(pow(base, _BLOCK, 1 << 64))
    return _powers(base)[exponents & (_BLOCK - 1)] * high[exponents >> 16]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums of values, each times its place's power of the base, up to each place."""
    sums = np.zeros(len(values) + 1, np.uint64)
    for i in range(0, len(values), _BLOCK):
        part = values[i : i + _BLOCK].astype(np.uint64) + np.uint64(1)
        part *= _powers(_BASE)[: len(part)] * np.uint64(pow(_BASE, i, 1 << 64))
        np.cumsum(part, out=part)
        sums[i + 1 : i + 1 + len(part)] = part + sums[i]
    return sums


def shifted_back(sums: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Differences of prefix sums made independent of where they start."""
    return sums * _power(pow(_BASE, -1, 1 << 64), starts)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[start:end], equal for equal spans wherever they stand."""
    sums = prefix_sums(values)
    return mix(shifted_back(sums[ends] - sums[starts], starts) + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """span_hashes of sorted spans that don't overlap, some of a long text at a time."""
    at = np.unique(np.concatenate((np.searchsorted(starts, np.arange(0, len(part), SLICE_BYTES)), [len(starts)])))
    each = zip(at[:-1].tolist(), at[1:].tolist(), strict=True)
    parts = [span_hashes(part[starts[i] : ends[j - 1]], starts[i:j] - starts[i], ends[i:j] - starts[i]) for i, j in each]
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from its flattened values and the length of each list."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of each of many ranges, one after the other."""
    total = int(counts.sum())
    if not total:
        return np.empty(0, np.int64)
    before = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) + np.repeat(starts.astype(np.int64) - before, counts)


def salted_join(rows: DataFrame, few: DataFrame, key: str, how: str = "inner", by: list[str] | None = None, salts: int = 16) -> DataFrame:
    """rows joined with few (a row a key), of which each goes to ``salts`` places, so that a key's rows meet it there, dealt
    by a hash of their columns by (all, if not given)."""
    left = rows.withColumn("__q_salt", F.pmod(F.xxhash64(*(by or rows.columns)), F.lit(salts)).cast("int"))
    right = few.withColumn("__q_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, "__q_salt"], how).drop("__q_salt")


#: Keys that hold at least one of so many rows; there are at most as many of them, so they may be sent to all tasks.
SHARE = 4_096


def parted_join(rows: DataFrame, few: DataFrame, key: str, number: str) -> DataFrame:
    """rows joined with few (a row a key, number: the key's rows), which should be a stored table. The keys of a
    ``SHARE``-th of all rows or more meet their rows where these are; only the others are shuffled, so no task gets more."""
    total = few.agg(F.sum(number).alias("__q_total"))  # one row
    marked = few.crossJoin(F.broadcast(total)).withColumn("__q_hot", F.col(number) * SHARE >= F.col("__q_total")).drop("__q_total")
    hot, rest = F.broadcast(marked.filter("__q_hot").drop("__q_hot")), marked.filter("not __q_hot").drop("__q_hot")
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(rest, key))
