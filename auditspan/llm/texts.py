"""Texts of an Arrow batch as flat numpy arrays: words, hashes and n-grams.

These helpers run inside Spark tasks on a small slice of rows at a time
(:func:`map_texts`), so memory does not depend on the size of a partition.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SLICE_BYTES = 1 << 20
SPACE = (0x20, *range(0x09, 0x0E))
MULTIPLIER = 0x9E3779B97F4A7C15


def non_space() -> np.ndarray:
    """Bytes that belong to a word when words are runs of anything but white space."""
    table = np.ones(256, bool)
    table[list(SPACE)] = False
    return table


def alphanumeric() -> np.ndarray:
    """Bytes of lower-case ASCII letters, digits and everything beyond ASCII."""
    table = np.zeros(256, bool)
    table[0x30:0x3A] = table[0x61:0x7B] = table[0x80:] = True
    return table


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows one after the other, and where each row starts (one more
    than rows). A null row is empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, bounds, data = column.buffers()
    if len(column) == 0 or bounds is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    kind = np.int64 if wide else np.int32
    starts = np.frombuffer(bounds, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    if data is None or starts[-1] == starts[0]:
        return np.zeros(0, np.uint8), starts - starts[0]
    return np.frombuffer(data, np.uint8)[starts[0]:starts[-1]], starts - starts[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """Row slices of about *limit* text bytes; a longer row is a slice of its own."""
    _, starts = flat(batch.column(column))
    first, rows = 0, batch.num_rows
    while first < rows:
        stop = max(first + 1, int(np.searchsorted(starts, starts[first] + limit, "right")) - 1)
        yield batch.slice(first, min(stop, rows) - first)
        first = min(stop, rows)


def map_texts(df: DataFrame, fn, schema: str, column: str = "text") -> DataFrame:
    """*fn* (record batch -> record batch) over slices of bounded text size."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, column):
                yield fn(part)
    return df.mapInArrow(run, schema)


def runs(data: np.ndarray, starts: np.ndarray, table: np.ndarray):
    """(first byte, end, row) of every maximal run of bytes that *table* marks; runs
    never cross rows."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = table[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    cuts = starts[1:-1]
    before[cuts[cuts < len(data)]] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[cuts[cuts > 0] - 1] = False
    first = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return first, end, np.searchsorted(starts, first, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """64-bit hashes of any substrings of *data* from one prefix sum."""

    def __init__(self, data: np.ndarray, multiplier: int = MULTIPLIER):
        n = len(data) + 1
        powers = np.full(n, multiplier, np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        inverse = np.full(n, pow(multiplier, -1, 1 << 64), np.uint64)
        inverse[0] = 1
        self.inverse = np.multiply.accumulate(inverse)
        self.prefix = np.zeros(n, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=self.prefix[1:])

    def of(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[first]) * self.inverse[first])


def grams(hashes: np.ndarray, rows: np.ndarray, n: int):
    """(hash, index of the first word) of all runs of *n* words inside one row."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = hashes[:count].copy()
    for k in range(1, n):
        out *= np.uint64(MULTIPLIER)
        out += hashes[k:k + count]
    at = np.flatnonzero(rows[:count] == rows[n - 1:])
    return mix(out[at]), at


def record(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names.split())


def text_key() -> list[Column]:
    """Two 64-bit hashes of the whole text; null and empty differ."""
    return [F.xxhash64("text").alias("_k1"),
            F.xxhash64(F.lit(7), F.md5(F.col("text").cast("binary"))).alias("_k2")]
