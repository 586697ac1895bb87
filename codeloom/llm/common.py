"""Helpers shared by the operators of this package: tables, Arrow slices, word scans."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.session import few, run_folder, ship_package, stage

SLICE_BYTES = 1 << 20  # text bytes that one step of vectorised work holds
ARROW_BYTES = 4 << 20  # of an Arrow batch, on its way to a worker
_ARROW_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
ASCII_SPACE = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: one evaluation, no lineage to lose."""
    return stage(df, run_folder(df.sparkSession, name))


def trim() -> None:
    """Give what a task has freed back to the system: its worker lives on beside later tasks, and other workers beside it."""
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if give is not None:
        give(0)


def over_arrow(df: DataFrame, work: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with this package at hand in the workers.

    Batches are bounded by bytes (Spark's own bound is 64 MB, held by both sides of every
    task) unless the session sets a bound itself.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        trim()

    spark = df.sparkSession
    if spark.conf.get(_ARROW_SETTING, None) is None:
        spark.conf.set(_ARROW_SETTING, str(ARROW_BYTES))
    ship_package(spark)
    return df.mapInArrow(task, schema)


def small(df: DataFrame, limit: int = 100_000) -> DataFrame:
    """``df`` with a broadcast hint if a count shows that it has at most ``limit`` narrow rows."""
    return F.broadcast(df) if few(df, limit) else df


def fingerprint(*columns: Column) -> Column:
    """A 64-bit hash that is the same in every run."""
    return F.xxhash64(*columns)


def slices(batches: Iterable[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of text, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column without gaps, and n + 1 offsets; null is empty."""
    column = pc.fill_null(column.cast(pa.large_utf8()), "")
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over a 64-bit word."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_PLACE = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _places(n: int) -> np.ndarray:
    global _PLACE
    if n > len(_PLACE):
        _PLACE = mix(np.arange(1, 2 * n, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
    return _PLACE


def not_space() -> np.ndarray:
    """Bytes of words that ASCII white space separates."""
    kind = np.ones(256, bool)
    kind[list(ASCII_SPACE)] = False
    return kind


def alphanumeric() -> np.ndarray:
    """Bytes of digits, ASCII letters and everything beyond ASCII."""
    kind = np.zeros(256, bool)
    kind[48:58] = kind[65:91] = kind[97:123] = kind[128:] = True
    return kind


class Words:
    """Words of a slice of texts, found with array operations on their bytes.

    ``text``: all bytes with A-Z lowered; ``start``, ``end``: byte range of each word;
    ``first``: index of the first word of each text, and the number of words at the end;
    ``hash``: 64 bits of each word. Equal words have equal hashes.
    """

    def __init__(self, column: pa.Array, kind: np.ndarray, hashed: bool = True) -> None:
        raw, self.offsets = buffers(column)
        self.text = _LOWER[raw]
        inside = kind[raw]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edges = self.offsets[(self.offsets > 0) & (self.offsets < len(raw))]
        begins[edges] = inside[edges]
        ends[edges - 1] = inside[edges - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        if hashed:
            self.hash = self._hashes(inside)

    def _hashes(self, inside: np.ndarray) -> np.ndarray:
        """Word hashes, a stretch of words at a time so that only a slice's bytes are widened to 64 bits."""
        out = np.zeros(len(self.start), np.uint64)
        at = 0
        while at < len(out):
            to = max(at + 1, int(np.searchsorted(self.end, self.start[at] + SLICE_BYTES, "right")))
            a, b = int(self.start[at]), int(self.end[to - 1])
            starts = self.start[at:to] - a
            place = np.arange(b - a) - np.repeat(starts, np.diff(np.append(starts, b - a)))
            kept = inside[a:b]
            place[~kept] = 0
            value = _BYTE[self.text[a:b]] * _places(int(place.max()) + 1)[place]
            value[~kept] = 0
            out[at:to] = np.add.reduceat(value, starts)
            at = to
        return mix(out + (self.end - self.start).astype(np.uint64))

    def owner(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def grams(self, n: int) -> np.ndarray:
        """Hash of the n words from each word on; the last n - 1 have none."""
        size = max(0, len(self.hash) - n + 1)
        out = np.full(size, n, np.uint64)
        for k in range(n):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + self.hash[k : k + size])
        return out


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All indices of the ranges that begin at ``starts`` and have ``sizes``."""
    total = int(sizes.sum())
    ends = np.cumsum(sizes)
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)
