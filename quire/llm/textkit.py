"""Vectorised word and shingle hashes over Arrow string columns, for use inside ``mapInArrow`` tasks.

Texts are handled as UTF-8 bytes, whole, in chunks of about a megabyte, so that memory follows the chunk (or the
longest text) and not the batch. Null texts count as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_TABLE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def release() -> None:
    """Give memory that a task no longer holds back to the system: workers stay for tasks of other stages."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``; once all that it held is let go, memory goes back to the system."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return task


def byte_class(separators: bytes) -> np.ndarray:
    """Which bytes belong to words, when all others are given."""
    keep = np.ones(256, dtype=bool)
    keep[list(separators)] = False
    return keep


#: words [^\x20\x09-\x0D]+
SPACED = byte_class(bytes([0x20, *range(0x09, 0x0E)]))
#: words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
ALPHANUMERIC = byte_class(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base to the power 0..n-1 and the inverse of each, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + 1)
        inverse = pow(int(_BASE), -1, 1 << 64)
        for key, factor in (("up", int(_BASE)), ("down", inverse)):
            x = np.full(size, factor, dtype=np.uint64)
            x[0] = 1
            _powers[key] = np.multiply.accumulate(x)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64 bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@dataclass
class Words:
    """The words of rows ``first .. first + len(begins) - 1``: words ``begins[i]:ends[i]`` are those of row i."""

    first: int
    raw: np.ndarray
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    begins: np.ndarray
    ends: np.ndarray

    def hashes(self) -> np.ndarray:
        up, down = powers(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum(_TABLE[self.data] * up[:-1], out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))

    def text(self, a: int, b: int) -> str:
        """Words a..b-1 joined by one space."""
        return b" ".join(self.data[self.start[i] : self.end[i]].tobytes() for i in range(a, b)).decode("utf-8", "replace")


def chain(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n successive words, across rows too; those at a row's last n-1 words are to be left out."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, dtype=np.uint64)
    h = np.full(m, n, dtype=np.uint64)
    for i in range(n):
        h = (h ^ words[i : i + m]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return mix(h)


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows) and bytes of a string or binary column; null rows are empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if len(column) == 0 or offsets is None:
        return np.zeros(len(column) + 1, dtype=np.int64), np.empty(0, dtype=np.uint8)
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return at, np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``limit`` bytes: first row, past the last, offsets from the run's start, bytes."""
    at, data = string_bytes(column)
    row, rows = 0, len(at) - 1
    while row < rows:
        stop = max(row + 1, int(np.searchsorted(at, at[row] + limit, side="right")) - 1)
        yield row, stop, at[row : stop + 1] - at[row], data[at[row] : at[stop]]
        row = stop


def words(column: pa.Array, keep: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[Words]:
    """The words of all rows, lower-cased from A-Z, chunk by chunk."""
    for row, _, at, raw in chunks(column, limit):
        data = LOWER[raw]
        n = len(data)
        inside = np.zeros(n + 1, dtype=bool)
        inside[:n] = keep[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[at] = True  # a row's first byte never continues a word
        before = np.zeros(n + 1, dtype=bool)
        before[1:] = inside[:n]
        start = np.flatnonzero(inside & (~before | edge))
        end = np.flatnonzero(before & (~inside | edge))
        yield Words(row, raw, data, start, end, np.searchsorted(start, at[:-1]), np.searchsorted(start, at[1:]))
