"""Vectorised scans over the UTF-8 bytes of Arrow string columns.

Everything here works on one Arrow batch inside a Spark task: no row objects
are made, memory is bounded by ``max_bytes`` (or by one document, if a single
document is longer), and nothing is kept between batches.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
#: White space of the word rule ``[^\x20\x09-\x0D]+``.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII lower-casing; other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: Spans longer than this many bytes are not hashed by the rolling polynomial.
LONG = 255
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUES = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit words so that all bits depend on all bits."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the rolling base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and ``n + 1`` offsets; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str, max_bytes: int = 1 << 19) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut Arrow batches so that each piece holds about ``max_bytes`` of text."""
    give_back()
    for batch in batches:
        buf, off = text_buffer(batch.column(batch.schema.get_field_index(text)))
        i, n = 0, batch.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(off, off[i] + max_bytes, "right")) - 1)
            yield batch.slice(i, j - i), buf[off[i] : off[j]], off[i : j + 1] - off[i]
            i = j
    give_back()


def give_back() -> None:
    """Return freed memory to the system: Python workers live on after their task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Rolling polynomial prefix sums; see :func:`span_hash`."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[buf] * powers(len(buf))[0], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, buf: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end), equal for equal bytes.

    The polynomial is taken modulo 2**64, where some texts of 1024 bytes and more
    collide by their structure (Thue-Morse words). Spans longer than ``LONG`` are
    therefore hashed by themselves; callers whose spans may be long give ``buf``.
    """
    h = (prefix[end] - prefix[start]) * powers(len(prefix))[1][start]
    h = mix(h + (end - start).astype(np.uint64) * U64(0xD6E8FEB86659FD93))
    if buf is not None and len(far := np.flatnonzero(end - start > LONG)):
        data = memoryview(np.ascontiguousarray(buf))
        h[far] = [xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(start[far].tolist(), end[far].tolist())]
    return h


def same_bytes(buf: np.ndarray, a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Whether span ``a[i]`` holds the same bytes as span ``b[i]``."""
    same = size_a == size_b
    at = np.flatnonzero(same)
    size = size_a[at]
    differ = buf[ragged(a[at], size)] != buf[ragged(b[at], size)]
    same[at[np.repeat(np.arange(len(at)), size)[differ]]] = False
    return same


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the first word of each document.

    The third array has one entry per document and one more, like ``off``.
    """
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    full = ~IS_SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    first = full.copy()
    first[1:] &= ~full[:-1] | edge[1:-1]
    last = full.copy()
    last[:-1] &= ~full[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, off)


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` neighbours (across documents too)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * U64(0xFF51AFD7ED558CCD) + hashes[k : k + n]
    return mix(out)


def segment_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of ``values[at[i]:at[i + 1]]`` in double precision, row by row; empty segments give zero."""
    out = np.zeros((len(at) - 1, *values.shape[1:]))
    some = np.flatnonzero(np.diff(at))
    if len(some):
        out[some] = np.add.reduceat(values[: at[-1]], at[some], axis=0, dtype=np.float64)
    return out


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices start[0], .., start[0]+length[0]-1, start[1], .. in one array."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    keep = length > 0
    start, length = start[keep], length[keep]
    at = np.cumsum(length)[:-1]
    out[0] = start[0]
    out[at] = start[1:] - start[:-1] - length[:-1] + 1
    return np.cumsum(out)
