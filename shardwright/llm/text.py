"""Vectorised text kernels over Arrow string columns.

All functions work on the raw UTF-8 bytes of many documents at once and never build a Python object per word or line.
A word is a maximal run of bytes that are not ASCII white space (9-13 and 32). A line is what stands between line feeds.
Null texts count as empty.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GROUP_BYTES = 1 << 20
BROADCAST_BYTES = 64 << 20
_P = 0x9E3779B97F4A7C15


def space_table() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[9, 10, 11, 12, 13, 32]] = True
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (works on a copy)."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class Hasher:
    """64-bit polynomial hashes of byte spans, from one prefix sum for all spans of a buffer."""

    def __init__(self) -> None:
        self.bytes = np.random.default_rng(20240607).integers(1, 2**64, 256, dtype=np.uint64)
        self._grow(GROUP_BYTES + 1)

    def _grow(self, n: int) -> None:
        self.power = np.cumprod(np.full(n, _P, np.uint64))
        self.inverse = np.cumprod(np.full(n, pow(_P, -1, 2**64), np.uint64))

    def spans(self, x: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = len(x)
        if n >= len(self.power):
            self._grow(2 * n + 1)
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(self.bytes[x] * self.power[:n], out=total[1:])
        return mix((total[end] - total[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of the documents in them) of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def groups(offsets: np.ndarray, limit: int = GROUP_BYTES):
    """Ranges of documents of about limit bytes each (one document at least)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1))
        yield i, j
        i = j


def word_spans(x: np.ndarray, edges: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in x; edges are the offsets of the documents in x, the last one its length."""
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~space[x]
    before = np.empty(len(x), bool)
    before[0] = False
    before[1:] = word[:-1]
    first = edges[:-1]
    before[first[first < len(x)]] = False
    start = np.flatnonzero(word & ~before)
    after = np.empty(len(x), bool)
    after[-1] = False
    after[:-1] = word[1:]
    last = edges[1:] - 1
    after[last[last >= 0]] = False
    return start, np.flatnonzero(word & ~after) + 1


def words(column, hasher: Hasher | None = None, spans: bool = False, fold: np.ndarray | None = None):
    """(hashes of all words, pointer of each document into them[, starts, ends in bytes of the document]); fold maps bytes first."""
    hasher, space = hasher or Hasher(), space_table()
    raw, offsets = flat(column)
    hashes, starts, ends, pointer = [], [], [], [np.zeros(1, np.int64)]
    seen = 0
    for i, j in groups(offsets):
        x = raw[offsets[i] : offsets[j]]
        if fold is not None:
            x = fold[x]
        edges = offsets[i : j + 1] - offsets[i]
        start, end = word_spans(x, edges, space)
        at = np.searchsorted(start, edges[1:])
        hashes.append(hasher.spans(x, start, end))
        if spans:
            base = np.repeat(edges[:-1], np.diff(at, prepend=0))
            starts.append(start - base)
            ends.append(end - base)
        pointer.append(at + seen)
        seen += len(start)
    cat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    out = cat(hashes, np.uint64), np.concatenate(pointer)
    return (*out, cat(starts, np.int64), cat(ends, np.int64)) if spans else out


def word_counts(column) -> np.ndarray:
    """Number of words of each document."""
    space = space_table()
    raw, offsets = flat(column)
    out = np.zeros(len(offsets) - 1, np.int64)
    for i, j in groups(offsets):
        edges = offsets[i : j + 1] - offsets[i]
        x = raw[offsets[i] : offsets[j]]
        if len(x):
            word = ~space[x]
            before = np.empty(len(x), bool)
            before[0] = False
            before[1:] = word[:-1]
            first = edges[:-1]
            before[first[first < len(x)]] = False
            start = np.flatnonzero(word & ~before)
            out[i:j] = np.diff(np.searchsorted(start, edges))
    return out


def lines(column, hasher: Hasher | None = None):
    """Lines that aren't blank: (hashes, document of each, number in its document, start and end in the bytes, those bytes).

    Line numbers count blank lines too."""
    hasher, space = hasher or Hasher(), space_table()
    raw, offsets = flat(column)
    parts = []
    for i, j in groups(offsets):
        x = raw[offsets[i] : offsets[j]]
        edges = offsets[i : j + 1] - offsets[i]
        feed = np.flatnonzero(x == 10)
        # each document has one line more than it has line feeds
        feeds_to = np.searchsorted(feed, edges)
        count = np.diff(feeds_to) + 1
        doc = np.repeat(np.arange(j - i), count)
        first = np.cumsum(count) - count
        number = np.arange(len(doc)) - first[doc]
        start = np.empty(len(doc), np.int64)
        end = np.empty(len(doc), np.int64)
        head = number == 0
        start[head] = edges[:-1]
        start[~head] = feed + 1
        tail = np.zeros(len(doc), bool)
        tail[first + count - 1] = True
        end[tail] = edges[1:]
        end[~tail] = feed
        ink = np.empty(len(x) + 1, np.int32)
        ink[0] = 0
        np.cumsum(~space[x], out=ink[1:])
        full = ink[end] > ink[start]
        start, end = start[full], end[full]
        parts.append((hasher.spans(x, start, end), doc[full] + i, number[full], start + offsets[i], end + offsets[i]))
    if not parts:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z, z, raw
    return (*(np.concatenate(p) for p in zip(*parts)), raw)


def take_spans(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The spans of raw as an Arrow string array."""
    size = end - start
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    index = np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])
    data = raw[index] if len(raw) else np.zeros(0, np.uint8)
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))).cast(pa.string())


def runs(values: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal neighbours in a sorted array, with its length at the end."""
    if not len(values):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]])


def pieces(batches, column: int, limit: int = 4 << 20):
    """Batches cut into slices of at most about limit bytes of text (one row at least), so that working arrays stay small."""
    for batch in batches:
        if not batch.num_rows:
            yield batch
            continue
        _, offsets = flat(batch.column(column))
        for i, j in groups(offsets, limit):
            yield batch.slice(i, j - i)
    release()


def release() -> None:
    """Give freed memory back to the system: workers are reused, and an executor pays for what they keep."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def free_names(taken, *wanted: str) -> list[str]:
    """Names like the wanted ones that no column of `taken` has, whatever their case."""
    used, out = {t.lower() for t in taken}, []
    for name in wanted:
        own = f"__{name}"
        while own.lower() in used:
            own += "_"
        used.add(own.lower())
        out.append(own)
    return out


def small(ids, limit: int = BROADCAST_BYTES):
    """(ids, whether they take at most `limit` bytes): then with a broadcast hint, so that no text is shuffled to find them, else for a join by shuffle."""
    from pyspark.sql import functions as F

    fits = ids.count() * 64 <= limit  # what a broadcast relation takes a row
    return (F.broadcast(ids) if fits else ids.hint("merge")), fits
