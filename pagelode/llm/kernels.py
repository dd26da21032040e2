"""Vectorised text kernels shared by the operators: word spans, span hashes and batch slicing on Arrow buffers.

All of them work on whole texts, byte by byte in UTF-8, and keep only arrays as long as one slice of a batch.
A null text is an empty one.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
#: Word separators: space and the control characters tab to carriage return.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Maps A-Z to a-z and leaves every other byte alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that begin a code point.
LEADING = (np.arange(256) & 0xC0) != 0x80

_LANE_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], dtype=U64)
_LONG_SPAN = 512
#: Spans joined at once, as that takes several numbers for each of their bytes.
_SPANS_AT_ONCE = 1 << 15


def frugal(each: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function over batches, giving free memory back to the system when a task ends.

    Python workers live on after their task; what the allocators keep would add up over the stages of a job.
    """

    @functools.wraps(each)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from each(batches)
        finally:
            give_back()

    return run


def give_back() -> None:
    """Give free memory back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; nulls are empty."""
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if not len(offsets):
        return data[:0], np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about `limit` bytes of text; a longer text stands alone."""
    _, offsets = text_buffer(batch.column(text))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def word_spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and how many words stand before each row (rows + 1 numbers)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~separator[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lanes(data: np.ndarray) -> np.ndarray:
    """Eight bytes from every position, as little-endian numbers; zeros stand past the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seeds: tuple[int, ...] = (1,)) -> list[np.ndarray]:
    """A 64-bit hash of each span of bytes for each seed; equal bytes give equal hashes wherever they stand."""
    view = lanes(data)
    size = (ends - starts).astype(np.int64)
    out = [mix(size.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(seed * 0x632BE59BD9B4E019 % (1 << 64))) for seed in seeds]
    odd = [U64((0xD6E8FEB86659FD93 + 2 * seed * 0xA0761D6478BD642F) % (1 << 64)) for seed in seeds]
    long = np.flatnonzero(size > _LONG_SPAN)
    rows, k = (np.arange(len(size)) if not len(long) else np.flatnonzero(size <= _LONG_SPAN)), 0
    rows = rows[size[rows] > 0]
    whole = len(rows) == len(size)
    while len(rows):
        left = size[rows] - k
        lane = view[starts[rows] + k] & _LANE_MASKS[np.minimum(left, 8)]
        for n in range(len(seeds)):
            if whole:
                out[n] = mix((out[n] ^ lane) * odd[n])
            else:
                out[n][rows] = mix((out[n][rows] ^ lane) * odd[n])
        k += 8
        rows = rows[left > 8]
        whole = False
    for i in long.tolist():
        piece = data[starts[i] : ends[i]].tobytes()
        for n, seed in enumerate(seeds):
            out[n][i] = xxhash.xxh3_64_intdigest(piece, seed=seed)
    return out


def rolling(values: np.ndarray, width: int, base: int) -> np.ndarray:
    """A hash of every `width` consecutive values."""
    count = len(values) - width + 1
    if count <= 0:
        return np.zeros(0, U64)
    total = np.zeros(count, U64)
    for k in range(width):
        total = total * U64(base) + values[k : k + count]
    return mix(total)


def window_rows(words_before: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of the windows that lie in one row, and their rows."""
    counts = np.maximum(np.diff(words_before) - width + 1, 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    shift = words_before[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(counts) else counts
    return np.arange(int(counts.sum())) + shift[rows], rows


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the given spans, joined by one space within each row, and the rows' offsets.

    `before` counts the spans before each row, as word_spans() gives it.
    """
    rows = len(before) - 1
    size = ends - starts
    if not len(size):
        return np.zeros(0, np.uint8), np.zeros(rows + 1, np.int64)
    to = np.cumsum(size + 1)
    at = to - size - 1
    out = np.full(int(to[-1]), 0x20, np.uint8)
    for k in range(0, len(size), _SPANS_AT_ONCE):
        some = size[k : k + _SPANS_AT_ONCE]
        skip = np.cumsum(some) - some
        index = np.arange(int(some.sum()))
        out[index + np.repeat(at[k : k + _SPANS_AT_ONCE] - skip, some)] = data[index + np.repeat(starts[k : k + _SPANS_AT_ONCE] - skip, some)]
    edge = np.concatenate([[0], to])[before]
    full = np.diff(before) > 0
    keep = np.ones(len(out), bool)
    keep[edge[1:][full] - 1] = False
    lengths = np.diff(edge) - full
    return out[keep], np.concatenate([[0], np.cumsum(lengths)])


def string_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A string column over the given bytes."""
    if offsets[-1] < 2**31:
        return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))


def row_sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of flags over each row's part."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
