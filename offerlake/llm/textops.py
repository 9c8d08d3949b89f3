"""Vectorised helpers on Arrow text columns: words, rolling hashes, packing.

A *word* is a maximal run of bytes other than space and 0x09-0x0D. All hashes
are 64-bit values of the word bytes alone, so they are equal in every task.
"""

from __future__ import annotations

import ctypes
import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

WHITE = np.zeros(256, dtype=bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
SEGMENT = 1 << 19  # bytes hashed at a time
BLOCK_BYTES = 8 << 20  # text bytes held as one block


class Cache(dict):
    """A per-process cache; shipped functions that refer to it take it along empty."""

    def __reduce__(self):
        return Cache, ()


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    if n > 1:
        out[1:] = np.uint64(base)
        np.cumprod(out, out=out)
    return out


_POW = Cache()


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, at least ``n`` of each."""
    if 0 not in _POW or len(_POW[0][0]) < n:
        size = max(n, SEGMENT + 1)
        _POW[0] = (_powers(BASE, size), _powers(pow(BASE, -1, 1 << 64), size))
    return _POW[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes in one array, and the n + 1 row offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    kind = pa.large_binary() if pa.types.is_large_binary(column.type) or pa.types.is_binary(column.type) else pa.large_string()
    column = column.cast(kind)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(kind) else "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset: column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]: offsets[-1]], offsets - offsets[0]


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word, in order; words never cross rows."""
    n = len(buf)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty.astype(np.int32)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    white = WHITE[buf]
    opens = edge[:n].copy()
    opens[1:] |= white[:-1]
    opens &= ~white
    closes = edge[1:].copy()
    closes[:-1] |= white[1:]
    closes &= ~white
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    row = (np.searchsorted(offsets, starts, side="right") - 1).astype(np.int32)
    return starts, ends, row


def poly(values: np.ndarray) -> np.ndarray:
    """Prefix sums of value[i] * BASE**i, with a leading 0."""
    power, _ = power_tables(len(values) + 1)
    out = np.empty(len(values) + 1, dtype=np.uint64)
    out[0] = 0
    np.cumsum(values * power[: len(values)], out=out[1:])
    return out


def _span_value(part: np.ndarray) -> int:
    """The polynomial of one long span, piece by piece."""
    total = 0
    for at in range(0, len(part), SEGMENT):
        piece = int(poly(BYTE_VALUE[part[at: at + SEGMENT]])[-1])
        total = (total + piece * pow(BASE, at, 1 << 64)) % (1 << 64)
    return total


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span; the spans must be in order."""
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        first = starts[at]
        to = int(np.searchsorted(ends, first + SEGMENT, side="right"))
        if to <= at:  # one span longer than a segment
            out[at] = _span_value(buf[first: ends[at]])
            at += 1
            continue
        prefix = poly(BYTE_VALUE[buf[first: ends[to - 1]]])
        s, e = starts[at:to] - first, ends[at:to] - first
        out[at:to] = (prefix[e] - prefix[s]) * power_tables(len(prefix))[1][s]
        at = to
    return mix(out ^ (ends - starts).astype(np.uint64))


def windows(hashes: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of the ``width``-word windows and their first word's index.

    Only windows inside one row are returned.
    """
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(row[:n] == row[width - 1:])
    rolled = np.empty(len(hashes) - width + 1, dtype=np.uint64)
    for lo in range(0, n, SEGMENT):
        hi = min(n, lo + SEGMENT)
        prefix = poly(hashes[lo: hi + width - 1])
        rolled[lo:hi] = (prefix[width: width + hi - lo] - prefix[: hi - lo]) * power_tables(len(prefix))[1][: hi - lo]
    return mix(rolled[at] + np.uint64(width)), at


_ZIP = Cache()


def _zip() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    if 0 not in _ZIP:
        _ZIP[0] = (zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor())
    return _ZIP[0]


def squeeze(data: bytes) -> bytes:
    return _zip()[0].compress(data)


def unsqueeze(data: bytes) -> bytes:
    return _zip()[1].decompress(data)


def pack(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes; small values cost few bytes."""
    values = np.ascontiguousarray(values)
    width = values.dtype.itemsize
    planes = values.view(np.uint8).reshape(-1, width).T if len(values) else np.zeros((width, 0), np.uint8)
    return squeeze(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes, dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    planes = np.frombuffer(unsqueeze(data), dtype=np.uint8).reshape(dtype.itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending 64-bit values as packed differences."""
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def pack_bits(flags: np.ndarray) -> bytes:
    return squeeze(len(flags).to_bytes(8, "little") + np.packbits(flags).tobytes())


def unpack_bits(data: bytes) -> np.ndarray:
    raw = unsqueeze(data)
    return np.unpackbits(np.frombuffer(raw, np.uint8, offset=8), count=int.from_bytes(raw[:8], "little")).astype(bool)


def dump(arrays: list[np.ndarray], data: bytes) -> bytes:
    """64-bit integer arrays and one byte string as one value."""
    return pickle.dumps(([pack(a.astype(np.int64)) for a in arrays], squeeze(data)))


def load(raw: bytes) -> tuple[list[np.ndarray], bytes]:
    arrays, data = pickle.loads(raw)
    return [unpack(a, np.int64) for a in arrays], unsqueeze(data)


def slices(batch: pa.RecordBatch, text: str, limit: int = BLOCK_BYTES):
    """The batch in runs of rows of at most ``limit`` text bytes (or one longer row)."""
    column = batch.column(batch.schema.get_field_index(text))
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64)
    at, n = 0, len(sizes)
    ends = np.cumsum(sizes)
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def give_back() -> None:
    """Return memory that this worker no longer needs to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a C library without it
        pass


def lean(run):
    """``run`` over batches, after which the worker gives memory back."""

    def trimmed(batches):
        yield from run(batches)
        give_back()

    return trimmed


def group_starts(sorted_values: np.ndarray) -> np.ndarray:
    """Index of the first item of every run of equal values."""
    if len(sorted_values) == 0:
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])))


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys; the sorting order and its group starts; each item's place."""
    order = np.argsort(keys)
    ranked = keys[order]
    first = group_starts(ranked)
    place = np.empty(len(keys), np.int64)
    place[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
    return ranked[first], order, first, place
