"""Vectorised helpers over the text column of an Arrow batch.

Everything here works on numpy views of one batch slice; Spark does the
partitioning. Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = U(0x9E3779B97F4A7C55)
BASE2 = U(0xC2B2AE3D27D4EB4F)
ODD = U(0xD6E8FEB86659FD93)
#: Masks of the first n of eight bytes.
TAIL = np.array([(1 << (8 * n)) - 1 for n in range(9)], U)
SLICE_BYTES, LONG = 1 << 20, 256

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser: spreads every input bit over the 64 output bits."""
    x = np.asarray(x, U) + U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE_CODE = mix(np.arange(256))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i mod 2**64 for i up to n (base is odd, so it has an inverse)."""
    key = int(base)
    if key not in _POWERS or len(_POWERS[key][0]) <= n:
        size = max(n + 1, 1 << 16)
        up, down = np.full(size, base, U), np.full(size, U(pow(key, -1, 1 << 64)), U)
        up[0] = down[0] = U(1)
        _POWERS[key] = np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)
    up, down = _POWERS[key]
    return up, down


def prefix_hashes(codes: np.ndarray, base: np.uint64 = BASE) -> np.ndarray:
    """P with P[j] - P[i] = sum of codes[k] * base**k for i <= k < j, mod 2**64."""
    out = np.zeros(len(codes) + 1, U)
    np.cumsum(codes * powers(base, len(codes))[0][: len(codes)], out=out[1:])
    return out


def between(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: np.uint64 = BASE) -> np.ndarray:
    """Position-free hashes of the substrings [start, end)."""
    return (prefix[end] - prefix[start]) * powers(base, len(prefix))[1][start]


def rolling(values: np.ndarray, width: int, base: np.uint64 = BASE2) -> np.ndarray:
    """Polynomial hash of each run of width values, by doubling; empty if there are fewer."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, U)
    now, size, power, out, done = values, 1, int(base), None, 0
    while size <= width:
        if width & size:
            if out is None:
                out = now
            else:
                m = len(now) - done
                out = out[:m] * U(power) + now[done:]
            done += size
        if 2 * size <= width:
            now = now[:-size] * U(power) + now[size:]
        size, power = 2 * size, power * power % (1 << 64)
    return out[:n]


def text_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of each batch of about `most` bytes of text (one row at least), with text_view of the part."""
    for batch in batches:
        data, offsets = text_view(batch.column(batch.schema.get_field_index(text)))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
            yield batch.slice(first, last - first), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
            first = last


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges [start, end): eight bytes at a time go through a mixing function that is not linear; a range of more than
    LONG bytes is a keyless BLAKE2b of 64 bits. Memory stays at some words for each range."""
    size = end - start
    out = mix(size)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    at, left, some = start.copy(), size.copy(), np.flatnonzero((size > 0) & (size <= LONG))
    while len(some):
        word = eight(padded, at[some])
        n = np.minimum(left[some], 8)
        out[some] = mix((out[some] * ODD) ^ (word & TAIL[n]))
        at[some] += 8
        left[some] -= 8
        some = some[left[some] > 0]
    if (size > LONG).any():
        view = memoryview(np.ascontiguousarray(data))
        for i in np.flatnonzero(size > LONG):
            out[i] = int.from_bytes(hashlib.blake2b(view[start[i] : end[i]], digest_size=8).digest(), "little")
    return out


def eight(padded: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as a number, the first one lowest; padded has eight bytes more than it needs."""
    whole = np.ndarray((max(0, len(padded) - 7),), "<u8", padded, 0, (1,)) if len(padded) > 7 else np.zeros(1, U)
    return whole[at]


def runs(codes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of width codes, by doubling through a mixing function that is not linear; empty if there are fewer."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.empty(0, U)
    now, size, out, done = codes, 1, None, 0
    while size <= width:
        if width & size:
            if out is None:
                out = now
            else:
                m = len(now) - done
                out = mix((out[:m] * ODD) ^ now[done:])
            done += size
        if 2 * size <= width:
            now = mix((now[:-size] * ODD) ^ now[size:])
        size *= 2
    return out[:n]


def word_spans(data: np.ndarray, offsets: np.ndarray, solid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges [start, end) of the maximal runs of bytes that the mask takes for solid, none over a row's end, and the
    first run of each row (one entry more than rows)."""
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner], after[inner - 1] = False, False
    start, end = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    return start, end, np.searchsorted(start, offsets)


def gathered(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The byte ranges one after the other, each followed by a space, and where each begins (one entry more than ranges)."""
    size = end - start + 1
    begin = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=begin[1:])
    place = np.arange(begin[-1]) + np.repeat(start - begin[:-1], size)
    text = np.append(data, np.uint8(32))[place]
    text[begin[1:] - 1] = 32
    return text, begin


class Words:
    """Words of a slice: byte ranges [start, end), the first word of each row in `first`
    (one entry more than rows) and the 64-bit hash of each word in `code`."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        solid = ~_SPACE[data]
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = solid[:-1], solid[1:]
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        before[inner], after[inner - 1] = False, False
        self.start = np.flatnonzero(solid & ~before)
        self.end = np.flatnonzero(solid & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.first)
        self.data = LOWER[data] if lower else data
        self.code = range_hashes(self.data, self.start, self.end)

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes of the windows of width words that stay inside a row."""
        hashed = runs(self.code, width)
        room = np.repeat(self.first[1:], self.counts)[: len(hashed)]
        at = np.flatnonzero(np.arange(len(hashed)) + width <= room)
        return at, hashed[at]


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a slice and the row offsets in them."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    return points, lead[offsets]


def covered(length: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mask of the positions below length that lie in some [start, end)."""
    step = np.zeros(length + 1, np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, end, -1)
    return np.cumsum(step[:-1]) > 0


def run_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values[first[i]:first[i+1]] for each i; empty runs give 0."""
    total = np.zeros(len(values) + 1, np.int64 if values.dtype.kind in "bui" else np.float64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
