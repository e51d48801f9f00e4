"""Array kernels over the bytes of many texts at once.

A text column arrives as an Arrow string array: one byte buffer and offsets.
Prefix polynomial hashes (mod 2**64, odd base) give the hash of any byte or
word range from two table lookups. Such hashes take some long sequences over two letters for equal
(Thue-Morse words from 1,024 on, whatever the base), so they name ranges of at most ``RANGE`` values only;
longer words and lines are named by xxhash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
BASE = 0x9E3779B97F4A7C15
CHUNK = 1 << 20
#: The longest range that a prefix hash may name.
RANGE = 256

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_tables: dict[int, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 whose every output bit depends on every input bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base ** 0 .. base ** (n-1) mod 2**64; kept between calls."""
    own = _tables.get(base)
    if own is None or len(own) < n:
        size = max(n, CHUNK + 1)
        own = np.empty(size, U)
        own[0], done = 1, 1
        while done < size:
            more = min(done, size - done)
            own[done : done + more] = own[:more] * U(pow(base, done, 1 << 64))
            done += more
        if size <= 8 * CHUNK:
            _tables[base] = own
    return own[:n]


def prefix_hash(values: np.ndarray, base: int = BASE) -> np.ndarray:
    """H with H[j] - H[i] = sum of (values[t] + 1) * base**t for i <= t < j."""
    out = np.empty(len(values) + 1, U)
    out[0] = 0
    np.cumsum((values.astype(U) + U(1)) * powers(len(values), base), out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASE) -> np.ndarray:
    """Hash of values[start:end], equal for equal contents anywhere."""
    inverse = powers(len(prefix), pow(base, -1, 1 << 64))
    return (prefix[end] - prefix[start]) * inverse[start]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (int64, from 0) of an Arrow string or binary array without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(column: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts with about ``most`` bytes; a longer text is a run of its own."""
    data, offsets = buffers(column)
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and each text's range of words (n + 1 offsets)."""
    inside = ~_SPACE[data]
    if not len(inside):
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    last[tails] = inside[tails]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes unchanged."""
    return _LOWER[data]


def named(values: np.ndarray, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASE) -> np.ndarray:
    """A hash of each values[start:end] of any length; ``prefix`` is ``prefix_hash(values, base)``."""
    size = ends - starts
    out = mixed(range_hash(prefix, starts, ends, base) + size.astype(U) * U(0xD6E8FEB86659FD93))
    seed = base & 0xFFFFFFFF
    for i in np.flatnonzero(size > RANGE).tolist():
        out[i] = xxhash.xxh3_64_intdigest(values[starts[i] : ends[i]].tobytes(), seed)
    return out


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASE) -> np.ndarray:
    return named(data, prefix_hash(data, base), starts, ends, base)


def window_min(x: np.ndarray, width_log2: int) -> np.ndarray:
    """Minimum of each run of 2**width_log2 values."""
    for k in range(width_log2):
        x = np.minimum(x[: -(1 << k)], x[1 << k :])
    return x


def within(offsets: np.ndarray, n: int, width: int) -> np.ndarray:
    """For each of n positions whether a window of ``width`` that starts there stays in its text."""
    ok = np.zeros(n + 1, np.int32)
    ends = np.maximum(offsets[1:] - width + 1, offsets[:-1])
    np.add.at(ok, offsets[:-1], 1)
    np.add.at(ok, ends, -1)
    return np.cumsum(ok[:n]) > 0


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0] .. starts[0]+lengths[0]-1, starts[1] .. and so on."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    at = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - at, lengths)
