"""Words and word n-grams of many texts at once, as 64-bit hashes in numpy arrays.

A word is a longest run of characters other than blank and the control characters 9 to 13. The
functions work on the UTF-8 bytes of an Arrow string column, so no Python string is made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U64 = np.uint64
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_BLOCK = 1 << 20
_BASE = _U64(0x9E3779B97F4A7C15)
_BASE_INVERSE = _U64(pow(int(_BASE), -1, 1 << 64))
_rng = np.random.default_rng(20240229)
_BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U64(2) + _U64(1)
_LOWER_VALUE = _BYTE_VALUE.copy()
_LOWER_VALUE[65:91] = _BYTE_VALUE[97:123]
_FACTORS = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * _U64(2) + _U64(1)
_powers: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over all output bits."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U64(27))
    x = x * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def _power_tables(length: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < length:
        size = max(length, _BLOCK + 1)
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _powers[name] = np.cumprod(table, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def text_buffer(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and the offset at which each row begins (and the
    end of the last); a null has no bytes."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], array.type)
    if array.null_count:
        array = array.fill_null(b"" if pa.types.is_binary(array.type) else "")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    kind = np.int64 if wide else np.int32
    if len(array) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    bounds = np.frombuffer(offsets, kind, len(array) + 1, array.offset * kind().itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def word_spans(buffer: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the index of each text's first word (and the number of
    all words). No word crosses from one text into the next."""
    inside = ~_SEPARATOR[buffer]
    edge = np.zeros(len(buffer) + 1, dtype=bool)
    edge[bounds] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def span_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """A hash of the bytes of each span; with ``lower``, A-Z count as a-z. Spans are in order."""
    values = _LOWER_VALUE if lower else _BYTE_VALUE
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _BLOCK, "right")))
        begin, end = starts[i], ends[j - 1]
        up, down = _power_tables(end - begin + 1)
        sums = np.zeros(end - begin + 1, dtype=np.uint64)
        np.cumsum(values[buffer[begin:end]] * up[: end - begin], out=sums[1:])
        s, e = starts[i:j] - begin, ends[i:j] - begin
        out[i:j] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
        i = j
    return mixed(out)


def ngrams(hashes: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hash of the n words that begin at each position; positions near the end are left out."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.empty(0, dtype=np.uint64)
    total = np.full(size, salt, dtype=np.uint64)
    for k in range(n):
        total += hashes[k : k + size] * _FACTORS[(k + salt) % len(_FACTORS)]
    return mixed(total)


def hashed_words(column, lower: bool):
    """(buffer, starts, ends, hashes, index of each text's first word) of a text column."""
    buffer, bounds = text_buffer(column)
    starts, ends, index = word_spans(buffer, bounds)
    return buffer, starts, ends, span_hashes(buffer, starts, ends, lower), index


def binary_rows(values: np.ndarray, cuts: np.ndarray) -> list[bytes]:
    """The bytes of consecutive slices of an array; ``cuts`` has the start of each and the end."""
    return [values[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
