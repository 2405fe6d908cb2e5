"""Ragged text arrays: word bounds, word hashes and window hashes of many texts at once.

Everything works on the UTF-8 bytes of an Arrow string column, so a batch of
documents is one byte buffer and one offset array.  Hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 2 << 20  # bytes of text handled at a time; only temporaries depend on it

_rng = np.random.default_rng(20240229)
_CODES = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEPS = (_rng.integers(1, 2**63, 64, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def byte_set(spec: bytes) -> np.ndarray:
    flags = np.zeros(256, bool)
    flags[list(spec)] = True
    return flags


#: word separators of whitespace words and of letter-or-digit words
BLANKS = byte_set(bytes([0x20, *range(0x09, 0x0E)]))
PUNCTUATION = byte_set(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
#: the same after A-Z were lower-cased
FOLDED_PUNCTUATION = PUNCTUATION & ~byte_set(bytes(range(0x41, 0x5B)))


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POWERS = powers(1 << 12)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        _POWERS = powers(max(n, 2 * len(_POWERS)))
    return _POWERS


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, bytes, offsets) of runs of texts of about ``limit`` bytes; a longer text comes alone."""
    raw, at = buffers(column)
    n, first = len(at) - 1, 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield first, end, raw[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of maximal runs of true bytes; a run never spans two texts."""
    if not len(inside):
        z = np.zeros(0, np.int64)
        return z, z, z
    edge = np.empty(len(inside), bool)
    edge[0] = inside[0]
    np.logical_and(inside[1:], ~inside[:-1], out=edge[1:])
    begins = offsets[:-1][np.diff(offsets) > 0]
    edge[begins] = inside[begins]
    starts = np.flatnonzero(edge)
    stop = np.empty(len(inside), bool)
    stop[-1] = inside[-1]
    np.logical_and(inside[:-1], ~inside[1:], out=stop[:-1])
    lasts = begins[1:] - 1
    stop[lasts] = inside[lasts]
    ends = np.flatnonzero(stop) + 1
    owner = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, owner


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True, limit: int = CHUNK) -> np.ndarray:
    """A hash of each byte range [start, end); ranges are ascending and do not overlap."""
    codes = _CODES.copy()
    if fold:
        codes[65:91] = codes[97:123]
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + limit, "right")))
        s, e = starts[i:j], ends[i:j]
        sizes = e - s
        total = int(sizes.sum())
        begins = np.cumsum(sizes) - sizes
        place = np.arange(total) - np.repeat(begins, sizes)
        value = codes[raw[place + np.repeat(s, sizes)]]
        value *= _powers(int(sizes.max()) + 1)[place]
        out[i:j] = mix(np.add.reduceat(value, begins) ^ (sizes.astype(np.uint64) * _STEPS[0]))
        i = j
    return out


def window_hashes(words: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the first words and hashes of all windows of ``size`` words within one text."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h += words[k : k + n] * _STEPS[1 + k]
    whole = np.flatnonzero(owner[:n] == owner[size - 1 :])
    return whole, mix(h[whole])


def sequence_hash(words: np.ndarray) -> np.uint64:
    """Hash of a whole short sequence, equal to ``window_hashes`` of a window of its length."""
    return mix((words * _STEPS[1 : 1 + len(words)]).sum(keepdims=True))[0]


def code_points(raw: np.ndarray) -> np.ndarray:
    """At each byte boundary the number of code points before it."""
    out = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=out[1:])
    return out
