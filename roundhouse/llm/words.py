"""Hashes of words and of runs of words, for many documents at once, straight from Arrow's text buffers.

A word is a longest run of bytes other than space and ``\\x09-\\x0D``. Its hash is a polynomial in 64-bit arithmetic over randomised
byte values, taken from prefix sums; a run's hash is a polynomial over mixed word hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: bytes of text worked on at a time (a longer document is cut between words)
STEP = 1 << 20
_RANDOM = np.random.default_rng(20240229)
BYTE_VALUES = _RANDOM.integers(1, 1 << 63, 256, dtype=U) * U(2) + U(1)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2 ** 64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, STEP + 4096), base, U)
        steps[0] = 1
        have = _POWERS[base] = np.cumprod(steps, dtype=U)
        if n > 4 * STEP:  # not worth keeping
            del _POWERS[base]
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(BASE, len(values)), dtype=U, out=out[1:])
    return out


def runs(values: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of ``length`` neighbours."""
    n = len(values) - length + 1
    if n <= 0:
        return np.zeros(0, U)
    sums = prefix_sums(values)
    return mix((sums[length:] - sums[:-length]) * powers(INVERSE, n))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null texts are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each word of texts that lie end to end in ``data``."""
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= SPACE[data[:-1]] | edge[1:-1]
    ends = inside
    ends[:-1] &= SPACE[data[1:]] | edge[1:-1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def hashed(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = prefix_sums(BYTE_VALUES[data])
    return mix((sums[ends] - sums[begins]) * powers(INVERSE, len(data) + 1)[begins])


def long_document(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes and spans of one document, a stretch of whole words at a time."""
    found, start = [], 0
    while start < len(data):
        end = min(len(data), start + STEP)
        while end < len(data):
            spaces = np.flatnonzero(SPACE[data[end : end + STEP]])
            if len(spaces):
                end += int(spaces[0])
                break
            end = min(len(data), end + STEP)
        part = data[start:end]
        begins, ends = spans(part, np.array([0, len(part)]))
        found.append((hashed(part, begins, ends), begins + start, ends + start))
        start = end
    return tuple(np.concatenate(x) for x in zip(*found))  # type: ignore[return-value]


def chunks(texts: pa.Array, lower: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """About ``STEP`` bytes of whole texts at a time: row of the first, bytes, where texts begin in them (and the end), hash, begin and end of
    all words, and the number of each text's first word (and of all)."""
    data, offsets = buffers(texts)
    row, n = 0, len(offsets) - 1
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + STEP, "right")) - 1)
        part = data[offsets[row] : offsets[stop]]
        own = offsets[row : stop + 1] - offsets[row]
        if lower:
            part = LOWER[part]
        if len(part) > STEP:
            words, begins, ends = long_document(part)
        else:
            begins, ends = spans(part, own) if len(part) else (np.zeros(0, np.int64),) * 2
            words = hashed(part, begins, ends)
        yield row, part, own, words, begins, ends, np.searchsorted(begins, own)
        row = stop


def documents(texts: pa.Array, lower: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text: its row, its bytes, and hash, begin and end of its words."""
    for row, part, own, words, begins, ends, first in chunks(texts, lower):
        for i in range(len(own) - 1):
            a, b = first[i], first[i + 1]
            yield row + i, part[own[i] : own[i + 1]], words[a:b], begins[a:b] - own[i], ends[a:b] - own[i]
