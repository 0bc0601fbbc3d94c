"""Vectorised text kernels shared by the training-data operators.

Texts arrive as Arrow string arrays. A block of documents is treated as one
UTF-8 byte buffer, and words, shingles, character n-grams and chunk borders
all come out of whole-buffer NumPy passes, so no Python code runs per word.

Word rule: lower-cased maximal runs of ASCII letters, digits, underscore and
non-ASCII characters other than Latin-1 signs, general punctuation and CJK
punctuation; each Han or kana character is a word of its own. Null and empty
texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one NumPy pass covers; a longer document is a block of its own.
BLOCK_BYTES = 1 << 19

_rng = np.random.default_rng(20240229)
_BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_GEAR = _rng.integers(0, 1 << 32, 256, dtype=np.uint32)
_PRIME = 0x9E3779B97F4A7C15
_INVERSE = pow(_PRIME, -1, 1 << 64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

_IS_WORD = np.zeros(256, bool)
for _c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_":
    _IS_WORD[_c] = True
_IS_WORD[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on every other."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, BLOCK_BYTES * 2)
        for k, base in enumerate((_PRIME, _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0], _POWERS[1]


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """S with S[e] - S[s] = the polynomial hash of buf[s:e] times PRIME**s."""
    power, _ = _powers(len(buf) + 1)
    s = np.empty(len(buf) + 1, np.uint64)
    s[0] = 0
    np.cumsum(_BYTE_CODE[buf] * power[: len(buf)], out=s[1:])
    return s


def span_hash(s: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, inverse = _powers(len(s))
    return mix((s[ends] - s[starts]) * inverse[starts])


def byte_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and its n + 1 offsets; a null has no bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    n = len(texts)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    if offsets[-1] == offsets[0]:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def blocks(texts: pa.Array, lower: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, offsets) of runs of about BLOCK_BYTES."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if lower and len(texts):
        texts = pc.utf8_lower(texts)
    data, offsets = byte_buffer(texts)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + BLOCK_BYTES, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


@dataclass
class Words:
    """Words of a block: hash, byte span, and for each document its first word (n + 1 of them)."""

    code: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def words(buf: np.ndarray, offsets: np.ndarray) -> Words:
    n = len(buf)
    docs = len(offsets) - 1
    if n == 0:
        none = np.empty(0, np.int64)
        return Words(np.empty(0, np.uint64), none, none, np.zeros(docs + 1, np.int64))
    is_word = _IS_WORD[buf]
    cjk = None
    if buf.max() >= 0x80:
        for lead in (0xC2, 0xE2, 0xE3):
            at = np.flatnonzero(buf == lead)
            if not len(at):
                continue
            second = buf[np.minimum(at + 1, n - 1)]
            if lead == 0xC2:  # Latin-1 signs; the ordinals and the micro sign are letters
                at = at[(second != 0xAA) & (second != 0xB5) & (second != 0xBA)]
                size = 2
            elif lead == 0xE2:
                at, size = at[(second == 0x80) | (second == 0x81)], 3
            else:
                at, size = at[second == 0x80], 3
            for k in range(size):
                is_word[np.minimum(at + k, n - 1)] = False
        cjk = np.flatnonzero((buf >= 0xE3) & (buf <= 0xE9) & is_word)
    start = is_word.copy()
    start[1:] &= ~is_word[:-1]
    edge = offsets[:-1][offsets[:-1] < n]
    start[edge] = is_word[edge]
    if cjk is not None and len(cjk):
        start[cjk] = True
        after = cjk[cjk + 3 < n] + 3
        start[after] = is_word[after]
    stop = is_word.copy()
    stop[:-1] &= ~is_word[1:] | start[1:]
    starts, ends = np.flatnonzero(start), np.flatnonzero(stop) + 1
    code = span_hash(prefix_hash(buf), starts, ends)
    return Words(code, starts, ends, np.searchsorted(starts, offsets))


_STEP = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words, and each document's first shingle (n + 1).

    A document of 1 to k - 1 words has one shingle, of all its words; one
    without words has none.
    """
    docs, total = len(w.first) - 1, len(w.code)
    count = np.diff(w.first)
    made = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    first = np.zeros(docs + 1, np.int64)
    np.cumsum(made, out=first[1:])
    if first[-1] == 0:
        return np.empty(0, np.uint64), first
    at = np.repeat(w.first[:-1] - first[:-1], made) + np.arange(first[-1])
    width = np.repeat(np.minimum(count, k), made)
    short = bool((width < k).any())
    code = np.zeros(first[-1], np.uint64)
    for j in range(k):
        part = w.code[np.minimum(at + j, total - 1)] * _STEP[j % 5]
        if short:
            part[width <= j] = 0
        code = (code ^ part) * np.uint64(_PRIME | 1) + np.uint64(j + 1)
    return mix(code), first


def gear(buf: np.ndarray) -> np.ndarray:
    """The gear rolling hash of the 32 bytes that end at each position."""
    h = _GEAR[buf]
    for k in (1, 2, 4, 8, 16):
        moved = h[:-k] << np.uint32(k)
        h = h.copy()
        h[k:] += moved
    return h
