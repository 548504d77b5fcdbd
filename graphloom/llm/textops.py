"""Vectorised text primitives over Arrow batches: words, hashes of words and of word windows.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. These separators are ASCII, so the byte view of
UTF-8 text gives the same words as the code-point view.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_M1 = np.uint64(0xFF51AFD7ED558CCD)
_M2 = np.uint64(0xC4CEB9FE1A85EC53)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_S33 = np.uint64(33)
#: Words longer than this are hashed whole by BLAKE2 instead of eight bytes at a time.
_LONG_WORD = 256


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising 64-bit mixer (a bijection); returns a new array."""
    x = x ^ (x >> _S33)
    x *= _M1
    x ^= x >> _S33
    x *= _M2
    x ^= x >> _S33
    return x


def pair(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    """Order-sensitive combination of two hash arrays."""
    return mix(a * np.uint64((2 * seed + 1) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF) + (b ^ _GOLD) * np.uint64(0xA0761D6478BD642F))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the index of its first word (one more entry at the end)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = _SPACE[raw]
    before = np.empty(len(raw) + 1, dtype=bool)  # before[i]: a separator or a text's edge precedes byte i
    before[0] = True
    before[1:] = space
    edge = offsets[offsets < len(raw)]
    first = before[:-1].copy()
    first[edge] = True
    starts = np.flatnonzero(first & ~space)
    after = np.empty(len(raw), dtype=bool)
    after[:-1] = space[1:]
    after[-1] = True
    inner = offsets[(offsets > 0)] - 1
    after[inner] = True
    ends = np.flatnonzero(after & ~space) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each word. Eight bytes a step, injective before mixing."""
    n = len(starts)
    if not n:
        return np.zeros(0, np.uint64)
    padded = np.empty(len(raw) + 8, dtype=np.uint8)
    padded[: len(raw)] = raw
    padded[len(raw) :] = 0
    eight = np.ndarray(shape=(len(raw) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    mask = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
    length = ends - starts
    h = mix((eight[starts] & mask[np.minimum(length, 8)]) + (length.astype(np.uint64) + np.uint64(seed)) * _GOLD)
    more, at = np.flatnonzero((length > 8) & (length <= _LONG_WORD)), 8
    while len(more):
        part = eight[starts[more] + at] & mask[np.minimum(length[more] - at, 8)]
        h[more] = mix(h[more] * _M2 + part)
        at += 8
        more = more[length[more] > at]
    for i in np.flatnonzero(length > _LONG_WORD):
        digest = hashlib.blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8, key=seed.to_bytes(4, "little")).digest()
        h[i] = int.from_bytes(digest, "little")
    return h


def grams(words: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hashes of all windows of n consecutive words (by doubling); shorter than words by n - 1."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    done, out, power, block = 0, None, 1, words
    while True:
        if n & power:
            size = len(words) - (done + power) + 1
            out = block[:size] if out is None else pair(out[:size], block[done : done + size], seed + 101 + power)
            done += power
        if done == n:
            return out
        block = pair(block[:-power], block[power:], seed + power)
        power *= 2


def gram_owner(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For windows over concatenated texts: the positions that lie within one text, and their texts.

    first: index of each text's first word, as word_spans gives it.
    """
    count = np.maximum(first[1:] - first[:-1] - n + 1, 0)
    text = np.repeat(np.arange(len(count)), count)
    start = np.repeat(first[:-1] - (np.cumsum(count) - count), count)
    return np.arange(len(text)) + start, text
