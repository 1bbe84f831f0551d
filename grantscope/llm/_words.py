"""Vectorised words, word hashes and n-gram hashes of whole Arrow batches.

A word is a maximal run of bytes other than ``\\x20`` and ``\\x09-\\x0D`` of the
UTF-8 text; no byte of a multi-byte character is in that set, so these are the
words ``[^\\x20\\x09-\\x0D]+`` of the text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa

SPACE = b" \t\n\x0b\x0c\r"
IS_WORD = np.ones(256, bool)
IS_WORD[list(SPACE)] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
BLOCK = 4 << 20


def tidy() -> None:
    """Gives back to the system what the allocators of a long-lived worker hold unused."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes; a longer text is alone in its range."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the number of its first word."""
    word = is_word[data]
    before, after = np.empty_like(word), np.empty_like(word)
    before[1:], after[:-1] = word[:-1], word[1:]
    cut = np.unique(offsets[offsets < len(data)])
    before[cut] = False
    after[cut[cut > 0] - 1] = False
    after[-1:] = False
    starts = np.flatnonzero(word & ~before)
    return starts, np.flatnonzero(word & ~after) + 1, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _K2
    return h ^ (h >> np.uint64(29))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, read eight bytes at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    size = ends - starts
    h = mix(size.astype(np.uint64) * _K1 + _K3)
    live, at = np.arange(len(starts)), starts
    left = size
    while len(live):
        h[live] = mix((h[live] ^ (eight[at] & _KEEP[np.minimum(left, 8)])) * _K1)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return h


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-word windows of a run of word hashes (empty if shorter)."""
    size = max(0, len(h) - n + 1)
    out = np.full(size, _K3)
    for k in range(n):
        out = mix((out ^ h[k : k + size]) * _K1 + np.uint64(k))
    return out
