"""Words of texts as positions in their bytes, and hashes of words and word sequences.

Nothing is made for a single word: a text's words are found, and hashed, by a few passes
over its bytes, and nothing is remembered from text to text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash

_MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9E3779B97F4A7C15)
# What cuts words: space and U+0009 to U+000D.
_CUTS = np.zeros(256, bool)
_CUTS[[0x20, *range(0x09, 0x0E)]] = True
_TO_SPACE = bytes(0x20 if cut else byte for byte, cut in enumerate(_CUTS))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(_MIX[0])
    h = (h ^ (h >> np.uint64(33))) * np.uint64(_MIX[1])
    return h ^ (h >> np.uint64(33))


# A word's hash is a polynomial of its bytes' values in _BASE, modulo 2^64; bytes between words are 0.
# Bytes that are hashed at once; the two tables below are 2 MB each.
CHUNK = 1 << 18
_BASE = _MIX[2]
_VALUES = np.where(_CUTS, np.uint64(0), mixed(np.arange(1, 257, dtype=np.uint64)))
_POWERS = np.cumprod(np.r_[np.uint64(1), np.full(CHUNK - 1, _BASE, np.uint64)])
_INVERSES = np.cumprod(np.r_[np.uint64(1), np.full(CHUNK - 1, pow(_BASE, -1, 1 << 64), np.uint64)])


class Words(NamedTuple):
    """Where a text's words begin and end in its bytes, and their hashes."""

    start: np.ndarray
    end: np.ndarray
    hashes: np.ndarray


def text_bytes(column: pa.Array) -> Iterator[np.ndarray]:
    """The UTF-8 bytes of each text of a string column, not copied; a null text has none."""
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    every = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    ends = at.tolist()
    for begin, end in zip(ends, ends[1:]):
        yield every[begin:end]


def single_spaced(text: np.ndarray) -> bytes:
    """The text's words with one space between them."""
    out = text.tobytes().translate(_TO_SPACE).strip(b" ")
    return b" ".join(out.split()) if b"  " in out else out


def words_of(text: np.ndarray, lower: bool = False) -> Words:
    """The words of a text's bytes, with A-Z as a-z if ``lower``."""
    if lower:
        text = _LOWER[text]
    inside = np.zeros(len(text) + 2, np.int8)
    inside[1:-1] = ~_CUTS[text]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    return Words(start, end, _hashes(text, start, end))


def _hashes(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        first = int(start[at])
        stop = max(int(np.searchsorted(end, first + CHUNK, side="right")), at + 1)
        last = int(end[stop - 1])
        if last - first > CHUNK:  # one word that is longer than the tables
            out[at] = xxhash.xxh3_64_intdigest(text[first:last].tobytes())
        else:
            begin = start[at:stop] - first
            terms = _VALUES[text[first:last]] * _POWERS[: last - first]
            out[at:stop] = np.add.reduceat(terms, begin) * _INVERSES[begin]
        at = stop
    return mixed(out)


def sequence_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """One hash for each ``size`` consecutive words."""
    count = len(words) - size + 1
    h = np.full(count, size, np.uint64)
    for k in range(size):
        h *= np.uint64(_MIX[1])
        h += words[k : k + count]
    return mixed(h)


def shingles(text: np.ndarray, size: int) -> np.ndarray:
    """Sorted hashes of the distinct word n-grams, A-Z lower-cased; a shorter text is one n-gram."""
    words = words_of(text, lower=True).hashes
    if not len(words):
        return np.empty(0, np.int64)
    return np.unique(sequence_hashes(words, min(size, len(words))).view(np.int64))
