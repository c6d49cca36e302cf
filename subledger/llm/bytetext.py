"""Vectorised work on UTF-8 texts inside Arrow tasks: rows of bytes, words, rolling hashes.

Texts are taken as the concatenated UTF-8 bytes of an Arrow string column and
cut into pieces of about ``PIECE`` bytes (a single longer text is a piece of its
own), so memory per task does not depend on the number of rows in a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 21

# Fixed parameters of the hashes: odd multipliers and a seeded byte table.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SLOTS = np.random.default_rng(20240612).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words ``[^\x20\x09-\x0D]+``.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``: digits, a-z and every byte of other code points.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_powers = (np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i < n, modulo 2^64."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, PIECE)
        up, down = np.full(size, _BASE), np.full(size, _INVERSE)
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def pieces(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets) of runs of rows; null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    i, n = 0, len(texts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] = BASE^i * hash(data[i:j])."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[data] * powers(len(data))[0], out=out[1:])
    return out


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of every maximal run of word bytes; runs never cross rows."""
    inside = is_word[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = offsets[:-1] < offsets[1:]
    at = offsets[:-1][full]
    first[at] = inside[at]
    at = offsets[1:][full] - 1
    last[at] = inside[at]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return np.searchsorted(offsets, start, "right") - 1, start, end


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    s = prefix_hash(data)
    h = (s[end] - s[start]) * powers(len(data) + 1)[1][start]
    return mix(h + (end - start).astype(np.uint64) * _SLOTS[63])


def sequence_hash(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each ``width`` consecutive values (len(h) - width + 1 of them)."""
    n = max(0, len(h) - width + 1)
    out = np.full(n, width, dtype=np.uint64) * _SLOTS[62]
    for t in range(width if n else 0):
        out += h[t : t + n] * _SLOTS[t % 62]
    return mix(out)


def shingle_sets(texts: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes (int64) of its ``width``-word shingles.

    ASCII letters are lower-cased.  A text of fewer words has one shingle, its
    whole sequence; a text without words has none.
    """
    for i, j, raw, offsets in pieces(texts):
        data = LOWER[raw]
        row, start, end = words(data, offsets, SPACED)
        h = word_hashes(data, start, end)
        bounds = np.searchsorted(row, np.arange(j - i + 1))
        runs = sequence_hash(h, width)
        for r in range(j - i):
            a, b = bounds[r], bounds[r + 1]
            if b - a >= width:
                s = runs[a : b - width + 1]
            elif b > a:
                s = sequence_hash(h[a:b], int(b - a))
            else:
                s = runs[:0]
            yield np.unique(s.view(np.int64))
