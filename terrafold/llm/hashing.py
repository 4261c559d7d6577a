"""Word and word-window hashes of whole texts, vectorised over Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import ship

#: Bytes of text that are hashed at a time; a longer text is hashed alone, whole.
CHUNK = 1 << 20

_WINDOW = np.uint64(0xD6E8FEB86659FD93)
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: A word is hashed as a polynomial in its bytes modulo two primes, each with a base of its own: unlike powers modulo
#: 2^64, no pattern of bytes makes two words meet in both but by chance (about 1 in 2^62, times the square of their length).
PRIMES, BASES = (2147483647, 2147483629), (1540483477, 1779033703)
#: Bytes of a word from which on it is hashed by itself.
LONG_WORD = 1 << 16
#: Bytes of words that are hashed at a time, about.
SLICE = 1 << 18
_powers: dict[int, np.ndarray] = {}


def powers(k: int) -> np.ndarray:
    """Powers of a base modulo its prime, for every place in a word."""
    if k not in _powers:
        table = np.ones(1, np.int64)
        while len(table) < LONG_WORD:
            table = np.concatenate([table, table * pow(BASES[k], len(table), PRIMES[k]) % PRIMES[k]])
        _powers[k] = table
    return _powers[k]


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets in them) of runs of whole texts of about so many bytes. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each word, some hundred kilobytes of words at a time."""
    lengths, hashed = ends - starts, np.empty(len(starts), np.uint64)
    short, long_ = np.flatnonzero(lengths < LONG_WORD), np.flatnonzero(lengths >= LONG_WORD)
    total = np.cumsum(lengths[short])
    cuts = np.searchsorted(total, np.arange(SLICE, total[-1] + SLICE, SLICE), "right") if len(short) else []
    at = 0
    for cut in cuts:
        if cut > at:
            part = short[at:cut]
            first = np.cumsum(lengths[part]) - lengths[part]
            place = np.arange(first[-1] + lengths[part[-1]]) - np.repeat(first, lengths[part])
            value = data[place + np.repeat(starts[part], lengths[part])].astype(np.int64) + 1
            low, high = (np.add.reduceat(value * powers(k)[place], first) % PRIMES[k] for k in (0, 1))
            hashed[part] = (low << 32 | high).astype(np.uint64)
            at = cut
    for k in long_:
        hashed[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return mixed(hashed)


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each run of bytes that are inside words; runs end at row ends."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = np.zeros(len(data), bool), np.zeros(len(data), bool)
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    last[offsets[1:][offsets[1:] > 0] - 1] = True
    starts = np.flatnonzero(inside & (first | np.concatenate(([True], ~inside[:-1]))))
    ends = np.flatnonzero(inside & (last | np.concatenate((~inside[1:], [True])))) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def same_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether word a[k] has the bytes of word b[k], for each k; some hundred kilobytes of words at a time."""
    lengths = ends - starts
    same = lengths[a] == lengths[b]
    for k in np.flatnonzero(same & (lengths[a] >= LONG_WORD)):
        same[k] = np.array_equal(data[starts[a[k]] : ends[a[k]]], data[starts[b[k]] : ends[b[k]]])
    short = np.flatnonzero(same & (lengths[a] < LONG_WORD))
    total, at = np.cumsum(lengths[a[short]]), 0
    for cut in np.searchsorted(total, np.arange(SLICE, total[-1] + SLICE, SLICE), "right") if len(short) else []:
        if cut > at:
            part = short[at:cut]
            n = lengths[a[part]]
            first = np.cumsum(n) - n
            place = np.arange(first[-1] + n[-1]) - np.repeat(first, n)
            differ = data[place + np.repeat(starts[a[part]], n)] != data[place + np.repeat(starts[b[part]], n)]
            same[part] = ~np.logical_or.reduceat(differ, first)
            at = cut
    return same


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row and hash of each word; words end at row ends."""
    if lower:
        data = LOWER[data]
    starts, ends, row = spans(data, offsets, ~SEPARATOR[data])
    return starts, ends, row, word_hashes(data, starts, ends)


def rolling(hashed: np.ndarray, width: int, base: np.uint64 = _WINDOW) -> np.ndarray:
    """Hash of the so many words from each word on, row ends ignored."""
    total = np.zeros(max(0, len(hashed) - width + 1), np.uint64)
    for k in range(width if len(total) else 0):
        total = total * base + hashed[k : k + len(total)]
    return mixed(total)


def windows(hashed: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of so many words within a row, and the index of its first word."""
    total = rolling(hashed, width)
    at = np.flatnonzero(row[: len(total)] == row[width - 1 :]) if len(total) else np.zeros(0, np.int64)
    return total[at], at


ship(__name__)
