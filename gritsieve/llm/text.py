"""Vectorised text helpers shared by the training-data operators.

Everything here works on one Arrow batch inside a task: Spark has already
partitioned the rows.  Texts are cut into slices of a few megabytes so that the
working arrays stay small whatever the batch size is.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer single text makes a slice of its own.
SLICE_BYTES = 1 << 20

#: Ranges beyond so many bytes are hashed piece by piece.
LONG_SPAN = 1024

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_STEP = np.uint64(0x9FB21C651E98DF25)
#: Which of eight bytes a range of so many bytes has.
_HEADS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes that end a word of letters and digits: ASCII punctuation, white space and controls.
PUNCTUATION = np.ones(256, bool)
PUNCTUATION[128:] = False
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    PUNCTUATION[_a:_b] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n of each."""
    if len(_powers[0]) >= n:
        return _powers[0][:n], _powers[1][:n]
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(n, base & _MASK, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    if n <= 2 * SLICE_BYTES:
        _powers[:] = out
    return out[0], out[1]


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null has no bytes."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES):
    """Ranges of rows whose texts have at most `most` bytes together, or one row."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end
        row = end


def give_back() -> None:
    """Return free memory to the system, as workers live on through tasks of many kinds."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def text_slices(column: pa.Array, most: int = SLICE_BYTES):
    """(first row, end row, bytes, offsets) for each slice of a string column."""
    data, offsets = string_buffers(column)
    for a, b in slices(offsets, most):
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
    give_back()


def word_spans(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = _WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and how many words each text has.

    A word is a maximal run of bytes that `breaks` does not mark, by default of bytes
    other than 0x20 and 0x09-0x0D; words never cross from one text to the next.
    """
    n = len(data)
    if n == 0:
        zero = np.zeros(0, np.int64)
        return zero, zero, np.zeros(len(offsets) - 1, np.int64)
    solid = ~breaks[data]
    begins, closes = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    closes[:-1] &= ~solid[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    begins[edges] = solid[edges]
    closes[edges - 1] = solid[edges - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one word; places beyond the end count as zero bytes."""
    words = np.zeros(len(data) + 8, np.uint64)
    words[: len(data)] = data
    for size in (1, 2, 4):
        words[:-size] |= words[size:] << np.uint64(8 * size)
    return words


def step(h: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Take one more word into each hash."""
    h = (h ^ value) * _STEP
    return h ^ (h >> np.uint64(32))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte ranges, mixed after every eight bytes; other seeds give independent ones."""
    n = ends - starts
    if len(n) == 0:
        return np.zeros(0, np.uint64)
    long = n > LONG_SPAN
    if long.any():
        # long ranges are hashed by the hashes of their pieces
        out = np.empty(len(n), np.uint64)
        out[~long] = span_hashes(data, starts[~long], ends[~long], seed)
        count = -(-n[long] // LONG_SPAN)
        piece = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        first = np.repeat(starts[long], count) + piece * LONG_SPAN
        inner = span_hashes(data, first, np.minimum(first + LONG_SPAN, np.repeat(ends[long], count)), seed)
        close = np.cumsum(count) * 8
        out[long] = mix(span_hashes(inner.view(np.uint8), close - count * 8, close, seed) + n[long].astype(np.uint64))
        return out
    words = eights(data)
    h = step(mix(n.astype(np.uint64) + np.uint64((seed + 1) * _BASE & _MASK)), words[starts] & _HEADS[np.minimum(n, 8)])
    live, at = np.flatnonzero(n > 8), 8
    while len(live):
        h[live] = step(h[live], words[starts[live] + np.minimum(at, n[live] - 8)])
        at += 8
        live = live[n[live] > at]
    return mix(h)


class Prefixes:
    """Keys of many ranges of one buffer, from prefix sums.

    Equal contents have equal keys, but some unequal ones (Thue-Morse strings, for one) have too:
    a way to find candidates that are compared afterwards, never an identity.
    """

    def __init__(self, data: np.ndarray):
        powers, self.inverse = _power_tables(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=self.sums[1:])

    def keys(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.inverse[starts]


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes, so all non-ASCII letters, stay."""
    return _LOWER[data]


def hashed_words(data: np.ndarray, offsets: np.ndarray, lower: bool = True, breaks: np.ndarray = _WHITE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words of each text."""
    data = lowered(data) if lower else data
    starts, ends, counts = word_spans(data, offsets, breaks)
    return span_hashes(data, starts, ends), counts


def shingles(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text (with fewer words: the whole text as one) and their counts."""
    ends = np.cumsum(counts)
    starts = ends - counts
    number = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    row = np.repeat(np.arange(len(counts)), number)
    at = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number) + starts[row]
    out = np.zeros(len(at), np.uint64)
    for j in range(k):
        there = at + j < ends[row]
        value = np.where(there, words[np.minimum(at + j, len(words) - 1)], np.uint64(0)) if len(words) else out
        out = (out + value) * np.uint64(0xD6E8FEB86659FD93 + 2 * j)
        out ^= out >> np.uint64(31)
    return mix(out + np.minimum(counts, k)[row].astype(np.uint64)), number
