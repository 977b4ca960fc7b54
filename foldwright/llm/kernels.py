"""Vectorised text hashing inside tasks: words, shingles and byte windows of an Arrow column of texts.

All hashes are polynomials modulo 2 ** 64 over random byte values, with prefix sums, so the hash of any span of a batch
costs a few operations. Batches are cut into chunks of bounded bytes (a longer text is a chunk of its own), so a worker
holds a few arrays of eight bytes for each byte of a chunk; no result depends on where chunks end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
#: Longest table of powers that stays between calls.
KEPT_POWERS = 1 << 21
#: Odd base of the polynomials, its inverse modulo 2 ** 64, seed of the byte values, finishing multipliers.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
BYTE_SEED = 8191
FINISH_1 = np.uint64(0xBF58476D1CE4E5B9)
FINISH_2 = np.uint64(0x94D049BB133111EB)
SPACES = (32, 9, 10, 11, 12, 13)

_VALUES = np.random.RandomState(BYTE_SEED).randint(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_IS_SPACE = np.isin(np.arange(256), SPACES)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1); tables up to KEPT_POWERS are kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(1 << max(n - 1, 1).bit_length(), base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if len(have) <= KEPT_POWERS:
            _powers[base] = have
    return have[:n]


def finish(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(30))) * FINISH_1
    x = (x ^ (x >> np.uint64(27))) * FINISH_2
    return x ^ (x >> np.uint64(31))


def chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in the bytes) of the chunks of a text column; null is empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


class Spans:
    """Hashes of the spans of one chunk."""

    def __init__(self, data: np.ndarray):
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUES[data] * powers(BASE, len(data)), out=self.prefix[1:])
        self.inverse = powers(BASE_INVERSE, len(data) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return finish((self.prefix[end] - self.prefix[start]) * self.inverse[start] + (end - start).astype(np.uint64))

    def windows(self, size: int) -> np.ndarray:
        """Hashes of all spans of ``size`` bytes, without the length."""
        n = len(self.prefix) - size
        return finish((self.prefix[size:] - self.prefix[:n]) * self.inverse[:n]) if n > 0 else np.zeros(0, np.uint64)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the words before each row (row r has the words counts[r] to counts[r + 1])."""
    inside = ~_IS_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.concatenate(([False], inside[:-1])) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.concatenate((inside[1:], [False])) if len(data) else inside
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = 5, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the word shingles of a chunk in order, the shingles before each row, and the word spans.

    A row of fewer words than ``size`` has one shingle of all its words, a row without words none. Only A-Z are lowered.
    """
    if lower:
        data = _LOWER[data]
    starts, ends, counts = word_spans(data, offsets)
    n_words = np.diff(counts)
    n_out = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    out_at = np.concatenate(([0], np.cumsum(n_out)))
    if not len(starts):
        return np.zeros(0, np.uint64), out_at, starts, counts
    # a word's hash with its length, then a polynomial over words
    words = Spans(data).of(starts, ends)
    prefix = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(BASE, len(words)), out=prefix[1:])
    inverse = powers(BASE_INVERSE, len(words) + 1)
    first = np.repeat(counts[:-1] - out_at[:-1], n_out) + np.arange(out_at[-1])
    width = np.repeat(np.minimum(n_words, size), n_out)
    return finish((prefix[first + width] - prefix[first]) * inverse[first] + width.astype(np.uint64)), out_at, first, counts


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest value (leftmost of equals, by the upper 38 bits) of each window of ``width`` values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    bits = np.uint64(max(len(values).bit_length(), 1))
    packed = ((values >> np.uint64(26)) << np.uint64(26)) if bits <= 26 else (values >> bits) << bits
    packed = packed | np.arange(len(values), dtype=np.uint64)
    reach = 1
    while reach * 2 <= width:
        packed = np.minimum(packed[:-reach], packed[reach:])
        reach *= 2
    if reach < width:
        packed = np.minimum(packed[: len(packed) - (width - reach)], packed[width - reach :])
    mask = np.uint64((1 << 26) - 1) if bits <= 26 else (np.uint64(1) << bits) - np.uint64(1)
    return (packed & mask).astype(np.int64)
