"""Words and n-grams of Arrow text columns as 64-bit hashes, one numpy pass per chunk of bytes.

A word's hash is a polynomial over random byte values, read off one running sum, so that
no Python object is made per word. Chunks hold whole texts: about ``CHUNK`` bytes, or one
longer text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
BASE = 0x9E3779B97F4A7C13  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: a bijection of 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Alphabet:
    """Which bytes make words; A-Z is lower-cased."""

    def __init__(self, is_word) -> None:
        fold = [b + 32 if 65 <= b <= 90 else b for b in range(256)]
        self.mask = np.array([bool(is_word(b)) for b in fold])
        random = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
        self.values = np.where(self.mask, random[fold], np.uint64(0))


#: ``[^\x20\x09-\x0D]+`` of lower-cased text.
NOT_SPACE = Alphabet(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased text: digits, a-z and all beyond ASCII.
ALPHANUMERIC = Alphabet(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)


class Words(NamedTuple):
    hash: np.ndarray  # uint64
    doc: np.ndarray  # number of the text in its chunk
    start: np.ndarray  # byte offsets in the chunk
    end: np.ndarray


class Chunk(NamedTuple):
    first: int  # number of the chunk's first text in its batch
    data: np.ndarray  # uint8
    bounds: np.ndarray  # where each text begins, and the end

    @property
    def n(self) -> int:
        return len(self.bounds) - 1


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, _INVERSE)):
            steps = np.full(max(n, CHUNK + 1), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


def texts_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and where each text begins; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def chunks_of(column: pa.Array | pa.ChunkedArray, size: int = CHUNK) -> Iterator[Chunk]:
    data, bounds = texts_of(column)
    first, n = 0, len(bounds) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + size, "right")) - 1)
        yield Chunk(first, data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first])
        first = last


def words_of(chunk: Chunk, alphabet: Alphabet) -> Words:
    data, bounds = chunk.data, chunk.bounds
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, none)
    inside = alphabet.mask[data]
    edge = np.zeros(n + 1, bool)  # an edge lies before byte i
    edge[bounds] = True
    before = np.concatenate(([False], inside))[:-1] & ~edge[:-1]
    after = np.concatenate((inside, [False]))[1:] & ~edge[1:]
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    powers, inverses = _power_tables(n)
    total = np.cumsum(alphabet.values[data] * powers[:n])
    value = total[end - 1] - np.where(start > 0, total[start - 1], np.uint64(0))
    doc = np.searchsorted(bounds, start, "right") - 1
    return Words(mix(value * inverses[start] + (end - start).astype(np.uint64)), doc, start, end)


_FACTORS = mix(np.arange(101, 165, dtype=np.uint64)) | np.uint64(1)


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` neighbouring hashes (none if there are fewer)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, n, np.uint64)
    for k in range(n):
        out = out + hashes[k : k + m] * _FACTORS[k]
    return mix(out)


def first_words(doc: np.ndarray, n: int) -> np.ndarray:
    """Where each of ``n`` texts begins among the words, and the end."""
    return np.searchsorted(doc, np.arange(n + 1))


def shingle_sets(chunk: Chunk, alphabet: Alphabet, n: int) -> Iterator[tuple[np.ndarray, int]]:
    """For each text its distinct ``n``-word shingles, sorted, and its number of words.

    A text of fewer words, but not none, has the whole sequence as its one shingle.
    """
    found = words_of(chunk, alphabet)
    begins = first_words(found.doc, chunk.n)
    grams = ngrams(found.hash, n)
    for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
        if b - a >= n:
            yield np.unique(grams[a : b - n + 1]), b - a
        else:
            yield (ngrams(found.hash[a:b], b - a) if b > a else grams[:0]), b - a
