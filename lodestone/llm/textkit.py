"""Whole-batch text primitives over Arrow buffers: words, shingles and rolling hashes without a loop over words.

A batch is cut into slices of about a megabyte (one document at least), so that the 8-byte temporaries of a slice
stay small whatever the size of the Arrow batch. Null texts count as empty. Words are maximal runs of bytes other
than space and 0x09-0x0D, the class [^\\x20\\x09-\\x0D]+ of code points, as those five bytes never occur inside a
longer UTF-8 sequence. Hashes are 64 bits wide and seeded by constants only, so every executor agrees on them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 19
_rng = np.random.default_rng(20240229)
TOKEN = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 1
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """The splitmix64 finaliser, a bijection of 64 bits."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2 ** 64; kept for slices of the usual size."""
    if base not in _powers or len(_powers[base]) < n:
        size = max(n, SLICE + 1)
        made = np.full(size, base, np.uint64)
        made[0] = 1
        made = np.cumprod(made)
        if size > 16 * SLICE:
            return made
        _powers[base] = made
    return _powers[base][:n]


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values between neighbouring offsets; empty ranges give 0.

    Floats are added range by range, so a sum does not depend on what stands before its range.
    """
    if values.dtype.kind == "f":
        return np.bincount(np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)), values, len(offsets) - 1).astype(np.float64)
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


@dataclass
class Slice:
    """Documents first..last of a batch: raw bytes and the offsets of each document in them."""

    first: int
    raw: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @cached_property
    def lower(self) -> np.ndarray:
        return LOWER[self.raw]

    @cached_property
    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of all words."""
        word = ~SPACE[self.raw]
        edge = self.offsets[:-1][self.offsets[:-1] < len(word)]
        before = np.zeros(len(word), bool)
        before[1:] = word[:-1]
        before[edge] = False
        after = np.zeros(len(word), bool)
        after[:-1] = word[1:]
        after[edge[edge > 0] - 1] = False
        return np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1

    @cached_property
    def doc(self) -> np.ndarray:
        """The document of each word."""
        return np.searchsorted(self.offsets[1:], self.bounds[0], "right")

    @cached_property
    def word_offsets(self) -> np.ndarray:
        """The first word of each document, and the number of words at last."""
        return np.concatenate([[0], np.cumsum(np.bincount(self.doc, minlength=len(self)))])

    def prefix(self, lower: bool, base: int = BASE) -> np.ndarray:
        data = self.lower if lower else self.raw
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(TOKEN[data] * powers(base, len(data)), out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASE) -> np.ndarray:
        """Hashes of byte ranges, by difference of prefix sums; equal bytes give equal hashes."""
        inverse = powers(pow(base, -1, 1 << 64), len(prefix))
        return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))

    def words(self, lower: bool = True) -> np.ndarray:
        """A hash for each word."""
        start, end = self.bounds
        return self.spans(self.prefix(lower), start, end)

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each document are flagged."""
        return sums(flags.astype(np.int64), self.offsets)


def slices(texts: pa.Array | pa.ChunkedArray, limit: int = SLICE) -> Iterator[Slice]:
    pa.set_memory_pool(pa.system_memory_pool())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if not len(texts):
        return
    offsets = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield Slice(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def shingles(part: Slice, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed word shingles, sorted inside each document, and their offsets by document.

    A document of fewer than `width` words has its whole sequence as one shingle; one without words has none.
    """
    return distinct(*windows(part.words(), part.word_offsets, width), len(part))


def windows(words: np.ndarray, offsets: np.ndarray, width: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of `width` words inside documents, and their documents; `short`: whole texts of fewer words too."""
    counts = np.diff(offsets)
    doc = np.repeat(np.arange(len(counts)), np.maximum(counts - width + 1, 0))
    made = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for i in range(width if len(made) else 0):
        made = made + mix(words[i : len(words) - width + 1 + i], i + 1)
    start = np.arange(len(made))
    last = np.repeat(offsets[1:], counts)[: len(made)]
    made = mix(made[start + width <= last], 77)
    if short and width > 1:
        few = np.flatnonzero((counts > 0) & (counts < width))
        extra = np.array([np.sum(mix(words[offsets[d] : offsets[d + 1]], 101) * powers(BASE, width)[1 : counts[d] + 1], dtype=np.uint64) for d in few], np.uint64)
        made, doc = np.concatenate([made, mix(extra, 79)]), np.concatenate([doc, few])
    return made, doc


def distinct(made: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((made, doc))
    made, doc = made[order], doc[order]
    new = np.ones(len(made), bool)
    new[1:] = (made[1:] != made[:-1]) | (doc[1:] != doc[:-1])
    return made[new], np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=n))])


class Lookup:
    """A hash table from distinct 64-bit keys to values, built and asked in whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing=0):
        bits = max(4, int(len(keys) * 2).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.zeros(1 << bits, np.int64), np.full(1 << bits, missing, values.dtype)
        self.full = np.zeros(1 << bits, bool)
        self.missing = missing
        keys, at, which = keys.astype(np.int64), self._slot(keys), np.arange(len(keys))
        while len(which):
            free = which[~self.full[at[which]]]
            self.keys[at[free]] = keys[free]  # of several for one slot the last stays
            self.full[at[free]] = True
            won = self.keys[at[which]] == keys[which]
            done = which[won]
            self.values[at[done]] = values[done]
            which = which[~won]
            at[which] = (at[which] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(np.int64)
        at = self._slot(keys)
        out = self.values[at]
        odd = np.flatnonzero((self.keys[at] != keys) | ~self.full[at])
        if len(odd):
            out[odd] = self.missing
            odd = odd[self.full[at[odd]]]
        while len(odd):
            at[odd] = (at[odd] + 1) & self.mask
            hit = self.full[at[odd]] & (self.keys[at[odd]] == keys[odd])
            out[odd[hit]] = self.values[at[odd[hit]]]
            odd = odd[~hit & self.full[at[odd]]]
        return out
