"""Whole columns of texts as numpy arrays: bytes, words, lines and their hashes, without a Python step per word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of texts that are looked at together; a longer text is looked at alone.
BLOCK = 1 << 19
_RANDOM = np.random.default_rng(20240229)
_CODES = _RANDOM.integers(1, 2**63, 256, dtype=U64)
_BASES = [int(x) | 1 for x in _RANDOM.integers(2**62, 2**63, 4, dtype=U64)]
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(29)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(32)
    return x


def powers(kind: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2**64."""
    have = _POWERS.get(kind)
    if have is None or len(have[0]) < n:
        base = _BASES[kind]
        size = max(n, BLOCK + 4096)
        both = [np.full(size, x & (2**64 - 1), U64) for x in (base, pow(base, -1, 2**64))]
        for x in both:
            x[0] = 1
            np.multiply.accumulate(x, out=x)
        have = _POWERS[kind] = (both[0], both[1])
    return have


class Prefix:
    """Sums of values times powers, from which the hash of any stretch follows."""

    def __init__(self, values: np.ndarray, kind: int = 0) -> None:
        self.values = values
        self.up, self.down = powers(kind, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, U64)
        np.cumsum(values * self.up[: len(values)], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U64))


def count_in(mask: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """True values in each stretch."""
    sums = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    return sums[end] - sums[start]


@dataclass
class Block:
    """Some texts in a row: text i of the block is data[start[i]:end[i]]; first is the place of text 0 in its batch."""

    first: int
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    _memo: dict = field(default_factory=dict)

    def __len__(self) -> int:
        return len(self.start)

    def _once(self, name: str, make):
        if name not in self._memo:
            self._memo[name] = make()
        return self._memo[name]

    @property
    def space(self) -> np.ndarray:
        return self._once("space", lambda: SPACE[self.data])

    @property
    def bytes_prefix(self) -> Prefix:
        return self._once("prefix", lambda: Prefix(_CODES[self.data]))

    @property
    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of words; none spans two texts."""
        return self._once("words", self._words)

    def _words(self) -> tuple[np.ndarray, np.ndarray]:
        edge = np.zeros(len(self.data) + 1, bool)
        edge[self.start] = edge[self.end] = True
        gap = np.ones(len(self.data) + 2, bool)
        gap[1:-1] = self.space
        inside = ~gap[1:-1]
        return np.flatnonzero(inside & (gap[:-2] | edge[:-1])), np.flatnonzero(inside & (gap[2:] | edge[1:])) + 1

    @property
    def word_range(self) -> tuple[np.ndarray, np.ndarray]:
        """First word of each text, and the word behind its last."""
        starts, _ = self.words
        return self._once("range", lambda: (np.searchsorted(starts, self.start), np.searchsorted(starts, self.end)))

    @property
    def word_text(self) -> np.ndarray:
        low, high = self.word_range
        return self._once("text", lambda: np.repeat(np.arange(len(self)), high - low))

    @property
    def word_hash(self) -> np.ndarray:
        return self._once("hash", lambda: self.bytes_prefix.hash(*self.words))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all runs of size words within a text, and the runs' hashes."""
        text, n = self.word_text, len(self.word_text)
        if n < size:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        first = np.flatnonzero(text[: n - size + 1] == text[size - 1 :])
        return first, Prefix(self.word_hash, 1).hash(first, first + size)


def blocks(texts: pa.Array, lower: bool = False) -> Iterator[Block]:
    """A column of texts (null: empty) as blocks of about BLOCK bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, side="right")) - 1)
        to = min(to, len(texts), at + 60_000)
        part = data[offsets[at] : offsets[to]]
        base = offsets[at]
        yield Block(at, LOWER[part] if lower else part, offsets[at:to] - base, offsets[at + 1 : to + 1] - base)
        at = to


def sorted_within(text: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Order by text, then value. text: small whole numbers."""
    order = np.argsort(value)
    return order[np.argsort(text[order].astype(np.uint16), kind="stable")]


def distinct_within(text: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, value), in order."""
    order = sorted_within(text, value)
    text, value = text[order], value[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    return text[new], value[new]
