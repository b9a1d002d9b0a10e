"""Vectorised hashing of words, lines and shingles over the bytes of many texts at once.

A span of bytes is cut into pieces of eight. Each piece is mixed with a key of its place in the
span, by a bijection that spreads every bit, and the mixed pieces are summed; so a span hashes
alike wherever it stands, and no structure of texts (as of Thue and Morse's, on which polynomials
modulo a power of two fail) makes spans collide. Spans of 64-bit values are hashed likewise.
"""

from __future__ import annotations

import hashlib

import numpy as np

_C = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Keeps the first k bytes of a piece.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _keys(n: int) -> np.ndarray:
    """Of the places 0 to n - 1."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _C[0])


def _summed(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the runs of values that begin at first, none of them empty."""
    return np.add.reduceat(values, first) if len(first) else np.zeros(0, np.uint64)


def _places(size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For runs of these sizes, one after another: first index of each, and run and place of each element."""
    first = np.cumsum(size) - size
    run = np.repeat(np.arange(len(size)), size)
    return first, run, np.arange(len(run)) - first[run]


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    return data + (((data - np.uint8(65)) < 26).view(np.uint8) << 5)


def byte_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span of bytes."""
    eights = np.zeros((len(data) >> 3) + 2, np.uint64)
    eights.view(np.uint8)[: len(data)] = data
    size = end - start

    def piece(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        word, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
        return ((eights[word] >> shift) | (eights[word + 1] << (np.uint64(63) - shift) << np.uint64(1))) & _FIRST[np.minimum(left, 8)]

    out = mix(piece(start, size) ^ _C[1])
    long = np.flatnonzero(size > 8)
    if len(long):
        first, run, place = _places((size[long] - 1) >> 3)
        done = 8 * (place + 1)
        out[long] += _summed(mix(piece(start[long][run] + done, size[long][run] - done) + _keys(int(place.max()) + 1)[place]), first)
    return mix(out + size.astype(np.uint64) * _C[2])


def value_spans(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span of 64-bit values."""
    size = end - start
    full = np.flatnonzero(size)
    out = np.zeros(len(size), np.uint64)
    if len(full):
        first, run, place = _places(size[full])
        out[full] = _summed(mix(values[start[full][run] + place] + _keys(int(place.max()) + 1)[place]), first)
    return mix(out + size.astype(np.uint64) * _C[2])


def string_hash(s: str | None) -> int:
    """Signed 64 bits, the same on every machine; null has its own value."""
    return int.from_bytes(hashlib.blake2b(b"\x00" if s is None else b"\x01" + s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class Words:
    """Words of a run of texts: bytes `data`, `offsets` of the texts in it."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1
        solid = np.zeros(len(data) + 1, bool)
        np.logical_not(SPACE[data], out=solid[:-1])
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True  # a text's first byte starts a word, though a word may stand before it
        self.solid = solid[:-1]
        before = np.zeros(len(data) + 1, bool)
        before[1:] = self.solid
        starts = solid & (~before | first)
        ends = before & (~solid | first)
        self.start, self.end = np.flatnonzero(starts), np.flatnonzero(ends)
        self.text = np.searchsorted(offsets, self.start, "right") - 1
        self.count = np.bincount(self.text, minlength=self.n)
        self.first = np.concatenate(([0], np.cumsum(self.count)))

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sum of flags of bytes by text."""
        sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]

    def hashes(self, lower: bool = True) -> np.ndarray:
        return byte_spans(lowered(self.data) if lower else self.data, self.start, self.end)

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """First word and one past the last word of each line that has a word."""
        if not len(self.start):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        breaks = np.cumsum(self.data == 10)[self.start]
        new = np.ones(len(self.start), bool)
        new[1:] = (breaks[1:] != breaks[:-1]) | (self.text[1:] != self.text[:-1])
        first = np.flatnonzero(new)
        return first, np.concatenate((first[1:], [len(self.start)]))

    def line_bytes(self, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the whole lines, white space included."""
        nl = np.concatenate(([-1], np.flatnonzero(self.data == 10), [len(self.data)]))
        at = np.searchsorted(nl, self.start[first])
        text = self.text[first]
        return np.maximum(nl[at - 1] + 1, self.offsets[text]), np.minimum(nl[at], self.offsets[text + 1])


def windows(hashes: np.ndarray, text: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of `width` words within a text, and the index of its first word."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out += mix(hashes[k : k + n] + _C[k]) * (_C[(k + 1) % 8] | np.uint64(1))
    at = np.flatnonzero(text[:n] == text[width - 1 :])
    return mix(out[at]), at
