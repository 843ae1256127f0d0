"""Text as numpy arrays: code points, runs, rolling hashes and a hash index.

Texts of a record batch are concatenated and handled with whole-array
operations; nothing here loops over characters.  Chunks are bounded by
``CHUNK_CHARS`` so the memory of a worker does not follow the batch size.
"""

from __future__ import annotations

from functools import cache

import numpy as np

U64 = np.uint64
CHUNK_CHARS = 1 << 20
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3

#: The code points of Unicode's White_Space property.
WHITE_SPACE = (
    *range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def splitmix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over an array of unsigned 64-bit values."""
    x = x.astype(U64) + U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@cache
def char_classes() -> np.ndarray:
    """OTHER, LETTER, NUMBER or SPACE for every code point."""
    import regex

    table = np.zeros(0x110000, np.uint8)
    everything = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, everything):
            a, b = ord(m[0][0]), ord(m[0][-1])
            table[a : b + 1] = kind
    table[0xD800:0xE000] = OTHER
    table[list(WHITE_SPACE)] = SPACE
    return table


@cache
def word_classes() -> np.ndarray:
    """True for letters, numbers, marks and the underscore: what words are made of."""
    import regex

    table = np.zeros(0x110000, bool)
    everything = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for m in regex.finditer(r"[\p{L}\p{N}\p{M}_]+", everything):
        table[ord(m[0][0]) : ord(m[0][-1]) + 1] = True
    table[0xD800:0xE000] = False
    return table


@cache
def _mix_table() -> np.ndarray:
    return splitmix(np.arange(0x110000, dtype=U64))


_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK_CHARS + 1)
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            p = np.full(size, base, U64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=U64)
    return _powers[0][:n], _powers[1][:n]


class Prefix:
    """Prefix sums from which the 64-bit hash of any slice is read in O(1)."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        power, self._inverse = _power_tables(n + 1)
        self._sum = np.zeros(n + 1, U64)
        np.cumsum(_mix_table()[symbols] * power[:n], out=self._sum[1:])

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self._sum[end] - self._sum[start]) * self._inverse[start]
        h ^= (end - start).astype(U64) * U64(0xD6E8FEB86659FD93)
        h ^= h >> U64(32)
        h *= U64(0xFF51AFD7ED558CCD)
        h ^= h >> U64(29)
        return h


def codepoints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the concatenation, and the offsets at which texts begin (and end)."""
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    off = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=off[1:])
    return cp, off


def chunks(texts: list[str], limit: int = CHUNK_CHARS):
    """(from, to) ranges of ``texts`` with about ``limit`` characters each."""
    begin = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield begin, k
            begin, size = k, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def word_spans(cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of word characters; runs end where a text ends."""
    if not len(cp):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    w = word_classes()[cp]
    first = np.zeros(len(cp) + 1, bool)
    first[off] = True
    before = np.zeros(len(cp), bool)
    before[1:] = w[:-1]
    start = np.flatnonzero(w & (~before | first[:-1]))
    after = np.zeros(len(cp), bool)
    after[:-1] = w[1:]
    end = np.flatnonzero(w & (~after | first[1:])) + 1
    return start, end


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-case words of ``texts`` in order, and the offsets per text.

    A text longer than a chunk is cut at spaces, so that memory stays bounded
    by its number of words rather than by its characters.
    """
    parts, counts = [], np.zeros(len(texts), np.int64)
    for a, b in chunks(texts):
        pieces, owner = [], []
        for k in range(a, b):
            for piece in cut_at_spaces(texts[k].lower()):
                pieces.append(piece)
                owner.append(k)
        for x, y in chunks(pieces):
            cp, off = codepoints(pieces[x:y])
            s, e = word_spans(cp, off)
            if len(s):
                parts.append(Prefix(cp).slices(s, e))
                n = np.diff(np.searchsorted(s, off))
                np.add.at(counts, owner[x:y], n)
    out = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return (np.concatenate(parts) if parts else np.zeros(0, U64)), out


def cut_at_spaces(text: str, limit: int = CHUNK_CHARS) -> list[str]:
    """Pieces of at most about ``limit`` characters, cut where a run of white space begins.

    No word and no pre-token spans such a place.  A text without white space
    stays whole.
    """
    if len(text) <= limit:
        return [text]
    out, begin = [], 0
    while len(text) - begin > limit:
        k = begin + limit
        while k < len(text) and not (text[k].isspace() and ord(text[k]) in _WHITE and ord(text[k - 1]) not in _WHITE):
            k += 1
        if k >= len(text):
            break
        out.append(text[begin:k])
        begin = k
    out.append(text[begin:])
    return out


_WHITE = frozenset(WHITE_SPACE)


class HashIndex:
    """Open addressing over numpy arrays: 64-bit keys to 32-bit values, probed for whole arrays."""

    def __init__(self, bits: int = 16):
        self._make(bits)

    def _make(self, bits: int) -> None:
        self.bits, self.used = bits, 0
        self._key = np.zeros(1 << bits, U64)
        self._value = np.zeros(1 << bits, np.int32)

    def _home(self, h: np.ndarray) -> np.ndarray:
        return ((h * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    @staticmethod
    def _nonzero(h: np.ndarray) -> np.ndarray:
        return np.where(h == 0, U64(1), h)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where it is missing."""
        h = self._nonzero(h)
        out = np.full(len(h), -1, np.int32)
        at = self._home(h)
        there = self._key[at]
        hit = there == h
        out[hit] = self._value[at[hit]]
        left = np.flatnonzero(~hit & (there != 0))
        at, mask = at[left], (1 << self.bits) - 1
        while len(left):
            at = (at + 1) & mask
            there = self._key[at]
            hit = there == h[left]
            out[left[hit]] = self._value[at[hit]]
            go = ~hit & (there != 0)
            left, at = left[go], at[go]
        return out

    def add(self, h: np.ndarray, value: np.ndarray) -> None:
        """Adds distinct keys that are not there yet."""
        h = self._nonzero(h)
        if (self.used + len(h)) * 2 > 1 << self.bits:
            full = self._key != 0
            old, old_value, bits = self._key[full], self._value[full], self.bits
            while (len(old) + len(h)) * 2 > 1 << bits:
                bits += 1
            self._make(bits)
            self._put(old, old_value)
        self._put(h, value.astype(np.int32))

    def _put(self, h: np.ndarray, value: np.ndarray) -> None:
        self.used += len(h)
        at, mask = self._home(h), (1 << self.bits) - 1
        while len(h):
            free = self._key[at] == 0
            self._key[at[free]] = h[free]
            mine = free & (self._key[at] == h)
            self._value[at[mine]] = value[mine]
            h, value, at = h[~mine], value[~mine], (at[~mine] + 1) & mask


def ragged(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Positions begin, begin + 1, ... of each piece, one piece after the other."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(length)
    out = np.arange(total, dtype=np.int64)
    out += np.repeat(begin - (ends - length), length)
    return out
