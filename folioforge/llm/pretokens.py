"""Pre-tokens of byte-level BPE vocabularies, found with array operations.

The split is that of ``public_tokenizers.PATTERN``: contractions, letters,
digits and other signs with an optional leading space, and white space of
which the last character belongs to what follows it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .textnum import LETTER, OTHER, SPACE, HashIndex, Prefix, char_classes, chunks, codepoints, cut_at_spaces

#: The endings of the contraction rules in the split pattern.
SHORT_ENDINGS, LONG_ENDINGS = ("s", "t", "m", "d"), ("re", "ve", "ll")


def starts(cp: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Positions in ``cp`` at which a pre-token begins; texts begin at ``off``."""
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    kind = char_classes()[cp]
    first = np.zeros(n + 3, bool)
    first[off] = True
    first[n:] = True
    start = first[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    last = space.copy()
    last[:-1] &= ~space[1:]
    last &= ~first[1 : n + 1]
    start |= last
    start[1:] &= ~(last & (cp == 32))[:-1]

    q = np.flatnonzero((cp == 39) & start & ~first[1 : n + 1])
    q = q[kind[q + 1] == LETTER] if len(q) else q
    if len(q):
        one = cp[q + 1]
        two = np.where(first[q + 2], 0, cp[np.minimum(q + 2, n - 1)])
        size = np.where(np.isin(one, [ord(x) for x in SHORT_ENDINGS]), 2, 0)
        for a, b in LONG_ENDINGS:
            size[(one == ord(a)) & (two == ord(b))] = 3
        q, size = q[size > 0], size[size > 0]
        start[q + 1] = False
        end = q + size
        end = end[~first[end]]
        start[end[kind[end] == LETTER]] = True
    return np.flatnonzero(start)


class PieceCache:
    """Pieces of distinct pre-tokens, worked out once in a worker and then looked up by hash.

    ``encode`` turns a list of pre-tokens into (flat ids, counts).  Once
    ``limit`` pre-tokens are held the cache starts anew; results never depend on it.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = 1_000_000, keep_ids: bool = True):
        self.encode, self.limit, self.keep_ids = encode, limit, keep_ids
        self._clear()

    def _clear(self) -> None:
        self.index = HashIndex()
        self.count = np.zeros(1 << 16, np.int32)
        self.begin = np.zeros(1 << 16, np.int64)
        self.ids = np.zeros(1 << 18, np.int32)
        self.size = self.filled = 0

    @staticmethod
    def _room(a: np.ndarray, need: int) -> np.ndarray:
        if need <= len(a):
            return a
        out = np.zeros(max(need, 2 * len(a)), a.dtype)
        out[: len(a)] = a
        return out

    def look_up(self, text: str, h: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """The number of each pre-token ``text[s:e]`` in this cache; valid until the next call."""
        if self.size > self.limit:
            self._clear()
        at = self.index.find(h)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new, one = np.unique(h[missing], return_index=True)
            which = missing[one]
            self._add(new, [text[a:b] for a, b in zip(s[which].tolist(), e[which].tolist())])
            at[missing] = self.index.find(h[missing])
        return at

    def _add(self, new: np.ndarray, words: list[str]) -> None:
        ids, count = self.encode(words)
        a, b = self.size, self.size + len(words)
        self.count, self.begin = self._room(self.count, b), self._room(self.begin, b)
        self.count[a:b] = count
        if self.keep_ids:
            self.begin[a:b] = self.filled + np.cumsum(count) - count
            self.ids = self._room(self.ids, self.filled + len(ids))
            self.ids[self.filled : self.filled + len(ids)] = ids
            self.filled += len(ids)
        self.index.add(new, np.arange(a, b))
        self.size = b


def split_texts(texts: list[str], special: str | None = None):
    """Yields (text, pre-token hashes, starts, ends, owner of each, owners of special strings) by chunk.

    ``owner`` is the number of the text in ``texts``.  Occurrences of
    ``special`` are cut out and reported as -1 in ``hash index`` order: they
    come as rows with start == end.
    """
    pieces: list[str] = []
    owner: list[int] = []
    mark: list[bool] = []
    for k, t in enumerate(texts):
        whole = t.split(special) if special and special in t else [t]
        for j, part in enumerate(whole):
            if j:
                pieces.append("")
                owner.append(k)
                mark.append(True)
            for x in cut_at_spaces(part):
                pieces.append(x)
                owner.append(k)
                mark.append(False)
    own, marked = np.array(owner, np.int64), np.array(mark, bool)
    for a, b in chunks(pieces):
        part = pieces[a:b]
        cp, off = codepoints(part)
        s = starts(cp, off)
        e = np.append(s[1:], len(cp)) if len(s) else s
        h = Prefix(cp).slices(s, e) if len(s) else np.zeros(0, np.uint64)
        o = own[a:b][np.searchsorted(off, s, side="right") - 1]
        if marked[a:b].any():
            special_at = off[:-1][marked[a:b]]
            at = np.searchsorted(s, special_at, side="left")
            s, e = np.insert(s, at, special_at), np.insert(e, at, special_at)
            h, o = np.insert(h, at, 0), np.insert(o, at, own[a:b][marked[a:b]])
        yield "".join(part), h, s, e, o


__all__ = ["OTHER", "PieceCache", "split_texts", "starts"]
