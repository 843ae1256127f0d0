"""External induced suffix sorting with common prefixes, with numpy.

Suffixes are classed as S (smaller than the next suffix) or L.  The
substrings between leftmost S suffixes are put in order by one induction and
named; where names repeat, the string of names is sorted by the same
procedure, one level down.  Its order, and its common prefixes turned into
symbols of this level, seed the last induction, which gives all suffixes.
Strings of names that fit into ``memory`` end the recursion and are sorted
there.

An induction is a priority queue.  It hands out tuples (suffix, length of the
prefix in common with the one handed out before) in order, and each puts its
predecessor into the queue.  Predecessors with one first symbol have one
symbol more in common than the least common prefix of what was handed out
between those that put them in.  As a predecessor's rank is its first symbol
and then the order of insertion, the queue is a row of first-in-first-out
buckets of symbols; a bucket of one symbol is handed out piece by piece, one
of several symbols is taken whole and handed out up to the first symbol to
which it still adds itself.

Tuples beyond ``memory`` bytes go to a file, and so does every array (text,
names, orders, common prefixes) larger than that; all else is done in blocks.
Files have no name, so they are gone with the task that made them.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np

#: Alphabets of at most this size have a bucket for each symbol.
ONE_SYMBOL = 512
#: Bytes of memory a name takes where a string of names is sorted in memory.
BASE_BYTES = 48


class Scratch:
    """Where the arrays of one sort live: in memory up to ``memory`` bytes each, else in files."""

    def __init__(self, memory: int):
        self.memory, self.mapped, self.spilled, self.levels = memory, 0, 0, 0
        #: Elements handled at once.
        self.block = max(64, memory // 64)

    def empty(self, n: int, kind) -> np.ndarray:
        size = n * np.dtype(kind).itemsize
        if size <= self.memory:
            return np.empty(n, kind)
        with tempfile.TemporaryFile() as f:
            f.truncate(size)
            self.mapped += size
            return np.memmap(f, kind, "r+", shape=(n,))

    def full(self, n: int, value: int, kind) -> np.ndarray:
        out = self.empty(n, kind)
        for a, b in self.blocks(n):
            out[a:b] = value
        return out

    def blocks(self, n: int) -> Iterator[tuple[int, int]]:
        for a in range(0, n, self.block):
            yield a, min(a + self.block, n)


class RunQueue:
    """First-in-first-out buckets of (suffix, common prefix), on disk beyond a bound of memory."""

    def __init__(self, buckets: int, scratch: Scratch):
        self.runs: list[list] = [[] for _ in range(buckets)]
        self.scratch, self.held, self.file = scratch, 0, None

    def push(self, bucket: np.ndarray, suffix: np.ndarray, common: np.ndarray) -> None:
        """Adds tuples, sorted by bucket and in order within each."""
        edge = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
        begin = [0, *edge.tolist()]
        for s, a, b in zip(bucket[begin].tolist(), begin, [*begin[1:], len(bucket)]):
            self.runs[s].append((suffix[a:b], common[a:b]))
        self.held += suffix.nbytes + common.nbytes
        if self.held > self.scratch.memory:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for run in self.runs:
            k = next((k for k, part in enumerate(run) if isinstance(part[0], np.ndarray)), None)
            if k is not None:
                suffix, common = (np.concatenate(x) for x in zip(*run[k:]))
                run[k:] = [(self.file.tell(), len(suffix))]
                self.file.write(suffix.tobytes())
                self.file.write(common.tobytes())
                self.scratch.spilled += suffix.nbytes + common.nbytes
        self.held = 0

    def take(self, bucket: int, most: int | None = None) -> tuple[np.ndarray, np.ndarray] | None:
        """The oldest tuples of a bucket, about ``most`` of them or all; None if it is empty."""
        run = self.runs[bucket]
        suffix, common, size, k = [], [], 0, 0
        for part in run:
            if most is not None and size >= most:
                break
            k += 1
            if isinstance(part[0], np.ndarray):
                self.held -= part[0].nbytes + part[1].nbytes
            else:
                at, n = part
                self.file.seek(at)
                part = np.frombuffer(self.file.read(8 * n), np.int64), np.frombuffer(self.file.read(2 * n), np.int16)
            suffix.append(part[0])
            common.append(part[1])
            size += len(part[0])
        if not k:
            return None
        del run[:k]
        return np.concatenate(suffix), np.concatenate(common)


def common_prefixes(t: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Symbols that suffixes a[k] and b[k] have in common, up to ``depth``, by comparing them."""
    out = np.zeros(len(a), np.int16)
    live = np.arange(len(a))
    for j in range(depth):
        live = live[np.maximum(a[live], b[live]) + j < len(t)]
        live = live[t[a[live] + j] == t[b[live] + j]]
        if not len(live):
            break
        out[live] = j + 1
    return out


def _range_minima(x: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """min(x[begin:end]) of each range, none of them empty."""
    size = end - begin
    level = np.frexp(size.astype(np.float64))[1] - 1
    out = np.empty(len(begin), x.dtype)
    table, step = x, 1
    for k in range(int(level.max(initial=-1)) + 1):
        at = np.flatnonzero(level == k)
        if len(at):
            out[at] = np.minimum(table[begin[at]], table[end[at] - step])
        table = np.minimum(table[:-step], table[step:]) if len(table) > step else table
        step *= 2
    return out


class _Inducer:
    """One pass over suffixes in order: ``fixed`` ones are given, those of the other type come from the queue.

    With ``down`` the order is from the greatest to the smallest suffix, which
    is the same with symbols counted from the top.
    """

    def __init__(self, t: np.ndarray, symbols: int, fixed: np.ndarray, common: np.ndarray, depth: int, scratch: Scratch, down: bool):
        self.t, self.top, self.down = t, symbols - 1, down
        self.fixed, self.common, self.depth, self.scratch = fixed, common, depth, scratch
        buckets = symbols if symbols <= ONE_SYMBOL else min(symbols, max(64, round((33 * len(t)) ** (1 / 3))))
        self.width = -(-symbols // buckets)
        self.buckets = -(-symbols // self.width)
        self.queue = RunQueue(self.buckets, scratch)
        # of each symbol: the batch in which it was last put in, and the least common prefix in that batch from there on
        self.last, self.tail = scratch.full(symbols, -1, np.int32), scratch.empty(symbols, np.int16)
        # least common prefix from each batch on to the latest
        self.since, self.batch = np.full(1024, depth, np.int16), 0

    def _symbol(self, p: np.ndarray) -> np.ndarray:
        s = self.t[p].astype(np.int64)
        return self.top - s if self.down else s

    def _edges(self) -> np.ndarray:
        """Where the fixed suffixes of each bucket begin, by binary search."""
        bound = np.arange(self.buckets + 1) * self.width
        low, high = np.zeros(len(bound), np.int64), np.full(len(bound), len(self.fixed))
        while (live := np.flatnonzero(low < high)).size:
            middle = (low[live] + high[live]) // 2
            less = self._symbol(self.fixed[middle]) < bound[live]
            low[live[less]] = middle[less] + 1
            high[live[~less]] = middle[~less]
        return low

    def _hand_on(self, p, common, s, queued, before, inside: int):
        """Puts predecessors of the other type into the queue; those of symbols below ``inside`` are returned."""
        at = np.flatnonzero((p > 0) & ((before > s) | ((before == s) & queued)))
        b, least = self.batch, common.min()
        if b + 2 > len(self.since):
            self.since = np.append(self.since, np.full(len(self.since), self.depth, np.int16))
        back = None
        if len(at):
            at = at[np.argsort(before[at], kind="stable")]
            symbol = before[at]
            head = np.append(0, np.flatnonzero(symbol[1:] != symbol[:-1]) + 1)
            value = np.empty(len(at), np.int16)
            own = symbol[head]
            last = self.last[own]
            first = np.minimum(np.minimum(self.tail[own], self.since[last + 1]), np.minimum.accumulate(common)[at[head]])
            value[head] = np.where(last < 0, -1, first)
            rest = np.ones(len(at), bool)
            rest[head] = False
            rest = np.flatnonzero(rest)
            value[rest] = _range_minima(common, at[rest - 1] + 1, at[rest] + 1)
            end = np.append(head[1:], len(at)) - 1
            self.tail[own] = np.append(np.minimum.accumulate(common[::-1])[::-1], self.depth)[at[end] + 1]
            self.last[own] = b
            suffix, value = p[at] - 1, np.minimum(value + 1, self.depth).astype(np.int16)
            k = int(np.searchsorted(symbol, inside))
            if k:
                back = suffix[:k], value[:k], symbol[:k]
            if k < len(at):
                self.queue.push(symbol[k:] // self.width, suffix[k:], value[k:])
        self.since[: b + 1] = np.minimum(self.since[: b + 1], least)
        self.batch += 1
        return back

    def run(self) -> Iterator[tuple]:
        """Batches (suffixes, common prefixes, True for queued ones, True where a suffix of the other type comes before it in the text)."""
        edge = self._edges()
        for b in range(self.buckets):
            yield from (self._one if self.width == 1 else self._several)(b, int(edge[b]), int(edge[b + 1]))

    def _one(self, s: int, begin: int, end: int) -> Iterator[tuple]:
        last, block = None, self.scratch.block
        while (got := self.queue.take(s, block)) is not None:
            p, common = got
            before = self._symbol(np.maximum(p - 1, 0))
            yes = np.ones(len(p), bool)
            self._hand_on(p, common, s, yes, before, 0)
            yield p, common, yes, (p > 0) & (before < s)
            last = p[-1:]
        for k in range(begin, end, block):
            p, common = (np.array(x[k : min(k + block, end)]) for x in (self.fixed, self.common))
            if k == begin:
                common[0] = common_prefixes(self.t, last, p[:1], self.depth)[0] if last is not None else 0
            before = self._symbol(np.maximum(p - 1, 0))
            no = np.zeros(len(p), bool)
            self._hand_on(p, common, s, no, before, 0)
            yield p, common, no, no

    def _several(self, b: int, begin: int, end: int) -> Iterator[tuple]:
        high = (b + 1) * self.width
        got = self.queue.take(b)
        p, common = (np.concatenate((x, y[begin:end])) if got else np.array(y[begin:end]) for x, y in zip(got or (None, None), (self.fixed, self.common)))
        queued = np.arange(len(p)) < len(p) - (end - begin)
        s, before = self._symbol(p), self._symbol(np.maximum(p - 1, 0))
        rows = [p, common, s, queued, before]
        rows = [x[np.argsort(2 * s + ~queued, kind="stable")] for x in rows]
        last = None
        while len(rows[0]):
            p, common, s, queued, before = rows
            inside = before[(p > 0) & (before < high) & ((before > s) | ((before == s) & queued))]
            cut = int(inside.min()) if len(inside) else high
            if cut > s[0]:
                k = int(np.searchsorted(s, cut))
            else:  # the first symbol adds to itself
                k = int(queued[: np.searchsorted(s, cut, "right")].sum())
            rest = [x[k:] for x in rows]
            p, common, s, queued, before = (x[:k] for x in rows)
            # from the last queued suffix of a symbol to its first fixed one
            lp, ls, lq = last or (0, -1, False)
            seam = ~queued & np.append(lq, queued[:-1]) & (np.append(ls, s[:-1]) == s)
            if seam.any():
                common = common.copy()
                common[seam] = common_prefixes(self.t, np.append(lp, p[:-1])[seam], p[seam], self.depth)
            back = self._hand_on(p, common, s, queued, before, high)
            yield p, common, queued, queued & (p > 0) & (before < s)
            last = int(p[-1]), int(s[-1]), bool(queued[-1])
            if back is not None:
                q = back[0]
                new = [q, back[1], back[2], np.ones(len(q), bool), self._symbol(np.maximum(q - 1, 0))]
                rest = [np.concatenate(x) for x in zip(rest, new)]
                order = np.argsort(2 * rest[2] + ~rest[3], kind="stable")
                rest = [x[order] for x in rest]
            rows = rest


def _ordered(t: np.ndarray, symbols: int, fixed: np.ndarray, common: np.ndarray, depth: int, scratch: Scratch, wanted: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Wanted suffixes but the last one in order, and common prefixes of neighbours, from leftmost S suffixes in order."""
    large, prefix, n = scratch.empty(len(t), np.int64), scratch.empty(len(t) + 1, np.int16), 0
    for p, c, queued, _ in _Inducer(t, symbols, fixed, common, depth, scratch, False).run():
        if queued.any():
            p, c = p[queued], c[queued]
            large[n : n + len(p)], prefix[n : n + len(p)] = p, c
            n += len(p)
    prefix[n] = 0
    out, least, m, held = scratch.empty(len(t), np.int64), scratch.empty(len(t) + 1, np.int16), 0, depth
    # towards smaller suffixes, each is compared with the one above it
    for p, c, _, star in _Inducer(t, symbols, large[:n][::-1], prefix[1 : n + 1][::-1], depth, scratch, True).run():
        at = np.flatnonzero(wanted(p, star))
        if not len(at):
            held = min(held, int(c.min()))
            continue
        low = np.minimum.reduceat(c[: at[-1] + 1], np.append(0, at[:-1] + 1))
        low[0] = min(held, int(low[0]))
        held = int(c[at[-1] + 1 :].min(initial=depth))
        out[m : m + len(at)], least[m : m + len(at)] = p[at], low
        m += len(at)
    least[m] = 0
    return out[:m][::-1], least[1 : m + 1][::-1]


def _leftmost(t: np.ndarray, scratch: Scratch) -> np.ndarray:
    """Positions of the leftmost S suffixes, the last suffix among them, from left to right."""
    n, parts, small, end = len(t), [], True, len(t) - 1
    while end > 0:
        begin = max(0, end - scratch.block)
        up = np.sign(np.diff(t[begin : end + 1].astype(np.int64)))
        at = np.where(up != 0, np.arange(len(up)), len(up))
        kind = np.append(np.append(up > 0, small)[np.minimum.accumulate(at[::-1])[::-1]], small)
        parts.append(np.flatnonzero(kind[1:] & ~kind[:-1]) + begin + 1)
        small, end = bool(kind[0]), begin
    out, k = scratch.empty(sum(map(len, parts)), np.int64), 0
    for part in reversed(parts):
        out[k : k + len(part)] = part
        k += len(part)
    return out if n > 1 else np.zeros(1, np.int64)


def _by_symbol(t: np.ndarray, seeds: np.ndarray, symbols: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """Seeds sorted by their symbol only, as if equal symbols were equal substrings of length 1."""
    count = scratch.full(symbols + 1, 0, np.int64)
    for a, b in scratch.blocks(len(seeds)):
        s, n = np.unique(t[seeds[a:b]].astype(np.int64), return_counts=True)
        count[s + 1] += n
    for a, b in scratch.blocks(symbols + 1):
        count[a:b] = np.cumsum(count[a:b]) + (count[a - 1] if a else 0)
    common = scratch.full(len(seeds), 1, np.int16)
    for a, b in scratch.blocks(symbols):
        first = count[a:b]
        common[first[first < len(seeds)]] = 0
    order = scratch.empty(len(seeds), np.int64)
    for a, b in scratch.blocks(len(seeds)):
        p = seeds[a:b]
        s = t[p].astype(np.int64)
        by = np.argsort(s, kind="stable")
        p, s = p[by], s[by]
        one, head, n = np.unique(s, return_index=True, return_counts=True)
        order[count[s] + np.arange(len(s)) - np.repeat(head, n)] = p
        count[one] += n
    return order, common


def _doubled(t: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """:func:`suffix_order` in memory, by ranks over twice as many symbols in each round."""
    n = len(t)
    ranks, reach, count = [np.asarray(t, np.int64)], 1, 0
    while reach < depth and count < n:
        last = ranks[-1].astype(np.int64)
        key = last * (int(last.max()) + 2)
        key[:-reach] += last[reach:] + 1
        ranks.append(np.unique(key, return_inverse=True)[1].astype(np.int32))
        count = int(ranks[-1].max()) + 1
        reach *= 2
    order = np.argsort(ranks[-1], kind="stable")
    common = np.zeros(n, np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        a, b = order[:-1] + common[1:], order[1:] + common[1:]
        live = np.flatnonzero((a < n) & (b < n))
        same = live[ranks[k][a[live]] == ranks[k][b[live]]]
        common[same + 1] += 1 << k
    return order, np.minimum(common, depth).astype(np.int16)


def suffix_order(t: np.ndarray, symbols: int, depth: int, scratch: Scratch, wanted: Callable | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``t`` ordered by at least their first ``depth`` symbols, and common prefixes of neighbours up to ``depth``.

    ``t`` ends with a symbol 0 that occurs nowhere else; suffixes that agree
    on ``depth`` symbols may come in any order, but come together.  With
    ``wanted`` (a function of positions) only those suffixes are given.
    """
    scratch.levels += 1
    if wanted is None and len(t) * BASE_BYTES <= scratch.memory:
        return _doubled(t, depth)
    keep = (lambda p, star: wanted(p)) if wanted else (lambda p, star: np.ones(len(p), bool))
    seeds = _leftmost(t, scratch)
    m = len(seeds)
    fixed, common = (seeds, np.zeros(1, np.int16)) if m == 1 else _by_symbol(t, seeds, symbols, scratch)
    if depth > 1 and m > 1:
        fixed, common = _sorted_seeds(t, symbols, seeds, fixed, common, depth, scratch)
    order, prefix = _ordered(t, symbols, fixed, common, depth, scratch, keep)
    last = np.array([len(t) - 1])
    if not keep(last, last).all():
        return order, prefix
    whole, least = scratch.empty(len(order) + 1, np.int64), scratch.empty(len(order) + 1, np.int16)
    whole[0], least[0] = len(t) - 1, 0
    for a, b in scratch.blocks(len(order)):
        whole[a + 1 : b + 1], least[a + 1 : b + 1] = order[a:b], prefix[a:b]
    return whole, least


def _sorted_seeds(t, symbols: int, seeds, fixed, common, depth: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """Leftmost S suffixes in order with their common prefixes: substrings are named, and the names sorted one level down."""
    m = len(seeds)
    star, prefix = _ordered(t, symbols, fixed, common, depth, scratch, lambda p, star: star)
    # the last suffix, which nothing induces, is the smallest
    number, name_prefix = scratch.empty(m, np.int64), scratch.empty(m, np.int16)
    names = scratch.empty(m, np.int64)
    number[0], names[m - 1], name_prefix[0] = m - 1, 0, 0
    count, last = 1, 1  # names so far; length of the substring before
    for a, b in scratch.blocks(m - 1):
        k = np.searchsorted(seeds, star[a:b])
        size = seeds[k + 1] - seeds[k] + 1
        before = np.append(last, size[:-1])
        c = np.minimum(prefix[a:b], np.minimum(size, before))
        same = (c >= depth) | ((size == before) & (c >= size))
        name = count - 1 + np.cumsum(~same)
        number[a + 1 : b + 1], names[k] = k, name
        new = np.flatnonzero(~same)
        name_prefix[count : count + len(new)] = c[new]
        count, last = count + len(new), int(size[-1])
    if count < m:
        # a substring is two symbols at least without the symbol it shares with the next
        number, shared = suffix_order(names, count, -(-depth // 2), scratch)
    else:
        shared = scratch.full(m, 0, np.int16)
    order, out = scratch.empty(m, np.int64), scratch.empty(m, np.int16)
    order[0], out[0] = seeds[number[0]], 0
    for a, b in scratch.blocks(m - 1):
        x, y, k = number[a:b], number[a + 1 : b + 1], shared[a + 1 : b + 1].astype(np.int64)
        xk, yk = np.minimum(x + k, m - 1), np.minimum(y + k, m - 1)
        c = seeds[xk] - seeds[x]
        u, v = names[xk], names[yk]
        differ = np.flatnonzero((u < v) & (c < depth))
        part = _range_minima(name_prefix[:count], u[differ] + 1, v[differ] + 1).astype(np.int64)
        c[differ] += part
        # a substring may end where the other goes on: what follows there is a run of one symbol on both sides
        xk, yk = xk[differ], yk[differ]
        ended = np.flatnonzero(part >= seeds[yk + 1] - seeds[yk] + 1)
        part = part[ended] - 1
        c[differ[ended]] += common_prefixes(t, seeds[xk[ended]] + part, seeds[yk[ended]] + part, depth) - 1
        order[a + 1 : b + 1], out[a + 1 : b + 1] = seeds[y], np.minimum(c, depth)
    return order, out


class Shard:
    """Records of one shard, appended in any number, and the windows of them that occur earlier.

    Text and marks are files from the start; what is kept in memory is four
    numbers a record.
    """

    def __init__(self, length: int, memory: int = 64 << 20):
        self.length, self.scratch = length, Scratch(memory)
        self.text, self.mark = tempfile.TemporaryFile(), tempfile.TemporaryFile()
        self.begin: list[np.ndarray] = []
        self.size = 0

    def add(self, records: list[bytes], windows: np.ndarray) -> None:
        """Records of which the first ``windows`` positions are to be judged; bytes above 0xFD, which no UTF-8 text has, are refused."""
        if not records:
            return
        size = np.fromiter(map(len, records), np.int64, len(records)) + 1
        begin = np.cumsum(size) - size
        # symbols: 0 ends the text, 1 ends a record, bytes follow
        t = np.frombuffer(b"\0".join(records) + b"\0", np.uint8)
        if t.max(initial=0) > 253:
            raise ValueError("records must be UTF-8")
        t = t + np.uint8(2)
        t[begin + size - 1] = 1
        wanted = np.zeros(len(t) + 1, np.int8)
        np.add.at(wanted, begin, 1)
        np.add.at(wanted, begin + windows, -1)
        self.text.write(t.tobytes())
        self.mark.write(np.cumsum(wanted[:-1], dtype=np.int8).tobytes())
        self.begin.append(begin + self.size)
        self.size += len(t)

    def _read(self, f, n: int) -> np.ndarray:
        f.flush()
        if n <= self.scratch.memory:
            f.seek(0)
            return np.frombuffer(f.read(n), np.uint8)
        self.scratch.mapped += n
        return np.memmap(f, np.uint8, "r", shape=(n,))

    def repeats(self, rank: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(record number, position in it) of each window that also occurs in a record of lower rank or further left."""
        if not self.size:
            return
        self.text.write(b"\0")
        self.mark.write(b"\0")
        t, mark = self._read(self.text, self.size + 1), self._read(self.mark, self.size + 1)
        begin, length, block = np.concatenate(self.begin), self.length, self.scratch.block
        order, common = suffix_order(t, 256, length, self.scratch, lambda p: mark[p] > 0)
        a, n = 0, len(order)
        while a < n:
            b = min(a + block, n)
            while b < n and common[b] >= length:  # whole groups
                new = np.flatnonzero(common[b : b + block] < length)
                b = b + int(new[0]) if len(new) else min(b + block, n)
            p = order[a:b]
            record = np.searchsorted(begin, p, "right") - 1
            at = p - begin[record]
            first = np.append(True, common[a + 1 : b] < length)
            group = np.cumsum(first) - 1
            edge = np.flatnonzero(first)
            rk = rank[record]
            least = np.minimum.reduceat(rk, edge)[group]
            left = np.where(rk == least, at, np.iinfo(np.int64).max)
            again = (rk > least) | (at > np.minimum.reduceat(left, edge)[group])
            if again.any():
                yield record[again], at[again]
            a = b


def repeated_windows(records: list[bytes], windows: list[int], length: int, memory: int = 64 << 20) -> np.ndarray:
    """True for each window that also occurs earlier; windows of all records one after the other."""
    shard = Shard(length, memory)
    n = np.array(windows, np.int64)
    shard.add(records, n)
    out = np.zeros(int(n.sum()), bool)
    for record, at in shard.repeats(np.arange(len(records))):
        out[(np.cumsum(n) - n)[record] + at] = True
    return out
