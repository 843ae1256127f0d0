"""Byte-level BPE encoding and decoding with padded numpy matrices.

Distinct pre-tokens of a chunk are put into matrices by length.  In each round
every row merges its leftmost pair of minimum rank: ranks of adjacent pairs
come from a hashed pair table, ``argmin`` finds the pair, and the matrix is
compacted by the one column each row lost.  Pre-tokens longer than
``MATRIX_BYTES`` are merged with a heap, which gives the same ids without
time that is quadratic in the length.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow, strings
from .pretokens import PieceCache, split_texts
from .textnum import U64, HashIndex, ragged

NONE = np.int32(2**31 - 1)
MATRIX_BYTES = 512
#: Matrix cells handled at once.
CELLS = 1 << 21


class ByteBPE:
    """A vocabulary of ranks; bytes missing from it are an error, as every byte must be a token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        size = max(ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, rank = [], [], []
        for token, r in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        self._pairs = HashIndex(18)
        self._pairs.add(self._key(np.array(left), np.array(right)), np.array(rank))

    @classmethod
    def from_tiktoken(cls, path: str) -> ByteBPE:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    @staticmethod
    def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(U64) << U64(32)) | b.astype(U64) | U64(1 << 63)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = self._pairs.find(self._key(a, b))
        return np.where((out < 0) | (a < 0) | (b < 0), NONE, out)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all pieces in order, and the number of ids of each."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        begin = np.cumsum(size) - size
        count = np.zeros(len(pieces), np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []  # (piece of each id, ids), in order within a piece
        longest = int(size.max(initial=0))
        lower, upper = 0, 2
        while lower < min(longest, MATRIX_BYTES):
            group = np.flatnonzero((size > lower) & (size <= upper))
            for k in range(0, len(group), step := max(1, CELLS // upper)):
                self._matrix(group[k : k + step], size, begin, flat, upper, done)
            lower, upper = upper, upper * 2 if upper >= 8 else upper + 2
        for k in np.flatnonzero(size > max(lower, MATRIX_BYTES)).tolist():
            ids = self._heap(pieces[k])
            done.append((np.full(len(ids), k), ids))
        if not done:
            return np.zeros(0, np.int32), count
        piece = np.concatenate([x for x, _ in done])
        ids = np.concatenate([x for _, x in done])
        order = np.argsort(piece, kind="stable")
        np.add.at(count, piece, 1)
        return ids[order], count

    def _matrix(self, rows, size, begin, flat, width, done) -> None:
        n = len(rows)
        column = np.arange(width)
        inside = column < size[rows][:, None]
        m = np.full((n, width), -1, np.int32)
        m[inside] = self.byte_id[flat[ragged(begin[rows], size[rows])]]
        rank = np.full((n, width), NONE, np.int32)
        rank[:, :-1] = self.pair_ranks(m[:, :-1].ravel(), m[:, 1:].ravel()).reshape(n, width - 1)
        while len(rows):
            best = rank.argmin(axis=1)
            r = np.arange(len(rows))
            low = rank[r, best]
            over = low == NONE
            if over.any():
                out = m[over]
                held = out >= 0
                done.append((np.repeat(rows[over], held.sum(axis=1)), out[held]))
                go = ~over
                rows, m, rank, best, low = rows[go], m[go], rank[go], best[go], low[go]
                if not len(rows):
                    return
                r = np.arange(len(rows))
            m[r, best] = low
            keep = np.ones(m.shape, bool)
            keep[r, best + 1] = False
            width = m.shape[1] - 1
            m = m[keep].reshape(-1, width)
            rank = rank[keep].reshape(-1, width)
            right = np.where(best + 1 < width, m[r, np.minimum(best + 1, width - 1)], -1)
            rank[r, best] = self.pair_ranks(m[r, best], right)
            some = best > 0
            q, at = r[some], best[some] - 1
            rank[q, at] = self.pair_ranks(m[q, at], m[q, at + 1])

    def _heap(self, piece: bytes) -> np.ndarray:
        ids = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tokens, ranks = self.tokens, self.ranks

        def rank(a: int, b: int) -> int | None:
            return ranks.get(tokens[ids[a]] + tokens[ids[b]])

        heap = [(x, k, ids[k], ids[k + 1]) for k in range(n - 1) if (x := rank(k, k + 1)) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            x, k, a, b = heapq.heappop(heap)
            j = after[k] if alive[k] else n
            if j >= n or ids[k] != a or ids[j] != b:
                continue
            ids[k], alive[j] = x, False
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
                if (y := rank(k, after[k])) is not None:
                    heapq.heappush(heap, (y, k, ids[k], ids[after[k]]))
            if before[k] >= 0 and (y := rank(before[k], k)) is not None:
                heapq.heappush(heap, (y, before[k], ids[before[k]], ids[k]))
        return np.array([x for x, held in zip(ids, alive) if held], np.int32)

    def encode(self, text: str) -> list[int]:
        """The ids of one text."""
        out: list[np.ndarray] = []
        for whole, _, s, e, _ in split_texts([text]):
            words = [whole[a:b].encode() for a, b in zip(s.tolist(), e.tolist())]
            out.append(self.encode_pieces(words)[0])
        return np.concatenate(out).tolist() if out else []

    def decode(self, ids) -> bytes:
        return b"".join([self.tokens[k] for k in ids])


@lru_cache(maxsize=2)
def vocabulary(path: str) -> ByteBPE:
    return ByteBPE.from_tiktoken(path)


class _Codec:
    """Per worker: the pieces of distinct pre-tokens as decimal ids and as decoded bytes."""

    def __init__(self, path: str, limit: int):
        self.bpe = vocabulary(path)
        self.limit = limit
        self.cache = PieceCache(self._encode, limit)
        self._clear()

    def _clear(self) -> None:
        self.decimal: list[bytes] = []
        self.decoded: list[bytes] = []

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.cache.size == 0:
            self._clear()
        ids, count = self.bpe.encode_pieces([w.encode() for w in words])
        at, flat, tokens = 0, ids.tolist(), self.bpe.tokens
        names = list(map(b"%d".__mod__, flat))
        for n in count.tolist():
            self.decimal.append(b",".join(names[at : at + n]))
            self.decoded.append(b"".join([tokens[k] for k in flat[at : at + n]]))
            at += n
        return ids, count


@lru_cache(maxsize=1)
def _codec(path: str, limit: int) -> _Codec:
    return _Codec(path, limit)


class _Doc:
    """Digests of one document, fed chunk by chunk."""

    def __init__(self):
        self.ids, self.out, self.n, self.size = hashlib.sha256(), hashlib.sha256(), 0, 0

    def feed(self, decimal: list[bytes], decoded: list[bytes], n: int) -> None:
        if decimal:
            self.ids.update((b"," if self.n else b"") + b",".join(decimal))
            whole = b"".join(decoded)
            self.out.update(whole)
            self.n += n
            self.size += len(whole)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", cache_limit: int = 300_000, with_ids: bool = False) -> DataFrame:
    """Encodes every text by the ranks at ``path`` and decodes the ids again.

    Returns (id_col, n_tokens, ids_sha256, decoded_sha256), plus ``ids`` as an
    array with ``with_ids``.  One row per input row, so repeated rows repeat;
    a null text counts as empty (0 tokens); other columns are not read.  A
    text whose decoded bytes differ from its own (two pre-tokens of one
    64-bit hash) is encoded again without the cache.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, cache_limit)
        for batch in batches:
            texts = strings(batch, text_col)
            rows = [_Doc() for _ in texts]
            held: list[list[int]] = [[] for _ in texts]
            for whole, h, s, e, owner in split_texts(texts):
                at = codec.cache.look_up(whole, h, s, e)
                count = codec.cache.count[at]
                cut = np.flatnonzero(np.diff(owner, prepend=-1, append=-1)) if len(owner) else []
                decimal, decoded = codec.decimal, codec.decoded
                for a, b in zip(cut[:-1], cut[1:]):
                    own = at[a:b].tolist()
                    rows[owner[a]].feed([decimal[k] for k in own], [decoded[k] for k in own], int(count[a:b].sum()))
                    if with_ids:
                        c = codec.cache
                        held[owner[a]] += c.ids[ragged(c.begin[at[a:b]], count[a:b])].tolist()
            out = []
            for k, (t, d) in enumerate(zip(texts, rows)):
                raw = hashlib.sha256(t.encode()).hexdigest()
                if raw != d.out.hexdigest():
                    held[k] = ids = codec.bpe.encode(t)
                    d.n, d.ids = len(ids), hashlib.sha256(",".join(map(str, ids)).encode())
                    d.out = hashlib.sha256(codec.bpe.decode(ids))
                out.append((d.n, d.ids.hexdigest(), d.out.hexdigest()))
            n, ids, decoded = zip(*out) if out else ((), (), ())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(held, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return map_arrow(docs.select(id_col, text_col), run, schema)
