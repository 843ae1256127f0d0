"""Order-preserving packing of documents into token windows by dynamic programming.

Documents keep the order of their rows in a partition.  Their ids form one
stream; windows are consecutive stretches of it.  Cuts are allowed at
document ends, at sentence ends inside a document, and, only in a stretch of
more than LONGEST_SENTENCE ids without a sentence end (lists, code, junk),
every ``window // 64`` ids.  With f(j) the
least cost of the stream up to cut j at position p(j),

    f(j) = penalty(j) + min over i, p(j) - p(i) <= W, of f(i) + (W - (p(j) - p(i)))

``f(i) + p(i)`` does not depend on j, so the minimum over the sliding range
of i is kept in a monotone queue and each transition takes constant
amortised time.  W - (p(j) - p(i)) is the padding of the window (0 where
its length is a power of two, which is not padded: that saving is left to
the last window); penalty(j) is the price of truncating a document at j.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow, partition_id, strings
from .tokens import library

#: Ids after which the stream so far is packed, all but its last windows.
SPAN = 1 << 20
#: Ids without a sentence end beyond which a stretch is no sentence and may be cut inside.
LONGEST_SENTENCE = 512
SENTENCE_PENALTY, HARD_PENALTY = 2.0, 12.0
SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def choose_cuts(position: np.ndarray, penalty: np.ndarray, window: int) -> np.ndarray:
    """Indices of the cuts with the least total of padding and penalties.

    ``position`` rises strictly from 0 by at most ``window`` a step; the first
    and the last position are always cuts.  Ties go to the longest window.
    """
    n = len(position)
    p, pen = position.tolist(), penalty.tolist()
    best, came = [0.0] * n, [0] * n
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    for j in range(1, n):
        low = p[j] - window
        while p[queue[0][1]] < low:
            queue.popleft()
        value, i = queue[0]
        best[j] = f = value - p[j] + window + pen[j]
        came[j] = i
        f += p[j]
        while queue and queue[-1][0] > f:
            queue.pop()
        queue.append((f, j))
    out = [n - 1]
    while out[-1]:
        out.append(came[out[-1]])
    return np.array(out[::-1])


class Packer:
    """Packs the stream of one partition; memory is bounded by SPAN and the longest document."""

    def __init__(self, window: int, sentence_end: np.ndarray, first_sequence: int):
        self.window, self.sentence_end, self.sequence = window, sentence_end, first_sequence
        self.ids: list[np.ndarray] = []  # of each document from where packing has come
        self.start: list[int] = []  # ids of the document before those
        self.whole: list[int] = []
        self.key: list = []
        self.held = 0

    def add(self, key, ids: np.ndarray) -> None:
        self.ids.append(ids)
        self.start.append(0)
        self.whole.append(len(ids))
        self.key.append(key)
        self.held += len(ids)

    def _cuts(self, stream: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Possible cuts (0 included) and what each costs."""
        at = np.flatnonzero(self.sentence_end[stream]) + 1
        step = max(1, self.window // 64)
        base = np.union1d(np.append(at, 0), ends)
        gap = np.diff(base)
        wide = np.flatnonzero(gap > min(LONGEST_SENTENCE, self.window))
        extra = [np.arange(a + step, b, step) for a, b in zip(base[wide].tolist(), base[wide + 1].tolist())]
        position = np.union1d(base, np.concatenate(extra)) if extra else base
        penalty = np.full(len(position), HARD_PENALTY)
        penalty[np.isin(position, at)] = SENTENCE_PENALTY
        penalty[np.isin(position, ends)] = 0
        penalty[0] = 0
        return position.astype(np.int64), penalty

    def pack(self, last: bool) -> Iterator[tuple]:
        """Rows (key, start, length, crc32, document tokens, sequence, offset) of all that is settled."""
        if not self.held:
            return
        stream = np.concatenate(self.ids)
        ends = np.cumsum([len(x) for x in self.ids])
        position, penalty = self._cuts(stream, ends)
        cut = position[choose_cuts(position, penalty, self.window)]
        if not last:  # the end of the stream is not yet known: keep the last windows for the next span
            keep = max(0, len(cut) - 9)
            cut = cut[: keep + 1]
        begin = np.concatenate(([0], ends[:-1]))
        done = int(cut[-1])
        raw = stream.astype("<u4")
        edges = np.union1d(cut, begin[begin < done])
        edges = edges[edges <= done]
        doc = np.searchsorted(ends, edges[:-1], side="right")
        sequence = np.searchsorted(cut, edges[:-1], side="right") - 1
        for a, b, d, q in zip(edges[:-1].tolist(), edges[1:].tolist(), doc.tolist(), sequence.tolist()):
            yield self.key[d], self.start[d] + a - int(begin[d]), b - a, zlib.crc32(raw[a:b].tobytes()), self.whole[d], self.sequence + q, a - int(cut[q])
        self.sequence += len(cut) - 1
        d = int(np.searchsorted(ends, done, side="right"))
        if d < len(self.ids):
            used = done - int(begin[d])
            self.ids[d] = self.ids[d][used:].copy()
            self.start[d] += used
        for held in (self.ids, self.start, self.whole, self.key):
            del held[:d]
        self.held -= done


def sentence_ends(path: str) -> np.ndarray:
    """True for ids whose text ends a sentence or holds a line break."""
    tokenizer = library(path, True).tokenizer
    names = [tokenizer.decode([k], skip_special_tokens=False) for k in range(tokenizer.get_vocab_size())]
    return np.array([x.rstrip("\"')] ").endswith((".", "!", "?")) or "\n" in x for x in names])


def pack(docs: DataFrame, path: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", order_col: str | None = None) -> DataFrame:
    """Packs all documents into windows of at most ``window`` ids.

    A document is its ids by the tokenizers file at ``path`` (no special
    tokens added) and then ``end_id``; a null text is empty, so it is the one
    id ``end_id``.  Returns one row per piece: (id_col, start, length,
    ids_crc32, doc_tokens, sequence_id, offset).  Documents keep the order of
    the input rows within a partition, or are range-partitioned and sorted by
    ``order_col``.  Sequences never span partitions, so at most one window of
    each partition is filled by less than the programme's best; sequence ids
    are the partition's number times 2**32 plus a count.  Repeated rows are
    packed once each; other columns are not read.  An empty table gives no rows.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    if order_col:
        docs = docs.repartitionByRange(order_col).sortWithinPartitions(order_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = library(path, True)
        packer = Packer(window, sentence_ends(path), partition_id() << 32)
        types = None

        def out(rows) -> Iterator[pa.RecordBatch]:
            rows = list(rows)
            if rows:
                keys, *columns = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(keys, types), *(pa.array(c, pa.int64()) for c in columns)], [id_col, *(x.split()[0] for x in SCHEMA.split(", "))])

        for batch in batches:
            types = batch.schema.types[0]
            keys = batch.column(0).to_pylist()
            ids, off = pieces.ids(strings(batch, text_col))
            for k, key in enumerate(keys):
                packer.add(key, np.append(ids[off[k] : off[k + 1]], np.int32(end_id)))
                if packer.held >= SPAN:
                    yield from out(packer.pack(last=False))
        if types is not None:
            yield from out(packer.pack(last=True))

    return map_arrow(docs.select(id_col, text_col), run, f"`{id_col}` {id_type}, {SCHEMA}")
