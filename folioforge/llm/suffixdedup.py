"""Removal of byte strings that occurred before, on documents of any number.

Two windows of LENGTH bytes are equal only if they hold the same anchor: the
least hash among the K-byte strings in them.  So every window is given to its
anchor, and the windows of one anchor occurrence, which are consecutive, form
a context.  Anchors only say which contexts may share windows: contexts whose
anchor occurs once are done with, all others are cut out of the texts and
dealt to shards by anchor.  Records that are equal byte for byte are one
record with its earliest place, in the task that cuts them and in the shard.
What then shares its anchor, and HALF bytes on one side of it, with another
record (without which no window can be shared) is sorted: a shard puts the
suffixes of these records in order by external induced sorting
(:mod:`.induced`), whose common prefixes tell which windows occurred earlier.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import document_key, free_name, map_arrow, parallelism, strings, with_fields, written
from .induced import Shard
from .textnum import U64, HashIndex, Prefix, ragged, splitmix

LENGTH, K = 100, 20
SPAN = LENGTH - K + 1
HALF = (LENGTH - K) // 2
SEGMENT = 1 << 20
#: Contexts of an anchor beyond which its windows are dealt one by one, so that no shard holds a hot anchor; results are the same.
HOT_CONTEXTS = 2048
#: Bytes a shard's sort holds in memory of each of its arrays and of its queue; what is larger is on disk.
SORT_MEMORY = 128 << 20
#: Contexts seen twice that a task remembers, to combine equal ones before the exchange; beyond it a task forgets them and starts anew.
REMEMBERED = 100_000
#: Places of the table in which a task notes the last context that fell into each (8 bytes a place): it knows again what recurs within about 80 MB of text.
NOTED = 1 << 21
_LOW = U64(127)


def _anchor_of(gram: np.ndarray) -> np.ndarray:
    """For each window of SPAN grams, the last position at which the least hash occurs."""
    n = len(gram)
    rows = -(-n // SPAN)
    key = np.full(rows * SPAN, U64(2**64 - 1))
    place = np.arange(SPAN, dtype=U64)
    key[:n] = gram | _LOW
    key = (key.reshape(rows, SPAN) ^ place).ravel()  # low bits: 127 - place, so that the last of equals is least
    table = key.reshape(rows, SPAN)
    head = np.minimum.accumulate(table, axis=1).ravel()
    tail = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    p = np.arange(n - SPAN + 1)
    left, right = tail[: n - SPAN + 1], head[SPAN - 1 : n]
    use_right = (right | _LOW) <= (left | _LOW)
    whole = p % SPAN == 0
    chosen = np.where(use_right, right, left)
    block = np.where(use_right & ~whole, p // SPAN + 1, p // SPAN)
    return block * SPAN + ((chosen & _LOW) ^ _LOW).astype(np.int64)


def contexts(texts: list[bytes], pieces: list[tuple[int, int]]):
    """Contexts of pieces (text, from) of at most SEGMENT windows.

    Yields arrays (piece, first window in its text, windows, place of the anchor from there, anchor hash, context hash).
    """
    parts = [texts[k][s : s + SEGMENT + LENGTH - 1] for k, s in pieces]
    b = np.frombuffer(b"".join(parts), np.uint8)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    begin = np.cumsum(size) - size
    if len(b) < LENGTH:
        return
    prefix = Prefix(b)
    at = np.arange(len(b) - K + 1)
    gram = prefix.slices(at, at + K)
    anchor = _anchor_of(gram)
    count = np.maximum(size - LENGTH + 1, 0)
    p = ragged(begin, count)
    if not len(p):
        return
    owner = np.repeat(np.arange(len(parts)), count)
    a = anchor[p]
    edge = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (owner[1:] != owner[:-1])))
    n = np.diff(np.append(edge, len(p)))
    first, a, owner = p[edge], a[edge], owner[edge]
    whole = splitmix(prefix.slices(first, first + n + LENGTH - 1) ^ splitmix((a - first).astype(U64)))
    start = np.array([s for _, s in pieces], np.int64)
    text = np.array([k for k, _ in pieces], np.int64)
    yield text[owner], first - begin[owner] + start[owner], n, a - first, gram[a], whole


def _pieces(texts: list[bytes]) -> Iterator[list[tuple[int, int]]]:
    out, held = [], 0
    for k, t in enumerate(texts):
        for s in range(0, max(0, len(t) - LENGTH + 1), SEGMENT):
            size = min(len(t) - s, SEGMENT + LENGTH - 1)
            if held and held + size > SEGMENT:
                yield out
                out, held = [], 0
            out.append((k, s))
            held += size
    if out:
        yield out


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by the intervals; runs that touch are one."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.append(True, start[1:] > end[:-1])
    edge = np.flatnonzero(new)
    return start[edge], end[np.append(edge[1:], len(end)) - 1]


_FOUND = "kind int, h long, id long, tie long, p long, n long, place long"
_NAMES = [x.split()[0] for x in _FOUND.split(", ")]
_RECORDS = "h long, c long, id long, tie long, p long, n long, place long, raw binary"
_RECORD_NAMES = [x.split()[0] for x in _RECORDS.split(", ")]
#: Kinds of rows: a context to be compared, a repeat, a context of a hot anchor.
PLAIN, REPEAT, HOT = 0, 1, 2


def _batch(kind, h, doc, tie, p, n, place) -> pa.RecordBatch:
    size = len(p)

    def column(x) -> pa.Array:
        x = np.broadcast_to(x, size)
        return pa.array(x.view(np.int64) if x.dtype == U64 else x.astype(np.int64))

    return pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(kind, size).astype(np.int32)), *map(column, (h, doc, tie, p, n, place))], _NAMES)


def _changed(*columns: np.ndarray) -> np.ndarray:
    """True where any column differs from the row before; the first row counts as different."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for x in columns:
        out[1:] |= x[1:] != x[:-1]
    return out


class _Combiner:
    """Contexts of one task: of those equal byte for byte, all but the earliest so far are repeats at once.

    A context is remembered, with its bytes and its earliest place, from its
    second sighting on, be that in one call or in calls far apart: a table of
    ``noted`` places holds the last context that fell into each.  What it has
    lost by then, and what is forgotten when ``remembered`` contexts are
    reached, is dealt on once more and told apart after the exchange.
    """

    def __init__(self, noted: int = NOTED, remembered: int = REMEMBERED):
        self.noted, self.remembered = np.zeros(noted, U64), remembered
        self.index, self.raw, self.place = HashIndex(), [], []

    def _seen_before(self, key: np.ndarray) -> np.ndarray:
        """Whether each context was noted in an earlier call; all of this call are noted."""
        at = (key % U64(len(self.noted))).astype(np.int64)
        out = (self.noted[at] == key) & (key != 0)
        self.noted[at] = key
        return out

    def split(self, texts: list[bytes], text, doc, tie, p, n, h, c) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the rows to be dealt on, and of the repeats."""
        key = splitmix(h) ^ c
        fresh, again = np.ones(len(key), bool), np.zeros(len(key), bool)
        by = np.argsort(key, kind="stable")
        new = _changed(key[by])
        several = np.zeros(len(key), bool)
        several[by] = ~new
        several[by[:-1]] |= ~new[1:]
        rows = np.flatnonzero(several)
        order = rows[np.lexsort((p[rows], tie[rows], doc[rows], key[rows]))]
        new = _changed(key[order])
        first = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
        for k, f in zip(order[~new].tolist(), first[~new].tolist()):
            at, size = int(p[k]), int(n[k]) + LENGTH - 1
            if texts[text[k]][at : at + size] == texts[text[f]][p[f] : p[f] + size]:
                fresh[k] = False
                # the same place of an equal row is no repeat
                again[k] = (doc[k], tie[k], p[k]) != (doc[f], tie[f], p[f])
        heads = np.unique(first)
        known = self.index.find(key)
        for k in np.flatnonzero(fresh & (known >= 0)).tolist():
            j, at = int(known[k]), int(p[k])
            if self.raw[j] == texts[text[k]][at : at + int(n[k]) + LENGTH - 1]:
                place = (int(doc[k]), int(tie[k]), at)
                if place > self.place[j]:
                    fresh[k], again[k] = False, True
                elif place == self.place[j]:
                    fresh[k] = False
                else:
                    self.place[j] = place
        heads = np.union1d(heads, np.flatnonzero(self._seen_before(key) & fresh & ~several))
        heads = heads[known[heads] < 0]
        _, one = np.unique(key[heads], return_index=True)
        heads = heads[one][: self.remembered]
        if len(self.raw) + len(heads) > self.remembered:
            self.index, self.raw, self.place = HashIndex(), [], []
        if len(heads):
            self.index.add(key[heads], np.arange(len(self.raw), len(self.raw) + len(heads)))
            for k in heads.tolist():
                self.raw.append(texts[text[k]][p[k] : p[k] + n[k] + LENGTH - 1])
                self.place.append((int(doc[k]), int(tie[k]), int(p[k])))
        return np.flatnonzero(fresh), np.flatnonzero(again)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of contexts sorted by anchor: those whose anchor occurs again, HOT from HOT_CONTEXTS of one anchor on, and known repeats.

    An anchor's rows are held until there are HOT_CONTEXTS of them, which then
    go out as HOT like all that follow.
    """
    held: list[np.ndarray] | None = None  # rows of the anchor at hand; None: none yet
    sent = False  # whether it is hot already

    def out(rows, kind):
        return _batch(kind, *rows)

    for batch in batches:
        kind, *rows = (batch.column(k).to_numpy() for k in range(len(_NAMES)))
        told = kind == REPEAT
        if told.any():
            yield out([x[told] for x in rows], REPEAT)
            rows = [x[~told] for x in rows]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows)]
        h, doc, tie, p = rows[:4]
        if not len(h):
            continue
        # equal rows of one document (given twice) are one
        keep = _changed(h, doc, tie, p)
        rows = [x[keep] for x in rows]
        h = rows[0]
        edge = np.append(np.flatnonzero(_changed(h)), len(h))
        size = np.diff(edge)
        hot = size > HOT_CONTEXTS
        hot[0] |= sent
        several = (size > 1) & ~hot
        several[-1] = False
        for chosen, k in ((several, PLAIN), (hot, HOT)):
            mask = np.repeat(chosen, size)
            if sent and k == HOT:
                mask[0] = False  # the last row sent of the anchor, held to compare with
            if mask.any():
                yield out([x[mask] for x in rows], k)
        sent = bool(hot[-1])
        held = [x[-1:] if sent else x[edge[-2] :] for x in rows]
    if held is not None and not sent and len(held[0]) > 1:
        yield out(held, PLAIN)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memory: int = SORT_MEMORY) -> DataFrame:
    """(id, tie, spans: array of (s, e)) of the bytes to remove from each document that has any.

    (id, tie) is :func:`.common.document_key`; of equal rows these are the
    spans of the first one.
    """
    spark = docs.sparkSession
    plain = docs.select(*document_key(docs, id_col, text_col), F.col(text_col).alias("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        combiner = _Combiner()
        for batch in batches:
            ids, ties = (batch.column(k).to_numpy() for k in (0, 1))
            texts = [t.encode() for t in strings(batch, "text")]
            for pieces in _pieces(texts):
                for text, p, n, place, h, c in contexts(texts, pieces):
                    doc, tie = ids[text], ties[text]
                    fresh, again = combiner.split(texts, text, doc, tie, p, n, h, c)
                    yield _batch(PLAIN, h[fresh], doc[fresh], tie[fresh], p[fresh], n[fresh], place[fresh])
                    if len(again):
                        yield _batch(REPEAT, splitmix(doc[again].astype(U64)), doc[again], tie[again], p[again], n[again], np.zeros(1, np.int64))

    found = map_arrow(plain, find, _FOUND).repartition(parallelism(spark), "h").sortWithinPartitions("h", "id", "tie", "p")
    judged = written(map_arrow(found, _candidates, _FOUND), "contexts")
    candidates = judged.where(F.col("kind") != REPEAT)
    per_doc = candidates.groupBy("id", "tie").agg(F.collect_list(F.struct("p", "n", "h", "place", (F.col("kind") == HOT).alias("hot"))).alias("cut"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode() for t in strings(batch, "text")]
            lists = batch.column(3)
            of = lists.flatten()
            owner = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
            p, n, h, place = (of.field(k).to_numpy() for k in ("p", "n", "h", "place"))
            hot = of.field("hot").to_numpy(zero_copy_only=False)
            ids, ties = (batch.column(k).to_numpy()[owner] for k in (0, 1))
            plain_rows = np.flatnonzero(~hot)
            for k in range(0, len(plain_rows), 20_000):
                at = plain_rows[k : k + 20_000]
                raw = [texts[o][a:b] for o, a, b in zip(owner[at].tolist(), p[at].tolist(), (p[at] + n[at] + LENGTH - 1).tolist())]
                check = np.fromiter(map(zlib.crc32, raw), np.int64, len(raw))
                yield pa.RecordBatch.from_arrays([*map(pa.array, (h[at], check, ids[at], ties[at], p[at], n[at], place[at])), pa.array(raw, pa.binary())], _RECORD_NAMES)
            # windows of hot anchors: of those equal in a batch, all but the earliest go on without their bytes
            seen: dict[bytes, tuple] = {}
            out: list[tuple] = []
            rows = np.flatnonzero(hot)
            for k in rows[np.lexsort((p[rows], owner[rows]))].tolist():
                i, tie, a, size = int(ids[k]), int(ties[k]), int(p[k]), int(n[k])
                raw = texts[owner[k]][a : a + size + LENGTH - 1]
                hash_ = Prefix(np.frombuffer(raw, np.uint8)).slices(np.arange(size), np.arange(size) + LENGTH).view(np.int64).tolist()
                for q in range(size):
                    w, where = raw[q : q + LENGTH], (i, tie, a + q)
                    first = where <= seen.setdefault(w, where)
                    if first:
                        seen[w] = where
                    out.append((hash_[q], 0, i, tie, a + q, 1, -1, w if first else None))
                if len(out) > 50_000:
                    yield _records(out)
                    out, seen = [], {}
            if out:
                yield _records(out)

    texts = plain.join(per_doc.hint("merge"), ["id", "tie"]).select("id", "tie", "text", "cut")
    records = map_arrow(texts, cut, _RECORDS)
    records = records.repartition(parallelism(spark), "h").sortWithinPartitions("h", "c", "id", "tie", "p")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows = Shard(LENGTH, memory), []

        def settle(t: pa.Table) -> tuple[pa.Table, pa.RecordBatch]:
            """Sorted records without those told by equal bytes, and these as repeats."""
            raw = t.column("raw").combine_chunks()
            h, c, doc, tie, p, n = (t.column(k).to_numpy() for k in range(6))
            bare = raw.is_null().to_numpy(zero_copy_only=False)
            place = _changed(h, c, doc, tie, p)  # False for what an equal row, given twice, repeats
            real = np.flatnonzero(~bare & place)
            new = _changed(h[real], c[real])
            head = real[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(real) else real
            equal = pa.compute.equal(raw.take(pa.array(real)), raw.take(pa.array(head))).to_numpy(zero_copy_only=False)
            again = np.append(np.flatnonzero(bare), real[equal & ~new])
            return t.take(pa.array(real[new | ~equal])), _batch(REPEAT, np.zeros(1, np.int64), doc[again], tie[again], p[again], n[again], np.zeros(1, np.int64))

        def anchors(t: pa.Table) -> None:
            """Adds what has to be sorted to the shard, from all settled records of some anchors."""
            h, _, doc, tie, p, n = (t.column(k).to_numpy() for k in range(6))
            edge = np.append(np.flatnonzero(_changed(h)), len(h))
            several = np.flatnonzero(np.diff(edge) > 1)
            at = ragged(edge[several], np.diff(edge)[several])
            raws, places, chosen, a = t.column("raw").take(pa.array(at)).to_pylist(), t.column("place").to_numpy()[at].tolist(), [], 0
            for size in np.diff(edge)[several].tolist():
                chosen += [a + k for k in _sharing(raws[a : a + size], places[a : a + size])]
                a += size
            if chosen:
                mine = at[chosen]
                shard.add([raws[k] for k in chosen], n[mine])
                rows.append((doc[mine], tie[mine], p[mine]))

        # the settled records of the anchor at hand: one of each text, however often it comes
        rest: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            if not t.num_rows:
                continue
            rest, told = settle(t)
            yield told
            if not rest.num_rows:
                continue
            k = int(np.flatnonzero(_changed(rest.column("h").to_numpy()))[-1])
            if k:
                anchors(rest.slice(0, k))
                rest = rest.slice(k)
        if rest is not None:
            anchors(rest)
        if not rows:
            return
        doc, tie, p = (np.concatenate(x) for x in zip(*rows))
        rank = np.empty(len(doc), np.int64)
        rank[np.lexsort((p, tie, doc))] = np.arange(len(doc))
        for record, at in shard.repeats(rank):
            order = np.lexsort((at, record))
            record, at = record[order], at[order]
            edge = np.flatnonzero(_changed(record, at - np.arange(len(at))))
            r = record[edge]
            yield _batch(REPEAT, np.zeros(1, np.int64), doc[r], tie[r], p[r] + at[edge], np.diff(np.append(edge, len(at))), np.zeros(1, np.int64))

    late = written(map_arrow(records, sort, _FOUND), "sorted-spans")
    spans = judged.where(F.col("kind") == REPEAT).select("id", "tie", "p", "n").union(late.select("id", "tie", "p", "n"))
    return spans.groupBy("id", "tie").agg(F.collect_list(F.struct(F.col("p").alias("s"), (F.col("p") + F.col("n") + (LENGTH - 1)).alias("e"))).alias("spans"))


def _sharing(raws: list[bytes], places: list[int]) -> list[int]:
    """Numbers of those different records of one anchor, at the given places in them, that may share a window with another.

    A window they share has HALF bytes at least on one side of the anchor.  A
    record of one window (place -1) shares none.
    """
    left = [raw[p - HALF : p] if p >= HALF else None for raw, p in zip(raws, places)]
    right = [raw[p + K : p + K + HALF] if 0 <= p <= len(raw) - K - HALF else None for raw, p in zip(raws, places)]
    as_left, as_right = Counter(left), Counter(right)
    return [k for k, (a, b) in enumerate(zip(left, right)) if a is not None and as_left[a] > 1 or b is not None and as_right[b] > 1]


def _records(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in columns[:-1]), pa.array(columns[-1], pa.binary())], _RECORD_NAMES)


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True, memory: int = SORT_MEMORY) -> DataFrame:
    """``docs`` without the bytes of texts that are part of a LENGTH-byte string which also starts earlier.

    Earlier means in a document with a smaller integer id (null ids last),
    of one id in the row whose text has the smaller 64-bit hash, of equal rows
    in one of them, or further left in the same text; strings never cross
    documents, overlaps count, and all is judged on the input.  So of equal
    rows one is judged by what is before it, and the others keep only texts
    shorter than LENGTH.  Adds n_bytes, n_removed, n_spans and kept_sha256 (in
    place of columns of those names); ``text_col`` becomes what is left,
    without a character of which only a part is left, or is dropped with
    ``keep_text=False``.  Null texts count as empty and stay null; an empty
    table stays empty; ids that are no integers are refused.
    """
    added = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in added])
    spans = repeated_spans(docs, id_col, text_col, memory)
    names = docs.columns
    key, tie, extra, number = (free_name(docs, x) for x in ("key", "tie", "spans", "number"))
    at = names.index(text_col)
    id_, tie_ = document_key(docs, id_col, text_col)
    joined = docs.withColumns({key: id_, tie: tie_}).join(spans.toDF(key, tie, extra).hint("merge"), [key, tie], "left")
    joined = joined.withColumn(number, F.row_number().over(Window.partitionBy(key, tie).orderBy(tie)))
    schema = with_fields(docs, *zip(added, ("long", "long", "long", "string")))

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(at).to_pylist()
            text, rows = [], []
            for t, found, copy in zip(raw, batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist()):
                b = (t or "").encode()
                s = e = np.zeros(0, np.int64)
                if copy > 1 and len(b) >= LENGTH:
                    s, e = np.array([0]), np.array([len(b)])
                elif copy == 1 and found:
                    s, e = merged(np.array([x["s"] for x in found]), np.array([x["e"] for x in found]))
                cut = np.append(0, e).tolist(), np.append(s, len(b)).tolist()
                kept = b"".join([b[x:y] for x, y in zip(*cut)])
                text.append(None if t is None else kept.decode("utf-8", "ignore") if len(s) else t)
                rows.append((len(b), int((e - s).sum()), len(s), hashlib.sha256(kept).hexdigest()))
            columns = list(batch.columns[: len(names)])
            columns[at] = pa.array(text, pa.string())
            more = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(m, pa.int64()) for m in more[:3]), pa.array(more[3], pa.string())], [*names, *added])

    out = map_arrow(joined.select(*[f"`{c}`" for c in names], extra, number), rebuild, schema)
    return out if keep_text else out.drop(text_col)
