"""Line deduplication within a bound of edits, by a deletion-neighbourhood join.

Equal lines meet by their hash.  The deletion neighbourhood of a line is the
line and what is left of it without up to ``edits`` of its characters.  Two
lines are within one edit (substitution, insertion or deletion) exactly if one
is a deletion variant of the other, or both leave the same variant when the
character at the same place is deleted.  Variants are emitted as hashed keys,
equal keys are joined, and what is joined is verified by its edit distance.
For bounds over one, places are counted in what is left: two lines that leave
the same variant are within the bound exactly if the places deleted from either
(one as often as the line that has it more often) are no more than the bound.

Of lines within the bound, the shorter one cut into ``edits + 1`` parts has a
part that no edit touches (for one edit, its first or its last half); only
lines that share such a part with another line emit variants.  No pair is lost
by that, and most lines emit nothing.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import document_key, free_name, map_arrow, parallelism, release, strings, with_fields, written
from .textnum import _BASE_INVERSE, U64, Prefix, chunks, codepoints, splitmix

#: Lines shorter than this are compared exactly, as one edit would make another word of them.
EDIT_FROM = 16


def shared_parts(edits: int) -> list[tuple[int, int, int]]:
    """(characters more than the shorter line, part, shift of the part) that lines within ``edits`` can share.

    What comes before a part shifts it by the insertions less the deletions
    there, and what comes after makes up for the rest of the lengths' difference.
    """
    out = []
    for more in range(edits + 1):
        for part in range(edits + 1):
            for shift in range(-edits, edits + 1):
                before = shift == 0 if part == 0 else shift == more if part == edits else abs(shift) + abs(more - shift) <= edits
                if before:
                    out.append((more, part, shift))
    return out


def line_keys(lines: list[str], edits: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each line, and a key for each of the parts it can share with a line within ``edits``."""
    kinds = shared_parts(edits)
    h, parts = np.zeros(len(lines), U64), np.zeros((len(lines), len(kinds)), U64)
    for x, y in chunks(lines):
        cp, off = codepoints(lines[x:y])
        if not len(cp):
            continue
        prefix, s, e = Prefix(cp), off[:-1], off[1:]
        h[x:y] = prefix.slices(s, e)
        for k, (more, part, shift) in enumerate(kinds):
            t = np.maximum(e - s - more, 0)
            begin, end = (np.clip(s + t * n // (edits + 1) + shift, s, e) for n in (part, part + 1))
            parts[x:y, k] = splitmix(prefix.slices(begin, end) ^ splitmix((t * (edits + 1) + part).astype(U64)))
    return h, parts


def variants(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line number, place of the deletion or -1 for the whole line, key) of all deletion variants.

    Deleting any character of a run of equal ones leaves the same variant; it
    is emitted with every place of the run, as another line can differ at any.
    """
    out = []
    inverse = U64(_BASE_INVERSE)
    for x, y in chunks(lines, 1 << 18):
        cp, off = codepoints(lines[x:y])
        if not len(cp):
            continue
        p, size = Prefix(cp), np.diff(off)
        owner = np.repeat(np.arange(len(size)), size)
        s, e = off[:-1][owner], off[1:][owner]
        at = np.arange(len(cp))
        raw = (p._sum[at] - p._sum[s] + (p._sum[e] - p._sum[at + 1]) * inverse) * p._inverse[s]
        whole = (p._sum[off[1:]] - p._sum[off[:-1]]) * p._inverse[off[:-1]]
        raw = np.concatenate((raw, whole))
        left = np.concatenate((e - s - 1, size))
        key = splitmix(raw ^ splitmix(left.astype(U64)))
        out.append((np.concatenate((owner, np.arange(len(size)))) + x, np.concatenate((at - s, np.full(len(size), -1))), key))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
    return tuple(np.concatenate(c) for c in zip(*out))


def bounded_variants(lines: list[str], edits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(line number, keys, sides) of all variants of up to ``edits`` deletions, a set of deletions from one character on at a time.

    Variants of i and of j deletions pair if they have i + j - edits places in
    common, and a key is what is left with these places, i and j.  Side 0 has
    i > j deletions, side 1 has j, and where i = j all are side 2.
    """
    shapes = [(i, j, max(0, i + j - edits)) for i in range(1, edits + 1) for j in range(i + 1)]
    inverse = U64(_BASE_INVERSE)
    for number, line in enumerate(lines):
        cp, _ = codepoints([line])
        n, total = len(cp), Prefix(cp)._sum
        for d in range(min(edits, n) + 1):
            for first in range(n - d + 1) if d else (-1,):
                rest = list(itertools.combinations(range(first + 1, n), d - 1)) if d else [()]
                gone = np.array(rest, np.int64).reshape(len(rest), max(d - 1, 0))
                if d:
                    gone = np.column_stack((np.full(len(rest), first), gone))
                raw, begin, scale = np.zeros(len(rest), U64), np.zeros(len(rest), np.int64), np.ones(1, U64)
                for c in range(d):
                    raw += (total[gone[:, c]] - total[begin]) * scale
                    begin, scale = gone[:, c] + 1, scale * inverse
                raw += (total[n] - total[begin]) * scale
                left = splitmix(raw ^ splitmix(np.array([n - d], U64)))
                places = (gone - np.arange(d)).astype(U64)
                keys, sides = [], []
                for i, j, common in shapes:
                    if d not in (i, j):
                        continue
                    for chosen in itertools.combinations(range(d), common):
                        key = splitmix(left + U64(i * (edits + 1) + j))
                        for c in chosen:
                            key = splitmix(key ^ splitmix(places[:, c]))
                        keys.append(key)
                        sides.append(np.full(len(key), 2 if i == j else int(d == j), np.int32))
                if keys:
                    yield number, np.concatenate(keys), np.concatenate(sides)


def within_one_edit(a: str, b: str) -> bool:
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    if len(a) == len(b):
        return a[k + 1 :] == b[k + 1 :]
    return a[k + 1 :] == b[k:] if len(a) > len(b) else a[k:] == b[k + 1 :]


def within_edits(a: str, b: str, edits: int) -> bool:
    if edits < 2:
        return within_one_edit(a, b) if edits else a == b
    if abs(len(a) - len(b)) > edits:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    if k == max(len(a), len(b)):
        return True
    return any(within_edits(a[x:], b[y:], edits - 1) for x, y in ((k + 1, k + 1), (k + 1, k), (k, k + 1)))


def _lines(text: str) -> list[tuple[int, str]]:
    """Number and stripped text of each line that is not blank."""
    return [(k, x) for k, line in enumerate(text.split("\n")) if (x := line.strip())]


def _joined_variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (line, an earlier line within one edit) from variants sorted by key, place and position.

    Lines with one key and place differ in one character there.  A whole line
    (place -1) and a variant of its key differ by one insertion.  Each line
    is paired with the earliest such line, so the pairs of a key are as many
    as its lines.
    """

    def pairs(key, place, h, i, tie, no) -> pa.RecordBatch:
        n = len(key)
        new_key = np.append(True, key[1:] != key[:-1])
        new_place = new_key | np.append(True, place[1:] != place[:-1])
        group = np.cumsum(new_key) - 1
        first = np.flatnonzero(new_key)
        # order of position among all rows here
        rank = np.empty(n, np.int64)
        rank[np.lexsort((h, no, tie, i))] = np.arange(n)
        a = [np.flatnonzero(~new_place & (place >= 0))]
        b = [np.flatnonzero(new_place)[np.cumsum(new_place) - 1][a[0]]]
        whole = place[first] < 0
        row = np.flatnonzero(place >= 0)
        at = first[group[row]]
        ok = whole[group[row]] & (rank[at] < rank[row])
        a.append(row[ok])
        b.append(at[ok])
        least = np.full(len(first), n)
        np.minimum.at(least, group[row], rank[row])
        by_rank = np.argsort(rank)
        g = np.flatnonzero(whole & (least < n))
        g = g[least[g] < rank[first[g]]]
        a.append(first[g])
        b.append(by_rank[least[g]])
        x, y = np.concatenate(a), np.concatenate(b)
        keep = h[x] != h[y]
        return pa.RecordBatch.from_arrays([pa.array(h[x[keep]]), pa.array(h[y[keep]])], ["h", "other"])

    rest = None
    for batch in batches:
        columns = [batch.column(c).to_numpy() for c in range(6)]
        if rest is not None:
            columns = [np.concatenate(x) for x in zip(rest, columns)]
        if not len(columns[0]):
            continue
        k = int(np.searchsorted(columns[0], columns[0][-1]))
        if k:
            yield pairs(*(c[:k] for c in columns))
        rest = [c[k:] for c in columns]
    if rest is not None:
        yield pairs(*rest)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edit_from: int = EDIT_FROM, edits: int = 1) -> DataFrame:
    """``docs`` with repeated lines removed from ``text_col``; adds n_lines and n_removed.

    Lines are split at line feeds and compared without white space at their
    ends; blank lines stay.  A line is removed if an equal line, or, for lines
    of at least ``edit_from`` characters, one within ``edits`` edits of it
    comes earlier (rows grow with a line's length to the power of ``edits``,
    so bounds over 1 are for short lines; 0 compares exactly): in a document with a smaller integer id (null ids last), of one
    id in the row whose text has the smaller 64-bit hash, of equal rows in one
    of them, or higher up in the same document.  So of equal rows one is
    judged by what is before it, and the others keep only blank lines.  All
    lines are judged on the input.  Null texts stay null with 0 lines; an
    empty table stays empty; other columns are kept (n_lines and n_removed
    replace columns of those names, in any case); ids that are no integers
    are refused.
    """
    if edits < 0:
        raise ValueError("edits is negative")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("n_lines", "n_removed")])
    spark = docs.sparkSession
    plain = docs.select(*document_key(docs, id_col, text_col), F.col(text_col).alias("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, number, line = [], [], []
            for k, t in enumerate(strings(batch, "text")):
                for n, x in _lines(t):
                    row.append(k)
                    number.append(n)
                    line.append(x)
            h, parts = line_keys(line, edits)
            at = pa.array(row, pa.int64())
            short = np.fromiter((not edits or len(x) < edit_from for x in line), bool, len(line))
            parts = [None if s else x for s, x in zip(short.tolist(), parts.view(np.int64))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(number, pa.int32()), pa.array(h.view(np.int64)), pa.array(parts, pa.list_(pa.int64()))],
                ["id", "tie", "no", "h", "parts"],
            )

    found = written(map_arrow(plain, find, "id long, tie long, no int, h long, parts array<long>"), "lines")
    first = found.groupBy("h").agg(F.min(F.struct("id", "tie", "no")).alias("first"), F.any_value("parts").alias("parts"))
    first = written(first, "first-lines")
    part = first.select("h", F.explode(F.array_distinct("parts")).alias("part"))
    # least and greatest are combined before their exchange, and a part that many lines have is no more rows in the join than they are
    shared = part.groupBy("part").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a != b").select("part")
    suspect = part.join(shared, "part").select("h").distinct()
    place = [F.col(f"first.{c}").alias(c) for c in ("id", "tie", "no")]
    where = written(suspect.join(first, "h").select("h", *place), "suspect-places")
    per_doc = where.groupBy("id", "tie").agg(F.collect_set("no").alias("nos"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            line, owner, number = [], [], []
            for k, (t, nos) in enumerate(zip(strings(batch, "text"), batch.column(3).to_pylist())):
                wanted = set(nos)
                for n, x in _lines(t):
                    if n in wanted:
                        line.append(x)
                        owner.append(k)
                        number.append(n)
            h, _ = line_keys(line)
            at = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column(0).take(at), batch.column(1).take(at), pa.array(number, pa.int32()), pa.array(line, pa.string())], ["h", "id", "tie", "no", "line"])

    texts = plain.join(per_doc.hint("merge"), ["id", "tie"]).select("id", "tie", "text", "nos")
    # equal rows give a line more than once
    suspects = written(map_arrow(texts, cut, "h long, id long, tie long, no int, line string").dropDuplicates(["h"]), "suspect-lines")

    def neighbourhood(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, place, key = variants(strings(batch, "line"))
            for k in range(0, len(owner), 1 << 16):
                o = pa.array(owner[k : k + (1 << 16)])
                yield pa.RecordBatch.from_arrays([pa.array(key[k : k + (1 << 16)].view(np.int64)), pa.array(place[k : k + (1 << 16)], pa.int32()), *(batch.column(c).take(o) for c in range(4))], ["key", "place", "h", "id", "tie", "no"])

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, rows = [], 0
            for number, key, side in itertools.chain(bounded_variants(strings(batch, "line"), edits), [(0, None, None)]):
                if rows and (key is None or rows + len(key) > 1 << 16):
                    owner, keys, sides = (np.concatenate(x) for x in zip(*held))
                    o = pa.array(owner)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(sides), *(batch.column(c).take(o) for c in range(4))], ["key", "side", "h", "id", "tie", "no"])
                    held, rows = [], 0
                if key is not None:
                    held.append((np.full(len(key), number), key, side))
                    rows += len(key)

    line_at = suspects.select("h", "id", "tie", "no", "line")
    if edits < 2:
        v = map_arrow(line_at, neighbourhood, "key long, place int, h long, id long, tie long, no int")
        v = v.repartition(parallelism(spark), "key").sortWithinPartitions("key", "place", "id", "tie", "no", "h")
        pair = map_arrow(v, _joined_variants, "h long, other long").distinct()
    else:
        v = map_arrow(line_at, bounded, "key long, side int, h long, id long, tie long, no int").withColumn("at", F.struct("id", "tie", "no", "h"))
        # all of a key on one side pair with all on the other, so the earliest one there is enough
        earliest = v.groupBy("key", "side").agg(F.min("at").alias("other"))
        earliest = earliest.withColumn("side", F.when(F.col("side") < 2, 1 - F.col("side")).otherwise(2))
        pair = v.join(earliest, ["key", "side"]).where("other < at").select("h", F.col("other.h").alias("other")).distinct()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [within_edits(a, b, edits) for a, b in zip(strings(batch, "line"), strings(batch, "other_line"))]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok, pa.bool_()))], ["h"])

    both = pair.join(suspects.select("h", "line"), "h").join(suspects.select(F.col("h").alias("other"), F.col("line").alias("other_line")), "other")
    near = written(map_arrow(both.select("h", "line", "other_line"), verify, "h long").distinct(), "near-lines")
    release(where, suspects)

    marked = found.select("id", "tie", "no", "h").join(first.select("h", "first").join(near.withColumn("near", F.lit(True)), "h", "left"), "h")
    gone = marked.where(F.col("near").isNotNull() | (F.col("first.id") != F.col("id")) | (F.col("first.tie") != F.col("tie")) | (F.col("first.no") != F.col("no")))
    gone = written(gone.groupBy("id", "tie").agg(F.collect_set("no").alias("gone")), "removed-lines")
    release(found, first, near)

    key, tie, extra, number = (free_name(docs, x) for x in ("key", "tie", "gone", "number"))
    names = docs.columns
    id_, tie_ = document_key(docs, id_col, text_col)
    joined = docs.withColumns({key: id_, tie: tie_}).join(gone.toDF(key, tie, extra).hint("merge"), [key, tie], "left")
    joined = joined.withColumn(number, F.row_number().over(Window.partitionBy(key, tie).orderBy(tie)))
    at = names.index(text_col)
    schema = with_fields(docs, ("n_lines", "long"), ("n_removed", "long"))

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, lines, removed = [], [], []
            for t, drop, copy in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist()):
                parts = t.split("\n") if t else []
                lines.append(len(parts))
                out = {k for k, _ in _lines(t or "")} if copy > 1 else set(drop or ())
                removed.append(len(out))
                text.append("\n".join([x for k, x in enumerate(parts) if k not in out]) if out else t)
            columns = list(batch.columns[: len(names)])
            columns[at] = pa.array(text, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(removed, pa.int64())], [*names, "n_lines", "n_removed"])

    return map_arrow(joined.select(*[f"`{c}`" for c in names], extra, number), rebuild, schema)


def digest(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """kept_sha256 in place of the text."""
    return docs.withColumn("kept_sha256", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).drop(text_col)


__all__ = ["dedup_lines", "digest", "line_keys", "variants", "within_edits", "within_one_edit"]
