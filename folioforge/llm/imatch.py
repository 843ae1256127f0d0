"""I-Match fingerprints over randomised lexicons.

The lexicon holds the terms (lower-case words) whose document frequency, as a
part of all documents, lies in a band: too common terms say nothing, too rare
ones are noise.  A document's signature under a lexicon subset is the hash of
its sorted distinct terms in that subset.  Subsets keep a term with
probabilities from 1/4 down to 1/1024, so that some of them survive small
edits of long texts and large edits of short ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import integer_id, map_arrow, parallelism, release, strings, with_fields, written
from .sharding import interval
from .textnum import U64, splitmix, word_hashes

#: The band of document frequency: 1/2000 to 1/5 of the documents, that is an IDF of 1.6 to 7.6.
#: A document has its number of distinct terms in all frequencies together, so the
#: lexicon has at most 2000 times the mean number of distinct terms, whatever the corpus.
BAND = (1 / 2000, 1 / 5)
SUBSETS = 64
DIGITS = 6
EMPTY = "0" * DIGITS
LOWEST, HIGHEST = -(2**63), 2**63 - 1
#: Rows per range, in expectation, from which the ranges of ids are chosen.
SAMPLE = 100
HELD = 400_000
#: Terms of a lexicon, which every worker holds: beyond it the band has to be narrower.
LEXICON_TERMS = 1 << 23

_SEEDS = splitmix(np.arange(1, SUBSETS + 1, dtype=U64))
_KEEP = np.array([int(2.0 ** (62 - 8 * k / (SUBSETS - 1))) for k in range(SUBSETS)], dtype=U64)


def document_frequency(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(term hash, df): in how many rows each term occurs, summed in the task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            h, at = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            return h, np.bincount(at, np.concatenate([n for _, n in held])).astype(np.int64)

        def rows() -> pa.RecordBatch:
            h, n = merged()
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["term", "df"])

        for batch in batches:
            h, off = word_hashes(strings(batch, text_col))
            distinct = [np.unique(h[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
            if len(h):
                u, n = np.unique(np.concatenate(distinct), return_counts=True)
                held.append((u, n))
            if sum(len(x) for x, _ in held) > HELD:
                held = [merged()]
                if len(held[0][0]) > HELD // 2:
                    yield rows()
                    held = []
        if held:
            yield rows()

    return map_arrow(docs.select(text_col), run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def lexicon(docs: DataFrame, band: tuple[float, float] = BAND, text_col: str = "text") -> np.ndarray:
    """Sorted hashes of the terms inside the band; its size is bounded as said at BAND."""
    n = docs.count()
    low, high = max(2.0, band[0] * n), band[1] * n
    chosen = written(document_frequency(docs, text_col).where((F.col("df") >= low) & (F.col("df") <= high)).select("term"), "lexicon")
    if (size := chosen.count()) > LEXICON_TERMS:
        raise ValueError(f"{size} terms lie in the band {band}: give a narrower one")
    terms = np.sort(chosen.toPandas()["term"].to_numpy(np.int64).view(U64))
    release(chosen)
    return terms


def fingerprint(terms: np.ndarray, lexicon: np.ndarray, text: str) -> str:
    """Signatures of one text, DIGITS hexadecimal digits for each subset; zeros where a subset has no term."""
    u = np.unique(terms)
    if len(lexicon) and len(u):
        at = np.minimum(np.searchsorted(lexicon, u), len(lexicon) - 1)
        banded = u[lexicon[at] == u]
        u = banded if len(banded) else u
    if not len(u):
        return hashlib.blake2b(text.encode(), digest_size=DIGITS // 2).hexdigest() * SUBSETS
    inside = splitmix(u[:, None] ^ _SEEDS) < _KEEP
    hit = inside.any(axis=0)
    return "".join([hashlib.blake2b(u[inside[:, k]].tobytes(), digest_size=DIGITS // 2).hexdigest() if hit[k] else EMPTY for k in range(SUBSETS)])


def likeness(a: str, b: str) -> float:
    """Part of the subsets filled on either side on which two fingerprints agree; 1 for equal ones."""
    if a == b:
        return 1.0
    same = filled = 0
    for k in range(0, len(a), DIGITS):
        x, y = a[k : k + DIGITS], b[k : k + DIGITS]
        if x != EMPTY or y != EMPTY:
            filled += 1
            same += x == y
    return same / filled if filled else 0.0


def fingerprints(docs: DataFrame, words: np.ndarray, text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``fingerprint`` (in place of one of that name).

    A text none of whose terms is in the lexicon is fingerprinted over all its
    terms, one without terms over its characters (null: empty).
    """
    shared = docs.sparkSession.sparkContext.broadcast(words)
    kept = [c for c in docs.columns if c.lower() != "fingerprint"]
    plain = docs.select(*[f"`{c}`" for c in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch, text_col)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_prints(texts, shared.value), pa.string())], [*kept, "fingerprint"])

    return map_arrow(plain, run, with_fields(plain, ("fingerprint", "string")))


def _prints(texts: list[str], words: np.ndarray) -> list[str]:
    h, off = word_hashes(texts)
    return [fingerprint(h[a:b], words, t) for t, a, b in zip(texts, off[:-1].tolist(), off[1:].tolist())]


def fingerprints_with_edits(docs: DataFrame, words: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text.

    The edited text has its last floor(n_chars / 2) code points replaced by
    the first as many (or all) of the next document by descending integer id;
    after the last comes the first.  Null ids come last; rows of one id are
    ordered by a hash of the text.  Returns (id_col, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next), one row per
    input row; a null text is empty.  A single document is its own next; an
    empty table gives no rows; ids that are no integers are refused; other
    columns are not read.

    Rows are dealt once to ranges of (id, hash); each range also gets the
    first row of the range after it, so no order over all rows is needed.
    """
    spark = docs.sparkSession
    id_type = integer_id(docs, id_col)
    # descending ids are ascending complements
    key = F.bitwise_not(F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)))
    plain = docs.select(F.col(id_col), F.col(text_col), key.alias("_key"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_tie"))
    rows = plain.count()
    if not rows:
        return spark.createDataFrame([], _EDIT_SCHEMA.format(id_col, id_type))
    parts = parallelism(spark)
    # the sample only balances the ranges; about SAMPLE rows a range come to the driver
    chosen = F.pmod(F.xxhash64("_key", "_tie"), F.lit(1 << 40)) < int(min(1.0, SAMPLE * parts / rows) * (1 << 40))
    sample = sorted((r[0], r[1]) for r in plain.where(chosen).select("_key", "_tie").distinct().collect())
    bounds = sorted({sample[len(sample) * k // parts] for k in range(1, parts)}) if sample else []
    bound_key, bound_tie = (np.array([b[k] for b in bounds], np.int64) for k in (0, 1))

    def part_of(batch: pa.RecordBatch, at: int) -> np.ndarray:
        return interval(bound_key, bound_tie, batch.column(at).to_numpy(), batch.column(at + 1).to_numpy())

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple] = {}
        for batch in batches:
            k, t, p = batch.column(0).to_numpy(), batch.column(1).to_numpy(), part_of(batch, 0)
            order = np.lexsort((t, k, p))
            for j in order[np.append(True, p[order][1:] != p[order][:-1])].tolist() if len(order) else []:
                found[int(p[j])] = min(found.get(int(p[j]), (HIGHEST, HIGHEST)), (int(k[j]), int(t[j])))
        if found:
            columns = list(found), [x[0] for x in found.values()], [x[1] for x in found.values()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["p", "k", "t"])

    firsts = map_arrow(plain.select("_key", "_tie"), least, "p long, k long, t long").groupBy("p").agg(F.min(F.struct("k", "t")).alias("m"))
    first = {r[0]: (r[1].k, r[1].t) for r in firsts.collect()}  # a row per range
    order = sorted(first)
    before = {first[order[(j + 1) % len(order)]]: p for j, p in enumerate(order)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = set()  # first rows that this task has sent ahead: equal rows need not follow
        for batch in batches:
            part = part_of(batch, 2)
            ahead = [(j, place) for j, place in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())) if place in before]
            ahead = [(j, before[place]) for j, place in ahead if not (place in sent or sent.add(place))]
            take = pa.array([*range(batch.num_rows), *(j for j, _ in ahead)], pa.int64())
            more = pa.array(np.append(part, [p for _, p in ahead]).astype(np.int32)), pa.array([False] * batch.num_rows + [True] * len(ahead))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in range(4)), *more], [id_col, text_col, "_key", "_tie", "_part", "_ahead"])

    dealt = map_arrow(plain, deal, f"`{id_col}` {id_type}, `{text_col}` string, _key long, _tie long, _part int, _ahead boolean")
    dealt = dealt.repartitionById(len(bounds) + 1, F.col("_part")).sortWithinPartitions("_ahead", "_key", "_tie").select(id_col, text_col, "_ahead")
    shared = spark.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        kind, held = None, []  # rows (id, text, fingerprint) whose next is not yet known

        def out(rows: list[tuple]) -> pa.RecordBatch:
            edited = [t[: len(t) - len(t) // 2] + after[: len(t) // 2] for (_, t, _), (_, after, _) in zip(rows[:-1], rows[1:])]
            prints = _prints(edited, words)
            got = [(k, len(t), hashlib.sha256(e.encode()).hexdigest(), p, q, likeness(p, q), likeness(p, following[2])) for (k, t, p), e, q, following in zip(rows, edited, prints, rows[1:])]
            columns = zip(*got)
            types = (kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], _EDIT_NAMES(id_col))

        last = False
        for batch in batches:
            kind = batch.schema.types[0]
            texts = strings(batch, text_col)
            flags = batch.column(2).to_pylist()
            n = flags.index(True) if True in flags else len(flags)
            take = 0 if last else min(len(flags), n + 1)
            if take:
                rows = held + list(zip(batch.column(0).to_pylist()[:take], texts[:take], _prints(texts[:take], words)))
                last = n < len(flags)
                if len(rows) > 1:
                    yield out(rows)
                held = rows[-1:]

    return map_arrow(dealt, run, _EDIT_SCHEMA.format(id_col, id_type))


_EDIT_SCHEMA = "`{}` {}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _EDIT_NAMES(id_col: str) -> list[str]:
    return [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
