"""Hard-negative mining by distributed radix selection over integer scores.

Every anchor has windows of scores: all rows of its label for its positives,
and one window a positive for the negatives.  The rows of a window stand in a
fixed order (score from high to low, then id), so the place of a row is an
integer key.  A round counts the live rows of every window in 256 buckets of
keys, in the tasks that hold the rows; the counts are summed in a shuffle, and
the bucket that holds the k-th row is opened with the next eight bits, first
of the score, then, where one score has too many rows, of the id.  A window
stands still once at most GATHER rows precede the end of its bucket; these are
then gathered and ranked.  No round moves a vector.

Anchors are taken in blocks of about BLOCK, which go out with the tasks; so
what the driver and a task hold does not grow with the table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import integer_id, map_arrow, release, shared_dir, tune, written

RADIX_BITS = 8
RADIX = 1 << RADIX_BITS
#: Anchors of one block, on average, and rows that a task scores against them at once.
BLOCK, ROWS = 1024, 256
#: A window is gathered once so few rows precede the end of the bucket of its k-th row.
GATHER = 64

OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def scaled(vector: Column, scale: int = 256) -> Column:
    """The components as integers: floor(scale * x), x as double."""
    y = lambda x: F.lit(float(scale)) * x.cast("double")
    return F.transform(vector, lambda x: F.when(F.abs(y(x)) < 2.0**53, F.floor(y(x))).otherwise(F.raise_error(F.lit("a component is too large for integer scores")).cast("long")))


def _shift_of(span: int) -> int:
    return max(0, int(span).bit_length() - RADIX_BITS)


@dataclass
class Windows:
    """The state of a selection; one entry a window.

    A key is hi - score while ``by_id`` is false, and id - least id among the
    rows of score ``top`` afterwards.  [base, base + 2^(shift + 8)) is live.
    """

    anchor: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    k: int
    same_label: bool
    base: np.ndarray = field(init=False)
    shift: np.ndarray = field(init=False)
    by_id: np.ndarray = field(init=False)
    top: np.ndarray = field(init=False)
    before: np.ndarray = field(init=False)
    limit: np.ndarray = field(init=False)
    done: np.ndarray = field(init=False)

    def __post_init__(self):
        n = len(self.anchor)
        span = np.maximum(self.hi - self.lo, 0)
        self.base, self.before, self.top, self.limit = (np.zeros(n, np.int64) for _ in range(4))
        self.shift = np.array([_shift_of(int(s)) for s in span], np.int64)
        self.by_id = np.zeros(n, bool)
        self.limit = span.copy()
        self.done = self.hi < self.lo

    def advance(self, found: pa.Table, id_span: int) -> None:
        """Takes the summed counts (window, digit, before, n) of a round."""
        window, digit, before, n = (found.column(c).to_numpy() for c in ("window", "digit", "before", "n"))
        order = np.lexsort((digit, window))
        seen = set()
        for w, d, b, m in zip(*(x[order].tolist() for x in (window, digit, before, n))):
            if self.done[w] or w in seen:
                continue
            passed = int(self.before[w]) + b
            if passed + m < self.k:
                continue
            seen.add(w)
            begin = int(self.base[w]) + (d << int(self.shift[w]))
            end = begin + (1 << int(self.shift[w])) - 1
            if passed + m <= GATHER or (self.by_id[w] and self.shift[w] == 0):
                self.limit[w], self.done[w] = end, True
            elif self.shift[w] > 0:
                self.base[w], self.before[w], self.shift[w] = begin, passed, max(0, int(self.shift[w]) - RADIX_BITS)
            else:  # one score, too many rows: on to their ids
                self.top[w], self.by_id[w], self.before[w], self.base[w] = self.hi[w] - begin, True, passed, 0
                self.shift[w] = _shift_of(id_span)
        for w in np.flatnonzero(~self.done).tolist():
            if w not in seen:  # fewer than k rows: all of the window's
                self.limit[w] = id_span if self.by_id[w] else self.hi[w] - self.lo[w]
                self.done[w] = True


@dataclass
class Block:
    """A block of anchors of one vector length."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Exact inner products, anchors by rows."""
        if not x.size or not self.vectors.size:
            return np.zeros((len(self.vectors), len(x)), np.int64)
        bound = int(np.abs(self.vectors).max()) * int(np.abs(x).max()) * x.shape[1]
        if bound < 1 << 53:
            return (self.vectors.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
        if bound < 1 << 62:
            return self.vectors @ x.T
        raise OverflowError("scores of these vectors may exceed 64 bits")


def _pieces(batch: pa.RecordBatch, d: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, vectors) of the rows of length ``d``, a few at a time."""
    vector = batch.column(2)
    size = np.diff(vector.offsets.to_numpy())
    flat = vector.flatten().to_numpy(zero_copy_only=False)
    begin = np.cumsum(size) - size
    ids, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    rows = np.flatnonzero(size == d)
    for a in range(0, len(rows), ROWS):
        r = rows[a : a + ROWS]
        yield ids[r], labels[r], flat[begin[r][:, None] + np.arange(d)] if d else np.zeros((len(r), 0), np.int64)


def _eligible(block: Block, w: Windows, live: np.ndarray, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
    """(scores, rows that the windows ``live`` may hold), windows by rows."""
    a = w.anchor[live]
    s = block.scores(x)[a]
    label = block.labels[a][:, None] == labels[None, :]
    ok = label & (block.ids[a][:, None] != ids[None, :]) if w.same_label else ~label
    return s, ok & (s <= w.hi[live][:, None]) & (s >= w.lo[live][:, None])


def _counts(vectors: DataFrame, block: Block, w: Windows, least: int) -> DataFrame:
    """(window, digit, before, n): the buckets of live rows that begin before the k-th row, summed over all tasks."""
    live = np.flatnonzero(~w.done)
    d = block.vectors.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        histogram = np.zeros(len(live) << RADIX_BITS, np.int64)
        by_id, top, hi = (x[live][:, None] for x in (w.by_id, w.top, w.hi))
        base, shift = w.base[live][:, None], w.shift[live][:, None]
        for batch in batches:
            for ids, labels, x in _pieces(batch, d):
                s, ok = _eligible(block, w, live, ids, labels, x)
                ok &= ~by_id | (s == top)
                key = np.where(by_id, (ids.astype(np.uint64) - np.uint64(least % (1 << 64))).astype(np.int64)[None, :], hi - s)
                digit = (key - base) >> shift
                ok &= (key >= base) & (digit < RADIX)
                i, j = np.nonzero(ok)
                histogram += np.bincount((i << RADIX_BITS) + digit[i, j], minlength=len(histogram))
        at = np.flatnonzero(histogram)
        for a in range(0, len(at), 1 << 16):
            part = at[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(live[part >> RADIX_BITS].astype(np.int32)), pa.array((part & (RADIX - 1)).astype(np.int32)), pa.array(histogram[part])], ["window", "digit", "n"]
            )

    summed = map_arrow(vectors, run, "window int, digit int, n long").groupBy("window", "digit").agg(F.sum("n").alias("n"))
    ordered = Window.partitionBy("window").orderBy("digit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return summed.withColumn("before", F.sum("n").over(ordered) - F.col("n")).where(F.col("before") < w.k)


def _select(vectors: DataFrame, block: Block, w: Windows, least: int, greatest: int) -> DataFrame:
    """(window, rank, id, score): the first k rows of every window."""
    while not w.done.all():
        w.advance(_counts(vectors, block, w, least).toArrow(), greatest - least)
    live = np.flatnonzero(w.hi >= w.lo)
    d = block.vectors.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_id, top, hi, limit = (x[live][:, None] for x in (w.by_id, w.top, w.hi, w.limit))
        for batch in batches:
            for ids, labels, x in _pieces(batch, d):
                s, ok = _eligible(block, w, live, ids, labels, x)
                place = (ids.astype(np.uint64) - np.uint64(least % (1 << 64))).astype(np.int64)[None, :]
                ok &= np.where(by_id, (s > top) | ((s == top) & (place <= limit)), hi - s <= limit)
                i, j = np.nonzero(ok)
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(live[i].astype(np.int32)), pa.array(ids[j]), pa.array(s[i, j])], ["window", "id", "score"])

    ordered = Window.partitionBy("window").orderBy(F.desc("score"), "id")
    gathered = map_arrow(vectors, run, "window int, id long, score long")
    return gathered.withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= w.k)


def _positive_windows(block: Block, longest: int, k: int) -> Windows:
    """One window an anchor: every score that vectors of squared length up to ``longest`` can have."""
    reach = np.array([isqrt(sum(c * c for c in v) * longest) + 1 for v in block.vectors.tolist()], np.int64)
    return Windows(np.arange(len(block.ids)), -reach, reach, k, True)


def mine_hard_negatives(
    df: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """Hard negatives of every anchor and positive.

    A score is the inner product of components floor(scale * x).  The
    positives of an anchor are its first ``positives`` other rows of the same
    label by score from high to low, then by id; the negatives of a positive
    are the first ``negatives`` rows of another label whose score is between
    ``low`` and ``high`` per cent of the positive's.  Returns (anchor_id,
    positive_id, rank from 1, negative_id, positive_score, negative_score).

    Rows with a null id, label or vector, or a null or non-finite component
    take no part.  Repeated rows (id, label and integer components alike)
    count once; rows that share an id but not their vector are rows of their
    own, but for being positives of their id.  Vectors of different length
    have no score; empty vectors score 0.  A positive of negative score has
    no negatives.  Scores that 64 bits may not hold are an error.  An empty
    table gives no rows; other columns are not read, whatever their names.
    """
    spark = df.sparkSession
    tune(spark)
    integer_id(df, id_col)
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    label = F.col(label_col).cast("long") if isinstance(df.schema[label_col].dataType, IntegralType) else F.xxhash64(label_col)
    usable = df.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull() & finite)
    rows = usable.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), scaled(v, scale).alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("anchor")).distinct()
    rows = written(rows, "scaled-vectors")
    square = F.aggregate("vector", F.lit(0).cast("decimal(38,0)"), lambda s, x: (s + x.cast("decimal(19,0)") * x).cast("decimal(38,0)"))
    least, greatest, longest = rows.agg(F.min("id"), F.max("id"), F.max(square)).first()
    out = f"{shared_dir(spark)}/hard-negatives-{uuid.uuid4().hex}"
    spark.createDataFrame([], OUT).write.parquet(out)
    anchors, vectors = rows.where("anchor"), rows.select("id", "label", "vector")
    if least is not None and greatest - least >= 1 << 62:
        raise OverflowError("the ids span more than 62 bits")
    for d, n in anchors.groupBy(F.size("vector").alias("d")).count().orderBy("d").toLocalIterator():
        parts = -(-n // BLOCK)
        part = F.pmod(F.xxhash64("id", "label", "vector", F.lit(7)), F.lit(parts))
        for p in range(parts):
            got = anchors.where((F.size("vector") == d) & (part == p)).select("id", "label", "vector").toArrow()
            if not len(got):
                continue
            block = Block(got["id"].to_numpy(), got["label"].to_numpy(), np.array(got["vector"].to_pylist(), np.int64).reshape(len(got), d))
            first = _select(vectors, block, _positive_windows(block, int(longest), positives), least, greatest).toArrow()
            if not len(first):
                continue
            at, score, positive = first["window"].to_numpy(), first["score"].to_numpy(), first["id"].to_numpy()
            lo, hi = (np.array(x, np.int64) for x in zip(*((-(-low * x // 100), high * x // 100) for x in score.tolist())))  # in wide integers
            window = Windows(at, lo, hi, negatives, False)
            of = pa.table({"window": pa.array(np.arange(len(at), dtype=np.int32)), "anchor_id": pa.array(block.ids[at]), "positive_id": pa.array(positive), "positive_score": pa.array(score)})
            found = _select(vectors, block, window, least, greatest).join(F.broadcast(spark.createDataFrame(of)), "window")  # at most positives * 2 BLOCK rows
            found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(out)
    release(rows)
    return spark.read.schema(OUT).parquet(out)
