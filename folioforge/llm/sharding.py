"""Sharding of documents by histogram sort.

Rows are ordered by (hash of the text, id), so equal texts lie together.
Every round counts the exact bytes and rows below a set of candidate key
boundaries over all partitions; around each wanted quantile the probes are
refined until the nearest row boundary is found or the count is within
tolerance.  Then rows are exchanged once, straight to the partition their
splitters give, and numbered within it.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, map_arrow, parallelism, strings, written

LOWEST, HIGHEST = -(2**63), 2**63 - 1
PROBES = 64
ROW_BYTES = 16
#: About what a row of the key table takes; only this table is exchanged, so parts are counted by it.
KEY_BYTES = 48
#: A boundary may leave its quantile by this part of a shard to keep a group whole.
GROUP_TOLERANCE = 0.02


def key_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, key, tie, size, text_crc32): all that splitting looks at, without texts."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [t.encode() for t in strings(batch, text_col)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([len(t) + ROW_BYTES for t in raw], pa.int64()), pa.array([zlib.crc32(t) for t in raw], pa.int64())],
                [id_col, "key", "size", "text_crc32"],
            )

    hashed = docs.select(id_col, text_col, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"))
    keys = map_arrow(hashed, run, f"`{id_col}` {id_type}, key long, size long, text_crc32 long")
    return keys.withColumn("tie", F.coalesce(F.xxhash64(id_col), F.lit(0)) if id_type not in ("bigint", "int") else F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)))


def _below(keys: DataFrame, probes: list[tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Bytes, rows, largest size, least and greatest key of each interval between sorted probes (key, tie), by exact counting."""
    key = np.array([k for k, _ in probes], np.int64)
    tie = np.array([t for _, t in probes], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(probes) + 1
        size, rows, most = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        least, greatest = np.full(n, HIGHEST), np.full(n, LOWEST)
        for batch in batches:
            k, t, s = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            at = interval(key, tie, k, t)
            np.add.at(size, at, s)
            rows += np.bincount(at, minlength=n)
            np.maximum.at(most, at, s)
            np.minimum.at(least, at, k)
            np.maximum.at(greatest, at, k)
        full = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (full, size[full], rows[full], most[full], least[full], greatest[full])], ["at", "size", "rows", "most", "least", "greatest"])

    counted = map_arrow(keys.select("key", "tie", "size"), run, "at long, size long, rows long, most long, least long, greatest long")
    out = [(0, 0, 0, HIGHEST, LOWEST)] * (len(probes) + 1)
    summed = counted.groupBy("at").agg(F.sum("size"), F.sum("rows"), F.max("most"), F.min("least"), F.max("greatest"))
    for r in summed.collect():  # a row for each probe at most
        out[r[0]] = tuple(r[1:])
    return out


def interval(key: np.ndarray, tie: np.ndarray, k: np.ndarray, t: np.ndarray) -> np.ndarray:
    """How many of the sorted boundaries (key, tie) are at or below each (k, t)."""
    low, high = np.searchsorted(key, k, "left"), np.searchsorted(key, k, "right")
    out = high.copy()
    for j in np.flatnonzero(high > low).tolist():
        a, b = int(low[j]), int(high[j])
        out[j] = a + np.searchsorted(tie[a:b], t[j], "right")
    return out


class _Counts:
    """Cumulative bytes and rows at the boundaries probed so far, and the keys found between them."""

    def __init__(self, keys: DataFrame):
        self.keys = keys
        self.at: list[tuple[int, int]] = []
        self._read([])
        self.bytes, self.most = self.inside[0][0], self.inside[0][2]

    def _read(self, probes: list[tuple[int, int]]) -> None:
        self.inside = _below(self.keys, probes)
        self.at = [(LOWEST, LOWEST), *probes, (HIGHEST + 1, LOWEST)]
        self.cum = [0, *np.cumsum([x[0] for x in self.inside]).tolist()]

    def probe(self, probes: set[tuple[int, int]]) -> None:
        """Counts below new boundaries; of the old ones those stay that still bound something asked for."""
        self._read(sorted(probes | set(self.at[1:-1])))

    def around(self, wanted: float) -> int:
        """Number of the interval that holds the byte ``wanted``."""
        return min(max(0, bisect_right(self.cum, wanted) - 1), len(self.inside) - 1)


def splitters(keys: DataFrame, parts: int, tolerance: float, fine: float = 0.001, probes: int = PROBES) -> list[tuple[int, int]]:
    """parts - 1 boundaries (key, tie) that deal the bytes of ``keys`` evenly.

    Boundaries between keys (groups of equal texts) are refined until one lies
    within ``fine`` of a part or a single group is left around the quantile.  A
    quantile that lies inside a group, both of whose edges are further than
    ``tolerance`` of a part and half of the largest document, is then refined
    over the ids of that group.
    """
    c = _Counts(keys)
    near = fine * c.bytes / max(parts, 1)
    allowed = max(tolerance * c.bytes / max(parts, 1), c.most / 2)
    wanted = [c.bytes * k / parts for k in range(1, parts)]
    per = max(4, probes * 8 // max(8, parts))
    while True:
        ask: set[tuple[int, int]] = set()
        for w in wanted:
            j = c.around(w)
            off = min(abs(c.cum[j] - w), abs(c.cum[j + 1] - w))
            _, rows, _, least, greatest = c.inside[j]
            if off <= near or rows <= 1:
                continue
            (k0, t0), (k1, t1) = c.at[j], c.at[j + 1]
            if least < greatest:
                step = max(1, (greatest - least) // per)
                ask |= {(k, LOWEST) for k in range(least + step, greatest, step)} | {(least, LOWEST), (greatest, LOWEST), (min(least + 1, HIGHEST), LOWEST)}
            elif off > allowed:
                low, high = (t0 if k0 == least else LOWEST), (t1 if k1 == least else HIGHEST)
                step = max(1, (high - low) // per)
                ask |= {(least, t) for t in range(low + step, high, step)} | ({(least, high)} if high < HIGHEST else set())
            else:
                ask |= {(least, LOWEST), (min(least + 1, HIGHEST), LOWEST)}
        if ask <= set(c.at):
            break
        c.probe(ask)
    out = []
    for w in wanted:
        j = c.around(w)
        out.append(c.at[j] if w - c.cum[j] <= c.cum[j + 1] - w else c.at[j + 1])
    return sorted(out)


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", tolerance: float = GROUP_TOLERANCE, bytes_per_part: int = 64 << 20) -> DataFrame:
    """Deals all documents to shards of nearly equal bytes (law ``bytes``).

    The size of a document is the UTF-8 bytes of its text (null: none) plus
    16.  Shards are consecutive stretches of the order (hash of the text, id):
    equal texts share a shard unless a boundary has to cut their group, which
    it does only where no edge of the group lies within ``tolerance`` of a
    shard (or half of the largest document) of the quantile.  Returns
    (id_col, size, text_crc32, law, shard, slot, grown_shard): slots are
    gapless from 0 in each shard; ``grown_shard`` is null, as it belongs to
    another law.  Repeated rows get slots of their own; null ids come first in
    their group.  An empty table gives no rows; other columns are not read.
    """
    keys = written(key_table(docs, id_col, text_col), "shard-keys")
    spark = docs.sparkSession
    cut = splitters(keys, shards, tolerance)
    fine = shards * max(1, -(-max(parallelism(spark), keys.count() * KEY_BYTES // bytes_per_part) // shards))
    edge = _fine_edges(keys, cut, fine // shards, shards)
    key = np.array([k for k, _, _ in edge], np.int64)
    tie = np.array([t for _, t, _ in edge], np.int64)
    shard_of = np.array([0, *(s for _, _, s in edge)], np.int64)
    rows = np.array([found[1] for found in _below(keys, [(k, t) for k, t, _ in edge])], np.int64)
    before = np.cumsum(rows) - rows
    first = before - before[np.searchsorted(shard_of, shard_of)]  # less what precedes the shard's first part

    part, offset, id_type = free_name(docs, "part"), free_name(docs, "offset"), docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = interval(key, tie, batch.column(1).to_numpy(), batch.column(4).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at), pa.array(shard_of[at]), pa.array(first[at])], [*batch.schema.names, part, "shard", offset])

    dealt = map_arrow(keys, run, f"`{id_col}` {id_type}, key long, size long, text_crc32 long, tie long, `{part}` long, shard long, `{offset}` long")
    within = Window.partitionBy(part).orderBy("key", "tie", "text_crc32", "size")
    return (
        dealt.repartitionById(len(edge) + 1, F.col(part).cast("int"))
        .withColumn("slot", (F.row_number().over(within) - 1).cast("long") + F.col(offset))
        .select(id_col, "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
    )


def _fine_edges(keys: DataFrame, cut: list[tuple[int, int]], per: int, shards: int) -> list[tuple[int, int, int]]:
    """Edges (key, tie, shard that begins or goes on there): those of shards, and ``per`` parts inside each."""
    out = {(k, t): bisect_right(cut, (k, t)) for k, t in cut}
    if per > 1:
        for k, t in splitters(keys, per * shards, 0.5, 0.25):
            out.setdefault((k, t), bisect_right(cut, (k, t)))
    return [(k, t, s) for (k, t), s in sorted(out.items()) if k <= HIGHEST]
