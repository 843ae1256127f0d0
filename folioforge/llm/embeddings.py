"""Near-duplicate embeddings by Euclidean p-stable hashing and exact cosine checks.

Vectors are normalised, projected on Gaussian directions and quantised in
steps of WIDTH; PROJECTIONS quantised values are one bucket of a table.  At
cosine 0.98 (distance 0.2) a projection agrees with probability 0.84, so a
pair meets in at least one of TABLES tables with probability 0.99, and closer
pairs almost surely; unrelated vectors agree with probability 2e-6 a table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import integer_id, map_arrow, parallelism, release, written
from .components import connected_components
from .textnum import U64, splitmix

TABLES, PROJECTIONS, WIDTH, SEED = 24, 10, 1.0, 11
#: Vectors of a bucket that meet in one task: larger buckets are cut into blocks, and pairs of blocks are tasks.
BLOCK = 512


def bucket_codes(x: np.ndarray) -> np.ndarray:
    """One 64-bit code per row and table of normalised vectors."""
    rng = np.random.default_rng(SEED)
    directions = rng.standard_normal((x.shape[1], TABLES * PROJECTIONS))
    shift = rng.uniform(0, WIDTH, TABLES * PROJECTIONS)
    q = np.floor((x @ directions + shift) / WIDTH).astype(np.int64).view(U64).reshape(len(x), TABLES, PROJECTIONS)
    code = np.zeros((len(x), TABLES), U64)
    for k in range(PROJECTIONS):
        code = splitmix(code ^ q[:, :, k])
    return code


def _classes(vectors: DataFrame) -> DataFrame:
    """(node, m, space, unit, codes): one row for each distinct (label, vector)."""
    grouped = vectors.groupBy("h1", "h2").agg(F.min("id").alias("node"), F.count("*").alias("m"), F.any_value("vector").alias("vector"), F.any_value("space").alias("space"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            size = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            begin = np.cumsum(size) - size
            unit, codes = [b""] * len(size), [b""] * len(size)
            for d in np.unique(size).tolist():
                rows = np.flatnonzero(size == d)
                x = flat[begin[rows][:, None] + np.arange(d)]
                x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
                x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
                for r, a, b in zip(rows.tolist(), x, bucket_codes(x)):
                    unit[r], codes[r] = a.tobytes(), b.view(np.int64).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(unit, pa.binary()), pa.array(codes, pa.list_(pa.int64()))], ["node", "m", "space", "unit", "codes"])

    return map_arrow(grouped.select("node", "m", "space", "vector"), run, "node long, m long, space long, unit binary, codes array<long>")


def _link_group(node, m, unit, codes, t: int, block, cross: bool, threshold: float):
    """(nodes with links, links of each, least node of its part) of one bucket or pair of blocks."""
    if cross:
        a, b = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
    else:
        a = b = np.arange(len(node))
    near = unit[a] @ unit[b].T >= threshold
    if not cross:
        np.fill_diagonal(near, False)
    for s in range(t):  # a pair belongs to the first table in which it meets
        if not near.any():
            break
        near &= codes[a, s][:, None] != codes[b, s]
    i, j = np.nonzero(near)
    if not len(i):
        return None
    i, j = a[i], b[j]
    links = np.bincount(i, m[j], len(node)) + (np.bincount(j, m[i], len(node)) if cross else 0)
    root = node.copy()
    while True:  # least node along links
        before = root.copy()
        np.minimum.at(root, i, before[j])
        np.minimum.at(root, j, before[i])
        if (before == root).all():
            break
    has = links > 0
    return node[has], links[has].astype(np.int64), root[has]


def link_embeddings(df: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Links rows of equal label whose vectors have a cosine of at least ``threshold``.

    Returns one row per input row: (id_col, n_links: other rows linked
    directly, component_id: least id reachable, kept: id = component_id).
    Rows whose id, label or vector is null, or whose vector is empty, zero or
    holds a null or non-finite number, link with nothing (a null id is its
    own, null component and not kept).  Vectors of different length never
    link.  Equal vectors are one class with a count, so copies are linked
    without a pair being made; repeated rows are copies of each other.  An
    empty table stays empty; ids that are no integers are refused; other
    columns are not read.
    """
    id_type = integer_id(df, id_col)
    v = F.col(vector_col)
    usable = (
        F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull() & (F.size(v) > 0)
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    )
    rows = df.select(
        F.col(id_col).cast("long").alias("id"), v.alias("vector"), F.coalesce(usable, F.lit(False)).alias("usable"),
        F.xxhash64(label_col, F.size(v)).alias("space"), F.xxhash64(label_col, v).alias("h1"), F.xxhash64(v, F.lit(1), label_col).alias("h2"),
    )
    classes = written(_classes(rows.where("usable")), "vector-classes")
    member = classes.select("node", F.posexplode("codes").alias("t", "code"), "space").select("node", "t", F.xxhash64("space", "t", "code").alias("bucket"))
    size = member.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    member = written(member.join(size, "bucket"), "vector-buckets")
    blocks = member.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    blocks = blocks.withColumn("block", F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")).cast("int"))
    blocks = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    blocks = blocks.select("node", "t", "bucket", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    full = blocks.join(classes.select("node", "m", "unit", "codes"), "node")
    full = full.repartition(parallelism(df.sparkSession), "bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def groups(t: pa.Table) -> Iterator[pa.RecordBatch]:
            node, m, table, block, lo, hi = (t.column(c).to_numpy() for c in ("node", "m", "t", "block", "lo", "hi"))
            key = np.stack([t.column("bucket").to_numpy(), lo, hi])
            edge = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0)))
            codes = t.column("codes").combine_chunks().flatten().to_numpy().reshape(len(node), TABLES)
            raw = t.column("unit").to_pylist()
            out = []
            for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(node)]):
                unit = np.frombuffer(b"".join(raw[a:b])).reshape(b - a, -1)
                if got := _link_group(node[a:b], m[a:b], unit, codes[a:b], int(table[a]), block[a:b], lo[a] != hi[a], threshold):
                    out.append(got)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["node", "links", "root"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            last = [t.column(c)[-1].as_py() for c in ("bucket", "lo", "hi")]
            same = np.logical_and.reduce([t.column(c).to_numpy() == x for c, x in zip(("bucket", "lo", "hi"), last)])
            k = int(np.argmax(same))
            if k:
                yield from groups(t.slice(0, k))
            rest = t.slice(k)
        if rest is not None:
            yield from groups(rest)

    found = written(map_arrow(full, run, "node long, links long, root long"), "vector-links")
    release(member)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    part = connected_components(found.select("node", "root"), "node", "root").withColumnRenamed("id", "node")
    of_class = classes.select("node", "m").join(links, "node", "left").join(part, "node", "left")
    keyed = rows.where("usable").groupBy("h1", "h2").agg(F.min("id").alias("node")).join(of_class, "node")
    joined = rows.select("id", F.when(F.col("usable"), F.col("h1")).alias("h1"), "h2").join(keyed, ["h1", "h2"], "left")
    component = F.coalesce("component", "node", "id")
    return joined.select(
        F.col("id").cast(id_type).alias(id_col), (F.coalesce(F.col("m") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))).alias("n_links"),
        component.cast(id_type).alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"),
    )
