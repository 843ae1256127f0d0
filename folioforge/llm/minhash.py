"""Near-duplicate documents by improved consistent weighted sampling (ICWS).

A document is its multiset of five-word shingles, each weighted by its
frequency in the document times a smoothed inverse document frequency.  ICWS
draws SAMPLES elements such that two documents agree on a draw with the
probability of their weighted Jaccard similarity; ROWS draws form a band.
Documents that share a band are candidates and are verified by their exact
weighted Jaccard similarity.  At similarity 0.8 a pair shares one of the 10
bands with probability 0.999.

Document frequencies are counted over all documents in a table of fixed size
(2**20 counters, shared by the shingles that hash to them).  A counter holds
about (distinct shingles of a mean document) / 2**20 of all documents on top
of the frequency of its most frequent shingle, whatever the corpus, so a
shingle more frequent than that has its own weight, and the weights of rarer
ones are alike.  Texts are shingled once; frequencies, signatures and
verification read that table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, map_arrow, parallelism, release, strings, written
from .components import connected_components
from .textnum import U64, chunks, splitmix, word_hashes

WORDS, BANDS, ROWS = 5, 10, 3
SAMPLES = BANDS * ROWS
DF_BITS, DF_CHUNKS = 20, 64
#: Documents of a bucket that meet in one task when members of several classes are left.
BLOCK = 512

_DRAWS = 1 << 16
_rng = np.random.default_rng(5)
_R = _rng.gamma(2.0, 1.0, _DRAWS).astype(np.float32)
_LOG_C = np.log(_rng.gamma(2.0, 1.0, _DRAWS)).astype(np.float32)
_BETA = _rng.random(_DRAWS).astype(np.float32)
_INVERSE_R = (1 / _R).astype(np.float32)
_PICK = splitmix(np.arange(1, SAMPLES + 1, dtype=U64)) | U64(1)


def shingles(texts: list[str], n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of the n-word shingles of each text in order, and offsets.

    A text of fewer words, but at least one, is one shingle of all its words.
    """
    h, off = word_hashes(texts)
    count = np.diff(off)
    if not len(h):
        return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
    rolled = np.zeros(len(h), U64)
    ends = np.repeat(off[1:], count)
    at = np.arange(len(h))
    for k in range(n):
        part = splitmix(h + U64(k))
        inside = at + k < ends
        rolled[: len(h) - k] += np.where(inside[: len(h) - k], part[k:], U64(0)) * U64(2 * k + 1)
    keep = (at + n <= ends) | ((at == np.repeat(off[:-1], count)) & (np.repeat(count, count) < n))
    out = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.add.reduceat(np.append(keep, False), off[:-1]) * (count > 0), out=out[1:])
    return (splitmix(rolled[keep]) >> U64(32)).astype(np.uint32), out


def profiles(texts: list[str]) -> Iterator[np.ndarray]:
    """The sorted shingle hashes of each text, repeated as often as they occur."""
    for a, b in chunks(texts, 1 << 19):
        u, off = shingles(texts[a:b])
        for s, e in zip(off[:-1].tolist(), off[1:].tolist()):
            yield np.sort(u[s:e])


def _profile(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint32)


def idf(df: np.ndarray, n: int) -> np.ndarray:
    """Smoothed inverse document frequency: 1 for a shingle that every document has."""
    return (1 + np.log((1 + n) / (1 + np.minimum(df, n)))).astype(np.float32)


def weight_table(shingled: DataFrame) -> np.ndarray:
    """The IDF of every counter, from counts over all documents (column ``profile``)."""
    size = 1 << DF_BITS
    step = size // DF_CHUNKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(size, np.int64), 0
        for batch in batches:
            raws = batch.column(0).to_pylist()
            n += len(raws)
            for raw in raws:
                c = _profile(raw) >> np.uint32(32 - DF_BITS)
                total[c[np.append(True, c[1:] != c[:-1])] if len(c) else c] += 1
        if n:
            rows = [total[k : k + step].tobytes() for k in range(0, size, step)]
            yield pa.RecordBatch.from_arrays([pa.array([*range(DF_CHUNKS), -1]), pa.array([*rows, np.array([n]).tobytes()], pa.binary())], ["part", "counts"])

    def add(t: pa.Table) -> pa.Table:
        total = 0
        for raw in t.column("counts").to_pylist():
            total = total + np.frombuffer(raw, np.int64)
        return pa.table({"part": t.column("part")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    counted = map_arrow(shingled.select("profile"), run, "part long, counts binary")
    counted = counted.withColumn("salt", F.spark_partition_id() % 1024)
    part = {}
    first = counted.groupBy("part", "salt").applyInArrow(add, "part long, counts binary")
    for k, raw in first.groupBy("part").applyInArrow(add, "part long, counts binary").collect():  # DF_CHUNKS + 1 rows
        part[k] = np.frombuffer(raw, np.int64)
    n = int(part.pop(-1, np.array([1]))[0])
    return idf(np.concatenate([part.get(k, np.zeros(step, np.int64)) for k in range(DF_CHUNKS)]), n)


def band_keys(profile: list[np.ndarray], log_weight: np.ndarray) -> list[list[int]]:
    """The BANDS keys of each profile; none for an empty one."""
    full = [k for k, p in enumerate(profile) if len(p)]
    out: list[list[int]] = [[] for _ in profile]
    if not full:
        return out
    one, times = zip(*(np.unique(profile[k], return_counts=True) for k in full))
    size = np.array([len(x) for x in one])
    u = np.concatenate(one)
    tf = np.concatenate(times)
    log_s = np.log(tf).astype(np.float32) + log_weight[u >> np.uint32(32 - DF_BITS)]
    begin = np.cumsum(size) - size
    wide = splitmix(u.astype(U64))
    drawn = np.zeros((len(full), SAMPLES), U64)
    for k in range(SAMPLES):
        at = ((wide * _PICK[k]) >> U64(48)).astype(np.int64)
        r, beta = _R[at], _BETA[at]
        t = np.floor(log_s * _INVERSE_R[at] + beta)
        a = _LOG_C[at] - r * (t - beta + np.float32(1))
        least = np.minimum.reduceat(a, begin)
        hit = np.flatnonzero(a == np.repeat(least, size))
        # ties within a document go to its first, that is least, shingle
        chosen = hit[np.searchsorted(hit, begin)]
        drawn[:, k] = splitmix((u[chosen].astype(U64) << U64(32)) ^ (t[chosen].astype(np.int64) & 0xFFFFFFFF).astype(U64))
    band = np.zeros((len(full), BANDS), U64)
    for k in range(ROWS):
        band = splitmix(band ^ drawn[:, k::ROWS])
    band = splitmix(band + np.arange(BANDS, dtype=U64)).view(np.int64)
    for k, row in zip(full, band.tolist()):
        out[k] = row
    return out


def similarity(a: np.ndarray, b: np.ndarray, weight: np.ndarray, at_least: float = 0.0) -> float:
    """Weighted Jaccard similarity of two profiles; 0 at once where their totals exclude ``at_least``."""
    if not len(a) or not len(b):
        return 1.0 if len(a) == len(b) else 0.0
    shift = np.uint32(32 - DF_BITS)
    x, y = float(weight[a >> shift].sum(dtype=np.float64)), float(weight[b >> shift].sum(dtype=np.float64))
    if min(x, y) < at_least * max(x, y):
        return 0.0
    # each occurrence as its own element: (shingle, how many of it came before)
    both = np.intersect1d(_numbered(a), _numbered(b), assume_unique=True)
    common = float(weight[(both >> U64(32)).astype(np.uint32) >> shift].sum(dtype=np.float64))
    return common / (x + y - common)


def _numbered(p: np.ndarray) -> np.ndarray:
    at = np.arange(len(p))
    first = np.append(True, p[1:] != p[:-1])
    return (p.astype(U64) << U64(32)) | (at - np.maximum.accumulate(np.where(first, at, 0))).astype(U64)


def near_duplicates(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of documents linked by a weighted Jaccard similarity of at least ``threshold``.

    Returns one row per input row: (id_col, class_id: the least id of its
    class, null if no row of the class has one; kept).  Equal texts (null as
    empty) are one class; so are, by transitivity, all that links join.  Texts
    without words link only with equal ones.  The row with the least id is
    kept, null ids last and of one id the text of the smaller hash; equal rows
    that both are it are both marked.  An empty table stays empty; other
    columns are not read.

    No pair is made of copies: a node is a distinct text, known by its 64-bit
    hash.  Members of a bucket are first compared with its least member; only
    where that leaves several classes in a bucket are members of different
    classes compared, in blocks, so every candidate pair is either compared or
    already in one class.
    """
    out = _classified(docs, threshold, id_col, text_col)
    return out.select(F.col("id").alias(id_col), F.col("first.id").alias("class_id"), _is_first().alias("kept"))


def _is_first() -> Column:
    return F.col("id").eqNullSafe(F.col("first.id")) & (F.col("node") == F.col("first.node"))


def _classified(docs: DataFrame, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """(id, node: hash of the text, first: (none, id, node) of the row that its class keeps), a row per row of ``docs``."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("node"), text.alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([p.tobytes() for p in profiles(strings(batch, "text"))], pa.binary())], ["id", "node", "profile"])

    shingled = written(map_arrow(rows, shingle, f"id {id_type}, node long, profile binary"), "shingles")
    weight = weight_table(shingled)
    shared = spark.sparkContext.broadcast((weight, np.log(weight)))  # 2**DF_BITS counters

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_weight = shared.value[1]
        for batch in batches:
            profile = [_profile(raw) for raw in batch.column(2).to_pylist()]
            keys: list[list[int]] = []
            for a, b in chunks(profile):
                keys += band_keys(profile[a:b], log_weight)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.list_(pa.int64()))], ["id", "node", "bands"])

    signed = map_arrow(shingled, sign, f"id {id_type}, node long, bands array<long>")
    # min over (is null, id) puts null ids last
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).alias("first")
    classes = written(signed.groupBy("node").agg(first, F.any_value("bands").alias("bands")), "text-classes")
    member = classes.select("node", F.posexplode("bands").alias("band", "key")).select("node", F.xxhash64("band", "key").alias("bucket"))
    bucket = member.groupBy("bucket").agg(F.min("node").alias("pivot"), F.max("node").alias("top")).where("pivot != top").drop("top")
    member = written(member.join(bucket, "bucket"), "bucket-members")

    # one row of each text; a merge join at every size, as candidates are a part of all documents
    wanted = classes.select("node", "first.id").join(member.select("node").distinct(), "node", "left_semi").hint("merge")
    same = (shingled["node"] == wanted["node"]) & shingled["id"].eqNullSafe(wanted["id"])
    profile = written(shingled.join(wanted, same, "left_semi").groupBy("node").agg(F.any_value("profile").alias("profile")), "profiles")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = shared.value[0]
        for batch in batches:
            same = [similarity(_profile(a), _profile(b), weight, threshold) >= threshold for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["u", "v"]).filter(pa.array(same, pa.bool_()))

    pairs = member.select("node", "pivot").where("node != pivot").distinct()
    pairs = pairs.join(profile, "node").join(profile.toDF("pivot", "profile_"), "pivot").select("node", "pivot", "profile", "profile_")
    near = written(map_arrow(pairs, compare, "u long, v long"), "near-pairs")
    part = written(connected_components(near), "near-classes")
    left = _blocks(member, part)
    rest = left.join(profile, "node").repartition(parallelism(spark), "bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
    more = written(map_arrow(rest.select("node", "part", "block", "bucket", "lo", "hi", "profile"), _block_links(shared, threshold), "u long, v long"), "more-pairs")
    final = part if more.isEmpty() else written(connected_components(near.union(more)), "near-classes")
    release(member, profile, near, more)
    joined = classes.select("node", "first").join(final.toDF("node", "component"), "node", "left")
    joined = joined.select("node", "first", F.coalesce("component", "node").alias("component"))
    least = joined.groupBy("component").agg(F.min("first").alias("first"))
    of_class = joined.select("node", "component").join(least, "component").select("node", "first")
    return shingled.select("id", "node").join(of_class, "node")


def _blocks(member: DataFrame, part: DataFrame) -> DataFrame:
    """(node, part, block, bucket, lo, hi): members of buckets with several classes, once for each pair of blocks they meet in.

    A class larger than BLOCK has blocks of its own, which do not meet each other.
    """
    m = member.select("node", "bucket").join(part.toDF("node", "part"), "node", "left").withColumn("part", F.coalesce("part", "node"))
    several = m.groupBy("bucket").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a != b").select("bucket")
    m = m.join(several, "bucket")
    size = m.groupBy("bucket", "part").agg(F.count("*").alias("c"))
    large = size.where(F.col("c") > BLOCK)
    small = size.where(F.col("c") <= BLOCK).groupBy("bucket").agg(F.sum("c").alias("s"))
    m = m.join(large, ["bucket", "part"], "left").join(small, "bucket", "left")
    split = F.pmod(F.xxhash64("node", F.lit(3)), F.ceil(F.col("c") / BLOCK))
    packed = F.pmod(F.xxhash64("part", F.lit(4)), F.ceil(F.col("s") / BLOCK))
    # block: a number; own: the class whose block it is alone
    m = m.withColumn("own", F.when(F.col("c").isNotNull(), F.col("part"))).withColumn("block", F.when(F.col("c").isNotNull(), F.xxhash64("part", split)).otherwise(packed)).drop("c", "s")
    blocks = m.select("bucket", F.col("block").alias("other"), F.col("own").alias("other_own")).distinct()
    met = m.join(blocks, "bucket").where("own is null or other_own is null or own != other_own")
    return met.select("node", "part", "block", "bucket", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))


def common_weights(a: list[np.ndarray], b: list[np.ndarray], weight: np.ndarray, columns: int = 1 << 13) -> np.ndarray:
    """Weight in common of each profile of ``a`` and each of ``b``.

    Profiles become rows of a matrix over the elements (shingle, how many of
    it came before) that occur on both sides; the product of the two matrices
    is taken ``columns`` elements at a time.
    """
    parts = []
    for side in (a, b):
        e = np.concatenate([_numbered(p) for p in side]) if side else np.zeros(0, U64)
        parts.append((e, np.repeat(np.arange(len(side)), [len(p) for p in side])))
    shared = np.intersect1d(parts[0][0], parts[1][0])
    out = np.zeros((len(a), len(b)), np.float32)
    if not len(shared):
        return out
    root = np.sqrt(weight[(shared >> U64(32)).astype(np.uint32) >> np.uint32(32 - DF_BITS)])
    at = []
    for e, row in parts:
        k = np.minimum(np.searchsorted(shared, e), len(shared) - 1)
        hit = shared[k] == e
        order = np.argsort(k[hit], kind="stable")
        at.append((k[hit][order], row[hit][order]))
    for begin in range(0, len(shared), columns):
        end = min(begin + columns, len(shared))
        m = []
        for (k, row), n in zip(at, (len(a), len(b))):
            x, y = np.searchsorted(k, (begin, end))
            dense = np.zeros((n, end - begin), np.float32)
            dense[row[x:y], k[x:y] - begin] = root[k[x:y]]
            m.append(dense)
        out += m[0] @ m[1].T
    return out


def _block_links(shared, threshold: float):
    """Links between members of different classes in each (bucket, lo, hi), which come sorted; one for each pair of classes."""

    def links(key, rows) -> list[tuple]:
        weight = shared.value[0]
        _, lo, hi = key
        a = [r for r in rows if r[2] == lo]
        b = a if lo == hi else [r for r in rows if r[2] == hi]
        if not a or not b:
            return []
        shift = np.uint32(32 - DF_BITS)
        profile = [[np.frombuffer(r[3], np.uint32) for r in side] for side in (a, b)]
        total = [np.array([weight[p >> shift].sum(dtype=np.float64) for p in side]) for side in profile]
        common = common_weights(*profile, weight)
        part = [np.array([r[1] for r in side]) for side in (a, b)]
        near = common >= threshold * (total[0][:, None] + total[1] - common) - 1e-3
        near &= part[0][:, None] != part[1]
        i, j = np.nonzero(near)
        if not len(i):
            return []
        _, one = np.unique(np.stack((np.minimum(part[0][i], part[1][j]), np.maximum(part[0][i], part[1][j]))), axis=1, return_inverse=True)
        done, out = set(), []
        for x, y, pair in zip(i.tolist(), j.tolist(), one.tolist()):
            # single precision proposes, the exact similarity decides
            if pair not in done and similarity(profile[0][x], profile[1][y], weight, threshold) >= threshold:
                done.add(pair)
                out.append((a[x][0], b[y][0]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, kind = None, [], None
        for batch in batches:
            kind = batch.schema.types[0]
            out = []
            columns = [batch.column(c).to_pylist() for c in range(7)]
            for n, p, b, *k, raw in zip(*columns):
                if k != key:
                    out += links(key, held) if key else []
                    key, held = k, []
                held.append((n, p, b, raw))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c in zip(*out)], ["u", "v"])
        if key and (out := links(key, held)):
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c in zip(*out)], ["u", "v"])

    return run


def drop_near_duplicates(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class of :func:`near_duplicates`, with all its columns; of equal rows one stays."""
    first = _classified(docs, threshold, id_col, text_col).where(_is_first()).select("id", "node").distinct()
    number, key, node = (free_name(docs, x) for x in ("number", "key", "node"))
    rows = docs.withColumn(node, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    kept = first.toDF(key, node).hint("merge")
    whole = rows.join(kept, (rows[node] == kept[node]) & rows[id_col].eqNullSafe(kept[key]), "left_semi")
    one = Window.partitionBy(node, id_col).orderBy(node)
    whole = whole.withColumn(number, F.row_number().over(one)).where(F.col(number) == 1)
    return whole.select(*[f"`{c}`" for c in docs.columns])
