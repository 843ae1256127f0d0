"""URL rules by a Bloom filter cascade, exact over the keys of the corpus.

A rule is a key, host and path in one string.  The keys of a URL are all rules
that would fit it: the suffixes of its host at dots, each with the beginnings
of its path of the lengths that rules have.  The first level of the cascade
holds the listed keys, the second the corpus keys that pass the first by
mistake, the third the listed keys that pass the second by mistake, and so on
until none is left; so membership is exact for every key of the corpus, and a
lookup reads bits only, without a join.  A second, small cascade over the
rules themselves tells blocked from allowed ones.

A list is dealt to slices by a hash of the key, each with a cascade of at most
SLICE_KEYS keys on average; URLs go through the slices one after the other and
keep the longest rule found so far.  So what goes out with tasks has a bound
that does not grow with the list.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, release, strings, tune, written
from .textnum import U64, splitmix

#: Listed keys of a slice, on average: 2^20 keys have a cascade of about 5 MB.
SLICE_KEYS = 1 << 20
#: Odds of a mistake at all levels but the first, and bits of the least level.
LATER, LEAST_BITS = 0.5, 64
#: A cascade of distinct keys ends long before so many levels.
LEVELS = 200
#: The letters of hosts that are lower-cased.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


class Level:
    """A Bloom filter; ``seed`` is the number of the level."""

    def __init__(self, seed: int, bits: int, hashes: int, words: np.ndarray | None = None):
        self.seed, self.bits, self.hashes = seed, bits, hashes
        self.words = np.zeros(-(-bits // 64), U64) if words is None else words

    @staticmethod
    def sized(seed: int, keys: int, odds: float) -> Level:
        bits = max(LEAST_BITS, ceil(keys * -log(odds) / log(2) ** 2))
        return Level(seed, bits, max(1, round(-log2(odds))))

    def places(self, h: np.ndarray) -> np.ndarray:
        """Bit numbers, keys by hashes."""
        a, b = splitmix(h), splitmix(h ^ U64(0x5851F42D4C957F2D)) | U64(1)
        return (a[:, None] + np.arange(self.hashes, dtype=U64) * b[:, None]) % U64(self.bits)

    def holds(self, h: np.ndarray) -> np.ndarray:
        at = self.places(h)
        return (self.words[at >> U64(6)] >> (at & U64(63)) & U64(1)).all(axis=1)


def _hashes(keys: list[str], seed: int) -> np.ndarray:
    """Hashes of a level's own seed: keys that clash at one level part at the next."""
    return np.fromiter((xxhash.xxh3_64_intdigest(k, seed) for k in keys), U64, len(keys))


class Cascade:
    """Levels, the first of listed keys.  A key passes if the first level without it has an even number, from 1."""

    def __init__(self, levels: list[Level]):
        self.levels, self.known = levels, {}

    def listed(self, keys: list[str]) -> np.ndarray:
        """Whether each key is listed; keys that pass the first level are few and remembered."""
        out = np.zeros(len(keys), bool)
        passed = np.flatnonzero(self.levels[0].holds(_hashes(keys, self.levels[0].seed))).tolist() if keys else []
        for k in passed:
            key = keys[k]
            if key not in self.known:
                depth = 1
                while depth < len(self.levels) and self.levels[depth].holds(_hashes([key], self.levels[depth].seed))[0]:
                    depth += 1
                if len(self.known) >= SLICE_KEYS:
                    self.known.clear()
                self.known[key] = depth % 2 == 1
            out[k] = self.known[key]
        return out


def _filled(keys: DataFrame, seed: int, n: int, odds: float) -> Level:
    """The level of the ``n`` keys; its words are put together by a grouped OR, so the driver sees words only."""
    level = Level.sized(seed, n, odds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = level.places(_hashes(strings(batch, "key"), seed)).reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array((at >> U64(6)).astype(np.int64)), pa.array((U64(1) << (at & U64(63))).view(np.int64))], ["word", "bits"])

    got = map_arrow(keys.select("key"), run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    level.words[got["word"].to_numpy()] = got["bits"].to_numpy().view(U64)
    return level


def _passing(keys: DataFrame, level: Level) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(level.holds(_hashes(strings(batch, "key"), level.seed)) if batch.num_rows else [], pa.bool_()))

    return map_arrow(keys.select("key"), run, "key string")


def build_cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """The cascade that holds the keys of ``listed`` and no other key of ``universe`` (both: key string).

    The keys that pass the first level by mistake are told from listed ones by
    grouping; all levels above are of the size of the list, whatever the
    universe.
    """
    ours = written(listed.select("key").distinct(), "cascade-listed")
    n = ours.count()
    total = universe.agg(F.approx_count_distinct("key", 0.05)).first()[0]
    odds = min(LATER, LATER**0.5 * max(n, 1) / max(total, 1))
    levels = [_filled(ours, 1, n, odds)]
    told = ours.withColumn("ours", F.lit(1)).unionByName(_passing(universe, levels[0]).withColumn("ours", F.lit(0)))
    wrong = written(told.groupBy("key").agg(F.max("ours").alias("ours")).where("ours = 0").select("key"), "cascade-wrong")
    inside, outside = ours, wrong  # what the last level is of, and what it must not hold
    tables = [ours, wrong]
    while (m := outside.count()) > 0:
        if len(levels) >= LEVELS:
            raise RuntimeError("the cascade does not end")
        levels.append(_filled(outside, len(levels) + 1, m, LATER))
        inside, outside = outside, written(_passing(inside, levels[-1]), "cascade-wrong")
        tables.append(outside)
    release(*tables)
    return Cascade(levels)


def rule_keys(host: Column, path: Column, lengths: list[int], labels: int, longest: int) -> Column:
    """The keys of a URL, the longest first, then those of the longest host.

    Only hosts of at most ``labels`` labels and ``longest`` characters are
    looked at, as no rule has a longer one, and path beginnings of the lengths
    that rules have.
    """
    parts = F.split(host, r"\.", -1)
    count = F.size(parts)
    hosts = F.transform(F.sequence(F.lit(1), F.least(count, F.lit(labels))), lambda k: F.array_join(F.slice(parts, count - k + 1, k), "."))
    hosts = F.filter(hosts, lambda h: (h != "") & (F.length(h) <= longest))
    begins = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length(path))
    pairs = F.flatten(F.transform(hosts, lambda h: F.transform(begins, lambda n: F.struct((-F.length(h) - n).alias("total"), (-F.length(h)).alias("host"), F.concat(h, F.substring(path, F.lit(1), n)).alias("key")))))
    return F.transform(F.array_sort(pairs), lambda p: p["key"])


def judge_urls(df: DataFrame, rules: DataFrame, otherwise: str = "allow", url_col: str = "url") -> DataFrame:
    """Rows of ``df`` with (host, path, rule, verdict) added: those of the longest rule that fits.

    ``rules`` has (host, path, verdict: allow or block).  A rule fits its host
    and all subdomains, if the path starts with the rule's; of rules of one
    length the one with the longer host wins, of equal rules one that blocks.
    Where no rule fits, the rule is null and the verdict ``otherwise``: the
    cascade finds no listed key.

    A null URL, or one without ``://``, has an empty host and path, which no
    rule fits.  Rules with a null or empty host are left out; a null path is
    empty.  Long URLs are read whole.  Repeated rows are judged alike; an
    empty table stays empty, and without rules all is ``otherwise``.  Columns
    of ``df`` named like those added are replaced, the others go through.
    """
    tune(df.sparkSession)
    host, path = F.col("host"), F.coalesce("path", F.lit(""))
    rules = rules.where(host.isNotNull() & (host != "")).select(host.alias("host"), path.alias("path"), (F.col("verdict") == "block").cast("int").alias("block"))
    rules = rules.groupBy("host", "path").agg(F.max("block").alias("block"))
    rules = written(rules.select(F.concat("host", "path").alias("key"), "block", F.size(F.split("host", r"\.", -1)).alias("labels"), F.length("host").alias("host_length"), F.length("path").alias("path_length")), "url-rules")
    n, labels, longest = rules.agg(F.count("*"), F.max("labels"), F.max("host_length")).first()
    out = df.drop("host", "path", "rule", "verdict").withColumns({"host": url_host(F.col(url_col)), "path": url_path(F.col(url_col))})
    none = {"rule": F.lit(None).cast("string"), "verdict": F.lit(otherwise)}
    if not n:
        return out.withColumns(none)
    lengths = [r[0] for r in rules.select("path_length").distinct().orderBy("path_length").toLocalIterator()]  # at most the longest path of a rule
    keys = rule_keys(F.col("host"), F.col("path"), lengths, labels, longest)
    slices = ceil(n / SLICE_KEYS)
    own = lambda s, key="key": F.pmod(F.xxhash64(key), F.lit(slices)) == s
    universe = df.select(url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path")).select(F.explode(keys).alias("key"))
    out = out.withColumns(none | {"_keys": keys})
    before = []
    for s in range(slices):
        listed = rules.where(own(s))
        fits = build_cascade(listed, universe.where(own(s)))
        blocks = build_cascade(listed.where("block = 1"), listed)
        out = _looked_up(out.withColumn("_mine", F.filter("_keys", lambda k: own(s, k))), fits, blocks).drop("_mine")  # noqa: B023
        if s + 1 < slices:
            out = written(out, "url-verdicts")
            release(*before)
            before = [out]
    return out.drop("_keys")


def _looked_up(df: DataFrame, fits: Cascade, blocks: Cascade) -> DataFrame:
    """``df`` with rule and verdict of its best listed key of ``_mine``, where that stands before the rule so far in ``_keys``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = {c: k for k, c in enumerate(batch.schema.names)}
            columns = list(batch.columns)
            mine, keys = columns[place["_mine"]], columns[place["_keys"]]
            flat, offsets = mine.flatten().to_pylist(), mine.offsets.to_numpy() - mine.offsets[0].as_py()
            distinct = {key: k for k, key in enumerate(dict.fromkeys(flat))}
            ours = fits.listed(list(distinct))
            hit = np.flatnonzero(ours[[distinct[k] for k in flat]]) if flat else np.zeros(0, np.int64)
            row, first = np.unique(np.searchsorted(offsets, hit, side="right") - 1, return_index=True)
            rule, verdict = columns[place["rule"]].to_pylist(), columns[place["verdict"]].to_pylist()
            for r, k in zip(row.tolist(), hit[first].tolist()):
                if rule[r] is not None:
                    order = keys[r].as_py()
                    if order.index(rule[r]) < order.index(flat[k]):
                        continue
                rule[r] = flat[k]
                verdict[r] = "block" if blocks.listed([flat[k]])[0] else "allow"
            columns[place["rule"]], columns[place["verdict"]] = pa.array(rule, pa.string()), pa.array(verdict, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return df.mapInArrow(run, df.schema)
