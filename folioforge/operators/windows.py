"""Ordered-sequence operators: rolling windows, islands, budgets, state machines."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Part of a context limit at which a level begins.
LEVELS = (("emergency", 0.95), ("critical", 0.90), ("warning", 0.80), ("info", 0.60))


def rolling_requests(df: DataFrame, key: str, time: str, seconds: int = 60) -> DataFrame:
    """Adds ``in_window``: rows of the key less than ``seconds`` old, and ``oldest`` among them.

    A row exactly ``seconds`` old is out.  Times are compared in microseconds.
    """
    us = F.unix_micros(F.col(time).cast("timestamp"))
    w = Window.partitionBy(key).orderBy(us).rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return df.withColumns({"in_window": F.count("*").over(w), "oldest": F.min(time).over(w)})


def last_rows_sum(df: DataFrame, key: str, value: str, *order: str, rows: int = 100) -> DataFrame:
    """Adds ``window_sum``: the sum over the last ``rows`` rows of the key."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-(rows - 1), 0)
    return df.withColumn("window_sum", F.sum(value).over(w))


def near_limit(used: Column, limit: int = 300, part: float = 0.8) -> Column:
    return used >= limit * part


def budget_level(usage: Column) -> Column:
    out = F.lit("ok")
    for name, least in reversed(LEVELS):
        out = F.when(usage >= least, name).otherwise(out)
    return out


def running_budget(df: DataFrame, session: str, tokens: str, *order: str, limit: float = 200_000) -> DataFrame:
    """Adds used, remaining, usage and level after each operation of a session."""
    w = Window.partitionBy(session).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("used", F.sum(tokens).over(w))
    return out.withColumns({"remaining": F.lit(limit) - F.col("used"), "usage": F.col("used") / limit}).withColumn("level", budget_level(F.col("usage")))


def consecutive_failures(df: DataFrame, key: str, failed: Column, *order: str) -> DataFrame:
    """Adds run_count, and failures in a row up to and with each row."""
    w = Window.partitionBy(key).orderBy(*order)
    up_to = w.rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumns({"run_count": F.row_number().over(w), "_ok": F.sum(F.when(failed, 0).otherwise(1)).over(up_to)})
    island = Window.partitionBy(key, "_ok").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("consecutive_failures", F.sum(F.when(failed, 1).otherwise(0)).over(island)).drop("_ok")


def same_period(last: Column, now: Column, period: str) -> Column:
    """True if both times lie in one day, or one ISO week."""
    return F.coalesce(F.date_trunc(period, last) == F.date_trunc(period, now), F.lit(False))


def phases_complete(df: DataFrame, key: str, done: Column, mode: str) -> DataFrame:
    """Whether all, or any, parallel phases of each key are done."""
    return df.groupBy(key).agg((F.bool_and(done) if mode == "all" else F.bool_or(done)).alias("complete"))


def overlaps(df: DataFrame, key: str, start: str, end: str, order: str, width: int = 86_400_000_000) -> DataFrame:
    """Pairs of intervals of one key that overlap, each pair once.

    Time is cut into stretches of ``width``; intervals meet in the stretches
    they touch, and a pair is taken in the stretch where the later one begins.
    """
    slot = F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.greatest(F.col(start), F.col(end)) / width))).alias("_slot")
    rows = df.select(key, start, end, order, slot)
    a, b = rows.alias("a"), rows.alias("b")
    c = lambda side, name: F.col(f"{side}.{name}")
    meet = (c("a", key) == c("b", key)) & (c("a", "_slot") == c("b", "_slot")) & (c("a", start) < c("b", end)) & (c("b", start) < c("a", end)) & (c("a", order) < c("b", order))
    own = c("a", "_slot") == F.floor(F.greatest(c("a", start), c("b", start)) / width)
    return a.join(b, meet & own).select(c("a", key).alias(key), c("a", order).alias("first"), c("b", order).alias("second"))


class _Breaker:
    """The state of one key's circuit breaker."""

    def __init__(self, failures: int, cooldown_s: float, probes: int):
        self.failures, self.cooldown_s, self.probes = failures, cooldown_s, probes
        self.state, self.bad, self.good, self.since = "closed", 0, 0, None
        self.calls = self.rejected = self.opened = 0

    def call(self, t, fine: bool) -> None:
        self.calls += 1
        if self.state == "open":
            if (t - self.since).total_seconds() < self.cooldown_s:
                self.rejected += 1
                return
            self.state, self.good = "half_open", 0
        if not fine:
            self.bad += 1
            if self.state == "half_open" or self.bad >= self.failures:
                self.state, self.since, self.bad, self.opened = "open", t, 0, self.opened + 1
            return
        self.bad = 0
        if self.state == "half_open":
            self.good += 1
            if self.good >= self.probes:
                self.state = "closed"


def circuit_states(df: DataFrame, key: str, time: str, ok: str, failures: int = 5, cooldown_s: float = 60.0, probes: int = 2, order: tuple[str, ...] = ()) -> DataFrame:
    """Replays a circuit breaker per key: (key, calls, rejected, opened, state).

    Closed opens after ``failures`` failures in a row; after the cooldown a
    call half-opens it; ``probes`` successes close it, a failure opens it
    again.  Calls while it is open are rejected.  Calls come by time and then
    by ``order``.  State moves call by call, so this is a fold over sorted
    Arrow batches; only the state of the key at hand is kept between them.
    """
    schema = f"{key} {df.schema[key].dataType.simpleString()}, calls long, rejected long, opened long, state string"
    names = [key, "calls", "rejected", "opened", "state"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, breaker = None, None
        for frame in batches:
            out = []
            for k, t, fine in zip(frame[key], frame[time], frame[ok]):
                if breaker is None or k != last:
                    if breaker is not None:
                        out.append((last, breaker.calls, breaker.rejected, breaker.opened, breaker.state))
                    last, breaker = k, _Breaker(failures, cooldown_s, probes)
                breaker.call(t, fine)
            if out:
                yield pd.DataFrame(out, columns=names)
        if breaker is not None:
            yield pd.DataFrame([(last, breaker.calls, breaker.rejected, breaker.opened, breaker.state)], columns=names)

    return df.select(key, time, ok, *order).repartition(key).sortWithinPartitions(key, time, *order).mapInPandas(run, schema)


def greedy_segments(df: DataFrame, key: str, order: str, size: str, budget: float) -> DataFrame:
    """(key, order, size, segment): consecutive rows filled up to ``budget``; a larger row stands alone.

    The fill starts anew at each segment, so it is a fold: rows sorted by key
    and order stream through a task that keeps one number.
    """
    rows = df.select(key, order, size, F.col(size).cast("double").alias("_size"))
    rows = rows.repartition(key).sortWithinPartitions(key, order, size)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, segment, fill = object(), 0, 0.0
        for batch in batches:
            out = []
            for k, s in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                s = s or 0.0
                if k != now:
                    now, segment, fill = k, 0, s
                elif fill + s > budget:
                    segment, fill = segment + 1, s
                else:
                    fill += s
                out.append(segment)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.int32())], [key, order, size, "segment"])

    return rows.mapInArrow(run, f"{key} {kinds[key]}, {order} {kinds[order]}, {size} {kinds[size]}, segment int")


def reading_lines(words: DataFrame, tolerance: float = 0.6, least: float = 4.0) -> DataFrame:
    """Word boxes (doc_id, page, text, x0, top, bottom) as lines of text.

    The tolerance is ``tolerance`` of the page's median word height, at least
    ``least``.  A word joins the line whose first word is within the tolerance
    of its top; that anchor moves from line to line, so sorted words are folded
    in Python, many pages to a batch.
    """
    page = Window.partitionBy("doc_id", "page")
    tol = F.greatest(F.median(F.col("bottom") - F.col("top")).over(page) * tolerance, F.lit(least))
    boxes = words.select("doc_id", "page", "text", "x0", "top", "bottom", tol.alias("tol")).withColumn("row", F.bround(F.col("top") / F.col("tol")))
    boxes = boxes.sortWithinPartitions("doc_id", "page", "row", "x0")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["doc_id", "page", "line", "text", "top", "bottom"]
        now, line, anchor, parts = None, 0, 0.0, []
        for frame in batches:
            out = []

            def close() -> None:
                if parts:
                    out.append((*now, line, "".join(t for t, _, _ in parts), min(a for _, a, _ in parts), max(b for _, _, b in parts)))

            for doc, pg, text, top, bottom, tol in zip(*(frame[c] for c in ("doc_id", "page", "text", "top", "bottom", "tol"))):
                if (doc, pg) != now:
                    close()
                    now, line, anchor, parts = (doc, pg), 0, top, []
                elif abs(top - anchor) > tol:
                    close()
                    line, anchor, parts = line + 1, top, []
                parts.append((text, top, bottom))
            yield pd.DataFrame(out, columns=names)
        if parts:
            yield pd.DataFrame([(*now, line, "".join(t for t, _, _ in parts), min(a for _, a, _ in parts), max(b for _, _, b in parts))], columns=names)

    return boxes.mapInPandas(fold, "doc_id long, page int, line int, text string, top double, bottom double")


def columns_by_gap(words: DataFrame, part: float = 0.1) -> DataFrame:
    """Adds ``column``: words right of a gap between neighbouring x positions wider than ``part`` of the page."""
    w = Window.partitionBy("doc_id", "page").orderBy("_x")
    rows = words.withColumn("_x", F.round("x0"))
    rows = rows.withColumn("_cut", F.coalesce((F.col("_x") - F.lag("_x").over(w) > F.col("page_w") * part).cast("int"), F.lit(0)))
    return rows.withColumn("column", F.sum("_cut").over(w.rangeBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_x", "_cut")


def body_band(words: DataFrame, top: float = 0.07, bottom: float = 0.93) -> DataFrame:
    """Without running heads and feet."""
    return words.where((F.col("top") > F.col("page_h") * top) & (F.col("top") < F.col("page_h") * bottom))
