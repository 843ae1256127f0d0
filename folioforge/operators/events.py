"""Operations reports over an event log (type, source, status, duration, error, tool, time).

Expected columns: timestamp, type, run_id, status ('ok' or 'fail'),
duration_ms, skill_name, mcp_name, tool_name, error_type, metadata (JSON).
All time limits are parameters; nothing reads the clock.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def failed() -> Column:
    return F.col("status") == "fail"


def in_range(df: DataFrame, start, end, time: str = "timestamp") -> DataFrame:
    """Rows with start <= time <= end."""
    return df.where(F.col(time).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def last_n(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The last ``n`` rows by ``order``; a bounded top-n, not a sort of all rows."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def filter_events(df: DataFrame, type: str | None = None, run_id: str | None = None, status: str | None = None, since: str | None = None, limit: int | None = None, order: tuple[str, ...] = ("timestamp",)) -> DataFrame:
    """AND of the given predicates; ``since`` is inclusive; ``limit`` keeps the last rows (0 counts as none)."""
    for column, value in (("type", type), ("run_id", run_id), ("status", status)):
        if value:
            df = df.where(F.col(column) == value)
    if since:
        df = df.where(F.col("timestamp") >= F.lit(since).cast("timestamp"))
    return last_n(df, limit, *order) if limit else df


def rate(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def p95(values: str) -> Column:
    """Nearest-rank 95th percentile; 0 where there are no values."""
    return F.coalesce(F.expr(f"percentile_disc(0.95) within group (order by {values})"), F.lit(0.0))


#: Accuracy of the quantile sketch; its ranks are off by a part of 1/ACCURACY at most.
ACCURACY = 10_000


def floor_index_percentiles(df: DataFrame, key: str | list[str], values: str, of: dict[str, float]) -> DataFrame:
    """(key, names of ``of``): the value at index floor(n * p) of the sorted values.

    A quantile sketch per key, combined before its exchange, bounds each rank
    by a band of values; a second pass counts what lies below the band, and
    the distinct values inside it.  So no task sorts the rows of a key.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rows = df.where(F.col(values).isNotNull()).select(*keys, F.col(values).alias("_v"))
    margin = 4 / ACCURACY
    bounds = [min(1.0, max(0.0, p + d)) for p in of.values() for d in (-margin, margin)]
    bands = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile_approx("_v", bounds, ACCURACY).alias("_q"))
    band = [F.struct(F.lit(k).alias("p"), F.floor(F.col("_n") * p).alias("at"), F.get("_q", F.lit(2 * k)).alias("lo"), F.get("_q", F.lit(2 * k + 1)).alias("hi")) for k, p in enumerate(of.values())]
    bands = bands.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.inline(F.array(*band)))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    near = rows.join(bands, on & (F.col("_v") <= F.col("hi")))
    counted = near.select(*keys, "p", "at", F.when(F.col("_v") >= F.col("lo"), F.col("_v")).alias("_v")).groupBy(*keys, "p", "at", "_v").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*keys, "p").orderBy(F.asc_nulls_first("_v")))
    found = counted.withColumn("_upto", upto).where(F.col("_upto") > F.col("at"))
    return found.groupBy(*keys).agg(*[F.min(F.when(F.col("p") == k, F.col("_v"))).alias(name) for k, name in enumerate(of)])


def floor_rank_percentile(df: DataFrame, keys: list[str], values: str, p: float, name: str) -> DataFrame:
    """The same for one percentile and several keys."""
    return floor_index_percentiles(df, keys, values, {name: p})


def summary(df: DataFrame) -> DataFrame:
    """One row: total, ok and failed events, success rate, mean duration to two places."""
    return df.agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(failed()).alias("failed"),
        rate(F.count_if(F.col("status") == "ok"), F.count("*")).alias("success_rate"),
        F.coalesce(F.floor(F.avg("duration_ms") * 100 + 0.5) / 100, F.lit(0.0)).alias("avg_duration_ms"),
    )


def counts_by_type(df: DataFrame) -> DataFrame:
    return df.groupBy("type").agg(F.count("*").alias("events"), F.count_if(failed()).alias("failures"))


def source_metrics(df: DataFrame, source: str = "mcp_name") -> DataFrame:
    """Calls, failures, rate, mean and 95th percentile of duration, and open circuits by source."""
    calls = F.count("*")
    return df.where(F.col(source).isNotNull()).groupBy(source).agg(
        calls.alias("calls"), F.count_if(failed()).alias("failures"), rate(F.count_if(failed()), calls).alias("failure_rate"),
        F.coalesce(F.avg("duration_ms"), F.lit(0.0)).alias("avg_duration_ms"), p95("duration_ms").alias("p95_duration_ms"),
        F.count_if(F.get_json_object("metadata", "$.circuit") == "open").alias("circuit_open"),
    )


def top_counts(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The ``n`` most frequent keys; ties by key."""
    counted = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("count"))
    return counted.orderBy(F.desc("count"), F.asc(key)).limit(n)


def recommendations(success_rate: Column, top_error: Column, top_error_count: Column, circuits_open: Column, slow: Column, most: int = 3) -> Column:
    """The first ``most`` recommendations whose threshold is passed, in fixed order; ``slow`` is an array of sources."""
    found = F.array_compact(F.array(
        F.when(success_rate < 0.95, F.lit("success_rate")),
        F.when(top_error_count > 10, F.concat(F.lit("top_error:"), top_error)),
        F.when(circuits_open > 0, F.concat(F.lit("circuit_open:"), circuits_open.cast("string"))),
    ))
    return F.slice(F.concat(found, F.transform(slow, lambda s: F.concat(F.lit("slow:"), s))), 1, most)


def period_start(now: Column, period: str, from_now: bool = False) -> Column:
    """Start of 'day', 'week' (seven days back; at midnight unless ``from_now``) or 'month'."""
    day = F.date_trunc("day", now)
    if period == "week":
        return (now if from_now else day) - F.expr("interval 7 days")
    return F.date_trunc("month", now) if period == "month" else day


def latency_metrics(df: DataFrame, key: str, value: str) -> DataFrame:
    """Mean, 95th and 99th percentile by floor index, 0 where there are none."""
    ranks = floor_index_percentiles(df, key, value, {"p95_ms": 0.95, "p99_ms": 0.99})
    mean = df.groupBy(key).agg(F.avg(value).alias("avg_ms"))
    return mean.join(ranks, key, "left").select(key, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("avg_ms", "p95_ms", "p99_ms")])


def benchmark_stats(df: DataFrame, key: str, value: str) -> DataFrame:
    """Mean, population deviation, extremes, floor-index percentiles and operations a second."""
    of = {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99}
    moments = df.groupBy(key).agg(F.count("*").alias("n"), F.avg(value).alias("avg_ms"), F.stddev_pop(value).alias("stddev_ms"), F.min(value).alias("min_ms"), F.max(value).alias("max_ms"))
    joined = moments.join(floor_index_percentiles(df, key, value, of), key, "left")
    return joined.select(*moments.columns, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in of], rate(F.lit(1000.0), F.col("avg_ms")).alias("ops_per_s"))


def baseline_diff(now: DataFrame, base: DataFrame, key: str, value: str, tolerance: float = 5.0) -> DataFrame:
    """Percent change against a baseline; scenarios the baseline lacks are left out."""
    change = (F.col(value) - F.col("base")) / F.col("base") * 100
    joined = now.join(base.select(key, F.col(value).alias("base")), key)
    kind = F.when(change > tolerance, "regression").when(change < -tolerance, "improvement").otherwise("unchanged")
    return joined.select(key, F.col(value), "base", change.alias("change_pct"), kind.alias("kind"))


def context_consumers(df: DataFrame, n: int = 5) -> DataFrame:
    """The types that used most tokens; operations that freed tokens do not count."""
    used = df.where(F.col("estimated_tokens") > 0).groupBy("type").agg(F.sum("estimated_tokens").alias("total"), F.count("*").alias("count"))
    used = used.withColumn("avg", F.floor(F.col("total") / F.col("count") + 0.5))
    return used.orderBy(F.desc("total"), "type").limit(n)


def _ordered(df: DataFrame, line: Column, *order: Column) -> DataFrame:
    """One row: the lines of a bounded table, in order, joined."""
    return df.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)], line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))


def report_document(df: DataFrame, label: str, start: Column, end: Column, made_at: Column, slow_ms: float = 90.0) -> DataFrame:
    """(report): the whole Markdown report over a period's events; a part without rows has no heading.

    Every part is an aggregation to few rows (sources, the five most frequent
    errors and tools, circuit states), so the joins are of single rows.
    """
    total = df.agg(F.count("*").alias("n"), rate(F.count_if(F.col("status") == "ok"), F.count("*")).alias("ok"), F.count_if(failed()).alias("bad"))
    one = lambda x: F.format_string("%.1f", x * 100)
    whole = lambda c: F.floor(F.col(c) + 0.5).cast("long").cast("string")
    sources = source_metrics(df)
    row = F.concat(F.lit("| "), "mcp_name", F.lit(" | "), F.col("calls").cast("string"), F.lit(" | "), one(F.col("failure_rate")), F.lit("% | "), whole("avg_duration_ms"), F.lit("ms | "), whole("p95_duration_ms"), F.lit("ms | "), F.col("circuit_open").cast("string"), F.lit(" |"))
    errors, tools = top_counts(df.where(failed()), "error_type"), top_counts(df, "tool_name")
    state = F.get_json_object("metadata", "$.circuit")
    circuits = df.agg(*[F.count_if(state == s).cast("string").alias(s) for s in ("closed", "open", "half_open")], F.count_if(state == "open").alias("n_open"))
    top = top_counts(df.where(failed()), "error_type", 1).agg(F.max("error_type").alias("error"), F.max("count").alias("errors"))
    slow = sources.where(F.col("p95_duration_ms") > slow_ms).agg(F.array_sort(F.collect_list("mcp_name")).alias("slow"))
    parts = [
        _ordered(sources, row, -F.col("calls"), F.col("mcp_name")).withColumnRenamed("lines", "by_source"),
        _ordered(errors, F.concat(F.lit("- **"), "error_type", F.lit("**: "), F.col("count").cast("string"), F.lit("件")), -F.col("count"), F.col("error_type")).withColumnRenamed("lines", "by_error"),
        _ordered(tools, F.concat(F.lit("- "), "tool_name", F.lit(": "), F.col("count").cast("string"), F.lit("件")), -F.col("count"), F.col("tool_name")).withColumnRenamed("lines", "by_tool"),
        circuits, top, slow,
    ]
    all_of = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts, total)  # single rows
    advice = F.array_join(F.transform(recommendations(F.col("ok"), F.col("error"), F.col("errors"), F.col("n_open"), F.col("slow")), lambda x: F.concat(F.lit("- "), x)), "\n")
    part = lambda head, body, gap="\n\n": F.when(body == "", "").otherwise(F.concat(F.lit(head + gap), body, F.lit("\n\n")))
    stamp = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return all_of.select(F.concat(
        F.lit(f"# Observability Report: {label}\n\n**期間:** "), stamp(start), F.lit(" 〜 "), stamp(end), F.lit("\n\n## サマリー\n\n| 項目 | 値 |\n|------|-----|\n| 総イベント数 | "), F.col("n").cast("string"),
        F.lit(" |\n| 成功率 | "), one(F.col("ok")), F.lit("% |\n| 失敗数 | "), F.col("bad").cast("string"), F.lit(" |\n\n"),
        part("## 内部MCP別メトリクス\n\n| MCP | 呼出数 | 失敗率 | 平均 | p95 | Circuit Open |\n|-----|--------|--------|------|-----|--------------|", F.col("by_source"), "\n"),
        part("## 失敗理由トップ", F.col("by_error")), part("## 上位スキル", F.col("by_tool")),
        F.lit("## Circuit Breaker状態\n\n- Closed: "), "closed", F.lit("\n- Open: "), "open", F.lit("\n- Half-Open: "), "half_open", F.lit("\n\n"), part("## 改善提案", advice), F.lit("---\n_Generated at "), stamp(made_at), F.lit("_"),
    ).alias("report"))


def report_markdown(df: DataFrame) -> DataFrame:
    """A Markdown line per source: one-decimal percentages and rounded milliseconds."""
    pct = F.format_string("%.1f", F.col("failure_rate") * 100)
    return df.select(F.col("mcp_name").alias("source"), F.concat(F.lit("| "), "mcp_name", F.lit(" | "), F.col("calls").cast("string"), F.lit(" | "), pct, F.lit("% | "), F.floor(F.col("p95_duration_ms") + 0.5).cast("long").cast("string"), F.lit("ms |")).alias("line"))
