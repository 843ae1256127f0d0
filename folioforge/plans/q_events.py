"""Queries over the event log."""

from pyspark.sql import functions as F

from ..operators import events as E
from ..operators import ops as O
from .registry import derived, query, table

OPS = (
    "select event_id, ts as timestamp, event_type as type, concat('run', cast(user_id % 5 as string)) as run_id, "
    "case when event_type = 'error' then 'fail' else 'ok' end as status, value as duration_ms, event_type as mcp_name, "
    "concat('tool_', cast(user_id % 7 as string)) as tool_name, case when event_type = 'error' then concat('E', cast(user_id % 9 as string)) end as error_type, "
    "case when user_id % 11 = 0 then '{\"circuit\": \"open\"}' else '{\"circuit\": \"closed\"}' end as metadata from events"
)
WITH = f"with ops as ({OPS}) "
RANGE = ("2024-01-05 00:00:00", "2024-01-20 00:00:00")
IN_RANGE = f"timestamp between timestamp '{RANGE[0]}' and timestamp '{RANGE[1]}'"


def ops(spark, sf):
    return derived(spark, sf, OPS, "events")


@query(f"""{WITH} select mcp_name, count(*) as calls, count(*) filter (status = 'fail') as failures,
  count(*) filter (status = 'fail') / count(*) as failure_rate, round(avg(duration_ms), 6) as avg_duration_ms,
  coalesce(quantile_disc(duration_ms, 0.95), 0) as p95_duration_ms,
  count(*) filter (json_extract_string(metadata, '$.circuit') = 'open') as circuit_open from ops group by mcp_name""")
def a2_source_report(spark, sf):
    return E.source_metrics(ops(spark, sf)).withColumn("avg_duration_ms", F.round("avg_duration_ms", 6))


@query(f"""{WITH} select count(*) as total, count(*) filter (status = 'ok') as ok, count(*) filter (status = 'fail') as failed,
  count(*) filter (status = 'ok') / count(*) as success_rate, floor(avg(duration_ms) * 100 + 0.5) / 100 as avg_duration_ms from ops""")
def a1_event_summary(spark, sf):
    return E.summary(ops(spark, sf))


@query(f"{WITH} select type, count(*) as events, count(*) filter (status = 'fail') as failures from ops group by type")
def a1_counts_by_type(spark, sf):
    return E.counts_by_type(ops(spark, sf))


@query(f"{WITH} select error_type, count(*) as count from ops where status = 'fail' and error_type is not null group by 1 order by 2 desc, 1 limit 5")
def a3_top_errors(spark, sf):
    return E.top_counts(ops(spark, sf).where(E.failed()), "error_type")


@query(f"{WITH} select tool_name, count(*) as count from ops group by 1 order by 2 desc, 1 limit 5")
def a3_top_tools(spark, sf):
    return E.top_counts(ops(spark, sf), "tool_name")


@query(f"""{WITH}, s as (select count(*) filter (status = 'ok') / count(*) as r, count(*) filter (json_extract_string(metadata, '$.circuit') = 'open') as o from ops),
  e as (select error_type as t, count(*) as c from ops where status = 'fail' group by 1 order by 2 desc, 1 limit 1),
  m as (select coalesce(list(mcp_name order by mcp_name), []) as slow from (select mcp_name, quantile_disc(duration_ms, 0.95) as p from ops group by 1) where p > 90)
  select unnest(list_filter([case when r < 0.95 then 'success_rate' end, case when c > 10 then concat('top_error:', t) end, case when o > 0 then concat('circuit_open:', cast(o as string)) end], lambda x: x is not null)
   || list_transform(slow, lambda x: concat('slow:', x)))  as recommendation from s, e, m limit 3""")
def a4_recommendations(spark, sf):
    """All inputs are one row each: the joins are of single rows."""
    df = ops(spark, sf)
    s = df.agg(E.rate(F.count_if(F.col("status") == "ok"), F.count("*")).alias("r"), F.count_if(F.get_json_object("metadata", "$.circuit") == "open").alias("o"))
    e = E.top_counts(df.where(E.failed()), "error_type", 1).agg(F.max("error_type").alias("t"), F.max("count").alias("c"))
    m = E.source_metrics(df).where("p95_duration_ms > 90").agg(F.array_sort(F.collect_list("mcp_name")).alias("slow"))
    one = s.join(e, F.lit(True)).join(m, F.lit(True))
    return one.select(F.explode(E.recommendations(F.col("r"), F.col("t"), F.col("c"), F.col("o"), F.col("slow"))).alias("recommendation"))


@query(f"{WITH} select event_id, type, status from ops where type = 'error' and run_id = 'run1' and status = 'fail' and timestamp >= timestamp '2024-01-10 00:00:00' order by timestamp desc, event_id desc limit 20")
def p1_filter_events(spark, sf):
    return E.filter_events(ops(spark, sf), "error", "run1", "fail", "2024-01-10 00:00:00", 20, ("timestamp", "event_id")).select("event_id", "type", "status")


@query(f"{WITH} select type, count(*) as n from ops where {IN_RANGE} group by 1")
def p2_time_range(spark, sf):
    return E.in_range(ops(spark, sf), *RANGE).groupBy("type").agg(F.count("*").alias("n"))


@query("""with n as (select timestamp '2024-01-17 15:30:00' as now) select 'day' as period, count(*) as n from events, n where ts >= date_trunc('day', now) and ts <= now
  union all select 'week', count(*) from events, n where ts >= date_trunc('day', now) - interval 7 days and ts <= now
  union all select 'week_cli', count(*) from events, n where ts >= now - interval 7 days and ts <= now
  union all select 'month', count(*) from events, n where ts >= date_trunc('month', now) and ts <= now""")
def p3_period_cutoffs(spark, sf):
    ev, now = table(spark, sf, "events"), F.lit("2024-01-17 15:30:00").cast("timestamp")
    inside = lambda p, f=False: F.count_if((F.col("ts") >= E.period_start(now, p, f)) & (F.col("ts") <= now))
    one = ev.agg(inside("day").alias("day"), inside("week").alias("week"), inside("week", True).alias("week_cli"), inside("month").alias("month"))
    return one.unpivot([], ["day", "week", "week_cli", "month"], "period", "n")


@query(f"{WITH} select event_id, type from ops order by timestamp desc, event_id desc limit 100")
def w17_last_events(spark, sf):
    return E.last_n(ops(spark, sf), 100, "timestamp", "event_id").select("event_id", "type")


FLOOR = "coalesce(list_sort(list({v}))[cast(floor(count({v}) * {p}) as int) + 1], 0)"


@query(f"{WITH} select type, round(avg(duration_ms), 6) as avg_ms, {FLOOR.format(v='duration_ms', p=0.95)} as p95_ms, {FLOOR.format(v='duration_ms', p=0.99)} as p99_ms from ops group by type")
def a16_latency_metrics(spark, sf):
    return E.latency_metrics(ops(spark, sf), "type", "duration_ms").withColumn("avg_ms", F.round("avg_ms", 6))


@query(f"{WITH} select type, {FLOOR.format(v='duration_ms', p=0.95)} as p95_ms from ops group by type")
def a16_latency_by_rank(spark, sf):
    return E.floor_rank_percentile(ops(spark, sf), ["type"], "duration_ms", 0.95, "p95_ms")


@query(f"""{WITH} select type, count(*) as n, round(avg(duration_ms), 6) as avg_ms, round(stddev_pop(duration_ms), 6) as stddev_ms, min(duration_ms) as min_ms, max(duration_ms) as max_ms,
  {FLOOR.format(v='duration_ms', p=0.5)} as p50_ms, {FLOOR.format(v='duration_ms', p=0.95)} as p95_ms, {FLOOR.format(v='duration_ms', p=0.99)} as p99_ms, round(1000.0 / avg(duration_ms), 6) as ops_per_s from ops group by type""")
def a17_benchmark_stats(spark, sf):
    out = E.benchmark_stats(ops(spark, sf), "type", "duration_ms")
    return out.withColumns({c: F.round(c, 6) for c in ("avg_ms", "stddev_ms", "ops_per_s")})


DIFF = "with b as (select event_type as type, avg(value) as v from events where user_id % 2 = 0 group by 1), n as (select event_type as type, avg(value) as v from events group by 1)"


@query(f"""{DIFF} select type, round(n.v, 6) as v, round(b.v, 6) as base, round((n.v - b.v) / b.v * 100, 6) as change_pct,
  case when (n.v - b.v) / b.v * 100 > 5 then 'regression' when (n.v - b.v) / b.v * 100 < -5 then 'improvement' else 'unchanged' end as kind from n join b using (type)""")
def a18_baseline_diff(spark, sf):
    ev = table(spark, sf, "events").withColumnRenamed("event_type", "type")
    mean = lambda df: df.groupBy("type").agg(F.avg("value").alias("v"))
    out = E.baseline_diff(mean(ev), mean(ev.where("user_id % 2 = 0")), "type", "v")
    return out.withColumns({c: F.round(c, 6) for c in ("v", "base", "change_pct")})


@query("""with u as (select event_type as type, case when event_type = 'signup' then -value else value end as t from events), c as (select type, sum(t) as total, count(*) as count from u where t > 0 group by 1)
  select type, round(total, 4) as total, count, floor(total / count + 0.5) as avg from c order by c.total desc, type limit 5""")
def a15_context_consumers(spark, sf):
    ev = table(spark, sf, "events").select(F.col("event_type").alias("type"), F.when(F.col("event_type") == "signup", -F.col("value")).otherwise(F.col("value")).alias("estimated_tokens"))
    return E.context_consumers(ev).withColumns({"total": F.round("total", 4), "avg": F.col("avg").cast("double")})


@query(f"""{WITH}, m as (select mcp_name, count(*) as c, count(*) filter (status = 'fail') / count(*) as r, coalesce(quantile_disc(duration_ms, 0.95), 0) as p from ops group by 1)
  select mcp_name as source, concat('| ', mcp_name, ' | ', cast(c as string), ' | ', printf('%.1f', r * 100), '% | ', cast(cast(floor(p + 0.5) as bigint) as string), 'ms |') as line from m""")
def k13_report_markdown(spark, sf):
    return E.report_markdown(E.source_metrics(ops(spark, sf)))


@query("select count(*) as total, count(*) filter (event_type = 'error') as open, count(*) filter (event_type = 'view') as half_open, count(*) filter (event_type not in ('error', 'view')) as closed from events")
def a32_circuit_summary(spark, sf):
    kind = F.when(F.col("event_type") == "error", "open").when(F.col("event_type") == "view", "half_open").otherwise("closed")
    return O.state_summary(table(spark, sf, "events").withColumn("state", kind), "state")


@query("select case when event_type = 'error' then 'ng' else 'ok' end as status, count(*) as files, round(sum(value), 4) as kb from events group by 1")
def a33_batch_tally(spark, sf):
    return O.batch_tally(table(spark, sf, "events"), F.col("event_type") == "error", "value").withColumn("kb", F.round("kb", 4))


@query("""select event_type as stage, round(avg(s), 6) as avg_s, min(s) as min_s, round(sum(s) * 1000 / count(distinct user_id), 4) as ms_per_chapter from (select event_type, user_id, value / 1000 as s from events) group by 1""")
def a19_conversion_benchmark(spark, sf):
    ev = table(spark, sf, "events").withColumn("s", F.col("value") / 1000)
    out = O.stage_benchmark(ev.withColumnRenamed("event_type", "stage"), "stage", "s", "user_id")
    return out.withColumns({"avg_s": F.round("avg_s", 6), "ms_per_chapter": F.round("ms_per_chapter", 4)})


@query("select case when user_id % 7 = 0 then 'high' when user_id % 3 = 0 then 'medium' else 'low' end as risk, count(*) as n from events group by 1")
def a31_risk_counts(spark, sf):
    risk = F.when(F.col("user_id") % 7 == 0, "high").when(F.col("user_id") % 3 == 0, "medium").otherwise("low")
    return table(spark, sf, "events").groupBy(risk.alias("risk")).agg(F.count("*").alias("n"))


@query("""with s as (select user_id, max(case when event_type = 'error' then 2 when event_type = 'view' then 1 else 0 end) as r from events group by 1)
  select user_id, case r when 2 then 'high' when 1 then 'medium' else 'low' end as plan_risk from s""")
def a31_plan_risk(spark, sf):
    risk = F.when(F.col("event_type") == "error", "high").when(F.col("event_type") == "view", "medium").otherwise("low")
    return O.plan_risk(table(spark, sf, "events").withColumn("risk", risk), "user_id", "risk")


_PCT = "printf('%.1f', {} * 100)"
_MS = "cast(cast(floor({} + 0.5) as bigint) as varchar)"


@query(f"""{WITH}, x as (select * from ops where {IN_RANGE}), t as (select count(*) as n, count(*) filter (status = 'ok') / count(*) as ok, count(*) filter (status = 'fail') as bad from x),
  m as (select mcp_name, count(*) as calls, count(*) filter (status = 'fail') / count(*) as r, avg(duration_ms) as a, coalesce(quantile_disc(duration_ms, 0.95), 0) as p, count(*) filter (json_extract_string(metadata, '$.circuit') = 'open') as o from x group by 1),
  ml as (select string_agg(concat('| ', mcp_name, ' | ', calls, ' | ', {_PCT.format('r')}, '% | ', {_MS.format('a')}, 'ms | ', {_MS.format('p')}, 'ms | ', o, ' |'), chr(10) order by calls desc, mcp_name) as l, list(mcp_name order by mcp_name) filter (p > 90) as slow from m),
  e as (select error_type as k, count(*) as c from x where status = 'fail' and error_type is not null group by 1 order by 2 desc, 1 limit 5), el as (select string_agg(concat('- **', k, '**: ', c, '件'), chr(10) order by c desc, k) as l, arg_min(k, -c * 1000 + cast(substring(k, 2) as int)) as top, max(c) as topc from e),
  s as (select tool_name as k, count(*) as c from x group by 1 order by 2 desc, 1 limit 5), sl as (select string_agg(concat('- ', k, ': ', c, '件'), chr(10) order by c desc, k) as l from s),
  c as (select count(*) filter (json_extract_string(metadata, '$.circuit') = 'closed') as cl, count(*) filter (json_extract_string(metadata, '$.circuit') = 'open') as op from x),
  r as (select list_concat(list_filter([case when ok < 0.95 then 'success_rate' end, case when topc > 10 then concat('top_error:', top) end, case when op > 0 then concat('circuit_open:', op) end], lambda v: v is not null), list_transform(coalesce(slow, []), lambda v: concat('slow:', v)))[1:3] as recs from t, ml, el, c)
  select concat('# Observability Report: range', chr(10), chr(10), '**期間:** 2024-01-05T00:00:00.000Z 〜 2024-01-20T00:00:00.000Z', chr(10), chr(10), '## サマリー', chr(10), chr(10), '| 項目 | 値 |', chr(10), '|------|-----|', chr(10), '| 総イベント数 | ', n, ' |', chr(10), '| 成功率 | ', {_PCT.format('ok')}, '% |', chr(10), '| 失敗数 | ', bad, ' |', chr(10), chr(10),
    '## 内部MCP別メトリクス', chr(10), chr(10), '| MCP | 呼出数 | 失敗率 | 平均 | p95 | Circuit Open |', chr(10), '|-----|--------|--------|------|-----|--------------|', chr(10), ml.l, chr(10), chr(10),
    case when el.l is null then '' else concat('## 失敗理由トップ', chr(10), chr(10), el.l, chr(10), chr(10)) end, '## 上位スキル', chr(10), chr(10), sl.l, chr(10), chr(10), '## Circuit Breaker状態', chr(10), chr(10), '- Closed: ', cl, chr(10), '- Open: ', op, chr(10), '- Half-Open: 0', chr(10), chr(10),
    case when len(recs) = 0 then '' else concat('## 改善提案', chr(10), chr(10), array_to_string(list_transform(recs, lambda v: concat('- ', v)), chr(10)), chr(10), chr(10)) end, '---', chr(10), '_Generated at 2024-01-20T00:00:00.000Z_') as report from t, ml, el, sl, c, r""")
def k13_report_document(spark, sf):
    """The whole report of a period."""
    start, end = (F.lit(t).cast("timestamp") for t in RANGE)
    return E.report_document(E.in_range(ops(spark, sf), *RANGE), "range", start, end, end)
