"""Queries over agent tasks derived from orders."""

from pyspark.sql import functions as F

from ..operators import tasks as K
from .registry import derived, query

TASKS = (
    "select o_orderkey as id, concat('agent', cast(o_custkey % 20 as string)) as agent, o_orderpriority as category, "
    "case o_orderstatus when 'F' then 'completed' when 'O' then 'failed' else 'running' end as status, "
    "case when o_orderkey % 7 = 0 then null else cast(floor(o_totalprice) as bigint) % 100 end as quality, cast(o_orderkey % 13 * 100 as double) as duration_ms, "
    "case when o_orderkey % 17 = 0 then null else o_orderdate end as completed_at, "
    "case when o_orderstatus = 'O' then case o_orderkey % 4 when 0 then concat('Timeout at line ', cast(o_orderkey as string)) when 1 then concat('File /tmp/x', cast(o_orderkey as string), ' not found') "
    "when 2 then 'permission denied' else concat('odd value ', cast(o_orderkey % 3 as string)) end end as error from orders"
)
WITH = f"with tasks as ({TASKS}) "
FOLD = """list_reduce(list_prepend({{'m': 0.0::double, 'n': 0::bigint, 'v': null::double}}, list({{'m': 0.0::double, 'n': 0::bigint, 'v': {v}::double}} order by id)),
  lambda a, x: {{'m': case when x.v is null then a.m else (a.m * a.n + x.v) / (a.n + 1) end, 'n': a.n + 1, 'v': null::double}}).m"""
STATS = f"""{WITH}, stats as (select agent, count(*) as total, count(*) filter (status = 'completed') as successful, count(*) filter (status = 'failed') as failed,
  count(*) filter (status = 'completed') / count(*) as success_rate, {FOLD.format(v='quality')} as avg_quality, {FOLD.format(v='duration_ms')} as avg_duration_ms, coalesce(avg(quality), 0) as true_avg_quality from tasks group by agent)"""
HEALTH = """case when total < 3 then 'unknown' when avg_quality >= 55 and success_rate >= 0.5 then 'excellent' when avg_quality >= 45 and success_rate >= 0.4 then 'good'
  when avg_quality >= 40 and success_rate >= 0.3 then 'fair' else 'poor' end"""


def tasks(spark, sf):
    return derived(spark, sf, TASKS, "orders")


def stats(spark, sf):
    return K.agent_stats(tasks(spark, sf))


def with_health(spark, sf):
    return stats(spark, sf).withColumn("health", K.health(F.col("total"), F.col("avg_quality"), F.col("success_rate"), (55, 45, 40), (0.5, 0.4, 0.3)))


@query(f"{STATS} select agent, total, successful, failed, success_rate, round(avg_quality, 4) as avg_quality, round(avg_duration_ms, 4) as avg_duration_ms, round(true_avg_quality, 4) as true_avg_quality from stats")
def a11_agent_stats(spark, sf):
    return stats(spark, sf).withColumns({c: F.round(c, 4) for c in ("avg_quality", "avg_duration_ms", "true_avg_quality")})


@query(f"{STATS} select count(*) as agents, sum(total) as tasks, sum(successful) / sum(total) as success_rate, round(avg(avg_quality) filter (avg_quality > 0), 4) as avg_quality from stats")
def a8_system_stats(spark, sf):
    return K.system_stats(stats(spark, sf)).withColumn("avg_quality", F.round("avg_quality", 4))


@query(f"{STATS} select agent, success_rate, total from stats order by success_rate desc, agent limit 5")
def t2_top_performers(spark, sf):
    return K.top_performers(stats(spark, sf))


@query(f"{STATS} select agent, {HEALTH} as health from stats")
def g21_health(spark, sf):
    return with_health(spark, sf).select("agent", "health")


@query(f"{STATS}, h as (select *, {HEALTH} as health from stats) select agent, health from h where health in ('poor', 'fair') or success_rate < 0.45")
def p11_needs_attention(spark, sf):
    return K.needs_attention(with_health(spark, sf), 0.45).select("agent", "health")


@query(f"{WITH} select category, count(*) as n from tasks group by 1")
def a8_task_distribution(spark, sf):
    return tasks(spark, sf).groupBy("category").agg(F.count("*").alias("n"))


@query(f"""{WITH}, d as (select unnest(generate_series(date '1996-02-15', date '1996-03-15', interval 1 day))::date as day)
  select day, count(id) as tasks, count(*) filter (status = 'completed') as successful, coalesce(round(avg(quality), 4), 0) as avg_quality from d left join tasks on completed_at::date = day group by 1""")
def a9_daily_trend(spark, sf):
    return K.daily_trend(tasks(spark, sf), "1996-03-15").withColumn("avg_quality", F.round("avg_quality", 4))


NORMAL = r"substring(regexp_replace(regexp_replace(regexp_replace(error, '/[^\s]+', '<path>', 'g'), 'line [0-9]+', 'line <N>', 'gi'), '[0-9]+', '<N>', 'g'), 1, 100)"
FIX = "case " + " ".join(f"when contains(lower(pattern), '{w}') then '{f}'" for w, f in K.FIXES) + f" else '{K.NO_FIX}' end"


@query(f"""{WITH}, p as (select {NORMAL} as pattern, agent, completed_at from tasks where error is not null and error <> ''),
  g as (select pattern, count(*) as count, list_sort(list(distinct agent)) as agents, max(completed_at) as last_seen from p group by 1 order by 2 desc, 1 limit 10) select *, {FIX} as fix from g""")
def a10_error_patterns(spark, sf):
    return K.error_patterns(tasks(spark, sf))


@query(f"{WITH} select id, {NORMAL} as pattern from tasks where error is not null")
def g19_normalize_error(spark, sf):
    return tasks(spark, sf).where("error is not null").select("id", K.normalize_error(F.col("error")).alias("pattern"))


@query(f"{WITH}, p as (select id, {NORMAL} as pattern from tasks where error is not null) select id, {FIX} as fix from p")
def g20_suggested_fix(spark, sf):
    return tasks(spark, sf).where("error is not null").select("id", K.suggested_fix(K.normalize_error(F.col("error"))).alias("fix"))


@query(f"{WITH} select count(*) as kept from tasks where completed_at is null or completed_at >= timestamp '1997-01-01 00:00:00' - interval 90 days")
def p12_retention(spark, sf):
    return K.retained(tasks(spark, sf), "1997-01-01 00:00:00").agg(F.count("*").alias("kept"))


@query(f"{STATS} select agent, concat_ws(',', agent, cast(total as string), printf('%.4f', success_rate), printf('%.2f', avg_quality)) as line from stats")
def k12_export_csv(spark, sf):
    return K.export_csv(stats(spark, sf))


@query(f"""{STATS} select agent, '{{"agent":"' || agent || '","total":' || total || ',"successful":' || successful || '}}' as line from stats""")
def k12_export_json(spark, sf):
    return K.export_json(stats(spark, sf))
