"""Queries over cost records derived from order lines."""

from pyspark.sql import functions as F

from ..operators import costs as C
from .registry import derived, query, table

COST = (
    "select l_orderkey * 10 + l_linenumber as id, o_orderdate as timestamp, concat(l_returnflag, l_linestatus) as model, o_orderpriority as provider, "
    "cast(l_quantity * 1000 as bigint) as input_tokens, cast(l_quantity * 100 as bigint) as output_tokens, cast(l_quantity * 250 as bigint) as cached_tokens, "
    "l_extendedprice / 1000 as cost, cast(o_custkey % 3 as string) as project_id from lineitem join orders on l_orderkey = o_orderkey"
)
WITH = f"with cost as ({COST}) "
NOW = "1996-03-15 12:00:00"


def cost(spark, sf):
    return derived(spark, sf, COST.replace("join orders on", "join orders  on"), "lineitem", "orders")


def rounded(df, *cols, to=4):
    return df.withColumns({c: F.round(c, to) for c in cols})


@query(f"{WITH} select model, provider, count(*) as requests, round(sum(cost), 4) as cost from cost group by grouping sets ((model), (provider), ())")
def a5_spend(spark, sf):
    return rounded(C.spend(cost(spark, sf)), "cost")


@query(f"{WITH} select count(*) as requests, round(sum(cost), 4) as cost, round(sum(cost) / count(*), 6) as per_request from cost")
def a5_cost_per_request(spark, sf):
    out = cost(spark, sf).agg(F.count("*").alias("requests"), F.sum("cost").alias("cost"))
    return out.select("requests", F.round("cost", 4).alias("cost"), F.round(F.col("cost") / F.col("requests"), 6).alias("per_request"))


SPENT = f"""{WITH}, p as (select timestamp '{NOW}' as now), s as (select
  coalesce(sum(cost) filter (date_trunc('day', timestamp) = date_trunc('day', now) and project_id = '1'), 0) as daily,
  coalesce(sum(cost) filter (date_trunc('month', timestamp) = date_trunc('month', now) and project_id = '1'), 0) as monthly,
  coalesce(sum(cost) filter (date_trunc('day', timestamp) = date_trunc('day', now)), 0) as global_daily,
  coalesce(sum(cost) filter (date_trunc('month', timestamp) = date_trunc('month', now)), 0) as global_monthly,
  coalesce(sum(cost) filter (date_trunc('day', timestamp) = date_trunc('day', now) and model = 'NO'), 0) as premium_daily,
  coalesce(sum(cost) filter (date_trunc('month', timestamp) = date_trunc('month', now) and model = 'NO'), 0) as premium_monthly from cost, p)"""
SPENT_COLS = ("daily", "monthly", "global_daily", "global_monthly", "premium_daily", "premium_monthly")
ROUNDED = ", ".join(f"round({c}, 4) as {c}" for c in SPENT_COLS)


def spent(spark, sf):
    return C.period_spend(cost(spark, sf), F.lit(NOW).cast("timestamp"), F.col("project_id") == "1", "NO")


@query(f"{SPENT} select {ROUNDED} from s")
def a6_period_spend(spark, sf):
    return rounded(spent(spark, sf), *SPENT_COLS)


@query(f"""{SPENT} select {ROUNDED}, daily >= 50 or monthly >= 1000 or global_daily >= 500 as is_over_budget, global_daily >= 500 as is_global_over, premium_daily >= 20 as is_premium_over,
  round(greatest(0, 50 - daily), 4) as daily_remaining, round(greatest(0, 1000 - monthly), 4) as monthly_remaining, round(monthly / 1000 * 100, 4) as percent_used, monthly / 1000 * 100 >= 80 as is_warning from s""")
def a7_budget_status(spark, sf):
    status = C.budget_status(spent(spark, sf), C.Budget(50, 1000, 80, 500, None, 20))
    return rounded(status, *SPENT_COLS, "daily_remaining", "monthly_remaining", "percent_used")


@query(f"{WITH}, b as (select * from cost where project_id = '1' union all select * from cost) select model, count(*) as requests, round(sum(cost), 4) as cost from b group by 1")
def u1_both_logs(spark, sf):
    every = cost(spark, sf)
    return C.both_logs(every.where("project_id = '1'"), every).groupBy("model").agg(F.count("*").alias("requests"), F.round(F.sum("cost"), 4).alias("cost"))


@query(f"{WITH} select model, count(*) as requests from (select distinct * from cost) group by 1")
def u1_both_logs_once(spark, sf):
    every = cost(spark, sf)
    return C.both_logs_once(every.where("project_id = '1'"), every).groupBy("model").agg(F.count("*").alias("requests"))


PRICES = "select 'NO' as model, 15.0 as input_price, 75.0 as output_price, 1.5 as cached_price union all select 'RF', 3.0, 15.0, null"


@query(f"""with cost as ({COST}), prices as ({PRICES}) select model, round(sum(coalesce((input_tokens - cached_tokens) / 1e6 * input_price + cached_tokens / 1e6 * coalesce(cached_price, input_price) + output_tokens / 1e6 * output_price, 0)), 6) as cost
  from cost left join prices using (model) group by 1""")
def g12_token_cost(spark, sf):
    prices = spark.createDataFrame([("NO", 15.0, 75.0, 1.5), ("RF", 3.0, 15.0, None)], "model string, input_price double, output_price double, cached_price double")
    return C.with_cost(cost(spark, sf).drop("cost"), prices).groupBy("model").agg(F.round(F.sum("cost"), 6).alias("cost"))


@query("select p_partkey, round(p_size * 100 / 1e6 * 3 + p_size * 100 * 0.3 / 1e6 * 15, 8) as cost, round(500 + p_size * 100 / 80.0 * 1000, 4) as latency_ms from part")
def g13_estimates(spark, sf):
    tokens = F.col("p_size") * 100
    return table(spark, sf, "part").select("p_partkey", F.round(C.estimate_cost(tokens, F.lit(3), F.lit(15)), 8).alias("cost"), F.round(C.estimate_latency_ms(tokens, F.lit(500), F.lit(80.0)), 4).alias("latency_ms"))


@query("""select doc_id, least(5, greatest(1, case when n_chars < 100 then 1 when n_chars < 500 then 2 when n_chars < 2000 then 3 when n_chars < 5000 then 4 else 5 end
  + cast(regexp_matches(lower(text), 'license|copyright') as int) - cast(regexp_matches(lower(text), 'the end|phone') as int))) as level from documents""")
def g14_complexity(spark, sf):
    return table(spark, sf, "documents").select("doc_id", C.complexity(F.col("n_chars"), F.col("text"), ["license", "copyright"], ["the end", "phone"]).alias("level"))
