"""Queries of ordered-sequence operators."""


from pyspark.sql import functions as F

from ..operators import ops as O
from ..operators import windows as W
from .registry import ORACLE, derived, query, table


def ev(spark, sf):
    return table(spark, sf, "events")


@query("select event_id, count(*) over w as in_window, min(ts) over w as oldest from events window w as (partition by user_id order by epoch_us(ts) range between 86399999999 preceding and current row)")
def w13_rolling_requests(spark, sf):
    return W.rolling_requests(ev(spark, sf), "user_id", "ts", 86_400).select("event_id", "in_window", "oldest")


@query("select event_id, round(sum(value) over (partition by user_id order by ts, event_id rows between 99 preceding and current row), 4) as window_sum from events")
def w14_last_rows_sum(spark, sf):
    return W.last_rows_sum(ev(spark, sf), "user_id", "value", "ts", "event_id").select("event_id", F.round("window_sum", 4).alias("window_sum"))


@query("select event_id, count(*) over (partition by user_id order by epoch_us(ts) range between 17999999999 preceding and current row) >= 2 as near_limit from events")
def w15_usage_window(spark, sf):
    return W.rolling_requests(ev(spark, sf), "user_id", "ts", 18_000).select("event_id", W.near_limit(F.col("in_window"), 2, 0.8).alias("near_limit"))


@query("""with u as (select event_id, sum(cast(floor(value * 10) as bigint)) over (partition by user_id order by ts, event_id rows unbounded preceding) as used from events)
  select event_id, used, 50000.0 - used as remaining, case when used / 50000.0 >= 0.95 then 'emergency' when used / 50000.0 >= 0.9 then 'critical' when used / 50000.0 >= 0.8 then 'warning' when used / 50000.0 >= 0.6 then 'info' else 'ok' end as level from u""")
def w16_running_budget(spark, sf):
    tokens = ev(spark, sf).withColumn("tokens", F.floor(F.col("value") * 10))
    return W.running_budget(tokens, "user_id", "tokens", "ts", "event_id", limit=50_000.0).select("event_id", "used", "remaining", "level")


@query("""with a as (select event_id, user_id, ts, event_type = 'error' as bad, row_number() over (partition by user_id order by ts, event_id) as run_count, sum(case when event_type = 'error' then 0 else 1 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as g from events)
  select event_id, run_count, sum(case when bad then 1 else 0 end) over (partition by user_id, g order by ts, event_id rows unbounded preceding) as consecutive_failures from a""")
def w18_consecutive_failures(spark, sf):
    return W.consecutive_failures(ev(spark, sf), "user_id", F.col("event_type") == "error", "ts", "event_id").select("event_id", "run_count", "consecutive_failures")


@query("select event_id, date_trunc('day', ts) = timestamp '2024-01-17 00:00:00' as ran_today, date_trunc('week', ts) = date_trunc('week', timestamp '2024-01-17 00:00:00') as ran_this_week from events")
def w19_ran_in_period(spark, sf):
    now = F.lit("2024-01-17 15:00:00").cast("timestamp")
    return ev(spark, sf).select("event_id", W.same_period(F.col("ts"), now, "day").alias("ran_today"), W.same_period(F.col("ts"), now, "week").alias("ran_this_week"))


@query("select o_orderkey, bool_and(l_linestatus = 'F') as complete from lineitem join orders on l_orderkey = o_orderkey group by 1")
def w21_all_phases(spark, sf):
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return W.phases_complete(lines, "o_orderkey", F.col("l_linestatus") == "F", "all")


@query("select l_orderkey, bool_or(l_returnflag = 'R') as complete from lineitem group by 1")
def w21_any_phase(spark, sf):
    return W.phases_complete(table(spark, sf, "lineitem"), "l_orderkey", F.col("l_returnflag") == "R", "any")


SPANS = "select user_id, event_id, epoch_us(ts) as s, epoch_us(ts) + cast(floor(value * 100000000) as bigint) as e from events"


@query(f"with t as ({SPANS}) select a.user_id, a.event_id as first, b.event_id as second from t a join t b on a.user_id = b.user_id and a.s < b.e and b.s < a.e and a.event_id < b.event_id")
def j11_overlaps(spark, sf):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    t = ev(spark, sf).select("user_id", "event_id", us.alias("s"), (us + F.floor(F.col("value") * 100_000_000)).alias("e"))
    return W.overlaps(t, "user_id", "s", "e", "event_id")


@query("""with recursive e as (select user_id, event_type <> 'error' as fine, epoch_us(ts) as t, row_number() over (partition by user_id order by ts, event_id) as k from events),
  r as (select user_id, cast(0 as bigint) as k, 'closed' as state, 0 as bad, 0 as good, cast(0 as bigint) as since, cast(0 as bigint) as rejected, cast(0 as bigint) as opened from e where k = 1
    union all select user_id, k, case when waits then 'open' when opens then 'open' when state <> 'closed' and (not fine or good + 1 < 2) then 'half_open' else 'closed' end,
        case when waits then bad when opens or fine then 0 else bad + 1 end, case when waits then good when fine and state <> 'closed' then good + 1 else good end, case when opens then t else since end,
        rejected + case when waits then 1 else 0 end, opened + case when opens then 1 else 0 end
      from (select *, not waits and not fine and (state <> 'closed' or bad + 1 >= 2) as opens
        from (select r.user_id, e.k, fine, t, bad, since, rejected, opened, state = 'open' and t - since < 86400000000 as waits, case when state = 'open' and t - since >= 86400000000 then 'half_open' else state end as state, case when state = 'open' and t - since >= 86400000000 then 0 else good end as good
          from r join e on e.user_id = r.user_id and e.k = r.k + 1)))
  select user_id, max(k) as calls, max(rejected) as rejected, max(opened) as opened, arg_max(state, k) as state from r group by 1""")
def w20_circuit_replay(spark, sf):
    return W.circuit_states(ev(spark, sf).withColumn("ok", F.col("event_type") != "error"), "user_id", "ts", "ok", 2, 86_400.0, 2, ("event_id",))


@query("""with recursive c as (select conv_id, turn, length(text) as mora, row_number() over (partition by conv_id order by turn) as k from conversations),
  s as (select conv_id, turn, mora, k, 0 as segment, mora + 0.0 as fill from c where k = 1
    union all select c.conv_id, c.turn, c.mora, c.k, case when fill + c.mora > 180 then segment + 1 else segment end, case when fill + c.mora > 180 then c.mora + 0.0 else fill + c.mora end from s join c on c.conv_id = s.conv_id and c.k = s.k + 1)
  select conv_id, turn, cast(mora as int) as mora, segment from s""")
def w23_greedy_segments(spark, sf):
    return W.greedy_segments(table(spark, sf, "conversations").withColumn("mora", F.length("text")), "conv_id", "turn", "mora", 180.0)


def words(spark, sf):
    """Word boxes from the words of documents: five lines of eight words a page, in two columns."""
    ws = F.split("text", "[ \n]+")
    w = table(spark, sf, "documents").select("doc_id", F.posexplode(ws).alias("k", "w"))
    row, col = F.floor((F.col("k") % 40) / 8), (F.col("k") % 40) % 8
    top = row * 14 + F.col("doc_id") % 3 + F.when(F.col("k") % 40 >= 24, 30).otherwise(0)
    return w.select("doc_id", F.floor(F.col("k") / 40).cast("int").alias("page"), F.col("w").alias("text"), (col * 60 + F.when(col >= 4, 100).otherwise(0)).cast("double").alias("x0"), top.cast("double").alias("top"), (top + 10).cast("double").alias("bottom"), F.lit(700.0).alias("page_w"), F.lit(110.0).alias("page_h"))


WORDS_SQL = """with n as (select doc_id, string_split_regex(text, '[ \n]+') as ws from documents), e as (select doc_id, unnest(ws) as w, unnest(generate_series(0, len(ws) - 1)) as k from n),
  words as (select doc_id, cast(floor(k / 40) as int) as page, w as text, (k % 40) % 8 * 60.0 + case when (k % 40) % 8 >= 4 then 100 else 0 end as x0, floor((k % 40) / 8) * 14.0 + doc_id % 3 + case when k % 40 >= 24 then 30 else 0 end as top, 700.0 as page_w, 110.0 as page_h from e)"""


@query(f"{WORDS_SQL} select doc_id, page, count(*) as words from words where top > page_h * 0.07 and top < page_h * 0.93 group by 1, 2")
def p9_body_band(spark, sf):
    return W.body_band(words(spark, sf)).groupBy("doc_id", "page").agg(F.count("*").alias("words"))


@query(f"{WORDS_SQL}, x as (select distinct doc_id, page, round(x0) as x from words), c as (select doc_id, page, x, x - lag(x) over (partition by doc_id, page order by x) as g from x), k as (select doc_id, page, count(*) filter (g > 70) + 1 as columns from c group by 1, 2) select * from k")
def w9_columns(spark, sf):
    return W.columns_by_gap(words(spark, sf)).groupBy("doc_id", "page").agg((F.max("column") + 1).alias("columns").cast("long").alias("columns"))


@query(f"{WORDS_SQL}, h as (select doc_id, page, median(10.0) as height from words group by 1, 2) select doc_id, page, greatest(0.6 * height, 4.0) as tolerance from h")
def a30_line_tolerance(spark, sf):
    h = words(spark, sf).groupBy("doc_id", "page").agg(F.median(F.col("bottom") - F.col("top")).alias("height"))
    return h.select("doc_id", "page", F.greatest(F.col("height") * 0.6, F.lit(4.0)).alias("tolerance"))


@query("select p_partkey, p_size >= 20 and p_partkey % 60 >= 20 as kept from part")
def p10_image_filter(spark, sf):
    return table(spark, sf, "part").select("p_partkey", O.is_picture(F.col("p_size"), F.col("p_partkey") % 60).alias("kept"))


@query("select p_partkey, case when p_size * 20000 > 650000 then 'error' when p_size * 20000 > 500000 then 'warn' else 'ok' end as flag from part")
def p13_size_flags(spark, sf):
    return table(spark, sf, "part").select("p_partkey", O.size_flag(F.col("p_size") * 20_000).alias("flag"))
