"""Queries over leads derived from customers."""

from pyspark.sql import functions as F

from ..operators import leads as L
from ..operators.ops import CHANNEL_LIMITS, composed_messages
from .registry import derived, query

LEADS = (
    "select c_custkey as lead_id, c_name as name, case c_custkey % 6 when 0 then 'SaaS' when 1 then '金融・保険' when 2 then 'retail' when 3 then 'it services' else c_mktsegment end as industry, "
    "case c_custkey % 5 when 0 then 'CEO' when 1 then '営業部長' when 2 then 'staff' end as position, case c_custkey % 4 when 0 then 'small' when 1 then 'medium' when 2 then 'large' else 'enterprise' end as company_size, "
    "case c_custkey % 3 when 0 then '東京都' when 1 then '札幌' else '関西' end as region, case when c_custkey % 3 = 0 then concat('U', cast(c_custkey as string)) end as line_id, "
    "case when c_custkey % 2 = 0 then '090' end as phone, case when c_custkey % 7 <> 0 then concat(lower(c_name), '@example.com') end as email, "
    "case c_custkey % 6 when 0 then 'discovery' when 1 then 'qualification' when 2 then 'proposal' when 3 then 'negotiation' when 4 then 'closed_won' else 'closed_lost' end as pipeline_stage, "
    "cast(c_custkey % 101 as int) as score, c_mktsegment as company from customer"
)
SIGNALS = (
    "select c_custkey as lead_id, cast(c_custkey % 9 as int) as pages_viewed, c_custkey % 2 = 0 as downloaded, c_custkey % 3 = 0 as seminar, c_custkey % 5 = 0 as demo, c_custkey % 2 = 1 as opened, "
    "c_custkey % 7 = 0 as line_responded, c_custkey % 4 = 0 as replied, c_custkey % 11 = 0 as meeting, c_custkey % 3 = 1 as pricing, c_custkey % 5 = 1 as materials, c_custkey % 6 = 1 as inquiry, c_custkey % 8 = 1 as comparison "
    "from customer where c_custkey % 10 <> 0"
)
MESSAGES = (
    "select o_orderkey as id, case o_custkey % 4 when 0 then 'line' when 1 then 'email' when 2 then 'sms' else 'voice' end as channel, case o_orderkey % 8 when 0 then 'draft' when 1 then 'scheduled' when 2 then 'sent' when 3 then 'delivered' "
    "when 4 then 'opened' when 5 then 'clicked' when 6 then 'replied' else 'failed' end as status, case when o_orderkey % 8 > 1 then o_orderdate end as sent_at from orders"
)


def leads(spark, sf):
    return derived(spark, sf, LEADS, "customer")


def signals(spark, sf):
    return derived(spark, sf, SIGNALS, "customer")


def messages(spark, sf):
    return derived(spark, sf, MESSAGES, "orders")


def any_of(column, values, lower=False):
    return "(" + " or ".join(f"contains({f'lower({column})' if lower else column}, '{v.lower() if lower else v}')" for v in values) + ")"


P = "coalesce(pages_viewed, 0)"
PTS = {d: " + ".join(f"case when {s} then {n} else 0 end" for s, n in p.items()) for d, p in L.SIGNAL_POINTS.items()}
SCORED = f"""with leads as ({LEADS}), signals as ({SIGNALS}), d as (select lead_id, case when {any_of('industry', L.INDUSTRIES, True)} then 30 else 0 end + case when {any_of('position', L.POSITIONS)} then 25 else 0 end
  + case when company_size in ('medium', 'large', 'enterprise') then 20 else 0 end + case when {any_of('region', L.REGIONS)} then 15 else 0 end as demographic,
  least(100, {PTS['behavioral']} + case when {P} > 0 then 10 + least({P} * 10, 50) else 0 end) as behavioral, least(100, {PTS['engagement']}) as engagement, least(100, {PTS['intent']}) as intent from leads left join signals using (lead_id)),
  t as (select *, cast(floor(demographic * 0.2::double + behavioral * 0.35::double + engagement * 0.25::double + intent * 0.2::double + 0.5) as int) as total_score from d),
  scored as (select *, case when total_score >= 80 then 'HOT' when total_score >= 50 then 'WARM' when total_score >= 20 then 'COLD' else 'DISQUALIFIED' end as rank from t)"""


def scored(spark, sf):
    return L.score(leads(spark, sf), signals(spark, sf))


@query(f"{SCORED} select * from scored")
def g9_lead_score(spark, sf):
    return scored(spark, sf)


@query(f"{SCORED} select lead_id, total_score from scored where lead_id in (select lead_id from signals)")
def j3_scores_with_signals(spark, sf):
    return scored(spark, sf).join(signals(spark, sf), "lead_id", "left_semi").select("lead_id", "total_score")


@query(f"{SCORED} select lead_id, rank from scored where lead_id in (select o_custkey from orders where o_orderkey < 200)")
def j4_requested_leads(spark, sf):
    asked = derived(spark, sf, "select o_custkey as lead_id from orders where o_orderkey < 200", "orders")
    return scored(spark, sf).join(asked, "lead_id", "left_semi").select("lead_id", "rank")


@query(f"{SCORED} select count(*) filter (rank = 'HOT') as hot, count(*) filter (rank = 'WARM') as warm, count(*) filter (rank = 'COLD') as cold, count(*) filter (rank = 'DISQUALIFIED') as disqualified from scored")
def a14_rank_summary(spark, sf):
    return L.rank_summary(scored(spark, sf))


@query(f"""{SCORED} select lead_id, case when rank in ('HOT', 'WARM') and line_id is not null then 'line' when rank = 'HOT' and phone is not null then 'voice' else 'email' end as channel from scored join leads using (lead_id)""")
def g10_channel(spark, sf):
    both = scored(spark, sf).join(leads(spark, sf), "lead_id")
    return both.select("lead_id", L.channel(F.col("rank"), F.col("line_id"), F.col("phone"), F.col("email")).alias("channel"))


STEPS = " union all ".join(f"select '{r}' as rank, {k + 1} as step, '{c}' as channel, {h} as delay_hours, '{t}' as template" for r, s in L.SEQUENCES.items() for k, (c, h, t) in enumerate(s))


@query(f"{SCORED}, steps as ({STEPS}) select lead_id, step, channel, delay_hours, template from scored join steps using (rank)")
def g11_sequence_steps(spark, sf):
    return L.sequence_steps(scored(spark, sf)).select("lead_id", "step", "channel", "delay_hours", "template")


@query(f"""with leads as ({LEADS}), m as ({MESSAGES}), a as (select count(*) as total_leads, {', '.join(f"count(*) filter (pipeline_stage = '{s}') as {s}" for s in L.STAGES)} from leads),
  b as (select floor(count(*) filter (status = 'replied') / count(sent_at) * 100 + 0.5) / 100 as avg_response_time, floor(count(*) filter (status = 'sent') / count(*) * 100 + 0.5) / 100 as followup_completion_rate from m)
  select *, floor(closed_won / (closed_won + closed_lost) * 100 + 0.5) / 100 as conversion_rate from a, b""")
def a12_funnel(spark, sf):
    return L.funnel(leads(spark, sf), messages(spark, sf), messages(spark, sf))


@query(f"""with m as ({MESSAGES}), c as (select channel, count(*) filter (status not in ('draft', 'scheduled')) as sent, count(*) filter (status in ('delivered', 'opened', 'clicked', 'replied')) as delivered,
  count(*) filter (status in ('opened', 'clicked', 'replied')) as opened, count(*) filter (status = 'replied') as replied from m group by 1) select *, floor(opened / sent * 100 + 0.5) / 100 as open_rate, floor(replied / sent * 100 + 0.5) / 100 as reply_rate from c""")
def a13_channel_metrics(spark, sf):
    return L.channel_metrics(messages(spark, sf))


@query(f"""with leads as ({LEADS}) select lead_id from leads where contains(lower(name), 'customer') and contains(lower(industry), 'it') and contains(region, '東') and company_size = 'enterprise' and score >= 20 and score <= 90""")
def p4_lead_search(spark, sf):
    found = L.search(leads(spark, sf), {"name": "Customer", "industry": "IT"}, {"region": "東"}, {"company_size": "enterprise"}, None, 20, 90)
    return found.select("lead_id")


@query(f"""with leads as ({LEADS}), t as (select lead_id, concat('Hello ', name, ' of ', company, ': ', industry, '! ', repeat('x', 30)) as m from leads) select lead_id, case when length(m) > 70 then concat(substring(m, 1, 67), '...') else m end as message from t""")
def g48_message(spark, sf):
    text = L.fill_template(F.concat(F.lit("Hello {name} of {company}: {industry}! "), F.repeat(F.lit("x"), F.lit(30))), {c: F.col(c) for c in ("name", "company", "industry")})
    return leads(spark, sf).select("lead_id", L.truncated(text, 70).alias("message"))


RAW = "select c_custkey as lead_id, case when c_custkey % 3 = 0 then null else c_name end as name, c_mktsegment as company, case when c_custkey % 2 = 0 then concat(' a , ', lower(c_mktsegment), ',, b') end as tags from customer"


@query(f"with r as ({RAW}) select lead_id, coalesce(name, '') as name, company, list_filter(list_transform(string_split(coalesce(tags, ''), ','), lambda t: trim(t)), lambda t: t <> '') as tags, 0 as score, 'COLD' as rank, 'discovery' as pipeline_stage from r")
def s23_import_leads(spark, sf):
    return L.import_rows(derived(spark, sf, RAW, "customer"))


@query("select c_custkey as lead_id, case when c_custkey % 3 = 0 then ['sent', 'pending'] when c_custkey % 3 = 1 then ['sent', 'sent'] else ['sent', 'sent'] end as statuses from customer")
def w22_advance_sequence(spark, sf):
    base = derived(spark, sf, "select c_custkey as lead_id, c_custkey % 3 as k from customer", "customer")
    step = lambda sent: F.struct(F.when(sent, "sent").otherwise("pending").alias("status"))
    steps = F.array(step(F.col("k") >= 1), step(F.col("k") >= 2))
    return base.select("lead_id", F.transform(L.advance(steps), lambda s: s["status"]).alias("statuses"))


LETTERS = [("HOT", "email", "For {company}", "Dear {name} of {company}, {industry} " + "x" * 1990), ("HOT", "line", "no", "Hi {name} " + "y" * 490), ("COLD", "sms", "", "{name}, {region}? {unknown} " + "z" * 140)]
RANKED = "select lead_id, name, company, industry, region, case lead_id % 3 when 0 then 'HOT' when 1 then 'COLD' else 'WARM' end as rank, case lead_id % 4 when 0 then 'email' when 1 then 'sms' when 2 then 'line' else 'fax' end as channel from leads"
_fill = lambda t: f"replace(replace(replace(replace('{t}', '{{name}}', coalesce(name, '')), '{{company}}', coalesce(company, '')), '{{industry}}', coalesce(industry, '')), '{{region}}', coalesce(region, ''))"
_cut = lambda t, n: f"case when length({_fill(t)}) > {n} then concat(substring({_fill(t)}, 1, {n - 3}), '...') else {_fill(t)} end"


@query(f"""with leads as ({LEADS}), r as ({RANKED}) select lead_id, case when rank = 'HOT' and channel = 'email' then {_fill(LETTERS[0][2])} end as subject,
  case {" ".join(f"when rank = '{k}' and channel = '{c}' then {_cut(b, CHANNEL_LIMITS[c])}" for k, c, _, b in LETTERS)} end as body from r""")
def g48_composed_messages(spark, sf):
    """Messages by rank and channel, at the length of the channel; only e-mail has a subject."""
    ranked = spark.sql(RANKED.replace("from leads", "from {leads}"), leads=leads(spark, sf))
    return composed_messages(ranked, spark.createDataFrame(LETTERS, "rank string, channel string, subject string, body string")).select("lead_id", "subject", "body")
