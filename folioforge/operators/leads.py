"""Leads: search, scoring, channels, sequences, messages and funnels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What scores in each dimension.
INDUSTRIES = ("IT", "SaaS", "マーケティング", "コンサルティング", "不動産", "金融")
POSITIONS = ("代表取締役", "CEO", "CTO", "COO", "CFO", "取締役", "部長", "本部長", "事業部長", "VP")
SIZES = ("medium", "large", "enterprise")
REGIONS = ("東京", "大阪", "名古屋", "福岡", "横浜", "関東", "関西")
SIGNAL_POINTS = {
    "behavioral": {"downloaded": 20, "seminar": 25, "demo": 35},
    "engagement": {"opened": 15, "line_responded": 20, "replied": 30, "meeting": 35},
    "intent": {"pricing": 30, "materials": 25, "inquiry": 35, "comparison": 20},
}
WEIGHTS = {"demographic": 0.20, "behavioral": 0.35, "engagement": 0.25, "intent": 0.20}
RANKS = (("HOT", 80), ("WARM", 50), ("COLD", 20))
STAGES = ("discovery", "qualification", "proposal", "negotiation", "closed_won", "closed_lost")
#: Fixed values: (channel, hours of delay, template) of each step by rank.
SEQUENCES = {
    "HOT": (("line", 0, "immediate_line_hot"), ("voice", 1, "followup_call_hot"), ("email", 24, "summary_email_hot")),
    "WARM": (("line", 0, "initial_line_warm"), ("email", 72, "followup_email_warm"), ("sms", 72, "reminder_sms_warm")),
    "COLD": (("email", 0, "nurture_email_cold_1"), ("email", 168, "nurture_email_cold_2"), ("email", 168, "nurture_email_cold_3")),
    "DISQUALIFIED": (("email", 720, "reactivation_email"),),
}


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def points(test: Column, n: int) -> Column:
    return F.when(test, n).otherwise(0)


def search(df: DataFrame, contains: dict[str, str] | None = None, contains_exact: dict[str, str] | None = None, equal: dict[str, str] | None = None, tags: list[str] | None = None, min_score: int | None = None, max_score: int | None = None) -> DataFrame:
    """AND of optional predicates: contains (without case), contains_exact, equality, all tags, score range; empty ones do not count."""
    tests = [F.contains(F.lower(c), F.lit(v.lower())) for c, v in (contains or {}).items() if v]
    tests += [F.contains(F.col(c), F.lit(v)) for c, v in (contains_exact or {}).items() if v]
    tests += [F.col(c) == v for c, v in (equal or {}).items() if v]
    if tags:
        tests.append(F.forall(F.array(*map(F.lit, tags)), lambda t: F.array_contains(F.col("tags"), t)))
    if min_score is not None:
        tests.append(F.col("score") >= min_score)
    if max_score is not None:
        tests.append(F.col("score") <= max_score)
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def rank_of(score: Column) -> Column:
    out = F.lit("DISQUALIFIED")
    for name, least in reversed(RANKS):
        out = F.when(score >= least, name).otherwise(out)
    return out


def score(leads: DataFrame, signals: DataFrame) -> DataFrame:
    """(lead_id, four dimensions capped at 100, total_score, rank); leads without signals score on who they are.

    A page view counts 10 points by its rule and again 10 a page up to 50.
    """
    df = leads.join(signals, "lead_id", "left")
    some = lambda values, test: reduce(lambda a, b: a | b, map(test, values))
    demographic = (
        points(some(INDUSTRIES, lambda v: F.contains(F.lower("industry"), F.lit(v.lower()))), 30)
        + points(some(POSITIONS, lambda v: F.contains(F.col("position"), F.lit(v))), 25)
        + points(F.col("company_size").isin(*SIZES), 20) + points(some(REGIONS, lambda v: F.contains(F.col("region"), F.lit(v))), 15)
    )
    pages = F.coalesce("pages_viewed", F.lit(0))
    sums = {d: reduce(lambda a, b: a + b, [points(F.col(s), n) for s, n in p.items()]) for d, p in SIGNAL_POINTS.items()}
    sums["behavioral"] = sums["behavioral"] + points(pages > 0, 10) + F.when(pages > 0, F.least(pages * 10, F.lit(50))).otherwise(0)
    sums = {"demographic": demographic, **sums}
    df = df.select("lead_id", *[F.least(v, F.lit(100)).alias(d) for d, v in sums.items()])
    total = round_half_up(reduce(lambda a, b: a + b, [F.col(d) * w for d, w in WEIGHTS.items()])).cast("int")
    return df.withColumn("total_score", total).withColumn("rank", rank_of(F.col("total_score")))


def rank_summary(scored: DataFrame) -> DataFrame:
    return scored.agg(*[F.count_if(F.col("rank") == r).alias(r.lower()) for r in (*[n for n, _ in RANKS], "DISQUALIFIED")])


def channel(rank: Column, line_id: Column, phone: Column, email: Column) -> Column:
    """The first channel of the rank's rule that the lead can be reached by."""
    has = lambda c: c.isNotNull() & (c != "")
    return (
        F.when(rank.isin("HOT", "WARM") & has(line_id), "line")
        .when((rank == "HOT") & has(phone), "voice")
        .when((rank == "WARM") & has(email), "email")
        .otherwise("email")
    )


def sequence_steps(df: DataFrame, rank: str = "rank") -> DataFrame:
    """A row per step of the rank's sequence: adds step, channel, delay_hours, template."""
    steps = F.create_map(*[x for r, s in SEQUENCES.items() for x in (F.lit(r), F.array(*[F.struct(F.lit(k + 1).alias("step"), F.lit(c).alias("channel"), F.lit(h).alias("delay_hours"), F.lit(t).alias("template")) for k, (c, h, t) in enumerate(s)]))])
    return df.select("*", F.inline(F.element_at(steps, F.col(rank))))


def advance(steps: Column) -> Column:
    """The first pending step becomes sent."""
    first = F.array_position(F.transform(steps, lambda s: s["status"]), "pending")
    return F.transform(steps, lambda s, i: s.withField("status", F.when(i + 1 == first, "sent").otherwise(s["status"])))


def funnel(leads: DataFrame, messages: DataFrame, followups: DataFrame) -> DataFrame:
    """One row: leads by stage, conversion, replied over sent messages, and follow-up completion, to two places.

    The second ratio goes by the name avg_response_time, which it is not.
    """
    ratio = lambda a, b: F.when(b > 0, round_half_up(a / b * 100) / 100).otherwise(0.0)
    stage = {s: F.count_if(F.col("pipeline_stage") == s) for s in STAGES}
    a = leads.agg(F.count("*").alias("total_leads"), *[v.alias(s) for s, v in stage.items()], ratio(stage["closed_won"], stage["closed_won"] + stage["closed_lost"]).alias("conversion_rate"))
    b = messages.agg(ratio(F.count_if(F.col("status") == "replied"), F.count("sent_at")).alias("avg_response_time"))
    c = followups.agg(ratio(F.count_if(F.col("status") == "sent"), F.count("*")).alias("followup_completion_rate"))
    return a.join(b, F.lit(True)).join(c, F.lit(True))  # single rows


def channel_metrics(messages: DataFrame) -> DataFrame:
    """Sent, delivered, opened and replied by channel; each status counts for those before it."""
    s = F.col("status")
    sent, opened, replied = F.count_if(~s.isin("draft", "scheduled")), F.count_if(s.isin("opened", "clicked", "replied")), F.count_if(s == "replied")
    ratio = lambda x: F.when(sent > 0, round_half_up(x / sent * 100) / 100).otherwise(0.0)
    return messages.groupBy("channel").agg(sent.alias("sent"), F.count_if(s.isin("delivered", "opened", "clicked", "replied")).alias("delivered"), opened.alias("opened"), replied.alias("replied"), ratio(opened).alias("open_rate"), ratio(replied).alias("reply_rate"))


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return template


def truncated(text: Column, limit: int) -> Column:
    """At most ``limit`` characters; what is cut ends in three dots."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def import_rows(df: DataFrame) -> DataFrame:
    """Leads from raw rows: defaults, tags split at commas and trimmed, score 0, COLD, discovery."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    tags = F.filter(F.transform(F.split(F.coalesce("tags", F.lit("")), ","), lambda t: F.trim(t)), lambda t: t != "")
    return df.select("lead_id", text("name"), text("company"), tags.alias("tags"), F.lit(0).alias("score"), F.lit("COLD").alias("rank"), F.lit("discovery").alias("pipeline_stage"))
