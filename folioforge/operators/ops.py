"""Small operators of the operations side: schedules, reuse, lookups, messages, tallies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .leads import fill_template, truncated

#: Characters of a message by channel at most, and of texts by size class.
CHANNEL_LIMITS = {"email": 2000, "line": 500, "sms": 160}
SIZES = (("small", 100), ("medium", 500), ("large", 2000))
PLACEHOLDERS = ("name", "company", "position", "industry", "region", "sender")


def due(now: Column, hour: Column, minute: Column, weekday: Column) -> Column:
    """Whether a schedule is due at ``now``: its hour and minute, and its weekday (0 is Sunday) unless that is null."""
    return (F.hour(now) == hour) & (F.minute(now) == minute) & (weekday.isNull() | (F.dayofweek(now) - 1 == weekday))


def reusable(inputs: DataFrame, artifacts: DataFrame, key: str, content: str) -> DataFrame:
    """(key, reusable): whether a validated artifact of the very content stands under the key; ``artifacts`` has (key, sha256, validated)."""
    own = inputs.select(key, F.sha2(F.col(content).cast("binary"), 256).alias("_own"))
    there = artifacts.groupBy(F.col(key).alias("_key"), "sha256").agg(F.bool_or("validated").alias("_validated"))
    joined = own.join(there, (F.col(key) == F.col("_key")) & (F.col("_own") == F.col("sha256")), "left")
    return joined.select(key, F.coalesce("_validated", F.lit(False)).alias("reusable"))


def rule_lookup(df: DataFrame, rules: DataFrame, keys: list[str], value: str, default: Column | None = None) -> DataFrame:
    """Adds ``value`` from ``rules`` (keys, value; one row a key) by equal keys, or the default."""
    renamed = rules.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(value).alias("_value"))
    on = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_{k}") for k in keys])
    out = df.join(renamed, on, "left")
    return out.withColumn(value, F.coalesce("_value", default) if default is not None else F.col("_value")).drop("_value", *[f"_{k}" for k in keys])


def localized(df: DataFrame, templates: DataFrame, key: str, locale: str, params: dict[str, Column], fallback: str = "en") -> DataFrame:
    """Adds ``message``: the template (locale, key, template) of the row's locale, else of ``fallback``, else the key itself, with its parameters put in."""
    own = templates.select(F.col("locale").alias("_l"), F.col("key").alias("_k"), F.col("template").alias("_own"))
    other = templates.where(F.col("locale") == fallback).select(F.col("key").alias("_k2"), F.col("template").alias("_other"))
    joined = df.join(own, (F.col(locale) == F.col("_l")) & (F.col(key) == F.col("_k")), "left").join(other, F.col(key) == F.col("_k2"), "left")
    return joined.withColumn("message", fill_template(F.coalesce("_own", "_other", key), params)).drop("_l", "_k", "_own", "_k2", "_other")


def composed_messages(leads: DataFrame, templates: DataFrame, rank: str = "rank", channel: str = "channel") -> DataFrame:
    """Adds subject and body from the template (rank, channel, subject, body) of the lead's rank and channel.

    Placeholders are filled from the columns of their names; a body has the
    length of its channel at most; only e-mail has a subject.
    """
    given = {p: F.col(p) for p in PLACEHOLDERS if p in leads.columns}
    mine = templates.select(F.col(rank).alias("_r"), F.col(channel).alias("_c"), F.col("subject").alias("_subject"), F.col("body").alias("_body"))
    out = leads.join(mine, (F.col(rank) == F.col("_r")) & (F.col(channel) == F.col("_c")), "left")
    body = fill_template(F.col("_body"), given)
    for name, limit in CHANNEL_LIMITS.items():
        body = F.when(F.col(channel) == name, truncated(fill_template(F.col("_body"), given), limit)).otherwise(body)
    subject = F.when(F.col(channel) == "email", fill_template(F.col("_subject"), given))
    return out.withColumns({"subject": subject, "body": body}).drop("_r", "_c", "_subject", "_body")


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(text) * 0.25)


def size_class(text: Column) -> Column:
    return reduce(lambda out, s: F.when(F.length(text) < s[1], s[0]).otherwise(out), reversed(SIZES), F.lit("huge"))


def corrected_label(was_blocked: Column, was_wrong: Column) -> Column:
    """What a record should have been: high if rightly blocked, medium if wrongly, else low."""
    return F.when(was_blocked & ~was_wrong, "high").when(was_wrong, "medium").otherwise("low")


def cache_key(*parts: Column) -> Column:
    """Parts in order, joined; nulls are left out."""
    return F.array_join(F.array_sort(F.array_compact(F.array(*parts))), "|")


def labels(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Names of all (name, pattern) rules that fit, in order."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), n) for n, p in rules]))


def branch(text: Column, pattern: str, branches: dict[str, str], default: str | None = None) -> Column:
    """The branch of the first group that a pattern finds in the trimmed text; the default, or an error, where none is of that value."""
    value = F.regexp_extract(F.trim(text), pattern, 1)
    found = F.try_element_at(F.create_map(*[F.lit(x) for pair in branches.items() for x in pair]), value)
    missing = F.lit(default) if default is not None else F.raise_error(F.concat(F.lit("no branch for "), value)).cast("string")
    return F.coalesce(found, missing)


def recent_rate(df: DataFrame, flag: str, *order: Column, n: int = 100) -> DataFrame:
    """(n, rate) of a 0/1 flag over the last ``n`` rows; a rate of 0 where there are none."""
    return df.orderBy(*order).limit(n).agg(F.count("*").alias("n"), F.coalesce(F.avg(flag), F.lit(0.0)).alias("rate"))


def is_picture(width: Column, height: Column, least: int = 20) -> Column:
    """Whether an image is more than a rule or an ornament."""
    return (width >= least) & (height >= least)


def size_flag(kb: Column, warn: int = 500_000, most: int = 650_000) -> Column:
    return F.when(kb > most, "error").when(kb > warn, "warn").otherwise("ok")


def conversion_counts(conversions: DataFrame) -> DataFrame:
    """(status, n, deleted) of stored conversions."""
    return conversions.groupBy("status").agg(F.count("*").alias("n"), F.count("deleted_at").alias("deleted"))


def owned(rows: DataFrame, owners: DataFrame, row_key: str, owner_key: str) -> DataFrame:
    """Rows with the columns of their owner; rows of other owners go."""
    return rows.join(owners, F.col(row_key) == F.col(owner_key))


def stage_benchmark(df: DataFrame, stage: str, seconds: str, chapter: str) -> DataFrame:
    """(stage, avg_s, min_s, ms_per_chapter)."""
    return df.groupBy(stage).agg(F.avg(seconds).alias("avg_s"), F.min(seconds).alias("min_s"), (F.sum(seconds) * 1000 / F.countDistinct(chapter)).alias("ms_per_chapter"))


def state_summary(df: DataFrame, state: str, states: tuple[str, ...] = ("open", "half_open", "closed")) -> DataFrame:
    """(total, a count for each state)."""
    return df.agg(F.count("*").alias("total"), *[F.count_if(F.col(state) == s).alias(s) for s in states])


def batch_tally(df: DataFrame, failed: Column, kb: str) -> DataFrame:
    """(status, files, kb) of a batch conversion."""
    return df.groupBy(F.when(failed, "ng").otherwise("ok").alias("status")).agg(F.count("*").alias("files"), F.sum(kb).alias("kb"))


def plan_risk(steps: DataFrame, plan: str, risk: str, order: tuple[str, ...] = ("low", "medium", "high")) -> DataFrame:
    """(plan, plan_risk): the worst of a plan's steps."""
    rank = reduce(lambda out, p: F.when(F.col(risk) == p[1], p[0]).otherwise(out), enumerate(order), F.lit(0))
    worst = steps.groupBy(plan).agg(F.max(rank).alias("_r"))
    return worst.select(plan, F.element_at(F.array(*map(F.lit, order)), F.col("_r") + 1).alias("plan_risk"))


def first_best(scores: dict[str, Column], default: str) -> Column:
    """The first name, in order, that has the greatest score; the default if that is 0."""
    best = F.greatest(*scores.values())
    out = reduce(lambda o, p: F.when(p[1] == best, p[0]).otherwise(o), reversed(list(scores.items())), F.lit(default))
    return F.when(best == 0, default).otherwise(out)
