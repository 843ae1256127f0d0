"""Token cost records: prices, spend by period, budgets.

Columns: timestamp, model, provider, input_tokens, output_tokens,
cached_tokens, cost (double), project_id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Budget:
    daily_limit: float
    monthly_limit: float
    warning_percent: float = 80.0
    global_daily_limit: float | None = None
    global_monthly_limit: float | None = None
    premium_daily_limit: float | None = None


def with_cost(df: DataFrame, prices: DataFrame) -> DataFrame:
    """Adds ``cost`` by the prices per million tokens (model, input_price, output_price, cached_price).

    Cached tokens without a price of their own cost as much as input; an
    unknown model costs 0.  The price list is small by nature: the join is
    left to the optimizer, which broadcasts it while it is below its bound.
    """
    fresh = (F.col("input_tokens") - F.col("cached_tokens")) / 1e6 * F.col("input_price")
    cached = F.col("cached_tokens") / 1e6 * F.coalesce("cached_price", "input_price")
    out = F.col("output_tokens") / 1e6 * F.col("output_price")
    return df.join(prices, "model", "left").withColumn("cost", F.coalesce(fresh + cached + out, F.lit(0.0))).drop("input_price", "output_price", "cached_price")


def spend(df: DataFrame) -> DataFrame:
    """Total, by model and by provider in one pass: (model, provider, requests, cost), nulls where summed over."""
    sets = df.groupingSets([["model"], ["provider"], []], "model", "provider")
    return sets.agg(F.count("*").alias("requests"), F.sum("cost").alias("cost"))


def period_spend(df: DataFrame, now: Column, projects: Column, premium: str) -> DataFrame:
    """One row: daily and monthly spend of the project, of all projects, and of the premium model."""
    day, month = F.date_trunc("day", now), F.date_trunc("month", now)
    today = (F.col("timestamp") >= day) & (F.col("timestamp") < day + F.expr("interval 1 day"))
    this_month = (F.col("timestamp") >= month) & (F.col("timestamp") < F.add_months(month, 1))
    total = lambda p: F.coalesce(F.sum(F.when(p, F.col("cost"))), F.lit(0.0))
    best = F.col("model") == premium
    return df.agg(
        total(today & projects).alias("daily"), total(this_month & projects).alias("monthly"), total(today).alias("global_daily"),
        total(this_month).alias("global_monthly"), total(today & best).alias("premium_daily"), total(this_month & best).alias("premium_monthly"),
    )


def budget_status(spent: DataFrame, b: Budget) -> DataFrame:
    """Limits checked on the row of :func:`period_spend`; what remains is never below 0."""
    over = lambda c, limit: F.lit(False) if limit is None else F.col(c) >= limit
    project = over("daily", b.daily_limit) | over("monthly", b.monthly_limit)
    world = over("global_daily", b.global_daily_limit) | over("global_monthly", b.global_monthly_limit)
    used = F.col("monthly") / b.monthly_limit * 100
    return spent.select(
        "*", (project | world).alias("is_over_budget"), world.alias("is_global_over"), over("premium_daily", b.premium_daily_limit).alias("is_premium_over"),
        F.greatest(F.lit(0.0), b.daily_limit - F.col("daily")).alias("daily_remaining"), F.greatest(F.lit(0.0), b.monthly_limit - F.col("monthly")).alias("monthly_remaining"),
        used.alias("percent_used"), (used >= b.warning_percent).alias("is_warning"),
    )


def both_logs(project: DataFrame, everything: DataFrame) -> DataFrame:
    """The two logs one after the other: what is in both counts twice, as the report does."""
    return project.unionByName(everything)


def both_logs_once(project: DataFrame, everything: DataFrame) -> DataFrame:
    """The same with each record once."""
    return both_logs(project, everything).distinct()


def estimate_cost(tokens: Column, input_price: Column, output_price: Column) -> Column:
    """Input and 30 % of it as output."""
    return tokens / 1e6 * input_price + tokens * 0.3 / 1e6 * output_price


def estimate_latency_ms(tokens: Column, base_ms: Column, tokens_per_s: Column) -> Column:
    return base_ms + tokens / tokens_per_s * 1000


def complexity(tokens: Column, text: Column, hard: list[str], easy: list[str]) -> Column:
    """Level by tokens (100, 500, 2000, 5000), raised by hard words and lowered by easy ones."""
    level = F.when(tokens < 100, 1).when(tokens < 500, 2).when(tokens < 2000, 3).when(tokens < 5000, 4).otherwise(5)
    has = lambda words: F.lit(any(())) if not words else F.lower(text).rlike("|".join(words))
    return F.least(F.lit(5), F.greatest(F.lit(1), level + has(hard).cast("int") - has(easy).cast("int")))
