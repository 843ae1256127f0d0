"""Agent task records: statistics, trends, error patterns, health.

Columns: id, agent, category, status ('completed', 'failed', ...), quality,
duration_ms, completed_at, error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .events import rate

#: Words of an error and the advice they lead to, first match first.
FIXES = (
    ("timeout", "Increase timeout or optimize task complexity"),
    ("not found", "Verify file/resource existence before operation"),
    ("permission", "Check file/directory permissions"),
    ("syntax error", "Validate input/code before processing"),
    ("network error", "Add retry logic and error handling"),
)
NO_FIX = "Review error details and add specific handling"


#: Stretches of its order that the records of a key are cut into.
STRETCHES = 64


def running_averages(df: DataFrame, key: str, order: str, values: tuple[str, ...]) -> DataFrame:
    """(key, values): averages kept record by record, where a null leaves the average as it is but still counts.

    A value that came as the i-th record enters with weight 1/i, and each later
    value, as the j-th record, multiplies it by (j - 1)/j.  The records of a
    key are cut into stretches of ``order`` (a number or a time) by a quantile
    sketch; a record's number is its place in the stretch plus the counts of
    the stretches before, and the products of later stretches are put on at
    the end.  So a task sorts a stretch, not a key.
    """
    rows = df.select(key, order, *[F.col(v).cast("double").alias(v) for v in values])
    cuts = rows.groupBy(key).agg(F.percentile_approx(order, [k / STRETCHES for k in range(1, STRETCHES)], 1000).alias("_cuts")).withColumnRenamed(key, "_k")
    rows = rows.join(cuts, F.col(key).eqNullSafe(F.col("_k"))).withColumn("_s", F.size(F.filter(F.coalesce("_cuts", F.array()), lambda c: c < F.col(order)))).drop("_cuts", "_k")
    every = Window.partitionBy(key).orderBy("_s")
    before = rows.groupBy(key, "_s").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(every) - F.col("_n"))
    before = before.select(F.col(key).alias("_k"), F.col("_s").alias("_t"), "_before")
    rows = rows.join(before, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_s") == F.col("_t"))).drop("_k", "_t")
    w = Window.partitionBy(key, "_s").orderBy(order)
    rows = rows.withColumn("_i", F.col("_before") + F.row_number().over(w))
    i = F.col("_i")
    fades = {f"_{v}": F.sum(F.when(F.col(v).isNotNull() & (i > 1), F.log((i - 1) / i)).otherwise(F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0)) for v in values}
    parts = [x for v in values for x in (F.sum(F.col(v) / i * F.exp(-F.col(f"_{v}"))).alias(v), F.min(f"_{v}").alias(f"_{v}"))]  # the last running sum is the least
    stretches = rows.withColumns(fades).groupBy(key, "_s").agg(*parts)
    from_here = Window.partitionBy(key).orderBy(F.desc("_s"))
    faded = stretches.withColumns({f"_all_{v}": F.sum(f"_{v}").over(from_here) for v in values})
    return faded.groupBy(key).agg(*[F.coalesce(F.sum(F.col(v) * F.exp(f"_all_{v}")), F.lit(0.0)).alias(v) for v in values])


def agent_stats(df: DataFrame, order: str = "id") -> DataFrame:
    done, n = F.count_if(F.col("status") == "completed"), F.count("*")
    counts = df.groupBy("agent").agg(
        n.alias("total"), done.alias("successful"), F.count_if(F.col("status") == "failed").alias("failed"), rate(done, n).alias("success_rate"),
        F.coalesce(F.avg("quality"), F.lit(0.0)).alias("true_avg_quality"),
    )
    averages = running_averages(df, "agent", order, ("quality", "duration_ms")).toDF("agent", "avg_quality", "avg_duration_ms")
    return counts.join(averages, "agent").select("agent", "total", "successful", "failed", "success_rate", "avg_quality", "avg_duration_ms", "true_avg_quality")


def health(total: Column, quality: Column, success: Column, q=(90.0, 75.0, 60.0), s=(0.9, 0.75, 0.5)) -> Column:
    """excellent, good, fair or poor; unknown below three tasks."""
    met = [(quality >= a) & (success >= b) for a, b in zip(q, s)]
    return F.when(total < 3, "unknown").when(met[0], "excellent").when(met[1], "good").when(met[2], "fair").otherwise("poor")


def needs_attention(stats: DataFrame, least_rate: float = 0.5) -> DataFrame:
    return stats.where(F.col("health").isin("poor", "fair") | (F.col("success_rate") < least_rate))


def system_stats(stats: DataFrame) -> DataFrame:
    """One row over all agents; quality is the mean of the positive ones."""
    good = F.avg(F.when(F.col("avg_quality") > 0, F.col("avg_quality")))
    return stats.agg(F.count("*").alias("agents"), F.sum("total").alias("tasks"), rate(F.sum("successful"), F.sum("total")).alias("success_rate"), F.coalesce(good, F.lit(0.0)).alias("avg_quality"))


def top_performers(stats: DataFrame, n: int = 5) -> DataFrame:
    return stats.orderBy(F.desc("success_rate"), "agent").limit(n).select("agent", "success_rate", "total")


def daily_trend(df: DataFrame, last_day: str, days: int = 30) -> DataFrame:
    """A row for each of the last ``days`` days, zeros where nothing was done."""
    spark = df.sparkSession
    end = F.lit(last_day).cast("date")
    calendar = spark.range(1).select(F.explode(F.sequence(F.date_sub(end, days - 1), end)).alias("day"))
    per_day = df.groupBy(F.to_date("completed_at").alias("day")).agg(F.count("*").alias("tasks"), F.count_if(F.col("status") == "completed").alias("done"), F.avg("quality").alias("q"))
    zero = lambda c, z: F.coalesce(c, F.lit(z))
    return calendar.join(per_day, "day", "left").select("day", zero("tasks", 0).alias("tasks"), zero("done", 0).alias("successful"), zero("q", 0.0).alias("avg_quality"))


def normalize_error(error: Column) -> Column:
    """Paths, line numbers and numbers become placeholders; 100 characters at most."""
    out = F.regexp_replace(error, r"/[^\s]+", "<path>")
    out = F.regexp_replace(out, r"(?i)line [0-9]+", "line <N>")
    return F.substring(F.regexp_replace(out, r"[0-9]+", "<N>"), 1, 100)


def suggested_fix(pattern: Column) -> Column:
    out = F.lit(NO_FIX)
    for word, fix in reversed(FIXES):
        out = F.when(F.contains(F.lower(pattern), F.lit(word)), fix).otherwise(out)
    return out


def error_patterns(df: DataFrame, n: int = 10) -> DataFrame:
    found = df.where(F.col("error").isNotNull() & (F.col("error") != "")).withColumn("pattern", normalize_error(F.col("error")))
    out = found.groupBy("pattern").agg(F.count("*").alias("count"), F.array_sort(F.collect_set("agent")).alias("agents"), F.max("completed_at").alias("last_seen"))
    return out.orderBy(F.desc("count"), "pattern").limit(n).withColumn("fix", suggested_fix(F.col("pattern")))


def retained(df: DataFrame, now: str, days: int = 90) -> DataFrame:
    """Drops what was completed more than ``days`` before ``now``; what is not completed stays."""
    return df.where(F.col("completed_at").isNull() | (F.col("completed_at") >= F.lit(now).cast("timestamp") - F.expr(f"interval {days} days")))


def specializations(df: DataFrame) -> DataFrame:
    return df.groupBy("agent").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("by_category"))


def export_csv(stats: DataFrame) -> DataFrame:
    """A CSV line per agent without quoting: rates with four decimals, means with two."""
    return stats.select("agent", F.concat_ws(",", "agent", F.col("total").cast("string"), F.format_string("%.4f", "success_rate"), F.format_string("%.2f", "avg_quality")).alias("line"))


def export_json(stats: DataFrame) -> DataFrame:
    return stats.select("agent", F.to_json(F.struct("agent", "total", "successful")).alias("line"))
