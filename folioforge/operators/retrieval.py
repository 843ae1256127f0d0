"""Memory entries: replay, search scores, summaries; routing of requests to tools."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOUR_MS = 3_600_000
#: Words and patterns of dangerous requests, and what they lead to, in order.
SAFETY = (
    ("deployment", ("deploy", "production", "release", "publish", "rollout"), (r"deploy\s+to\s+prod", r"push\s+to\s+production", r"release\s+v[0-9]"), "require_human"),
    ("destructive", ("delete", "drop", "truncate", "remove", "destroy", "wipe"), (r"drop\s+table", r"delete\s+all", r"rm\s+-rf", r"truncate\s+table"), "require_human"),
    ("secrets", ("secret", "credential", "password", "token", "api_key", "private_key"), (r"rotate\s+(secret|key|token)", r"update\s+credential"), "require_human"),
    ("billing", ("billing", "payment", "invoice", "subscription", "charge"), (r"cancel\s+subscription", r"change\s+plan", r"update\s+billing"), "require_human"),
    ("access_control", ("permission", "role", "access", "admin", "sudo", "root"), (r"grant\s+admin", r"change\s+role", r"elevate\s+privilege"), "require_human"),
    ("automation_abuse", ("captcha", "bypass", "scrape", "spam", "flood"), (r"bypass\s+captcha", r"mass\s+scrape", r"automated\s+login"), "deny"),
)
#: Words that are no keywords.
STOP_WORDS = ("the", "and", "for", "are", "but", "not", "you", "all", "can", "had", "her", "was", "one", "our", "out", "with", "this", "that", "from", "they", "have", "been")


def replay(log: DataFrame) -> DataFrame:
    """Latest state of a log of adds, updates and deletes (op, id, entry, timestamp, line_no); later lines win ties."""
    last = log.groupBy("id").agg(F.max_by(F.struct("op", "entry"), F.struct("timestamp", "line_no")).alias("s"))
    return last.where(F.col("s.op") != "delete").select("id", "s.entry")


def alive(expires_at: Column, now: Column) -> Column:
    """No expiry (null or 0), or one that is not past."""
    return expires_at.isNull() | (expires_at == 0) | (expires_at >= now)


def any_tag(tags: Column, wanted: list[str]) -> Column:
    return F.arrays_overlap(F.transform(tags, lambda t: F.lower(t)), F.array(*[F.lit(w.lower()) for w in wanted]))


def query_tokens(text: Column) -> Column:
    """Lower-case words, kana and kanji of at least two characters."""
    clean = F.regexp_replace(F.lower(text), "[^\\w\\s　぀-ゟ゠-ヿ一-龯]", " ")
    return F.filter(F.split(clean, "[\\s　]+"), lambda t: F.length(t) > 1)


def memory_score(tokens: Column, summary: Column, content: Column, tags: Column, created_at: Column, importance: Column, now: Column) -> Column:
    """0.4 summary + 0.25 content + 0.2 tags (parts of the tokens found) + recency + 0.05 importance, at most 1; 0 without tokens."""
    n = F.size(tokens)
    low = F.transform(tokens, lambda t: F.lower(t))
    found = lambda test: F.size(F.filter(low, test)) / n
    s, c = F.lower(summary), F.lower(content)
    score = (
        found(lambda t: F.contains(s, t)) * 0.4 + found(lambda t: F.contains(c, t)) * 0.25
        + found(lambda t: F.exists(tags, lambda g: F.contains(F.lower(g), t))) * 0.2
        + F.greatest(F.lit(0.0), F.lit(0.1) - (now - created_at) / HOUR_MS * 0.001) + F.coalesce(importance, F.lit(0.0)) * 0.05
    )
    return F.when(n > 0, F.least(score, F.lit(1.0))).otherwise(0.0)


def top(df: DataFrame, n: int, score: str = "score", *tie: str) -> DataFrame:
    return df.orderBy(F.desc(score), *tie).limit(n)


def summary_of(text: Column, most: int) -> Column:
    """The first ``most`` characters, cut at the last blank if that lies beyond 80 %, and three dots."""
    head = F.substring(text, 1, most)
    at = F.length(head) - F.locate(" ", F.reverse(head))  # of the last blank, from 0; length if there is none
    cut = F.when((F.locate(" ", head) > 0) & (at > most * 0.8), F.substring(head, F.lit(1), at)).otherwise(head)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(cut, F.lit("...")))


def preview(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def latin_tokens(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9\\s]", " "), "\\s+"), lambda t: F.length(t) > 2)


def tool_score(query: Column, name: Column, description: Column, tags: Column) -> Column:
    """Likeness of a request to a tool: 0.5 tags + 0.35 description + 0.15 name, each way of containing; boosts for exact tags and the name."""
    q = latin_tokens(query)
    n = F.size(q)
    either = lambda words: lambda t: F.exists(words, lambda w: F.contains(w, t) | F.contains(t, w))
    low = F.transform(tags, lambda t: F.lower(t))
    part = lambda words: F.size(F.filter(q, either(words))) / n
    score = part(low) * 0.5 + part(latin_tokens(description)) * 0.35 + part(latin_tokens(name)) * 0.15
    score += F.when(F.exists(q, lambda t: F.array_contains(low, t)), 0.2).otherwise(0.0) + F.when(F.contains(F.lower(query), F.lower(name)), 0.3).otherwise(0.0)
    return F.when(n > 0, F.least(score, F.lit(1.0))).otherwise(0.0)


def match_tools(queries: DataFrame, tools: list[tuple[str, str, list[str]]], threshold: float, most: int, key: str = "id", text: str = "text") -> DataFrame:
    """(key, name, score) of the ``most`` best tools per request at or above ``threshold``; ties by registry order.

    The registry is a short list of the caller's, so it is an array literal: no join and no shuffle.
    """
    registry = F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(n).alias("name"), tool_score(F.col(text), F.lit(n), F.lit(d), F.array(*map(F.lit, t))).alias("score")) for k, (n, d, t) in enumerate(tools)])
    good = F.filter(registry, lambda t: t["score"] >= threshold)
    ranked = F.slice(F.array_sort(good, lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).otherwise(a["ord"] - b["ord"])), 1, most)
    return queries.select(key, F.inline(ranked)).drop("ord")


def safety(text: Column) -> tuple[Column, Column]:
    """(category, action) of the first rule that denies, else of the first that matches; nulls without one."""
    hit = {}
    for name, words, patterns, action in SAFETY:
        hit[name] = (reduce(lambda a, b: a | b, [F.contains(F.lower(text), F.lit(w)) for w in words]) | text.rlike("(?i)" + "|".join(patterns)), action)
    ordered = sorted(hit.items(), key=lambda kv: kv[1][1] != "deny")
    category = action = F.lit(None).cast("string")
    for name, (test, act) in reversed(ordered):
        category, action = F.when(test, name).otherwise(category), F.when(test, act).otherwise(action)
    return category, action


def route(category: Column, action: Column, best: Column, threshold: float = 0.3) -> Column:
    """Denied or sent to a person by safety rules; else allowed if a tool fits, else left to a fallback."""
    return F.when(category.isNotNull(), action).when(best >= threshold, "allow").otherwise("fallback")


def keywords(df: DataFrame, key: str, text: str, most: int = 10) -> DataFrame:
    """The most frequent words of each text, stop words left out; ties by word."""
    # whole texts are dealt out by key, so that the words, of which there are many more, are counted and ranked where they are
    words = df.select(key, text).repartition(key).select(key, F.explode(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " ")).alias("word")).where((F.length("word") > 2) & ~F.col("word").isin(*STOP_WORDS))
    counted = words.groupBy(key, "word").agg(F.count("*").alias("n"))
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col("word")))), 1, most)
    return counted.groupBy(key).agg(F.transform(best, lambda x: x["word"]).alias("keywords"))


def sections(df: DataFrame, key: str, text: str, least: int = 10) -> DataFrame:
    """(key, name, body) of ``##`` sections; of one name the last wins; bodies shorter than ``least`` are left out."""
    from pyspark.sql import Window

    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    head = F.regexp_extract("line", "^##\\s+(.+)$", 1)
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("head", head).withColumn("sec", F.sum((F.col("head") != "").cast("int")).over(w)).where("sec > 0")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("head") == "", F.struct("pos", "line")))), lambda x: x["line"]), "\n")
    one = lines.groupBy(key, "sec").agg(F.max("head").alias("name"), body.alias("body")).where(F.length("body") >= least)
    return one.groupBy(key, "name").agg(F.max_by("body", "sec").alias("body"))
