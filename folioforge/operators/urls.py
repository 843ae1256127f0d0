"""URL lists: parsing, normalising, bundling; links and page summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query parameters that only track.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "fbclid", "gclid", "ref", "source")


def parse_url_list(text: Column) -> Column:
    """URLs of a JSON array, an object with urls, tabs or links, or lines and commas."""
    t = F.regexp_replace(text, "^[\\s　]+|[\\s　]+$", "")
    objects = "array<struct<url:string,href:string>>"
    from_objects = lambda a: F.transform(a, lambda o: F.coalesce(o["url"], o["href"]))
    whole = F.from_json(t, "struct<urls:array<string>,tabs:" + objects + ",links:" + objects + ">")
    array = F.when(t.rlike('^\\[\\s*"'), F.from_json(t, "array<string>")).otherwise(from_objects(F.from_json(t, objects)))
    parsed = F.when(F.startswith(t, F.lit("[")), array).when(F.startswith(t, F.lit("{")), F.coalesce(whole["urls"], from_objects(whole["tabs"]), from_objects(whole["links"])))
    plain = F.transform(F.split(t, "[\n,]+"), lambda u: F.trim(u))
    return F.filter(F.coalesce(parsed, plain), lambda u: u.isNotNull() & (u != ""))


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(F.trim(url), F.lit("HOST")))


def normalize_url(url: Column) -> Column:
    """Lower-case scheme and host, no tracking parameters, no slash at the end of a path; null if it is no URL."""
    u = F.trim(url)
    part = lambda p: F.try_parse_url(u, F.lit(p))
    path = F.coalesce(part("PATH"), F.lit(""))
    path = F.when(path == "", "/").when((path != "/") & F.endswith(path, F.lit("/")), F.substring(path, F.lit(1), F.length(path) - 1)).otherwise(path)
    tracked = F.array(*map(F.lit, TRACKING))
    kept = F.array_join(F.filter(F.split(F.coalesce(part("QUERY"), F.lit("")), "&"), lambda q: (q != "") & ~F.array_contains(tracked, F.substring_index(q, "=", 1))), "&")
    fragment = part("REF")
    out = F.concat(F.lower(part("PROTOCOL")), F.lit("://"), F.lower(part("HOST")), path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""), F.when(fragment.isNotNull(), F.concat(F.lit("#"), fragment)).otherwise(""))
    return F.when(part("HOST").isNotNull() & part("PROTOCOL").isNotNull(), out)


def bundle(df: DataFrame, url: str, order: str, most: int | None = None) -> DataFrame:
    """(order, url, domain): the first row of each normalised URL, in order, ``most`` at most; invalid ones are left out."""
    n = df.select(order, normalize_url(F.col(url)).alias("url")).where("url is not null")
    first = n.groupBy("url").agg(F.min(order).alias(order)).withColumn("domain", host(F.col("url")))
    return first.orderBy(order).limit(most) if most else first


def domain_counts(bundled: DataFrame, n: int = 10) -> DataFrame:
    return bundled.groupBy("domain").agg(F.count("*").alias("urls")).orderBy(F.desc("urls"), "domain").limit(n)


def domain_filter(url: Column, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), patterns: tuple[str, ...] = ()) -> Column:
    """Host contains one of ``include`` and none of ``exclude``; a URL without a host fails includes and passes excludes."""
    h = host(url)
    some = lambda words: reduce(lambda a, b: a | b, [F.contains(h, F.lit(w)) for w in words])
    out = F.coalesce(some(include), F.lit(False)) if include else F.lit(True)
    if exclude:
        out &= ~F.coalesce(some(exclude), F.lit(False))
    for p in patterns:
        out &= ~url.rlike("(?i)" + p)
    return out


def links_of(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit("(?i)<a[^>]+href=[\"']([^\"']+)[\"']"), F.lit(1))


def links_by_side(df: DataFrame, key: str, page_url: str, links: str, most: int = 5) -> DataFrame:
    """(key, internal, external): the first links to the page's own host, and to others; invalid ones are dropped."""
    valid = F.filter(links, lambda x: host(x).isNotNull())
    own = host(F.col(page_url))
    return df.select(key, F.slice(F.filter(valid, lambda x: host(x) == own), 1, most).alias("internal"), F.slice(F.filter(valid, lambda x: host(x) != own), 1, most).alias("external"))


def page_title(html: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1), "^[\\s　]+|[\\s　]+$", "")


def page_author(html: Column) -> Column:
    """The author that a page's meta elements name, whichever attribute comes first; empty where none does."""
    named = F.filter(F.regexp_extract_all(html, F.lit("(?is)<meta\\b[^>]*>"), F.lit(0)), lambda m: m.rlike("(?is)\\sname\\s*=\\s*[\"']?author[\"'\\s/>]"))
    return F.coalesce(F.regexp_extract(F.get(named, 0), "(?is)\\scontent\\s*=\\s*[\"']([^\"'>]*)", 1), F.lit(""))


def page_text(html: Column) -> Column:
    """Text without scripts, styles, navigation, header and footer, blanks collapsed."""
    out = html
    for tag in ("script", "style", "nav", "header", "footer"):
        out = F.regexp_replace(out, f"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    out = F.regexp_replace(F.regexp_replace(out, "<[^>]+>", " "), "[\\s　]+", " ")
    return F.regexp_replace(out, "^ | $", "")


def page_summary(title: Column, url: Column, text: Column, most: int = 300) -> Column:
    return F.concat(title, F.lit(" ("), host(url), F.lit(")\n"), F.substring(F.regexp_replace(text, "[\\s　]+", " "), 1, most))


def latest_per(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``old`` with those of ``new`` in place of theirs: inserts and updates."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def soft_deleted(df: DataFrame, trash: bool, n: int = 20, tie: str = "id") -> DataFrame:
    """Live rows, newest first, or those in the trash by when they went."""
    if trash:
        return df.where("deleted_at is not null").orderBy(F.desc("deleted_at"), tie).limit(n)
    return df.where("deleted_at is null").orderBy(F.desc("created_at"), tie).limit(n)


def merged_config(base: DataFrame, local: DataFrame, overlay: DataFrame) -> DataFrame:
    """(name, url, enabled) with overlay before local before base; unknown names are ignored, empty values do not override."""
    out = base
    for layer in (local, overlay):
        o = layer.select("name", F.col("url").alias("_url"), F.col("enabled").alias("_enabled"))
        out = out.join(o, "name", "left").select("name", F.when(F.coalesce(F.col("_url"), F.lit("")) != "", F.col("_url")).otherwise(F.col("url")).alias("url"), F.coalesce("_enabled", "enabled").alias("enabled"))
    return out
