"""Choosing models, telling dangerous requests, and small parsers of operations notes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a request that call for care; a dot or an underscore in one is optional in the text.
DANGEROUS = (
    "deploy", "production", "release", "publish",
    "delete", "drop", "truncate", "remove", "destroy", "wipe",
    "secret", "credential", "api.key", "api_key", "apikey", "password", "token",
    "billing", "payment", "subscription", "charge", "invoice",
    "role", "admin", "permission", "access.control", "access_control", "privilege",
    "captcha", "bypass", "spam", "brute.force", "brute_force",
)
#: The words that make a request critical or high; any other dangerous word makes it medium.
CRITICAL = ("delete", "drop", "destroy", "wipe", "production", "deploy")
HIGH = ("secret", "credential", "password", "token", "billing", "payment")
#: Files that may be changed and commands that only read.
SAFE_FILES = (r"\.test\.(ts|js|tsx|jsx)$", r"\.spec\.(ts|js|tsx|jsx)$", r"\.md$", r"\.txt$", r"\.json$", "README", "CHANGELOG")
READ_ONLY = ("ls", "cat", "head", "tail", "grep", "find", "echo", "pwd", "which", "whoami", "date")
#: Price of a million tokens read and written, milliseconds before the first token, tokens a second.
TIERS = {"small": (0.25, 1.25, 200, 200), "medium": (3.0, 15.0, 500, 100), "large": (15.0, 75.0, 2000, 50)}
WRITTEN_SHARE = 0.3
#: The format of a ledger: its headings, its checklist and an item of it.
LEDGER_HEAD = r"## (\d{4}-\d{2}-\d{2}) Mistake: (.+)"
LEDGER_LIST = r"(?s)\*\*Prevention[^*]*\*\*:\s*(.*?)(?=\*\*|---|\n##|$)"
LEDGER_ITEM = r"- \[[ x]\]\s*(.+)"


def _any(parts) -> Column:
    return reduce(lambda a, b: a | b, parts)


def dangerous_words(text: Column) -> Column:
    """The dangerous words in a text, in the order of their list."""
    pattern = lambda w: "(?i)" + w.replace("_", ".").replace(".", "[._]?")
    return F.array_compact(F.array(*[F.when(text.rlike(pattern(w)), w) for w in DANGEROUS]))


def risk_tier(words: Column) -> Column:
    """low, medium, high or critical, from :func:`dangerous_words`."""
    has = lambda ws: F.arrays_overlap(words, F.array(*map(F.lit, ws)))
    return F.when(F.size(words) == 0, "low").when(has(CRITICAL), "critical").when(has(HIGH), "high").otherwise("medium")


def needs_approval(words: Column, action: Column | None = None) -> Column:
    asked = F.size(words) > 0
    return asked if action is None else asked | F.coalesce(action == "require_human", F.lit(False))


def recommend_model(complexity: Column, tokens: Column, reasoning: Column, code: Column, urgent: Column) -> Column:
    """A struct (model, confidence, cost, latency_ms).

    Trivial tasks and simple code go to the small tier, expert reasoning to the
    large one; else simple tasks without code or reasoning are small, expert
    tasks and complex reasoning large, and all others medium.  An urgent task
    never waits for the large tier.
    """
    light = (complexity == "trivial") | (code & (complexity == "simple"))
    deep = reasoning & (complexity == "expert")
    by_kind = F.when(light, "small").when(deep, "large")
    by_size = F.when((complexity == "simple") & ~reasoning & ~code, "small").when((complexity == "expert") | ((complexity == "complex") & reasoning), "large").otherwise("medium")
    wanted = F.coalesce(by_kind, by_size)
    lowered = urgent & (wanted == "large")
    model = F.when(lowered, "medium").otherwise(wanted)
    confidence = F.when(light, 0.9).when(lowered, 0.75).when(deep, 0.85).otherwise(0.8)
    pick = lambda f: reduce(lambda out, t: F.when(model == t, f(*TIERS[t])).otherwise(out), TIERS, F.lit(None))
    cost = pick(lambda read, write, *_: tokens * (read + WRITTEN_SHARE * write) / 1_000_000)
    latency = pick(lambda _r, _w, first, speed: first + tokens / speed * 1000)
    return F.struct(model.alias("model"), confidence.alias("confidence"), cost.alias("cost"), latency.alias("latency_ms"))


def route_model(complexity: Column, over_budget: Column, large_over_limit: Column, available: Column, rules: dict[str, tuple[str, ...]], free: str, default: str, large: str = "large", instead: str = "medium") -> Column:
    """A struct (model, reason: rule, fallback, budget, unavailable or default).

    ``rules`` has the models of a complexity in order of preference.  Over
    budget all goes to ``free``; beyond the limit of the large model its place
    as the first is taken by ``instead``, and as a fallback it is passed over.
    """
    out = F.struct(F.lit(default).alias("model"), F.lit("default").alias("reason"))
    for name, (first, *rest) in rules.items():
        head = F.when(large_over_limit & (F.lit(first) == large), instead).otherwise(first)
        found = F.struct(F.lit(free).alias("model"), F.lit("unavailable").alias("reason"))
        for m in reversed(rest):
            open_ = F.array_contains(available, m)
            usable = open_ & ~large_over_limit if m == large else open_
            found = F.when(usable, F.struct(F.lit(m).alias("model"), F.lit("fallback").alias("reason"))).otherwise(found)
        found = F.when(F.array_contains(available, head), F.struct(head.alias("model"), F.lit("rule").alias("reason"))).otherwise(found)
        out = F.when(complexity == name, found).otherwise(out)
    return F.when(over_budget, F.struct(F.lit(free).alias("model"), F.lit("budget").alias("reason"))).otherwise(out)


def is_safe_file(path: Column) -> Column:
    return _any([path.rlike(p) for p in SAFE_FILES])


def is_read_only(command: Column) -> Column:
    return command.rlike(rf"^({'|'.join(READ_ONLY)})(\s|$)")


def cache_key(tool: Column, *inputs: Column) -> Column:
    """The tool and the first of its inputs that is given."""
    given = F.coalesce(*[F.when(x != "", x) for x in inputs], F.lit(""))
    return F.concat(tool, F.lit(":"), given)


def hit_rate(df: DataFrame, key: Column) -> DataFrame:
    """(calls, hits, rate): a call hits if its key was seen before."""
    seen = df.select(key.alias("_k")).groupBy("_k").agg(F.count("*").alias("n"))
    total = seen.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("calls"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("hits"))
    return total.withColumn("rate", F.when(F.col("calls") > 0, F.col("hits") / F.col("calls")).otherwise(0.0))


def filter_entities(entities: Column, kind: str | None = None, least: float | None = None) -> Column:
    """Entities (type, confidence, ...) of one type and at least a confidence; order stays."""
    keep = lambda e: (F.lit(True) if kind is None else e["type"] == kind) & (F.lit(True) if least is None else e["confidence"] >= least)
    return F.filter(entities, keep)


def ledger_entries(notes: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, id, date, name, symptom, root_cause, location, fix, prevention) of each dated heading of a ledger.

    Missing fields are empty; the checklist is what stands between its heading
    and the next bold field, rule, heading or end.
    """
    s = notes.select("doc_id", F.explode(F.split(F.col(text), f"(?={LEDGER_HEAD})")).alias("s")).where(F.col("s").rlike(LEDGER_HEAD))
    field = lambda name: F.regexp_extract("s", rf"\*\*{name}\*\*:\s*(.+)", 1)
    name = F.regexp_extract("s", LEDGER_HEAD, 2)
    listed = F.regexp_extract("s", LEDGER_LIST, 1)
    items = F.transform(F.regexp_extract_all(listed, F.lit(LEDGER_ITEM), F.lit(1)), lambda x: F.rtrim(x))
    return s.select(
        "doc_id", F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-").alias("id"), F.regexp_extract("s", LEDGER_HEAD, 1).alias("date"), name.alias("name"),
        field("Symptom").alias("symptom"), field("Root cause").alias("root_cause"), field(r"Where it happened[^*]*").alias("location"), field("Fix").alias("fix"), items.alias("prevention"),
    )


def search_by_heading(files: DataFrame, words: str, limit: int = 10) -> DataFrame:
    """(doc_id, name, total): files whose first heading or text holds ``words``, by name, with their number before the limit."""
    name = F.coalesce(F.nullif(F.regexp_extract("text", r"(?m)^#\s+(.+)$", 1), F.lit("")), F.lit("untitled"))
    hit = F.contains(F.lower(name), F.lit(words.lower())) | F.contains(F.lower("text"), F.lit(words.lower()))
    found = files.select("doc_id", name.alias("name"), hit.alias("hit")).where("hit")
    total = found.agg(F.count("*").alias("total"))
    return found.orderBy("name", "doc_id").limit(limit).select("doc_id", "name").crossJoin(F.broadcast(total))  # one row


def by_priority(df: DataFrame, priority: str, *order: str) -> DataFrame:
    """Critical, high, medium, low, then all else."""
    rank = reduce(lambda out, p: F.when(F.col(priority) == p[1], p[0]).otherwise(out), enumerate(("critical", "high", "medium", "low")), F.lit(4))
    return df.orderBy(rank, *order)


def holds_words(tokens: Column, all_of: tuple[str, ...] = (), any_of: tuple[str, ...] = ()) -> Column:
    """Whether an array holds all of some words and any of others; an empty list asks for nothing."""
    every = F.forall(F.array(*map(F.lit, all_of)), lambda w: F.array_contains(tokens, w)) if all_of else F.lit(True)
    some = F.exists(F.array(*map(F.lit, any_of)), lambda w: F.array_contains(tokens, w)) if any_of else F.lit(True)
    return every & some


def export_yaml(df: DataFrame, order: str) -> DataFrame:
    """(order, value): each row as an item of a YAML list; strings are quoted, nulls are null."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def scalar(c: str) -> Column:
        text = F.col(c).cast("string")
        quoted = F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
        return F.coalesce(quoted if kinds[c] == "string" else text, F.lit("null"))

    lines = [F.concat(F.lit(("- " if k == 0 else "  ") + c + ": "), scalar(c)) for k, c in enumerate(df.columns)]
    return df.select(order, F.concat_ws("\n", *lines).alias("value"))


def scan_yaml(files: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, key, value) of flat YAML: top-level scalars of each file, unquoted; lists and nested parts are left out."""
    line = files.select("doc_id", F.explode(F.split(F.col(text), "\r?\n")).alias("line")).where(F.col("line").rlike(r"^[A-Za-z_][\w-]*:\s*\S"))
    value = F.trim(F.regexp_replace(F.regexp_extract("line", r"^[\w-]+:\s*(.*)$", 1), r"\s+#.*$", ""))
    bare = F.when(value.rlike("^\"(.*)\"$|^'(.*)'$"), value.substr(F.lit(2), F.length(value) - 2)).otherwise(value)
    return line.select("doc_id", F.regexp_extract("line", r"^([\w-]+):", 1).alias("key"), bare.alias("value"))
