"""Intent, risk and content classification by rules and small models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RISKS = ("low", "medium", "high")
#: What a message is redacted of, in order.
SECRETS = (
    r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    r"\b(?:ghp|gho|ghs|ghu|github_pat)_[A-Za-z0-9_]{36,}\b",
    r"\bsk-[A-Za-z0-9]{48}\b",
    r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b",
    r"\b[A-Za-z0-9]{32,}\b",
)
#: Patterns of injected commands and queries.
COMMAND_INJECTION = (r";\s*rm\s+-rf", r"\|\s*bash", r"\|\s*sh", r"`.*`", r"\$\(.*\)", r"&&\s*curl", r";\s*wget", r">\s*/dev/null.*&")
SQL_INJECTION = (r"'\s*OR\s*'1'\s*=\s*'1", r"--\s*$", r";.*DROP\s+TABLE", r"UNION\s+SELECT", r"'\s*;\s*DELETE\s+FROM")
#: Words that tell the type of a page, first match first.
CONTENT_TYPES = (
    ("documentation", ("documentation", "api reference", "getting started", "installation")),
    ("api", ("api", "endpoint", "request", "response")),
    ("product", ("$", "price", "add to cart", "buy")),
    ("tool", ("dashboard", "admin", "settings")),
    ("article", ("article", "blog", "post")),
)


def any_match(text: Column, patterns, flags: str = "") -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(flags + p) for p in patterns])


def redact(text: Column, placeholder: str = "[REDACTED]", more: tuple[str, ...] = ()) -> Column:
    for p in (*SECRETS, *more):
        text = F.regexp_replace(text, p, placeholder)
    return text


def injection(text: Column) -> Column:
    """command, sql or null."""
    return F.when(any_match(text, COMMAND_INJECTION), "command").when(any_match(text, SQL_INJECTION, "(?i)"), "sql")


def content_type(text: Column) -> Column:
    low = F.lower(text)
    out = F.lit("unknown")
    for name, words in reversed(CONTENT_TYPES):
        out = F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words]), name).otherwise(out)
    return out


def classify(text: Column, rules: list[tuple[str, str, int]], fits=Column.rlike) -> Column:
    """Matches of (name, pattern, confidence) rules as an array of structs, best first, then by rule order; ``fits`` tests a text by a pattern."""
    found = F.array_compact(F.array(*[F.when(fits(text, p), F.struct(F.lit(-c).alias("rank"), F.lit(k).alias("ord"), F.lit(n).alias("name"), F.lit(c).alias("confidence"))) for k, (n, p, c) in enumerate(rules)]))
    return F.transform(F.array_sort(found), lambda m: F.struct(m["name"].alias("name"), m["confidence"].alias("confidence")))


def confidence(matches: Column, flags: dict[str, Column]) -> Column:
    """Confidence of the best match, moved by context flags and by the number of matches, within 0 and 100."""
    move = {"continued": 5, "reuse": 10, "skill": 8, "files": 5, "deviation": -10, "baseline": -15}
    base = F.get(matches, F.lit(0))["confidence"]
    for name, by in move.items():
        if name in flags:
            base = base + F.when(flags[name], by).otherwise(0)
    n = F.size(matches)
    base = base + F.when(n >= 2, 5).otherwise(0) + F.when(n >= 3, 5).otherwise(0)
    return F.when(n == 0, 0).otherwise(F.least(F.lit(100), F.greatest(F.lit(0), base)))


def confidence_level(score: Column) -> Column:
    return F.when(score >= 90, "very_high").when(score >= 70, "high").when(score >= 50, "medium").when(score >= 30, "low").otherwise("very_low")


def adjusted_risk(base: Column, flags: dict[str, Column], score: Column) -> Column:
    """Base risk moved by context, then by confidence."""
    r = F.when(flags["deviation"] & (base == "low"), "medium").otherwise(base)
    r = F.when((flags["reuse"] | flags["skill"]) & (r == "medium"), "low").otherwise(r)
    r = F.when(flags["baseline"], "high").otherwise(r)
    weak = F.when(r == "low", "medium").when(r == "medium", "high").otherwise(r)
    strong = F.when(r == "high", "medium").when(r == "medium", "low").otherwise(r)
    return F.when(score < 50, weak).when(score > 90, strong).otherwise(r)


def skippable_layers(risk: Column, simple: Column, flags: dict[str, Column]) -> Column:
    low = risk == "low"
    return F.array_compact(F.array(F.when(low & ~flags["deviation"], 6), F.when(low & simple, 7), F.when(flags["reuse"], 3), F.when(flags["skill"], 6)))


#: From which confidence the models of the cascade decide, and how sure a leaf of the tree is.
BAYES_LEAST, TREE_LEAST, TREE_SURE = 70, 60, 70


def bayes_train(df: DataFrame, label: str, features: str) -> DataFrame:
    """(label, n, sums) per class: counts and sums of each feature, in one aggregation."""
    long = df.select(label, F.posexplode(features).alias("i", "x"))
    sums = long.groupBy(label, "i").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    return sums.groupBy(label).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda p: p["s"]).alias("sums"))


def bayes_predict(df: DataFrame, model: list[tuple[str, int, list[float]]], features: str, alpha: float = 1.0) -> DataFrame:
    """Adds risk and confidence (rounded percent of the softmax) from (label, n, sums); ties go to the first label."""
    total, k = sum(n for _, n, _ in model), len(model)

    def log_prob(n: int, sums: list[float]) -> Column:
        p = F.array(*[F.lit((s + alpha) / (n + 2 * alpha)) for s in sums])
        each = F.zip_with(features, p, lambda x, q: F.when(x > 0.5, F.log(q)).otherwise(F.log(1 - q)))
        return F.aggregate(each, F.log(F.lit((n + alpha) / (total + k * alpha))), lambda a, b: a + b)

    names = [f"_p{i}" for i in range(k)]
    out = df.withColumns({c: log_prob(n, s) for c, (_, n, s) in zip(names, model)})
    best = F.greatest(*names)
    label = F.lit(model[-1][0])
    for c, (name, _, _) in reversed(list(zip(names, model))[:-1]):
        label = F.when(F.col(c) == best, name).otherwise(label)
    odds = reduce(lambda a, b: a + b, [F.exp(F.col(c) - best) for c in names])
    return out.withColumns({"risk": label, "confidence": F.least(F.lit(100), F.floor(F.lit(100.0) / odds + 0.5))}).drop(*names)


def _entropy(counts: list[Column]) -> Column:
    n = reduce(lambda a, b: a + b, counts)
    return -reduce(lambda a, b: a + b, [F.when(c > 0, c / n * F.log2(c / n)).otherwise(0.0) for c in counts])


def information_gain(df: DataFrame, label: str, features: str, labels: tuple[str, ...] = RISKS) -> DataFrame:
    """(i, gain) of splitting at 0.5, for each feature that splits at all."""
    long = df.select(label, F.posexplode(features).alias("i", "x"))
    side = lambda test, name: F.count_if(test & (F.col(label) == name))
    left, right = F.col("x") <= 0.5, F.col("x") > 0.5
    agg = long.groupBy("i").agg(*[side(t, n).alias(f"{s}{k}") for s, t in (("l", left), ("r", right)) for k, n in enumerate(labels)])
    ls, rs = ([F.col(f"{s}{k}") for k in range(len(labels))] for s in "lr")
    nl, nr = (reduce(lambda a, b: a + b, x) for x in (ls, rs))
    gain = _entropy([a + b for a, b in zip(ls, rs)]) - nl / (nl + nr) * _entropy(ls) - nr / (nl + nr) * _entropy(rs)
    return agg.where((nl > 0) & (nr > 0)).select("i", gain.alias("gain"))


#: Gains are compared to so many places, so that ties do not hang on the last bits of a logarithm.
GAIN_PLACES = 9


def grow_tree(df: DataFrame, label: str, features: str, depth: int = 5, least: int = 5, labels: tuple[str, ...] = RISKS) -> list[tuple[int, int | None, str]]:
    """An ID3 tree as (node, feature or None, majority label); children of node k are 2k + 1 (<= 0.5) and 2k + 2.

    Each level is one aggregation over all rows by (node, feature); the driver
    gets one row per node and feature, which depth and width bound.
    """
    out: list[tuple[int, int | None, str]] = []
    rows = df.select(label, features).withColumn("node", F.lit(0))
    for level in range(depth + 1):
        stats = rows.groupBy("node").agg(*[F.count_if(F.col(label) == n).alias(n) for n in labels]).collect()
        if not stats:
            break
        splits: dict[int, int] = {}
        full = [r.node for r in stats if sum(r[n] for n in labels) >= least and sum(r[n] > 0 for n in labels) > 1]
        if level < depth and full:
            long = rows.where(F.col("node").isin(full)).select("node", label, F.posexplode(features).alias("i", "x"))
            for r in _gains(long, label, labels).withColumn("gain", F.round("gain", GAIN_PLACES)).collect():
                if r.gain > 0 and (r.node not in splits or (r.gain, -r.i) > (splits[r.node][0], -splits[r.node][1])):
                    splits[r.node] = (r.gain, r.i)
        for r in sorted(stats):
            best = max(labels, key=lambda n: (r[n], -labels.index(n)))
            out.append((r.node, splits[r.node][1] if r.node in splits else None, best))
        if not splits:
            break
        at = F.create_map(*[F.lit(x) for n, (_, i) in splits.items() for x in (n, i)])
        x = F.element_at(F.col(features), F.try_element_at(at, F.col("node")) + 1)
        rows = rows.where(F.col("node").isin(list(splits))).withColumn("node", F.col("node") * 2 + F.when(x > 0.5, 2).otherwise(1))
    return out


def _gains(long: DataFrame, label: str, labels: tuple[str, ...]) -> DataFrame:
    side = lambda test, name: F.count_if(test & (F.col(label) == name))
    agg = long.groupBy("node", "i").agg(*[side(t, n).alias(f"{s}{k}") for s, t in (("l", F.col("x") <= 0.5), ("r", F.col("x") > 0.5)) for k, n in enumerate(labels)])
    ls, rs = ([F.col(f"{s}{k}") for k in range(len(labels))] for s in "lr")
    nl, nr = (reduce(lambda a, b: a + b, x) for x in (ls, rs))
    gain = _entropy([a + b for a, b in zip(ls, rs)]) - nl / (nl + nr) * _entropy(ls) - nr / (nl + nr) * _entropy(rs)
    return agg.where((nl > 0) & (nr > 0)).select("node", "i", gain.alias("gain"))


def tree_leaf(features: Column, tree: list[tuple[int, int | None, str]]) -> Column:
    """The node of :func:`grow_tree` where a row ends: the node array is walked inside Catalyst, one step a level."""
    nodes = {n: i for n, i, _ in tree if i is not None}
    last = max((n for n, _, _ in tree), default=0)
    split = F.array(*[F.lit(nodes.get(n)).cast("int") for n in range(last + 1)])
    depth = (last + 1).bit_length()

    def step(node: Column, _: Column) -> Column:
        feature = F.get(split, node)
        return F.when(feature.isNull(), node).otherwise(2 * node + F.when(F.coalesce(F.get(features, feature), F.lit(0.0)) > 0.5, 2).otherwise(1))

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step)


def tree_predict(df: DataFrame, tree: list[tuple[int, int | None, str]], features: str) -> DataFrame:
    """Adds tree_risk and tree_confidence: the label of the row's leaf, TREE_SURE; without a tree medium, 0."""
    if not tree:
        return df.withColumns({"tree_risk": F.lit("medium"), "tree_confidence": F.lit(0)})
    names = {n: label for n, _, label in tree}
    labels = F.array(*[F.lit(names.get(n)) for n in range(max(names) + 1)])
    return df.withColumns({"tree_risk": F.get(labels, tree_leaf(F.col(features), tree)), "tree_confidence": F.lit(TREE_SURE)})


def cascade_predict(df: DataFrame, bayes: list[tuple[str, int, list[float]]], tree: list[tuple[int, int | None, str]], rule: Column, features: str) -> DataFrame:
    """Adds risk, confidence and method of the first model that is sure enough: Bayes, then the tree, then the rule (confidence 0).

    Without a trained Bayes model the rule decides, whatever the tree says.
    """
    rule_only = {"risk": rule, "confidence": F.lit(0).cast("long"), "method": F.lit("rule")}
    if not bayes:
        return df.withColumns(rule_only)
    out = tree_predict(bayes_predict(df.withColumn("_rule", rule), bayes, features), tree, features)
    sure = [F.col("confidence") >= BAYES_LEAST, F.col("tree_confidence") >= TREE_LEAST]
    risk = cascade((F.col("risk"), F.col("confidence")), (F.col("tree_risk"), F.col("tree_confidence")), F.col("_rule"))
    confidence = F.when(sure[0], F.col("confidence")).when(sure[1], F.col("tree_confidence")).otherwise(0).cast("long")
    method = F.when(sure[0], "bayes").when(sure[1], "tree").otherwise("rule")
    return out.withColumns({"risk": risk, "confidence": confidence, "method": method}).drop("_rule", "tree_risk", "tree_confidence")


def cascade(bayes: tuple[Column, Column], tree: tuple[Column, Column], rule: Column) -> Column:
    """Bayes from BAYES_LEAST on, else the tree from TREE_LEAST on, else the rule."""
    return F.when(bayes[1] >= BAYES_LEAST, bayes[0]).when(tree[1] >= TREE_LEAST, tree[0]).otherwise(rule)


def canary_bucket(run_id: Column, name: Column) -> Column:
    """0 to 99 from the first eight digits of sha256(run:name)."""
    digest = F.sha2(F.concat(run_id, F.lit(":"), name), 256)
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 100).cast("int")


def retry_delay(attempt: Column, base_ms: int = 1000, most_ms: int = 30_000) -> Column:
    return F.least(F.lit(float(most_ms)), F.lit(base_ms) * F.pow(F.lit(2.0), attempt))


def normalize_path(path: Column) -> Column:
    """Resolves ``.``, ``..`` and doubled slashes; an absolute path never leaves its root."""
    absolute = F.startswith(path, F.lit("/"))

    def step(acc: Column, p: Column) -> Column:
        up = (F.size(acc) > 0) & (F.element_at(acc, F.greatest(F.size(acc), F.lit(1)) * F.lit(1)) != "..")
        shorter = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when((p == "") | (p == "."), acc).when(p == "..", F.when(up, shorter).when(~absolute, F.array_append(acc, "..")).otherwise(acc)).otherwise(F.array_append(acc, p))

    safe = lambda acc, p: F.when(F.size(acc) == 0, F.when((p == "") | (p == "."), acc).when(p == "..", F.when(~absolute, F.array(F.lit(".."))).otherwise(acc)).otherwise(F.array(p))).otherwise(step(acc, p))
    joined = F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), safe), "/")
    return F.when(F.coalesce(F.regexp_replace(path, "\\s", ""), F.lit("")) == "", "").when(absolute, F.concat(F.lit("/"), joined)).when(joined == "", ".").otherwise(joined)


def _tagged(name: str):
    return lambda v: F.concat(F.lit(name + ":"), v)


def entities(text: Column) -> Column:
    """(type, value) of skills, paths, numbers and links, each once, in order of type and place."""
    patterns = (("skill", r"([a-z\-]+)(?:スキル|skill)"), ("path", r"([a-zA-Z0-9_\-./]+\.(?:ts|js|json|md|txt|html))"), ("number", r"([0-9]+)"), ("url", r"(https?://[^\s]+)"))
    found = [F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(p), F.lit(1))), _tagged(n)) for n, p in patterns]
    return F.concat(*found)


def progress_bar(done: Column, total: Column, blocks: int = 20) -> Column:
    percent = F.floor(done / total * 100 + 0.5)
    full = F.floor(percent * blocks / 100 + 0.5).cast("int")
    return F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), F.lit(blocks) - full), F.lit(" "), percent.cast("string"), F.lit("%"))


def replaced_with_counts(text: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The text after all rules in order, and how often each applied."""
    counts = []
    for pattern, to in rules:
        counts.append(F.regexp_count(text, F.lit(pattern)))
        text = F.regexp_replace(text, pattern, to)
    return text, F.array(*counts)
