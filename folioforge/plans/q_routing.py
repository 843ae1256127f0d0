"""Queries of model routing, request risk, ledgers and entity filters."""

from pyspark.sql import functions as F

from ..operators import books as B
from ..operators import routing as R
from .registry import derived, query, table

TASKS = (
    "select event_id, case event_id % 5 when 0 then 'trivial' when 1 then 'simple' when 2 then 'moderate' when 3 then 'complex' else 'expert' end as complexity, user_id % 1000 * 10 as tokens, "
    "event_id % 3 = 0 as reasoning, event_id % 7 < 3 as code, event_type = 'error' as urgent, user_id % 11 = 0 as over_budget, user_id % 4 = 0 as over_limit, user_id % 6 as free from events"
)
_WANTED = "case when complexity = 'trivial' or (code and complexity = 'simple') then 'small' when reasoning and complexity = 'expert' then 'large' when complexity = 'simple' and not reasoning and not code then 'small' when complexity = 'expert' or (complexity = 'complex' and reasoning) then 'large' else 'medium' end"


@query(f"""with t as ({TASKS}), w as (select *, {_WANTED} as wanted from t), m as (select *, case when urgent and wanted = 'large' then 'medium' else wanted end as model from w)
  select event_id, model, case when complexity = 'trivial' or (code and complexity = 'simple') then 0.9 when urgent and wanted = 'large' then 0.75 when reasoning and complexity = 'expert' then 0.85 else 0.8 end as confidence,
  round(tokens * (case model when 'small' then 0.25 + 0.3 * 1.25 when 'medium' then 3 + 0.3 * 15 else 15 + 0.3 * 75 end) / 1000000, 8) as cost,
  round(case model when 'small' then 200 + tokens / 200.0 * 1000 when 'medium' then 500 + tokens / 100.0 * 1000 else 2000 + tokens / 50.0 * 1000 end, 6) as latency_ms from m""")
def g15_recommend_model(spark, sf):
    c = F.col
    out = derived(spark, sf, TASKS, "events").select("event_id", R.recommend_model(c("complexity"), c("tokens"), c("reasoning"), c("code"), c("urgent")).alias("m")).select("event_id", "m.*")
    return out.withColumns({"cost": F.round(c("cost").cast("double"), 8), "latency_ms": F.round(c("latency_ms").cast("double"), 6)})


RULES = {"trivial": ("local", "small", "free"), "simple": ("small", "local", "free"), "moderate": ("medium", "small", "local"), "complex": ("medium", "large", "small"), "expert": ("large", "medium")}
_AVAILABLE = "case free when 0 then ['small', 'local'] when 1 then ['medium'] when 2 then ['large', 'medium'] when 3 then ['large'] when 4 then cast([] as string[]) else ['small', 'medium', 'large', 'local'] end"


def _route_sql():
    out = []
    for name, (first, *rest) in RULES.items():
        head = f"case when over_limit and '{first}' = 'large' then 'medium' else '{first}' end"
        steps = " ".join(f"when list_contains(a, '{m}'){' and not over_limit' if m == 'large' else ''} then '{m}:fallback'" for m in rest)
        out.append(f"when complexity = '{name}' then case when list_contains(a, {head}) then concat({head}, ':rule') {steps} else 'free:unavailable' end")
    return "case when over_budget then 'free:budget' " + " ".join(out) + " else 'medium:default' end"


@query(f"with t as (select *, {_AVAILABLE} as a from ({TASKS})) select event_id, split_part({_route_sql()}, ':', 1) as model, split_part({_route_sql()}, ':', 2) as reason from t")
def g16_route_model(spark, sf):
    lists = (("small", "local"), ("medium",), ("large", "medium"), ("large",), (), ("small", "medium", "large", "local"))
    free = F.lit(None).cast("array<string>")
    for k, names in enumerate(lists):
        free = F.when(F.col("free") == k, F.array(*map(F.lit, names)).cast("array<string>")).otherwise(free)
    route = R.route_model(F.col("complexity"), F.col("over_budget"), F.col("over_limit"), free, RULES, "free", "medium")
    return derived(spark, sf, TASKS, "events").select("event_id", route.alias("r")).select("event_id", "r.*")


_SAID = "select doc_id, concat(text, case doc_id % 9 when 0 then ' API.Key' when 1 then ' please Drop it' when 2 then ' accesscontrol' when 3 then ' brute_force' else '' end) as text from documents"
_pattern = lambda w: w.replace("_", ".").replace(".", "[._]?")
_words = "list_filter([" + ", ".join(f"case when regexp_matches(text, '(?i){_pattern(w)}') then '{w}' end" for w in R.DANGEROUS) + "], lambda w: w is not null)"
_has = lambda ws: "list_has_any(words, [" + ", ".join(f"'{w}'" for w in ws) + "])"


@query(f"with s as ({_SAID}), w as (select doc_id, {_words} as words from s) select doc_id, words, case when len(words) = 0 then 'low' when {_has(R.CRITICAL)} then 'critical' when {_has(R.HIGH)} then 'high' else 'medium' end as risk, len(words) > 0 as approval from w")
def g35_dangerous_words(spark, sf):
    said = derived(spark, sf, _SAID, "documents").select("doc_id", R.dangerous_words(F.col("text")).alias("words"))
    return said.select("doc_id", "words", R.risk_tier(F.col("words")).alias("risk"), R.needs_approval(F.col("words")).alias("approval"))


CALLS = "select event_id, concat(event_type, case event_id % 6 when 0 then '.md' when 1 then '.test.ts' when 2 then '.tsx' when 3 then '.spec.jsx' when 4 then '/README' else '.py' end) as path, concat(case user_id % 4 when 0 then 'ls' when 1 then 'lsof' when 2 then 'grep x' else 'rm y' end, case when user_id % 8 < 4 then '' else ' -l' end) as command, case when user_id % 2 = 0 then '' else event_type end as pattern from events"
_safe = " or ".join(f"regexp_matches(path, '{p}')" for p in R.SAFE_FILES)


@query(f"with c as ({CALLS}) select event_id, {_safe} as safe, regexp_matches(command, '^({'|'.join(R.READ_ONLY)})(\\s|$)') as read_only, concat(path, ':', case when pattern <> '' then pattern else command end) as key from c")
def g54_safe_calls(spark, sf):
    c = derived(spark, sf, CALLS, "events")
    return c.select("event_id", R.is_safe_file(F.col("path")).alias("safe"), R.is_read_only(F.col("command")).alias("read_only"), R.cache_key(F.col("path"), F.col("pattern"), F.col("command")).alias("key"))


@query(f"with c as ({CALLS}), k as (select count(*) as n, count(distinct concat(path, ':', command)) as d from c) select n as calls, n - d as hits, (n - d) / n as rate from k")
def g54_hit_rate(spark, sf):
    return R.hit_rate(derived(spark, sf, CALLS, "events"), R.cache_key(F.col("path"), F.col("command")))


LEDGER = (
    "select doc_id, concat('intro', chr(10), '## 2024-01-0', 1 + doc_id % 9, ' Mistake: Lost ', source, chr(10), '**Symptom**: ', lang, chr(10), case when doc_id % 2 = 0 then concat('**Root cause**: cut', chr(10)) else '' end, "
    "'**Where it happened (file)**: a/b', chr(10), '**Fix**: undo', chr(10), '**Prevention (list)**: ', chr(10), '- [ ] test ', source, chr(10), '- [x] read', chr(10), '---', chr(10), '## 2024-02-02 Mistake: Two  Words!', chr(10), '**Fix**: none', chr(10)) as text from documents"
)


@query("""select doc_id, concat('lost-', lower(source)) as id, concat('2024-01-0', 1 + doc_id % 9) as date, concat('Lost ', source) as name, lang as symptom, case when doc_id % 2 = 0 then 'cut' else '' end as root_cause, 'a/b' as location, 'undo' as fix, [concat('test ', source), 'read'] as prevention from documents
  union all select doc_id, 'two-words-', '2024-02-02', 'Two  Words!', '', '', '', 'none', cast([] as string[]) from documents""")
def g57_ledger(spark, sf):
    return R.ledger_entries(derived(spark, sf, LEDGER, "documents"))


@query("select event_id, case when value >= 50 then 'number' else '' end as found, case when value >= 50 then cast(0.9 as double) end as confidence, case when event_id % 2 = 0 then 2 else 1 end as sure from events")
def p15_entity_filters(spark, sf):
    e = lambda kind, c: F.struct(F.lit(kind).alias("type"), c.alias("confidence"))
    entities = F.array(e("number", F.when(F.col("value") >= 50, 0.9).otherwise(0.4)), e("path", F.lit(0.7)), e("url", F.when(F.col("event_id") % 2 == 0, 0.6).otherwise(0.1)))
    found = R.filter_entities(F.col("entities"), "number", 0.5)
    sure = F.size(F.filter(R.filter_entities(F.col("entities"), least=0.5), lambda x: x["type"] != "number"))
    return table(spark, sf, "events").select("event_id", "value", entities.alias("entities")).select("event_id", found.alias("found"), sure.alias("sure")).select(
        "event_id", F.array_join(F.col("found.type"), ",").alias("found"), F.array_max(F.col("found.confidence")).alias("confidence"), "sure"
    )


@query("select doc_id, case when doc_id % 3 = 0 then concat('known-', doc_id) else concat_ws('-', h[1:8], h[9:12], h[13:16], h[17:20], h[21:32]) end as uid, doc_id % 3 <> 0 as created from (select doc_id, sha256(cast(doc_id as string)) as h from documents)")
def k9_get_or_create_uid(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    known = d.where("doc_id % 3 = 0").select("doc_id", F.concat(F.lit("known-"), F.col("doc_id").cast("string")).alias("uid"))
    return B.get_or_create_uid(d, known)


@query("select doc_id, concat(':root { --line-height: 1.8; --font-size: 1em; --margin-block: 2em; --margin-inline: 1em; }', chr(10), 'html { line-height: 1.8; font-size: 1em; }', chr(10), 'body { padding: 2em 1em; }', chr(10), 'body { font-size: calc(100vh / (40 * 1.8)); }', chr(10), source) as css from documents")
def f29_layout_css(spark, sf):
    return table(spark, sf, "documents").select("doc_id", B.layout_css(F.col("source"), "1.8", "1em", "2em", "1em", 40).alias("css"))


@query("with s as (select doc_id, concat('# ', source, chr(10), text) as text, source as name from documents), f as (select * from s where contains(lower(name), 'src1') or contains(lower(text), 'src1')), t as (select count(*) as total from f) select doc_id, name, total from (select doc_id, name from f order by name, doc_id limit 10), t")
def g51_search_by_heading(spark, sf):
    files = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("# "), "source", F.lit("\n"), "text").alias("text"))
    return R.search_by_heading(files, "src1")


@query("""select r_regionkey as k, concat('- r_regionkey: ', r_regionkey, chr(10), '  r_name: "', r_name, '"', chr(10), '  half: ', case when r_regionkey = 1 then 'null' else cast(r_regionkey as string) end) as value from region""")
def k12_export_yaml(spark, sf):
    r = table(spark, sf, "region").select("r_regionkey", "r_name", F.when(F.col("r_regionkey") != 1, F.col("r_regionkey")).alias("half"))
    return R.export_yaml(r, "r_regionkey").withColumnRenamed("r_regionkey", "k")


@query("select doc_id, unnest(['agent', 'total']) as key, unnest([source, cast(n_chars as string)]) as value from documents")
def s18_scan_yaml(spark, sf):
    text = F.concat(F.lit("# stats\nagent: \""), "source", F.lit("\"\ntotal: "), F.col("n_chars").cast("string"), F.lit("  # all\nlist:\n  - a\n  b: c\n"))
    return R.scan_yaml(table(spark, sf, "documents").select("doc_id", text.alias("text")))
