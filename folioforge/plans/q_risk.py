"""Queries of rules and small models."""

from pyspark.sql import functions as F

from ..operators import ops as O
from ..operators import risk as R
from ..operators.routing import by_priority, holds_words
from .registry import derived, query, table


def docs(spark, sf):
    return table(spark, sf, "documents")


def _q(x):
    return x.replace("'", "''")


def redact_sql(x):
    for p in R.SECRETS:
        x = f"regexp_replace({x}, '{_q(p)}', '[REDACTED]', 'g')"
    return x


@query(f"select doc_id, {redact_sql('text')} as value from documents")
def g22_redact(spark, sf):
    return docs(spark, sf).select("doc_id", R.redact(F.col("text")).alias("value"))


BAD = "concat(text, case doc_id % 5 when 0 then '; rm -rf /' when 1 then ' UNION select 1' when 2 then ' $(id)' when 3 then ' --' else '' end)"


def bad(spark, sf):
    k = F.col("doc_id") % 5
    tail = F.when(k == 0, "; rm -rf /").when(k == 1, " UNION select 1").when(k == 2, " $(id)").when(k == 3, " --").otherwise("")
    return docs(spark, sf).select("doc_id", F.concat("text", tail).alias("text"))


_any = lambda x, ps, f="": "(" + " or ".join(f"regexp_matches({x}, '{f}{_q(p)}')" for p in ps) + ")"


@query(f"with b as (select doc_id, {BAD} as text from documents) select doc_id, case when {_any('text', R.COMMAND_INJECTION)} then 'command' when {_any('text', R.SQL_INJECTION, '(?i)')} then 'sql' end as kind from b")
def g34_injection(spark, sf):
    return bad(spark, sf).select("doc_id", R.injection(F.col("text")).alias("kind"))


_type = "case " + " ".join("when " + " or ".join(f"contains(lower(html), '{w}')" for w in ws) + f" then '{n}'" for n, ws in R.CONTENT_TYPES) + " else 'unknown' end"


@query(f"select page_id, {_type} as kind from pages")
def g36_content_type(spark, sf):
    return table(spark, sf, "pages").select("page_id", R.content_type(F.col("html")).alias("kind"))


RULES = [("LICENSE", "(?i)licensed? ", 90), ("MAIL", "[a-z]+@[a-z]+", 85), ("NUMBER", "[0-9]{4}", 60), ("SHOUT", "[A-Z]{6}", 60), ("THE", "(?i)\\bthe\\b", 40)]
_hit = lambda p: f"regexp_matches(text, '{p}')"
MATCHES = "list_filter([" + ", ".join(f"case when {_hit(p)} then {{'name': '{n}', 'confidence': {c}}} end" for n, p, c in RULES) + "], lambda m: m is not null)"
SORTED = f"list_sort(list_transform([" + ", ".join(f"case when {_hit(p)} then {{'rank': {-c}, 'ord': {k}, 'name': '{n}', 'confidence': {c}}} end" for k, (n, p, c) in enumerate(RULES)) + "], lambda m: m))"
FLAGS = {"continued": "doc_id % 2 = 0", "reuse": "doc_id % 3 = 0", "skill": "doc_id % 5 = 0", "files": "doc_id % 7 = 0", "deviation": "doc_id % 4 = 0", "baseline": "doc_id % 11 = 0"}
MOVED = " + ".join(f"case when {FLAGS[k]} then {v} else 0 end" for k, v in {"continued": 5, "reuse": 10, "skill": 8, "files": 5, "deviation": -10, "baseline": -15}.items())
SCORE = f"""with m as (select doc_id, list_filter({SORTED}, lambda m: m is not null) as ms from documents),
  c as (select doc_id, ms, len(ms) as n, case when len(ms) = 0 then 0 else least(100, greatest(0, ms[1].confidence + {MOVED} + case when len(ms) >= 2 then 5 else 0 end + case when len(ms) >= 3 then 5 else 0 end)) end as score from m)"""


def matched(spark, sf):
    return docs(spark, sf).select("doc_id", R.classify(F.col("text"), RULES).alias("ms"))


def flags():
    return {k: F.expr(v) for k, v in FLAGS.items()}


@query(f"{SCORE} select doc_id, n, ms[1].name as best from c")
def g26_classify(spark, sf):
    return matched(spark, sf).select("doc_id", F.size("ms").alias("n"), F.get("ms", F.lit(0))["name"].alias("best"))


@query(f"{SCORE} select doc_id, score, case when score >= 90 then 'very_high' when score >= 70 then 'high' when score >= 50 then 'medium' when score >= 30 then 'low' else 'very_low' end as level from c")
def g27_confidence(spark, sf):
    score = R.confidence(F.col("ms"), flags())
    return matched(spark, sf).select("doc_id", score.alias("score"), R.confidence_level(score).alias("level"))


@query(f"""{SCORE}, b as (select doc_id, score, case doc_id % 3 when 0 then 'low' when 1 then 'medium' else 'high' end as r from c), d as (select *, case when {FLAGS['deviation']} and r = 'low' then 'medium' else r end as r1 from b),
  e as (select *, case when {FLAGS['baseline']} then 'high' when ({FLAGS['reuse']} or {FLAGS['skill']}) and r1 = 'medium' then 'low' else r1 end as r2 from d),
  f as (select *, case when score < 50 then case r2 when 'low' then 'medium' when 'medium' then 'high' else r2 end when score > 90 then case r2 when 'high' then 'medium' when 'medium' then 'low' else r2 end else r2 end as risk from e)
  select doc_id, risk, list_filter([case when risk = 'low' and not ({FLAGS['deviation']}) then 6 end, case when risk = 'low' and doc_id % 2 = 1 then 7 end, case when {FLAGS['reuse']} then 3 end, case when {FLAGS['skill']} then 6 end], lambda x: x is not null) as skip from f""")
def g28_risk(spark, sf):
    base = F.element_at(F.array(*map(F.lit, R.RISKS)), (F.col("doc_id") % 3 + 1).cast("int"))
    risk = R.adjusted_risk(base, flags(), R.confidence(F.col("ms"), flags()))
    return matched(spark, sf).withColumn("risk", risk).select("doc_id", "risk", R.skippable_layers(F.col("risk"), F.col("doc_id") % 2 == 1, flags()).alias("skip"))


@query(f"{SCORE} select cast(count(*) as bigint) as matches, round(avg(m.confidence), 6) as avg, max(m.confidence) as max, min(m.confidence) as min from (select unnest(ms) as m from c)")
def a23_pattern_stats(spark, sf):
    m = matched(spark, sf).select(F.inline("ms"))
    return m.agg(F.count("*").alias("matches"), F.round(F.avg("confidence"), 6).alias("avg"), F.max("confidence").alias("max"), F.min("confidence").alias("min"))


TRAIN = "select vec_id, case label % 3 when 0 then 'low' when 1 then 'medium' else 'high' end as risk, list_transform(embedding[1:22], lambda v: case when v > 0 then 1.0 else 0.0 end) as f from embeddings"
SUMS = f"with t as ({TRAIN}), l as (select risk, unnest(f) as x, unnest(generate_series(0, 21)) as i from t), s as (select risk, i, sum(x) as s, count(*) as n from l group by 1, 2)"


def training(spark, sf):
    name = F.element_at(F.array(*map(F.lit, R.RISKS)), (F.col("label") % 3 + 1).cast("int"))
    return table(spark, sf, "embeddings").select("vec_id", name.alias("risk"), F.transform(F.slice("embedding", 1, 22), lambda v: F.when(v > 0, 1.0).otherwise(0.0)).alias("f"))


@query(f"{SUMS} select risk, max(n) as n, list(s order by i) as sums from s group by 1")
def a24_bayes_train(spark, sf):
    return R.bayes_train(training(spark, sf), "risk", "f")


@query(f"""{SUMS}, c as (select risk, max(n) as n from s group by 1), n as (select sum(n) as total from c), e as (select vec_id, unnest(f) as x, unnest(generate_series(0, 21)) as i from t),
  p as (select vec_id, s.risk, ln((any_value(s.n) + 1) / (any_value(total) + 3)) + sum(case when x > 0.5 then ln((s.s + 1) / (s.n + 2)) else ln(1 - (s.s + 1) / (s.n + 2)) end) as lp from e join s using (i), n group by 1, 2),
  b as (select vec_id, max(lp) as best from p group by 1), r as (select vec_id, min(case risk when 'low' then 0 when 'medium' then 1 else 2 end) filter (lp >= best - 1e-9) as k, least(100, floor(100 / sum(exp(lp - best)) + 0.5)) as confidence from p join b using (vec_id) group by 1)
  select vec_id, case k when 0 then 'low' when 1 then 'medium' else 'high' end as risk, cast(confidence as bigint) as confidence from r""")
def g30_bayes_predict(spark, sf):
    t = training(spark, sf)
    model = {r.risk: (r.n, r.sums) for r in R.bayes_train(t, "risk", "f").collect()}  # one row per class
    return R.bayes_predict(t.select("vec_id", "f"), [(k, *model[k]) for k in R.RISKS if k in model], "f").select("vec_id", "risk", "confidence")


_ent = lambda c: "-(" + " + ".join(f"case when {x} > 0 then {x} / ({' + '.join(c)}) * log2({x} / ({' + '.join(c)})) else 0 end" for x in c) + ")"
_L, _R = ["l0", "l1", "l2"], ["r0", "r1", "r2"]
_side = ", ".join(f"count(*) filter (x {op} 0.5 and risk = '{n}') as {s}{k}" for s, op in (("l", "<="), ("r", ">")) for k, n in enumerate(R.RISKS))


@query(f"""with t as ({TRAIN}), l as (select risk, unnest(f) as x, unnest(generate_series(0, 21)) as i from t), a as (select i, {_side} from l group by 1)
  select i, round({_ent([f'({a}+{b})' for a, b in zip(_L, _R)])} - (l0+l1+l2) / (l0+l1+l2+r0+r1+r2) * ({_ent(_L)}) - (r0+r1+r2) / (l0+l1+l2+r0+r1+r2) * ({_ent(_R)}), 8) as gain from a where l0+l1+l2 > 0 and r0+r1+r2 > 0""")
def a25_information_gain(spark, sf):
    return R.information_gain(training(spark, sf), "risk", "f").withColumn("gain", F.round("gain", 8))


def _tree_sql(depth: int = 5, least: int = 5) -> str:
    """CTEs of a tree grown level by level: r0 .. the rows of each level, b0 .. its splits, and tree."""
    gain = f"round({_ent([f'({a}+{b})' for a, b in zip(_L, _R)])} - (l0+l1+l2) / (l0+l1+l2+r0+r1+r2) * ({_ent(_L)}) - (r0+r1+r2) / (l0+l1+l2+r0+r1+r2) * ({_ent(_R)}), {R.GAIN_PLACES})"
    count = ", ".join(f"count(*) filter (risk = '{n}') as c{k}" for k, n in enumerate(R.RISKS))
    out = [f"t as ({TRAIN}), r0 as (select vec_id, risk, f, 0 as node from t)"]
    for d in range(depth + 1):
        out.append(f"s{d} as (select node, {count} from r{d} group by 1)")
        if d < depth:
            grown = f"select node from s{d} where c0 + c1 + c2 >= {least} and cast(c0 > 0 as int) + cast(c1 > 0 as int) + cast(c2 > 0 as int) > 1"
            out.append(f"l{d} as (select node, risk, unnest(f) as x, unnest(generate_series(0, 21)) as i from r{d} where node in ({grown}))")
            out.append(f"g{d} as (select node, i, {gain} as gain from (select node, i, {_side} from l{d} group by 1, 2) where l0+l1+l2 > 0 and r0+r1+r2 > 0)")
            out.append(f"b{d} as (select node, min(i) as i from g{d} a where gain > 0 and gain = (select max(gain) from g{d} b where b.node = a.node) group by 1)")
            out.append(f"r{d + 1} as (select vec_id, risk, f, node * 2 + case when f[i + 1] > 0.5 then 2 else 1 end as node from r{d} join b{d} using (node))")
    most = "case when c0 >= c1 and c0 >= c2 then 'low' when c1 >= c2 then 'medium' else 'high' end"
    levels = [f"select s{d}.node, {'b' + str(d) + '.i' if d < depth else 'null'} as feature, {most} as label from s{d}" + (f" left join b{d} using (node)" if d < depth else "") for d in range(depth + 1)]
    return ", ".join([*out, "tree as (" + " union all ".join(levels) + ")"])


@query(f"with {_tree_sql()} select cast(node as int) as node, cast(feature as int) as feature, label from tree")
def a26_id3_tree(spark, sf):
    tree = R.grow_tree(training(spark, sf), "risk", "f")
    return spark.createDataFrame(tree, "node int, feature int, label string")


_leaf = "with " + _tree_sql() + ", leaf as (select vec_id, max(node) as node from (" + " union all ".join(f"select vec_id, node from r{d}" for d in range(6)) + ") group by 1)"


@query(f"{_leaf} select vec_id, label as tree_risk, 70 as tree_confidence from leaf join tree using (node)")
def g31_tree_predict(spark, sf):
    t = training(spark, sf)
    return R.tree_predict(t.select("vec_id", "f"), R.grow_tree(t, "risk", "f"), "f").drop("f")


def _rule(t):
    """The rule beside the models: by how many features are set."""
    n = F.aggregate("f", F.lit(0.0), lambda a, x: a + x)
    return F.when(n >= 14, "high").when(n >= 10, "medium").otherwise("low")


@query(f"""{_leaf}, l as (select risk, unnest(f) as x, unnest(generate_series(0, 21)) as i from t), s as (select risk, i, sum(x) as s, count(*) as n from l group by 1, 2), c as (select risk, max(n) as n from s group by 1), n as (select sum(n) as total from c),
  e as (select vec_id, unnest(f) as x, unnest(generate_series(0, 21)) as i from t),
  p as (select vec_id, s.risk, ln((any_value(s.n) + 1) / (any_value(total) + 3)) + sum(case when x > 0.5 then ln((s.s + 1) / (s.n + 2)) else ln(1 - (s.s + 1) / (s.n + 2)) end) as lp from e join s using (i), n group by 1, 2),
  b as (select vec_id, max(lp) as best from p group by 1), bayes as (select vec_id, min(case risk when 'low' then 0 when 'medium' then 1 else 2 end) filter (lp >= best - 1e-9) as k, least(100, floor(100 / sum(exp(lp - best)) + 0.5)) as confidence from p join b using (vec_id) group by 1),
  u as (select vec_id, list_sum(f) as n from t)
  select vec_id, case when confidence >= 70 then case k when 0 then 'low' when 1 then 'medium' else 'high' end when vec_id % 5 < 3 then label when n >= 14 then 'high' when n >= 10 then 'medium' else 'low' end as risk,
    cast(case when confidence >= 70 then confidence when vec_id % 5 < 3 then 70 else 0 end as bigint) as confidence, case when confidence >= 70 then 'bayes' when vec_id % 5 < 3 then 'tree' else 'rule' end as method
  from bayes join leaf using (vec_id) join tree using (node) join u using (vec_id)""")
def g31_cascade(spark, sf):
    """All three models score the rows; two fifths of them have no tree yet, so that the rule is asked too."""
    t = training(spark, sf)
    rows, tree = R.bayes_train(t, "risk", "f").collect(), R.grow_tree(t, "risk", "f")  # one row per class, and one per node
    model = {r.risk: (r.n, r.sums) for r in rows}
    bayes = [(k, *model[k]) for k in R.RISKS if k in model]
    both = [R.cascade_predict(t.where(keep), bayes, own, _rule(t), "f") for keep, own in (("vec_id % 5 < 3", tree), ("vec_id % 5 >= 3", []))]
    return both[0].unionByName(both[1]).select("vec_id", "risk", "confidence", "method")


@query("""with l as (select doc_id, toxic, quality, row_number() over (order by doc_id desc) as k from labels)
  select 'block' as kind, count(*) as n, round(avg(toxic), 6) as rate from l where k <= 100 union all select 'false_block', count(*), round(avg(1 - quality), 6) from l where k <= 200""")
def a27_block_rate(spark, sf):
    """How many of the last hundred records were blocked, and of the last two hundred wrongly."""
    rows = table(spark, sf, "labels").withColumn("wrong", 1 - F.col("quality"))
    rates = [O.recent_rate(rows, flag, F.desc("doc_id"), n=n).withColumn("kind", F.lit(kind)) for kind, flag, n in (("block", "toxic", 100), ("false_block", "wrong", 200))]
    return rates[0].unionByName(rates[1]).select("kind", "n", F.round("rate", 6).alias("rate"))


@query("select doc_id, case when quality = 1 and toxic = 1 then 'high' when quality = 0 then 'medium' else 'low' end as label from labels")
def g33_corrected_label(spark, sf):
    return table(spark, sf, "labels").select("doc_id", O.corrected_label(F.col("toxic") == 1, F.col("quality") == 0).alias("label"))


@query("select c_custkey, [cast(c_acctbal > 0 as double), cast(c_custkey % 2 as double), cast(c_mktsegment = 'BUILDING' as double), round(least(1.0, length(c_name) / 40.0), 6)] as features from customer")
def g32_features(spark, sf):
    c = F.col
    return table(spark, sf, "customer").select("c_custkey", F.array((c("c_acctbal") > 0).cast("double"), (c("c_custkey") % 2).cast("double"), (c("c_mktsegment") == "BUILDING").cast("double"), F.round(F.least(F.lit(1.0), F.length("c_name") / 40.0), 6)).alias("features"))


@query("select doc_id, regexp_matches(text, '(?i)licen[cs]e') as has_license, regexp_matches(text, '[0-9]{3}') as has_number, contains(text, '@') as has_mail from documents")
def g29_context_flags(spark, sf):
    t = F.col("text")
    return docs(spark, sf).select("doc_id", t.rlike("(?i)licen[cs]e").alias("has_license"), t.rlike("[0-9]{3}").alias("has_number"), F.contains(t, F.lit("@")).alias("has_mail"))


@query("select o_orderkey, cast(('0x' || substring(sha256(concat('run', o_orderkey, ':', o_orderpriority)), 1, 8))::bigint % 100 as int) as bucket from orders")
def g24_canary_bucket(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", R.canary_bucket(F.concat(F.lit("run"), F.col("o_orderkey").cast("string")), F.col("o_orderpriority")).alias("bucket"))


@query("select l_orderkey, l_linenumber, least(30000.0, 1000 * pow(2.0, l_linenumber)) as delay_ms from lineitem")
def g47_retry_delay(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", R.retry_delay(F.col("l_linenumber")).alias("delay_ms"))


@query("select c_custkey, case c_custkey % 4 when 0 then concat('/a/', c_custkey) when 1 then concat('../', c_custkey, '/x') when 2 then '/z' else '.' end as path from customer")
def g56_normalize_path(spark, sf):
    k = F.col("c_custkey").cast("string")
    raw = F.element_at(F.array(F.concat(F.lit("/a/./b/../"), k, F.lit("//")), F.concat(F.lit("a/../../"), k, F.lit("/x")), F.lit("/../y/../z"), F.lit("./")), (F.col("c_custkey") % 4 + 1).cast("int"))
    return table(spark, sf, "customer").select("c_custkey", R.normalize_path(raw).alias("path"))


@query("select doc_id, list_transform(list_distinct_ordered, lambda v: concat('number:', v)) as found from (select doc_id, list_filter(ns, lambda v, i: list_position(ns, v) = i) as list_distinct_ordered from (select doc_id, regexp_extract_all(substring(text, 1, 0) || ' ' || n_chars || ' and ' || doc_id || ' and ' || n_chars, '[0-9]+') as ns from documents))")
def g25_u2_entities(spark, sf):
    raw = F.concat(F.lit(" "), F.col("n_chars").cast("string"), F.lit(" and "), F.col("doc_id").cast("string"), F.lit(" and "), F.col("n_chars").cast("string"))
    return docs(spark, sf).select("doc_id", R.entities(raw).alias("found"))


@query("select c_custkey, concat(repeat('█', cast(floor(p * 20 / 100 + 0.5) as int)), repeat('░', 20 - cast(floor(p * 20 / 100 + 0.5) as int)), ' ', p, '%') as bar from (select c_custkey, cast(floor((c_custkey % 41) / 40 * 100 + 0.5) as bigint) as p from customer)")
def g50_progress_bar(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", R.progress_bar(F.col("c_custkey") % 41, F.lit(40)).alias("bar"))


@query("select doc_id, regexp_replace(regexp_replace(text, '[0-9]+', '#', 'g'), '#,#', '##', 'g') as value, [len(regexp_extract_all(text, '[0-9]+')), len(regexp_extract_all(regexp_replace(text, '[0-9]+', '#', 'g'), '#,#'))] as counts from documents")
def g42_replace_with_counts(spark, sf):
    value, counts = R.replaced_with_counts(F.col("text"), [("[0-9]+", "#"), ("#,#", "##")])
    return docs(spark, sf).select("doc_id", value.alias("value"), counts.alias("counts"))


@query("select doc_id, array_to_string(list_sort([lang, source, 'k']), '|') as key from documents")
def g46_cache_key(spark, sf):
    return docs(spark, sf).select("doc_id", O.cache_key(F.col("lang"), F.col("source"), F.lit("k")).alias("key"))


ARTIFACTS = "select doc_id, case when doc_id % 5 = 0 then concat(text, ' ') else text end as made_of, doc_id % 7 <> 0 as validated from documents where doc_id % 3 <> 0"


@query(f"with a as (select doc_id, sha256(made_of) as h, validated from ({ARTIFACTS})) select d.doc_id, coalesce(validated and h = sha256(text), false) as reusable from documents d left join a using (doc_id)")
def g45_artifact_reuse(spark, sf):
    """Stored artifacts of documents: some missing, some of a text that changed since, some never validated."""
    stored = derived(spark, sf, ARTIFACTS, "documents").select("doc_id", F.sha2(F.col("made_of").cast("binary"), 256).alias("sha256"), "validated")
    return O.reusable(docs(spark, sf), stored, "doc_id", "text")


@query("select doc_id, cast(ceil(length(text) * 0.25) as bigint) as tokens, case when length(text) < 100 then 'small' when length(text) < 500 then 'medium' when length(text) < 2000 then 'large' else 'huge' end as size from documents")
def g17_token_estimate(spark, sf):
    return docs(spark, sf).select("doc_id", O.token_estimate(F.col("text")).alias("tokens"), O.size_class(F.col("text")).alias("size"))


@query("select doc_id, list_filter([case when regexp_matches(lower(text), 'license') then 'legal' end, case when regexp_matches(text, '[0-9]{3}') then 'numbers' end, case when contains(text, '@') then 'contact' end], lambda x: x is not null) as labels from documents")
def g55_multi_label(spark, sf):
    return docs(spark, sf).select("doc_id", O.labels(F.col("text"), [("legal", "(?i)license"), ("numbers", "[0-9]{3}"), ("contact", "@")]).alias("labels"))


@query("select event_id, hour(ts) = user_id % 24 and minute(ts) = event_id % 60 and (user_id % 3 = 0 or dayofweek(ts) = event_id % 7) as due from events where user_id % 24 = hour(ts) union all select -1 - event_id, hour(ts) = hour(ts) and (user_id % 3 = 0 or dayofweek(ts) = event_id % 7) from events")
def g23_schedule_due(spark, sf):
    """Schedules of users at the times of events, most at other hours; then each at its own minute, two thirds on one weekday only."""
    e = table(spark, sf, "events")
    weekday = F.when(F.col("user_id") % 3 != 0, (F.col("event_id") % 7).cast("int"))
    first = e.where(F.col("user_id") % 24 == F.hour("ts")).select("event_id", O.due(F.col("ts"), F.col("user_id") % 24, F.col("event_id") % 60, weekday).alias("due"))
    return first.unionByName(e.select((-1 - F.col("event_id")).alias("event_id"), O.due(F.col("ts"), F.hour("ts"), F.minute("ts"), weekday).alias("due")))


@query("select doc_id, case regexp_extract(text, '(?i)licensed under ([a-z]+)', 1) when 'CC' then 'open' when 'the' then 'named' else 'other' end as branch from documents")
def g58_condition_branch(spark, sf):
    return docs(spark, sf).select("doc_id", O.branch(F.col("text"), "(?i)licensed under ([a-z]+)", {"CC": "open", "the": "named"}, "other").alias("branch"))


TEMPLATES = [("ja", "BUILDING", "建物 {n} {name}"), ("en", "BUILDING", "building {n}"), ("en", "MACHINERY", "{name} has {n} of {n}"), ("ja", "MACHINERY", "機械"), ("en", "FURNITURE", "{other}")]
_template = lambda where: "case " + " ".join(f"when {where} and k = '{k}' then '{t}'" for loc, k, t in TEMPLATES if loc == ("ja" if "ja" in where else "en")) + " end"


@query(f"""with c as (select c_custkey, c_name, c_mktsegment as k, case c_custkey % 3 when 0 then 'ja' when 1 then 'en' else 'fr' end as l from customer)
  select c_custkey, replace(replace(coalesce({_template("l = 'ja'")}, {_template("l <> ''")}, k), '{{n}}', cast(c_custkey as varchar)), '{{name}}', c_name) as message from c""")
def g49_localized(spark, sf):
    """Three locales over two sets of templates; a key without a template is its own message."""
    texts = spark.createDataFrame(TEMPLATES, "locale string, key string, template string")
    locale = F.element_at(F.array(F.lit("ja"), F.lit("en"), F.lit("fr")), (F.col("c_custkey") % 3 + 1).cast("int"))
    rows = table(spark, sf, "customer").withColumn("locale_of", locale)
    return O.localized(rows, texts, "c_mktsegment", "locale_of", {"n": F.col("c_custkey").cast("string"), "name": F.col("c_name")}).select("c_custkey", "message")


ERRORS = (("timeout", "時間切れ"), ("not found", "見つかりません"), ("permission", "権限"))


@query("select o_orderkey, case o_orderkey % 4 when 0 then '時間切れ' when 1 then '見つかりません' when 2 then '権限' else 'odd' end as message from orders")
def f34_localized_error(spark, sf):
    raw = F.element_at(F.array(*map(F.lit, ("Timeout!", "file NOT FOUND", "Permission denied", "odd"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    out = raw
    for pattern, text in reversed(ERRORS):
        out = F.when(raw.rlike(f"(?i){pattern}"), text).otherwise(out)
    return table(spark, sf, "orders").select("o_orderkey", out.alias("message"))


@query("select o_orderkey from orders order by case o_orderpriority when '1-URGENT' then 0 when '2-HIGH' then 1 when '3-MEDIUM' then 2 else 3 end, o_orderkey limit 100")
def t4_priority_order(spark, sf):
    name = F.when(F.col("o_orderpriority") == "1-URGENT", "critical").when(F.col("o_orderpriority") == "2-HIGH", "high").when(F.col("o_orderpriority") == "3-MEDIUM", "medium")
    return by_priority(table(spark, sf, "orders").withColumn("priority", name), "priority", "o_orderkey").limit(100).select("o_orderkey")


@query("select c_custkey, len(list_filter(['a', 'b'], lambda t: not list_contains(tags, t))) = 0 as has_all, list_has_any(tags, ['b', 'z']) as has_any from (select c_custkey, case c_custkey % 3 when 0 then ['a', 'b'] when 1 then ['b'] else ['c'] end as tags from customer)")
def u4_set_tests(spark, sf):
    k = F.col("c_custkey") % 3
    tags = F.when(k == 0, F.array(F.lit("a"), F.lit("b"))).when(k == 1, F.array(F.lit("b"))).otherwise(F.array(F.lit("c")))
    return table(spark, sf, "customer").select("c_custkey", holds_words(tags, all_of=("a", "b")).alias("has_all"), holds_words(tags, any_of=("b", "z")).alias("has_any"))
