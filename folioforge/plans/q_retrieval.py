"""Queries over memory entries and requests derived from documents and benchmark."""

from pyspark.sql import functions as F

from ..operators import retrieval as R
from .registry import derived, query, table

NOW = 1_700_000_000_000
MEMORY = (
    f"select doc_id as id, case when doc_id % 3 = 0 then 'long' else 'short' end as namespace, substring(text, 1, 120) as summary, text as content, array(lang, source) as tags, {NOW} - doc_id * 900000 as created_at, "
    f"case when doc_id % 4 = 0 then {NOW} - 1 when doc_id % 4 = 1 then {NOW} + 5 when doc_id % 4 = 2 then 0 end as expires_at, case when doc_id % 2 = 0 then 0.5D end as importance from documents"
)
MEMORY_DUCK = MEMORY.replace("array(lang, source)", "[lang, source]").replace("0.5D", "0.5::double")
WITH = f"with memory as ({MEMORY_DUCK}) "
ALIVE = f"(expires_at is null or expires_at = 0 or expires_at >= {NOW})"


def memory(spark, sf):
    return derived(spark, sf, MEMORY, "documents")


QUERY = "The license and the end of en src1!"
TOKENS = ["the", "license", "and", "the", "end", "of", "en", "src1"]


def _score_sql():
    list_ = "[" + ", ".join(f"'{t}'" for t in TOKENS) + "]"
    part = lambda test: f"len(list_filter({list_}, lambda t: {test})) / {len(TOKENS)}.0"
    return f"""least(1.0, {part('contains(lower(summary), t)')} * 0.4 + {part('contains(lower(content), t)')} * 0.25 + {part('contains(lower(tags[1]), t) or contains(lower(tags[2]), t)')} * 0.2
      + greatest(0, 0.1 - ({NOW} - created_at) / 3600000.0 * 0.001) + coalesce(importance, 0) * 0.05)"""


def scored(spark, sf):
    c = F.col
    return memory(spark, sf).withColumn("score", F.round(R.memory_score(R.query_tokens(F.lit(QUERY)), c("summary"), c("content"), c("tags"), c("created_at"), c("importance"), F.lit(NOW)), 8))


@query(f"{WITH} select id, round({_score_sql()}, 8) as score from memory")
def g1_memory_score(spark, sf):
    return scored(spark, sf).select("id", "score")


@query(f"{WITH} select id, round({_score_sql()}, 8) as score from memory where {ALIVE} and namespace = 'short' order by 2 desc, 1 limit 10")
def t1_memory_search(spark, sf):
    """Filter, score, top-k: the k best are kept per task, never a full sort."""
    live = scored(spark, sf).where(R.alive(F.col("expires_at"), F.lit(NOW)) & (F.col("namespace") == "short"))
    return R.top(live, 10, "score", "id").select("id", "score")


@query(f"{WITH} select id from memory where {ALIVE}")
def p5_alive(spark, sf):
    return memory(spark, sf).where(R.alive(F.col("expires_at"), F.lit(NOW))).select("id")


@query(f"{WITH} select id from memory where list_has_any(list_transform(tags, lambda t: lower(t)), ['de', 'src2'])")
def p6_any_tag(spark, sf):
    return memory(spark, sf).where(R.any_tag(F.col("tags"), ["DE", "Src2"])).select("id")


@query(f"{WITH} select id, created_at from memory order by created_at desc, id limit 50")
def t3_latest_entries(spark, sf):
    return memory(spark, sf).orderBy(F.desc("created_at"), "id").limit(50).select("id", "created_at")


@query(f"{WITH} select namespace, count(*) as entries from memory group by 1")
def a20_namespace_counts(spark, sf):
    return memory(spark, sf).groupBy("namespace").agg(F.count("*").alias("entries"))


@query(f"{WITH} select id, case when id = 7 then 1.0 else round({_score_sql()}, 8) end as score from memory")
def g3_direct_hit(spark, sf):
    """An exact id is found without scoring, and stands with all other scored rows."""
    m = scored(spark, sf)
    return m.where("id = 7").select("id", F.lit(1.0).alias("score")).unionByName(m.where("id <> 7").select("id", "score"))


@query("select item_id, list_filter(string_split_regex(regexp_replace(lower(text), '[^\\w\\s　぀-ゟ゠-ヿ一-龯]', ' ', 'g'), '[\\s　]+'), lambda t: length(t) > 1) as tokens from benchmark")
def g2_query_tokens(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", R.query_tokens(F.col("text")).alias("tokens"))


@query("""with h as (select doc_id, text, substring(text, 1, 100) as h from documents), p as (select *, length(h) - strpos(reverse(h), ' ') as cut from h)
  select doc_id, case when length(text) <= 100 then text else concat(case when contains(h, ' ') and cut > 80 then substring(h, 1, cut) else h end, '...') end as summary from p""")
def g4_summary(spark, sf):
    return table(spark, sf, "documents").select("doc_id", R.summary_of(F.col("text"), 100).alias("summary"))


@query("select doc_id, case when length(text) > 300 then concat(substring(text, 1, 300), '...') else text end as preview from documents")
def g5_preview(spark, sf):
    return table(spark, sf, "documents").select("doc_id", R.preview(F.col("text"), 300).alias("preview"))


LOG = (
    "select event_id as line_no, user_id as id, case event_type when 'error' then 'delete' when 'signup' then 'add' else 'update' end as op, concat(event_type, cast(event_id as string)) as entry, "
    "cast(event_id % 50 as bigint) as timestamp from events"
)
LAST = f"with log as ({LOG}), s as (select id, arg_max({{'op': op, 'entry': entry}}, timestamp * 1000000000 + line_no) as s from log group by id) select id, s.entry as entry from s where s.op <> 'delete'"


@query(LAST)
def s19_replay_log(spark, sf):
    return R.replay(derived(spark, sf, LOG, "events"))


@query(f"select count(*) as live_entries from ({LAST})")
def k14_compaction(spark, sf):
    return R.replay(derived(spark, sf, LOG, "events")).agg(F.count("*").alias("live_entries"))


TOOLS = [("search", "find documents and pages by words", ["find", "query", "the"]), ("ledger", "billing and invoice reports", ["cost", "money"]), ("andes", "maps and travel of all kinds", ["and", "road"])]


def _tool_sql(name, description, tags):
    words = lambda s: [w for w in s.split() if len(w) > 2]
    lst = lambda x: "[" + ", ".join(f"'{t}'" for t in x) + "]"
    part = lambda x: f"len(list_filter(q, lambda t: len(list_filter({lst(x)}, lambda w: contains(w, t) or contains(t, w))) > 0)) / len(q)"
    return f"case when len(q) = 0 then 0 else least(1.0, {part(tags)} * 0.5 + {part(words(description))} * 0.35 + {part(words(name))} * 0.15 + case when list_has_any(q, {lst(tags)}) then 0.2 else 0 end + case when contains(lower(text), '{name}') then 0.3 else 0 end) end"


ROUTED = f"""with q as (select item_id, text, list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda t: length(t) > 2) as q from benchmark),
  s as ({' union all '.join(f"select item_id, {k} as ord, '{n}' as name, round({_tool_sql(n, d, t)}, 8) as score from q" for k, (n, d, t) in enumerate(TOOLS))})"""


@query(f"{ROUTED} select item_id, name, score from s")
def g6_tool_score(spark, sf):
    out = R.match_tools(table(spark, sf, "benchmark"), TOOLS, 0.0, 9, "item_id")
    return out.withColumn("score", F.round("score", 8))


@query(f"{ROUTED}, r as (select *, row_number() over (partition by item_id order by score desc, ord) as k from s where score >= 0.1) select item_id, name, score from r where k <= 2")
def j7_match_tools(spark, sf):
    out = R.match_tools(table(spark, sf, "benchmark"), TOOLS, 0.1, 2, "item_id")
    return out.withColumn("score", F.round("score", 8))


_rule = lambda w, p: "(" + " or ".join(f"contains(lower(text), '{x}')" for x in w) + f" or regexp_matches(text, '(?i){'|'.join(p)}'))"
_rules = sorted(R.SAFETY, key=lambda r: r[3] != "deny")
REQUESTS = "select doc_id, concat(text, case doc_id % 7 when 0 then ' please DELETE all rows' when 1 then ' bypass the captcha and drop table x' when 2 then ' cancel subscription' when 3 then ' grant admin role' else '' end) as text from documents"
CATEGORY = "case " + " ".join(f"when {_rule(w, p)} then '{n}'" for n, w, p, _ in _rules) + " end"
ACTION = "case " + " ".join(f"when {_rule(w, p)} then '{a}'" for _, w, p, a in _rules) + " end"


@query(f"with q as ({REQUESTS}) select doc_id, {CATEGORY} as category, {ACTION} as action from q")
def g8_j8_safety(spark, sf):
    category, action = R.safety(F.col("text"))
    return derived(spark, sf, REQUESTS, "documents").select("doc_id", category.alias("category"), action.alias("action"))


@query(f"with q as ({REQUESTS}) select doc_id, case when {CATEGORY} is not null then {ACTION} when doc_id % 10 >= 3 then 'allow' else 'fallback' end as decision from q")
def g7_route(spark, sf):
    category, action = R.safety(F.col("text"))
    return derived(spark, sf, REQUESTS, "documents").select("doc_id", R.route(category, action, F.col("doc_id") % 10 / 10.0).alias("decision"))


_stop = "(" + ", ".join(f"'{w}'" for w in R.STOP_WORDS) + ")"


@query(f"""with w as (select doc_id, unnest(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' ')) as word from documents), c as (select doc_id, word, count(*) as n from w where length(word) > 2 and word not in {_stop} group by 1, 2),
  r as (select *, row_number() over (partition by doc_id order by n desc, word) as k from c) select doc_id, list(word order by k) as keywords from r where k <= 10 group by 1""")
def a21_j5_keywords(spark, sf):
    return R.keywords(table(spark, sf, "documents"), "doc_id", "text")


MD = "select doc_id, concat('intro', chr(10), '## A', chr(10), source, ' one two three', chr(10), 'more', chr(10), '## B', chr(10), 'x', chr(10), '## A', chr(10), lang, ' again and again') as text from documents"


@query(f"with m as ({MD}) select doc_id, 'A' as name, concat(regexp_extract(text, '(..) again', 1), ' again and again') as body from m")
def s22_sections(spark, sf):
    return R.sections(derived(spark, sf, MD, "documents"), "doc_id", "text")
