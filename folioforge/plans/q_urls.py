"""Queries over pages and their URLs."""

from pyspark.sql import functions as F

from ..operators import ops as O
from ..operators import urls as U
from .registry import derived, query, table

RAW = "select page_id, case page_id % 5 when 0 then concat(' HTTPS://Example.COM/a/?utm_source=x&q=', cast(page_id % 20 as string), '&ref=1 ') when 1 then concat('http://b.org/x/', cast(page_id % 7 as string), '/#top') when 2 then 'not a url' when 3 then url else concat('https://c.net?gclid=1&z=', cast(page_id % 3 as string)) end as url from pages"
_track = "(" + ", ".join(f"'{t}'" for t in U.TRACKING) + ")"
PARTS = f"""with r as (select page_id, trim(url) as u from ({RAW}) x), p as (select page_id, u, lower(regexp_extract(u, '^([a-zA-Z]+)://', 1)) as s, lower(regexp_extract(u, '^[a-zA-Z]+://([^/?#]+)', 1)) as h, regexp_extract(u, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) as path,
  regexp_extract(u, '\\?([^#]*)', 1) as q, case when contains(u, '#') then regexp_extract(u, '#(.*)$', 1) end as f from r),
  k as (select *, array_to_string(list_filter(string_split(q, '&'), lambda x: x <> '' and string_split(x, '=')[1] not in {_track}), '&') as kept, case when path = '' then '/' when path <> '/' and ends_with(path, '/') then substring(path, 1, length(path) - 1) else path end as np from p),
  n as (select page_id, u, h as domain, case when h <> '' then concat(s, '://', h, np, case when kept <> '' then concat('?', kept) else '' end, case when f is not null then concat('#', f) else '' end) end as url from k)"""


def raw(spark, sf):
    return derived(spark, sf, RAW, "pages")


@query(f"{PARTS} select page_id, url from n")
def g18_normalize_url(spark, sf):
    return raw(spark, sf).select("page_id", U.normalize_url(F.col("url")).alias("url"))


BUNDLE = f"{PARTS}, b as (select min(page_id) as page_id, url, min(domain) as domain from n where url is not null group by url)"


@query(f"{BUNDLE} select * from b")
def u2_bundle(spark, sf):
    return U.bundle(raw(spark, sf), "url", "page_id")


@query(f"{BUNDLE} select * from b order by page_id limit 20")
def t5_capped_bundle(spark, sf):
    return U.bundle(raw(spark, sf), "url", "page_id", 20)


@query(f"{BUNDLE} select domain, count(*) as urls from b group by 1 order by 2 desc, 1 limit 10")
def a22_domain_counts(spark, sf):
    return U.domain_counts(U.bundle(raw(spark, sf), "url", "page_id"))


@query(f"{PARTS} select page_id from n where contains(domain, 'example') or contains(domain, 'org')")
def p7_domain_include(spark, sf):
    return raw(spark, sf).where(U.domain_filter(F.col("url"), include=("example", "org"))).select("page_id")


@query(f"{PARTS} select page_id from n where not contains(domain, 'example') and not regexp_matches(u, '(?i)x/[0-3]')")
def p7_u3_domain_exclude(spark, sf):
    return raw(spark, sf).where(U.domain_filter(F.col("url"), exclude=("example",), patterns=("x/[0-3]",))).select("page_id")


LISTS = "select page_id, case page_id % 4 when 0 then concat('[\"http://a.b/', cast(page_id as string), '\", \"http://c.d\"]') when 1 then concat('{\"tabs\": [{\"url\": \"http://t/', cast(page_id as string), '\"}, {\"href\": \"http://h\"}]}') when 2 then concat('http://x, http://y', chr(10), ' http://z/', cast(page_id as string)) else '{\"urls\": [\"http://u\"]}' end as text from pages"


@query("select page_id, unnest(case page_id % 4 when 0 then [concat('http://a.b/', page_id), 'http://c.d'] when 1 then [concat('http://t/', page_id), 'http://h'] when 2 then ['http://x', 'http://y', concat('http://z/', page_id)] else ['http://u'] end) as url from pages")
def s21_url_lists(spark, sf):
    return derived(spark, sf, LISTS, "pages").select("page_id", F.explode(U.parse_url_list(F.col("text"))).alias("url"))


_s = lambda x: f"regexp_replace({x}, '^[\\s　]+|[\\s　]+$', '', 'g')"
TITLE = _s("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")
_text = "html"
for _tag in ("script", "style", "nav", "header", "footer"):
    _text = f"regexp_replace({_text}, '(?is)<{_tag}[^>]*>.*?</{_tag}>', ' ', 'g')"
_text = f"regexp_replace(regexp_replace(regexp_replace({_text}, '<[^>]+>', ' ', 'g'), '[\\s　]+', ' ', 'g'), '^ | $', '', 'g')"


@query(f"select page_id, {TITLE} as title from pages")
def s10_page_title(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.page_title(F.col("html")).alias("title"))


@query("select page_id, case page_id % 3 when 2 then '' else regexp_extract(html, 'lang=.([a-z]+)', 1) end as author from pages")
def s10_page_author(spark, sf):
    """Every third page names no author; the others name their language as one, with the attributes in either order."""
    lang = F.regexp_extract("html", "lang=.([a-z]+)", 1)
    meta = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("<meta name='author' content='"), lang, F.lit("'>"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit('<META content="'), lang, F.lit('" name=author>'))).otherwise(F.lit('<meta name="authority" content="x">'))
    page = F.replace("html", F.lit("</head>"), F.concat(meta, F.lit("</head>")))
    return table(spark, sf, "pages").select("page_id", U.page_author(page).alias("author"))


@query(f"select page_id, {_text} as text from pages")
def s10_page_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.page_text(F.col("html")).alias("text"))


@query(f"select page_id, concat({TITLE}, ' (', lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)), ')', chr(10), substring({_text}, 1, 300)) as summary from pages")
def g53_page_summary(spark, sf):
    h = F.col("html")
    return table(spark, sf, "pages").select("page_id", U.page_summary(U.page_title(h), F.col("url"), U.page_text(h)).alias("summary"))


LINKS = "regexp_extract_all(html, '(?i)<a[^>]+href=[\"'']([^\"'']+)[\"'']', 1)"
_h = lambda x: f"lower(regexp_extract({x}, '^[a-zA-Z]+://([^/?#]+)', 1))"


@query(f"""with l as (select page_id, {_h('url')} as own, list_filter({LINKS} || [url, 'http://other.example/x', '/relative'], lambda x: {_h('x')} <> '') as links from pages)
  select page_id, list_filter(links, lambda x: {_h('x')} = own)[1:5] as internal, list_filter(links, lambda x: {_h('x')} <> own)[1:5] as external from l""")
def g52_links_by_side(spark, sf):
    pages = table(spark, sf, "pages")
    links = F.concat(U.links_of(F.col("html")), F.array("url", F.lit("http://other.example/x"), F.lit("/relative")))
    return U.links_by_side(pages.withColumn("links", links), "page_id", "url", "links")


CONV = "select o_orderkey as id, o_custkey as user_id, o_orderdate as created_at, case when o_orderkey % 3 = 0 then o_orderdate end as deleted_at, o_orderstatus as status from orders"


@query(f"with c as ({CONV}) select id from c where deleted_at is null order by created_at desc, id limit 20")
def p8_live_conversions(spark, sf):
    return U.soft_deleted(derived(spark, sf, CONV, "orders"), False).select("id")


@query(f"with c as ({CONV}) select id from c where deleted_at is not null order by deleted_at desc, id limit 20")
def p8_trash(spark, sf):
    return U.soft_deleted(derived(spark, sf, CONV, "orders"), True).select("id")


@query(f"with c as ({CONV}) select id, c_name from c join customer on user_id = c_custkey and c_nationkey = 3")
def j10_owner(spark, sf):
    owner = table(spark, sf, "customer").where("c_nationkey = 3")
    return O.owned(derived(spark, sf, CONV, "orders"), owner, "user_id", "c_custkey").select("id", "c_name")


@query(f"with c as ({CONV}) select status, count(*) as n, count(deleted_at) as deleted from c group by 1")
def s20_conversion_store(spark, sf):
    return O.conversion_counts(derived(spark, sf, CONV, "orders"))


@query("select c_custkey, case when c_custkey % 3 = 0 then upper(c_name) else c_name end as c_name from customer union all select c_custkey + 10000000, upper(c_name) from customer where c_custkey % 50 = 1")
def k16_upsert(spark, sf):
    old = table(spark, sf, "customer").select("c_custkey", "c_name")
    new = old.where("c_custkey % 3 = 0").union(old.where("c_custkey % 50 = 1").select(F.col("c_custkey") + 10_000_000, "c_name")).select("c_custkey", F.upper("c_name").alias("c_name"))
    return U.upsert(old, new, "c_custkey")


@query("select c_name as name, case when c_custkey % 10 = 0 then 'over' when c_custkey % 4 = 0 then 'local' else 'base' end as url, case when c_custkey % 10 = 0 then false when c_custkey % 4 = 0 then true else true end as enabled from customer")
def s24_merged_config(spark, sf):
    c = table(spark, sf, "customer")
    layer = lambda df, url, on: df.select(F.col("c_name").alias("name"), F.lit(url).alias("url"), F.lit(on).cast("boolean").alias("enabled"))
    unknown = spark.createDataFrame([("nobody", "x", True)], "name string, url string, enabled boolean")
    return U.merged_config(layer(c, "base", True), layer(c.where("c_custkey % 4 = 0"), "local", None), layer(c.where("c_custkey % 10 = 0"), "over", False).union(unknown))


@query("with p as (select p_partkey, p_name, p_type, p_retailprice from part) select n, total from (select count(*) over () as total, p_name as n from p where contains(lower(p_type), 'e') order by p_name limit 10)")
def g51_skill_search(spark, sf):
    found = table(spark, sf, "part").where(F.contains(F.lower("p_type"), F.lit("e")))
    total = found.agg(F.count("*").alias("total"))
    return found.orderBy("p_name").limit(10).select(F.col("p_name").alias("n")).join(total, F.lit(True))  # ten rows and one


@query("select s_suppkey, s_name, n_name, r_name from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def j14_member_paths(spark, sf):
    s, n, r = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "s_name", "n_name", "r_name")


@query("select doc_id, list_has_any(string_split(source, ' '), ['src1', 'src3']) as known from documents")
def j13_baseline_files(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.arrays_overlap(F.split("source", " "), F.array(F.lit("src1"), F.lit("src3"))).alias("known"))


@query("""select o_orderkey, case o_orderstatus when 'F' then 'line' when 'O' then 'email' end as channel, case when o_orderstatus = 'F' and o_orderkey % 2 = 0 then 'small' when o_orderstatus = 'O' and o_orderkey % 2 = 1 then 'large' else 'medium' end as model,
  case o_orderpriority when '1-URGENT' then 'review' when '2-HIGH' then 'build' else 'end' end as next from orders""")
def j9_rule_lookup(spark, sf):
    """Rank to channel, complexity to model by two keys with a default, phase to branch."""
    orders = table(spark, sf, "orders").withColumn("odd", F.col("o_orderkey") % 2)
    out = O.rule_lookup(orders, spark.createDataFrame([("F", "line"), ("O", "email")], "o_orderstatus string, channel string"), ["o_orderstatus"], "channel")
    out = O.rule_lookup(out, spark.createDataFrame([("F", 0, "small"), ("O", 1, "large")], "o_orderstatus string, odd long, model string"), ["o_orderstatus", "odd"], "model", F.lit("medium"))
    out = O.rule_lookup(out, spark.createDataFrame([("1-URGENT", "review"), ("2-HIGH", "build")], "o_orderpriority string, next string"), ["o_orderpriority"], "next", F.lit("end"))
    return out.select("o_orderkey", "channel", "model", "next")
