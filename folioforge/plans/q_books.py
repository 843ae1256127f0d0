"""Queries over books derived from documents."""

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import books as B
from .q_text import PART, clean_sql, level_sql, ruby_sql, rx, strip_sql, title_sql, EMPH, NOTE, SPLIT
from .registry import ORACLE, derived, query, table

BOOKS = (
    "select doc_id, concat('Title ', source, chr(10), case when doc_id % 3 = 0 then chr(10) else '' end, case when doc_id % 2 = 0 then concat('まえがき', chr(10), 'first & \"line\"', chr(10), chr(10)) else '' end, "
    "'第1章 ', lang, chr(10), text, chr(10), chr(10), 'second <b>', chr(10), case when doc_id % 5 = 0 then concat('Chapter 2', chr(10)) else '' end, 'Chapter 3', chr(10), 'end of ', lang, chr(10), 'あとがき', chr(10), 'bye') as text from documents"
)
W = f"""with b as ({BOOKS}), l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) as pos from b),
  f as (select *, pos > 0 and regexp_matches({strip_sql('line')}, '{X.HEADING}') as is_head from l), s as (select *, sum(cast(is_head as int)) over (partition by doc_id order by pos) as sec from f),
  g as (select doc_id, sec, arg_max({strip_sql('line')}, pos) filter (is_head or pos = 0) as title, coalesce(list(line order by pos) filter (pos > 0 and not is_head), []) as body_lines from s group by 1, 2),
  c as (select doc_id, cast(row_number() over (partition by doc_id order by sec) as int) as idx, title, body_lines from g where len(body_lines) > 0), ch as (select *, concat('chapter', lpad(cast(idx as string), 3, '0')) as chapter_id from c)"""
PARA = f""", r as (select doc_id, idx, unnest(body_lines) as line, unnest(generate_series(0, len(body_lines) - 1)) as pos from ch), k as (select *, {strip_sql('line')} = '' as blank from r),
  q as (select *, sum(case when not blank and coalesce(pb, true) then 1 else 0 end) over (partition by doc_id, idx order by pos) as para from (select *, lag(blank) over (partition by doc_id, idx order by pos) as pb from k)),
  pa as (select doc_id, idx, para, concat('<p>', string_agg(replace(replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '<br/>' order by pos), '</p>') as html from q where not blank group by 1, 2, 3)"""
ESC = "replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


def chapters(spark, sf, sql=BOOKS):
    return B.text_chapters(derived(spark, sf, sql, "documents"))


def html_chapters(spark, sf, sql=BOOKS):
    return B.with_html(chapters(spark, sf, sql))


def books(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.concat(F.lit("Title "), "source").alias("title"), F.col("lang").alias("author"), F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("uid"))


@query(f"{W} select doc_id, pos, line from l")
def s1_lines(spark, sf, sql=BOOKS):
    return B.lines(derived(spark, sf, sql, "documents"))


@query(f"{W} select doc_id, idx, chapter_id, title, body_lines from ch")
def s7_w1_w2_chapters(spark, sf, sql=BOOKS):
    return chapters(spark, sf, sql)


@query(f"{W}{PARA} select * from pa")
def w8_paragraphs(spark, sf, sql=BOOKS):
    return B.paragraphs(chapters(spark, sf, sql))


@query(f"{W} select doc_id, chapter_id, lag(chapter_id) over w as prev_id, lead(chapter_id) over w as next_id from ch window w as (partition by doc_id order by idx)")
def w3_neighbours(spark, sf, sql=BOOKS):
    return B.neighbours(chapters(spark, sf, sql)).select("doc_id", "chapter_id", "prev_id", "next_id")


@query(f"{W}, t as (select doc_id, idx, chapter_id, {strip_sql('title')} as t from ch), p as (select *, {PART} as part from t) select doc_id, arg_min(chapter_id, idx) filter (part = 'frontmatter') as front, coalesce(arg_min(chapter_id, idx) filter (part = 'bodymatter'), arg_min(chapter_id, idx)) as body, arg_min(chapter_id, idx) filter (part = 'backmatter') as back from p group by 1")
def w5_landmarks(spark, sf, sql=BOOKS):
    return B.landmarks(chapters(spark, sf, sql))


@query(f"""{W} select doc_id, string_agg(concat('      <li><a href="Text/', chapter_id, '.xhtml">', {ESC.format('title')}, '</a></li>'), chr(10) order by idx) as toc from ch group by 1""")
def k3_nav(spark, sf, sql=BOOKS):
    return B.nav(chapters(spark, sf, sql))


@query(f"{W}, p as (select doc_id, idx, chapter_id, unnest([title, concat('h', idx)]) as label, unnest([1, 2]) as level from ch) select doc_id, cast(row_number() over (partition by doc_id order by idx, level) as int) as play_order, chapter_id, label, level from p")
def w4_k4_play_order(spark, sf, sql=BOOKS):
    html = chapters(spark, sf, sql).withColumn("html", F.concat(F.lit("<h2 id='a'>h"), F.col("idx").cast("string"), F.lit("</h2>")))
    return B.play_order(html)


OPF = f"""{W}, m as (select doc_id, string_agg(concat('    <item id="', chapter_id, '" href="Text/', chapter_id, '.xhtml" media-type="application/xhtml+xml"/>'), chr(10) order by idx) as manifest, string_agg(concat('    <itemref idref="', chapter_id, '"/>'), chr(10) order by idx) as spine from ch group by 1),
  o as (select d.doc_id, concat('<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="uid">', chr(10), '  <metadata xmlns:dc="http://purl.org/dc/elements/1.1/">', chr(10), '    <dc:identifier id="uid">urn:uuid:u', d.doc_id, '</dc:identifier>', chr(10), '    <dc:title>Title ', source, '</dc:title>', chr(10), '    <dc:creator>', lang, '</dc:creator>', chr(10), '    <dc:language>ja</dc:language>', chr(10),
  '    <meta property="schema:accessMode">textual</meta>', chr(10), '    <meta name="primary-writing-mode" content="vertical-rl"/>', chr(10), '  </metadata>', chr(10), '  <manifest>', chr(10), '    <item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>', chr(10), '    <item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>', chr(10), manifest, chr(10), '  </manifest>', chr(10), '  <spine toc="ncx" page-progression-direction="rtl">', chr(10), spine, chr(10), '  </spine>', chr(10), '</package>') as opf from documents d join m on d.doc_id = m.doc_id)"""


@query(f"{OPF} select * from o")
def k2_f37_opf(spark, sf, sql=BOOKS):
    return B.opf(books(spark, sf), chapters(spark, sf, sql))


@query(f"{OPF} select doc_id, replace(regexp_replace(regexp_replace(opf, '<dc:title>[^<]*</dc:title>', '<dc:title>New</dc:title>'), '<dc:language>[^<]*</dc:language>', '<dc:language>en</dc:language>'), 'x<dc:none', '') as opf from o")
def k8_edit_metadata(spark, sf, sql=BOOKS):
    return B.opf(books(spark, sf), chapters(spark, sf, sql)).select("doc_id", B.edit_metadata(F.col("opf"), "New", None, "en").alias("opf"))


@query(f"{W}, n as (select doc_id, count(*) as n from ch group by 1) select doc_id, 5 + n as members, true as has_mimetype, true as has_container, n + 1 as n_text, cast(0 as bigint) as missing_alt, true as ok from n")
def a29_check_package(spark, sf, sql=BOOKS):
    members = B.entries(books(spark, sf), html_chapters(spark, sf, sql))
    return B.check_package(members).join(members.groupBy("doc_id").agg(F.count("*").alias("members")), "doc_id")


@query(f"{W} select doc_id, cast(unnest(range(0, 5)) as int) as ord, unnest(['mimetype', 'META-INF/container.xml', 'OEBPS/content.opf', 'OEBPS/nav.xhtml', 'OEBPS/toc.ncx']) as path, unnest([true, false, false, false, false]) as stored from (select distinct doc_id from ch) union all select doc_id, idx + 4, concat('OEBPS/Text/', chapter_id, '.xhtml'), false from ch")
def k1_entries(spark, sf, sql=BOOKS):
    return B.entries(books(spark, sf), html_chapters(spark, sf, sql)).drop("content")



HTML_SQL = f"""{W}{PARA}, bo as (select doc_id, idx, string_agg(html, concat(chr(10), '    ') order by para) as body from pa group by 1, 2),
  hx as (select ch.doc_id, ch.idx, chapter_id, title, concat('<?xml version="1.0" encoding="UTF-8"?>', chr(10), '<!DOCTYPE html>', chr(10), '<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops" xml:lang="ja" lang="ja">', chr(10), '<head>', chr(10), '  <meta charset="UTF-8"/>', chr(10), '  <title>', {ESC.format('title')}, '</title>', chr(10),
  '  <link rel="stylesheet" href="{B.STYLES[0]}"/>', chr(10), '  <link rel="stylesheet" href="{B.STYLES[1]}"/>', chr(10), '</head>', chr(10), '<body epub:type="bodymatter">', chr(10), '  <section epub:type="chapter" class="chapter-break">', chr(10), '    <h1>', {ESC.format('title')}, '</h1>', chr(10), '    ', coalesce(body, ''), chr(10), '  </section>', chr(10), '</body>', chr(10), '</html>') as html from ch left join bo on ch.doc_id = bo.doc_id and ch.idx = bo.idx)"""


@query(f"{HTML_SQL} select doc_id, chapter_id, html from hx")
def s7_chapter_html(spark, sf, sql=BOOKS):
    return html_chapters(spark, sf, sql).select("doc_id", "chapter_id", "html")


@query(f"{HTML_SQL} select doc_id, count(*) as chapters, cast(floor(sum(strlen(html)) / 1024.0) as bigint) as kb, count(*) filter (strlen(html) > 512000) as large from hx group by 1")
def a28_book_info(spark, sf, sql=BOOKS):
    return B.book_info(html_chapters(spark, sf, sql))


@query(f"{W} select doc_id, idx, concat(lpad(cast(idx as string), 3, '0'), '_', regexp_replace(title, '[^a-zA-Z0-9\\-_]', '_', 'g'), '.epub') as file_name from ch")
def k7_split_books(spark, sf, sql=BOOKS):
    return B.split_books(chapters(spark, sf, sql)).select("doc_id", "idx", "file_name")


@query(f"""{W}, t as (select doc_id, chapter_id, idx, {strip_sql('title')} as t from ch) select doc_id, chapter_id, idx, {PART} as part from (select *, t as t from t)""")
def j12_chapter_types(spark, sf, sql=BOOKS):
    return B.chapter_types(chapters(spark, sf, sql)).select("doc_id", "chapter_id", "idx", "part")


@query(f"""{W}, h as (select doc_id, idx, chapter_id, unnest(case when idx % 2 = 0 then [title, concat('h', idx, '&'), 'x'] else [title] end) as label, unnest(case when idx % 2 = 0 then [1, 2, 2] else [1] end) as level, unnest(case when idx % 2 = 0 then [0, 1, 2] else [0] end) as k from ch),
  p as (select *, cast(row_number() over (partition by doc_id order by idx, k) as string) as n, k = max(k) over (partition by doc_id, idx) as last from h),
  nb as (select doc_id, max(level) as depth, string_agg(concat('<navPoint id="n', n, '" playOrder="', n, '"><navLabel><text>', {ESC.format('label')}, '</text></navLabel><content src="Text/', chapter_id, '.xhtml"/>', case when level = 2 then '</navPoint>' else '' end, case when last then '</navPoint>' else '' end), '' order by idx, k) as body from p group by 1)
  select doc_id, concat('<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><head><meta name="dtb:uid" content="urn:uuid:u', doc_id, '"/><meta name="dtb:depth" content="', depth, '"/><meta name="dtb:totalPageCount" content="0"/><meta name="dtb:maxPageNumber" content="0"/></head><docTitle><text>Title ', source, '</text></docTitle><navMap>', body, '</navMap></ncx>') as ncx from nb join (select doc_id, source from documents) using (doc_id)""")
def k4_ncx(spark, sf, sql=BOOKS):
    """Every second chapter has two second headings."""
    heads = F.when(F.col("idx") % 2 == 0, F.concat(F.lit("<h2>h"), F.col("idx").cast("string"), F.lit("&</h2><p/><h2 id='q'>x</h2>"))).otherwise("")
    return B.ncx(books(spark, sf), chapters(spark, sf, sql).withColumn("html", heads))


@query(f"{W} select distinct doc_id, 1 as page_lists, 3 as navs from ch")
def k3_page_list(spark, sf, sql=BOOKS):
    page = B.nav_page(chapters(spark, sf, sql))
    return page.select("doc_id", F.regexp_count("page", F.lit('<nav epub:type="page-list" hidden="">')).alias("page_lists"), F.regexp_count("page", F.lit("</nav>")).alias("navs"))


@query(f"""{W}, t as (select doc_id, idx, chapter_id, {strip_sql('title')} as t from ch), p as (select *, {PART} as part from t), lm as (select doc_id, arg_min(chapter_id, idx) filter (part = 'frontmatter') as front, coalesce(arg_min(chapter_id, idx) filter (part = 'bodymatter'), arg_min(chapter_id, idx)) as body, arg_min(chapter_id, idx) filter (part = 'backmatter') as back from p group by 1)
  select doc_id, concat({", ".join(f"""case when {c} is null then '' else concat('      <li><a epub:type="{t}" href="Text/', {c}, '.xhtml">{n}</a></li>', chr(10)) end""" for c, t, n in B.LANDMARKS)}) as landmarks from lm""")
def k3_landmarks(spark, sf, sql=BOOKS):
    return B.landmark_items(chapters(spark, sf, sql))


@query(f"""{HTML_SQL}, n as (select *, lag(chapter_id) over (partition by doc_id order by idx) as p, lead(chapter_id) over (partition by doc_id order by idx) as x, {strip_sql("regexp_extract(html, '(?is)<body[^>]*>(.*?)</body>', 1)")} as body from hx)
  select doc_id, concat('<html><body><ol>', string_agg(concat('<li><a href="#', chapter_id, '">', {ESC.format('title')}, '</a></li>'), '' order by idx), '</ol>', chr(10),
    string_agg(concat('<section id="', chapter_id, '">', body, case when p is null then '' else concat('<a href="#', p, '">&lt;</a>') end, case when x is null then '' else concat('<a href="#', x, '">&gt;</a>') end, '</section>'), chr(10) order by idx), '</body></html>') as html from n group by 1""")
def k5_k15_single_html(spark, sf, sql=BOOKS):
    return B.single_html(html_chapters(spark, sf, sql))


ANN = (
    "select doc_id, concat('題', source, chr(10), case when doc_id % 2 = 0 then '' else concat('著者', lang) end, chr(10), '-----------', chr(10), '説明', chr(10), '-----------', chr(10), '［＃３字下げ］一［＃「一」は大見出し］', chr(10), '私《わたくし》は、', chr(10), lang, chr(10), chr(10), '※外字　次', chr(10), '［＃改頁］', chr(10), '二［＃「二」は中見出し］', chr(10), '終わり', chr(10), case when doc_id % 3 = 0 then '底本：x' else '' end, chr(10), case when doc_id % 3 = 0 then '入力：y' else '' end) as text from documents"
)
AW = f"""with b as ({ANN}), l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) as pos from b), s as (select *, {strip_sql('line')} as s from l),
  n as (select *, sum(cast(s <> '' as int)) over (partition by doc_id order by pos) as nth from s),
  m as (select doc_id, max(s) filter (nth = 1 and s <> '') as title, max(s) filter (nth = 2 and s <> '') as a, coalesce(max(pos) filter (regexp_matches(s, '^-{{5,}}')), -1) as rule, max(pos) + 1 as n from n group by 1),
  bf as (select *, case when rule > 0 then rule + 1 else 0 end as body_from from m), cut as (select n.doc_id, min(pos) as cut from n join bf on n.doc_id = bf.doc_id where pos - body_from > greatest(0, bf.n - body_from - 50) and regexp_matches(s, '^-{{5,}}|底本：|入力：|校正：|^[0-9]{{4}}（|^【テキスト中') group by 1),
  meta as (select bf.doc_id, title, case when length(a) < 30 and not starts_with(a, '著') then a else '' end as author, body_from, coalesce(cut, n) as body_to from bf left join cut on bf.doc_id = cut.doc_id)"""


def annotated(spark, sf):
    lined = B.lines(derived(spark, sf, ANN, "documents"))
    return lined, B.annotated_meta(lined)


@query(f"{AW} select * from meta")
def f8_annotated_meta(spark, sf):
    return annotated(spark, sf)[1]


_raw = rx("line", "[\\s　]+$", "")
_line_sql = f"case when {level_sql('raw')} <> '' then {title_sql('raw')} else {ruby_sql(clean_sql(rx(EMPH(NOTE(SPLIT('raw'))), f'［＃{X.DIGITS}字下げ］', '')))} end"


@query(f"""{AW}, x as (select l.doc_id, pos, {_raw} as raw from l join meta on l.doc_id = meta.doc_id where pos >= body_from and pos < body_to), y as (select doc_id, pos, case when raw = '' then 'blank' when {level_sql('raw')} <> '' then {level_sql('raw')} else 'p' end as kind, {strip_sql(_line_sql)} as content from x),
  z as (select * from y where kind = 'blank' or content <> ''), u as (select *, case when kind <> 'p' or coalesce(lag(kind) over (partition by doc_id order by pos), '') <> 'p' then 1 else 0 end as new from z), v as (select *, sum(new) over (partition by doc_id order by pos) as block from u)
  select doc_id, min(pos) as pos, min(kind) as kind, string_agg(content, '<br/>' order by pos) as content from v where kind <> 'blank' group by doc_id, block""")
def s8_annotated_blocks(spark, sf):
    return B.annotated_blocks(*annotated(spark, sf))


@query("select doc_id, case doc_id % 4 when 0 then 'epub' when 1 then 'md' when 2 then 'html' else 'txt' end as parser from documents")
def s2_parser_by_suffix(spark, sf):
    name = F.concat("source", F.element_at(F.array(*map(F.lit, (".EPUB", ".md", ".htm", ".xyz"))), (F.col("doc_id") % 4 + 1).cast("int")))
    ext = F.lower(F.regexp_extract(name, "\\.([^.]+)$", 1))
    kind = F.when(ext.isin("epub", "pdf", "docx", "md"), ext).when(ext.isin("html", "htm"), "html").otherwise("txt")
    return table(spark, sf, "documents").select("doc_id", kind.alias("parser"))


IMG = "select page_id as doc_id, 'chapter001' as chapter_id, concat('<img alt=\"\" src=\"../Images/i', cast(page_id % 3 as string), '.png\"/><img src=\"gone.png\"/>') as html from pages"


@query("select page_id as doc_id, 'chapter001' as chapter_id, unnest([concat('../Images/i', page_id % 3, '.png'), 'gone.png']) as src, unnest([case when page_id % 3 < 2 then concat('b/i', page_id % 3, '.png') end, null]) as href from pages")
def j1_images(spark, sf):
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"))
    images = pages.select("doc_id", F.inline(F.array(*[F.struct(F.lit(f"x{k}").alias("item_id"), F.lit(h).alias("href")) for k, h in enumerate(("a/i0.png", "b/i0.png", "a/i1.png", "b/i1.png"))])))
    return B.join_images(derived(spark, sf, IMG, "pages"), images)


@query("with r as (select conv_id as doc_id, turn as pos, cast(turn % 3 as string) as id from conversations), n as (select doc_id, id, min(pos) as p from r where id not in ('-1', '0') group by 1, 2) select doc_id, cast(row_number() over (partition by doc_id order by p) as int) as number, id, concat('note ', id) as text from n")
def j2_w6_footnotes(spark, sf):
    refs = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), (F.col("turn") % 3).cast("string").alias("id"))
    notes = refs.select("doc_id", "id").distinct().withColumn("text", F.concat(F.lit("note "), "id"))
    return B.footnotes(refs, notes)


@query("""with b as (select conv_id as doc_id, turn as pos, case turn % 4 when 0 then 'p' when 3 then 'ol' else 'ul' end as kind, role as content from conversations), l as (select *, lag(kind) over (partition by doc_id order by pos) as pk from b),
  r as (select *, sum(case when kind in ('ul', 'ol') and pk = kind then 0 else 1 end) over (partition by doc_id order by pos) as run from l) select doc_id, run, min(kind) as kind, min(pos) as pos, string_agg(content, '' order by pos) as content from r group by 1, 2""")
def w7_list_runs(spark, sf):
    blocks = derived(spark, sf, "select conv_id as doc_id, turn as pos, case turn % 4 when 0 then 'p' when 3 then 'ol' else 'ul' end as kind, role as content from conversations", "conversations")
    return B.list_runs(blocks)


PICTURES = "select page_id as doc_id, 1 as idx, concat('<p>', url, '</p><img alt=\"a\" src=\"../Images/i', page_id % 3, '.png\"/> < <img src=\"gone.png\"/>') as html from pages"


@query("select page_id as doc_id, concat('<p>', url, '</p><img alt=\"a\" src=\"', case when page_id % 3 < 2 then concat('data:image/png;base64,', to_base64(encode(concat('picture ', page_id % 3, ' of ', page_id)))) else concat('../Images/i', page_id % 3, '.png') end, '\"/> < <img src=\"gone.png\"/>') as html from pages")
def k5_inline_images(spark, sf):
    """Images are put into the pages that show them, in base64; a third of the sources have none."""
    ids = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    data = F.encode(F.concat(F.lit("picture "), F.col("k").cast("string"), F.lit(" of "), F.col("doc_id").cast("string")), "UTF-8")
    images = ids.select("doc_id", F.concat(F.lit("i"), F.col("k").cast("string"), F.lit(".png")).alias("name"), F.lit("image/png").alias("media"), data.alias("data"))
    return B.with_inline_images(derived(spark, sf, PICTURES, "pages"), images).select("doc_id", "html")


#: Packages with a member missing, compressed or out of place, and with metadata, images and alternative texts wanting, by document.
DAMAGED = """select doc_id, ord, path, stored and doc_id % 7 <> 1 as stored, case when path like '%content.opf' and doc_id % 3 = 0 then replace(replace(content, 'rtl', 'ltr'), '<dc:creator>', '<dc:other>') when path like '%.xhtml' and doc_id % 4 = 0 then concat(content, '<img src="x"><IMG alt=""/>') else content end as content, cast(length(content) as bigint) as bytes from members
  where not (doc_id % 5 = 0 and path = 'OEBPS/toc.ncx') and not (doc_id % 11 = 0 and path = 'mimetype') union all select doc_id, 900, 'OEBPS/Images/big.png', false, '', cast(5200000 + doc_id as bigint) from members where path = 'META-INF/container.xml' and doc_id % 6 = 0"""


@query(f"""{W}, n as (select doc_id, count(*) as n from ch group by 1) select doc_id, list_concat(case when doc_id % 11 = 0 then ['mimetype missing'] else [] end, case when doc_id % 5 = 0 then ['OEBPS/toc.ncx missing'] else [] end, case when doc_id % 11 = 0 then ['mimetype not first'] when doc_id % 7 = 1 then ['mimetype compressed'] else [] end, case when doc_id % 3 = 0 then ['page direction'] else [] end) as issues,
  list_concat(case when doc_id % 3 = 0 then ['creator'] else [] end, ['cover'], case when doc_id % 6 = 0 then ['large images: 1'] else [] end, case when doc_id % 4 = 0 then [concat('images without alt: ', n)] else [] end) as warnings, n as chapters, case when doc_id % 6 = 0 then 1 else 0 end as images from n""")
def a29_package_report(spark, sf, sql=BOOKS):
    """The whole check list over packages, many of which are damaged."""
    members = B.entries(books(spark, sf), html_chapters(spark, sf, sql))
    damaged = spark.sql(DAMAGED.replace("from members", "from {members}"), members=members)
    return B.package_report(damaged).select("doc_id", "issues", "warnings", "chapters", F.col("images").cast("int").alias("images"))


@query(f"""{HTML_SQL}, n as (select doc_id, concat('chapter_', lpad(cast(idx - 1 as varchar), 3, '0'), '.html') as file, concat('<!DOCTYPE html>', chr(10), '<html lang="ja"><head><meta charset="UTF-8"/>', chr(10), '<meta name="viewport" content="width=device-width,initial-scale=1"/>', chr(10), '<title>', {ESC.format('title')}, '</title>', chr(10), '<style>p{{}}</style>', chr(10), '</head><body>', {strip_sql("regexp_extract(html, '(?is)<body[^>]*>(.*?)</body>', 1)")}, '</body></html>') as content from hx)
  select * from n union all select doc_id, 'theme.json', concat('{{"name":"', case when doc_id % 2 = 0 then 'novel' else 'default' end, '"}}') from documents""")
def k15_reader_pages(spark, sf, sql=BOOKS):
    themes = table(spark, sf, "documents").select("doc_id", F.struct(F.when(F.col("doc_id") % 2 == 0, "novel").otherwise("default").alias("name")).alias("theme"))
    return B.reader_pages(html_chapters(spark, sf, sql), themes, "p{}")
