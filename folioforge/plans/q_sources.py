"""Queries of parsers, writers and stateful rewrites; most have no SQL form and are tested on literals."""

from pyspark.sql import functions as F

from .. import sources as S
from ..functions import markup as M
from ..functions import text as X
from ..operators import books as B
from .q_books import BOOKS, W, books, html_chapters
from .q_text import HTML, strip_sql
from .registry import derived, query, table

MD = "select doc_id, concat('# ', source, chr(10), chr(10), 'A **', lang, '** _word_ [x](http://a.b) ', chr(10), '- one', chr(10), '- two', chr(10), chr(10), '## Part', chr(10), '> said', chr(10), chr(10), '---', chr(10), '1. first') as text from documents"


def md(spark, sf):
    return derived(spark, sf, MD, "documents")


@query("""select doc_id, unnest(['heading', 'blank', 'p', 'ul', 'blank', 'heading', 'p', 'blank', 'hr', 'ol']) as kind, cast(unnest(range(0, 10)) as int) as pos, unnest([1, 0, 0, 0, 0, 2, 0, 0, 0, 0]) as level,
  unnest([concat('<h1>', source, '</h1>'), '', concat('<p>A <strong>', lang, '</strong> <em>word</em> <a href="http://a.b">x</a></p>'), '<ul><li>one</li><li>two</li></ul>', '', '<h2>Part</h2>', '<blockquote>said</blockquote>', '', '<hr/>', '<ol><li>first</li></ol>']) as content from documents""")
def s9_w7_markdown_blocks(spark, sf):
    return S.markdown_blocks(md(spark, sf)).select("doc_id", "kind", "pos", "level", "content")


@query("select doc_id, unnest([1, 2]) as idx, unnest([source, 'Part']) as title from documents")
def s9_markdown_chapters(spark, sf):
    return S.markdown_chapters(md(spark, sf), split_level=2).select("doc_id", "idx", "title")


@query()
def s10_html_chapters(spark, sf):
    return S.html_chapters(table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), "html"))


@query("""with p as (select page_id, replace(replace(replace(replace(html, '<article>', ''), '</article>', ''), '&quot;', chr(34)), '&#x27;', chr(39)) as html from pages), h as (select page_id, replace(replace(replace(trim(regexp_extract(html, '<title>([^<]*)<', 1)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') as title, regexp_extract(html, '<div class="ad">([^<]*)<', 1) as ad, regexp_extract(html, '(?s)(<h1>.*)<footer', 1) as body from p)
  select page_id as doc_id, 1 as idx, title, replace(ad, chr(10), '') as text from h union all select page_id, 2, replace(replace(replace(trim(regexp_extract(body, '<h1>([^<]*)<', 1)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), replace(regexp_replace(body, '<[^>]+>', '', 'g'), chr(10), '') from h""")
def s10_page_chapters(spark, sf):
    """Pages whose headings stand in the body itself: the chapters begun by them, as whole texts without navigation, footer and line breaks."""
    page = F.replace(F.replace("html", F.lit("<article>"), F.lit("")), F.lit("</article>"), F.lit(""))
    got = S.html_chapters(table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), page.alias("html")), as_written=True)
    return got.select("doc_id", "idx", "title", F.regexp_replace(F.replace("html", F.lit("\n")), "<[^>]+>", "").alias("text"))


_NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_P = lambda style, runs: f"'<w:p><w:pPr><w:pStyle w:val=\"{style}\"/></w:pPr>', {runs}, '</w:p>'"
_R = lambda text, mark="": f"'<w:r>{mark}<w:t>', {text}, '</w:t></w:r>'"
_ESCAPED = "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
#: Word documents of whole texts: styles by name and by id, a list, a bold text with a footnote, a table, properties and a picture.
WORD = {
    "word/document.xml": f"""concat('<w:document {_NS}><w:body>', {_P("a1", _R("source"))}, {_P("ListBullet", _R("lang"))}, {_P("ListBullet", _R("'x'"))}, {_P("Normal", _R(_ESCAPED, "<w:rPr><w:b/></w:rPr>"))},
      '<w:p><w:r><w:footnoteReference w:id="2"/></w:r></w:p><w:tbl><w:tr><w:tc>', {_P("", _R("lang"))}, '</w:tc></w:tr></w:tbl><w:p/>', {_P("タイトル", _R("'End'"))}, '</w:body></w:document>')""",
    "word/styles.xml": f"""'<w:styles {_NS}><w:style w:styleId="a1"><w:name w:val="heading 1"/></w:style></w:styles>'""",
    "word/footnotes.xml": f"""concat('<w:footnotes {_NS}><w:footnote w:id="0">', {_P("", _R("'separator'"))}, '</w:footnote><w:footnote w:id="2">', {_P("", _R("concat(source, ' note')"))}, '</w:footnote></w:footnotes>')""",
    "docProps/core.xml": """concat('<c xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>', case when doc_id % 2 = 0 then concat('Book ', source) else '' end, '</dc:title><dc:creator>', lang, '</dc:creator></c>')""",
    "word/_rels/document.xml.rels": """'<r><x Type="http://x/image" Target="media/p.jpeg"/><x Type="http://x/image" Target="http://x/y.png" TargetMode="External"/></r>'""",
    "[Content_Types].xml": """'<t><d Extension="jpeg" ContentType="image/jpeg"/></t>'""",
    "word/media/p.jpeg": "'picture'",
}


def word_files(spark, sf):
    """(doc_id, path, content) of a Word document for each document."""
    member = F.explode(F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(path).alias("path"), F.lit(False).alias("stored"), F.expr(sql).alias("content")) for k, (path, sql) in enumerate(WORD.items())]))
    packed = S.pack_epub(table(spark, sf, "documents").where("text is not null").select("doc_id", member.alias("m")).select("doc_id", "m.*"))
    return packed.select("doc_id", F.concat(F.lit("w/d"), F.col("doc_id").cast("string"), F.lit(".docx")).alias("path"), "content")


@query(f"""with b as (select doc_id, unnest(['h1', 'ul', 'ul', 'p', 'p', 'table', 'h1']) as kind, unnest([1, 0, 0, 0, 0, 0, 1]) as level,
    unnest([source, lang, 'x', concat('<strong>', replace(replace({_ESCAPED}, '"', '&quot;'), chr(39), '&#x27;'), '</strong>'), '<a epub:type="noteref" role="doc-noteref" href="#fn-2"><sup>1</sup></a>', concat('<table><tr><td>', lang, '</td></tr></table>'), 'End']) as content, unnest(range(0, 7)) as place
    from documents where text is not null),
  kept as (select * from b where trim(content, chr(10) || ' ') not in ('', '<strong></strong>'))
  select doc_id, cast(row_number() over (partition by doc_id order by place) - 1 as int) as pos, kind, level, content from kept""")
def s13_docx_blocks(spark, sf):
    return S.docx_blocks(word_files(spark, sf)).select("doc_id", "pos", "kind", "level", "content")


@query("""select doc_id, unnest([1, 2]) as idx, unnest([source, 'End']) as title, case when doc_id % 2 = 0 then concat('Book ', source) else concat('d', doc_id) end as book, lang as author, unnest([concat(source, ' note'), '']) as note, 'docx_img001.jpg' as image from documents where text is not null""")
def s13_docx_books(spark, sf):
    """Word documents as books: title, author, chapters with their notes, and the picture."""
    books, chapters, images, _ = S.books_of(word_files(spark, sf))
    note = F.regexp_extract("html", '<aside epub:type="footnote" role="doc-footnote" id="fn-2"><p>([^<]*)</p>', 1)
    read = chapters.join(books.select("doc_id", F.col("title").alias("book"), "author"), "doc_id").join(images.where("cover and media = 'image/jpeg'").select("doc_id", F.col("name").alias("image")), "doc_id")
    return read.select("doc_id", "idx", "title", "book", "author", note.alias("note"), "image")


@query("select doc_id, '2' as note_id, concat(source, ' note') as note from documents where text is not null")
def s13_docx_footnotes(spark, sf):
    return S.docx_footnotes(word_files(spark, sf)).select("doc_id", "note_id", "note")


_SENTENCES = "regexp_extract_all(v, '[^。．]*[。．]|[^。．]+')"


@query(f"""with d as (select doc_id, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '. ', '。') as v from documents)
  select doc_id, case when length(v) > 150 and len({_SENTENCES}) > 1 then array_to_string(list_transform(list_filter({_SENTENCES}, lambda s: regexp_matches(s, '[^ \t\r\n]')), lambda s: concat('<p>', s, '</p>')), '') else concat('<p>', v, '</p>') end as value from d""")
def f15_long_paragraphs(spark, sf):
    """Whole texts as one paragraph each, with full stops of Japanese type."""
    v = F.regexp_replace(X.escape_html(F.col("text"), quotes=False), "\\. ", "。")
    return table(spark, sf, "documents").select("doc_id", M.long_paragraphs(F.concat(F.lit("<p>"), v, F.lit("</p>"))).alias("value"))


@query("""with d as (select doc_id, lang, cast(doc_id as varchar) as n from documents)
  select doc_id, concat('<p>', t, ' <a href="/12">', lang, ' 12</a> <b>', t, '</b> ', '<span class="tcy">1</span><span class="tcy">AB</span> <span class="tcy">', lang, '</span>語</p>') as value
  from (select *, case when length(n) <= 3 then concat('<span class="tcy">', n, '</span>') else n end as t from d)""")
def w24_link_guard(spark, sf):
    """Tokens are set upright but in links, however deep the tags."""
    n, lang = F.col("doc_id").cast("string"), F.col("lang")
    html = F.concat(F.lit("<p>"), n, F.lit(' <a href="/12">'), lang, F.lit(" 12</a> <b>"), n, F.lit("</b> 1AB "), lang, F.lit("語</p>"))
    return table(spark, sf, "documents").select("doc_id", M.upright(html).alias("value"))


@query("select doc_id, concat(repeat('日本語のかな', 20), source) as text, 'utf-8-sig' as encoding from documents")
def s4_s5_decoded(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", S.decoded(F.encode(F.concat(F.repeat(F.lit("日本語のかな"), F.lit(20)), F.col("source")), "UTF-8")).alias("d"))
    return d.select("doc_id", "d.text", "d.encoding")


@query("select doc_id, nfc_normalize(concat(text, 'e', chr(769), 'か', chr(12441))) as value from documents")
def f10_nfc(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.nfc(F.concat("text", F.lit("éが"))).alias("value"))


@query("select doc_id, cast(null as int) as idx, true as failed from documents")
def s11_unreadable_packages(spark, sf):
    """Files that are no packages give a row with an error each, and no chapter."""
    bad = table(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return S.epub_chapters(bad).select("doc_id", "idx", F.col("error").isNotNull().alias("failed"))


FILES = (
    "select doc_id, concat('f', doc_id, case doc_id % 4 when 0 then '.md' when 1 then '.TXT' when 2 then '.html' else '.bin' end) as path, "
    "case doc_id % 4 when 0 then concat('# ', source, chr(10), text) when 1 then concat(source, chr(10), text) else concat('<html><body><h1>', source, '</h1><p>x</p></body></html>') end as text from documents"
)


@query("select doc_id, cast(1 as int) as idx, case doc_id % 4 when 3 then null else source end as title, doc_id % 4 = 3 as failed from documents")
def s2_files_to_chapters(spark, sf):
    """The first chapter of every file, by the parser of its suffix; unknown suffixes give an error."""
    files = derived(spark, sf, FILES, "documents").withColumn("content", F.encode("text", "UTF-8"))
    out = S.file_chapters(files.select("doc_id", "path", "content")).where("coalesce(idx, 1) = 1")
    return out.select("doc_id", F.coalesce("idx", F.lit(1)).alias("idx"), "title", F.col("error").isNotNull().alias("failed"))


def some_packages(spark, sf, sql=BOOKS):
    return S.pack_epub(B.entries(books(spark, sf), html_chapters(spark, sf, sql)))


@query(f"{W} select doc_id, idx, chapter_id, {strip_sql('title')} as title from ch")
def k1_s11_epub_round_trip(spark, sf, sql=BOOKS):
    """Books are packed, and their chapters read back."""
    return S.epub_chapters(some_packages(spark, sf, sql)).select("doc_id", "idx", "chapter_id", "title")


@query()
def f13_f15_f16_typeset(spark, sf):
    return derived(spark, sf, HTML, "documents").select("doc_id", M.typeset(F.col("html"), normalize=True).alias("value"))


@query("select doc_id, concat('いちまん', case doc_id % 3 when 0 then '' when 1 then 'にじゅういち' else 'さんびゃく' end, '円と5個') as value from documents")
def g37_g38_numbers_read(spark, sf):
    k = F.col("doc_id") % 3
    raw = F.concat(F.lit("1万"), F.when(k == 0, "").when(k == 1, "21").otherwise("300"), F.lit("円と5個"))
    return table(spark, sf, "documents").select("doc_id", M.numbers_read(raw).alias("value"))


@query("select doc_id, concat_ws('-', h[1:8], h[9:12], h[13:16], h[17:20], h[21:32]) as uid from (select doc_id, sha256(cast(doc_id as string)) as h from documents)")
def k9_fixed_uid(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.fixed_uid(F.col("doc_id")).alias("uid"))


@query("select doc_id, doc_id % 3 <> 0 as valid, contains(text, chr(65533)) as has_replacement, starts_with(text, chr(65279)) as has_bom from documents")
def g40_utf8_check(spark, sf):
    """Every third document ends in the middle of a character."""
    t, broken = F.col("text"), F.when(F.col("doc_id") % 3 == 0, F.unhex(F.lit("E3"))).otherwise(F.unhex(F.lit("")))
    bytes_ = F.concat(F.encode("text", "UTF-8"), broken).cast("string")
    return table(spark, sf, "documents").select("doc_id", F.is_valid_utf8(bytes_).alias("valid"), F.contains(t, F.lit("�")).alias("has_replacement"), F.startswith(t, F.lit("﻿")).alias("has_bom"))


LOG = "select event_id, case when event_id % 10 = 0 then '{broken' else concat('{\"type\":\"', event_type, '\",\"user\":', cast(user_id as string), ',\"__proto__\":1}') end as line from events"


@query("select event_type as type, count(*) as n from events where event_id % 10 <> 0 group by 1")
def s15_s16_jsonl_scan(spark, sf):
    """Bad lines are skipped."""
    rows = derived(spark, sf, LOG, "events").select(F.from_json("line", "type string, user long", {"mode": "PERMISSIVE"}).alias("e"))
    return rows.where("e.type is not null").groupBy("e.type").agg(F.count("*").alias("n"))


@query("select event_id, ['type', 'user'] as keys from events where event_id % 10 <> 0")
def g43_p14_safe_keys(spark, sf):
    """Keys that could change a prototype are dropped."""
    bad = F.array(*map(F.lit, ("__proto__", "constructor", "prototype")))
    m = F.from_json("line", "map<string,string>")
    rows = derived(spark, sf, LOG, "events").where("event_id % 10 <> 0")
    return rows.select("event_id", F.array_sort(F.map_keys(F.map_filter(m, lambda k, v: ~F.array_contains(bad, k)))).alias("keys"))


@query("with h as (select event_id, event_type from events order by ts desc, event_id desc limit 100) select event_type, count(*) as n from h group by 1")
def s17_recent_history(spark, sf):
    last = table(spark, sf, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(100)
    return last.groupBy("event_type").agg(F.count("*").alias("n"))


#: Files of every kind: Markdown with an image beside it (every eighth lacks it), plain text, HTML, and one without a parser.
LIBRARY = (
    "select doc_id, concat('lib/f', doc_id, case doc_id % 4 when 0 then '.md' when 1 then '.TXT' when 2 then '.html' else '.bin' end) as path, "
    "case doc_id % 4 when 0 then concat('# ', source, ' *x*', chr(10), '![p](pics/p', doc_id, '.png)', chr(10), 'a < b ', lang, chr(10), '# Last') when 1 then concat(source, chr(10), 'a & b', chr(10), '第2章 ', lang, chr(10), text) "
    "else concat('<html><head><title>T ', source, '</title></head><body><p @x=1 a:b=2>pre<br><h1>', source, '</h1><p>&nbsp;x<o:p>y</o:p><h1>again</h1></body></html>') end as text from documents "
    "union all select -1 - doc_id, concat('lib/pics/p', doc_id, '.png'), 'image' from documents where doc_id % 4 = 0 and doc_id % 8 <> 4"
)


@query("""with d as (select doc_id, source, lang, doc_id % 4 as k, doc_id % 8 = 4 as lost from documents)
  select doc_id, unnest(case when k = 3 or lost then [cast(null as int)] when k = 2 then [1, 2, 3] else [1, 2] end) as idx,
    unnest(case when k = 3 or lost then [null] when k = 0 then [concat(source, ' x'), 'Last'] when k = 1 then [source, concat('第2章 ', lang)] else [concat('T ', source), source, 'again'] end) as title,
    case when k = 0 and not lost then 1 else 0 end as images, case when k = 3 or lost then 'ValueError' end as error from d""")
def s2_k1_conversion_round_trip(spark, sf):
    """A folder of files becomes packages, whose chapters and images are read back; files that fail keep their error."""
    files = derived(spark, sf, LIBRARY, "documents").withColumn("content", F.encode("text", "UTF-8"))
    packed = S.convert(files.select("doc_id", "path", "content"))
    back = S.books_of(packed.where("error is null").select("doc_id", F.lit("x.epub").alias("path"), "content"))
    n = back[2].groupBy("doc_id").agg(F.count("*").alias("images"))
    read = back[1].join(n, "doc_id", "left").select("doc_id", "idx", "title", F.coalesce("images", F.lit(0)).cast("int").alias("images"), F.lit(None).cast("string").alias("error"))
    failed = packed.where("error is not null").select("doc_id", F.lit(None).cast("int").alias("idx"), F.lit(None).cast("string").alias("title"), F.lit(0).alias("images"), F.substring_index("error", ":", 1).alias("error"))
    return read.unionByName(failed)
