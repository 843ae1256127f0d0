"""Queries of page composition, on word boxes laid out from the words of documents."""

from pyspark.sql import functions as F

from ..operators import pages as P
from .q_windows import WORDS_SQL
from .q_windows import words as straight_words
from .registry import query, table

#: Tops of the five rows of eight words a page has, the first in the head margin; words jitter by up to 8 around them.
TOPS = (0, 14, 44, 58, 88)
_SLOT, _ROW, _COL = "(k % 40)", "cast(floor((k % 40) / 8) as int)", "(k % 8)"
_TOP = "case " + " ".join(f"when {_ROW} = {r} then {t}" for r, t in enumerate(TOPS)) + " end"
#: Every second page has a heading in the second row of the left column; every hundredth document has blank pages only.
_WORD = f"case when doc_id % 100 = 7 then '' when {_ROW} = 1 and {_COL} < 4 and floor(k / 40) % 2 = 1 then case when {_COL} = 0 then concat('第', cast(cast(floor(k / 40) as int) as string), '章') else '' end else w end"
_WORDS = (
    f"select doc_id, cast(floor(k / 40) as int) as page, {_WORD} as text, cast({_COL} * 60 + case when {_COL} >= 4 then 100 else 0 end as double) as x0, "
    f"cast({_TOP} + doc_id % 3 + (k * 7) % 9 as double) as top, cast({_TOP} + doc_id % 3 + (k * 7) % 9 + 10 as double) as bottom, cast(700 as double) as page_w, cast(110 as double) as page_h from "
)


def words(spark, sf):
    exploded = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "[ \n]+")).alias("k", "w"))
    return spark.sql(_WORDS + "{e}", e=exploded)


#: Words of documents one by one, then page composition over the CTE ``words``.
_EACH = "with recursive n as (select doc_id, string_split_regex(text, '[ \n]+') as ws from documents), e as (select doc_id, unnest(ws) as w, unnest(generate_series(0, len(ws) - 1)) as k from n)"
_COMPOSED = """,
  band as (select *, round_even(x0, 0) as x from words where top > page_h * 0.07 and top < page_h * 0.93),
  h as (select doc_id, page, median(bottom - top) as height from band group by 1, 2),
  g as (select *, x - lag(x) over (partition by doc_id, page order by x) > page_w * 0.1 as cut from band),
  l as (select *, count(*) filter (cut) over (partition by doc_id, page order by x range between unbounded preceding and current row) as from_left from g),
  c as (select l.*, height, greatest(height * 0.6, 4.0) as tol, cast(max(from_left) over (partition by doc_id, page) - from_left as int) as col from l join h using (doc_id, page)),
  o as (select *, row_number() over (partition by doc_id, page, col order by round_even(top / tol, 0), x0, top, text) as rn from c),
  f as (select doc_id, page, col, rn, 0 as line, top as anchor from o where rn = 1
        union all select o.doc_id, o.page, o.col, o.rn, case when abs(o.top - f.anchor) <= o.tol then f.line else f.line + 1 end, case when abs(o.top - f.anchor) <= o.tol then f.anchor else o.top end
        from f join o on f.doc_id = o.doc_id and f.page = o.page and f.col = o.col and o.rn = f.rn + 1),
  t as (select o.doc_id, o.page, o.col, line, trim(string_agg(text, '' order by x0, rn)) as text, arg_min(top, struct_pack(a := x0, b := rn)) as top, max(bottom) as bottom, any_value(height) as height from f join o using (doc_id, page, col, rn) group by 1, 2, 3, 4),
  b as (select *, top - lag(bottom) over (partition by doc_id, page, col order by line) > 1.5 * height as new from t where text <> ''),
  p as (select *, count(*) filter (new) over (partition by doc_id, page, col order by line) as paragraph from b),
  paragraphs as (select doc_id, page, col as "column", cast(paragraph as int) as paragraph, string_agg(text, '' order by line) as text from p group by 1, 2, 3, 4)"""
PARAGRAPHS = f"{_EACH}, words as ({_WORDS} e){_COMPOSED}"


@query(f"{PARAGRAPHS} select * from paragraphs")
def s14_w9_w12_page_paragraphs(spark, sf):
    return P.page_paragraphs(words(spark, sf))


@query(f"""{PARAGRAPHS}, r as (select *, length(trim(text)) <= 30 and regexp_matches(trim(text), '^第[0-9]+章') as head, row_number() over (partition by doc_id order by page, "column", paragraph) as pos from paragraphs),
  s as (select *, count(*) filter (head) over (partition by doc_id order by pos) as sec from r),
  m as (select doc_id, sec, coalesce(max(case when head then trim(text) end), '本文') as title, count(*) filter (not head) as n, string_agg(concat('<p>', replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '</p>'), chr(10) || '    ' order by pos) filter (not head) as body from s group by 1, 2),
  k as (select *, max(sec) over (partition by doc_id) = sec as last, max(n) over (partition by doc_id order by sec) > 0 as before, max(n) over (partition by doc_id) > 0 as filled from m),
  q as (select doc_id, row_number() over (partition by doc_id order by sec) as idx, title, coalesce(body, '') as body from k where n > 0 or (not last and before) or (last and not filled))
  select doc_id, cast(idx as int) as idx, title, body, case when idx is null then 'no text on any page' end as error from (select distinct doc_id from documents) left join q using (doc_id)""")
def s14_page_chapters(spark, sf):
    got = P.page_chapters(P.page_paragraphs(words(spark, sf)), table(spark, sf, "documents"))
    return got.select("doc_id", "idx", "title", F.regexp_extract("html", "(?s)</h1>\n    (.*)\n  </section>", 1).alias("body"), "error")


_STRAIGHT = WORDS_SQL[WORDS_SQL.index("words as (") :].replace(", 110.0 as page_h", ", 110.0 as page_h, floor((k % 40) / 8) * 14.0 + doc_id % 3 + case when k % 40 >= 24 then 30 else 0 end + 10.0 as bottom").replace("110.0", "1000.0")


@query(f"{_EACH}, {_STRAIGHT}{_COMPOSED} select * from paragraphs")
def w10_w11_pdf_paragraphs(spark, sf):
    """Straight lines on high pages: a new paragraph where lines stand further apart than one and a half words are high."""
    return P.page_paragraphs(straight_words(spark, sf).withColumn("page_h", F.lit(1000.0)))
