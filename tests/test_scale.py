"""Whole results on odd inputs, and plans whose work stays in proportion to the input."""

import io
import zipfile

from folioforge.operators import books as B
from folioforge.operators import intent as I
from folioforge.plans import registry
from folioforge.sources import conversion, yamlstats

SF = "/root/testdata/sf0.001"


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_page_chapters_keep_cut_references(spark, tmp_path):
    cut = ["One &am", "Two &amp", "Three &", "Four &lt; &amp;"]
    page = "<html><head><title>{0}</title></head><body><div class=\"ad\">ad</div><article><h1>{0}</h1><p>text &amp;&gt; R&D</p></article><footer>x</footer></body></html>"
    spark.createDataFrame([(k, page.format(t)) for k, t in enumerate(cut)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {(r.doc_id, r.idx): (r.title, r.text) for r in registry.QUERIES["s10_page_chapters"](spark, str(tmp_path)).collect()}
    titles = ["One &am", "Two &amp", "Three &", "Four < &"]
    assert got == {(k, 1): (t, "ad") for k, t in enumerate(titles)} | {(k, 2): (t, f"{c}text &amp;&gt; R&D") for k, (t, c) in enumerate(zip(titles, cut))}


def test_chapters_cut_in_their_row_equal_those_of_lines(spark):
    texts = ["T", "", "T\n", " T \n\n", "T\n第1章 x", "T\n第1章 x\n", "T\r\npre\r第1章 x\r\n\r\na\n第2章\nChapter\n3\nb", "T\n\n一 x\ny", "T\n一\nx\n二、z\n　 あとがき \nw\n ", "第1章\n序章\n終章", "T\nChapter　12\n \n\u2028\na <b> & \"c\"\n\t\nd\ne", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    lined = B.plain_chapters(B.lines(docs))
    assert rows(B.text_chapters(docs)) == rows(lined)
    paras = {}
    for r in sorted(B.paragraphs(lined).collect(), key=lambda r: r.para):
        paras.setdefault((r.doc_id, r.idx), []).append(r.html)
    assert {(r.doc_id, r.idx): r.body for r in B.with_body(B.text_chapters(docs)).collect()} == {(r.doc_id, r.idx): "\n    ".join(paras.get((r.doc_id, r.idx), [])) for r in lined.collect()}


def test_books_are_made_without_shuffles_of_lines(spark):
    most = {"s7_chapter_html": 0, "k15_reader_pages": 0, "k5_k15_single_html": 1, "k1_entries": 2, "a29_check_package": 7, "a29_package_report": 5}
    assert {k: n for k in most if (n := exchanges(registry.QUERIES[k](spark, SF))) > most[k]} == {}


def test_bad_files_come_in_bounded_batches(spark):
    registry.QUERIES["s11_unreadable_packages"](spark, SF)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 2000


def test_files_of_one_split_are_dealt_to_tasks(spark):
    files = spark.range(40).coalesce(1).selectExpr("id as doc_id", "concat('a', id) as agent", "'total_tasks: 1  # all\\nrecent_tasks:\\n- id: \"#1\"\\n- id: 2' as text")
    assert yamlstats.yaml_values(files).rdd.getNumPartitions() > 1
    assert {(r.total_tasks, r.recent_tasks) for r in yamlstats.agent_stats(files).collect()} == {(1.0, 2)}


def test_words_are_counted_and_cut_in_one_exchange(spark):
    assert exchanges(registry.QUERIES["a21_j5_keywords"](spark, SF)) <= 1
    assert exchanges(registry.QUERIES["w9_columns"](spark, SF)) <= 1


def test_files_are_opened_once_and_handed_on_together(spark, monkeypatch):
    raw = io.BytesIO()
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>x</w:t></w:r></w:p></w:body></w:document>")
    opened, plain = [], zipfile.ZipFile
    monkeypatch.setattr(zipfile, "ZipFile", type("Counted", (plain,), {"__init__": lambda self, *a, **b: (opened.append(1), plain.__init__(self, *a, **b))[1]}))
    assert conversion._from_docx("a.docx", raw.getvalue()).chapters == [("", "<p>x</p>")] and len(opened) == 1


def test_intents_fit_alike_in_linear_time(spark):
    from pyspark.sql import functions as F

    texts = ["前回と同じ x 手順", "手順 同じ\n方法", "同じ\r手順", "pdf-makerスキルを使って", "x スキルで", "a/b.ts.mdを修正", "そのファイル更新", "fix the バグ", "バグ\nfix", "run x run test", "run\ntest run", "見て a.scssを見て", "why?", "/do", "x /do", "find find file", "ok", None, "Better sKill a.TSX b.md c.mdx", "same a workflow 提案", "SAME\nworkflow"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    pairs = [(I.fits(t, p), t.rlike(p)) for _, p, _ in I.INTENTS] + [(I._said(t, ps), F.exists(F.array(*map(F.lit, ps)), lambda p: F.regexp_like(t, p))) for ps in (I.DEVIATION, I.REUSE)]
    pairs += [(I.skill_of(t), F.coalesce(*[F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in I.SKILL])), (I.file_paths(t), F.array_distinct(F.regexp_extract_all(t, F.lit(I.ENTITIES[1][1]), F.lit(1))))]
    rows = df.select("t", *[(a.eqNullSafe(b)).alias(f"c{k}") for k, (a, b) in enumerate(pairs)]).collect()
    assert [(r.t, c) for r in rows for c in r.asDict() if c != "t" and not r[c]] == []
    long = spark.createDataFrame([("実行" * 50_000 + "x" + "find " * 50_000 + "ファ テス エージ" + "a" * 50_000,)], "t string").select(*[I.fits(t, p).alias(n) for n, p, _ in I.INTENTS])
    assert long.first().TEST_RUN is False


def test_pages_are_composed_after_one_sort(spark):
    df = registry.QUERIES["s14_w9_w12_page_paragraphs"](spark, SF)
    assert exchanges(df) == 1 and "Window" not in df._jdf.queryExecution().executedPlan().toString()


def test_whole_texts_reach_python_in_bounded_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 30))
    registry.QUERIES["f15_long_paragraphs"](spark, SF)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 16 << 20
