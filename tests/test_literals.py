"""Behaviours on small literals, where SQL is no independent witness."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from folioforge import sources as S
from folioforge.functions import markup as M
from folioforge.functions import text as X
from folioforge.operators import risk as R
from folioforge.operators import windows as W
from folioforge.sources import docx, encoding, epub, html, markdown


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_upright_tokens_are_cut_left_to_right():
    assert M.upright_html("1A SNS Google 123") == '<span class="tcy">1</span><span class="tcy">A</span> <span class="tcy">SNS</span> Google <span class="tcy">123</span>'
    assert M.upright_html('<a href="12">12</a> 12') == '<a href="12">12</a> <span class="tcy">12</span>'


def test_long_paragraphs_split_at_full_stops_until_an_empty_element():
    a, b = "あ" * 100 + "。", "い" * 100 + "。"
    assert M.split_paragraphs(f"<p>{a}{b}</p>") == f"<p>{a}</p><p>{b}</p>"
    assert M.split_paragraphs(f"<p><br/>{a}{b}</p>") == f"<p><br/>{a}{b}</p>"
    assert M.split_paragraphs("<p>短い。文。</p>") == "<p>短い。文。</p>"


@pytest.mark.parametrize("n, reading", [(0, "ぜろ"), (21, "にじゅういち"), (300, "さんびゃく"), (8000, "はっせん"), (10_000, "いちまん"), (10**12, "いっちょう"), (1_0000_0020, "いちおくにじゅう")])
def test_number_reading(n, reading):
    assert M.number_reading(n) == reading


def test_only_numbers_with_a_unit_are_read():
    assert M.read_numbers("3万5個と7個") == "さんまんご個と7個"


def test_two_notes_take_the_text_between_along(spark):
    assert value(spark, X.clean_marks(F.lit("a［＃x］b［＃y］c"))) == "ac"
    assert value(spark, X.clean_marks(F.lit("a※外字 b　c"))) == "a　c"


def test_emphasised_words_appear_twice(spark):
    assert value(spark, X.emphasis(F.lit("強い［＃「強い」に傍点］"))) == "強い<em>強い</em>"


def test_markdown_blocks_and_chapters():
    text = "Title\n=====\nfirst  \nsecond\n\n```\n<x> *a*\n```\n* a\n* b\n1. c\n# Two #\n[k](local) http://a.b/c。"
    kinds = [(b.kind, b.level) for b in markdown.blocks(text)]
    assert kinds == [("heading", 1), ("p", 0), ("blank", 0), ("pre", 0), ("ul", 0), ("ol", 0), ("heading", 1), ("p", 0)]
    assert markdown.blocks(text)[1].content == "<p>first<br/>second</p>"
    assert markdown.blocks(text)[3].content == "<pre><code>&lt;x&gt; *a*</code></pre>"
    assert '<a href="http://a.b/c">http://a.b/c</a>。' in markdown.blocks(text)[-1].content
    assert [c[2] for c in markdown.chapters(text)] == ["Title", "Two"]
    assert markdown.chapters("")[0][:3] == (1, "chapter001", "")
    with pytest.raises(ValueError, match="http://x/a.png, b.txt"):
        markdown.images("![a](http://x/a.png) ![b](b.txt) ![c](c.png)")


def test_html_children_of_the_body():
    page = "<html><head><title> T </title><meta name='author' content='N'></head><body>loose<h1>A</h1><p>one<br>two</p><script>x</script><div><h2>no</h2></div><h2>B</h2><p>open</body></html>"
    assert [(c[2], c[3]) for c in html.chapters(page)] == [("A", "<h1>A</h1>\n<p>one<br/>two</p>\n<div><h2>no</h2></div>"), ("B", "<h2>B</h2>\n<p>open</p>")]
    assert html.parse(page).author == "N"


def make_epub(spine=True):
    opf = (
        '<package xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>T</dc:title></metadata><manifest>'
        '<item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="b" href="b.xhtml" media-type="application/xhtml+xml"/><item id="cover-image" href="i/c.png" media-type="image/png"/></manifest>'
        f'<spine>{"<itemref idref=" + chr(34) + "b" + chr(34) + "/><itemref idref=" + chr(34) + "a" + chr(34) + "/>" if spine else ""}</spine></package>'
    )
    container = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="O/c.opf"/></rootfiles></container>'
    page = '<html><head><link rel="stylesheet" href="x.css"/><style>p</style></head><body><h1>{}</h1></body></html>'
    return epub.write([("mimetype", True, "application/epub+zip"), ("META-INF/container.xml", False, container), ("O/c.opf", False, opf), ("O/a.xhtml", False, page.format("A")), ("O/b.xhtml", False, page.format("B")), ("O/i/c.png", False, b"png")])


def test_epub_reading_order_and_writer():
    raw = make_epub()
    assert [c[2] for c in epub.chapters(raw)] == ["B", "A"] and [c[2] for c in epub.chapters(make_epub(False))] == ["A", "B"]
    assert "style" not in epub.chapters(raw)[0][3]
    assert epub.cover(epub.package(raw)[2]) == "O/i/c.png"
    first = zipfile.ZipFile(io.BytesIO(raw)).infolist()[0]
    assert (first.filename, first.compress_type) == ("mimetype", zipfile.ZIP_STORED)
    assert epub.write([("a", False, "x")]) == epub.write([("a", False, "x")])


def test_docx_blocks_and_footnotes():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda style, text, extra="": f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r>{extra}<w:t>{text}</w:t></w:r></w:p>'
    doc = f"<w:document {w}><w:body>{p('Heading1', 'H')}{p('ListBullet', 'i')}{p('Normal', 'a &lt; b', '<w:rPr><w:b/></w:rPr>')}<w:tbl><w:tr><w:tc>{p('', 'c')}</w:tc></w:tr></w:tbl>{p('Normal', ' ')}</w:body></w:document>"
    notes = f'<w:footnotes {w}><w:footnote w:id="-1">{p("", "sep")}</w:footnote><w:footnote w:id="2">{p("", "note")}</w:footnote></w:footnotes>'
    raw = epub.write([("word/document.xml", False, doc), ("word/footnotes.xml", False, notes)])
    assert docx.blocks(raw) == [(0, "h1", 1, "H"), (1, "ul", 0, "i"), (2, "p", 0, "<strong>a &lt; b</strong>"), (3, "table", 0, "<table><tr><td>c</td></tr></table>")]
    assert docx.footnotes(raw) == {"2": "note"}


def test_docx_styles_notes_properties_and_images():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda style, runs: f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr>{runs}</w:p>'
    r = lambda text: f"<w:r><w:t>{text}</w:t></w:r>"
    ref = lambda k: f'<w:r><w:footnoteReference w:id="{k}"/></w:r>'
    body = p("7", r("Start &amp; go")) + p("8", r("x")) + p("8", r("y") + ref(3)) + p("番号付きリスト", r("n")) + p("", r("z") + ref(2) + ref(3) + ref(99)) + p("見出し 2", r("part")) + p("タイトル", r("End"))
    parts = [
        ("word/document.xml", False, f"<w:document {w}><w:body>{body}</w:body></w:document>"),
        ("word/styles.xml", False, f'<w:styles {w}><w:style w:styleId="7"><w:name w:val="heading 1"/></w:style><w:style w:styleId="8"><w:name w:val="List Bullet 2"/></w:style><w:style w:styleId="9"/></w:styles>'),
        ("word/footnotes.xml", False, f'<w:footnotes {w}><w:footnote w:id="2">{p("", r("two"))}</w:footnote><w:footnote w:id="3">{p("", r("a &lt; b"))}</w:footnote><w:footnote w:id="4">{p("", r(" "))}</w:footnote></w:footnotes>'),
        ("docProps/core.xml", False, '<c xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title> T </dc:title><dc:creator>Who</dc:creator></c>'),
        ("word/_rels/document.xml.rels", False, '<r><x Type="http://x/image" Target="media/a.png"/><x Type="http://x/image" Target="/word/media/b.bin"/><x Type="http://x/image" Target="media/lost.png"/><x Type="http://x/styles" Target="styles.xml"/></r>'),
        ("[Content_Types].xml", False, '<t><d Extension="png" ContentType="image/png"/><o PartName="/word/media/b.bin" ContentType="image/x-emf"/></t>'),
        ("word/media/a.png", False, b"a"), ("word/media/b.bin", False, b"b"),
    ]
    raw = epub.write(parts)
    link = lambda k, n: f'<a epub:type="noteref" role="doc-noteref" href="#fn-{k}"><sup>{n}</sup></a>'
    assert [b[1:] for b in docx.blocks(raw)] == [("h1", 1, "Start &amp; go"), ("ul", 0, "x"), ("ul", 0, f"y{link(3, 1)}"), ("ol", 0, "n"), ("p", 0, f"z{link(2, 2)}{link(3, 3)}"), ("h2", 2, "part"), ("h1", 1, "End")]
    assert docx.properties(raw) == ("T", "Who") and docx.properties(epub.write(parts[:1])) == ("", "")
    assert docx.images(raw) == [("docx_img001.png", "image/png", b"a"), ("docx_img002.emf", "image/x-emf", b"b")] and docx.images(epub.write(parts[:1])) == []
    (first, text), last = docx.chapters(raw)
    assert (first, last) == ("Start & go", ("End", "<h1>End</h1>"))
    assert f"<ul><li>x</li><li>y{link(3, 1)}</li></ul>" in text and "<ol><li>n</li></ol>" in text
    assert text.index('id="fn-3"><p>a &lt; b</p>') < text.index('id="fn-2"><p>two</p>') and text.count("<aside") == 2
    assert link(3, 1) not in docx.blocks(epub.write(parts[:1]))[2][3]


def test_a_bad_file_is_a_row(spark):
    rows = spark.createDataFrame([(1, make_epub()), (2, b"no zip")], "doc_id long, content binary")
    got = S.epub_chapters(rows).orderBy("doc_id", "idx").collect()
    assert [(r.doc_id, r.title) for r in got if r.error is None] == [(1, "B"), (1, "A")]
    assert [r.doc_id for r in got if r.error] == [2]
    assert S.docx_blocks(rows.where("doc_id = 2")).first().error


@pytest.mark.parametrize("name", ["cp932", "euc_jp", "utf-8"])
def test_encodings(name):
    text = "日本語のかなと漢字の文です。" * 5
    assert encoding.decode(text.encode(name))[0] == text


def test_folder_scan(spark, tmp_path):
    (tmp_path / "a.md").write_text("# x")
    (tmp_path / "b.bin").write_text("no")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.md").write_text("no")
    assert [r.path.rsplit("/", 1)[1] for r in S.scan(spark, str(tmp_path)).collect()] == ["a.md"]


def test_circuit_replay(spark):
    t0 = 1_700_000_000
    ok = [0, 0, 1, 0, 0, 1, 1, 1, 1]  # two failures open it at the 2nd and the 5th call
    rows = [("a", t0 + k, bool(v)) for k, v in enumerate(ok)] + [("a", t0 + 100, True), ("a", t0 + 101, True), ("b", t0, True)]
    df = spark.createDataFrame(rows, "k string, s long, ok boolean").select("k", F.timestamp_seconds("s").alias("t"), "ok")
    got = {r.k: r for r in W.circuit_states(df, "k", "t", "ok", 2, 60.0, 2).collect()}
    assert (got["a"].calls, got["a"].rejected, got["a"].opened, got["a"].state) == (11, 7, 1, "closed")
    assert got["b"].state == "closed"


def test_greedy_segments(spark):
    df = spark.createDataFrame([(1, k, s) for k, s in enumerate([5, 4, 3, 20, 1, 9])], "d int, o int, s int")
    assert [r.segment for r in W.greedy_segments(df, "d", "o", "s", 10).orderBy("o").collect()] == [0, 0, 1, 2, 3, 3]


def test_reading_lines_keep_the_anchor_of_their_first_word(spark):
    rows = [(1, 0, t, x, y, y + 10.0) for t, x, y in (("a", 0.0, 0.0), ("b", 10.0, 5.0), ("c", 20.0, 2.0), ("d", 0.0, 30.0))]
    got = W.reading_lines(spark.createDataFrame(rows, "doc_id long, page int, text string, x0 double, top double, bottom double")).orderBy("line").collect()
    assert [r.text for r in got] == ["acb", "d"]


@pytest.mark.parametrize("path, want", [("/a/./b/../c//d", "/a/c/d"), ("../../x", "../../x"), ("/../..", "/"), ("a/..", "."), ("", ""), ("a/../../b", "../b")])
def test_normalize_path(spark, path, want):
    assert value(spark, R.normalize_path(F.lit(path))) == want


def test_tree_finds_the_only_feature_that_tells(spark):
    rows = [("high" if k % 2 else "low", [float(k % 2), float(k % 3 == 0)]) for k in range(40)]
    tree = R.grow_tree(spark.createDataFrame(rows, "y string, f array<double>"), "y", "f")
    assert tree == [(0, 0, "low"), (1, None, "low"), (2, None, "high")]


def test_queries_do_not_depend_on_the_number_of_partitions(spark):
    from folioforge.plans import registry

    before = spark.conf.get("spark.sql.shuffle.partitions")
    for name in ("a10_error_patterns", "s7_w1_w2_chapters", "w16_running_budget"):
        got = []
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got.append(sorted(map(str, registry.QUERIES[name](spark, "/root/testdata/sf0.001").collect())))
        spark.conf.set("spark.sql.shuffle.partitions", before)
        assert got[0] == got[1]


def test_bytes_tell_their_encoding():
    assert encoding.decode(b"plain words only, and even more") == ("plain words only, and even more", "utf-8-sig")
    assert encoding.decode("a".encode("utf-16"))[1] == "utf-16"


def test_markdown_images():
    assert markdown.blocks('see ![a "b"](pics/x.png)')[0].content == '<p>see <img src="images/x.png" alt="a &quot;b&quot;"/></p>'
    with pytest.raises(ValueError):
        markdown.blocks("![a](http://x/y.png)")


def test_inline_marks_are_read_once():
    assert markdown.inline("**a *b* c** `**x**` http://a.b/c_d_e.") == '<strong>a <em>b</em> c</strong> <code>**x**</code> <a href="http://a.b/c_d_e">http://a.b/c_d_e</a>.'


def test_files_go_to_the_parser_of_their_suffix_and_into_packages(spark):
    files = [(1, "a.md", b"# A\ntext"), (2, "b.txt", "題\n第1章 始\n本文".encode()), (3, "c.HTM", b"<body><h1>C</h1><p>x</p></body>"), (4, "d.epub", make_epub()), (5, "e.xyz", b"?")]
    rows = spark.createDataFrame(files, "doc_id long, path string, content binary")
    got = S.file_chapters(rows).collect()
    assert {r.doc_id for r in got if r.error} == {5}
    assert {(r.doc_id, r.title) for r in got if not r.error} >= {(1, "A"), (3, "C"), (4, "B"), (4, "A")}
    packed = S.convert(rows)
    assert sorted((r.doc_id, r.error is None) for r in packed.collect()) == [(1, True), (2, True), (3, True), (4, True), (5, False)]
    assert {r.title for r in S.epub_chapters(packed.where("doc_id = 1")).collect()} == {"A"}


def test_overlaps_in_any_stretch(spark):
    rows = [("k", 0, 5, 1), ("k", 4, 30, 2), ("k", 29, 40, 3), ("j", 0, 99, 4), ("k", 12, 12, 5), ("k", 5, 12, 6)]
    df = spark.createDataFrame(rows, "key string, s long, e long, n int")
    want = {(a[3], b[3]) for a in rows for b in rows if a[0] == b[0] and a[3] < b[3] and a[1] < b[2] and b[1] < a[2]}
    for width in (1, 7, 1000):
        got = [(r.first, r.second) for r in W.overlaps(df, "key", "s", "e", "n", width).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_stream_sinks(spark, tmp_path):
    from folioforge import streaming

    source = str(tmp_path / "in")
    spark.range(50).selectExpr("id", "repeat('x', 100) as text").write.json(source)
    stream = spark.readStream.schema("id long, text string").json(source)
    streaming.append_json(stream, str(tmp_path / "out"), str(tmp_path / "c1"), None).awaitTermination()
    assert spark.read.json(str(tmp_path / "out")).count() == 50
    log = str(tmp_path / "log")
    streaming.buffered_log(stream, log, str(tmp_path / "c2"), None).awaitTermination()
    assert streaming.read_log(spark, log, "id long").count() == 50


def test_page_markup_reads_tags_only(spark):
    from folioforge.functions import pagemarkup as P

    of = lambda html: value(spark, P.page_markup(F.lit(html)))
    page = '<!doctype html><HTML><html lang="en"><!-- <img> <body> --><img src="a>b"/><img alt=\'x\'><![CDATA[<img>]]></html>'
    assert of(page) == P.PROLOGUE + '<HTML><html lang="en" xml:lang="ja"><!-- <img> <body> --><img src="a>b" alt=""/><img alt=\'x\'><![CDATA[<img>]]></html>'
    assert of("<body style='color:red;'>") == P.PROLOGUE + f'<body style="color:red;;{P.VERTICAL_STYLE}">'
    for same in ("", "plain", "a < b <p>", "<p", "<!-- only -->"):
        assert of(same) == same
    assert value(spark, P.page_markup(F.lit(None).cast("string"))) is None


def test_readings_in_their_order(spark):
    from folioforge.functions import readings as D

    of = lambda text, **k: value(spark, D.read_aloud(F.lit(text), **k))
    assert of("3万円と3円、1ヶ月と11ヶ月、12日間。") == "3まんえんと3えん、いっかげつと1いっかげつ、1ふつかかん。"
    assert of("AIとXAI、youtubeのGPTs") == "えーあいとXAI、ゆーちゅーぶのじーぴーてぃーず"
    assert of("AI 5円", numbers=False, abbreviations=False, custom=[("A(.)", "$1a")]) == "Ia 5円"
    assert value(spark, D.read_aloud(F.lit(None).cast("string"))) is None


def test_percentiles_of_bands_are_exact(spark):
    import random

    from folioforge.operators import events as E

    rnd = random.Random(2)
    rows = [("a", rnd.gauss(0, 1)) for _ in range(30_000)] + [("b", float(rnd.randrange(3))) for _ in range(5000)] + [(None, 1.5), ("c", None), ("d", 7.0), ("d", 8.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    of = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p999": 0.999}
    got = {r.k: tuple(r)[1:] for r in E.floor_index_percentiles(df, "k", "v", of).collect()}
    for k in ("a", "b", None, "d"):
        values = sorted(v for x, v in rows if x == k and v is not None)
        assert got[k] == tuple(values[int(len(values) * p)] for p in of.values())
    assert set(got) == {"a", "b", None, "d"}


def test_running_averages_over_stretches(spark):
    import random

    from folioforge.operators import tasks as K

    rnd = random.Random(3)
    rows = [(rnd.choice("xy"), k, None if rnd.random() < 0.3 else rnd.random() * 100) for k in range(3000)] + [("z", 1, None), (None, 1, 5.0)]
    got = {r.k: r.v for r in K.running_averages(spark.createDataFrame(rows, "k string, o long, v double").repartition(5), "k", "o", ("v",)).collect()}
    for key in ("x", "y", "z", None):
        average = 0.0
        for i, v in enumerate((v for k, _, v in rows if k == key), 1):
            average += 0.0 if v is None else (v - average) / i
        assert got[key] == pytest.approx(average)
