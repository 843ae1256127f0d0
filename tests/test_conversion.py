"""Files to packages: pages are XML with one h1, nothing is lost, and what fails says so."""

import io
import zipfile
from xml.etree import ElementTree

from pyspark.sql import functions as F

from folioforge import sources as S
from folioforge.operators import books as B
from folioforge.operators import pages as P
from folioforge.operators import risk as R
from folioforge.operators import windows as W
from folioforge.sources import conversion, epub, html

XHTML = "{http://www.w3.org/1999/xhtml}"
OPF = (
    '<package xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>T &amp; U</dc:title><dc:creator>Who</dc:creator><dc:language>fr</dc:language></metadata><manifest>'
    '<item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="s" href="s.svg" media-type="image/svg+xml"/><item id="cover-image" href="i/c.png" media-type="image/png"/></manifest><spine><itemref idref="s"/><itemref idref="a"/></spine></package>'
)


def an_epub():
    container = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="O/c.opf"/></rootfiles></container>'
    page = '<?xml version="1.0"?><!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body>loose <b>text<p>a<h1>One &eacute;</h1><img src="../x/c.png"><h1>Two</h1><h2>Sub &lt;</h2><script>1<2</script></body></html>'
    return epub.write([("mimetype", True, "application/epub+zip"), ("META-INF/container.xml", False, container), ("O/c.opf", False, OPF), ("O/a.xhtml", False, page), ("O/s.svg", False, "<svg/>"), ("O/i/c.png", False, b"cover")])


def a_docx():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda style, text: f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'
    ref = '<w:p><w:r><w:t>see</w:t><w:footnoteReference w:id="5"/></w:r></w:p>'
    return epub.write([
        ("word/document.xml", False, f"<w:document {w}><w:body>{p('Normal', 'pre')}{p('Heading1', 'H &amp; I')}{p('ListBullet', 'i')}{p('ListBullet', 'j')}{ref}</w:body></w:document>"),
        ("word/footnotes.xml", False, f'<w:footnotes {w}><w:footnote w:id="5">{p("", "the note")}</w:footnote></w:footnotes>'),
        ("docProps/core.xml", False, '<c xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:creator>Word &amp; Co</dc:creator></c>'),
        ("word/_rels/document.xml.rels", False, '<r><x Type="http://x/image" Target="media/k.png"/></r>'), ("word/media/k.png", False, b"drawn"),
        ("[Content_Types].xml", False, '<t><d Extension="png" ContentType="image/png"/></t>'),
    ])


FILES = [
    (1, "d/a.md", b"# A *x*\n![p](img/p.png) text & <b>\n\n## Part\nmore\n# B\n\x0bend"), (2, "d/b.txt", "題 & 名\n\n第1章 始\n本文 <b>\x01\n".encode()), (3, "d/c.HTM", b"<title>C</title><meta name=author content=Me><body>no<p @a=1 x:y=2 class=k>one<o:p>two</o:p><div><h1>In</h1></div><h2>D</h2><img src='img/q.JPG'><img src=http://x/y.png></body>"),
    (4, "d/d.epub", an_epub()), (5, "d/e.xyz", b"?"), (6, "d/f.epub", b"no zip"), (7, "d/g.md", b"![p](img/none.png)"), (8, "d/h.md", b"![p](http://x/a.png)"), (9, "d/i.docx", a_docx()), (10, "d/j.md", b""), (11, "d/k.txt", b""), (12, "d/l.html", None),
    (-1, "d/img/p.png", b"png bytes"), (-2, "d/img/q.JPG", b"jpg bytes"), (-3, "d/img/unused.gif", b"gif"),
]


def frame(spark):
    return spark.createDataFrame([(k, p, bytearray(c) if c is not None else None) for k, p, c in FILES], "doc_id long, path string, content binary").repartition(3)


def members(raw):
    z = zipfile.ZipFile(io.BytesIO(bytes(raw)))
    return {n: z.read(n) for n in z.namelist()}


def test_packages_are_whole_and_well_formed(spark):
    rows = {r.doc_id: r for r in S.convert(frame(spark)).collect()}
    assert sorted(rows) == list(range(1, 13))
    assert {k for k, r in rows.items() if r.error} == {5, 6, 7, 8}
    assert "'xyz'" in rows[5].error and "d/img/none.png is missing" in rows[7].error and "http://x/a.png" in rows[8].error
    for k, r in rows.items():
        if r.error:
            assert r.content is None
            continue
        inside = members(r.content)
        trees = {n: ElementTree.fromstring(c) for n, c in inside.items() if n.endswith((".xhtml", ".opf", ".ncx", ".xml"))}
        chapters = [n for n in inside if n.startswith("OEBPS/Text/")]
        assert chapters and all(len(list(trees[n].iter(f"{XHTML}h1"))) == 1 for n in chapters), k
        listed = [i.get("href") for i in trees["OEBPS/content.opf"].iter("{http://www.idpf.org/2007/opf}item")]
        assert {f"OEBPS/{h}" for h in listed} == set(inside) - {"mimetype", "META-INF/container.xml", "OEBPS/content.opf"}
        for n in chapters:
            for img in trees[n].iter(f"{XHTML}img"):
                src = img.get("src")
                assert src.startswith("http") or "OEBPS/" + src.removeprefix("../") in inside
    assert members(rows[1].content)["OEBPS/Images/p.png"] == b"png bytes" and members(rows[3].content)["OEBPS/Images/q.JPG"] == b"jpg bytes"
    nine = members(rows[9].content)
    assert nine["OEBPS/Images/docx_img001.png"] == b"drawn" and any(b'id="fn-5"><p>the note</p>' in c and b'href="#fn-5"><sup>1</sup>' in c and b"<li>i</li><li>j</li>" in c for n, c in nine.items() if "Text/" in n)
    four = members(rows[4].content)
    assert four["OEBPS/Images/c.png"] == b"cover" and b'properties="cover-image"' in four["OEBPS/content.opf"]
    meta, docs, images = epub.package(bytes(rows[4].content))
    assert meta == {"title": "T & U", "creator": "Who", "language": "fr"} and epub.cover(images) == "OEBPS/Images/c.png" and "loose" in docs[0][2].decode()
    assert '<meta name="dtb:depth" content="2"/>'.encode() in four["OEBPS/toc.ncx"] and four["OEBPS/toc.ncx"].count(b"<navPoint") == 3  # Two and Sub are second headings


def test_titles_and_chapters(spark):
    books, chapters, _, _ = conversion.books_of(frame(spark))
    titles = {r.doc_id: (r.title, r.author, r.language) for r in books.collect()}
    assert titles == {1: ("A x", "", "ja"), 2: ("題 & 名", "", "ja"), 3: ("C", "Me", "ja"), 4: ("T & U", "Who", "fr"), 9: ("i", "Word & Co", "ja"), 10: ("j", "", "ja"), 11: ("k", "", "ja"), 12: ("l", "", "ja")}
    got = {}
    for r in chapters.orderBy("doc_id", "idx").collect():
        got.setdefault(r.doc_id, []).append(r.title)
    assert got[1] == ["A x", "B"] and got[3] == ["C", "D"] and got[4] == ["One é"] and got[9] == ["i", "H & I"] and got[10] == ["j"]


def test_split_packages_share_the_images(spark):
    rows = S.split_packages(frame(spark).where("doc_id in (1, -1)")).orderBy("idx").collect()
    assert [(r.doc_id, r.idx, r.file_name) for r in rows] == [(1, 1, "001_A_x.epub"), (1, 2, "002_B.epub")]
    for r in rows:
        inside = members(r.content)
        assert inside["OEBPS/Images/p.png"] == b"png bytes" and len([n for n in inside if "Text/" in n]) == 1
    assert [c[2] for c in epub.chapters(bytes(rows[1].content))] == ["B"]


def test_no_files_no_packages(spark):
    assert S.convert(frame(spark).where("doc_id > 99")).count() == 0


def test_whole_bodies_keep_loose_text():
    assert html.whole_body("<html><body>a &lt; b<p>c<p>d<svg:x>e</svg:x></body></html>") == ("", "a &lt; b<p>c</p><p>de</p>")
    assert html.whole_body("<body><h2>T &amp; <i>U</i></h2></body>") == ("T & U", "<h2>T &amp; <i>U</i></h2>")


def test_single_page_with_images(spark):
    books, chapters, images, _ = conversion.books_of(frame(spark).where("doc_id in (1, -1)"))
    page = B.single_html(chapters, images).first().html
    assert 'src="data:image/png;base64,cG5nIGJ5dGVz"' in page and "../Images" not in page


def test_pages_are_composed_by_band_column_line_and_paragraph(spark):
    w = lambda text, x0, top, page=0, doc=1: (doc, page, text, float(x0), float(top), top + 10.0, 700.0, 1000.0)
    rows = [w("HEAD", 0, 5), w("left1", 0, 100), w("left2", 0, 112), w("right1", 400, 100), w("right2", 400, 160), w("b", 430, 103), w(" ", 0, 130), w("foot", 0, 990), w("第1章", 0, 100, 1), w("x", 0, 200, 1), w("only head", 0, 1, 0, 2)]
    words = spark.createDataFrame(rows, "doc_id long, page int, text string, x0 double, top double, bottom double, page_w double, page_h double")
    paras = P.page_paragraphs(words)
    assert [tuple(r)[1:] for r in paras.orderBy("doc_id", "page", "column", "paragraph").collect()] == [(0, 0, 0, "right1b"), (0, 0, 1, "right2"), (0, 1, 0, "left1left2"), (1, 0, 0, "第1章"), (1, 0, 1, "x")]
    got = P.page_chapters(paras, words).orderBy("doc_id", "idx").collect()
    assert [(r.doc_id, r.idx, r.title, r.error) for r in got] == [(1, 1, "本文", None), (1, 2, "第1章", None), (2, None, None, P.NO_TEXT)]
    assert "<p>right1b</p>\n    <p>right2</p>\n    <p>left1left2</p>" in got[0].html
    assert W.reading_lines(words).count() > 0


def test_the_cascade_asks_one_model_after_the_other(spark):
    rows = [("high" if k % 2 else "low", [float(k % 2), float(k % 3 == 0)]) for k in range(40)]
    df = spark.createDataFrame(rows, "y string, f array<double>")
    tree = R.grow_tree(df, "y", "f")
    got = R.tree_predict(df, tree, "f")
    assert got.where("tree_risk <> y").count() == 0 and {r.tree_confidence for r in got.collect()} == {70}
    unsure = [("low", 1, [0.5, 0.5]), ("high", 1, [0.5, 0.5])]
    sure = [("low", 20, [0.0, 10.0]), ("high", 20, [20.0, 10.0])]
    methods = lambda bayes, t: {r.method for r in R.cascade_predict(df, bayes, t, F.lit("medium"), "f").collect()}
    assert (methods(sure, tree), methods(unsure, tree), methods(unsure, []), methods([], tree)) == ({"bayes"}, {"tree"}, {"rule"}, {"rule"})
    assert {(r.tree_risk, r.tree_confidence) for r in R.tree_predict(df, [], "f").collect()} == {("medium", 0)}
