"""Files to packages: every file becomes a book, its chapter bodies, its images, or a row with its error.

Parsers give bodies; :func:`chapter_pages` is the one place that makes pages
of them, so that every page is XML and holds one h1.  Images that Markdown and
HTML files name are found among the scanned files by a join on their path.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import books as B
from ..shared import BATCH_BYTES, bounded, new_folder
from . import docx, epub, html, markdown
from .encoding import decode

#: Media types of images by suffix.
MEDIA = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "svg": "image/svg+xml", "webp": "image/webp"}
#: A larger image is its book's error, as a package is one task's work.
IMAGE_BYTES = 32 << 20
TEXT_SUFFIXES = ("txt", "md", "html", "htm", "epub", "docx")
ROWS = "doc_id long, kind string, pos int, name string, title string, author string, language string, body string, media string, cover boolean, data binary, error string"
_FIELDS = [f.split()[0] for f in ROWS.split(", ")]


@dataclass
class Book:
    """What a parser finds in a file."""

    title: str = ""
    author: str = ""
    language: str = ""
    chapters: list[tuple[str, str]] = field(default_factory=list)  # (title, body)
    images: list[tuple[str, str, bytes, bool]] = field(default_factory=list)  # (name, media type, data, is the cover)
    named: list[str] = field(default_factory=list)  # paths of images that stand beside the file


def _from_markdown(path: str, raw: bytes) -> Book:
    text = decode(raw)[0]
    found = markdown.chapters(text)
    title = next((unescape(t) for _, _, t, _ in found if t), "")
    return Book(title, chapters=[(unescape(t), body) for _, _, t, body in found], named=[p for _, p in markdown.images(text)])


def _from_html(path: str, raw: bytes) -> Book:
    page = decode(raw)[0]
    parsed = html.parse(page)
    sources = re.findall(r'<img[^>]*?\ssrc="([^"]+)"', "".join(m for _, m, _ in parsed.children))
    local = [s for s in sources if not re.match(r"[a-z]+:|/", s, re.I) and s.rsplit(".", 1)[-1].lower() in MEDIA]
    return Book(parsed.title.strip(), parsed.author.strip(), chapters=[(t, body) for _, _, t, body in html.chapters(page)], named=local)


def _from_epub(path: str, raw: bytes) -> Book:
    meta, docs, images = epub.package(raw)
    cover = epub.cover(images)
    chapters = []
    for k, (_, _, data) in enumerate(docs, 1):
        title, body = html.whole_body(epub.without_styles(data.decode("utf-8", "replace")))
        chapters.append((title or f"Chapter {k}", body))
    packed = [(posixpath.basename(p), MEDIA.get(p.rsplit(".", 1)[-1].lower(), "image/png"), data, p == cover) for _, p, data in images]
    return Book(meta["title"], meta["creator"], meta["language"], chapters, packed)


def _from_docx(path: str, raw: bytes) -> Book:
    z = docx.opened(raw)
    title, author = docx.properties(z)
    packed = [(name, media, data, k == 0) for k, (name, media, data) in enumerate(docx.images(z))]
    return Book(title, author, chapters=docx.chapters(z), images=packed)


_PARSERS = {"md": _from_markdown, "html": _from_html, "htm": _from_html, "epub": _from_epub, "docx": _from_docx}


def _suffix(path: str) -> str:
    return path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""


def _stem(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return name[: -len(_suffix(path)) - 1] if _suffix(path) else name


def _book_rows(key: int, path: str, raw: bytes) -> list[tuple]:
    parser = _PARSERS.get(_suffix(path))
    if parser is None:
        raise ValueError(f"no parser for files that end in {_suffix(path)!r}")
    b = parser(path, raw)
    title = b.title or _stem(path)
    row = lambda kind, pos, **given: (key, kind, pos, *[given.get(f) for f in _FIELDS[3:]])
    rows = [row("book", 0, title=title, author=b.author, language=b.language or "ja")]
    rows += [row("chapter", k, title=t or title, body=html.xml_text(body)) for k, (t, body) in enumerate(b.chapters or [("", "")], 1)]
    for k, (name, media, data, cover) in enumerate(b.images):
        if len(data) > IMAGE_BYTES:
            raise ValueError(f"image {name} is larger than {IMAGE_BYTES} bytes")
        rows.append(row("image", k, name=name, media=media, data=data, cover=cover))
    folder = path.rsplit("/", 1)[0] if "/" in path else ""
    rows += [row("named", k, name=posixpath.normpath(posixpath.join(folder, p.replace("\\", "/")))) for k, p in enumerate(dict.fromkeys(b.named))]
    return rows


def parsed(files: DataFrame) -> DataFrame:
    """Rows of books, chapters, images and named images of (doc_id, path, content) files but plain text; a file that fails is one row with its error."""

    kinds = {"pos": pa.int32(), "doc_id": pa.int64(), "cover": pa.bool_(), "data": pa.binary()}
    batch_of = lambda out: pa.RecordBatch.from_arrays([pa.array(c, kinds.get(f, pa.string())) for f, c in zip(_FIELDS, zip(*out))], _FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            keys, paths = (batch.column(c).to_pylist() for c in ("doc_id", "path"))
            for key, path, cell in zip(keys, paths, batch.column("content")):
                try:
                    rows = _book_rows(key, path or "", cell.as_py() or b"")
                except Exception as e:  # noqa: BLE001  whatever a bad file raises is its row's error
                    rows = [(key, "error", 0, *[None] * (len(_FIELDS) - 4), f"{type(e).__name__}: {e}")]
                out += rows
                size += sum(len(x) for row in rows for x in row if isinstance(x, str | bytes))
                if size > BATCH_BYTES // 4:
                    yield batch_of(out)
                    out, size = [], 0
            if out:
                yield batch_of(out)

    bounded(files.sparkSession)
    return files.select("doc_id", "path", "content").mapInArrow(run, ROWS)


def _plain(files: DataFrame) -> DataFrame:
    """The same rows for plain text, which goes through the line operators."""
    from . import decoded

    chapters = B.with_body(B.text_chapters(files.select("doc_id", decoded(F.col("content"))["text"].alias("text"))))
    one = F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1)
    title = chapters.where("idx = 1").select("doc_id", "title")
    first = files.join(title, "doc_id", "left").select("doc_id", F.lit("book").alias("kind"), F.lit(0).alias("pos"), F.coalesce(F.nullif(X.strip(F.element_at(F.split(decoded(F.col("content"))["text"], "\r\n|\r|\n"), 1)), F.lit("")), one).alias("title"), F.lit("").alias("author"), F.lit("ja").alias("language"))
    bodies = chapters.select("doc_id", F.lit("chapter").alias("kind"), F.col("idx").alias("pos"), F.nullif("title", F.lit("")).alias("title"), F.regexp_replace("body", _NOT_XML, "").alias("body"))
    return first.unionByName(bodies, allowMissingColumns=True)


#: Control characters that XML does not allow.
_NOT_XML = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uFFFE\\uFFFF]"


def one_h1(title: Column, body: Column) -> Column:
    """The body with one h1: its first, else a heading it begins with, else the title put before it; further ones become h2."""
    low = "(?s)^\\s*<h([1-6])([^>]*)>(.*?)</h\\1>"
    lifted = F.regexp_replace(body, low, "<h1$2>$3</h1>")
    with_head = F.when(body.rlike("<h1[\\s>]"), body).when(body.rlike(low), lifted).otherwise(F.concat(F.lit("<h1>"), X.escape_html(title), F.lit("</h1>\n    "), body))
    end = F.locate("</h1>", with_head) + 4
    rest = F.regexp_replace(F.substring(with_head, end + 1, F.length(with_head)), "<(/?)h1(?=[\\s>])", "<$1h2")
    return F.concat(F.substring(with_head, F.lit(1), end), rest)


def image_sources(body: Column) -> Column:
    """Image sources but web addresses, as the packed images of their file names."""
    return F.regexp_replace(body, r'(<img\b[^>]*?\ssrc=")(?![a-zA-Z]+:)(?:[^"]*/)?([^"/]+")', "$1../Images/$2")


def chapter_pages(chapters: DataFrame) -> DataFrame:
    """(doc_id, idx, chapter_id, title, html): pages of (doc_id, idx, title, body)."""
    body = one_h1(F.col("title"), image_sources(F.col("body")))
    chapter_id = F.concat(F.lit("chapter"), F.lpad(F.col("idx").cast("string"), 3, "0"))
    return chapters.select("doc_id", "idx", chapter_id.alias("chapter_id"), "title", B.page_html(F.col("title"), body).alias("html"))


def _kept(df: DataFrame, name: str) -> DataFrame:
    """A table in the shared folder, as a package reads its chapters many times."""
    spark, where = df.sparkSession, new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(where)
    return spark.read.schema(df.schema).parquet(where)


def books_of(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(books, chapters, images, errors) of (doc_id, path, content) files; image files among them are what others name.

    The files are parsed once; all but the books come from tables in the shared folder.
    """
    from . import fixed_uid

    is_image = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).isin(*MEDIA)
    is_text = F.lower("path").endswith(".txt")
    both = parsed(files.where(~is_image & ~is_text)).unionByName(_plain(files.where(is_text)), allowMissingColumns=True)
    rows = _kept(both, "parsed-files")
    beside = files.where(is_image).select(F.col("path").alias("name"), "content")
    found = rows.where("kind = 'named'").select("doc_id", "pos", "name").join(beside.withColumn("there", F.lit(True)).hint("merge"), "name", "left")
    lost = found.where(F.col("there").isNull() | (F.length("content") > IMAGE_BYTES)).groupBy("doc_id").agg(F.min(F.concat(F.lit("ValueError: image "), "name", F.lit(" is missing or too large"))).alias("error"))
    errors = rows.where("kind = 'error'").select("doc_id", "error").unionByName(lost)
    good = rows.join(errors.select("doc_id"), "doc_id", "left_anti")
    suffix = F.lower(F.regexp_extract("name", r"\.([^./]*)$", 1))
    media = F.element_at(F.create_map(*[F.lit(x) for pair in MEDIA.items() for x in pair]), suffix)
    packed = good.where("kind = 'image'").select("doc_id", "pos", "name", "media", "cover", "data")
    joined = found.join(errors.select("doc_id"), "doc_id", "left_anti").select("doc_id", "pos", F.substring_index("name", "/", -1).alias("name"), media.alias("media"), F.lit(False).alias("cover"), F.col("content").alias("data"))
    images = packed.unionByName(joined)
    last = images.groupBy("doc_id", "name").agg(F.max("pos").alias("pos"))  # of one file name the last
    images = _kept(images.join(last, ["doc_id", "name", "pos"]).dropDuplicates(["doc_id", "name"]), "book-images")
    books = good.where("kind = 'book'").select("doc_id", "title", "author", "language", fixed_uid(F.col("doc_id")).alias("uid"))
    titled = good.where("kind = 'chapter'").select("doc_id", F.col("pos").alias("idx"), "title", "body").join(books.select("doc_id", F.col("title").alias("_book")), "doc_id")
    chapters = _kept(chapter_pages(titled.withColumn("title", F.coalesce("title", "_book"))), "book-chapters")
    return books, chapters, images, errors


def convert(files: DataFrame) -> DataFrame:
    """(doc_id, content, error): a package for each file of text, or its error; image files are members of those that name them."""
    from . import pack_epub

    books, chapters, images, errors = books_of(files)
    packed = pack_epub(B.entries(books, chapters, images)).withColumn("error", F.lit(None).cast("string"))
    return packed.unionByName(errors.select("doc_id", F.lit(None).cast("binary").alias("content"), "error"))


def split_packages(files: DataFrame) -> DataFrame:
    """(doc_id, idx, file_name, content): one package per chapter, each with all images of its book."""
    from . import fixed_uid, pack_epub

    books, chapters, images, _ = books_of(files)
    names = B.split_books(chapters).select("doc_id", "idx", "file_name", "title")
    key = F.xxhash64("doc_id", "idx")
    each = names.select(key.alias("key"), "doc_id", "idx", "file_name")
    single = names.join(books.drop("title", "uid"), "doc_id").select(key.alias("doc_id"), "title", "author", "language", fixed_uid(key).alias("uid"))
    pages = chapters.select(key.alias("doc_id"), F.lit(1).alias("idx"), "chapter_id", "title", "html")
    shared = images.join(each.select("key", "doc_id"), "doc_id").drop("doc_id").withColumnRenamed("key", "doc_id")
    packed = pack_epub(B.entries(single, pages, shared)).withColumnRenamed("doc_id", "key")
    return each.join(packed, "key").select("doc_id", "idx", "file_name", "content")
