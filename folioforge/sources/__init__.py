"""Parsers of file formats, on the standard library, as Arrow-batched functions.

A parser takes (doc_id, content) rows, where content is binary or text, and
gives one row per block or chapter.  A file that cannot be parsed becomes one
row with its error, so that one bad file never fails a corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from . import docx, epub, html, markdown
from .conversion import books_of as books_of
from .conversion import split_packages as split_packages
from .encoding import decode

SUFFIXES = ("txt", "md", "html", "htm", "epub", "docx", "pdf")
BLOCKS = "doc_id long, pos int, kind string, level int, content string, error string"
CHAPTERS = "doc_id long, idx int, chapter_id string, title string, html string, error string"


def scan(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """Files of a folder, not of those below it, with one of the suffixes: (path, length, content)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}").option("recursiveFileLookup", "false").load(folder)


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("encoding", StringType())]))
def decoded(content: pd.Series) -> pd.DataFrame:
    """Text and encoding of file contents: the first encoding, in fixed order, with most Japanese characters."""
    return pd.DataFrame([decode(bytes(b)) if b is not None else (None, None) for b in content], columns=["text", "encoding"])


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode normal form C, for which Spark has no function."""
    import unicodedata

    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def _parse(df: DataFrame, content: str, parse: Callable, columns: list[str], schema: str) -> DataFrame:
    from ..shared import bounded

    bounded(df.sparkSession)
    names = ["doc_id", *columns, "error"]
    kinds = [{"long": pa.int64(), "int": pa.int32()}.get(f.split()[1], pa.string()) for f in schema.split(", ")]
    batch_of = lambda out: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for key, cell in zip(batch.column(0).to_pylist(), batch.column(1)):
                value = cell.as_py()  # one by one: a batch of texts is not held twice
                try:
                    rows = [(key, *row, None) for row in parse(value)]
                except Exception as e:  # noqa: BLE001  whatever a bad file raises is its row's error
                    rows = [(key, *[None] * len(columns), f"{type(e).__name__}: {e}")]
                out += rows
                size += sum(len(x) for row in rows for x in row if isinstance(x, str))
                if size > PACKED_BYTES:
                    yield batch_of(out)
                    out, size = [], 0
            if out:
                yield batch_of(out)

    return df.select("doc_id", content).mapInArrow(run, schema)


def markdown_blocks(df: DataFrame, text: str = "text") -> DataFrame:
    """Blocks of Markdown: headings, paragraphs, lists, code, rules."""
    return _parse(df, text, lambda t: [(k, b.kind, b.level, b.content) for k, b in enumerate(markdown.blocks(t or ""))], ["pos", "kind", "level", "content"], BLOCKS)


def markdown_chapters(df: DataFrame, text: str = "text", split_level: int = 1) -> DataFrame:
    """Chapters of Markdown, begun by headings of at most ``split_level`` (1 to 6)."""
    return _parse(df, text, lambda t: markdown.chapters(t or "", split_level), ["idx", "chapter_id", "title", "html"], CHAPTERS)


def html_chapters(df: DataFrame, text: str = "html", as_written: bool = False) -> DataFrame:
    """Chapters of HTML: element children of the body, begun by its h1 and h2 children; ``as_written`` keeps open references."""
    return _parse(df, text, lambda t: html.chapters(t or "", as_written), ["idx", "chapter_id", "title", "html"], CHAPTERS)


def epub_chapters(df: DataFrame, content: str = "content") -> DataFrame:
    """Chapters of EPUB packages in the order of the spine (all documents if it is empty)."""
    return _parse(df, content, lambda b: epub.chapters(bytes(b)), ["idx", "chapter_id", "title", "html"], CHAPTERS)


def file_chapters(files: DataFrame) -> DataFrame:
    """Chapters of (doc_id, path, content) files as pages, each by the parser of its suffix, and a row for each file that fails."""
    from .conversion import books_of

    _, chapters, _, errors = books_of(files)
    failed = errors.select("doc_id", *[F.lit(None).cast(t).alias(c) for c, t in (("idx", "int"), ("chapter_id", "string"), ("title", "string"), ("html", "string"))], "error")
    return chapters.withColumn("error", F.lit(None).cast("string")).unionByName(failed)


def convert(files: DataFrame) -> DataFrame:
    """(doc_id, content, error): see :func:`folioforge.sources.conversion.convert`."""
    from . import conversion

    return conversion.convert(files)


def docx_blocks(df: DataFrame, content: str = "content") -> DataFrame:
    """Blocks of Word documents in the order of the body."""
    return _parse(df, content, lambda b: docx.blocks(bytes(b)), ["pos", "kind", "level", "content"], BLOCKS)


def docx_footnotes(df: DataFrame, content: str = "content") -> DataFrame:
    """(doc_id, note_id, note, error): footnotes of Word documents."""
    return _parse(df, content, lambda b: list(docx.footnotes(bytes(b)).items()), ["note_id", "note"], "doc_id long, note_id string, note string, error string")


#: Bytes of results that a task hands on at once.
PACKED_BYTES = 4 << 20


def pack_epub(entries: DataFrame) -> DataFrame:
    """(doc_id, content): packages zipped from (doc_id, ord, path, stored, content); a task streams through its books, one after the other."""
    from ..shared import bounded

    bounded(entries.sparkSession)
    text = entries.schema["content"].dataType.typeName() == "string"
    rows = entries.select("doc_id", "ord", "path", "stored", "content").repartition("doc_id").sortWithinPartitions("doc_id", "ord")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, key, members = [], 0, None, []
        for batch in batches:
            for doc, _, path, stored, content in zip(*(c.to_pylist() for c in batch.columns)):
                if members and doc != key:
                    out.append((key, epub.write(members)))
                    size, members = size + len(out[-1][1]), []
                    if size > PACKED_BYTES:
                        yield _packed(out)
                        out, size = [], 0
                key = doc
                members.append((path, stored, content if text or content is None else bytes(content)))
        if members:
            out.append((key, epub.write(members)))
        if out:
            yield _packed(out)

    return rows.mapInArrow(run, "doc_id long, content binary")


def _packed(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([raw for _, raw in out], pa.binary())], ["doc_id", "content"])


def fixed_uid(key: Column) -> Column:
    """A stable identifier in the form of a UUID."""
    h = F.sha2(key.cast("string"), 256)
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
