"""Page composition: word boxes of pages become paragraphs and chapters in reading order.

words (doc_id, page, text, x0, top, bottom, page_w, page_h).  A page is one
group: the band, the median height, the columns and the fold of words to lines
and paragraphs all come from a single exchange by page.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..shared import bounded
from .books import _by_pos, chapter_html
from .windows import body_band

#: The title of what precedes the first heading, and the longest paragraph that can be a heading.
BODY_TITLE, HEADING_CHARS = "本文", 30
NO_TEXT = "no text on any page"
#: Words that a task composes at once, at least; a page that is longer is held whole.
WORDS_AT_ONCE = 50_000
PARAGRAPHS = "doc_id long, page int, column int, paragraph int, text string"


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before it in any column; the first does."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _within(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Running sums that begin again where a group starts."""
    total = np.cumsum(values)
    return total - (total - values)[starts][np.cumsum(starts) - 1]


def _joined(text: pa.Array, starts: np.ndarray) -> pa.Array:
    """The texts of each group as one."""
    offsets = pa.array(np.append(np.flatnonzero(starts), len(text)), pa.int64())
    return pc.binary_join(pa.LargeListArray.from_arrays(offsets, text), pa.scalar("", pa.large_string()))


def _line_numbers(starts: np.ndarray, top: np.ndarray, tol: np.ndarray) -> np.ndarray:
    """A word joins the line whose first word is within the tolerance of its top, else it begins one."""
    out, line, anchor = [], -1, 0.0
    for new, y, t in zip(starts.tolist(), top.tolist(), tol.tolist()):
        if new or abs(y - anchor) > t:
            line, anchor = line + 1, y
        out.append(line)
    return np.array(out, np.int64)


def _paragraphs(words: pa.Table, gap: float, tolerance: float, least: float, spacing: float) -> pa.RecordBatch:
    """Paragraphs of whole pages, whose words stand together."""
    doc_valid = np.asarray(words["doc_id"].is_valid())
    of = lambda c: words[c].to_numpy()
    doc = np.asarray(words["doc_id"].fill_null(0))
    page_start = _starts(doc, doc_valid, of("page"))
    page = np.cumsum(page_start) - 1
    x0, top, bottom = of("x0"), of("top"), of("bottom")
    x, size = np.rint(x0), np.bincount(page)
    by_height = (bottom - top)[np.lexsort((bottom - top, page))]
    first = np.cumsum(size) - size
    height = ((by_height[first + (size - 1) // 2] + by_height[first + size // 2]) / 2)[page]
    tol = np.maximum(height * tolerance, least)
    left = np.lexsort((x, page))
    cut = np.zeros(len(x), np.int64)
    cut[1:] = (np.diff(x[left]) > of("page_w")[left][1:] * gap) & (np.diff(page[left]) == 0)
    from_left = _within(cut, page_start)
    column = np.empty(len(x), np.int64)
    column[left] = np.maximum.reduceat(from_left, np.flatnonzero(page_start))[page] - from_left
    keys = pa.table({"page": page, "column": column, "row": np.rint(top / tol), "x0": x0, "top": top, "text": words["text"].combine_chunks()})
    order = pc.sort_indices(keys, sort_keys=[(c, "ascending") for c in keys.column_names], null_placement="at_start").to_numpy()
    page, column, x0, top, bottom, tol, height = (c[order] for c in (page, column, x0, top, bottom, tol, height))
    line = _line_numbers(_starts(page, column), top, tol)
    again = np.lexsort((x0, line))  # words of a line by place, else as they stood
    begins = _starts(line)
    text = words["text"].combine_chunks().take(pa.array(order)).fill_null("").cast(pa.large_string()).take(pa.array(again))
    lines = pc.utf8_trim_whitespace(_joined(text, begins))
    filled = np.asarray(pc.not_equal(lines, ""))
    at = np.flatnonzero(begins)
    line_bottom = np.maximum.reduceat(bottom[again], at)[filled]
    line_top, page, column, space, place = top[again][at][filled], page[at][filled], column[at][filled], (height * spacing)[at][filled], order[at][filled]
    column_start = _starts(page, column)
    new = column_start.copy()
    new[1:] |= line_top[1:] - line_bottom[:-1] > space[1:]
    paragraph = _within(new.astype(np.int64), column_start) - 1
    text = _joined(lines.filter(pa.array(filled)), new) if len(new) else pa.array([], pa.large_string())
    rows = place[new]
    return pa.RecordBatch.from_arrays(
        [words["doc_id"].combine_chunks().take(pa.array(rows)), pa.array(of("page")[rows], pa.int32()), pa.array(column[new], pa.int32()), pa.array(paragraph[new], pa.int32()), text.cast(pa.string())],
        ["doc_id", "page", "column", "paragraph", "text"],
    )


def page_paragraphs(words: DataFrame, gap: float = 0.1, tolerance: float = 0.6, least: float = 4.0, spacing: float = 1.5) -> DataFrame:
    """Paragraphs of pages: (doc_id, page, column, paragraph, text); words outside the body band go.

    Columns are parted by gaps in the rounded places of the words, in reading
    order, the right one first.  Words stand by column, then row, then place.
    A word joins the line whose first word is within the tolerance of its top,
    so the anchor moves from line to line; a line begins a paragraph if it
    stands ``spacing`` median heights below the line before.  Lines of blanks
    are nothing.  Words are shuffled and sorted once, by page, and a task
    computes the whole pages of a batch together.
    """
    bounded(words.sparkSession)
    rows = body_band(words).where("x0 is not null and bottom is not null").select("doc_id", F.col("page").cast("int").alias("page"), *[F.col(c).cast("double").alias(c) for c in ("x0", "top", "bottom", "page_w")], "text")
    rows = rows.repartition("doc_id", "page").sortWithinPartitions("doc_id", "page")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(len(b) for b in held) < WORDS_AT_ONCE:
                continue
            table = pa.Table.from_batches(held)
            last = table.slice(len(table) - 1).select(["doc_id", "page"]).to_pylist()[0]
            same = lambda c: pc.is_null(table[c]) if last[c] is None else pc.equal(table[c], last[c]).combine_chunks().fill_null(False)
            whole = len(table) - pc.sum(pc.and_(same("doc_id"), same("page"))).as_py()  # the last page may go on
            if whole:
                yield _paragraphs(table.slice(0, whole), gap, tolerance, least, spacing)
            held = table.slice(whole).to_batches()
        if held and sum(len(b) for b in held):
            yield _paragraphs(pa.Table.from_batches(held), gap, tolerance, least, spacing)

    return rows.mapInArrow(run, PARAGRAPHS)


def page_chapters(paragraphs: DataFrame, docs: DataFrame) -> DataFrame:
    """Chapters of composed pages: (doc_id, idx, chapter_id, title, html, error); a document of ``docs`` without text has a row with its error.

    A paragraph of at most HEADING_CHARS signs that starts like a heading begins a
    chapter.  Sections without paragraphs go where no chapter came before or none comes after.
    """
    reading = Window.partitionBy("doc_id").orderBy("page", "column", "paragraph")
    head = X.strip(F.col("text"))
    rows = paragraphs.withColumn("is_head", (F.length(head) <= HEADING_CHARS) & head.rlike(X.PAGE_HEADING)).withColumn("pos", F.row_number().over(reading))
    rows = rows.withColumn("sec", F.sum(F.col("is_head").cast("int")).over(reading.rowsBetween(Window.unboundedPreceding, 0)))
    html = F.concat(F.lit("<p>"), X.escape_html(F.col("text")), F.lit("</p>"))
    secs = rows.groupBy("doc_id", "sec").agg(F.coalesce(F.max(F.when(F.col("is_head"), head)), F.lit(BODY_TITLE)).alias("title"), _by_pos(F.when(~F.col("is_head"), html)).alias("paras"))
    book, so_far = Window.partitionBy("doc_id"), Window.partitionBy("doc_id").orderBy("sec")
    full = (F.size("paras") > 0).cast("int")
    last = F.col("sec") == F.max("sec").over(book)
    keep = (full == 1) | (~last & (F.max(full).over(so_far) == 1)) | (last & (F.max(full).over(book) == 0))
    kept = secs.withColumn("keep", keep).where("keep").withColumn("idx", F.row_number().over(so_far))
    chapter_id = F.concat(F.lit("chapter"), F.lpad(F.col("idx").cast("string"), 3, "0"))
    done = kept.select("doc_id", "idx", chapter_id.alias("chapter_id"), "title", chapter_html(F.col("title"), F.array_join("paras", "\n    ")).alias("html"))
    return docs.select("doc_id").distinct().join(done, "doc_id", "left").withColumn("error", F.when(F.col("idx").isNull(), NO_TEXT))
