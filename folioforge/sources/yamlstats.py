"""Statistics files in YAML: block maps and lists become rows of paths and values.

Reads what such files hold: nested maps and lists, quoted and plain scalars,
flow lists of scalars, comments.  Lines are read once against a stack of
indentations; a file beyond this becomes one row with its error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import bounded

VALUES = "doc_id long, path string, value string, error string"
_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s'"#\-\[\]{},][^:#]*?|-[^\s:][^:#]*?)\s*:(?:\s+(.*))?$""")
_COMMENT = re.compile(r"""((?:[^'"#]|"(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|(?<!\s)#|['"])*?)(?:(?:^|\s+)#.*)?$""")
_ESCAPES = {"n": "\n", "t": "\t", '"': '"', "\\": "\\", "/": "/", "0": "\0"}


def scalar(text: str) -> str | None:
    """A scalar without its quotes; null for ``null``, ``~`` and nothing."""
    if text[:1] == '"' and text[-1:] == '"' and len(text) > 1:
        return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[0]), text[1:-1])
    if text[:1] == "'" and text[-1:] == "'" and len(text) > 1:
        return text[1:-1].replace("''", "'")
    return None if text in ("", "~", "null", "Null", "NULL") else text


def _tokens(indent: int, body: str) -> tuple[list[tuple[int, str | None]], str]:
    """The items and the key that a line begins, as (depth, key or None), and what follows them.

    An item is deeper than a key of its indentation, as lists may stand under their key without one.
    """
    out: list[tuple[int, str | None]] = []
    while body == "-" or body.startswith("- "):
        out.append((2 * indent + 1, None))
        rest = body[1:].lstrip(" ")
        indent, body = indent + len(body) - len(rest), rest
    if found := _KEY.match(body):
        out.append((2 * indent, scalar(found[1])))
        body = (found[2] or "").strip()
    return out, body


@lru_cache(1 << 14)
def _line(raw: str) -> tuple[list[tuple[int, str | None]], str, str] | None:
    """(tokens, what follows them, first sign) of a line; None for one that holds nothing. Files of one kind share most of their lines."""
    line = (_COMMENT.match(raw)[1] if "#" in raw else raw).rstrip()
    body = line.lstrip(" ")
    return (*_tokens(len(line) - len(body), body), body[0]) if body and body != "---" else None


def values(text: str) -> Iterator[tuple[str, str | None]]:
    """(path, value) of the scalars of a file, in order; a path is keys and places joined by dots."""
    stack: list[tuple[int, str | int | None]] = []
    open_depth = None  # that of the last key or item, while nothing has followed it
    path = lambda: ".".join(str(name) for _, name in stack)
    for number, raw in enumerate(text.replace("\r\n", "\n").split("\n"), 1):
        if (read := _line(raw)) is None:
            continue
        tokens, rest, first = read
        if not tokens or first in "&*!|>%@`\t":
            raise ValueError(f"line {number} is beyond plain block YAML")
        for depth, name in tokens:
            if open_depth is not None and depth <= open_depth:
                yield path(), None
            open_depth = None
            while stack and stack[-1][0] > depth:
                stack.pop()
            before = stack.pop()[1] if stack and stack[-1][0] == depth else -1
            stack.append((depth, before + 1 if depth % 2 else name))
        if rest:
            yield from _flow(path(), rest, number)
        else:
            open_depth = stack[-1][0]
    if open_depth is not None:
        yield path(), None


def _flow(path: str, body: str, number: int) -> Iterator[tuple[str, str | None]]:
    if body in ("[]", "{}"):
        return
    if body[0] == "[" and body[-1] == "]":
        for k, part in enumerate(re.findall(r"""\s*("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^,]+)\s*(?:,|$)""", body[1:-1])):
            yield f"{path}.{k}", scalar(part.strip())
    elif body[0] in "[{&*!|>":
        raise ValueError(f"line {number} is beyond plain block YAML")
    else:
        yield path, scalar(body)


def yaml_values(files: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, path, value, error) of YAML files; null values keep their path, empty lists and maps have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, paths, found, errors = [], [], [], []
            for key, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    read, error = list(values(content or "")), None
                except ValueError as e:
                    read, error = [(None, None)], str(e)
                keys += [key] * len(read)
                paths += [p for p, _ in read]
                found += [v for _, v in read]
                errors += [error] * len(read)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *(pa.array(c, pa.string()) for c in (paths, found, errors))], ["doc_id", "path", "value", "error"])

    spark = files.sparkSession
    bounded(spark)
    # a small table of many small files may be one split: its files are dealt out to as many tasks as a shuffle has
    return files.select("doc_id", text).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id").mapInArrow(run, VALUES)


def scan_stats(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, agent, text) of the ``*-stats.yaml`` files of a folder; the agent is the name of the file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*-stats.yaml").load(folder)
    agent = F.regexp_extract("path", "([^/]+)-stats[.]yaml$", 1)
    return files.select(F.xxhash64("path").alias("doc_id"), F.try_url_decode(agent).alias("agent"), F.decode("content", "UTF-8").alias("text"))


#: Numbers of a statistics file that count as 0 where they are missing.
NUMBERS = ("total_tasks", "successful_tasks", "failed_tasks", "success_rate", "avg_quality_score", "avg_duration_ms", "trends.success_rate_trend", "trends.quality_score_trend", "trends.avg_duration_trend")


def agent_stats(files: DataFrame) -> DataFrame:
    """One row per readable file of (doc_id, agent, text): its name, numbers and how many recent tasks it lists.

    Values come from one aggregation over the paths; a file's own agent_name goes before that of the file.
    """
    rows = yaml_values(files)
    of = lambda p: F.max(F.when(F.col("path") == p, F.col("value")))
    task = F.regexp_extract("path", r"^recent_tasks\.([0-9]+)", 1)
    named = [F.coalesce(of(p).try_cast("double"), F.lit(0.0)).alias(p.rsplit(".", 1)[-1]) for p in NUMBERS]
    got = rows.groupBy("doc_id").agg(of("agent_name").alias("_name"), *named, F.size(F.collect_set(F.when(task != "", task))).alias("recent_tasks"), F.max("error").alias("error"))
    return files.join(got, "doc_id", "left").where("error is null").select("doc_id", F.coalesce("_name", "agent").alias("agent"), *[F.coalesce(F.col(p.rsplit(".", 1)[-1]), F.lit(0.0)).alias(p.rsplit(".", 1)[-1]) for p in NUMBERS], F.coalesce("recent_tasks", F.lit(0)).alias("recent_tasks"))
