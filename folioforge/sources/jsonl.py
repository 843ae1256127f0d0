"""Logs of JSON lines: scans that skip, keep or refuse broken lines, and logs of operations that are compacted."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.retrieval import replay
from ..shared import committed, delete

#: What a scan does with broken lines.
MODES = {"skip": "DROPMALFORMED", "fail": "FAILFAST", "keep": "PERMISSIVE"}
BAD_LINE = "bad_line"


def scan_jsonl(spark: SparkSession, path: str, schema: str, bad: str = "skip") -> DataFrame:
    """Rows of the JSON lines under ``path``, which may be dealt to folders (``day=2024-01-05``).

    Broken lines are skipped, or end the job (``fail``), or stand in ``bad_line`` beside nulls
    (``keep``).  Blank lines are no rows.  Filters on plain columns reach the scan.
    """
    if bad == "keep":
        lines = spark.read.text(path).where(F.trim("value") != "")
        parsed = F.from_json("value", f"{schema}, {BAD_LINE} string", {"mode": MODES[bad], "columnNameOfCorruptRecord": BAD_LINE})
        return lines.withColumn("_parsed", parsed).select(*[c for c in lines.columns if c != "value"], "_parsed.*")
    return spark.read.option("mode", MODES[bad]).schema(schema).json(path)


def quarantined(kept: DataFrame, path: str) -> DataFrame:
    """The whole rows of a scan that keeps broken lines, once these are written as text to ``path``."""
    broken = F.col(BAD_LINE).isNotNull()
    kept.where(broken).select(BAD_LINE).write.mode("append").text(path)
    return kept.where(~broken).drop(BAD_LINE)


def since(rows: DataFrame, start: datetime, time: str = "timestamp", day: str | None = None) -> DataFrame:
    """Rows from ``start`` on; with ``day``, a folder column of the day, older folders are not read."""
    if day:
        rows = rows.where(F.col(day) >= F.lit(start.date()))
    return rows.where(F.col(time) >= F.lit(start))


def recent(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """The last ``n`` rows: a top-k per task, then of these."""
    return rows.orderBy(*order).limit(n)


LOG = "op string, id string, entry string, timestamp long, line_no long"
_GENERATION = "gen="


def _generation(spark: SparkSession, path: str) -> int:
    """The newest generation that is complete and named by a pointer; 0 without one."""
    return max(committed(spark, f"{path}/_pointers", _GENERATION), default=0)


def append_operations(rows: DataFrame, path: str) -> None:
    """Appends (op, id, entry, timestamp, line_no) to a log."""
    spark = rows.sparkSession
    rows.select("op", "id", "entry", "timestamp", "line_no").write.mode("append").json(f"{path}/{_GENERATION}{_generation(spark, path)}")


def read_operations(spark: SparkSession, path: str) -> DataFrame:
    """The operations of the generation that the pointer names; broken lines are skipped."""
    return scan_jsonl(spark, f"{path}/{_GENERATION}{_generation(spark, path)}", LOG)


def compact(spark: SparkSession, path: str, timestamp: int) -> int:
    """Rewrites a log as one ``add`` of ``timestamp`` for each live entry; returns the new generation.

    The new generation is written beside the old one, then the pointer moves
    in one step; a failure in between leaves the old log in force.  The
    generation before stays for those who read it, older ones go.  One writer
    at a time.
    """
    old = _generation(spark, path)
    live = replay(read_operations(spark, path)).select(F.lit("add").alias("op"), "id", "entry", F.lit(timestamp).cast("long").alias("timestamp"), F.lit(0).cast("long").alias("line_no"))
    live.write.mode("overwrite").json(f"{path}/{_GENERATION}{old + 1}")
    _point(spark, path, old + 1)
    delete(spark, f"{path}/{_GENERATION}{old - 1}")
    return old + 1


def _point(spark: SparkSession, path: str, generation: int) -> None:
    """The pointer is in force once its folder is complete."""
    spark.createDataFrame([(str(generation),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_pointers/{_GENERATION}{generation}")
