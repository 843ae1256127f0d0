"""Sinks of streams: appended records, and a log that is flushed in batches and rotated."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..shared import committed, delete, files_under

#: Records of one flush, seconds between flushes, bytes from which on a log is rotated.
FLUSH_ROWS, FLUSH_EVERY, LOG_BYTES = 100, "30 seconds", 1 << 20
_MANIFEST = "_manifest"


def append_json(stream: DataFrame, path: str, checkpoint: str, every: str | None = FLUSH_EVERY) -> StreamingQuery:
    """Appends each record of a stream as a line of JSON, exactly once; with ``every`` None, what is there now."""
    writer = stream.writeStream.format("json").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def log_state(spark: SparkSession, path: str) -> dict:
    """The newest manifest: the flushes of the log and of its rotated part, and the batch that was written last."""
    numbers = committed(spark, f"{path}/{_MANIFEST}", "n=")
    if not numbers:
        return {"n": 0, "query": None, "batch": -1, "current": [], "old": []}
    return json.loads(spark.read.text(f"{path}/{_MANIFEST}/n={numbers[-1]}").first()[0])


def _commit(spark: SparkSession, path: str, state: dict) -> None:
    """Writes a manifest; from the moment its folder is complete, readers see it."""
    spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{_MANIFEST}/n={state['n']}")


def rotated(state: dict, flushes: list[tuple[str, int]], limit: int) -> dict:
    """The state after the flushes: each looks at the log first, and rotates it from ``limit`` bytes on in place of what was rotated before."""
    current, old = list(state["current"]), list(state["old"])
    for name, size in flushes:
        if sum(b for _, b in current) >= limit:
            current, old = [], current
        current.append([name, size])
    return state | {"current": current, "old": old}


def flush(batch: DataFrame, number: int, query: str, path: str, rows: int = FLUSH_ROWS, limit: int = LOG_BYTES) -> None:
    """Writes a batch in flushes of at most ``rows`` records and commits it with the rotation that goes with it.

    A batch that is run again after its commit does nothing; one that failed
    before it replaces its own files and takes the same decisions, as they
    hang on the manifest before it alone.  So no record is lost or doubled,
    and what was rotated goes only after the commit.
    """
    spark = batch.sparkSession
    state = log_state(spark, path)
    if state["query"] == query and state["batch"] >= number:
        return
    folder = f"flushes-{query}-{number}"
    batch.write.mode("overwrite").option("maxRecordsPerFile", rows).json(f"{path}/{folder}")
    written = [(f"{folder}/{name}", size) for name, size, is_folder in files_under(spark, f"{path}/{folder}") if not is_folder and not name.startswith(("_", ".")) and size]
    new = rotated(state, written, limit) | {"n": state["n"] + 1, "query": query, "batch": number}
    _commit(spark, path, new)
    kept = {name for name, _ in new["current"] + new["old"]}
    for name in [n for n, _ in [*state["current"], *state["old"], *written] if n not in kept]:
        delete(spark, f"{path}/{name}")
    delete(spark, f"{path}/{_MANIFEST}/n={new['n'] - 2}")


def buffered_log(stream: DataFrame, path: str, checkpoint: str, every: str | None = FLUSH_EVERY, rows: int = FLUSH_ROWS, limit: int = LOG_BYTES) -> StreamingQuery:
    """Keeps a stream as a log of JSON lines, flushed once per trigger and every ``rows`` records, rotated from ``limit`` bytes on.

    Each record stands once in the log or its rotated part, whenever a batch
    fails; a stream that starts anew (another checkpoint) goes on with the log.
    """

    def one(batch: DataFrame, number: int) -> None:
        query = json.loads(batch.sparkSession.read.text(f"{checkpoint}/metadata").first()[0])["id"]
        flush(batch, number, query, path, rows, limit)

    writer = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def read_log(spark: SparkSession, path: str, schema: str, part: str = "current") -> DataFrame:
    """The records of the log (``current``), of its rotated part (``old``), or of ``both``; broken lines are skipped."""
    state = log_state(spark, path)
    names = {"current": state["current"], "old": state["old"], "both": state["old"] + state["current"]}[part]
    if not names:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json([f"{path}/{n}" for n, _ in names])
