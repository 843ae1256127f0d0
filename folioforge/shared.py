"""The folder that driver and executors share, for logs and tables of the library."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of this machine for a session that runs on this machine alone."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = "/tmp/checkpoints/folioforge"
    return where.rstrip("/")


#: Rows and bytes of a batch handed to Python at most, so that whole texts do not pile up.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def bounded(spark: SparkSession) -> None:
    """Bounds Arrow batches by rows and bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def files_under(spark: SparkSession, path: str) -> list[tuple[str, int, bool]]:
    """(name, bytes, is a folder) of what stands in a folder, by name; nothing where it is missing."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    return sorted((s.getPath().getName(), s.getLen(), s.isDirectory()) for s in fs.listStatus(where))


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def committed(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers n of the folders ``prefix``n under ``path`` that were written to their end."""
    numbers = [n[len(prefix) :] for n, _, folder in files_under(spark, path) if folder and n.startswith(prefix)]
    return sorted(int(n) for n in numbers if n.isdigit() and any(f == "_SUCCESS" for f, _, _ in files_under(spark, f"{path}/{prefix}{n}")))
