"""What the operators share: reading tables, the shared folder, Arrow plumbing."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of one Arrow batch handed to Python, so that long texts do not pile up.
ARROW_BATCH_BYTES = 16 << 20
ARROW_BATCH_ROWS = 2000


def tune(spark: SparkSession) -> None:
    """Bounds Arrow batches by rows and bytes, and lets shuffle files go with the query that wrote them."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.

    Where that is unset, a folder of this machine is set for a session that
    runs on this machine alone; on a cluster it is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = "/tmp/checkpoints/folioforge"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables of :func:`written` once all that reads them is itself written."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: The greatest long stands for a null id, which comes last.
NULL_ID = 2**63 - 1


def integer_id(df: DataFrame, id_col: str) -> str:
    """The type of an integer id column; others are refused."""
    kind = df.schema[id_col].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col} is {kind}; this operator orders documents by an integer id")
    return kind


def document_key(df: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column]:
    """(id, tie): the integer id with nulls last, and a hash of the text that tells rows of one id apart unless they are equal."""
    integer_id(df, id_col)
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tie")


def with_fields(df: DataFrame, *fields: tuple[str, str]) -> StructType:
    """The schema of ``df`` with (name, type) fields added; that of ``df`` itself stays as it is."""
    schema = StructType(list(df.schema.fields))
    for name, kind in fields:
        schema = schema.add(name, kind)
    return schema


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    tune(df.sparkSession)
    return df.mapInArrow(f, schema)


def partition_id() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


def strings(batch: pa.RecordBatch, name: str) -> list[str]:
    """A text column as Python strings, null as the empty string."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` has it (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def utf8_bytes(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long")
