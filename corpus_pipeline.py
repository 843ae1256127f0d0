"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes all rows its predecessor kept and, but for the last, returns
the columns of ``documents``.  A stage's result is written to the shared
folder as Parquet and read again by the next one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm import langid, linededup, minhash, packing, suffixdedup
from folioforge.llm.common import free_name, release, table, tune, written
from folioforge.llm.queries import tokenizer_path


def _with_own_columns(docs: DataFrame, stage: Callable[[DataFrame], DataFrame], added: tuple[str, ...]) -> DataFrame:
    """``stage(docs)`` with the columns of ``docs`` and none of those that the stage adds, n_chars brought up to date."""
    away = {}
    for c in docs.columns:
        if c.lower() in added:
            away[c] = free_name(docs, c + "_of_input")
    out = stage(docs.withColumnsRenamed(away)).drop(*added).withColumnsRenamed({new: c for c, new in away.items()})
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))
    return out.select(*[f"`{c}`" for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language cannot be told: null and empty texts, texts without a letter, and ambiguous ones.

    Repeated rows and null ids are judged like any other by their text; an
    empty table, here and in all stages, stays empty.
    """
    tune(spark)
    return langid.keep_identified(docs, langid.train(docs, langid.held_out_rule(F.col("doc_id"))))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that came before, equal or, from 16 characters on, up to one edit; documents stay.

    Null texts stay null; of repeated rows the later ones keep blank lines only.
    """
    tune(spark)
    return _with_own_columns(docs, linededup.dedup_lines, ("n_lines", "n_removed"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near-duplicates, the one with the least id (null ids last).

    Null and empty texts are one class; of repeated rows one stays.
    """
    tune(spark)
    return minhash.drop_near_duplicates(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes 100-byte strings that came before; documents stay, null texts stay null."""
    tune(spark)
    return _with_own_columns(docs, suffixdedup.dedup_substrings, ("n_bytes", "n_removed", "n_spans", "kept_sha256"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 2048 tokens; a null or empty text is its end token."""
    tune(spark)
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("packing", pack),
]

#: The tokenizer of the last stage cannot be written in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, "stage-" + "".join(c if c.isalnum() else "-" for c in name))
            release(*before)
            before = [docs]
    return docs
