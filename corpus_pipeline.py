"""A corpus pipeline: five stages, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelet.llm import decontaminate, exact_dedup, language, pieces, simhash
from tracelet.llm.common import discard, own_names, plain_names, remainder, staged



def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go: null, empty and other texts without a letter.

    All columns of ``docs`` stay, whatever they are called; texts of any length are read whole; ties
    between languages and repeated rows make no difference, as only ``und`` goes; an empty table gives
    an empty one. Without labelled rows to learn from, all lettered texts stay too.
    """
    model = language.learn(docs, remainder("doc_id", 4) != 2)
    rows = plain_names(docs, docs.columns, F.col("text").alias("t"))
    if model is None:
        return own_names(language.lettered(rows, "t").where("lettered"), docs.columns)
    return own_names(language.identify(rows, model, "t").where(F.col("lang_pred") != language.UNKNOWN), docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of equal texts stays: the one with the largest doc_id; null and empty texts are equal.

    Of rows alike in both (ties, repeated rows) the one with the smallest hash of all its columns
    stays. All columns of ``docs`` stay; texts of any length are compared whole; an empty table gives
    an empty one.
    """
    rows = plain_names(docs, docs.columns, F.col("doc_id").alias("id"), F.col("text").alias("t"))
    return own_names(exact_dedup.exact_duplicates(rows, "id", "t", keep=rows.columns[:-2]).where("kept"), docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest doc_id.

    Texts without words (null, empty, blank) are one group; ties go as ``simhash.representatives``
    says. All columns of ``docs`` stay; texts of any length are read whole; an empty table gives an
    empty one.
    """
    return simhash.representatives(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go: those with at least a twentieth of their words in passages of the benchmark.

    Null and empty texts have no words and stay; repeated rows are judged alike, texts of any length
    whole; there are no ties. All columns of ``docs`` stay; an empty table gives an empty one, an empty
    benchmark lets all stay.
    """
    items = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    rows = plain_names(docs, docs.columns, F.col("text").alias("t"))
    found = decontaminate.judged(decontaminate.contamination(rows, items, "t"))
    return own_names(found.where(~F.col("contaminated")), docs.columns)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with piece_ids and decoded, the text that these decode to; columns of those names are replaced.

    Null counts as empty and has the begin and end ids alone; repeated rows are encoded alike, texts of
    any length whole; there are no ties; an empty table gives an empty one.
    """
    return pieces.encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontaminate", benchmark_stage),
    ("pieces", pieces_stage),
]

#: SQL can express neither the language stage nor the piece encoding; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, staged(stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
