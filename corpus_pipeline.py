"""A corpus from documents: each stage works on all that the one before it kept, written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from presswork.llm import decontaminate, langid, mixing, near_dedup, suffix_dedup
from presswork.llm.shared import drop, new_path, scratch


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those that the identifier rejects go, null, empty and letterless ones among them.

    Each row is judged by its own text, whole, however long: null ids, repeated rows and rows that share an id as any others. Null lang values count for nothing in
    the fitting; where no row has one, all rows go. Ties of two languages don't matter to what stays. An empty table stays empty; columns may have any names.
    """
    return langid.accept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies, that of the least doc_id; null ids and null, empty and wordless texts stay.

    Rows that share a doc_id are one document: all stay or all go, and they go where one of their texts is a copy of a lesser id's. Long texts are compared
    whole. An empty table stays empty; columns may have any names.
    """
    return near_dedup.dedup(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words or more that stand earlier in the corpus, by doc_id and place; n_chars follows; what is left empty goes.

    Null ids and null and empty texts stay as they are. Rows of one doc_id and different texts are texts of their own, in the order of a hash; equal ones are cut
    alike. Long texts are worked on whole. An empty table stays empty; columns may have any names.
    """
    return suffix_dedup.dedup(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark: no eight words running of an item, nor all of a shorter one.

    Each row is judged by its own text, whole: null ids, repeated rows and rows that share an id as any others. Null and empty texts stay. Null and empty items
    count for nothing; without any item all rows stay. An empty table stays empty; columns may have any names.
    """
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn so that sources meet their target weights: half of all tokens, a source weighing as the square root of its own.

    A null source is a source; null and empty texts are drawn as others of their source, by number. Rows that share a doc_id go together, and null ids go. Of rows
    that agree in all that counts any may be drawn. A long text may put its source's total off by its own tokens. An empty table stays empty; columns may
    have any names.
    """
    return mixing.mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("near_dedup", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("decontaminate", benchmark_leaks),
    ("mixing", mixture),
]

#: Language models, SimHash and the draw can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's documents, a table in the shared folder. An empty table gives an empty result with the columns of documents.

    What a stage has read, and what it made on the way, is deleted once its own result is written.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), ""
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        with scratch():
            stage(spark, docs, sf_dir).write.parquet(path)
        drop(before)
        docs, before = spark.read.parquet(path), path
    return docs
