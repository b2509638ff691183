"""The operators' queries over the whole of their tables, with production parameters, and what SQL can say of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import spread
from . import chat_format, decontaminate, gam, langid, mixing, near_dedup, quality_rules, suffix_dedup, url_filter, warc_index


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "pages") else df


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return url_filter.blocked(pages, url_filter.sample_list(pages))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gam.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.chat(_table(spark, sf_dir, "conversations"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.duplicates(_table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(_table(spark, sf_dir, "documents")).select("doc_id", "begin_word", "end_word")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sample(_table(spark, sf_dir, "documents"))


def op10_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_index.history(_table(spark, sf_dir, "pages"), warc_index.captured_at(F.col("page_id")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_url_filter, op2_quality_classifier, op3_chat_format, op4_near_dedup, op5_decontaminate, op6_language_id, op7_quality_rules, op8_suffix_dedup, op9_mixing, op10_warc_index)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": url_filter.SQL, "op3_chat_format": chat_format.SQL, "op5_decontaminate": decontaminate.SQL, "op8_suffix_dedup": suffix_dedup.SQL, "op10_warc_index": warc_index.SQL}
