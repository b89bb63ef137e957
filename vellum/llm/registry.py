"""Queries of this subpackage over the driver's tables, each with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, exact_dedup, langid, mixing, near_dedup, quality, sharding, substring_dedup, url_filter, warc
from .common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_report(read(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))[0].select("doc_id", "size", "source_size", "target", "taken")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(read(spark, sf_dir, "pages"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.ring_shards(read(spark, sf_dir, "documents"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_report(read(spark, sf_dir, "documents"), words=3, percent=85)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(read(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leak_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES |= {"op1_warc": op1_warc, "op2_quality": op2_quality, "op3_langid": op3_langid, "op4_exact_dedup": op4_exact_dedup, "op5_mixing": op5_mixing, "op6_url_filter": op6_url_filter, "op7_sharding": op7_sharding, "op8_near_dedup": op8_near_dedup, "op9_substring_dedup": op9_substring_dedup, "op10_decontamination": op10_decontamination}
ORACLES |= {"op1_warc": warc.ORACLE, "op4_exact_dedup": exact_dedup.ORACLE, "op8_near_dedup": near_dedup.ORACLE, "op9_substring_dedup": substring_dedup.ORACLE}
