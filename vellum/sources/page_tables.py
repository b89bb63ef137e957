"""Page tables as CSV or Parquet, and unions of corpora."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from vellum.functions.text import missing_to_null
from vellum.schemas import PAGES

# without charToEscapeQuoteEscaping a character 0 before a quote is taken for an escape and lost
CSV = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"', "charToEscapeQuoteEscaping": '"', "lineSep": "\n"}
#: Stands for null in files that must tell it from an empty text: a code point that is no character.
NULL = "\ufdd0"


def read_csv(spark: SparkSession, path: str, schema: T.StructType = PAGES, na: bool = True) -> DataFrame:
    """Pages of CSV files with quoted line breaks. Dates stay strings; pandas' missing spellings become null, with ``na``."""
    df = spark.read.schema(schema).options(**CSV, ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false", nullValue=NULL).option("pathGlobFilter", "*.csv").csv(path)
    return missing_to_null(df) if na else df


def write_csv(pages: DataFrame, path: str, null: str = "") -> None:
    """With a header, also for an empty table. ``null`` is what is written for it; ``NULL`` is read as null without ``na``."""
    pages.write.mode("overwrite").options(header="true", quote='"', escape='"', quoteAll="true", emptyValue="", nullValue=null, ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(path)


def write_parquet(pages: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    pages.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(path)


def union_corpora(tables: list[DataFrame]) -> DataFrame:
    """All rows, columns matched by name; what a table lacks is null."""
    if not tables:
        raise FileNotFoundError("no page tables were found")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def csv_files(spark: SparkSession, folder: str, glob: str = "*.csv") -> DataFrame:
    """``path`` of the CSV files below a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder).select("path")


def load_csvs(spark: SparkSession, paths: list[str], **options) -> DataFrame:
    """All rows of several files or folders; fails on a folder without a CSV file."""
    for p in paths:
        if not csv_files(spark, p).take(1):
            raise FileNotFoundError(f"no CSV file in {p}")
    return union_corpora([read_csv(spark, p, **options) for p in paths])


def corpus_path(folder: str, corpus: str) -> str:
    return f"{folder.rstrip('/')}/{corpus}_pages_full.csv"
