"""Publication dates: free-form strings to years, in built-in expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions.text import py_strip, strip_left, strip_right, stripped_int

#: Open bounds of the years that the first two stages accept.
AFTER, BEFORE = 1500, 1900


def clean_dates(pages: DataFrame, column: str = "date") -> DataFrame:
    """Adds ``date_convert`` (a string: the year, or the input with ``l`` as ``1``) and ``year`` (null if unresolved).

    Stages: the first four characters after leading brackets and dashes; else the last four before trailing dots,
    brackets and question marks; else a year anywhere, brackets and dots left out. The first stage that finds an
    integer decides, in range or not; the third takes any year from 1500 to 1899. Null stays null.

    Each step is a column of its own, so that no expression is planned or evaluated twice.
    """
    d = F.col("_d")
    steps = [
        {"_d": F.translate(F.col(column), "l", "1")},
        {"_head": F.substring(strip_left(strip_left(d, "["), "-"), 1, 4), "_tail": F.substring(strip_right(strip_right(strip_right(d, "."), "]"), "?"), -4, 4)},
        {"_head": py_strip("_head"), "_tail": py_strip("_tail")},
        {"_number": F.coalesce(stripped_int(F.col("_head")), stripped_int(F.col("_tail")))},
        {"_found": F.when(F.col("_number").isNull(), F.regexp_extract(F.regexp_replace(d, r"[\[\].]", ""), r"(1[5-8][0-9]{2})", 1).try_cast("int"))},
        {"year": F.when((F.col("_number") > AFTER) & (F.col("_number") < BEFORE), F.col("_number")).otherwise(F.col("_found"))},
        {"date_convert": F.coalesce(F.col("year").cast("string"), d)},
    ]
    for step in steps:
        pages = pages.withColumns(step)
    return pages.drop("_d", "_head", "_tail", "_number", "_found")


def unresolved_dates(cleaned: DataFrame) -> DataFrame:
    """The distinct values that no stage resolved: ``raw``."""
    return cleaned.where(F.col("year").isNull() & F.col("date_convert").isNotNull()).select(F.col("date_convert").alias("raw")).distinct()


def resolve(unresolved: DataFrame, resolver: Callable[[Iterable[str]], Iterable[str | None]]) -> DataFrame:
    """``raw, resolved`` by a user's function over batches of distinct values; it runs on the executors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"raw": batch["raw"], "resolved": pd.Series(list(resolver(batch["raw"])), dtype=object, index=batch.index)})

    return unresolved.mapInPandas(run, "raw string, resolved string")


def apply_resolved(cleaned: DataFrame, date_map: DataFrame) -> DataFrame:
    """Replaces unresolved dates by the map's. The map is joined by key; Spark broadcasts it where it is small."""
    return cleaned.join(date_map.withColumnRenamed("raw", "date_convert"), "date_convert", "left").withColumn("date_convert", F.when(F.col("year").isNull(), F.coalesce("resolved", "date_convert")).otherwise(F.col("date_convert"))).drop("resolved")
