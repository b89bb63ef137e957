"""Global row numbers without sorting a table in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def global_number(df: DataFrame, bucket: Column, order: list[Column | str], out: str, present: Column | None = None) -> DataFrame:
    """Adds ``out``, a row's number from 1 in the order of ``bucket``, then of ``order``.

    ``bucket`` splits the order into ranges, such as a prefix of the key. Each is sorted on its own; the table
    of their totals, a row for each bucket, is the only thing that one task sees. A null bucket comes first.

    Totals and numbers are two plans over ``df``. Where its last step is an aggregation, ``present``, a condition that holds for
    every row and reads what the totals would leave out, keeps them equal, so that its shuffle is computed once.
    """
    df = df.withColumn("_bucket", bucket)
    totals = df.groupBy("_bucket").agg((F.count(F.lit(1)) if present is None else F.count_if(present)).alias("_rows"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("_bucket").alias("_of"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    numbered = df.withColumn(out, F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)))
    joined = numbered.join(totals, F.col("_bucket").eqNullSafe(F.col("_of")))
    return joined.withColumn(out, F.col(out) + F.col("_before")).drop("_bucket", "_of", "_before")


def seeded_key(seed: int, *key: Column) -> Column:
    """A reproducible pseudorandom key: a hexadecimal digest of the seed and the row's key, which leaves out nulls."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in key]).cast("binary"))
