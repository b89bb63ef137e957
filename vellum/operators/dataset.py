"""Reproducible splits, batches, padding and labels. All randomness is a digest of a seed and a row's key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.operators.ranking import global_number, seeded_key

IGNORED = -100


def shuffled_number(df: DataFrame, key: list[str], seed: int, out: str) -> DataFrame:
    """Adds ``out``, a row's number from 1 in a pseudorandom order of its key."""
    h = seeded_key(seed, *[F.col(k) for k in key])
    return global_number(df.withColumn("_h", h), F.substring(F.col("_h"), 1, 3), ["_h", *key], out).drop("_h")


def split(df: DataFrame, key: list[str], test_share: float = 0.1, seed: int = 42, group: list[str] | None = None) -> DataFrame:
    """Adds ``split``, ``test`` for exactly the rounded-up share of rows (of groups, with ``group``), else ``train``.

    Null is a group like any other.
    """
    unit = group or key
    units = shuffled_number(df.select(*unit).distinct() if group else df, unit, seed, "_n")
    total = units.count()
    named = units.withColumn("split", F.when(F.col("_n") <= F.ceil(F.lit(test_share) * total), "test").otherwise("train")).drop("_n")
    if not group:
        return named
    named = named.select("split", *[F.col(k).alias(f"_key{i}") for i, k in enumerate(unit)])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(unit)])
    return df.join(named, same).drop(*[f"_key{i}" for i in range(len(unit))])


def batches(df: DataFrame, order: list[str], size: int, bucket: Column) -> DataFrame:
    """Adds ``batch_id``: runs of ``size`` rows in the order of ``bucket``, then of ``order``."""
    return global_number(df, bucket, order, "_n").withColumn("batch_id", F.floor((F.col("_n") - 1) / size).cast("long")).drop("_n")


def pad(df: DataFrame, column: str = "tokens", filler: Column | None = None, pad_token: str = "[PAD]") -> DataFrame:
    """Pads the lists of a batch to its longest; ``attention_mask`` is 1 on what was there."""
    longest = F.max(F.size(column)).over(Window.partitionBy("batch_id"))
    fill = F.lit(pad_token) if filler is None else filler
    df = df.withColumn("_len", F.size(column)).withColumn("padded_length", longest)
    mask = F.concat(F.array_repeat(F.lit(1), F.col("_len")), F.array_repeat(F.lit(0), F.col("padded_length") - F.col("_len")))
    return df.withColumn("attention_mask", mask).withColumn(column, F.concat(F.col(column), F.array_repeat(fill, F.col("padded_length") - F.col("_len")))).drop("_len")


PRIME = 2_147_483_647


def token_draws(seed: int, key: Column, tokens: Column) -> Column:
    """A pseudorandom long below ``PRIME`` for each token of a row.

    One digest gives three numbers a, b and c for the row; token i draws ``y * y % PRIME`` with ``y = x * x + c`` and
    ``x = a + b * (i + 1)``, both modulo ``PRIME``: arithmetic that never exceeds a long.
    """
    digest = seeded_key(seed, key)
    a, b, c = (F.conv(F.substring(digest, at, 8), 16, 10).cast("long") % PRIME for at in (1, 9, 17))
    keys = F.struct(a.alias("a"), b.alias("b"), c.alias("c"))

    def draw(k: Column) -> Column:
        # a list for each step: a lambda computes again what it names twice
        x = F.transform(tokens, lambda _, i: (k["a"] + k["b"] * (i.cast("long") + 1)) % PRIME)
        y = F.transform(x, lambda v: (v * v % PRIME + k["c"]) % PRIME)
        return F.transform(y, lambda v: v * v % PRIME)

    # a row's numbers are the start of a fold over one element, so that they are computed once
    return F.aggregate(F.array(keys), F.array().cast("array<bigint>"), lambda _, k: draw(k))


def masked(token: Column, draw: Column, mask: Column, other: Column, percent: int = 15) -> tuple[Column, Column]:
    """The token that is shown, and whether it is to be predicted: of ``percent`` of tokens, 80 % are masked, 10 % replaced, 10 % kept."""
    chosen, kind = draw % 100 < percent, F.floor(draw / 100) % 10
    return F.when(chosen & (kind < 8), mask).when(chosen & (kind == 8), other).otherwise(token), chosen


def mlm(df: DataFrame, key: str, column: str = "input_ids", mask_id: int = 103, vocabulary: int = 30522, seed: int = 42, percent: int = 15) -> DataFrame:
    """Masks ids in place and adds ``labels``: the id where it is to be predicted, else ``IGNORED``.

    A row without ids (null) stays without. Rows with equal keys draw alike.
    """
    # draws come out of a generator, so that no later expression computes them again
    ids = F.struct(F.col(column).alias("ids"), token_draws(seed, F.col(key), F.col(column)).alias("draws"))
    df = df.select("*", F.explode(F.array(ids)).alias("_drawn")).withColumn("_draws", F.col("_drawn.draws")).withColumn(column, F.col("_drawn.ids")).drop("_drawn")
    shown = F.zip_with(column, "_draws", lambda t, d: masked(t, d, F.lit(mask_id), (F.floor(d / 1000) % vocabulary).cast("int"), percent)[0])
    labels = F.zip_with(column, "_draws", lambda t, d: F.when(d % 100 < percent, t).otherwise(F.lit(IGNORED)))
    return df.withColumns({"labels": labels, column: shown}).drop("_draws")


def clm_labels(df: DataFrame, column: str = "input_ids", pad_id: int = 0) -> DataFrame:
    """Adds ``labels``: the ids, with the padding id ignored (and so, where they are one, the end of text)."""
    return df.withColumn("labels", F.transform(column, lambda x: F.when(x == pad_id, F.lit(IGNORED)).otherwise(x)))
