"""Summaries of page tables and sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def corpus_summary(pages: DataFrame, by: list[str]) -> DataFrame:
    """Rows, texts, characters by group."""
    text = F.col("page_text")
    return pages.groupBy(*by).agg(F.count(F.lit(1)).alias("pages"), F.count_if(text.isNotNull() & (text != "")).alias("with_text"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("chars"))


def active_positions(mask: Column) -> Column:
    """Sum of an attention mask of 0 and 1: how many of its positions aren't 0."""
    return F.when(mask.isNotNull(), F.size(F.array_remove(mask, F.lit(0))))


def predicted_positions(labels: Column, ignored: int = -100) -> Column:
    """Labels that aren't ignored."""
    return F.size(F.filter(labels, lambda x: x != ignored))


def validation_report(sequences: DataFrame, batched: DataFrame, key: list[str]) -> DataFrame:
    """``item, value`` of a chunked data set and its padded, labelled batches; an empty one has counts and batches of 0.

    Sequences, tokens and active positions; the first sequence by ``key``: its length and first 50 tokens; the share of
    ``split`` if there is one; and the number of batches, the longest one's length and predicted positions.
    """
    text = lambda c: c.cast("string")
    own = sequences.agg(
        F.count(F.lit(1)).alias("sequences"), F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("tokens"), F.coalesce(F.sum(active_positions(F.col("attention_mask"))), F.lit(0)).alias("active"),
        F.min_by(F.struct(F.size("tokens").alias("n"), F.slice("tokens", 1, 50).alias("head")), F.struct(*key)).alias("first"),
    )
    items = {"sequences": F.col("sequences"), "tokens": F.col("tokens"), "active": F.col("active"), "first_length": F.col("first.n"), "first_tokens": F.array_join("first.head", " ")}
    out = own.select(F.explode(F.array(*[F.struct(F.lit(k).alias("item"), text(v).alias("value")) for k, v in items.items()])).alias("_i")).select("_i.*")
    of = batched.agg(F.count_distinct("batch_id").alias("batches"), F.coalesce(F.max("padded_length"), F.lit(0)).alias("batch_length"), F.coalesce(F.sum(predicted_positions(F.col("labels"))), F.lit(0)).alias("predicted"))
    more = of.select(F.explode(F.array(*[F.struct(F.lit(k).alias("item"), text(F.col(k)).alias("value")) for k in ("batches", "batch_length", "predicted")])).alias("_i")).select("_i.*")
    return out.unionByName(more)


def element(df: DataFrame, order: list[str], number: int) -> DataFrame:
    """Row ``number`` (from 0) in an order; none beyond the end."""
    return df.orderBy(*order).offset(number).limit(1)


def steps(rows: DataFrame, batch_size: int, epochs: int) -> DataFrame:
    """``rows, steps_per_epoch, total_steps``."""
    n = rows.agg(F.count(F.lit(1)).alias("rows"))
    per = F.floor(F.col("rows") / batch_size).cast("long")
    return n.select("rows", per.alias("steps_per_epoch"), (per * epochs).alias("total_steps"))


def first_rows(df: DataFrame, n: int | None, order: list[str]) -> DataFrame:
    """The first ``n`` rows by ``order``; all where ``n`` is 0 or None."""
    return df.orderBy(*order).limit(n) if n else df
