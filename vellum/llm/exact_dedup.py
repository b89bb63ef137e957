"""Exact dedup by skew-safe combining.

Rows with equal texts form a group; the row with the largest ``doc_id`` stays. Combining goes in three
stages, each grouping by digest *and* full text, so that a digest collision never merges two texts:

1. Each scan task combines its own rows (the partial aggregate of stage 2).
2. Groups of a salt are merged. The salt comes from the scan task, so a text that a third of all rows
   share arrives as one row per scan task, spread over ``salts`` reducers.
3. The salts' winners, at most ``salts`` for each text, are combined globally.

A thin join on the digest then gives each row its group. A digest that turns out to have several texts
is joined on digest and text instead.

Cases: null texts count as empty; very long texts are compared whole, in all three stages; ties of the largest id are rows that
repeat it, which are all kept; rows whose ``doc_id`` is null are members, and the group's winner is null
only if all ids are; an empty table gives an empty
result; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, text_of


def exact_groups(docs: DataFrame, salts: int = 16, digest: Callable[[Column], Column] = lambda text: F.sha2(text, 256), normalise: Callable[[Column], Column] = lambda text: text) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    ``normalise`` decides which texts are equal; ``digest`` only routes rows and may collide.
    """
    ws = Workspace(docs.sparkSession, "exact")
    text = normalise(text_of(docs))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text")).withColumn("digest", digest(F.col("text")))
    salted = (
        rows.withColumn("salt", F.spark_partition_id() % salts)
        .groupBy("salt", "digest", "text")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    groups = salted.groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    by_digest = groups.select("digest", "keep_id", "group_size").groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"))
    by_digest = ws.write(by_digest, "groups")
    # one text for each digest: all rows of the digest are equal, as the full comparison has shown
    out = rows.select("doc_id", "digest", F.sha2("text", 256).alias("text_sha256")).join(by_digest.where("texts = 1"), "digest")
    collided = by_digest.where("texts > 1").select("digest")
    if collided.take(1):
        clash = rows.join(collided, "digest", "left_semi")
        again = clash.groupBy("digest", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        again = again.withColumn("text_sha256", F.sha2("text", 256))
        out = out.select("doc_id", "keep_id", "group_size", "text_sha256").unionByName(clash.join(again, ["digest", "text"]).select("doc_id", "keep_id", "group_size", "text_sha256"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


ORACLE = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
