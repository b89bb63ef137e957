"""A training-data pipeline over ``documents``: quality, near-duplicates, benchmark leaks, mixture, shards.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read
again as the next stage's ``docs``. A stage works on what its predecessor kept, and its decisions take effect.

Cases, for all stages: an empty table gives an empty one with the same columns; further columns are carried, whatever
their names; texts are judged whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellum.llm import decontaminate, mixing, near_dedup, quality, sharding
from vellum.llm.common import Workspace, read


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within their language's limits of perplexity and odd words.

    Null and empty texts stay, as do languages without trusted text; documents that tie with a limit stay; repeated rows
    are judged alike.
    """
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five-word shingles, similarity of 0.8 or more.

    The smallest id stays, once if its row is repeated; one of rows that tie in id and text stays. Null and blank texts are
    in no group and stay, once for each id; a null id stays only where its group has no other.
    """
    return near_dedup.keep_one(docs, words=5, percent=80)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts stay; each of repeated rows goes or stays alike.
    """
    return decontaminate.remove_leaks(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources by weight; a document may come up to three times.

    Null and empty texts have no words to take and go; a null source is one, the last; rows that repeat in all columns
    share their copies.
    """
    return mixing.mix_documents(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents, with ``shard`` and ``slot``.

    Every row gets a place, also of null text or id; copies of a document may get different shards. Columns named
    ``shard`` or ``slot`` are replaced.
    """
    return sharding.ring_shards(docs, carry=True)


STAGES = [
    ("quality classifier", keep_quality),
    ("near-duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("mixing to target weights", mix_sources),
    ("sharding", assign_shards),
]

#: Perplexity, similarity and edit distance are beyond SQL; the tests compare each stage with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    ws = Workspace(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = ws.write(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            ws.drop(f"stage-{k - 1}")
    return docs
