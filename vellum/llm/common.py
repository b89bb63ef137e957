"""What several operators of this subpackage share: words, tables in the shared folder, prefix sums."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word is a maximal run of anything but the six ASCII whitespace characters (Java pattern).
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of a data folder; only Spark opens the path, so any store that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def word_count(text: Column) -> Column:
    """Number of words as a long; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_of(df: DataFrame, name: str = "text") -> Column:
    """The text column as a string, null as empty."""
    return F.coalesce(df[name].cast("string"), F.lit(""))


_own_dirs: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where it is unset and the master is local (tests, a laptop) a temporary folder is made.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        context = spark.sparkContext
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if context.applicationId not in _own_dirs:
            _own_dirs[context.applicationId] = tempfile.mkdtemp(prefix="vellum-")
        path = _own_dirs[context.applicationId]
    return path.rstrip("/")


def bound_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker holds at once: long texts make batches of fewer rows.

    The settings are the session's and stay, since what an operator returns runs later.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


class Workspace:
    """Tables that cut lineage, in a folder of one run below the shared one.

    A written table survives lost executors, is planned with its true size, and is read again without
    the work above it. ``drop`` frees what no later step reads; ``keep`` all but what a result still reads, which stays
    until its folder is removed, with ``sweep`` when results have been written.
    """

    folders: list[str] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.names = spark, f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}", set()
        Workspace.folders.append(self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.names.add(name)
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def keep(self, *names: str) -> None:
        """Drops all tables but these: what a result, which is read later, still needs."""
        self.drop(*(self.names - set(names)))

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        self.names -= set(names)
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Removes what operators of this session have left in the shared folder; their results must not be read afterwards."""
    for root in Workspace.folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    Workspace.folders.clear()


def rank_in_groups(df: DataFrame, group: list[str], bucket: Column, order: list[Column], out: str, weight: Column | None = None) -> DataFrame:
    """Adds ``out``: the sum of ``weight`` (1) of the rows that come before a row in its group, from 0.

    Rows are ordered by bucket, then by ``order``. A group may hold any share of the table: each bucket
    is sorted on its own and starts at the total of those before it, so no task sorts a whole group.
    ``bucket`` must be spread evenly, such as by a hash; the table of totals has a row for each group and
    bucket and is joined by key, not broadcast. Group columns must not be null. ``_bucket`` and ``_n`` (the
    row's number in its bucket, from 1) stay: with the group they identify a row.
    """
    w = F.lit(1).cast("long") if weight is None else weight.cast("long")
    df = df.withColumn("_bucket", bucket).withColumn("_w", w)
    keys = [*group, "_bucket"]
    totals = df.groupBy(*keys).agg(F.sum("_w").alias("_total"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*keys).orderBy(*order)
    df = df.withColumn("_n", F.row_number().over(within)).withColumn("_sum", F.sum("_w").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    joined = df.join(totals, keys)
    return joined.withColumn(out, F.col("_start") + F.col("_sum") - F.col("_w")).drop("_w", "_sum", "_start")
