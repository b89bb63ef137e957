"""SparkSession factory with the settings every operator relies on."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

#: Runtime settings only: they are also safe on a session that someone else has started.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def get_session(app: str = "vellum", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """A session in UTC with AQE on. On a cluster, leave ``master`` unset and let spark-submit decide.

    ``spark.sql.shuffle.partitions`` is left to the cluster's configuration; AQE coalesces small
    partitions, so a generous value there costs little.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in {**RUNTIME, **(conf or {})}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Where that is unset, a local master (tests, a laptop) gets a temporary folder and a cluster an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="vellum-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
