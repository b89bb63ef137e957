"""Incremental ingestion: XML files that arrive in a folder become page rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from vellum.schemas import PAGE_FIELDS
from vellum.sources.xml_pages import parse_pages

_FILES = "path STRING, modificationTime TIMESTAMP, length LONG, content BINARY"


def stream_pages(spark: SparkSession, folder: str, mode: str = "sibling", files_per_trigger: int = 1000) -> DataFrame:
    """Pages of new files. Stateless: each file is parsed once, in the micro-batch that finds it."""
    files = spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", "*.xml").option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return parse_pages(files, mode).select("path", "page_no", *PAGE_FIELDS)


def append_pages(pages: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends to a Parquet table, exactly once for each file."""
    writer = pages.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start(path)
