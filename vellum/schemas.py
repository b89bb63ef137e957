"""Schemas of the tables that the engine passes around."""

from pyspark.sql import types as T

XML_FILES = T.StructType([T.StructField("path", T.StringType(), False), T.StructField("content", T.BinaryType(), False)])
PAGE_FIELDS = ("author", "place", "date", "page_text")
PAGES = T.StructType([T.StructField(n, T.StringType(), True) for n in PAGE_FIELDS])
PARSED_PAGES = T.StructType([T.StructField("path", T.StringType(), True), *PAGES.fields, T.StructField("page_no", T.IntegerType(), True), T.StructField("error", T.StringType(), True)])
DATE_MAP = T.StructType([T.StructField("raw", T.StringType(), False), T.StructField("resolved", T.StringType(), True)])
