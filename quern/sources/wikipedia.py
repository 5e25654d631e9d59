"""Wiki dumps: articles of the main namespace, without redirects, as plain text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import wikitext_strip

SCHEMA = "title string, ns int, id long, redirect struct<_title: string>, revision struct<id: long, timestamp: string, text: struct<_VALUE: string>>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """(id, title, timestamp, text) from an XML dump, also one compressed with bzip2."""
    pages = spark.read.format("xml").option("rowTag", "page").schema(SCHEMA).load(path)
    rows = pages.where((F.col("ns") == 0) & F.col("redirect").isNull())
    rows = rows.select(F.col("id").cast("string").alias("id"), "title", F.col("revision.timestamp").alias("timestamp"), wikitext_strip(F.col("revision.text._VALUE")).alias("text"))
    return rows.where(F.length("text") > 0)
