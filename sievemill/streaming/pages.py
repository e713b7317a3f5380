"""Streams of pages: the same extraction, row by row, without state; re-crawls can be dropped within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.page import Options
from ..operators.stage import extract
from ..sources import markdown_sink


def extract_stream(spark: SparkSession, folder: str, schema, options: Options | None = None) -> DataFrame:
    """A streaming DataFrame of extracted pages from Parquet files that arrive in folder."""
    return extract(spark.readStream.schema(schema).parquet(folder), options)


def html_folder_stream(spark: SparkSession, folder: str, options: Options | None = None) -> DataFrame:
    """A streaming DataFrame of extracted pages (with path and name) from *.html files that arrive in folder."""
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", "*.html").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return extract(files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("content").alias("html")), options)


def write_page_files(pages: DataFrame, out: str, checkpoint: str):
    """Start a stream of rows (name, document, failed; see sources.html_files.markdown_rows) into one file a page; each batch is committed or leaves nothing."""
    markdown_sink.register(pages.sparkSession)
    return pages.writeStream.format("page_files").option("path", out).option("checkpointLocation", checkpoint)


def first_seen(pages: DataFrame, url: str = "url", time: str = "fetched", delay: str = "1 day") -> DataFrame:
    """Each URL once within the watermark."""
    return pages.withWatermark(time, delay).dropDuplicatesWithinWatermark([url])
