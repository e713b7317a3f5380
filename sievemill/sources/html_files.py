"""Sources and sinks: directories of HTML files, crawler pages, Markdown files with front matter, JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.page import Options
from ..operators.stage import extract
from . import markdown_sink

BATCH = Options(output_markdown=True, include_tables=True, include_links=True)


def read_html(spark: SparkSession, folder: str) -> DataFrame:
    """The *.html files of a folder as (path, name, html binary); reading is spread over the executors."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("content").alias("html"))


def crawled(pages: DataFrame, body: str = "body", url: str = "url", options: Options | None = None) -> DataFrame:
    """Crawler pages (undecoded body and URL; options.url wins over the page's)."""
    return extract(pages, options, html=body, url=url)


def _line(key: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{key}: "), value, F.lit("\n"))).otherwise(F.lit(""))


def _front() -> Column:
    """The YAML front matter of an extracted page."""
    m, quote = (lambda k: F.col(f"metadata.{k}")), (lambda x: F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('\\"')), F.lit('"')))
    return F.concat(
        F.lit("---\n"), _line("title", quote(m("title"))), _line("author", quote(m("author"))),
        _line("date", quote(F.date_format(m("date"), "yyyy-MM-dd'T'HH:mm:ssxxx"))), _line("source_file", quote(F.col("name"))),
        _line("confidence", F.format_string("%.2f", "extraction_quality")), _line("page_type", quote(m("page_type"))), F.lit("---\n\n"),
    )


def front_matter(df: DataFrame) -> DataFrame:
    """Extracted pages with a `document` column: YAML front matter, then Markdown (text where there is none). Blank pages are left out."""
    body = F.coalesce("content_markdown", "content_text")
    return df.where(F.trim(body) != "").withColumn("document", F.concat(_front(), body, F.lit("\n")))


def write_markdown(spark: SparkSession, folder: str, out: str) -> dict[str, int]:
    """Every HTML file of folder as one Markdown document under out (Parquet rows name, document: one commit, any store). Returns counts, taken in the same pass: pages written, without content, and failed (files of no bytes at all are not read, so not counted)."""
    seen = Observation()
    failed = F.exists("warnings", lambda w: w.startswith("Content extraction failed: "))
    blank = F.trim(F.coalesce("content_markdown", "content_text")) == ""
    df = extract(read_html(spark, folder), BATCH).observe(seen, F.count_if(~blank).alias("success"), F.count_if(blank & ~failed).alias("empty"), F.count_if(blank & failed).alias("failed"))
    front_matter(df).select(F.regexp_replace("name", r"\.html$", ".md").alias("name"), "document").write.mode("overwrite").parquet(out)
    return {k: seen.get[k] for k in ("success", "empty", "failed")}


def markdown_rows(extracted: DataFrame) -> DataFrame:
    """Rows for the sink page_files, one for each extracted page: name (.md), document (null without content) and failed."""
    failed = F.exists("warnings", lambda w: w.startswith("Content extraction failed: "))
    blank = F.trim(F.coalesce("content_markdown", "content_text")) == ""
    named = extracted.select("*", F.regexp_replace("name", r"\.html$", ".md").alias("__file"))
    head, body = _front(), F.coalesce("content_markdown", "content_text")
    return named.select(F.col("__file").alias("name"), F.when(~blank, F.concat(head, body, F.lit("\n"))).alias("document"), (blank & failed).alias("failed"))


def markdown_files(spark: SparkSession, folder: str, out: str) -> dict[str, int]:
    """Every HTML file of folder as a file NAME.md in the folder out, written by the tasks and moved into place by one commit. Returns the counts of pages written, without content, and failed."""
    markdown_sink.register(spark)
    markdown_rows(extract(read_html(spark, folder), BATCH)).write.format("page_files").mode("append").save(out)
    return markdown_sink.counts(out, keep=False)


def json_lines(df: DataFrame) -> DataFrame:
    """Extracted pages as JSON lines: title, author and date always, the rest where not null."""
    m = lambda k: F.col(f"metadata.{k}")
    always = F.to_json(F.struct(m("title").alias("title"), m("author").alias("author"), F.date_format(m("date"), "yyyy-MM-dd'T'HH:mm:ssxxx").alias("date")), {"ignoreNullFields": "false"})
    rest = F.to_json(F.struct(F.col("content_text").alias("main_content"), "content_markdown", m("page_type").alias("page_type"), "classification_confidence", "extraction_quality"))
    return df.select(F.concat(F.regexp_replace(always, r"\}$", ","), F.substring(rest, 2, 1_000_000_000)).alias("value"))
