"""The sink of one file a page: commits, aborts, counts, streams."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from sievemill.operators.page import Options
from sievemill.sources import html_files, markdown_sink
from sievemill.streaming.pages import html_folder_stream, write_page_files

LONG = " ".join(f"This sentence of the main text holds several useful words, and number {i}." for i in range(30))


def save(df, out, mode="append"):
    df.write.format("page_files").mode(mode).save(str(out))


def test_files_and_counts(spark, tmp_path):
    markdown_sink.register(spark)
    rows = [(f"p{k}.md", f"text {k} é" if k % 5 else None, k % 10 == 0) for k in range(50)] + [("blank.md", " \n", None)]
    save(spark.createDataFrame(rows, "name string, document string, failed boolean").repartition(6), tmp_path / "out")
    assert sorted(os.listdir(tmp_path / "out")) == sorted([markdown_sink.COUNTS, *(f"p{k}.md" for k in range(50) if k % 5)])
    assert markdown_sink.counts(str(tmp_path / "out")) == {"success": 40, "empty": 6, "failed": 5}
    assert (tmp_path / "out" / "p7.md").read_text() == "text 7 é"
    save(spark.createDataFrame([("q.md", "new")], "name string, document string"), tmp_path / "out")
    assert len(os.listdir(tmp_path / "out")) == 42  # appended
    save(spark.createDataFrame([("q.md", "again"), ("q.md", "again")], "name string, document string"), f"file://{tmp_path}/out", "overwrite")
    assert sorted(os.listdir(tmp_path / "out")) == [markdown_sink.COUNTS, "q.md"] and markdown_sink.counts(f"file://{tmp_path}/out")["success"] == 1


def test_an_aborted_job_leaves_no_file(spark, tmp_path):
    markdown_sink.register(spark)
    rows = spark.range(200).repartition(8).select(F.format_string("p%d.md", "id").alias("name"), F.when(F.col("id") == 137, F.raise_error(F.lit("broken page")).cast("string")).otherwise(F.lit("x")).alias("document"))
    with pytest.raises(Exception, match="broken page"):
        save(rows, tmp_path / "out")
    assert not any(files for _, _, files in os.walk(tmp_path / "out"))
    with pytest.raises(Exception, match="no name for a file"):
        save(spark.createDataFrame([("../x", "y")], "name string, document string"), tmp_path / "out")
    with pytest.raises(Exception, match="rows need the columns"):
        save(spark.createDataFrame([("x",)], "name string"), tmp_path / "out")
    assert not any(files for _, _, files in os.walk(tmp_path / "out"))


def test_an_empty_table(spark, tmp_path):
    markdown_sink.register(spark)
    save(spark.createDataFrame([], "name string, document string"), tmp_path / "out")
    assert markdown_sink.counts(str(tmp_path / "out")) == {"success": 0, "empty": 0, "failed": 0}


def test_a_stream_gives_what_a_batch_gives(spark, tmp_path):
    for folder in ("in", "out", "batch"):
        (tmp_path / folder).mkdir()
    for k in range(4):
        (tmp_path / "in" / f"p{k}.html").write_text(f"<html><head><title>Page {k}</title></head><body><article><p>{LONG}</p></article></body></html>")
    (tmp_path / "in" / "none.html").write_text("<html></html>")
    (tmp_path / "in" / "other.txt").write_text("x")
    rows = html_files.markdown_rows(html_folder_stream(spark, str(tmp_path / "in"), Options(output_markdown=True, include_links=True)))
    query = write_page_files(rows, str(tmp_path / "out"), str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()
    want = html_files.markdown_files(spark, str(tmp_path / "in"), str(tmp_path / "batch"))
    assert want == markdown_sink.counts(str(tmp_path / "out"), 0) == {"success": 4, "empty": 1, "failed": 0}
    for k in range(4):
        assert (tmp_path / "out" / f"p{k}.md").read_text() == (tmp_path / "batch" / f"p{k}.md").read_text()
    (tmp_path / "in" / "late.html").write_text(f"<html><body><article><p>{LONG}</p></article></body></html>")
    query = write_page_files(rows, str(tmp_path / "out"), str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert markdown_sink.counts(str(tmp_path / "out"), 1) == {"success": 1, "empty": 0, "failed": 0} and (tmp_path / "out" / "late.md").exists()
