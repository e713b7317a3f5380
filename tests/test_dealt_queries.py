"""Every query that parses pages deals them to tasks by bytes, also where one row group holds all pages and the file has splits enough for all cores."""

import pytest

import __spark_entry__ as entry
from sievemill.operators import stage

PARSING = "filtered_text link_dense_elements page_titles extract_markdown page_quality_features content_scored extract_html host_sites extract_text extraction_quality extract_all type_signals page_metadata nodes_per_page type_score_rollup content_found classic_text metadata_fields title_elements nodes_by_tag".split()


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("one_group")
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    pages.coalesce(1).write.parquet(str(d / "pages.parquet"))
    return str(d), sum(len((r.html or "").encode()) for r in pages.collect())


@pytest.mark.parametrize("name", PARSING)
def test_tasks_by_bytes(spark, table, name, monkeypatch):
    d, total = table
    cores = spark.sparkContext.defaultParallelism
    monkeypatch.setattr(stage, "TASK_BYTES", total // (10 * cores))
    tasks = -(-total // stage.TASK_BYTES)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert spark.read.parquet(f"{d}/pages.parquet").rdd.getNumPartitions() >= cores
        plan = entry.queries()[name](spark, d)._jdf.queryExecution().optimizedPlan().toString()
        assert tasks >= 10 * cores and f"Repartition {tasks}, true" in plan
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
