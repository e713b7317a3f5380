"""How tables are dealt to tasks: by bytes, whatever the files' row groups."""

from pyspark.sql import functions as F

from sievemill.operators import stage


def _sizes(df):
    return [r.n for r in df.groupBy(F.spark_partition_id()).agg(F.sum(F.octet_length("html")).alias("n")).collect()]


def test_one_full_partition_among_empty_ones(spark, tmp_path):
    """A file of one row group is split for all cores, and one split has all rows."""
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, 3000, 1, 1).select("id", F.repeat(F.sha2(F.col("id").cast("string"), 256), 400).alias("html")).write.parquet(str(tmp_path / "t"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        t = spark.read.parquet(str(tmp_path / "t"))
        assert t.rdd.getNumPartitions() >= cores and max(_sizes(t)) == 3000 * 25600
        dealt = _sizes(stage.dealt(t))
        assert sum(dealt) == 3000 * 25600 and len(dealt) >= 3 * cores and max(dealt) < 2 * stage.TASK_BYTES
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_tasks_grow_with_the_bytes_of_an_expression(spark):
    cores = spark.sparkContext.defaultParallelism
    t = spark.range(0, 4000, 1, 2)
    assert stage.dealt(t, html=F.repeat(F.lit("x"), F.col("id").cast("int"))).rdd.getNumPartitions() == 3 * cores
    tasks = -(-4000 * (100_000) // stage.TASK_BYTES)
    assert tasks > 3 * cores and stage.dealt(t, html=F.repeat(F.lit("x"), F.lit(100_000))).rdd.getNumPartitions() == tasks


def test_even_and_empty_tables(spark):
    cores = spark.sparkContext.defaultParallelism
    even = spark.range(0, 400 * cores, 1, 4 * cores).select("id", F.lit("<p>x").alias("html"))
    assert stage.dealt(even).rdd.getNumPartitions() == 4 * cores
    assert stage.dealt(even.where("id < 0")).count() == 0
    assert stage.dealt(even.withColumn("html", F.lit(None).cast("string"))).count() == 400 * cores


def test_bodies_with_other_declarations_give_what_texts_give(spark, tmp_path):
    from sievemill.plans import page_queries

    text = "<p>" + "Café, señor, über 100 naïve façades. " * 20
    page = '<html lang="fr"><head><meta charset="{}"><title>A title of some length</title></head><body><article><h1>A heading</h1>' + text + "</article></body></html>"
    html = [page.format(c) for c in ("utf-8", "UTF-8", "utf8", "iso-8859-1", "windows-1252", "gbk", "utf-16", "nonsense")] + ["\ufeff" + page.format("latin1"), "\ufeff" + text, text, "", None]
    spark.createDataFrame([(i, f"https://a.b/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    texts = {r.page_id: len(r.content_text) for r in page_queries.extract_text(spark, str(tmp_path)).collect()}
    assert texts[0] > 500
    assert {r.page_id: r.chars for r in page_queries.bytes_pages(spark, str(tmp_path)).collect()} == texts
