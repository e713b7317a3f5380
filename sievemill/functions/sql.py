"""Names for Spark SQL: register(spark) makes the functions of a page callable from SQL.

    register(spark)
    spark.sql("SELECT page_id, extract_page(html, url).content_text FROM pages")
    spark.sql("SELECT page_id, n.tag, n.text FROM pages, LATERAL html_nodes(html) n")
    spark.sql("SELECT url_type(url), absolute_url(href, url), table_markdown(html) FROM links")

All but html_nodes take Arrow batches. Expressions that need no tree are Column functions
(functions.columns); in SQL they are Spark's own functions.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf, udtf

from ..operators import page as X
from ..operators import stage, values


def register(spark: SparkSession) -> None:
    stage._workers_import(spark)
    record = T.StructType(stage.RESULT)

    @pandas_udf(record)
    def extract_page(html: pd.Series, url: pd.Series) -> pd.DataFrame:
        rows = [stage.record_of(p, u, X.Options()) for p, u in zip(html, url, strict=True)]
        return pd.DataFrame({f.name: pd.Series([r[f.name] for r in rows], dtype=object) for f in stage.RESULT})

    def strings(name, function):
        @pandas_udf("string")
        def run(x: pd.Series) -> pd.Series:
            return x.map(lambda v: None if v is None else function(v)).astype(object)

        spark.udf.register(name, run)

    @pandas_udf("string")
    def absolute_url(url: pd.Series, base: pd.Series) -> pd.Series:
        return pd.Series([None if u is None else values.absolute(u, b) for u, b in zip(url, base, strict=True)], dtype=object)

    @udtf(returnType=T.StructType(stage.NODE))
    class HtmlNodes:
        def eval(self, html: str):
            for r in stage.node_rows(html):
                yield tuple(r[f.name] for f in stage.NODE)

    spark.udf.register("extract_page", extract_page)
    spark.udf.register("absolute_url", absolute_url)
    for name, function in (("url_type", values.url_type), ("table_markdown", stage.table_markdown), ("page_text", lambda p: X.extract(p)["content_text"])):
        strings(name, function)
    spark.udtf.register("html_nodes", HtmlNodes)
