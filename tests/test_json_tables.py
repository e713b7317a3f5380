"""JSON-LD, JSON search and table text as columns, against plain recounts and the page engine."""

from __future__ import annotations

import json
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from sievemill.functions import jsonld, tables
from sievemill.operators.dom import parse
from sievemill.operators.page import table_text
from sievemill.plans import json_queries

SF = "/root/testdata/sf0.001"


def harvested(spark, *texts):
    df = spark.createDataFrame([(list(texts),)], "t array<string>")
    return df.select(jsonld.harvest("t").alias("h")).select("h.*", jsonld.first_date(F.col("h.date_text")).alias("date")).first()


def test_order_by_importance_then_place(spark):
    article = lambda title, **more: {"@type": "Article", "headline": title, **more}
    assert harvested(spark, json.dumps([article("first"), article("second")])).title == "first"
    assert harvested(spark, json.dumps({"@type": "Thing", "x": article("inner")}), json.dumps(article("outer"))).title == "outer"  # 100 - 10 + 5 against 100
    assert harvested(spark, json.dumps({"b": article("by key b"), "a": article("by key a")})).title == "by key a"
    deep = article("4", x=[{"y": {"@type": "Person", "name": "deep"}}])
    assert harvested(spark, json.dumps({"z": {"@type": "Person", "name": " top "}, "a": deep})).author == "top"
    assert harvested(spark, json.dumps({"@type": ["Person", "Article"], "name": "one kind", "headline": "h"})).title is None


def test_values(spark):
    r = harvested(spark, json.dumps({"@type": "NewsArticle", "headline": [" list ", 2], "name": "n", "description": "", "keywords": ["a", 1, " b "], "image": [{"url": "i"}], "datePublished": "2024-01-02T03:04:05+01:00", "publisher": {"@type": "WebSite", "givenName": "Given", "familyName": " Name "}}))
    assert (r.title, r.description, r.categories, r.image, r.sitename, str(r.date)) == ("list", None, ["a", "b"], "i", "Given Name", "2024-01-02 02:04:05")
    r = harvested(spark, json.dumps([{"@type": "Report", "headline": 5, "name": "n", "image": 7, "keywords": " , ", "datePublished": "May"}, {"@type": "WebPage", "image": "second", "keywords": "x,y", "datePublished": "2024-05-06"}]))
    assert (r.title, r.image, r.categories, str(r.date)) == ("n", "second", ["x", "y"], "2024-05-06 00:00:00")


@pytest.mark.parametrize("texts", [[], ["", "nope", "[1, null, \"x\"]", "{\"@type\": 5}"], ["{" * 50]])
def test_nothing_to_find(spark, texts):
    r = harvested(spark, *texts)
    assert (r.author, r.sitename, r.title, r.image, r.categories, r.date) == (None, None, None, None, [], None)


def test_null_and_blocks(spark):
    assert spark.createDataFrame([(None,)], "t array<string>").select(jsonld.harvest("t").alias("h")).first().h is None
    html = "<script type=\"application/ld+json\">{\"@type\":\"Article\",\"name\":\"A\"}</script><script>no</script><SCRIPT id=x type='application/ld+json'> [1] </SCRIPT>"
    df = spark.createDataFrame([(html,), (None,), ("",)], "html string").select(jsonld.blocks().alias("b"))
    assert [x.b for x in df.collect()] == [['{"@type":"Article","name":"A"}', " [1] "], None, []]


def test_deep_nesting(spark):
    v: object = {"@type": "Person", "name": "deepest"}
    for _ in range(60):
        v = {"k": [v]}
    assert harvested(spark, json.dumps(v)).author == "deepest"


def brute(v, key, out):
    if isinstance(v, str) and v.lstrip(" \n\t")[:1] in ("{", "["):
        try:
            v = json.loads(v)
        except ValueError:
            pass
    if isinstance(v, dict):
        for k in sorted(v):
            x = v[k]
            inner = x
            if isinstance(x, str) and x.lstrip()[:1] in ("{", "["):
                try:
                    inner = json.loads(x)
                except ValueError:
                    pass
            if k.lower() == key and isinstance(inner, str):
                out.append(inner)
            brute(inner, key, out)
    elif isinstance(v, list):
        for x in v:
            brute(x, key, out)
    return out


def random_json(r, depth=0):
    kind = r.random()
    if depth > 4 or kind < 0.3:
        return r.choice(["text", "", 5, None, True, "{no json", "é"])
    if kind < 0.6:
        return [random_json(r, depth + 1) for _ in range(r.randint(0, 3))]
    v = {r.choice(["a", "Key", "KEY", "b", "z"]): random_json(r, depth + 1) for _ in range(r.randint(0, 4))}
    return json.dumps(v) if r.random() < 0.2 else v


def test_json_strings(spark):
    r = random.Random(3)
    texts = [json.dumps(random_json(r)) for _ in range(150)] + [None, "not json"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("t", jsonld.json_strings("t", "key").alias("s")).collect()
    for x in rows:
        assert x.s == (None if x.t in (None, "not json") else brute(json.loads(x.t), "key", [])), x.t


def random_table(r):
    def cell():
        spans = "".join(f" {k}={r.choice(['2', '3', '0', 'x', chr(34) + ' 2 ' + chr(34), '1'])}" for k in ("colspan", "rowspan") if r.random() < 0.3)
        return f"<{r.choice(['td', 'th'])}{spans}>{r.choice(['', ' ', 'a b', 'x', '&amp;'])}"

    return "<table>" + "".join("<tr>" + "".join(cell() for _ in range(r.randint(0, 4))) for _ in range(r.randint(0, 6))) + "</table>"


def test_table_texts(spark):
    r = random.Random(5)
    pages = [random_table(r) for _ in range(120)] + [f"<div>{random_table(r)}</div>{random_table(r)}", "no table", "", None, "<table><tr><td>a<table><tr><td rowspan=2>b<td>c<tr><td>d</table>e</table>", "<table><tr><td colspan=30000>w<td>x<tr><td>y</table>"]
    df = spark.createDataFrame(list(enumerate(pages)), "i int, html string")
    for x in tables.with_table_texts(df).collect():
        if x.html is None:
            assert x.tables is None
        elif "30000" not in x.html:
            assert x.tables == [table_text(t) for t in parse(x.html).select("table")], x.html
        else:
            assert x.tables[0].count("w") == tables.MOST_CELLS - 1 and "x" not in x.tables[0]
    assert tables.with_table_texts(df.limit(0)).count() == 0


def test_table_texts_of_shared_markup(spark):
    """Pages of one markup are laid out once; those that no other page is like, or whose layout is large, have a fold of their own."""
    r = random.Random(8)
    pages, cells = [], ["", " ", "a  b\n", "&amp;<b>x", "\u00a0", "&nbsp;"]
    for _ in range(30):
        parts = re.split("(<t[dh][^>]*>)[^<]*", random_table(r))
        pages += ["".join(x + r.choice(cells) if k % 2 else x for k, x in enumerate(parts)) for _ in range(6)]
    big = "<table>" + "<tr><td rowspan=2>{0}<td colspan=3>{1}<tr><td>{0}" * 40 + "</table><table><tr><td>last</table>"
    pages += [big.format(x, y) for x in ("u" * 3000, "v" * 4000) for y in ("", "w")] * 2 + ["<table>" + "<tr><td>x" * 2000] * 2 + ["<table><tr><td colspan=30000>w<td>x<tr><td>y</table>"] * 2 + ["no table", "no table", "", "", None, None]
    df = spark.createDataFrame(list(enumerate(pages)), "i int, html string")
    found = tables.with_table_texts(df)
    assert "BroadcastHashJoin [__markup" in found._jdf.queryExecution().executedPlan().toString()
    plain = tables._own(tables.with_texts(tables.with_source(df).withColumn("__layout", F.lit(None)))).select("i", "__own_tables")
    assert {x.i: x.tables for x in found.collect()} == {x.i: x[1] for x in plain.collect()}
    assert found.columns == ["i", "html", "tables"] and found.count() == len(pages)
    shared = tables._layouts(tables.with_source(df).withColumn("__markup", F.expr(tables.markup("__source")))).count()
    assert 10 <= shared <= tables.SHARED


@pytest.mark.parametrize("name", list(json_queries.QUERIES))
def test_queries(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = json_queries.QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "MapInArrow" not in plan and "BatchEvalPython" not in plan
    want = con.execute(json_queries.ORACLES[name]).df()
    rows = lambda d: sorted(str(x) for x in d[sorted(d.columns)].astype(object).itertuples(index=False, name=None))
    assert rows(df.toPandas()) == rows(want)
