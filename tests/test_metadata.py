"""Metadata by columns, against what small pages must give and against the page engine."""

from __future__ import annotations

import page_cases as cases
import pytest
from pyspark.sql import functions as F

from sievemill.functions import metadata as M
from sievemill.operators import stage
from sievemill.operators import values as V

SF = "/root/testdata/sf0.001"
SHARED = [k for k in M.FIELDS if k != "og_type"]


def shown(v):
    return "|".join(v) or None if isinstance(v, list) else v.strftime("%Y-%m-%d %H:%M:%S") if hasattr(v, "strftime") else v


def rows(spark, pages, *columns):
    return spark.createDataFrame([(k, *p) for k, p in enumerate(pages)], "id int, " + ", ".join(f"{c} string" for c in columns))


def test_fields_of_small_pages(spark):
    got = M.with_metadata(rows(spark, [(c[0],) for c in cases.META.values()], "html")).orderBy("id").collect()
    assert {k: shown(r.metadata[c[1]]) for r, (k, c) in zip(got, cases.META.items(), strict=True)} == {k: c[2] for k, c in cases.META.items()}


OTHERS = [
    "",
    "words alone",
    "<title> </title><h1>Short</h1><h1>A heading of some length</h1>",
    "<title>One of it : Two of it, longer : Three</title><h1>two OF it, longer</h1>",
    "<html lang='de-AT'><head><link rel='canonical' href='/no/host'><title>A story &amp; more of it - Site</title></head><body><p class='author avatar'>No One</p><p class='author'>x</p><div id='author'>Written by Ann Lee</div>",
    "<body><div class='tags'><a>One</a><a>Two, Three</a><a>One</a></div><div id=keywords>Four; Five</div><a rel=tag>Six</a><ul class='breadcrumb'><li><a>Home</a><li><a>News</a></ul><span data-section='s'>Part</span>",
    "<meta name=author content='a.com'><meta name=author content='Ann Lee'><meta property='og:image' content='data:x'><meta name=date content='no date'><meta name=pubdate content='2024-05-06'><footer><a href='http://creativecommons.org/licenses/by-sa/4.0/'>c</a></footer>",
    "<span itemprop=datePublished content='2023/01/02'>x</span><time>yesterday</time><i class='entry-date'>3 March 2021</i>",
    "<title>The Site | Big News Story of today</title><meta name=keywords content=' '><meta name=keywords content='a;b, a'><meta name='category' content='c1'><meta name='category' content='c2'>",
]


def test_as_the_page_engine(spark):
    df = rows(spark, [(p, f"https://Www.X{k}.org/a" if k % 2 else None) for k, p in enumerate([*OTHERS, *(c[0] for c in cases.META.values())])], "html", "url").withColumn("title", F.lit("clash"))
    want = [r.metadata for r in stage.extract(df).orderBy("id").collect()]
    got = [r.metadata for r in M.with_metadata(df, url="url").orderBy("id").collect()]
    for w, g in zip(want, got, strict=True):
        assert {k: shown(g[k]) for k in SHARED} == {k: shown(w[k]) for k in SHARED}


def test_as_the_page_engine_on_given_pages(spark):
    df = stage.dealt(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html"))
    want = {r.page_id: r.metadata for r in stage.extract(df).collect()}
    got = {r.page_id: r.metadata for r in M.with_metadata(df, url="url").collect()}
    assert {p: [shown(m[k]) for k in SHARED] for p, m in got.items()} == {p: [shown(m[k]) for k in SHARED] for p, m in want.items()}


def test_blacklist_nulls_and_empty_tables(spark):
    df = rows(spark, [("<meta name=author content='Ann Lee'>",), (None,)], "html")
    one, none = M.with_metadata(df, blacklist=("aNN",)).orderBy("id").collect()
    assert one.metadata.author is None
    assert all(not none.metadata[k] for k in M.FIELDS)
    assert M.with_metadata(df.limit(0)).collect() == [] and M.open_graph(df.limit(0)).collect() == []


def test_open_graph(spark):
    got = M.open_graph(rows(spark, [(k,) for k in cases.GRAPHS], "html")).orderBy("id").collect()
    assert [",".join(f"{k}={v}" for k, v in sorted(r.graph.asDict().items()) if v is not None) for r in got] == list(cases.GRAPHS.values())


def test_light_metadata(spark):
    got = M.with_light_metadata(rows(spark, [(k, "https://x.org/a") for k in cases.LIGHT], "html", "url"), url="url").orderBy("id").collect()
    assert [f"{r.metadata.title}|{r.metadata.author or 'null'}" for r in got] == list(cases.LIGHT.values())
    assert {r.metadata.hostname for r in got} == {"x.org"}


@pytest.mark.parametrize("site", [None, "the site", "Story"])
def test_site_suffix(spark, site):
    titles = [*cases.SITES, "", " - ", "a - ", "Story - and | more » of - it", "The Site - The Site", "x" * 40 + " | " + "y " * 30 + "- z"]
    got = rows(spark, [(t,) for t in titles], "t").select("id", M.strip_site_suffix(F.col("t"), F.lit(site).cast("string")).alias("v")).orderBy("id").collect()
    assert [r.v for r in got] == [V.strip_site(t, site) for t in titles]
