"""Column expressions against DuckDB, and against the plain functions used within a page."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievemill.functions import columns as C
from sievemill.operators import values as V
from sievemill.plans import catalog, page_queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_catalog(spark, duck, rows, name):
    assert rows(catalog.QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(catalog.ORACLES[name]).df())


@pytest.mark.parametrize("name", list(page_queries.ORACLES))
def test_pages(spark, duck, rows, name):
    assert rows(page_queries.QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(page_queries.ORACLES[name]).df())


@pytest.mark.parametrize("name", [n for n in catalog.CASES if n != "date_parse"])
def test_literals(spark, duck, rows, name):
    assert rows(catalog.CASES[name](spark, SF).toPandas()) == rows(duck.execute(catalog.CASE_SQL[name]).df())


def test_dates(spark, duck):
    ours = {r.i: r.seconds for r in catalog.date_parse(spark, SF).collect()}
    assert ours == dict(duck.execute(catalog.CASE_SQL["date_parse"]).fetchall())


ENCODED = [("<meta charset=UTF-8>", "utf-8"), ("<meta charset='nope'><meta http-equiv=Content-Type content='text/html; charset=koi8-r'>", "koi8-r"), ("<meta charset=nope>", "utf-8"), ("", "utf-8"), (None, None), ("<meta http-equiv=content-type content='text/html; charset=Windows-1251'>", "windows-1251"), (" " * 2000 + "<meta charset=koi8-r>", "utf-8")]


def test_declared_encoding(spark):
    got = spark.createDataFrame([(h,) for h, _ in ENCODED], "h string").select(C.declared_encoding("h")).collect()
    assert [r[0] for r in got] == [e for _, e in ENCODED]


TEXTS = ["", " a b ", "x .y\r\n\n\n\nz", "By Jane Doe", "Photo: Getty", "Facebook | share", "Subscribe to our newsletter", "A & <b> \"q\" 'r'", "&amp;lt; &#8217;", "no", "Updated: today", "é　ü,  ö", "a\t \nb", "Twitterati say", "by someone. Else", "10 words or so.,;:!?"]
URLS = ["", "https://Example.com/a/b.html?x#y", "http://forum.x.org/t/1", "https://docs.y.io/guide/", "https://shop.z.com/products/1", "https://a.b/category/c", "https://a.b/services/x", "https://a.b/news/", "https://a.b/news/x", "/relative/p", "ftp://x", "https://u@h.org:80/", "https://x.org/how-to-y", "https://x.org/collections/"]


def test_page_functions_equal_columns(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = df.select("t", C.clean_text("t"), C.normalize_text("t"), C.escape_html("t"), C.decode_entities("t"), C.is_share_text("t"), C.is_name("t"), C.count_words("t"), C.count_sentences("t"), C.quality("t", F.lit(None).cast("string"), F.lit(5000), F.lit("article"))).collect()
    for r in got:
        t = r[0]
        assert list(r)[1:9] == [V.clean(t), V.normalize(t), V.escape(t), V.decode(t), V.is_share(t), V.is_name(t), V.count_words(t, 2), V.sentences(t)]
        assert r[9] == pytest.approx(V.quality(t, None, 5000, "article"))
    urls = spark.createDataFrame([(u,) for u in URLS], "u string").select("u", C.url_page_type("u"), C.hostname("u"), C.filename("u")).collect()
    for r in urls:
        assert list(r)[1:] == [V.url_type(r.u), V.host(r.u), V.file_name(r.u)]


def test_titles(spark):
    pairs = [("A Title", "a  title"), ("A Title", "A Title | Site"), ("A Title - Site", "a title"), ("A", "B"), ("", "x"), ("Title: More", "Title")]
    got = spark.createDataFrame(pairs, "a string, b string").select(C.titles_match("a", "b")).collect()
    assert [r[0] for r in got] == [V.titles_match(a, b) for a, b in pairs]


def test_fscore(spark):
    pairs = [("a b c", "a b d"), ("", ""), ("a", ""), ("A a", "a"), ("x", "y")]
    got = [tuple(r.s) for r in spark.createDataFrame(pairs, "a string, b string").select(C.fscore("a", "b").alias("s")).collect()]
    assert got[1:] == [(1, 1, 1), (0, 0, 0), (1, 1, 1), (0, 0, 0)] and got[0] == pytest.approx((2 / 3,) * 3)


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_normalisation_is_idempotent(s):
    assert V.clean(V.clean(s)) == V.clean(s)
    assert V.normalize(V.normalize(s)) == V.normalize(s)
