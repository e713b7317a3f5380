"""Interval trees and what is measured on them, against the page engine's tree and plain recounts."""

from __future__ import annotations

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from sievemill.functions import content, tree
from sievemill.operators import page as X
from sievemill.operators.dom import parse
from sievemill.operators.values import clean, sentences, size
from sievemill.plans import tree_queries

SF = "/root/testdata/sf0.001"
LONG = "This sentence of the text holds several useful words, and a number. " * 20
CASES = [
    "",
    "plain &amp; text &#233;&#x1F60; &amp",
    "<p>a<p>b <b>c</b><div>d<ul><li>x<li>y<ul><li>z</ul></ul></div>",
    "<!DOCTYPE html><html><head><title>T</title><meta charset=x></head><body class='k'><h1>H</h1>t<br>u<table><tr><td>1<td>2<tr><th>3</table></body></html>",
    "<b>x<div>y</b>z</div>w",
    "<a href='x'>1<a href=y>2</a> 3",
    "<h1>a<h2>b</h3>c</p>d</br>e",
    "<div title=\"a>b<c\" class='q r' id=z>f</div><!-- <p> --><p>q</p>cut <p cla",
    "<dl><dt>a<dd>b<dt>c</dl><select><option>1<option>2</select><p>x<hr>y<td>z",
    "<table><thead><tr><th>h<tbody><tr><td><p>c<table><tr><td>n</table>d</table>e",
    "<style>p{}</style>k<p>a < b <3 </>c</p ><BODY><DIV>Up</DIV></HTML>",
    "<p>un\x01der\x02 <i>no end<p>next</i></div></span>x",
]


def built(spark, pages):
    df = spark.createDataFrame(list(enumerate(pages)), "id int, html string").repartition(3)
    return [r for r in tree.with_tree(df).orderBy("id").collect()]


def shown(r):
    return [(n.tag, "".join(r.texts[n.start : n.end])) for n in r.nodes]


def engine(html):
    """Tags and texts of the page engine, whose tree keeps the source of scripts and styles."""
    return [(n.tag, "".join(k.data for k in n.walk() if not k.tag and k.up.tag not in ("script", "style"))) for n in parse(html.replace("\x01", "").replace("\x02", "")).elements()]


def test_trees(spark):
    for r in built(spark, CASES[:-1]):
        assert shown(r) == engine(r.html), r.html


def random_page(r):
    tags = ["div", "p", "ul", "li", "span", "h2", "section", "table", "tr", "td", "br", "img", "article", "nav", "blockquote"]
    out = []
    for _ in range(r.randint(0, 120)):
        out.append(r.choice([f"<{r.choice(tags)} class=c{r.randint(0, 9)}>", f"</{r.choice(tags)}>", "w1 ", ".", "  x&lt;y", "\n"]))
    return "<body class=k>" + "".join(out)


def test_intervals_nest(spark):
    r = random.Random(6)
    for row in built(spark, [random_page(r) for _ in range(60)] + ["<i>" * 700 + "x", "<p>a" * 3000]):
        nodes = row.nodes
        assert [n.pre for n in nodes] == list(range(len(nodes)))
        for n in nodes:
            assert n.pre <= n.post < len(nodes) and n.start <= n.end
            if n.parent >= 0:
                up = nodes[n.parent]
                assert up.pre < n.pre <= n.post <= up.post and up.depth + 1 == n.depth and up.start <= n.start <= n.end <= up.end
            if n.post + 1 < len(nodes):
                assert nodes[n.post + 1].depth <= n.depth  # it ends where the next one is no deeper
        if not any(f"<{t}" in row.html for t in ("table", "tr", "td")):  # the engine moves what a table can't hold
            assert shown(row) == engine(row.html)


def test_null_and_empty(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "id int, html string")
    got = {r.id: r.nodes for r in tree.with_tree(df).collect()}
    assert got[1] is None and [n.tag for n in got[2]] == ["html", "head", "body"]
    for f in (content.content_scores, content.find_content, content.link_density):
        assert f(df).count() == 2 and f(df.limit(0)).count() == 0
    assert content.content_scores(df).where("content IS NOT NULL").count() == 0
    clash = df.withColumns({"nodes": F.lit(1), "texts": F.lit(2)})
    assert content.find_content(clash).count() == 2


def test_filters_stay_above_the_folds(spark):
    df = spark.createDataFrame([(1, "<p>a")], "id int, html string")
    exploded = tree.with_tree(df).select(F.explode("nodes").alias("x")).where("x.tag = 'p'")
    plan = exploded._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(regexp_replace(translate") == 1


def test_measures(spark):
    r = random.Random(8)
    df = spark.createDataFrame(list(enumerate([random_page(r) for _ in range(40)] + CASES[:-1])), "id int, html string")
    for row in tree.with_measures(tree.with_tree(df)).collect():
        for n in row.nodes:
            t = "".join(row.texts[n.start : n.end])
            assert (n.clean, n.sentences, n.chars, n.bytes) == (size(clean(t)), sentences(clean(t)), len(t.strip()), size(t.strip())), (row.html, n.tag)
            below = row.nodes[n.pre + 1 : n.post + 1]
            s, e = row.sums[n.pre + 1], row.sums[n.post + 1]
            assert (e.n - s.n, e.p - s.p, e.h - s.h, e.a_clean - s.a_clean) == (len(below), sum(x.tag == "p" for x in below), sum(x.tag in tree.HEADINGS for x in below), sum(x.clean for x in below if x.tag == "a"))


def one(spark, f, html):
    return f(spark.createDataFrame([(1, html)], "id int, html string")).first()


@pytest.mark.parametrize(
    "body,tag,cls",
    [
        (f"<div class=side><a href=x>{LONG}</a></div><div class=b><p>{LONG}</p><p>{LONG}</p></div>", "div", "b"),
        (f"<div class=sidebar><p>{LONG}</p><p>{LONG}</p></div><section><p>{LONG}</p></section>", "section", ""),
        (f"<main><p>{LONG}</p></main><nav>{LONG}</nav>", "main", ""),
        (f"<div><article><p>{LONG}</p></article></div>", "article", ""),  # ten points for the deeper one
        (f"<section class=x><p>{LONG}</p></section><div class=y><p>{LONG}</p></div>", "div", "y"),  # equal scores: div comes first
        ("<div>short</div>", None, None),
        ("<p>" + "a b c. " * 60 + "</p>", "body", ""),
        (f"<div class=x><p>{LONG}</p></div>" + "".join(f"<span>{LONG}</span>" for _ in range(5)), None, None),  # under a third of the page
    ],
)
def test_scored_node(spark, body, tag, cls):
    got = one(spark, content.content_scores, f"<html><body>{body}</body></html>").content
    assert (got and (got.tag, got["class"])) == (tag and (tag, cls))


def test_score_by_hand(spark):
    html = f"<body><div class='post menu'><h2>Head</h2><p>{LONG}</p><p>short one. two!</p>see <a href=x>a link</a></div></body>"
    n = next(n for n in parse(html).elements() if n.tag == "div")
    t = clean(n.text())
    want = min(size(t), 8000) + 2 * 200 + 100 + 300 + 50 * min(sentences(t), min(size(t), 8000) // 50) + 25 - 25
    assert one(spark, content.content_scores, html.replace("menu", "nav")).scores == []  # boilerplate by name
    got = one(spark, content.content_scores, html.replace("post menu", "post metal"))
    assert got.scores[0].score == want


FOUND = [
    (f"<div class=entry-content><p>{LONG}</p></div>", (1, "div")),
    (f"<article><p>{LONG}</p></article>", (2, "article")),
    (f"<div id=primary-x><p>{LONG}</p></div>", (3, "div")),
    (f"<div id=content><p>{LONG}</p></div>", (4, "div")),
    (f"<main><p>{LONG}</p></main>", (5, "main")),
    (f"<div class=my-content-area><p>{LONG}</p></div>", (6, "div")),
    (f"<div class=my-content-area-menu><p>{LONG}</p></div>", None),
    (f"<aside><article><p>{LONG}</p></article></aside>", None),
    (f"<header><div><article><p>{LONG}</p></article></div></header>", None),
    (f"<div class='related box'><article><p>{LONG}</p></article></div>", None),
    (f"<div class='js-menu'><article><p>{LONG}</p></article></div>", (2, "article")),
    (f"<section><article>head</article><p>{LONG}</p></section>", (2, "section")),
    ("<article>short</article>", None),
    (f"<div class=post-content-wrap><div class=widget>w</div><div class=entry-content><p>{LONG}</p></div></div>", (1, "div")),
    (f"<article><article class=post-content><p>{LONG}</p></article></article>", (1, "article")),
    (f"<article><p>{LONG}</p></article><div class=post-text><p>{LONG}</p></div>", (1, "div")),
]


@pytest.mark.parametrize("body,want", FOUND)
def test_found_node(spark, body, want):
    got = one(spark, content.find_content, f"<html><body>{body}</body></html>").found
    assert (got and (got.rule, got.tag)) == want
    n = X.find_content(next(n for n in parse(f"<html><body>{body}</body></html>").elements() if n.tag == "body"))
    if "<aside>" not in body:
        assert (n and n.tag) == (want and want[1])


def test_wrapper_with_sidebar_is_passed_over(spark):
    html = f"<body><div class=post-content-wrap><div class=widget>w</div><div class='entry-content in'><p>{LONG}</p></div></div></body>"
    assert one(spark, content.find_content, html).found["class"] == "entry-content in"


MENU = "".join(f"<li><a href=/{k}>Item {k}</a>" for k in range(8))


@pytest.mark.parametrize(
    "body",
    [
        f"<ul>{MENU}</ul><p>{LONG}</p>",
        f"<div><ul>{MENU * 6}</ul></div><p>{LONG}</p>",
        f"<div><p>text {LONG}<a href=x>one</a></p></div>",
        f"<p><a href=x>{'long link text ' * 10}</a></p><p>end</p>",
        "<div><a href=x></a></div><p>y</p>",
        f"<section><a href=1>{LONG}</a> {LONG}</section>",
        f"<table><tr><td><a href=x>{LONG}</a><td>few</table><table><tr><td><a href=x>few</a><td>{LONG}</table>",
        "<p><a href=x>short</a> and plain text around it</p><p><a href=x>short</a></p>",
    ],
)
@pytest.mark.parametrize("precision", [False, True])
def test_link_density(spark, body, precision):
    html = f"<html><body>{body}</body></html>"
    tags = ("div", "ul", "ol", "li", "p", "nav", "section", "article", "table")
    o = X.Options(favor_precision=precision)
    want = [n.tag for n in parse(html).elements() if n.tag in tags and (X.table_link_dense(n) if n.tag == "table" else X.link_dense(n, o))]
    got = content.link_density(spark.createDataFrame([(1, html)], "id int, html string"), precision=precision).first().dense
    assert [x.tag for x in got] == want


@pytest.mark.parametrize("name", list(tree_queries.QUERIES))
def test_queries(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    df = tree_queries.QUERIES[name](spark, SF)
    assert "ArrowEvalPython" not in (plan := df._jdf.queryExecution().executedPlan().toString()) and "MapInArrow" not in plan
    want = con.execute(tree_queries.ORACLES[name]).df()[sorted(df.columns)]
    key = lambda d: sorted(tuple(None if x is None or x != x else x for x in r) for r in d.astype(object).itertuples(index=False, name=None))
    assert sorted(map(str, key(df.toPandas()[sorted(df.columns)]))) == sorted(map(str, key(want)))
