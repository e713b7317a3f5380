"""Type signals, images and resolved links by columns, against the page engine and small cases."""

from __future__ import annotations

import page_cases as cases
import pytest
from pyspark.sql import functions as F

from sievemill.functions import columns as C
from sievemill.functions import signals as S
from sievemill.operators import page as X
from sievemill.operators import stage
from sievemill.operators import values as V
from sievemill.operators.dom import parse

SF = "/root/testdata/sf0.001"
MORE = [
    "",
    "<script type='application/ld+json'>{broken</script><script type='application/ld+json'>[{\"@graph\":[{\"@type\":[\"ItemList\",\"Thing\"],\"itemListElement\":[{\"@type\":\"Product\"}]}]}]</script>" + "<div class='Product-Card'>x</div>" * 5,
    "<meta property='og:type' content='Product.Group'><p>a b<p>c",
    "<a>Add to BAG</a><div class='product-grid'></div><link rel=next href=/2>",
    "<nav aria-label='Paging of results'></nav>" + "<code>x</code>" * 12 + "<div class='my-sidebar'>",
    "<a>1</a>" * 9 + "<p>few words",
]


def rows(spark, values, *columns):
    return spark.createDataFrame([(k, *v) for k, v in enumerate(values)], "id int, " + ", ".join(f"{c} string" for c in columns))


def test_types_of_small_pages(spark):
    got = S.with_signals(rows(spark, [(c[0],) for c in cases.TYPES.values()], "html")).orderBy("id").collect()
    assert [r.page_type for r in got] == [c[1] for c in cases.TYPES.values()]


def test_signals_as_the_page_engine(spark):
    df = rows(spark, [(p, u) for p in [*MORE, *(c[0] for c in cases.TYPES.values())] for u in (None, "https://x.org/docs/a")], "html", "url").withColumn("title", F.lit("clash"))
    want = stage.html_signals(df).orderBy("id").collect()
    got = S.with_signals(df, url="url").orderBy("id").collect()
    for w, g in zip(want, got, strict=True):
        a, b = w.signals.asDict(), g.signals.asDict()
        assert {**a, "ld_types": sorted(a["ld_types"])} == {**b, "ld_types": sorted(b["ld_types"])}
        assert w.page_type == g.page_type


def test_signals_of_null_and_no_pages(spark):
    df = rows(spark, [(None,)], "html")
    one = S.with_images(S.with_signals(df)).collect()[0]
    assert one.signals is None and one.page_type == "article" and one.images == []
    assert S.with_images(S.with_signals(df.limit(0))).collect() == []


def test_images(spark):
    pages = [c[0] for c in cases.IMAGES.values()] + ["", "<img alt=x>", "<figure>no</figure><figure><b><img src='a&amp;b.png' alt=''></b></figure><img src=Z/A.PNG><meta property='og:image' content='Z/A.PNG'>", "<img src='a/'><img src=q><meta property='og:image' content='q'>"]
    got = S.with_images(rows(spark, [(p,) for p in pages], "html")).orderBy("id").collect()
    for page, r in zip(pages, got, strict=True):
        doc = parse(page)
        og = next((m.get("content") for m in doc.select("meta[property='og:image']")), None)
        assert [i.asDict() for i in r.images] == X.images(doc, og)
    for c, r in zip(cases.IMAGES.values(), got, strict=False):
        assert [f"{i.src}|{i.filename}|{i.alt or ''}|{i.caption or ''}|{str(i.is_hero).lower()}" for i in r.images] == c[1]


@pytest.mark.parametrize("base", ["https://x.org/d/e", "https://x.org", "http://x.org/a/b/?q=1#f", "https://x.org/a//b/../c", None])
def test_resolved_links(spark, base):
    links = [*cases.LINKED, "./a/./b/..", "../../../c", "..", ".", "a//b", "/a/../b/./c", "?", "#", " /p ", "tel:1", "data:x", "javascript:void(0)", "ftp://y/z", "a?b#c", "é/ü", "/a//b/../c/"]
    got = rows(spark, [(x,) for x in links], "x").select("id", C.resolve_url("x", F.lit(base).cast("string")).alias("v")).orderBy("id").collect()
    assert [r.v for r in got] == [V.absolute(x.strip(), base) for x in links]


LANGUAGES = ["", "<html lang='de-AT'><p>x", "<html lang=' '><meta http-equiv='Content-Language' content='EN_us'>", "<meta name=language content=''><meta name=Language content='pt-BR'>", "<meta name=language content=fr><meta http-equiv=content-language content=it>"]


def test_language(spark):
    got = S.with_language(rows(spark, [*((p,) for p in LANGUAGES), (None,)], "html")).orderBy("id").select("language", S.matches_language("language", "de-CH").alias("ok")).collect()
    assert [r.language for r in got] == [*(X.document_language(parse(p)) for p in LANGUAGES), None]
    assert [r.ok for r in got] == [r.language in (None, "de") for r in got]


TALKS = [
    "<div class='respond a'>1</div><p id=respond>2</p><p class='comments'>3</p>",
    "<i class='x comment-list-y'>short</i><b class='My-Replies'>longer one</b><u id='Disqus_Thread'>longer two</u>",
    "<p class='commentary'>no</p>",
    "<div id=discussion>a  b<p>c</div><div id=comments></div>",
]


def test_comments(spark):
    pages = [*TALKS, "", *(c[0] for c in cases.COMMENTS.values())]
    got = S.with_comments(rows(spark, [*((p,) for p in pages), (None,)], "html")).orderBy("id").collect()
    for page, r in zip(pages, got, strict=False):
        doc = parse(page)
        n = X.comment_section(doc, X.body_of(doc))
        assert (r.comments and (r.comments.tag, r.comments.text)) == (n and (n.tag, V.clean(n.text()))), page
    assert got[-1].comments is None
