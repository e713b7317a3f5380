"""Whole pages: the tree, cleaning, content, metadata, tables, comments, images, languages, sources and streams."""

from __future__ import annotations

import json
from datetime import datetime, timezone

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievemill import cli
from sievemill.functions.sql import register
from sievemill.operators import metadata as M
from sievemill.operators import page as X
from sievemill.operators import page_types
from sievemill.operators.dom import parse
from sievemill.operators.features import NAMES, features
from sievemill.operators.page import Options, extract, markdown_table, table_text
from sievemill.operators.stage import decode, html_nodes
from sievemill.operators.stage import extract as extract_df
from sievemill.sources import html_files
from sievemill.streaming.pages import extract_stream

LONG = " ".join("This sentence of the main text holds several useful words, and number %d." % i for i in range(30))


def page(body, head=""):
    return f"<html><head>{head}</head><body>{body}</body></html>"


def text(body, head="", **o):
    return extract(page(body, head), Options(**o))["content_text"]


def tree(html):
    def show(n):
        return n.data if not n.tag else f"<{n.tag}>" + "".join(map(show, n.kids)) + f"</{n.tag}>"

    return "".join(map(show, next(n for n in parse(html).elements() if n.tag == "body").kids))


@pytest.mark.parametrize(
    "html,want",
    [
        ("<p>a<p>b", "<p>a</p><p>b</p>"),
        ("<ul><li>a<li>b</ul>c", "<ul><li>a</li><li>b</li></ul>c"),
        ("<p><b>a<p>b</b>c", "<p><b>a</b></p><p><b>b</b>c</p>"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "<table><tbody><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></tbody></table>"),
        ("<script>var a='</p>';</script><p>x", "<p>x</p>"),
        ("<p>&amp; &eacute;", "<p>& é</p>"),
        ("<div><p>cut o", "<div><p>cut o</p></div>"),
        ("<table>lost<tr><td>x</table>", "lost<table><tbody><tr><td>x</td></tr></tbody></table>"),
    ],
)
def test_tree(html, want):
    assert tree(html) == want


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="<>/abdiptlu \"'=&;#é\n", max_size=300))
def test_any_markup_gives_a_record(s):
    got = extract(s, Options(include_images=True, include_comments=True, output_markdown=True))
    assert isinstance(got["content_text"], str) and isinstance(got["warnings"], list)


def test_selectors():
    doc = parse("<div id=a class='x y'><p class=z>1</p><span data-k='ab c'>2</span></div><p>3</p>")
    count = lambda css: len(doc.select(css))
    assert [count(c) for c in ("#a", ".x.y", "div > p", "div p", "p", "[data-k*='b']", "[data-k^=ab]", "[data-k$='c']", "[class~=y]", "p, span", "div > span.z")] == [1, 1, 1, 1, 2, 1, 1, 1, 1, 3, 0]


def test_boilerplate_goes_and_content_stays():
    got = text(f"<nav><a href=/>Home</a></nav><div class=sidebar>Popular Posts</div><div class='newsletter'>Join us</div><article><h1>Heading of it</h1><p>{LONG}</p><div class='share-btn'>Share</div></article><footer>Copyright</footer>")
    assert "main text" in got and not any(w in got for w in ("Home", "Popular", "Join us", "Copyright"))


def test_inline_markup():
    assert text(f"<article><p>This is <strong>bold</strong> and <em>italic</em>.</p><p>{LONG}</p></article>").startswith("This is bold and italic.")


def test_table():
    t = parse("<table><tr><td colspan=2>X</td></tr><tr><td rowspan=2>A</td><td>B1</td></tr><tr><td>B2</td></tr></table>").first("table")
    assert table_text(t).split("\n") == ["X | X", "A | B1", "A | B2"]
    assert markdown_table(parse("<table><tr><th align=right>a</th><th>b</th></tr><tr><td>1</td><td>2|3</td></tr></table>").first("table")).split("\n") == ["|   a | b    |".replace("|   a |", "| a   |"), "| --: | ---- |", "| 1   | 2\\|3 |"]
    got = extract(page(f"<article><p>{LONG}</p><table><tr><th>k</th><th>v</th></tr><tr><td rowspan=2>a</td><td>b</td></tr><tr><td>c</td></tr></table></article>"))
    assert "a | c" in got["content_text"] and 'rowspan="2"' in got["content_html"]
    assert "k | v" not in text(f"<article><p>{LONG}</p><table><tr><th>k</th><th>v</th></tr><tr><td>a</td><td>b</td></tr></table></article>", include_tables=False)


def test_metadata():
    head = """<title>Big News Story | The Site</title><meta name=author content="Jane Doe"><meta property="og:site_name" content="The Site"><meta name=keywords content=" rust,  scraping , ,web "><meta property="article:published_time" content="2024-01-15T10:30:00Z"><link rel=canonical href="https://x.org/a"><meta property="og:image" content="https://x.org/i.png"><meta name=description content="About &amp; so">"""
    m = extract(f'<html lang="en-US"><head>{head}</head><body><article><p>{LONG}</p></article></body></html>')["metadata"]
    assert (m["title"], m["author"], m["sitename"], m["tags"], m["url"], m["hostname"], m["image"], m["language"]) == ("Big News Story", "Jane Doe", "The Site", ["rust", "scraping", "web"], "https://x.org/a", "x.org", "https://x.org/i.png", "en")
    assert m["date"] == datetime(2024, 1, 15, 10, 30, tzinfo=timezone.utc) and m["id"] is None


def test_json_ld_comes_first():
    ld = '<script type="application/ld+json">{"@type":"NewsArticle","headline":"From data","author":{"@type":"Person","name":"Ann Lee"},"publisher":{"@type":"Organization","name":"Pub"},"datePublished":"2024-02-03","keywords":["k1","k2"]}</script>'
    m = extract(page(f"<article><p>{LONG}</p></article>", ld + "<title>Other</title>"))["metadata"]
    assert (m["title"], m["author"], m["sitename"], m["categories"]) == ("From data", "Ann Lee", "Pub", ["k1", "k2"]) and m["date"].day == 3


def test_date_from_time_and_text():
    for t in ("<time datetime='2024-01-15'>x</time>", "<time>January 15, 2024</time>"):
        assert extract(page(f"<article>{t}<p>{LONG}</p></article>"))["metadata"]["date"] == datetime(2024, 1, 15, tzinfo=timezone.utc)


def test_author_blacklist():
    assert extract(page("<p>x", "<meta name=author content='Site Admin'>"), Options(author_blacklist=("admin",)))["metadata"]["author"] is None


def test_comments_and_images():
    body = f"<main><article><p>{LONG}</p><figure><img src=/a/b.png alt=Alt><figcaption>Cap  tion</figcaption></figure><img data-src='/c.jpg'><img src=/a/b.png></article><section id=comments><p>{'A reader wrote this comment of ten words or more here.'}</p></section></main>"
    assert extract(page(body))["comments_text"] is None
    got = extract(page(body, "<meta property='og:image' content='https://x.org/c.jpg'>"), Options(include_comments=True, include_images=True))
    assert "reader wrote" in got["comments_text"] and "reader wrote" not in got["content_text"]
    assert [(i["src"], i["filename"], i["alt"], i["caption"], i["is_hero"]) for i in got["images"]] == [("/a/b.png", "b.png", "Alt", "Cap tion", False), ("/c.jpg", "c.jpg", None, None, True)]


def test_language_filter():
    body = f"<article lang=en><p>{LONG}</p></article><article lang=de><p>{LONG.replace('sentence', 'Satz')}</p></article>"
    assert "Satz" in text(body, target_language="de") and "Satz" not in text(body, target_language="en")


def test_empty_pages():
    for html in ("", "   ", "<html></html>"):
        got = extract(html)
        assert got["content_text"] == "" and got["warnings"]


def test_page_types():
    cart = "".join(f"<div class=product-card><a href=/p{i}>P</a></div>" for i in range(6)) + "<button>Add to cart</button>"
    assert extract(page(cart))["metadata"]["page_type"] == "collection"
    ld = '<script type="application/ld+json">{"@type":"Product","description":"%s"}</script>' % ("A fine thing to own. " * 10)
    got = extract(page("<div>Buy</div>", ld))
    assert got["metadata"]["page_type"] == "product" and "fine thing" in got["content_text"]
    assert extract(page("<p>x"), Options(url="https://forum.x.org/a"))["metadata"]["page_type"] == "forum"
    assert extract(page("<p>x"), Options(page_type="service"))["classification_confidence"] is None
    assert M.refine("article", dict(og_type=None, ld_types=[], has_aggregate_offer=False, has_product_grid=False, has_add_to_cart=False, product_element_count=0, has_pagination=False, code_block_count=3, has_docs_nav=True, link_ratio=0.0, paragraph_word_count=99)) == "documentation"


def test_structured_body():
    ld = '<script type="application/ld+json">{"@type":"Article","articleBody":"%s"}</script>' % LONG
    got = extract(page("<div><p>Short.</p></div>", ld))
    assert "main text" in got["content_text"]


def test_links_and_markdown():
    body = f"<article><h2>Part</h2><p>{LONG} <a href='/x'>a link</a></p><ul><li>one</li><li>two<ul><li>deep</li></ul></li></ul><pre><code class='language-py'>x = 1</code></pre><blockquote><p>Said.</p></blockquote></article>"
    got = extract(page(body), Options(include_links=True, output_markdown=True))
    md = got["content_markdown"]
    assert 'href="/x"' in got["content_html"] and "[a link](/x)" in md
    assert all(x in md for x in ("## Part", "- one", "  - deep", "```py\nx = 1\n```", "> Said."))


def test_decoding():
    assert decode(b"<meta charset=ISO-8859-1>Caf\xe9") == "<meta charset=ISO-8859-1>Café"
    assert decode(b"<meta charset='windows-1252'>\x93q\x94")[-3:] == "“q”"
    assert decode(b"\xef\xbb\xbfx") == "x" and decode("é".encode()) == "é" and decode(b"\xff") == "�"
    assert decode(b"<meta charset=nonsense>\xc3\xa9").endswith("é")


def test_stage(spark):
    df = spark.createDataFrame([(1, "https://x.org/a", page(f"<article><p>{LONG}</p></article>"), "k"), (2, None, None, "k")], "page_id long, url string, html string, images string")
    got = {r.page_id: r for r in extract_df(df).collect()}
    assert "main text" in got[1].content_text and got[1].metadata.hostname == "x.org" and got[1].images == []
    assert got[2].content_text == "" and got[2].warnings
    assert extract_df(df.limit(0)).count() == 0
    binary = extract_df(df.withColumn("html", F.encode("html", "UTF-8")))
    assert sorted(r.content_text for r in binary.collect()) == sorted(r.content_text for r in got.values())
    assert html_nodes(df.select("page_id", "html")).where("tag = 'p'").count() == 1


def test_features():
    doc = parse(page("<div class=grid><div class='product-card'>a <b class=price>$1</b></div><div class='product-card'>b</div><div class='product-card'>c</div></div><h2>x</h2>"))
    f = dict(zip(NAMES, features(doc, doc.first("body"), "product", "https://shop.x.org/products/a/b"), strict=True))
    assert len(f) == 89
    assert [f[k] for k in ("product_path", "shop_domain", "n_products", "most_equal_classes", "n_prices", "n_cards", "cards_with_price", "path_parts", "og_product", "has_cart")] == [1, 1, 3, 3, 1, 3, 1, 3, 1, 0]


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.html").write_text(page(f"<article><p>{LONG}</p></article>", "<title>A &amp; B story</title><meta name=author content='Jane Doe'>"))
    (tmp_path / "in/b.html").write_text(" ")
    (tmp_path / "in/c.txt").write_text("no")
    assert html_files.write_markdown(spark, str(tmp_path / "in"), str(tmp_path / "out")) == {"success": 1, "empty": 1, "failed": 0}
    row = spark.read.parquet(str(tmp_path / "out")).first()
    assert row.name == "a.md" and row.document.startswith('---\ntitle: "A & B story"\nauthor: "Jane Doe"\nsource_file: "a.html"\nconfidence: ') and "main text" in row.document
    line = html_files.json_lines(extract_df(html_files.read_html(spark, str(tmp_path / "in")).where("name = 'a.html'"))).first().value
    assert line.startswith('{"title":"A & B story","author":"Jane Doe","date":null,"main_content":')


def test_stream_equals_batch(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").limit(6)
    df.write.parquet(str(tmp_path / "pages"))
    stream = extract_stream(spark, str(tmp_path / "pages"), df.schema)
    q = stream.select("page_id", "content_text").writeStream.format("memory").queryName("extracted").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(spark.table("extracted").collect()) == sorted(extract_df(df).select("page_id", "content_text").collect())


def test_one_page():
    import json

    from sievemill.cli import one_page

    got = json.loads(one_page(page(f"<article><p>{LONG}</p></article>", "<title>A fine title</title>").encode(), "https://x.org/", None, False))
    assert got["title"] == "A fine title" and got["author"] is None and "main text" in got["main_content"] and got["page_type"] == "article" and "content_markdown" not in got


def test_all_matches_of_a_content_selector():
    """Posts of a forum, parts of a product, bodies of a document: all count, nested ones once."""
    posts = "".join(f"<div class='topic-body'><p>Post {i} says: {LONG[:200]}</p></div><div class='between'>gap {i}</div>" for i in range(4))
    got = text(f"<div>{posts}</div>", page_type="forum")
    assert [got.count(f"Post {i} says") for i in range(4)] == [1, 1, 1, 1] and "gap" not in got
    nested = f"<div class='product-detail'><p>Outer {LONG[:200]}</p><div class='product-detail'><p>Inner part of it, which is long enough to stay here</p></div></div>"
    got = text(nested, page_type="product")
    assert got.count("Outer") == 1 and got.count("Inner part") == 1
    docs = "".join(f"<div class='markdown'><h2>Part {i}</h2><p>Body {i}: {LONG[:150]}</p></div>" for i in range(3))
    got = text(docs, page_type="docs")
    assert all(f"Body {i}" in got for i in range(3))


def test_structured_body_has_html():
    ld = '<script type="application/ld+json">{"@type":"Article","articleBody":"%s"}</script>' % (LONG + " a &lt; b")
    got = extract(page("<div><p>Short.</p></div>", ld), Options(output_markdown=True))
    assert "<p>This sentence" in got["content_html"] and "main text" in got["content_markdown"]
    notice = extract(page(f"<article><p>This site uses cookies. {LONG[:900]}</p></article>", '<script type="application/ld+json">{"@type":"Article","articleBody":"%s"}</script>' % LONG[:700]))
    assert notice["content_text"].startswith("This sentence") and "JSON-LD content" in notice["warnings"][-1]
    posts = '{"topic_1": "{\\"post_stream\\": {\\"posts\\": [{\\"cooked\\": \\"<p>%s</p>\\"}]}}"}' % LONG
    got = extract(page(f"<div data-preloaded='{posts}'>x</div>"), Options(page_type="forum"))
    assert "main text" in got["content_text"] and got["content_html"].startswith("<p>")


def test_declared_language_comes_from_the_root():
    body = f"<article><p>{LONG}</p></article>"
    both = "<html lang=de><head><meta property='og:locale' content='en_US'></head><body>%s</body></html>" % body
    assert "main text" in extract(both, Options(target_language="de"))["content_text"]
    assert X.document_language(parse("<meta http-equiv=Content-Language content=fr-CH>")) == "fr"
    assert X.document_language(parse("<p>x")) is None


def test_large_spans():
    t = parse("<table><tr><td colspan=1500>x</td></tr><tr><td>a</td><td>b</td></tr></table>").first("table")
    assert table_text(t).split("\n")[0].count("x") == 1500
    t = parse("<table><tr><td colspan=30000>x</td></tr></table>").first("table")
    assert table_text(t).count("x") <= 20_000


@pytest.mark.parametrize("name,want", [("docs", "documentation"), ("Category", "collection"), ("FORUM", "forum"), ("listing", "listing")])
def test_page_type_names(name, want):
    assert extract(page("<p>x"), Options(page_type=name))["metadata"]["page_type"] == want


def test_unknown_page_type(spark):
    with pytest.raises(ValueError, match="unknown page type"):
        extract_df(spark.createDataFrame([("<p>x",)], "html string"), Options(page_type="news"))


@pytest.mark.parametrize(
    "head,body,want",
    [
        ("<meta charset=latin-1>", b"Caf\xe9 \x80\x81", "Caf\xe9 \u20ac\x81"),
        ("<meta charset=windows-1251>", "мир".encode("cp1251"), "мир"),
        ("<meta name=x charset=nonsense><meta http-equiv='Content-Type' content='text/html; charset=koi8-r'>", "мир".encode("koi8-r"), "мир"),
        ("<meta charset=gb2312>", "中文".encode("gb18030"), "中文"),
        ("<meta charset=shift_jis>", "日本".encode("cp932"), "日本"),
        ("<meta charset=nonsense>", "é".encode(), "é"),
        ("<meta charset=base64>", "é".encode(), "é"),
    ],
)
def test_declared_charsets(head, body, want):
    assert decode(head.encode() + body).endswith(want)


def test_sql_names(spark):
    register(spark)
    spark.createDataFrame([(1, page(f"<article><p>{LONG}</p><table><tr><th>k</th></tr><tr><td>v</td></tr></table></article>"), "https://forum.x.org/a/b")], "page_id long, html string, url string").createOrReplaceTempView("sql_pages")
    r = spark.sql("SELECT extract_page(html, url) AS p, url_type(url) AS kind, absolute_url('../c', url) AS up, table_markdown(html) AS t, page_text(html) AS x FROM sql_pages").first()
    assert "main text" in r.p.content_text and r.p.metadata.page_type == r.kind == "forum" and r.up == "https://forum.x.org/c" and r.t.startswith("| k") and "main text" in r.x
    assert [x.tag for x in spark.sql("SELECT n.tag FROM sql_pages, LATERAL html_nodes(html) n WHERE n.tag IN ('td', 'th') ORDER BY n.node").collect()] == ["th", "td"]


def test_model_and_vote(spark):
    rows = [(i, f"https://x.org/{i}", page(f"<h1>Cart {i}</h1>" + "<div class=product-card>P <b class=price>$1</b></div>" * 8 if i % 2 else f"<article><p>{LONG}</p></article>"), "collection" if i % 2 else "article") for i in range(24)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, kind string")
    model = page_types.train(df, "kind", trees=8)
    typed = page_types.vote(page_types.classify(model, df))
    got = {r.page_id: (r.page_type, r.classification_confidence) for r in typed.collect()}
    assert all(got[i][0] == ("collection" if i % 2 else "article") and 0.5 <= got[i][1] <= 1 for i in range(24))
    out = extract_df(typed.drop("classification_confidence"), page_type="page_type").select("page_id", "metadata.page_type").collect()
    assert {r.page_id: r.page_type for r in out} == {i: got[i][0] for i in got}


def test_type_scores(spark):
    df = spark.createDataFrame([("article", 1.0), ("article", 0.5), ("forum", 0.25)], "page_type string, fscore double")
    assert {r.page_type: (r.pages, r.mean_score) for r in page_types.type_scores(df).collect()} == {"article": (2, 0.75), "forum": (1, 0.25), None: (3, 0.5)}


def test_markdown_files_and_json_line(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.html").write_text(page(f"<article><h2>Part</h2><p>{LONG}</p></article>"))
    (tmp_path / "in/b.html").write_text("\n")
    assert html_files.markdown_files(spark, str(tmp_path / "in"), str(tmp_path / "md")) == {"success": 1, "empty": 1, "failed": 0}
    assert sorted(p.name for p in (tmp_path / "md").iterdir() if not p.name.startswith(".")) == ["a.md"] and "## Part" in (tmp_path / "md/a.md").read_text()
    line = json.loads(cli.one_page(page(f"<article><p>{LONG}</p></article>").encode(), None, None, False, True))
    assert line["content_html"].startswith("<p>") and line["confidence"] > 0.5 and "content_markdown" not in line
    assert json.loads(cli.one_page(b"x", None, "news", False)) == {"title": None, "author": None, "date": None, "main_content": "", "confidence": 0.0}
