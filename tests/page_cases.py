"""Small pages for what the pages table does not hold: forums, products, manuals, tables, images, comments, structured data, encodings.

A case is a page with words in capitals, options, and the words that the rules keep, in
order. The SQL of a query is the list of its cases with what they must give.
"""

from __future__ import annotations

import json
from html import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemill.operators import classic
from sievemill.operators import rules as R
from sievemill.operators import stage
from sievemill.operators import values as V
from sievemill.operators.dom import parse
from sievemill.operators.page import Options

PROSE = " ".join(f"This sentence of the main text holds several useful words, and number {i}." for i in range(16))
SOME = PROSE[:300]
LINKS = "".join(f"<li><a href='/{i}'>Go {i}</a></li>" for i in range(8))


def page(body: str, head: str = "") -> str:
    return f"<html><head>{head}</head><body>{body}</body></html>"


def ld(data: str) -> str:
    return f'<script type="application/ld+json">{data}</script>'


def p(word: str, text: str = PROSE) -> str:
    return f"<p>{word} {text}</p>"


SELECTION = {
    "body name": (page(f"<div class='article-body'>{p('KEPT')}</div><div class='other'><p>LOST words</p></div>"), {}, "KEPT"),
    "article": (page(f"<div><p>LOST words</p></div><article>{p('KEPT')}</article>"), {}, "KEPT"),
    "story name": (page(f"<div id='story-body'>{p('KEPT')}</div><div><p>LOST words</p></div>"), {}, "KEPT"),
    "main-content id": (page(f"<div id='Main-Content'>{p('KEPT')}</div><div><p>LOST words</p></div>"), {}, "KEPT"),
    "main": (page(f"<main>{p('KEPT')}</main><div><p>LOST words</p></div>"), {}, "KEPT"),
    "content in a name": (page(f"<div class='mycontent'>{p('KEPT')}</div><div><p>LOST words</p></div>"), {}, "KEPT"),
    "inside a side box": (page(f"<aside><div class='article-body'>{p('LOST')}</div></aside><div class='post-content'>{p('KEPT')}</div>"), {}, "KEPT"),
    "first of two articles": (page(f"<article>{p('FIRST')}</article><article>{p('SECOND')}</article>"), {}, "FIRST"),
    "scored": (page(f"<div>{p('KEPT')}{p('MORE')}{p('REST')}</div><div><p>LOST words here</p></div>"), {}, "KEPT,MORE,REST"),
    "short body": (page("<p>WHOLE body text</p><p>AGAIN a line</p>"), {"use_fallback_extraction": False}, "WHOLE,AGAIN"),
    "wider parent": (page(f"<section><div class='article-body'><p>PART one</p></div>{p('TWICE')}</section>"), {}, "PART,TWICE"),
    "split bodies": (page(f"<article><div class='article__body'>{p('FIRST', SOME)}</div><div class='gap'>x</div><div class='article__body'>{p('SECOND')}</div></article>"), {}, "FIRST,SECOND"),
    "forum posts": (page("".join(f"<div class='topic-body'>{p(f'POST{i}', SOME)}</div><div>GAPS</div>" for i in range(4))), {"page_type": "forum"}, "POST0,POST1,POST2,POST3"),
    "product parts": (page(f"<div class='product-info'>{p('PARTA', SOME)}</div><div class='product-info'>{p('PARTB', SOME)}</div><div class='reviews'>{p('LOST')}</div>"), {"page_type": "product"}, "PARTA,PARTB"),
    "manual bodies": (page("".join(f"<div class='markdown'><h2>Part</h2>{p(f'BODY{i}', SOME)}</div>" for i in range(3)) + f"<div class='sidebar'>{p('LOST')}</div>"), {"page_type": "docs"}, "BODY0,BODY1,BODY2"),
    "nested parts once": (page(f"<div class='product-detail'>{p('OUTER', SOME)}<div class='product-detail'>{p('INNER', SOME)}</div></div>"), {"page_type": "product"}, "OUTER,INNER"),
    "language en": (page(f"<article lang=en>{p('ENGLISH')}</article><article lang=de-AT>{p('GERMAN')}</article>"), {"target_language": "en"}, "ENGLISH"),
    "language of the root": (f"<html lang=fr><head><meta property='og:locale' content='de_DE'></head><body><article>{p('FRENCH')}</article></body></html>", {"target_language": "fr"}, "FRENCH"),
}
CLEANING = {
    "parts around": (page(f"<header>LOST top</header><nav>LOST menu</nav><article>{p('KEPT')}</article><aside>LOST side</aside><footer>LOST end</footer>"), {}, "KEPT"),
    "header of the article": (page(f"<article><header><p>INTRO of the text</p></header>{p('KEPT')}</article>"), {}, "INTRO,KEPT"),
    "form": (page(f"<article>{p('KEPT')}<form><label>LOST</label><input></form></article>"), {}, "KEPT"),
    "script and style": (page(f"<article><script>var LOST;</script><style>LOST</style>{p('KEPT')}</article>"), {}, "KEPT"),
    "dialog": (page(f"<article>{p('KEPT')}<div role='dialog'>LOST box</div><div class='cookie-banner-x'>LOST</div></article>"), {}, "KEPT"),
    "long noscript": (page(f"<noscript><article>{p('KEPT')}</article></noscript>"), {}, "KEPT"),
    "consent noscript": (page(f"<noscript>{p('LOST consent')}</noscript><article>{p('KEPT')}</article>"), {}, "KEPT"),
    "figure with quote": (page(f"<article>{p('KEPT')}<figure><blockquote><p>QUOTE of someone</p></blockquote></figure></article>"), {}, "KEPT,QUOTE"),
    "unwrapped tags": (page(f"<article><p>ONES <abbr>TWOS</abbr> <small>THREE</small></p>{p('KEPT')}</article>"), {}, "ONES,TWOS,THREE,KEPT"),
    "share names": (page(f"<article>{p('KEPT')}<div class='social-share'>LOST</div><div id='related'>LOST</div><div class='newsletter-box'>LOST</div></article>"), {}, "KEPT"),
    "side box names": (page(f"<article>{p('KEPT')}<div class='sidebar'>LOST</div><div class='right-sidebar'>LOST</div><div class='l-sidebar'>STAY here</div></article>"), {}, "KEPT,STAY"),
    "author boxes": (page(f"<article>{p('KEPT')}<div class='author-box'>LOST</div><div class='author'>LOST</div><div class='authors-note'>STAY here</div></article>"), {}, "KEPT,STAY"),
    "widgets": (page(f"<article>{p('KEPT')}<div class='widget'>LOST</div><div class='elementor-widget'>STAY here</div></article>"), {}, "KEPT,STAY"),
    "advertising": (page(f"<article>{p('KEPT')}<div class='ad slot'>LOST</div><div class='adventure'>STAY here</div></article>"), {}, "KEPT,STAY"),
    "always out": (page(f"<article>{p('KEPT')}<div class='wp-caption'>LOST</div></article>"), {}, "KEPT"),
    "link list": (page(f"<article>{p('KEPT')}<ul>{LINKS.replace('Go', 'LOST')}</ul></article>"), {}, "KEPT"),
    "list of words": (page(f"<article>{p('KEPT')}<ul><li>POINT of the text</li><li>OTHER point</li></ul></article>"), {}, "KEPT,POINT,OTHER"),
    "one long link": (page(f"<article>{p('KEPT')}<div><a href=/x>LOST {'far away words ' * 9}</a></div></article>"), {}, "KEPT"),
    "share lines": (page(f"<article>{p('KEPT')}<p>Facebook</p><p>LASTLY a line</p></article>"), {}, "KEPT,LASTLY"),
    "title heading": (page(f"<article><h1>TITLE of the text</h1><h2>PART one</h2>{p('KEPT')}</article>", "<title>TITLE of the text</title>"), {}, "PART,KEPT"),
    "title by class": (page(f"<article><h2 class='entry-title'>LOST head</h2>{p('KEPT')}</article>"), {}, "KEPT"),
    "bread crumbs": (page(f"<article><ol itemtype='https://schema.org/BreadcrumbList'><li>LOST</li></ol>{p('KEPT')}</article>"), {}, "KEPT"),
    "empty elements": (page(f"<article><p> </p><div></div>{p('KEPT')}</article>"), {}, "KEPT"),
}
TABLES = {
    "cells": (page(f"<article>{p('KEPT')}<table><tr><th>AAAA</th><th>BBBB</th></tr><tr><td>CCCC</td><td>DDDD</td></tr></table></article>"), {}, "KEPT,AAAA,BBBB,CCCC,DDDD"),
    "spans": (page(f"<article>{p('KEPT')}<table><tr><td colspan=2>WIDE</td></tr><tr><td rowspan=2>TALL</td><td>ONES</td></tr><tr><td>TWOS</td></tr></table></article>"), {}, "KEPT,WIDE,WIDE,TALL,ONES,TALL,TWOS"),
    "layout": (page(f"<table role='presentation'><tr><td><article>{p('KEPT')}</article></td></tr></table>"), {}, "KEPT"),
    "one row": (page(f"<article>{p('KEPT')}<table><tr><td>LEFT</td><td>RIGHT</td></tr></table></article>"), {}, "KEPT,LEFT,RIGHT"),
    "without tables": (page(f"<article>{p('KEPT')}<table><tr><td>LOST</td></tr><tr><td>LOST</td></tr></table></article>"), {"include_tables": False}, "KEPT"),
    "link table": (page(f"<article>{p('KEPT')}<table>{''.join(f'<tr><td><a href=/{i}>LOST {SOME[:40]}</a></td></tr>' for i in range(8))}</table></article>"), {}, "KEPT"),
}
FALLBACKS = {
    "article body in data": (page("<div><p>Short.</p></div>", ld('{"@type":"Article","articleBody":"DATA ' + PROSE + '"}')), {}, "DATA"),
    "notice first": (page(f"<article><p>LOST cookie notice. {PROSE[:700]}</p></article>", ld('{"@type":"Article","articleBody":"DATA ' + PROSE[:600] + '"}')), {}, "DATA"),
    "much larger body": (page(f"<article>{p('LOST', SOME)}</article>", ld('{"@type":"Article","articleBody":"DATA ' + PROSE + '"}')), {}, "DATA"),
    "smaller body": (page(f"<article>{p('KEPT')}</article>", ld('{"@type":"Article","articleBody":"LOST ' + PROSE[:600] + '"}')), {}, "KEPT"),
    "forum data": (page(f"<div data-preloaded='{escape(json.dumps({'topic_1': json.dumps({'post_stream': {'posts': [{'cooked': p('DATA')}]}})}))}'>x</div>"), {"page_type": "forum"}, "DATA"),
    "product data": (page("<div>Buy</div>", ld('{"@type":"Product","description":"DATA ' + SOME + '"}')), {}, "DATA"),
    "collection text": (page(f"<main>{p('KEPT')}</main><div class='category-description'>ABOUT these things there is a good deal to say, and more than fifty letters of it.</div>"), {"page_type": "collection"}, "ABOUT,KEPT"),
    "repeated items": (page("<ul class='x'>" + "".join(f"<li>ITEM{i} {SOME[:110]}</li>" for i in range(4)) + "</ul><div><p>few words</p></div>"), {"page_type": "listing", "use_fallback_extraction": False}, "ITEM0,ITEM1,ITEM2,ITEM3"),
    "baseline article": (page("<article><h2>HEADS up</h2><span>SPAN text of some length that goes on for a while, so that it has more than a hundred letters in all.</span></article>"), {}, "HEADS,SPAN"),
    "no content": ("<html></html>", {}, ""),
}
COMMENTS = {
    "by id": (page(f"<article>{p('KEPT')}</article><section id='comments'>{p('REPLY', SOME)}</section>"), "REPLY"),
    "by class": (page(f"<article>{p('KEPT')}</article><div class='comment-list'>{p('REPLY', SOME)}</div>"), "REPLY"),
    "by pattern": (page(f"<article>{p('KEPT')}</article><div class='my discussion-x'>{p('REPLY', SOME)}</div>"), "REPLY"),
    "too short": (page(f"<article>{p('KEPT')}</article><section id='comments'><p>LOST words</p></section>"), ""),
    "none": (page(f"<article>{p('KEPT')}</article>"), ""),
}
_PICTURES = "<figure><img src=/a/b.png alt=Alt><figcaption>Cap  tion</figcaption></figure><img data-src='/c.jpg'><img src=/a/b.png>"
IMAGES = {
    "figure first": (page(f"<article>{p('KEPT')}{_PICTURES}</article>"), ["/a/b.png|b.png|Alt|Cap tion|true", "/c.jpg|c.jpg|||false"]),
    "hero by name": (page(f"<article>{p('KEPT')}{_PICTURES}</article>", "<meta property='og:image' content='https://x.org/y/C.jpg?w=1'>"), ["/a/b.png|b.png|Alt|Cap tion|false", "/c.jpg|c.jpg|||true"]),
    "outside of the text": (page(f"<article>{p('KEPT')}</article><img src='/d.gif?x=1'>"), ["/d.gif?x=1|d.gif|||true"]),
}
META = {
    "title of the page": (page("<p>x", "<title>Big News Story | The Site</title>"), "title", "Big News Story"),
    "title by heading": (page("<h1>Heading of the page</h1>"), "title", "Heading of the page"),
    "title by property": (page("<p>x", "<meta property='og:title' content='From the meta'><title>Other words here</title>"), "title", "From the meta"),
    "title in data": (page("<p>x", ld('{"@type":"NewsArticle","headline":"From data"}') + "<title>Other words here</title>"), "title", "From data"),
    "site of the title": (page("<p>x", "<title>Big News Story | The Site</title>"), "sitename", "The Site"),
    "site by class": (page("<div class='site-title'>My Site</div>", "<title>Story</title>"), "sitename", "My Site"),
    "site by header": (page("<header>Head of it</header>", "<title>Story</title>"), "sitename", "Head of it"),
    "author by name": (page("<p>x", "<meta name=author content='Jane Doe'>"), "author", "Jane Doe"),
    "author in data": (page("<p>x", ld('{"@type":"Article","author":{"@type":"Person","givenName":"Ann","familyName":"Lee"}}')), "author", "Ann Lee"),
    "author by link": (page("<a rel=author>By Jane Doe</a>"), "author", "Jane Doe"),
    "author by class": (page("<span class='byline'>By Jane Doe and 2 more</span>"), "author", "Jane Doe"),
    "author refused": (page("<p>x", "<meta name=author content='https://x.org/jane'>"), "author", None),
    "date by property": (page("<p>x", "<meta property='article:published_time' content='2024-01-15T10:30:00+02:00'>"), "date", "2024-01-15 08:30:00"),
    "date of time": (page("<time datetime='2024-01-15'>x</time>"), "date", "2024-01-15 00:00:00"),
    "date in words": (page("<time>January 15, 2024</time>"), "date", "2024-01-15 00:00:00"),
    "date by class": (page("<span class='post-date'>15/01/2024</span>"), "date", "2024-01-15 00:00:00"),
    "date in data": (page("<p>x", ld('{"@type":"Article","datePublished":"2024-02-03"}')), "date", "2024-02-03 00:00:00"),
    "date in data, other format": (page("<p>x", ld('{"@type":"Article","datePublished":"2024/02/03"}')), "date", None),
    "url by link": (page("<p>x", "<link rel=canonical href='https://x.org/a'>"), "url", "https://x.org/a"),
    "host": (page("<p>x", "<meta property='og:url' content='https://Www.X.org/a'>"), "hostname", "www.x.org"),
    "description": (page("<p>x", "<meta name=description content=' Some words '>"), "description", "Some words"),
    "tags": (page("<p>x", "<meta name=keywords content=' rust,  scraping , ,web '>"), "tags", "rust|scraping|web"),
    "tags by link": (page("<a rel=tag>One</a><a rel=tag>Two</a>"), "tags", "One|Two"),
    "sections": (page("<p>x", "<meta property='article:section' content='World; News'>"), "categories", "World|News"),
    "sections by link": (page("<a href='/category/world'>World</a>"), "categories", "World"),
    "licence by name": (page("<p>x", "<meta name='dc.rights' content='https://creativecommons.org/licenses/by-sa/4.0/'>"), "license", "CC BY SA 4.0"),
    "licence by link": (page("<a rel=license href='https://creativecommons.org/licenses/by-nc/3.0/'>x</a>"), "license", "CC BY-NC"),
    "language by property": (page("<p>x", "<meta property='og:locale' content='en_US'>"), "language", "en"),
    "image": (page("<p>x", "<meta property='og:image' content='https://x.org/c.jpg'>"), "image", "https://x.org/c.jpg"),
    "image refused": (page("<p>x", "<meta property='og:image' content='c.jpg'>"), "image", None),
}
_CARDS = "".join(f"<div class='product-card'><a href=/p{i}>P</a></div>" for i in range(6))
TYPES = {
    "cards and cart": (page(f"{_CARDS}<button>Add to cart</button>"), "collection"),
    "cards and pages": (page(f"{_CARDS}<div class='pagination'>1</div>"), "collection"),
    "product data": (page("<p>x", ld('{"@type":"Product"}')), "product"),
    "offers": (page("<p>x", ld('{"@type":"Product","offers":{"@type":"AggregateOffer"}}')), "collection"),
    "collection data": (page("<p>x", ld('{"@type":"CollectionPage"}')), "collection"),
    "product by property": (page("<p>x", "<meta property='og:type' content='product.item'>"), "product"),
    "manual": (page("<div class='docs-sidebar'>x</div>" + "<pre>code</pre>" * 3), "documentation"),
    "links": (page(f"<p>few</p><ul>{LINKS}</ul>"), "listing"),
    "prose": (page(p("text")), "article"),
}
CHARSETS = {
    "latin-1": (b"<meta charset=latin-1>Caf\xe9 \x80\x81", "Café €\u0081"),
    "windows-1251": ("<meta charset=windows-1251>мир".encode("cp1251"), "мир"),
    "second pattern": (b"<meta charset=nonsense><meta http-equiv='Content-Type' content='text/html; charset=koi8-r'>" + "мир".encode("koi8-r"), "мир"),
    "gb2312": ("<meta charset=gb2312>中文".encode("gb18030"), "中文"),
    "shift_jis": ("<meta charset=shift_jis>日本".encode("cp932"), "日本"),
    "mark": (b"\xef\xbb\xbf<meta charset=latin-1>\xc3\xa9", "é"),
    "wide mark": (b"\xff\xfe" + "é".encode("utf-16-le"), "é"),
    "unknown": ("<meta charset=nonsense>é".encode(), "é"),
    "broken": (b"a\xffb", "a�b"),
    "none": ("é".encode(), "é"),
}
NAMES = {
    "sidebar": True, "left-sidebar": True, "l-sidebar": False, "l-main-sidebar": True, "my-sidebar-x": False, "author": True, "author-bio": True, "authority": False, "widget": True, "elementor-widget": False, "share-buttons": True,
    "c-social": False, "social": True, "main-menu": True, "breadcrumbs": True, "post-meta": True, "article text": False, "ad": True, "ads x": True, "x ad": False, "comment": True, "related-posts": True, "footer": True, "footnote": False, "content": False,
}
AROUND = {"mega-menu": True, "js-menu": False, "x hero": True, "heroic": False, "nav": True, "navy": False, "related": True, "content": False, "sidebar": True, "content-sidebar": False}
TITLES = {
    "A story of words|A story of words - The Site": True, "A story|a  STORY": True, "A story|Another": False, "|x": False, "Part|Part: more of it": True, "News | Site|News": True,
}
SITES = {
    "Big News Story | The Site": "Big News Story", "The Site | Big News Story of today": "Big News Story of today", "A - B": "A - B", "Long enough head - Short tail": "Long enough head", "Nothing to cut": "Nothing to cut", "One » Two words of it": "Two words of it",
}
LINKED = {
    "/a/b": "https://x.org/a/b", "c": "https://x.org/d/c", "../c": "https://x.org/c", "?q=1": "https://x.org/d/e?q=1", "#top": "https://x.org/d/e#top", "https://y.org/z": "https://y.org/z", "//y.org/z": "https://y.org/z", "mailto:a@b.c": "mailto:a@b.c", "": "",
}
PIPES = {
    "<table><thead><tr><th align=right>a</th><th>b</th></tr></thead><tbody><tr><td>1</td><td>2|3</td></tr></tbody></table>": "|   a | b   |\n|--:| --- |\n|   1 | 2|3 |\n",
    "<table><tr><td align=center>x</td><td>longer</td></tr><tr><td>y</td></tr></table>": "|  x  | longer |\n|:-:| ------ |\n|  y  |        |\n",
    "<p>x</p>": "",
}
LOOSE = {
    "# Head\n\ntext": "# Head\n\ntext", "a < b": "a \\< b", "x [1] y": "x \\[1\\] y", "[a](b)": "[a](b)", "**bold** and *it*": "**bold** and *it*", "2 * 3": "2 \\* 3", "`a*b` c": "`a*b` c", "```\na < b\n```\nc < d": "```\na < b\n```\nc \\< d",
    "done \\* so": "done \\* so", "- item\n* other\n+ third": "- item\n* other\n+ third", "> said\n> > more": "> said\n> > more", "see <https://x.org>": "see <https://x.org\\>", "snake_case": "snake_case",
}
FILES = {"a.PNG": True, "/x/y.jpeg?w=1": True, "a.svgz": False, "png": True, "a.b.avif": True, "": False, "x.html": False}


CLASSIC = {
    "body name": (SELECTION["body name"][0], {}, "KEPT"),
    "main": (SELECTION["main"][0], {}, "KEPT"),
    "first of two articles": (SELECTION["first of two articles"][0], {}, "FIRST"),
    "recovered": (page(f"<div>{p('ONES')}<span>{p('TWOS')}</span></div>"), {}, "ONES,TWOS"),
    "teaser": (page(f"<article>{p('KEPT')}<div class='teaser'>{p('LOST', SOME)}</div></article>"), {}, "KEPT"),
    "teaser in recall": (page(f"<article>{p('KEPT')}<div class='teaser'>{p('STAY', SOME)}</div></article>"), {"favor_recall": True}, "KEPT,STAY"),
    "caption": (page(f"<article>{p('KEPT')}<p class='caption'>LOST words</p></article>"), {}, "KEPT"),
    "precision": (page(f"<article>{p('KEPT')}<p class='bottom'>LOST words</p><header><p>LOST</p></header></article>"), {"favor_precision": True}, "KEPT"),
    "hidden": (page(f"<article>{p('KEPT')}<p style='display:none'>LOST</p><p hidden>LOST</p></article>"), {}, "KEPT"),
    "lists and quotes": (page(f"<article>{p('KEPT')}<ul><li>POINT one</li><li>OTHER two</li></ul><blockquote>QUOTE of it</blockquote></article>"), {}, "KEPT,POINT,OTHER,QUOTE"),
    "table": (page(f"<article>{p('KEPT')}<table><tr><td>AAAA</td><td>BBBB</td></tr><tr><td>CCCC</td><td>DDDD</td></tr></table></article>"), {}, "KEPT,AAAA,BBBB,CCCC,DDDD"),
    "link list": (page(f"<article>{p('KEPT')}<ul>{LINKS.replace('Go', 'LOST')}</ul></article>"), {}, "KEPT"),
    "repeated texts": (page(f"<article>{''.join(p('SAME') for _ in range(5))}</article>"), {"deduplicate": True}, "SAME,SAME,SAME"),
    "comments go": (page(f"<article>{p('KEPT')}<div class='comments-box'>{p('LOST', SOME)}</div></article>"), {}, "KEPT"),
}
CLASSIC_COMMENTS = {
    "list": (page(f"<article>{p('KEPT')}</article><ol class='commentlist'><li>REPLY of a reader</li><li class='nocomments'>LOST</li></ol>"), "REPLY"),
    "by id": (page(f"<article>{p('KEPT')}</article><section id='comments-x'><p>REPLY of a reader</p><cite>LOST name</cite></section>"), "REPLY"),
    "thread": (page(f"<article>{p('KEPT')}</article><div id='disqus_thread'><p>REPLY of a reader</p></div>"), "REPLY"),
    "by class": (page(f"<article>{p('KEPT')}</article><div class='user-comment'><p>REPLY of a reader</p></div>"), "REPLY"),
    "none": (page(f"<article>{p('KEPT')}</article>"), None),
}
MENUS = {
    "Home | About | Contact\nThe text.": "The text.", "Skip to content. The text.": "The text.", "< Back\n\nThe text.": "The text.", "The text | of one": "The text | of one", "a > b > c < d <\nThe text.": "The text.", "The text.": "The text.",
}
_MENU = "<ul>" + "".join(f"<li><a href='/{i}'>Go {i}</a></li>" for i in range(12)) + "</ul>"
SECTIONS = {
    f"<div><p>{PROSE}</p>{_MENU}</div>": f"<div><p>{PROSE}</p></div>",
    f"<p>Few</p>{_MENU}": f"<p>Few</p>{_MENU}",
    f"<p>{PROSE} <a href='/x'>one</a></p>": f"<p>{PROSE} <a href='/x'>one</a></p>",
}
GRAPHS = {
    "<meta property='og:title' content='A'><meta property='og:title' content='B'><meta property='og:locale' content='de_AT'>": "language=de,title=A",
    "<meta property='og:url' content='https://x.org'><meta property='og:type' content='article'><meta name='title' content='C'>": "og_type=article,url=https://x.org",
    "<meta property='og:image' content=''>": "",
}
LIGHT = {
    "<title>Big News Story | The Site</title>": "Big News Story|null",
    "<meta name=title content='From the meta'><meta name=author content='Jane Doe'><title>x</title>": "From the meta|Jane Doe",
    "<h1>Heading of the page</h1>": "Heading of the page|null",
}


def _sql(rows) -> str:
    quote = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join(f"({', '.join(map(quote, r))})" for r in rows) + ") AS v"


def words(column: str = "content_text") -> Column:
    """The capital words of a text, in order."""
    return F.array_join(F.regexp_extract_all(F.coalesce(column, F.lit("")), F.lit("([A-Z]{4,}[0-9]?)"), 1), ",")


def _extracted(spark, cases: dict, value: Column) -> DataFrame:
    """case_name and value of every case, extracted with its options."""
    parts = []
    for o in dict.fromkeys(tuple(sorted(c[1].items())) for c in cases.values()):
        rows = [(k, c[0], None) for k, c in cases.items() if tuple(sorted(c[1].items())) == o]
        parts.append(stage.extract(spark.createDataFrame(rows, "case_name string, html string, url string"), Options(**dict(o))).select("case_name", value.alias("value")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def _words_query(cases: dict):
    return lambda spark, d: _extracted(spark, cases, words())


def case_comments(spark, d):
    return _extracted(spark, {k: (html, {"include_comments": True}) for k, (html, _) in COMMENTS.items()}, words("comments_text"))


def case_images(spark, d):
    out = _extracted(spark, {k: (html, {"include_images": True}) for k, (html, _) in IMAGES.items()}, F.col("images")).select("case_name", F.posexplode("value").alias("place", "i"))
    none = lambda c: F.coalesce(F.col(f"i.{c}").cast("string"), F.lit(""))
    return out.select("case_name", F.col("place").cast("string").alias("place"), F.concat_ws("|", *(none(c) for c in ("src", "filename", "alt", "caption", "is_hero"))).alias("value"))


def case_metadata(spark, d):
    m = lambda k: F.array_join(F.col(f"metadata.{k}"), "|") if k in ("tags", "categories") else F.date_format(F.col(f"metadata.{k}"), "yyyy-MM-dd HH:mm:ss") if k == "date" else F.col(f"metadata.{k}")
    df = stage.extract(spark.createDataFrame([(k, c[0], None, c[1]) for k, c in META.items()], "case_name string, html string, url string, field string"))
    value = F.lit(None).cast("string")
    for k in dict.fromkeys(c[1] for c in META.values()):
        value = F.when(F.col("field") == k, m(k)).otherwise(value)
    return df.select("case_name", "field", value.alias("value"))


def case_page_types(spark, d):
    df = spark.createDataFrame([(k, c[0], None) for k, c in TYPES.items()], "case_name string, html string, url string")
    return stage.html_signals(df).select("case_name", F.col("page_type").alias("value"))


def case_charsets(spark, d):
    df = spark.createDataFrame([(k, c[0]) for k, c in CHARSETS.items()], "case_name string, body binary")
    return stage.values_map(df, "body", "value", lambda text: text.split(">")[-1]).select("case_name", "value")


def _values_query(cases: dict, function):
    def run(spark, d):
        df = spark.createDataFrame([(k,) for k in cases], "case_name string")
        return stage.values_map(df, "case_name", "value", function).select("case_name", "value")

    return run


def case_classic(spark, d):
    parts = []
    for o in dict.fromkeys(tuple(sorted(c[1].items())) for c in CLASSIC.values()):
        df = spark.createDataFrame([(k, c[0]) for k, c in CLASSIC.items() if tuple(sorted(c[1].items())) == o], "case_name string, html string")
        parts.append(stage.classic(df, Options(**dict(o))).select("case_name", words().alias("value")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def case_classic_comments(spark, d):
    df = spark.createDataFrame([(k, c[0]) for k, c in CLASSIC_COMMENTS.items()], "case_name string, html string")
    return stage.classic(df, Options(include_comments=True)).select("case_name", F.when(F.col("comments_text").isNotNull(), words("comments_text")).alias("value"))


_yes = lambda x: str(bool(x)).lower()
_graph = lambda x: ",".join(f"{k}={v}" for k, v in sorted(classic.open_graph(parse(x)).items()))


def _light(x: str) -> str:
    m = classic.light_metadata(parse(x), None)
    return f"{m['title']}|{m.get('author') or 'null'}"


QUERIES = {
    "case_classic": case_classic,
    "case_classic_comments": case_classic_comments,
    "case_menu_lines": _values_query(MENUS, classic.strip_menu_line),
    "case_link_sections": _values_query(SECTIONS, classic.strip_link_sections),
    "case_open_graph": _values_query(GRAPHS, _graph),
    "case_light_metadata": _values_query(LIGHT, _light),
    "case_selection": _words_query(SELECTION),
    "case_cleaning": _words_query(CLEANING),
    "case_tables": _words_query(TABLES),
    "case_fallbacks": _words_query(FALLBACKS),
    "case_comments": case_comments,
    "case_images": case_images,
    "case_metadata": case_metadata,
    "case_page_types": case_page_types,
    "case_charsets": case_charsets,
    "case_boilerplate_names": _values_query(NAMES, lambda x: _yes(R.boilerplate(x))),
    "case_around_names": _values_query(AROUND, lambda x: _yes(R.around_boilerplate(x))),
    "case_titles_match": _values_query(TITLES, lambda x: _yes(V.titles_match(*x.rsplit("|", 1)))),
    "case_site_suffix": _values_query(SITES, lambda x: V.strip_site(x, None)),
    "case_absolute_urls": _values_query(LINKED, lambda x: V.absolute(x, "https://x.org/d/e")),
    "case_table_markdown": _values_query(PIPES, stage.table_markdown),
    "case_loose_markdown": _values_query(LOOSE, V.escape_loose_markdown),
    "case_image_files": _values_query(FILES, lambda x: _yes(V.is_image_file(x))),
}
_pairs = lambda cases: _sql([(k, str(v).lower() if isinstance(v, bool) else v) for k, v in cases.items()]) + "(case_name, value)"
_thirds = lambda cases: _sql([(k, c[2]) for k, c in cases.items()]) + "(case_name, value)"
ORACLES = {
    **{name: _thirds(cases) for name, cases in (("case_selection", SELECTION), ("case_cleaning", CLEANING), ("case_tables", TABLES), ("case_fallbacks", FALLBACKS), ("case_classic", CLASSIC))},
    **{name: _pairs({k: c[1] for k, c in cases.items()}) for name, cases in (("case_comments", COMMENTS), ("case_classic_comments", CLASSIC_COMMENTS), ("case_page_types", TYPES), ("case_charsets", CHARSETS))},
    "case_images": _sql([(k, str(i), x) for k, c in IMAGES.items() for i, x in enumerate(c[1])]) + "(case_name, place, value)",
    "case_metadata": _sql([(k, c[1], c[2]) for k, c in META.items()]) + "(case_name, field, value)",
    **{name: _pairs(cases) for name, cases in (("case_menu_lines", MENUS), ("case_loose_markdown", LOOSE), ("case_link_sections", SECTIONS), ("case_open_graph", GRAPHS), ("case_light_metadata", LIGHT), ("case_boilerplate_names", NAMES), ("case_around_names", AROUND), ("case_titles_match", TITLES), ("case_site_suffix", SITES), ("case_absolute_urls", LINKED), ("case_table_markdown", PIPES), ("case_image_files", FILES))},
}
