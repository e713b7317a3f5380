"""Filtered text by columns against the page engine's."""

from __future__ import annotations

import page_cases as cases
from pyspark.sql import functions as F

from sievemill.functions import filtered
from sievemill.operators import page as X
from sievemill.operators.dom import parse

SF = "/root/testdata/sf0.001"
LONG = "These are words of a sentence that says something, with a number of parts. " * 4
MORE = [
    "",
    "bare words <b>and bold</b> ones",
    f"<header>Top</header><nav><a>x</a></nav><article><header>In it</header><h1>Title of it</h1><p>{LONG}<br>more<p>Share this<p>b</article><footer>End</footer>",
    f"<h1>Title of it - Site</h1><h1>Other heading</h1><h2 class='post-title'>No</h2><h2 itemprop='Headline'>No</h2><h3>Kept</h3><div>{LONG}</div>",
    f"<div class='sidebar'>{LONG}</div><div id='my-comments'>{LONG}</div><div class='read-more-link'>x</div><div class='fine'>{LONG}<aside>a</aside></div>",
    "<ul>" + "".join(f"<li><a href=/{k}>Go {k}</a>" for k in range(8)) + f"</ul><p>{LONG}</p><div><a href=/>link words alone</a></div>",
    f"<p>{LONG}<table><tr><td>a<td>b<tr><td rowspan=2>c<td>d<tr><td>e</table><table><tr><td>{LONG}</table><table role=presentation><tr><td>1<td>2<tr><td>3<td>4</table>",
    f"<main><footer>Kept here</footer><section>{LONG}</section></main><script>x</script><style>y</style><noscript>z</noscript><svg><path/>q</svg>",
    f"<ol itemtype='http://schema.org/BreadcrumbList'><li>a</ol><div class='ad top'>no</div><div>Photo by Someone</div><p>By Ann Lee</p><div>{LONG}<ul><li>one<li>two</ul></div>",
]


def engine(page, title, tables=True):
    return X.render_text(X.body_of(parse(page)), X.Options(include_tables=tables), title=title)


def test_as_the_page_engine(spark):
    pages = [*MORE, *(c[0] for c in cases.TABLES.values()), *(c[0] for c in cases.COMMENTS.values())]
    df = spark.createDataFrame([(k, p, "Title of it" if k % 3 else None, "clash") for k, p in enumerate(pages)], "id int, html string, title string, text string")
    for tables in (True, False):
        got = filtered.with_filtered_text(df, title="title", tables=tables).orderBy("id").collect()
        for r, page in zip(got, pages, strict=True):
            assert r.text == engine(page, r.title, tables), page[:300]


def test_as_the_page_engine_on_given_pages(spark):
    df = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html")
    for r in filtered.with_filtered_text(df).collect():
        assert r.text == engine(r.html, None)


def test_null_and_empty_tables(spark):
    df = spark.createDataFrame([(None,)], "html string")
    assert filtered.with_filtered_text(df).collect()[0].text is None
    assert filtered.with_filtered_text(df.where(F.lit(False))).collect() == []


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_tree_is_made_once_and_only_the_title_worked_out(spark):
    """Metadata and filtered text share a page's tree, and fields of metadata that nothing uses aren't found."""
    from sievemill.plans import metadata_queries

    plan = _plan(metadata_queries.filtered_text(spark, SF))
    assert plan.count("AS __fold#") == 1
    for unused in ("__authors", "__dates", "__tags_found", "__categories", "__licences", "__canonical", "__lang", "__meta_author", "__filled_date"):
        assert f"AS {unused}#" not in plan, unused
    assert "AS __titles#" in plan and "AS __sites#" in plan


def test_a_given_tree_gives_the_same_text(spark):
    from sievemill.functions import metadata as M

    df = spark.createDataFrame([(k, p) for k, p in enumerate(["", None, *MORE])], "id int, html string")
    own = M.with_metadata(df).withColumn("title", F.col("metadata.title"))
    kept = M.with_metadata(df, keep_tree=True).withColumn("title", F.col("metadata.title"))
    assert {"texts", "nodes"} <= set(kept.columns) and not {"texts", "nodes"} & set(own.columns)
    apart, shared = (filtered.with_filtered_text(x, title="title", has_tree=h) for x, h in ((own, False), (kept, True)))
    assert apart.columns == shared.columns and apart.orderBy("id").collect() == shared.orderBy("id").collect()
