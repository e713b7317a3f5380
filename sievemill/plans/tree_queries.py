"""Queries over interval-encoded trees (functions/tree.py, functions/content.py), with their DuckDB SQL on the uniform pages table: no Python worker in any plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import content, tree
from ..operators.stage import dealt
from .catalog import STRIP, _clean, pages
from .page_sql import PAGES, _untagged


def nodes_by_tag(spark, d):
    nodes = tree.with_tree(dealt(pages(spark, d).select("page_id", "html"))).select(F.explode("nodes").alias("x"))
    return nodes.select("x.tag").where(~F.col("tag").isin("html", "head", "body", "p", "b")).groupBy("tag").agg(F.count("*").alias("n"))


def nodes_per_page(spark, d):
    """Links by page: how many, with how many texts, and how deep."""
    found = tree.with_tree(dealt(pages(spark, d).select("page_id", "html"))).select("page_id", F.expr(f"filter(transform(nodes, x -> struct(x.tag AS tag, x.depth AS depth, IF(x.tag = 'a', {tree.node_text('x')}, '') AS text)), x -> x.tag = 'a')").alias("a"))
    found = found.where(F.size("a") > 0)
    return found.select("page_id", F.size("a").cast("long").alias("links"), F.size(F.array_distinct("a.text")).cast("long").alias("texts"), F.array_min("a.depth").alias("depth"))


def content_scored(spark, d):
    """The best node of every page by the heuristic score; where none is good enough, no tag and a score of 0."""
    found = content.content_scores(dealt(pages(spark, d).select("page_id", "html")))
    return found.select("page_id", "content.tag", F.coalesce("content.score", F.lit(0)).alias("score"), F.coalesce(F.round("content.coverage", 9), F.lit(0.0)).alias("coverage"), F.size("scores").cast("long").alias("candidates"))


def content_found(spark, d):
    """The first node of every page that the content rules accept, and the number of the rule; no tag and 0 without one."""
    found = content.find_content(dealt(pages(spark, d).select("page_id", "html")))
    return found.select("page_id", F.coalesce("found.rule", F.lit(0)).alias("rule"), "found.tag", F.coalesce("found.bytes", F.lit(0)).alias("bytes"))


def link_dense_elements(spark, d):
    """What the test of link density takes out of every page."""
    found = content.link_density(dealt(pages(spark, d).select("page_id", "html")))
    return found.select("page_id", F.array_join("dense.tag", " ").alias("tags"), F.coalesce(F.aggregate("dense", F.lit(0), lambda a, x: a + x["links"]), F.lit(0)).cast("long").alias("links"))


QUERIES = {f.__name__: f for f in (nodes_by_tag, nodes_per_page, content_scored, content_found, link_dense_elements)}

_PLAIN = "regexp_replace(regexp_replace(html, '(?s)<script>.*?</script>', '<script>', 'g'), '(?s)<style>.*?</style>', '<style>', 'g')"
_LEGACY = lambda x: _untagged(f"regexp_replace({x}, '&amp([^;])', '&amp;\\1', 'g')")  # noqa: E731  a heading was cut within a reference
_ART, _BODY = _LEGACY("art"), _LEGACY("ad || art")
_MEASURED = f"""(SELECT page_id, {_clean(_ART)} AS a, {_clean(_BODY)} AS b, strlen({STRIP(_ART)}) AS an, strlen({STRIP(_BODY)}) AS bn, contains(html, '<article>') AS has, len(ps) AS p, len(regexp_extract_all(art, '<h1>')) AS h,
 len(list_filter(ps, lambda x: strlen({_clean(_LEGACY('x'))}) >= 100)) AS p100 FROM {PAGES})"""
_SCORE = lambda x: f"least(strlen({x}), 8000) + 200 * p + 100 * h + 300 * p100 + 50 * least(len(regexp_extract_all({x}, '[.!?]+')), least(strlen({x}), 8000) // 50)"
_LINKS = _untagged("x")
_DENSE = f"""(SELECT page_id, contains(html, '<div class="ad"') AS more, list_transform(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)(</nav>|$)', 1), '<a href="[^"]*">([^<]*)', 1), lambda x: length({STRIP(_LINKS)})) AS l FROM pages)"""
_TOO_DENSE = lambda limit: f"(len(l) > 0 AND (total < {limit} OR (len(l) = 1 AND total > 100) OR (len(l) >= 5 AND total > 0 AND 2 * short > used)))"
ORACLES = {
    "nodes_by_tag": f"SELECT tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all({_PLAIN}, '<(meta|title|style|script|nav|ul|li|a|div|article|h1|br|footer)(?:[ >])', 1)) AS tag FROM pages) GROUP BY tag",
    "nodes_per_page": "SELECT page_id, count(*) AS links, count(DISTINCT x) AS texts, 6 AS depth FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"[^\"]*\">([^<]*)', 1)) AS x FROM pages) GROUP BY page_id",
    "content_scored": f"""SELECT page_id, CASE WHEN good THEN tag END AS tag, CASE WHEN good THEN score ELSE 0 END AS score, CASE WHEN good THEN round(coverage, 9) ELSE 0 END AS coverage, candidates FROM (SELECT *, coalesce(score >= 1000 AND coverage >= 0.3, false) AS good FROM (
SELECT page_id, CASE WHEN small THEN 'body' ELSE 'article' END AS tag, CASE WHEN small THEN {_SCORE('b')} WHEN a <> '' THEN {_SCORE('a')} END::BIGINT AS score, CASE WHEN small THEN 1 WHEN a <> '' THEN strlen(a) / strlen(b)::DOUBLE END AS coverage, small::BIGINT + (a <> '')::BIGINT AS candidates FROM (SELECT *, strlen(b) BETWEEN 1 AND 500 AS small FROM {_MEASURED})))""",
    "content_found": f"SELECT page_id, CASE WHEN way > 0 THEN 2 ELSE 0 END AS rule, CASE way WHEN 1 THEN 'article' WHEN 2 THEN 'body' END AS tag, CASE way WHEN 1 THEN an WHEN 2 THEN bn ELSE 0 END::INT AS bytes FROM (SELECT *, CASE WHEN has AND an >= 1000 THEN 1 WHEN has AND bn > 2 * an AND bn >= 1000 THEN 2 ELSE 0 END AS way FROM {_MEASURED})",
    "link_dense_elements": f"""SELECT page_id, trim(CASE WHEN {_TOO_DENSE('CASE WHEN more THEN 100 ELSE 300 END')} THEN 'nav ' ELSE '' END || CASE WHEN {_TOO_DENSE(300)} THEN 'ul ' ELSE '' END || repeat('li ', len(l))) AS tags,
 (len(l) * (CASE WHEN {_TOO_DENSE('CASE WHEN more THEN 100 ELSE 300 END')} THEN 1 ELSE 0 END + CASE WHEN {_TOO_DENSE(300)} THEN 1 ELSE 0 END + 1))::BIGINT AS links FROM (SELECT *, coalesce(list_sum(l), 0) AS total, len(list_filter(l, lambda x: x > 0)) AS used, len(list_filter(l, lambda x: x BETWEEN 1 AND 9)) AS short FROM {_DENSE})""",
}
