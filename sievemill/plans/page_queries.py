"""Queries that need a document tree, by name, with their DuckDB SQL: over the pages table, whose uniform markup lets SQL say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lists
from ..functions.columns import SPACE, declared_charset, is_absolute_url, resolve_url
from ..operators import page_types
from ..operators.classic import QUALITY_FEATURES
from ..operators.features import NAMES
from ..operators.page import Options
from ..operators.stage import classic, extract, html_signals, ml_features, quality_features
from .catalog import WORDS, WS, pages
from .page_sql import PAGES

ALL = Options(output_markdown=True, include_images=True, include_comments=True, include_links=True)


def _said():
    return F.array_join("warnings", "|").alias("warnings")


def extract_text(spark, d):
    return extract(pages(spark, d)).select("page_id", "content_text", _said())


def extract_html(spark, d):
    return extract(pages(spark, d), Options(include_links=True)).select("page_id", "content_html")


def extract_markdown(spark, d):
    return extract(pages(spark, d), ALL).select("page_id", "content_markdown")


def extract_all(spark, d):
    out = extract(pages(spark, d), ALL)
    meta = [F.col(f"metadata.{k}").alias(k) for k in ("title", "sitename", "hostname", "language", "page_type")]
    return out.select("page_id", "url", "content_text", "content_html", "content_markdown", *meta, "classification_confidence", "extraction_quality", F.size("images").alias("n_images"), "comments_text", _said())


def page_metadata(spark, d):
    return extract(pages(spark, d)).select("page_id", *[F.col(f"metadata.{k}").alias(k) for k in ("url", "hostname", "language", "page_type", "author", "description")], F.size("metadata.tags").alias("n_tags"))


def page_titles(spark, d):
    return extract(pages(spark, d)).select("page_id", "metadata.title", "metadata.sitename")


def page_signals(spark, d):
    return html_signals(pages(spark, d)).select("page_id", "signals.has_product_grid", "signals.code_block_count", "signals.link_ratio", "signals.paragraph_word_count", "page_type")


def extraction_quality(spark, d):
    return extract(pages(spark, d)).select("page_id", "metadata.page_type", "classification_confidence", "extraction_quality")


def page_features(spark, d):
    f = ml_features(pages(spark, d))
    return f.select("page_id", *[F.element_at("features", NAMES.index(k) + 1).cast("long").alias(k) for k in ("n_headings", "n_images", "n_tables", "n_navs", "n_lists", "has_article")])


def bytes_pages(spark, d):
    """Undecoded bodies give what the texts give. A page that declares another encoding than that of its bytes here, or whose text starts with a byte-order mark of its own, gets a mark, which counts before what it declares."""
    body = F.encode("html", "UTF-8")
    marked = (F.coalesce(declared_charset("html"), F.lit("utf-8")) != "utf-8") | F.startswith("html", F.lit("\ufeff"))
    return extract(pages(spark, d).withColumn("html", F.when(marked, F.concat(F.unhex(F.lit("EFBBBF")), body)).otherwise(body))).select("page_id", F.length("content_text").cast("long").alias("chars"))


def page_type_vote(spark, d):
    """The vote of URL, page and model over all pages; the model's type and confidence go by page_id here."""
    kinds = F.array(*(F.lit(k) for k in lists.PAGE_TYPES))
    typed = html_signals(pages(spark, d).withColumn("kept_url", F.col("url"))).select("page_id", F.when(F.col("page_id") % 3 == 0, "forum").otherwise(F.lit("article")).alias("url_type"), F.col("page_type").alias("refined_type"), F.element_at(kinds, (F.col("page_id") % 3 + 1).cast("int")).alias("model_type"), (F.col("page_id") % 10 / 10.0).alias("model_confidence"))
    return page_types.vote(typed).select("page_id", "page_type", "classification_confidence")


def type_score_rollup(spark, d):
    """Mean quality by page type and its macro mean."""
    scored = extract(pages(spark, d)).select("metadata.page_type", F.round("extraction_quality", 6).alias("fscore"))
    return page_types.type_scores(scored).select(F.coalesce("page_type", F.lit("all")).alias("page_type"), "pages", F.round("mean_score", 4).alias("mean_score"))


def links_resolved(spark, d):
    """Every link of every page as an absolute URL."""
    links = pages(spark, d).select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)).alias("href"))
    found = links.select("page_id", "href", resolve_url("href", "url").alias("absolute_url"))
    return found.withColumn("valid", is_absolute_url("absolute_url"))


def classic_text(spark, d):
    """The classic way over all pages: characters of text without white space."""
    out = classic(pages(spark, d).select("page_id", "html"))
    return out.select("page_id", F.length(F.regexp_replace("content_text", SPACE, "")).cast("long").alias("chars"), (~F.col("used_recovery")).alias("by_rule"))


def page_quality_features(spark, d):
    f = quality_features(pages(spark, d))
    return f.select("page_id", *[F.round(F.element_at("quality_features", QUALITY_FEATURES.index(k) + 1), 9).alias(k) for k in ("heuristic", "bytes", "words", "distinct_words", "paragraphs", "links", "is_article", "of_expected", "share_of_html", "of_description", "scripts", "has_data")])


QUERIES = {f.__name__: f for f in (classic_text, page_quality_features, extract_text, extract_html, extract_markdown, extract_all, page_metadata, page_titles, page_signals, extraction_quality, page_features, bytes_pages, page_type_vote, type_score_rollup, links_resolved)}
_tags = lambda t: f"len(regexp_extract_all(html, '<({t})[ >]'))"
_MEAN = f"SELECT page_type, count(*) AS pages, avg(round(extraction_quality, 6)) AS mean_score FROM {PAGES} GROUP BY 1"
_KINDS = "['" + "', '".join(lists.PAGE_TYPES) + "']"
_PARTS = "list_filter(list_transform(string_split(content_text, chr(10) || chr(10)), lambda x: trim(x)), lambda x: strlen(x) > 20)"
_LOW = WORDS("lower(content_text)")
ORACLES = {
    "page_quality_features": f"SELECT page_id, round(extraction_quality, 9) AS heuristic, n::DOUBLE AS bytes, len({_LOW})::DOUBLE AS words, round(len(list_distinct({_LOW})) / greatest(len({_LOW}), 1)::DOUBLE, 9) AS distinct_words, len({_PARTS})::DOUBLE AS paragraphs, 0::DOUBLE AS links, (page_type = 'article')::INT::DOUBLE AS is_article, round(n / (CASE page_type WHEN 'article' THEN 10228 ELSE 6275 END)::DOUBLE, 9) AS of_expected, round(r, 9) AS share_of_html, -1::DOUBLE AS of_description, 1::DOUBLE AS scripts, 0::DOUBLE AS has_data FROM {PAGES}",
    "classic_text": f"SELECT page_id, length(regexp_replace(CASE WHEN length(h1) + length(array_to_string(paras, '')) >= 200 THEN h1 || array_to_string(paras, '') ELSE array_to_string(paras, '') END, '{WS}', '', 'g')) AS chars, length(h1) + length(array_to_string(paras, '')) >= 200 AS by_rule FROM (SELECT page_id, h1, string_split(lines, chr(10)) AS paras FROM {PAGES})",
    "extract_text": f"SELECT page_id, content_text, warnings FROM {PAGES}",
    "extract_html": f"SELECT page_id, content_html FROM {PAGES}",
    "extract_markdown": f"SELECT page_id, content_markdown FROM {PAGES}",
    "extract_all": f"SELECT page_id, url, content_text, content_html, content_markdown, title, sitename, hostname, language, page_type, confidence AS classification_confidence, extraction_quality, 0 AS n_images, NULL::VARCHAR AS comments_text, warnings FROM {PAGES}",
    "page_metadata": f"SELECT page_id, url, hostname, language, page_type, NULL::VARCHAR AS author, NULL::VARCHAR AS description, 0 AS n_tags FROM {PAGES}",
    "page_titles": f"SELECT page_id, title, sitename FROM {PAGES}",
    "extraction_quality": f"SELECT page_id, page_type, confidence AS classification_confidence, extraction_quality FROM {PAGES}",
    "bytes_pages": f"SELECT page_id, length(content_text) AS chars FROM {PAGES}",
    "page_features": f"SELECT page_id, {_tags('h[1-6]')} AS n_headings, {_tags('img')} AS n_images, {_tags('table')} AS n_tables, {_tags('nav')} AS n_navs, {_tags('ul|ol')} AS n_lists, least({_tags('article')}, 1) AS has_article FROM pages",
    "page_signals": f"SELECT page_id, false AS has_product_grid, 0::BIGINT AS code_block_count, len(regexp_extract_all(html, '<a ')) / greatest(len(ps), 1)::DOUBLE AS link_ratio, list_sum(list_transform(ps, lambda p: len(list_filter(regexp_split_to_array(regexp_replace(p, '<[^>]*(>|$)', '', 'g'), '\\s+'), lambda w: w <> ''))))::BIGINT AS paragraph_word_count, page_type FROM {PAGES}",
    "page_type_vote": f"SELECT page_id, CASE WHEN u <> 'article' AND u = m THEN u WHEN page_type <> 'article' AND page_type = m THEN page_type ELSE m END AS page_type, CASE WHEN u <> 'article' AND u = m THEN 1.0 WHEN page_type <> 'article' AND page_type = m THEN 0.95 ELSE page_id % 10 / 10.0 END::DOUBLE AS classification_confidence FROM (SELECT page_id, page_type, CASE WHEN page_id % 3 = 0 THEN 'forum' ELSE 'article' END AS u, ({_KINDS})[page_id % 3 + 1] AS m FROM {PAGES})",
    "type_score_rollup": f"SELECT page_type, pages, round(mean_score, 4) AS mean_score FROM (SELECT page_type, pages, mean_score FROM ({_MEAN}) UNION ALL SELECT 'all', sum(pages)::BIGINT, avg(mean_score) FROM ({_MEAN}))",
    "links_resolved": "SELECT page_id, href, regexp_extract(url, '^(https?://[^/?#]+)', 1) || href AS absolute_url, true AS valid FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM pages)",
}
