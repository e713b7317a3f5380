"""Queries over columns of metadata, type signals and filtered text (functions/metadata.py, signals.py, filtered.py), with their DuckDB SQL on the uniform pages table: no Python worker in any plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metadata as M
from ..functions import signals as S
from ..functions.filtered import with_filtered_text
from ..operators.stage import dealt
from .catalog import HOST, WORDS, pages
from .page_sql import _AS_TEXT, _FLOW, _NAMED, PAGES, _normal, _untagged


def _own(spark, d, *columns):
    return dealt(pages(spark, d).select("page_id", *columns))


def metadata_fields(spark, d):
    """Title, site, host and language of every page, by all that a page says of itself."""
    found = M.with_metadata(_own(spark, d, "url", "html"), url="url")
    return found.select("page_id", *(f"metadata.{k}" for k in ("title", "sitename", "hostname", "language", "url")))


def title_elements(spark, d):
    """The title element's longest part, its site and the first heading of fair length of every page."""
    return M.title_texts(_own(spark, d, "html")).select("page_id", "title_element", "title_part", "title_site", "heading")


def light_titles(spark, d):
    """Title and host of every page without a look at its body's rules."""
    return M.with_light_metadata(_own(spark, d, "url", "html"), url="url").select("page_id", "metadata.title", "metadata.hostname")


def host_sites(spark, d):
    """How pages of a host name their site: pages, with a site, distinct names."""
    own = M.with_metadata(_own(spark, d, "url", "html"), url="url").select("metadata.hostname", "metadata.sitename")
    return own.groupBy("hostname").agg(F.count("*").alias("pages"), F.count("sitename").alias("with_site"), F.count_distinct("sitename").alias("sites"))


def type_signals(spark, d):
    """Links a paragraph and words in paragraphs of every page, and the type that they and the URL give."""
    return S.with_signals(_own(spark, d, "url", "html"), url="url").select("page_id", "signals.link_ratio", "signals.paragraph_word_count", "page_type")


def filtered_text(spark, d):
    """The text that is kept of every page's body, without headings that repeat its title."""
    own = M.with_metadata(_own(spark, d, "url", "html"), url="url", keep_tree=True).withColumn("title", F.col("metadata.title"))
    return with_filtered_text(own, title="title", has_tree=True).select("page_id", "text")


QUERIES = {f.__name__: f for f in (metadata_fields, title_elements, light_titles, host_sites, type_signals, filtered_text)}

_LONG = lambda x: f"CASE WHEN strlen({x}) > 5 AND strlen({x}) < 200 THEN {x} END"
#: short paragraphs that are a byline
_BYLINE = "(strlen(t) < 50 AND lower(t[:3]) = 'by ' AND regexp_matches(t[4:], '^\\p{Lu}') AND NOT contains(t[4:], '. ') AND NOT contains(t[4:], ', the '))"
_KEPT = f"list_filter(ps, lambda p: NOT list_transform([{_AS_TEXT('p')}], lambda t: {_BYLINE})[1])"
ORACLES = {
    "metadata_fields": f"SELECT page_id, title, sitename, hostname, nullif(language, '') AS language, url FROM {PAGES}",
    "title_elements": f"SELECT page_id, nullif(raw, '') AS title_element, nullif(best, '') AS title_part, CASE WHEN len(sites) > 1 AND strlen(trim(sites[-1])) BETWEEN 3 AND 49 THEN trim(sites[-1]) END AS title_site, {_LONG('h1')} AS heading FROM {_NAMED}",
    "light_titles": f"SELECT page_id, coalesce(nullif(best, ''), {_LONG('h1')}) AS title, {HOST} AS hostname FROM {_NAMED}",
    "host_sites": f"SELECT hostname, count(*) AS pages, count(sitename) AS with_site, count(DISTINCT sitename) AS sites FROM {PAGES} GROUP BY hostname",
    "filtered_text": f"SELECT page_id, {_normal(f"(CASE WHEN same OR h1 = '' THEN '' ELSE h1 || ' ' END || {_FLOW})")} AS text FROM (SELECT * REPLACE ({_KEPT} AS ps) FROM {PAGES})",
    "type_signals": f"SELECT page_id, len(regexp_extract_all(html, '<a ')) / greatest(len(ps), 1)::DOUBLE AS link_ratio, coalesce(list_sum(list_transform(ps, lambda p: len({WORDS(_untagged('p'))}))), 0)::BIGINT AS paragraph_word_count, page_type FROM {PAGES}",
}
