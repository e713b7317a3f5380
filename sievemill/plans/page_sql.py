"""DuckDB SQL for what extraction gives on the pages table.

The pages are uniform (see FIXTURES.md): one article with a heading and paragraphs, of
which some are opened by bold text that nothing closes, between a list of links, an
advertisement and a footer; about one in ten is cut off. On such pages the rules of
extraction come down to text functions, written here independently of the engine.
"""

from __future__ import annotations

from ..functions import lists
from .catalog import HOST, STRIP, TYPED, WORDS, WS, _clean

_BREAK = r"\s*[|–—·]\s*|\s+-\s+|\s*:\s+"
_SITE = r"\s*[|–—]\s*|\s+-\s+"
_SUFFIX = (" | ", " • ", " » ", " - ", " – ", " — ")


def _decoded(x: str) -> str:
    x = f"regexp_replace({x}, '&amp$', '&')"  # a title that was cut
    for entity, raw in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{raw}')"
    return x


def _normal(x: str) -> str:
    x = f"regexp_replace(replace({x}, chr(13), ''), '[ \\t]+', ' ', 'g')"
    x = f"regexp_replace(regexp_replace({x}, ' ([.,;:!?])', '\\1', 'g'), ' ?\\n ?', chr(10), 'g')"
    return STRIP(f"regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


def _untagged(x: str, between: str = "''") -> str:
    return _decoded(f"regexp_replace({x}, '<[^>]*(>|$)', {between}, 'g')")


def _split_title() -> str:
    """Every way to cut t at a separator, in order: head and tail."""
    each = [f"list_transform(range(1, len(string_split(t, '{s}'))), lambda k: {{'head': trim(array_to_string(string_split(t, '{s}')[1:k], '{s}')), 'tail': trim(array_to_string(string_split(t, '{s}')[k + 1:], '{s}'))}})" for s in _SUFFIX]
    return f"flatten([{', '.join(each)}])"


def _lines(low: str, mid: str) -> str:
    return f"CASE page_type {' '.join(f'WHEN {k!r} THEN {v[0]}' for k, v in lists.EXPECTED_LENGTH.items())} END AS {low}, CASE page_type {' '.join(f'WHEN {k!r} THEN {v[1]}' for k, v in lists.EXPECTED_LENGTH.items())} END AS {mid}"


_head_words = " + ".join(f"contains(lower(substring(content_text, 1, 200)), '{w}')::INT" for w in lists.QUALITY_WORDS)

#: parts of the source
_PARTS = rf"""(SELECT *, regexp_extract(html, '(?s)<article>(.*?)(</article>|$)', 1) AS art, trim({_decoded("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")}) AS raw,
 regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) AS nav, regexp_extract(html, '(?s)<div class="ad">(.*?)</div>', 1) AS ad FROM {TYPED})"""
_HEADED = f"""(SELECT *, {_clean(_untagged("regexp_extract(art, '(?s)^<h1>(.*?)(</h1>|$)', 1)"))} AS h1, regexp_split_to_array(raw, '{_BREAK}') AS cuts, regexp_split_to_array(raw, '{_SITE}') AS sites,
 string_split(regexp_replace(art, '(?s)^<h1>.*?(</h1>|$)', ''), '<p>')[2:] AS ps, trim(regexp_replace({_untagged('nav', "' '")}, ' +', ' ', 'g')) AS menu FROM {_PARTS})"""
_TITLED = f"""(SELECT *, CASE WHEN len(sites) > 1 AND strlen(trim(sites[-1])) BETWEEN 3 AND 49 THEN trim(sites[-1]) WHEN menu <> '' AND strlen(menu) < 100 THEN menu END AS sitename,
 CASE WHEN strlen(h1) > 5 AND strlen(h1) < 200 AND contains(lower(best), lower(h1)) THEN h1 WHEN best <> '' THEN best WHEN strlen(h1) > 5 AND strlen(h1) < 200 THEN h1 END AS t
 FROM (SELECT *, CASE WHEN len(cuts) > 1 AND strlen(longest) > 10 THEN longest ELSE raw END AS best
 FROM (SELECT *, trim(list_reverse(list_sort(list_transform(range(1, len(cuts) + 1), lambda k: {{'n': strlen(cuts[k]), 'k': k, 'x': cuts[k]}})))[1].x) AS longest FROM {_HEADED})))"""
_NAMED = f"""(SELECT *, coalesce(list_filter(list_transform({_split_title()}, lambda c: CASE WHEN sitename IS NOT NULL AND starts_with(lower(c.tail), lower(sitename)) AND c.head <> '' THEN c.head WHEN sitename IS NOT NULL AND lower(c.head) = lower(sitename) AND c.tail <> '' THEN c.tail
 WHEN len({WORDS('c.tail')}) <= 5 AND strlen(c.tail) < 35 AND strlen(c.head) > 10 THEN c.head WHEN len({WORDS('c.head')}) <= 2 AND strlen(c.head) < 20 AND strlen(c.tail) > strlen(c.head) THEN c.tail END), lambda x: x IS NOT NULL)[1], t) AS title FROM {_TITLED})"""
#: the page's type: by its URL, else a list where links outnumber short paragraphs
_KIND = f"""(SELECT * EXCLUDE (page_type), CASE WHEN page_type <> 'article' THEN page_type WHEN len(regexp_extract_all(html, '<a ')) / greatest(len(ps), 1)::DOUBLE >= 3 AND len({WORDS(_untagged("array_to_string(ps, ' ')", "' '"))}) < 30 THEN 'listing' ELSE 'article' END AS page_type,
 CASE WHEN page_type <> 'article' THEN 1.0 WHEN len(regexp_extract_all(html, '<a ')) / greatest(len(ps), 1)::DOUBLE >= 3 AND len({WORDS(_untagged("array_to_string(ps, ' ')", "' '"))}) < 30 THEN 0.95 ELSE 0.5 END::DOUBLE AS confidence,
 (lower(h1) = lower(title) OR {" OR ".join(f"split_part(lower({a}), '{s}', 1) = lower({b}) AND contains(lower({a}), '{s}') OR (starts_with(lower({a}), lower({b}) || '{s}') AND strlen({a}) > strlen({b}) + 3)" for a, b in (("h1", "title"), ("title", "h1")) for s in (" - ", " | ", " – ", " — ", ": "))}) AS same FROM {_NAMED})"""
_BOLD = lambda x: f"len(regexp_extract_all({x}, '<b>'))::INT"
#: bold elements that paragraph k takes over (three at most), and those it opens
_OVER = f"least({_BOLD("array_to_string(ps[1:k - 1], '')")}, 3)"
_OWN = _BOLD("ps[k]")
_BARE = lambda x: f"regexp_replace(regexp_replace({x}, '(?s)</(p|h1)>.*$', ''), '<[^>]*$', '')"
_AS_HTML = lambda x: f"replace(replace(replace(replace(regexp_replace({x}, '&(amp)?([a-z]*)$', '&amp;\\2'), '\"', '&quot;'), chr(39), '&#39;'), '&copy;', '©'), '&middot;', '·')"
_AS_TEXT = lambda x: _clean(_untagged(x, "' '"))
_AS_MARKDOWN = lambda x: f"regexp_replace({x}, '([\\\\*_\\[\\]<>])', '\\\\\\1', 'g')"
_HEADING = "regexp_extract(art, '(?s)^<h1>(.*?)(</h1>|$)', 1)"
_P = f"'<p>' || repeat('<b>', {_OVER}) || {_AS_HTML(_BARE('ps[k]'))} || repeat('</b>', {_OVER} + {_OWN}) || '</p>'"
_M = f"repeat('**', {_OVER} + {_OWN}) || {_AS_MARKDOWN(_AS_TEXT('ps[k]'))} || repeat('**', {_OVER} + {_OWN})"
_EACH = "list_transform(range(1, len(ps) + 1), lambda k: {})".format
_FLOW = _untagged("replace(array_to_string(list_transform(ps, lambda p: chr(10) || chr(10) || p), ''), '<br>', chr(10))", "' '")
_TEXT = f"""(SELECT *, {_normal(f"(CASE WHEN same OR h1 = '' THEN '' ELSE h1 || ' ' END || {_FLOW})")} AS plain,
 CASE WHEN h1 = '' THEN '' ELSE '<h1>' || {_AS_HTML(_HEADING)} || '</h1>' END || array_to_string({_EACH(_P)}, '') AS markup,
 array_to_string(list_concat(CASE WHEN h1 = '' THEN [] ELSE ['# ' || {_AS_MARKDOWN('h1')}] END, list_filter({_EACH(f"CASE WHEN {_AS_TEXT('ps[k]')} = '' THEN '' ELSE {_M} END")}, lambda x: x <> '')), chr(10) || chr(10)) AS marked,
 {_AS_TEXT("h1 || ' ' || array_to_string(ps, ' ')")} AS spaced, {_clean(_untagged('art'))} AS joined, {_AS_TEXT("ad || ' ' || art")} AS whole,
 array_to_string(list_filter(list_transform(ps, lambda p: {_AS_TEXT('p')}), lambda p: p <> ''), chr(10)) AS lines FROM {_KIND})"""
_WORDS = lambda x: f"len(list_filter({WORDS(x)}, lambda w: strlen(w) >= 2))"
#: short texts: the whole content with its heading if that is twice as long, else the article, its lines or the page as they are
_SHORT = f"""(SELECT *, CASE WHEN (length(plain) < 200 OR {_WORDS('plain')} < 50) AND length(spaced) >= 200 AND length(spaced) > 2 * length(plain) THEN 'spaced' WHEN length(plain) < 200 THEN 'base' ELSE 'plain' END AS way,
 CASE WHEN length(joined) > 100 THEN joined WHEN length(lines) > 100 THEN lines ELSE whole END AS base FROM {_TEXT})"""
_BASE_LINES = "list_filter(string_split(base, chr(10)), lambda x: x <> '')"
_ESCAPED = "replace(replace(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#39;')"
_CHOSEN = f"""(SELECT *, CASE way WHEN 'plain' THEN plain WHEN 'spaced' THEN spaced ELSE base END AS content_text,
 CASE way WHEN 'plain' THEN markup WHEN 'spaced' THEN '<body>' || markup || '</body>' ELSE '<body>' || array_to_string(list_transform({_BASE_LINES}, lambda x: '<p>' || {_ESCAPED} || '</p>'), '') || '</body>' END AS content_html,
 CASE WHEN way = 'base' THEN array_to_string(list_transform({_BASE_LINES}, lambda x: {_AS_MARKDOWN('x')}), chr(10) || chr(10)) ELSE marked END AS content_markdown FROM {_SHORT})"""
_SCORED = f"(SELECT *, strlen(content_text) AS n, strlen(content_text) / strlen(html)::DOUBLE AS r, {_lines('lo', 'mid')}, {_head_words} AS hits FROM {_CHOSEN})"
_NUMBER = lambda x: f"({x})::DOUBLE"
_SUM = " + ".join(
    [
        "1.0::DOUBLE",
        _NUMBER("CASE WHEN r < 0.005 THEN -0.30 WHEN r < 0.01 THEN -0.20 WHEN r < 0.02 THEN -0.10 ELSE 0 END"),
        _NUMBER("CASE WHEN r > 0.30 THEN -0.10 ELSE 0 END"),
        _NUMBER("CASE WHEN n < 100 THEN -0.30 WHEN n < lo // 2 THEN -0.20 WHEN n < lo THEN -0.10 ELSE 0 END"),
        _NUMBER("CASE WHEN n >= lo AND n <= mid * 3 THEN 0.05 ELSE 0 END"),
        _NUMBER("CASE WHEN n > 200 AND NOT regexp_matches(content_html, '<p[> ]') THEN -0.20 ELSE 0 END"),
        _NUMBER("CASE WHEN hits >= 2 THEN -0.25 WHEN hits = 1 THEN -0.10 ELSE 0 END"),
    ]
)
_SAID = f"""[CASE WHEN way <> 'plain' THEN 'Used fallback extraction: ' || length(content_text) || ' chars (was ' || length(plain) || ' chars)' ELSE '' END,
 CASE WHEN {_WORDS('content_text')} < 50 OR n < 200 THEN 'Insufficient content after extraction: ' || {_WORDS('content_text')} || ' words (min: 50), ' || n || ' chars (min: 200)' ELSE '' END]"""
#: page_id, content_text, content_html, content_markdown, title, sitename, hostname, language, page_type, confidence, extraction_quality, warnings of every page
PAGES = f"""(SELECT *, least(greatest({_SUM}, 0), 1) AS extraction_quality, array_to_string(list_filter({_SAID}, lambda x: x <> ''), '|') AS warnings,
 {HOST} AS hostname, split_part(regexp_extract(html, '<html lang="([^"]*)"', 1), '-', 1) AS language FROM {_SCORED})"""
