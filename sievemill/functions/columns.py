"""Column expressions: all that needs no document tree. They run inside Catalyst, so filters and pruning reach the scan."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lists

SPACE = r"[\x{9}-\x{D} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


#: the characters of SPACE
SPACES = "".join(map(chr, (*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(x) -> Column:
    """White space of any kind off both ends, without a pattern that is tried at every blank."""
    return F.btrim(_c(x), F.lit(SPACES))


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _any(parts) -> Column:
    return reduce(lambda a, b: a | b, parts)


def contains_any(x: Column, words) -> Column:
    return x.rlike("|".join(re.escape(w) for w in words))


# ---------------------------------------------------------------- text
def clean_text(x) -> Column:
    """White space of any kind collapsed to one space, ends trimmed."""
    return F.trim(F.regexp_replace(_c(x), SPACE + "+", " "))


def normalize_text(x) -> Column:
    """Blanks collapsed, none at line edges or before . , ; : ! ?; at most one empty line in a row."""
    x = F.regexp_replace(F.replace(_c(x), F.lit("\r"), F.lit("")), "[ \t]+", " ")
    x = F.regexp_replace(F.regexp_replace(x, " ([.,;:!?])", "$1"), " ?\n ?", "\n")
    x = F.regexp_replace(x, "\n{3,}", "\n\n")
    return strip(x)


def escape_html(x) -> Column:
    x = _c(x)
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        x = F.replace(x, F.lit(raw), F.lit(entity))
    return x


def decode_entities(x) -> Column:
    x = _c(x)
    for entity, raw in lists.ENTITIES:
        x = F.replace(x, F.lit(entity), F.lit(raw))
    return x


def escape_markdown(x, in_code=False) -> Column:
    """Backslashes before what Markdown takes as markup; none where in_code (a boolean or a column) holds."""
    escaped = F.regexp_replace(_c(x), r"([\\*_\[\]<>])", r"\\$1")
    return F.when(F.lit(in_code) if isinstance(in_code, bool) else _c(in_code), _c(x)).otherwise(escaped)


def normalize_title(x) -> Column:
    return clean_text(F.lower(_c(x)))


def titles_match(a, b) -> Column:
    """Equal up to case and space, or one is the other with a site suffix. Both are normalised once, as they are looked at many times."""
    separators = (" - ", " | ", " – ", " — ", ": ")

    def cut(x: Column, y: Column) -> Column:
        heads = [(x.contains(s)) & (F.substring_index(x, s, 1) == y) for s in separators]
        tails = [x.startswith(F.concat(y, F.lit(s))) & (F.octet_length(x) > F.octet_length(y) + 3) for s in separators]
        return _any([*heads, *tails])

    def match(x: Column) -> Column:
        a, b = x["a"], x["b"]
        return F.when((a == "") | (b == ""), F.lit(False)).otherwise((a == b) | cut(a, b) | cut(b, a))

    both = F.struct(normalize_title(a).alias("a"), normalize_title(b).alias("b"))
    return F.element_at(F.transform(F.array(both), match), 1)


def words(x) -> Column:
    return F.filter(F.split(_c(x), SPACE + "+"), lambda w: w != "")


def count_words(x, least_bytes: int = 2) -> Column:
    return F.size(F.filter(words(x), lambda w: F.octet_length(w) >= least_bytes)).cast("long")


def count_sentences(x) -> Column:
    return F.regexp_count(_c(x), F.lit("[.!?]+")).cast("long")


def is_share_text(x) -> Column:
    """Texts of share buttons, photo credits, newsletter boxes and bylines."""
    t = strip(x)
    t_bytes = F.octet_length(t)
    s = F.regexp_replace(t, r"^[^\p{L}\p{N}_]+", "")
    low = F.lower(s)
    starts = lambda ws: _any(low.startswith(w) for w in ws)
    return (
        s.rlike(f"^({'|'.join(lists.SHARE_NAMES)})($|[^\\p{{L}}\\p{{N}}])")
        | starts(lists.SHARE_STARTS)
        | low.isin(*lists.SHARE_WHOLE)
        | (low.contains("subscribe") & low.contains("newsletter"))
        | ((t_bytes < 120) & (starts(lists.PHOTO_STARTS) | contains_any(low, lists.PHOTO_AGENCIES)))
        | ((t_bytes < 80) & (starts(lists.NEWS_STARTS) | starts(lists.DATE_STARTS)))
        | ((t_bytes < 50) & low.startswith("by ") & F.substring(t, 4, 9999).rlike(r"^\p{Lu}") & ~F.substring(t, 4, 9999).contains(". ") & ~F.substring(t, 4, 9999).contains(", the "))
    )


# ---------------------------------------------------------------- metadata values
def normalize_language(x) -> Column:
    return F.lower(F.split_part(F.split_part(clean_text(x), F.lit("-"), F.lit(1)), F.lit("_"), F.lit(1)))


def meta_language(x) -> Column:
    return F.lower(F.split_part(_c(x), F.lit("_"), F.lit(1)))


def normalize_license(x) -> Column:
    t = clean_text(x)
    kind, version = (F.regexp_extract(F.lower(t), r"creativecommons\.org/licenses/([a-z-]+)/([0-9.]+)", i) for i in (1, 2))
    return F.when(F.lower(t).contains("creativecommons.org/publicdomain/zero") | (F.upper(t) == "CC0"), F.lit("CC0 1.0")).when(kind != "", F.concat(F.lit("CC "), F.upper(F.replace(kind, F.lit("-"), F.lit(" "))), F.lit(" "), version)).otherwise(t)


def tag_list(x, separators: str = "[,;]") -> Column:
    return F.filter(F.transform(F.split(_c(x), separators), lambda t: clean_text(t)), lambda t: t != "")


def is_name(x) -> Column:
    """Whether a meta value can be a person's name."""
    t = strip(x)
    n = F.octet_length(t)
    return (
        n.between(2, 120)
        & ~((n > 20) & ~t.contains(" "))
        & ~_any(t.startswith(w) for w in ("http://", "https://", "www.", "{", "["))
        & ~contains_any(t, (".com", ".org", ".net"))
        & (F.regexp_count(t, F.lit("[0-9]")) <= 3)
        & (F.regexp_count(t, F.lit(r"[^\p{L}\p{N}\s\-'.]")) <= 2)
    )


def normalize_author(x) -> Column:
    x = F.regexp_replace(clean_text(x), r"^(Written by |By |by )", "")
    x = F.regexp_replace(x, r"[\w.+-]+@[\w-]+\.[\w.-]+", "")
    x = F.regexp_replace(F.regexp_replace(x, r"@\w+", ""), r"(?i)\s*and \d+ more.*$", "")
    x = clean_text(x)
    return F.when(F.octet_length(x) >= 2, x)


DATE_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy", "MM/dd/yyyy", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy")


def parse_date(x) -> Column:
    """RFC 3339 first, then the fixed formats in order (day-first before month-first)."""
    t = clean_text(x)
    zoned = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"), F.try_to_timestamp(t))
    shape = {"yyyy-MM-dd'T'HH:mm:ss": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$", "yyyy-MM-dd": r"^\d{4}-\d{2}-\d{2}$", "yyyy/MM/dd": r"^\d{4}/\d{2}/\d{2}$", "dd/MM/yyyy": r"^\d{2}/\d{2}/\d{4}$", "MM/dd/yyyy": r"^\d{2}/\d{2}/\d{4}$", "MMMM d, yyyy": r"^[A-Z][a-z]+ \d{1,2}, \d{4}$", "MMM d, yyyy": r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$", "d MMMM yyyy": r"^\d{1,2} [A-Z][a-z]+ \d{4}$"}
    return F.coalesce(zoned, *(F.when(t.rlike(shape[f]), F.try_to_timestamp(t, F.lit(f))) for f in DATE_FORMATS))


# ---------------------------------------------------------------- URLs
HOST = r"^https?://(?:[^/?#@]*@)?([^/?#:@]+)"


def is_absolute_url(x) -> Column:
    return F.coalesce(F.trim(_c(x)).rlike(HOST), F.lit(False))


def hostname(x) -> Column:
    return F.nullif(F.lower(F.regexp_extract(F.trim(_c(x)), HOST, 1)), F.lit(""))


def base_url(x) -> Column:
    return F.concat(F.regexp_extract(F.trim(_c(x)), "^(https?)://", 1), F.lit("://"), hostname(x))


def normalize_url(x) -> Column:
    """No fragment, and no slash at the end of a path longer than one."""
    x = _c(x)
    plain = F.regexp_replace(x, "#.*$", "")
    return F.when(is_absolute_url(x), F.regexp_replace(plain, r"^(https?://[^/?]+/[^?]*[^/?])/(\?.*)?$", "$1$2")).otherwise(x)


_REFERENCE = r"^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def resolve_url(x, base) -> Column:
    """A link of a page as an absolute URL, by the rules for relative references: dot segments go, an empty query or fragment too. Links with a scheme of their own stay, and all do where the base is null or has no host; a null link stays null."""

    def joined(v: Column) -> Column:
        part = lambda of, k: F.regexp_extract(v[of], _REFERENCE, k)
        path, own = part("x", 3), F.split(part("x", 3), "/")
        before = F.split(part("base", 3), "/")
        before = F.when(F.element_at(before, -1) != "", F.slice(before, F.lit(1), F.size(before) - 1)).otherwise(before)
        merged = F.concat(F.when(F.size(before) > 0, before).otherwise(F.array(F.lit(""))), own)
        merged = F.filter(merged, lambda s, k: (s != "") | (k == 0) | (k == F.size(merged) - 1))
        segments = F.when(path.startswith("/"), own).otherwise(merged)
        last = F.when(F.element_at(segments, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        step = lambda o, s: F.when(s == "..", F.slice(o, F.lit(1), F.greatest(F.size(o) - 1, F.lit(0)))).when(s == ".", o).otherwise(F.array_append(o, s))
        way = F.array_join(F.concat(F.aggregate(segments, F.array().cast("array<string>"), step), last), "/")
        way = F.when(way.startswith("/"), way).otherwise(F.concat(F.lit("/"), way))
        query = F.when((path == "") & (part("x", 4) == ""), part("base", 4)).otherwise(part("x", 4))
        tail = F.concat(F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")), F.when(part("x", 5) != "", F.concat(F.lit("#"), part("x", 5))).otherwise(F.lit("")))
        root = F.concat(F.lower(part("base", 1)), F.lit("://"), part("base", 2))
        return (
            F.when((v["x"] == "") | (part("x", 1) != "") | v["base"].isNull() | ~v["base"].rlike(HOST), v["x"])
            .when(v["x"].startswith("//"), F.concat(F.lower(part("base", 1)), F.lit(":"), v["x"]))
            .otherwise(F.concat(root, F.when(path == "", part("base", 3)).otherwise(way), tail))
        )

    return F.element_at(F.transform(F.array(F.struct(strip(x).alias("x"), F.trim(_c(base)).alias("base"))), joined), 1)


def urls_match(a, b) -> Column:
    """Whether two URLs point to the same page, whatever their fragments."""
    return normalize_url(a) == normalize_url(b)


def filename(x) -> Column:
    name = F.element_at(F.split(F.split_part(F.split_part(F.trim(_c(x)), F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1)), "/"), -1)
    return F.when(name.isin(".", ".."), F.lit("")).otherwise(name)


def filenames_match(a, b) -> Column:
    a, b = F.lower(filename(a)), F.lower(filename(b))
    return (a != "") & (a == b)


def domain_of(x) -> Column:
    return F.split_part(F.regexp_replace(_c(x), "^https?://", ""), F.lit("/"), F.lit(1))


def path_of(x) -> Column:
    rest = F.regexp_replace(_c(x), "^https?://", "")
    return F.when(rest.contains("/"), F.substring(rest, F.instr(rest, "/"), F.length(rest))).otherwise(F.lit("/"))


def url_page_type(x) -> Column:
    url = F.lower(F.coalesce(_c(x), F.lit("")))
    domain, path = domain_of(url), path_of(url)
    trimmed = F.regexp_replace(path, "/+$", "")
    return (
        F.when(url == "", F.lit("article"))
        .when(contains_any(domain, lists.FORUM_DOMAINS) | contains_any(path, lists.FORUM_PATHS) | contains_any(url, lists.FORUM_URLS), F.lit("forum"))
        .when(contains_any(domain, lists.DOCS_DOMAINS) | contains_any(path, lists.DOCS_PATHS), F.lit("documentation"))
        .when(contains_any(path, lists.PRODUCT_PATHS) | contains_any(domain, lists.PRODUCT_DOMAINS), F.lit("product"))
        .when(contains_any(path, lists.CATEGORY_PATHS), F.lit("collection"))
        .when(contains_any(path, lists.SERVICE_PATHS) | contains_any(url, lists.SERVICE_SLUGS), F.lit("service"))
        .when(trimmed.rlike(f"({'|'.join(lists.LISTING_ENDINGS)})$") | contains_any(path, lists.LISTING_PATHS), F.lit("listing"))
        .otherwise(F.lit("article"))
    )


# ---------------------------------------------------------------- pages
def declared_charset(html) -> Column:
    """The charset label in the first 1024 characters, lower case; null without one."""
    head = F.substring(_c(html), 1, 1024)
    return F.nullif(F.lower(F.regexp_extract(head, r"""(?i)<meta[^>]+charset\s*=\s*["']?([^"'\s>]+)""", 1)), F.lit(""))


#: labels of encodings besides those that follow a pattern
ENCODINGS = ("utf-8", "utf8", "unicode-1-1-utf-8", "us-ascii", "ascii", "latin1", "latin-1", "l1", "koi8-r", "koi8-u", "macintosh", "x-mac-cyrillic", "gbk", "gb2312", "gb18030", "big5", "big5-hkscs", "euc-jp", "euc-kr", "iso-2022-jp", "shift_jis", "shift-jis", "sjis", "ks_c_5601-1987", "tis-620", "utf-16", "utf-16le", "utf-16be", "ibm866", "cp866")
_ENCODING = r"^(?:iso-?8859-(?:[1-9]|1[0-6])|(?:windows|cp)-?(?:125[0-8]|874|932|936|949|950)|(?:x-)?(?:cp125[0-8]))$"
_META_CHARSET = r"""(?i)<meta[^>]+charset\s*=\s*["']?([^"'\s>]+)"""
_CONTENT_TYPE = r"""(?i)<meta[^>]+http-equiv\s*=\s*["']?content-type["']?[^>]+content\s*=\s*["']?[^"'>]*;\s*charset\s*=\s*([^"'\s>]+)"""


def declared_encoding(html) -> Column:
    """The label of the encoding that a page declares in its first 1024 characters: by a charset or, if nobody knows that label, by its content type; utf-8 otherwise. Null pages give null."""
    head = F.substring(_c(html), 1, 1024)
    labels = [F.lower(F.regexp_extract(head, pattern, 1)) for pattern in (_META_CHARSET, _CONTENT_TYPE)]
    known = [F.when(x.isin(*ENCODINGS) | x.rlike(_ENCODING), x) for x in labels]
    return F.when(_c(html).isNotNull(), F.coalesce(*known, F.lit("utf-8")))


def html_lang(html) -> Column:
    return F.nullif(F.lower(F.split_part(F.regexp_extract(_c(html), r"""(?i)<html[^>]*\slang\s*=\s*["']?([^"'\s>]+)""", 1), F.lit("-"), F.lit(1))), F.lit(""))


def raw_title(html) -> Column:
    return F.nullif(clean_text(decode_entities(F.regexp_extract(_c(html), r"(?is)<title[^>]*>(.*?)</title>", 1))), F.lit(""))


def text_chars_test(x) -> Column:
    """Whether there is a letter or a digit."""
    return F.coalesce(_c(x).rlike(r"[\p{L}\p{N}]"), F.lit(False))


IMAGE_ENDINGS = ("jpg", "jpeg", "png", "gif", "webp", "svg", "bmp", "ico", "tiff", "tif", "avif")


def is_image_file(x) -> Column:
    """Whether a URL ends like the name of an image, before any query."""
    return F.lower(F.element_at(F.split(F.split_part(_c(x), F.lit("?"), F.lit(1)), r"\."), -1)).isin(*IMAGE_ENDINGS)


# ---------------------------------------------------------------- scores
def quality(text, html_content, html_bytes, page_type) -> Column:
    """The heuristic extraction quality in 0..1. html_content: the extracted HTML, or null."""
    text, html, kind = _c(text), _c(html_content), _c(page_type)
    n = F.octet_length(text)
    ratio = n / F.nullif(_c(html_bytes), F.lit(0)).cast("double")
    low = reduce(lambda a, k: a.when(kind == k, F.lit(lists.EXPECTED_LENGTH[k][0])), lists.PAGE_TYPES[1:], F.when(kind == "article", F.lit(1500)))
    middle = reduce(lambda a, k: a.when(kind == k, F.lit(lists.EXPECTED_LENGTH[k][1])), lists.PAGE_TYPES[1:], F.when(kind == "article", F.lit(5000)))
    d = lambda x: F.lit(float(x))
    s1 = F.when(ratio < 0.005, d(-0.30)).when(ratio < 0.01, d(-0.20)).when(ratio < 0.02, d(-0.10)).otherwise(d(0))
    s2 = F.when(ratio > 0.30, d(-0.10)).otherwise(d(0))
    s3 = F.when(n < 100, d(-0.30)).when(n < F.floor(low / 2), d(-0.20)).when(n < low, d(-0.10)).otherwise(d(0))
    s4 = F.when((n >= low) & (n <= middle * 3), d(0.05)).otherwise(d(0))
    paragraphs = F.regexp_count(html, F.lit("<p[> ]"))
    s5 = F.when(html.isNotNull() & (paragraphs == 0) & (n > 200), d(-0.20)).when(html.isNull() & (n > 200), d(-0.05)).otherwise(d(0))
    links = F.aggregate(F.regexp_extract_all(html, F.lit("(?s)<a [^>]*>(.*?)</a>"), 1), F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x))
    share = F.when(html.isNotNull() & (n > 0), links / n.cast("double")).otherwise(d(0))
    s6 = F.when(share > 0.5, d(-0.25)).when(share > 0.3, d(-0.10)).otherwise(d(0))
    head = F.lower(F.substring(text, 1, 200))
    hits = reduce(lambda a, b: a + b, (F.when(head.contains(w), 1).otherwise(0) for w in lists.QUALITY_WORDS))
    s7 = F.when(hits >= 2, d(-0.25)).when(hits == 1, d(-0.10)).otherwise(d(0))
    return F.least(F.greatest(((((((d(1.0) + s1) + s2) + s3) + s4) + s5) + s6) + s7, d(0)), d(1))


def fscore(extracted, expected) -> Column:
    """Struct of precision, recall and fscore over lower-cased word sets."""
    a, b = (F.array_distinct(words(F.lower(_c(x)))) for x in (extracted, expected))
    both = F.size(F.array_intersect(a, b)).cast("double")
    p, r = both / F.size(a), both / F.size(b)
    zero, one = F.lit(0.0), F.lit(1.0)
    empty = (F.size(a) == 0) & (F.size(b) == 0)
    half = (F.size(a) == 0) | (F.size(b) == 0)
    return F.struct(
        F.when(empty, one).when(half, zero).otherwise(p).alias("precision"),
        F.when(empty, one).when(half, zero).otherwise(r).alias("recall"),
        F.when(empty, one).when(half | (both == 0), zero).otherwise(2 * p * r / (p + r)).alias("fscore"),
    )


def validation_warnings(text, n_words, least_words: int = 50, least_bytes: int = 200, most_bytes: int = 1_000_000) -> Column:
    n = F.octet_length(_c(text))
    short = F.when((_c(n_words) < least_words) | (n < least_bytes), F.concat(F.lit("Insufficient content after extraction: "), _c(n_words).cast("string"), F.lit(f" words (min: {least_words}), "), n.cast("string"), F.lit(f" chars (min: {least_bytes})")))
    long = F.when(n > most_bytes, F.lit(f"Content truncated to max length: {most_bytes}"))
    return F.array_compact(F.array(short, long))
