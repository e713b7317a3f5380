"""Column-expression queries over the tables, by name, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as c
from ..functions import lists

WS = c.SPACE
_SQL: dict[str, str] = {}
_RUN: dict = {}


def query(sql: str | None):
    def keep(f):
        _RUN[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


#: functions of values that no table holds: rows of literals, for tests only
CASES: dict = {}
CASE_SQL: dict[str, str] = {}


def case(sql: str):
    def keep(f):
        CASES[f.__name__], CASE_SQL[f.__name__] = f, sql
        return f

    return keep


def pages(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/pages.parquet")


def docs(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def _has(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def _clean(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def _replace(x: str, pairs) -> str:
    for a, b in pairs:
        a, b = a.replace("'", "''"), b.replace("'", "''")
        x = f"replace({x}, '{a}', '{b}')"
    return x


DOMAIN = "split_part(regexp_replace(lower(url), '^https?://', ''), '/', 1)"
REST = "regexp_replace(lower(url), '^https?://', '')"
PATH = f"CASE WHEN contains({REST}, '/') THEN substring({REST}, instr({REST}, '/')) ELSE '/' END"
TYPE = f"""CASE WHEN {_has('dom', lists.FORUM_DOMAINS)} OR {_has('pth', lists.FORUM_PATHS)} OR {_has('low', lists.FORUM_URLS)} THEN 'forum'
WHEN {_has('dom', lists.DOCS_DOMAINS)} OR {_has('pth', lists.DOCS_PATHS)} THEN 'documentation'
WHEN {_has('pth', lists.PRODUCT_PATHS)} OR {_has('dom', lists.PRODUCT_DOMAINS)} THEN 'product'
WHEN {_has('pth', lists.CATEGORY_PATHS)} THEN 'collection'
WHEN {_has('pth', lists.SERVICE_PATHS)} OR {_has('low', lists.SERVICE_SLUGS)} THEN 'service'
WHEN {' OR '.join(f"suffix(rtrim(pth, '/'), '{w}')" for w in lists.LISTING_ENDINGS)} OR {_has('pth', lists.LISTING_PATHS)} THEN 'listing'
ELSE 'article' END"""
TYPED = f"(SELECT *, {TYPE} AS page_type FROM (SELECT *, lower(url) AS low, {DOMAIN} AS dom, {PATH} AS pth FROM pages))"
HOST = f"nullif(lower(regexp_extract(trim(url), '{c.HOST}', 1)), '')"
WORDS = lambda x: f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda w: w <> '')"
STRIP = lambda x: f"regexp_replace(regexp_replace({x}, '^{WS}+', ''), '{WS}+$', '')"


@query(f"SELECT page_id, page_type FROM {TYPED}")
def url_page_type(spark, d):
    return pages(spark, d).select("page_id", c.url_page_type("url").alias("page_type"))


@query(f"SELECT page_id, {HOST} AS host, regexp_extract(trim(url), '^(https?)://', 1) || '://' || {HOST} AS base FROM pages")
def page_hostname(spark, d):
    return pages(spark, d).select("page_id", c.hostname("url").alias("host"), c.base_url("url").alias("base"))


@query("SELECT page_id, CASE WHEN n IN ('.', '..') THEN '' ELSE n END AS name FROM (SELECT page_id, split_part(split_part(split_part(trim(url), '?', 1), '#', 1), '/', -1) AS n FROM pages)")
def url_filename(spark, d):
    return pages(spark, d).select("page_id", c.filename("url").alias("name"))


@query(f"SELECT page_id, CASE WHEN regexp_matches(trim(url), '{c.HOST}') THEN regexp_replace(regexp_replace(url, '#.*$', ''), '^(https?://[^/?]+/[^?]*[^/?])/(\\?.*)?$', '\\1\\2') ELSE url END AS url FROM pages")
def url_normalized(spark, d):
    return pages(spark, d).select("page_id", c.normalize_url("url").alias("url"))


@query(f"SELECT page_id, {DOMAIN} AS domain, {PATH} AS path FROM pages")
def domain_path_split(spark, d):
    low = F.lower("url")
    return pages(spark, d).select("page_id", c.domain_of(low).alias("domain"), c.path_of(low).alias("path"))


@query("SELECT page_id, nullif(lower(regexp_extract(substring(html, 1, 1024), '(?i)<meta[^>]+charset\\s*=\\s*[\"'']?([^\"''\\s>]+)', 1)), '') AS charset FROM pages")
def declared_charset(spark, d):
    return pages(spark, d).select("page_id", c.declared_charset("html").alias("charset"))


@query("SELECT page_id, nullif(lower(split_part(regexp_extract(html, '(?i)<html[^>]*\\slang\\s*=\\s*[\"'']?([^\"''\\s>]+)', 1), '-', 1)), '') AS lang FROM pages")
def html_lang(spark, d):
    return pages(spark, d).select("page_id", c.html_lang("html").alias("lang"))


@query(f"SELECT page_id, nullif({_clean(_replace('''regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)''', lists.ENTITIES))}, '') AS title FROM pages")
def title_regex_cleaned(spark, d):
    return pages(spark, d).select("page_id", c.raw_title("html").alias("title"))


@query(f"SELECT page_id, {_replace('html', lists.ENTITIES)} AS html FROM pages")
def decode_entities_pages(spark, d):
    return pages(spark, d).select("page_id", c.decode_entities("html").alias("html"))


@query(f"SELECT page_id, {_replace('html', (('&', '&amp;'), ('<', '&lt;'), ('>', '&gt;'), ('\"', '&quot;'), (chr(39), '&#39;')))} AS html FROM pages")
def escape_html_pages(spark, d):
    return pages(spark, d).select("page_id", c.escape_html("html").alias("html"))


@query("SELECT doc_id, regexp_replace(text, '([\\\\*_\\[\\]<>])', '\\\\\\1', 'g') AS text FROM documents")
def escape_markdown_documents(spark, d):
    return docs(spark, d).select("doc_id", c.escape_markdown("text").alias("text"))


@query(f"SELECT doc_id, {_clean('text')} AS text FROM documents")
def clean_text_documents(spark, d):
    return docs(spark, d).select("doc_id", c.clean_text("text").alias("text"))


@query(f"SELECT doc_id, {STRIP('''regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(13), ''), '[ \\t]+', ' ', 'g'), ' ([.,;:!?])', '\\1', 'g'), ' ?\\n ?', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g')''')} AS text FROM documents")
def normalize_text_documents(spark, d):
    return docs(spark, d).select("doc_id", c.normalize_text("text").alias("text"))


@query(f"SELECT doc_id, len(list_filter({WORDS('text')}, lambda w: strlen(w) >= 2)) AS n2, len(list_filter({WORDS('text')}, lambda w: strlen(w) >= 5)) AS n5 FROM documents")
def word_counts_min_len(spark, d):
    return docs(spark, d).select("doc_id", c.count_words("text").alias("n2"), c.count_words("text", 5).alias("n5"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[.!?]+')) AS sentences FROM documents")
def sentence_counts(spark, d):
    return docs(spark, d).select("doc_id", c.count_sentences("text").alias("sentences"))


_S = f"(SELECT doc_id, n_line, t, strlen(t) AS nb, s, lower(s) AS low, substring(t, 4) AS rest FROM (SELECT doc_id, n_line, t, regexp_replace(t, '^[^\\p{{L}}\\p{{N}}_]+', '') AS s FROM (SELECT doc_id, generate_subscripts(l, 1) - 1 AS n_line, {STRIP('unnest(l)')} AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))))"
_starts = lambda ws: "(" + " OR ".join(f"starts_with(low, '{w}')" for w in ws) + ")"


@query(f"""SELECT doc_id, n_line, regexp_matches(s, '^({'|'.join(lists.SHARE_NAMES)})($|[^\\p{{L}}\\p{{N}}])') OR {_starts(lists.SHARE_STARTS)} OR low IN ({', '.join(f"'{w}'" for w in lists.SHARE_WHOLE)}) OR (contains(low, 'subscribe') AND contains(low, 'newsletter'))
OR (nb < 120 AND ({_starts(lists.PHOTO_STARTS)} OR {_has('low', lists.PHOTO_AGENCIES)})) OR (nb < 80 AND ({_starts(lists.NEWS_STARTS)} OR {_starts(lists.DATE_STARTS)}))
OR (nb < 50 AND starts_with(low, 'by ') AND regexp_matches(rest, '^\\p{{Lu}}') AND NOT contains(rest, '. ') AND NOT contains(rest, ', the ')) AS share FROM {_S}""")
def share_text_flags(spark, d):
    lines = docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("n_line", "line"))
    return lines.select("doc_id", F.col("n_line").cast("long").alias("n_line"), c.is_share_text("line").alias("share"))


_low, _mid = (" ".join(f"WHEN '{k}' THEN {v[i]}" for k, v in lists.EXPECTED_LENGTH.items()) for i in (0, 1))


@query(f"""SELECT doc_id, page_type, least(greatest(1.0::DOUBLE + CASE WHEN r < 0.005 THEN -0.30 WHEN r < 0.01 THEN -0.20 WHEN r < 0.02 THEN -0.10 ELSE 0 END::DOUBLE + CASE WHEN r > 0.30 THEN -0.10 ELSE 0 END::DOUBLE
+ CASE WHEN n < 100 THEN -0.30 WHEN n < lo // 2 THEN -0.20 WHEN n < lo THEN -0.10 ELSE 0 END::DOUBLE + CASE WHEN n >= lo AND n <= mid * 3 THEN 0.05 ELSE 0 END::DOUBLE + CASE WHEN n > 200 THEN -0.05 ELSE 0 END::DOUBLE + 0::DOUBLE
+ CASE WHEN hits >= 2 THEN -0.25 WHEN hits = 1 THEN -0.10 ELSE 0 END::DOUBLE, 0), 1) AS quality
FROM (SELECT *, CASE page_type {_low} END AS lo, CASE page_type {_mid} END AS mid, n / (n * 5 + 100)::DOUBLE AS r, {' + '.join(f"contains(head, '{w}')::INT" for w in lists.QUALITY_WORDS)} AS hits
FROM (SELECT doc_id, strlen(text) AS n, lower(substring(text, 1, 200)) AS head, (['{"', '".join(lists.PAGE_TYPES).replace('"', "'").replace("', '", "','")}'])[doc_id % 7 + 1] AS page_type FROM documents))""")
def quality_heuristic_documents(spark, d):
    kinds = F.array(*(F.lit(k) for k in lists.PAGE_TYPES))
    df = docs(spark, d).withColumn("page_type", F.element_at(kinds, (F.col("doc_id") % 7 + 1).cast("int")))
    return df.select("doc_id", "page_type", c.quality("text", F.lit(None).cast("string"), F.octet_length("text") * 5 + 100, "page_type").alias("quality"))


@query(f"""SELECT item_id, doc_id, CASE WHEN na = 0 AND nb = 0 THEN 1 WHEN na = 0 OR nb = 0 THEN 0 ELSE n / na::DOUBLE END AS precision, CASE WHEN na = 0 AND nb = 0 THEN 1 WHEN na = 0 OR nb = 0 THEN 0 ELSE n / nb::DOUBLE END AS recall,
CASE WHEN na = 0 AND nb = 0 THEN 1 WHEN na = 0 OR nb = 0 OR n = 0 THEN 0 ELSE 2 * (n / na::DOUBLE) * (n / nb::DOUBLE) / (n / na::DOUBLE + n / nb::DOUBLE) END AS fscore
FROM (SELECT item_id, doc_id, len(a) AS na, len(b) AS nb, len(list_intersect(a, b))::DOUBLE AS n FROM (SELECT b.item_id, d.doc_id, list_distinct({WORDS('lower(d.text)')}) AS a, list_distinct({WORDS('lower(b.text)')}) AS b FROM benchmark b JOIN documents d ON d.doc_id = b.item_id))""")
def fscore_documents_vs_benchmark(spark, d):
    b = spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", F.col("text").alias("gold"))
    both = b.join(docs(spark, d).select(F.col("doc_id").alias("item_id"), "text"), "item_id")
    return both.select("item_id", F.col("item_id").alias("doc_id"), c.fscore("text", "gold").alias("s")).select("item_id", "doc_id", "s.*")


@query(f"SELECT page_type, count(*) AS pages, sum(strlen(html))::BIGINT AS bytes, max(length(html)) AS longest FROM {TYPED} GROUP BY 1")
def page_type_rollup(spark, d):
    return pages(spark, d).groupBy(c.url_page_type("url").alias("page_type")).agg(F.count("*").alias("pages"), F.sum(F.octet_length("html")).cast("long").alias("bytes"), F.max(F.length("html")).cast("long").alias("longest"))


@query(f"SELECT {HOST} AS host, count(*) AS pages, min(page_id) AS first_page FROM pages GROUP BY 1")
def host_rollup(spark, d):
    return pages(spark, d).groupBy(c.hostname("url").alias("host")).agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page"))


@query("SELECT lang, count(*) AS docs, sum(quality)::BIGINT AS good, sum(toxic)::BIGINT AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def lang_quality_rollup(spark, d):
    return docs(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").groupBy("lang").agg(F.count("*").alias("docs"), F.sum("quality").cast("long").alias("good"), F.sum("toxic").cast("long").alias("toxic"))


@query("SELECT doc_id, len(l) AS n_lines, len(list_distinct(l)) AS n_distinct FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)")
def repeated_line_stats(spark, d):
    lines = F.split("text", "\n")
    return docs(spark, d).select("doc_id", F.size(lines).cast("long").alias("n_lines"), F.size(F.array_distinct(lines)).cast("long").alias("n_distinct"))


@query(f"SELECT doc_id, CASE WHEN len(list_filter({WORDS('text')}, lambda w: strlen(w) >= 2)) < 50 OR strlen(text) < 200 THEN 'Insufficient content after extraction' END AS short, strlen(text) > 20000 AS long FROM documents")
def validation_warnings(spark, d):
    warnings = c.validation_warnings("text", c.count_words("text"), most_bytes=20_000)
    return docs(spark, d).select("doc_id", F.when(F.exists(warnings, lambda w: w.startswith("Insufficient content after extraction")), F.lit("Insufficient content after extraction")).alias("short"), F.array_contains(warnings, "Content truncated to max length: 20000").alias("long"))


_NAMES = ("Jane Doe", "http://x.org", "a", "Anna-Maria O'Neil", "user1234", "site.com team", "{json}", "Averyverylongnamewithoutspace", "Ünal Ö.", "a@b #c", " Bo ")
_LICENSES = ("CC0", "https://creativecommons.org/licenses/by-sa/4.0/", "http://creativecommons.org/publicdomain/zero/1.0/", " All rights reserved ", "https://creativecommons.org/licenses/by/3.0")
_DATES = ("2024-01-15T10:20:30Z", "2024-01-15T10:20:30+02:00", "2024-01-15T10:20:30", "2024-01-15", "2024/01/15", "15/01/2024", "02/03/2024", "January 15, 2024", "Jan 5, 2024", "15 January 2024", "nonsense", "13/25/2024")
_LANGS = ("en-US", "de_DE", " FR ", "pt-BR_x", "zh")
_TAGS = (" rust,  scraping , ,web ", "a;b,c", "", "one")
_values = lambda vs: "(VALUES " + ", ".join(f"({i}, '{v.replace(chr(39), chr(39) * 2)}')" for i, v in enumerate(vs)) + ") AS v(i, x)"


def _frame(spark: SparkSession, values) -> DataFrame:
    return spark.createDataFrame(list(enumerate(values)), "i int, x string")


@case(f"SELECT i, strlen(t) BETWEEN 2 AND 120 AND NOT (strlen(t) > 20 AND NOT contains(t, ' ')) AND NOT regexp_matches(t, '^(https?://|www\\.|\\{{|\\[)') AND NOT regexp_matches(t, '\\.(com|org|net)') AND len(regexp_extract_all(t, '[0-9]')) <= 3 AND len(regexp_extract_all(t, '[^\\p{{L}}\\p{{N}}\\s\\-''.]')) <= 2 AS valid FROM (SELECT i, {STRIP('x')} AS t FROM {_values(_NAMES)})")
def author_name_valid(spark, d):
    return _frame(spark, _NAMES).select("i", c.is_name("x").alias("valid"))


@case(f"SELECT i, CASE WHEN contains(lower(t), 'creativecommons.org/publicdomain/zero') OR upper(t) = 'CC0' THEN 'CC0 1.0' WHEN regexp_matches(lower(t), 'creativecommons\\.org/licenses/[a-z-]+/[0-9.]+') THEN 'CC ' || upper(replace(regexp_extract(lower(t), 'licenses/([a-z-]+)/', 1), '-', ' ')) || ' ' || regexp_extract(lower(t), 'licenses/[a-z-]+/([0-9.]+)', 1) ELSE t END AS license FROM (SELECT i, {_clean('x')} AS t FROM {_values(_LICENSES)})")
def license_normalize(spark, d):
    return _frame(spark, _LICENSES).select("i", c.normalize_license("x").alias("license"))


@case(f"SELECT i, epoch(coalesce(CASE WHEN regexp_matches(x, '(Z|[+-][0-9]{{2}}:[0-9]{{2}})$') THEN try_cast(x AS TIMESTAMPTZ) AT TIME ZONE 'UTC' END, {', '.join(f'''try_strptime(x, '{f}')''' for f in ('%Y-%m-%dT%H:%M:%S', '%Y-%m-%d', '%Y/%m/%d', '%d/%m/%Y', '%m/%d/%Y', '%B %d, %Y', '%b %d, %Y', '%d %B %Y'))}))::BIGINT AS seconds FROM {_values(_DATES)}")
def date_parse(spark, d):
    return _frame(spark, _DATES).select("i", F.unix_timestamp(c.parse_date("x")).alias("seconds"))


@case(f"SELECT i, lower(split_part(split_part({_clean('x')}, '-', 1), '_', 1)) AS lang, lower(split_part(x, '_', 1)) AS meta_lang FROM {_values(_LANGS)}")
def language_normalize(spark, d):
    return _frame(spark, _LANGS).select("i", c.normalize_language("x").alias("lang"), c.meta_language("x").alias("meta_lang"))


@case(f"SELECT i, array_to_string(list_filter(list_transform(regexp_split_to_array(x, '[,;]'), lambda t: {_clean('t')}), lambda t: t <> ''), '|') AS tags FROM {_values(_TAGS)}")
def tag_lists(spark, d):
    return _frame(spark, _TAGS).select("i", F.array_join(c.tag_list("x"), "|").alias("tags"))


@query("SELECT page_id, coalesce(regexp_matches(trim(url), '^https?://(?:[^/?#@]*@)?([^/?#:@]+)'), false) AS is_absolute, lower(split_part(split_part(split_part(trim(url), '?', 1), '#', 1), '/', -1)) = '1.html' AS matches FROM pages")
def url_checks(spark, d):
    return pages(spark, d).select("page_id", c.is_absolute_url("url").alias("is_absolute"), c.filenames_match("url", F.lit("https://x.org/1.HTML?y")).alias("matches"))


@query("SELECT doc_id, coalesce(regexp_matches(text, '[\\p{L}\\p{N}]'), false) AS has_chars FROM documents")
def text_chars_documents(spark, d):
    return docs(spark, d).select("doc_id", c.text_chars_test("text").alias("has_chars"))


_TITLE = f"nullif({_clean(_replace('''regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)''', lists.ENTITIES))}, '')"


@query(f"SELECT page_id, strlen(t) BETWEEN 2 AND 120 AND NOT (strlen(t) > 20 AND NOT contains(t, ' ')) AND NOT regexp_matches(t, '^(https?://|www\\.|\\{{|\\[)') AND NOT regexp_matches(t, '\\.(com|org|net)') AND len(regexp_extract_all(t, '[0-9]')) <= 3 AND len(regexp_extract_all(t, '[^\\p{{L}}\\p{{N}}\\s\\-''.]')) <= 2 AS valid FROM (SELECT page_id, {_TITLE} AS t FROM pages)")
def author_name_titles(spark, d):
    return pages(spark, d).select("page_id", c.is_name(c.raw_title("html")).alias("valid"))


@query(f"SELECT page_id, array_to_string(list_filter(list_transform(regexp_split_to_array({_TITLE}, '[,;]'), lambda t: {_clean('t')}), lambda t: t <> ''), '|') AS tags FROM pages")
def tag_lists_titles(spark, d):
    return pages(spark, d).select("page_id", F.array_join(c.tag_list(c.raw_title("html")), "|").alias("tags"))


@query("SELECT doc_id, lower(lang) AS lang, lower(lang) || '-' || lower(source) AS meta_lang FROM documents")
def language_normalize_documents(spark, d):
    return docs(spark, d).select("doc_id", c.normalize_language(F.concat("lang", F.lit("-"), F.upper("source"))).alias("lang"), c.meta_language(F.concat(F.upper("lang"), F.lit("-"), F.col("source"), F.lit("_x"))).alias("meta_lang"))


_EVENT_DATES = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy", "MMMM d, yyyy", "d MMMM yyyy")


@query("SELECT event_id, epoch(CASE event_id % 6 WHEN 0 THEN date_trunc('second', ts) ELSE date_trunc('day', ts) END)::BIGINT AS seconds FROM events")
def date_parse_events(spark, d):
    """Dates of all events, written in six formats, read back."""
    ts = spark.read.parquet(f"{d}/events.parquet").select("event_id", "ts")
    text = F.date_format("ts", _EVENT_DATES[0])
    for k, f in enumerate(_EVENT_DATES[1:], 1):
        text = F.when(F.col("event_id") % 6 == k, F.date_format("ts", f)).otherwise(text)
    return ts.select("event_id", F.unix_timestamp(c.parse_date(text)).alias("seconds"))


@query(f"SELECT page_id, true AS fragment, regexp_matches(trim(url), '^https?://[^/?#]+/[^?#]') AND NOT regexp_matches(url, '[?#]') AND NOT regexp_matches(url, '/$') AS slash FROM pages")
def urls_match_pages(spark, d):
    return pages(spark, d).select("page_id", c.urls_match("url", F.concat("url", F.lit("#part"))).alias("fragment"), (c.urls_match("url", F.concat("url", F.lit("/"))) & ~F.col("url").contains("?") & ~F.col("url").contains("#") & ~F.col("url").endswith("/")).alias("slash"))


@query(f"SELECT page_id, CASE WHEN ad = '' THEN NULL WHEN strlen(a) >= 2 THEN a END AS author FROM (SELECT page_id, ad, {_clean("regexp_replace(" + _clean("'By ' || split_part(ad, '.', 1)") + ", '^By ', '')")} AS a FROM (SELECT page_id, regexp_extract(html, '<div class=\"ad\">([^<]*)', 1) AS ad FROM pages))")
def author_normalized_pages(spark, d):
    ad = F.regexp_extract("html", '<div class="ad">([^<]*)', 1)
    return pages(spark, d).select("page_id", F.when(ad != "", c.normalize_author(F.concat(F.lit("By "), F.split_part(ad, F.lit("."), F.lit(1)), F.lit(" @handle and 3 more people")))).alias("author"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN t ELSE regexp_replace(t, '([\\\\*_\\[\\]<>])', '\\\\\\1', 'g') END AS text FROM (SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS t FROM pages)")
def escape_markdown_code(spark, d):
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    return pages(spark, d).select("page_id", c.escape_markdown(title, F.col("page_id") % 2 == 0).alias("text"))


_KINDS = ("by", "by-sa", "by-nc-nd")


@query(f"""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'CC0 1.0' WHEN 1 THEN 'CC0 1.0' WHEN 2 THEN {_clean('text')} ELSE 'CC ' || CASE doc_id % 3 WHEN 0 THEN 'BY' WHEN 1 THEN 'BY SA' ELSE 'BY NC ND' END || ' ' || (doc_id % 4 + 1) || '.0' END AS license FROM documents WHERE NOT contains(lower(text), 'creativecommons') AND upper(trim(text)) <> 'CC0'""")
def license_documents(spark, d):
    """Licence names and links of six forms, one a document."""
    kind = F.element_at(F.array(*(F.lit(k) for k in _KINDS)), (F.col("doc_id") % 3 + 1).cast("int"))
    link = F.concat(F.lit(" see https://creativecommons.org/licenses/"), kind, F.lit("/"), (F.col("doc_id") % 4 + 1).cast("string"), F.lit(".0/deed"))
    said = F.when(F.col("doc_id") % 6 == 0, F.lit(" cc0 ")).when(F.col("doc_id") % 6 == 1, F.lit("http://CreativeCommons.org/publicdomain/zero/1.0/")).when(F.col("doc_id") % 6 == 2, F.col("text")).otherwise(link)
    kept = docs(spark, d).where(~F.lower("text").contains("creativecommons") & (F.upper(F.trim("text")) != "CC0"))
    return kept.select("doc_id", c.normalize_license(said).alias("license"))


@query(f"SELECT page_id, lower({_TITLE}) AS title, t IS NOT NULL AND CASE page_id % 5 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN true WHEN 3 THEN false ELSE lower(t) = 'other' OR starts_with(lower(t), 'other: ') OR starts_with(lower(t), 'other - ') OR starts_with(lower(t), 'other | ') END AS same FROM (SELECT *, {_TITLE} AS t FROM pages)")
def titles_match_pages(spark, d):
    """Every page's title against itself in small letters, with a site behind it, with blanks, glued to a word, and against another."""
    t = c.raw_title("html")
    other = F.when(F.col("page_id") % 5 == 0, F.lower(t)).when(F.col("page_id") % 5 == 1, F.concat(t, F.lit(" | Site name"))).when(F.col("page_id") % 5 == 2, F.concat(F.lit("  "), t, F.lit(" \t"))).when(F.col("page_id") % 5 == 3, F.concat(t, F.lit("xyz"))).otherwise(F.lit("Other"))
    return pages(spark, d).select("page_id", c.normalize_title(t).alias("title"), F.coalesce(c.titles_match(t, other), F.lit(False)).alias("same"))


_IMAGES = ("jpg", "jpeg", "png", "gif", "webp", "svg", "bmp", "ico", "tiff", "tif", "avif")


@query(f"SELECT page_id, CASE page_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true ELSE lower(split_part(split_part(url, '?', 1), '.', -1)) IN ({', '.join(repr(x) for x in _IMAGES)}) END AS image FROM pages")
def image_files_pages(spark, d):
    """Names of image files made of every page's URL, and the URLs themselves."""
    ending = F.element_at(F.array(*(F.lit(x) for x in _IMAGES)), (F.col("page_id") % 11 + 1).cast("int"))
    link = F.when(F.col("page_id") % 4 == 0, F.concat(F.split_part("url", F.lit("?"), F.lit(1)), F.lit("/a."), F.upper(ending), F.lit("?w=1.html"))).when(F.col("page_id") % 4 == 1, F.concat(F.split_part("url", F.lit("?"), F.lit(1)), F.lit("/png.html?x.png"))).when(F.col("page_id") % 4 == 2, F.concat(F.lit("b."), ending)).otherwise(F.col("url"))
    return pages(spark, d).select("page_id", c.is_image_file(link).alias("image"))


@query("SELECT page_id, CASE WHEN NOT regexp_matches(html, '<meta charset=\"utf-8\">') THEN 'utf-8' WHEN page_id % 3 = 0 THEN 'utf-8' WHEN page_id % 3 = 1 THEN 'koi8-r' ELSE 'utf-8' END AS encoding FROM pages")
def declared_encoding_pages(spark, d):
    """The encoding that pages declare: as they are, by their content type after a label that nobody knows, and by such a label alone."""
    meta = '<meta charset="utf-8">'
    html = F.when(F.col("page_id") % 3 == 1, F.replace("html", F.lit(meta), F.lit("<meta charset='none-such'><META http-equiv=\"Content-Type\" content='text/html; charset=KOI8-R'>"))).when(F.col("page_id") % 3 == 2, F.replace("html", F.lit(meta), F.lit("<meta charset=none-such>"))).otherwise(F.col("html"))
    return pages(spark, d).select("page_id", c.declared_encoding(html).alias("encoding"))


QUERIES, ORACLES = _RUN, _SQL
