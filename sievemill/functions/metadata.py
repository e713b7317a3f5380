"""Metadata of a page as columns over its tree (see tree.py): meta tags, JSON-LD and what the document itself says, each filling what is still empty. No Python runs on the executors.

`with_metadata` gives all fields, `with_light_metadata` those of meta tags and the title,
`open_graph` the Open Graph properties alone. A null page has null fields and empty lists;
so has an empty one, but for what its URL says.

Not modelled: text of scripts inside an element that names the site; what tree.py leaves out.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import profiles as P
from ..operators import rules as R
from . import columns as C
from . import jsonld
from .content import holds
from .tree import attribute, decoded, fenced, let, lit, node_text, with_tree

FIELDS = ("title", "author", "url", "hostname", "description", "sitename", "date", "license", "language", "image", "og_type", "categories", "tags")
LISTS = ("categories", "tags")

# ---------------------------------------------------------------- fixed values
TITLE_CUT = rf"{C.SPACE}*[|–—·]{C.SPACE}*|{C.SPACE}+-{C.SPACE}+|{C.SPACE}*:{C.SPACE}+"
SITE_CUT = rf"{C.SPACE}*[|–—]{C.SPACE}*|{C.SPACE}+-{C.SPACE}+"
SUFFIXES = (" | ", " • ", " » ", " - ", " – ", " — ")
GRAPH = {"og:title": "title", "og:description": "description", "og:site_name": "sitename", "og:url": "url", "og:image": "image", "og:type": "og_type", "og:locale": "language"}

_LANGUAGE = attribute("regexp_extract({html}, '(?is)<html(?=[^a-z])([^>]*)>', 1)", "lang")
_NAMES = ("name", "property", "itemprop", "http-equiv")


# ---------------------------------------------------------------- titles
def title_part(text: Column) -> Column:
    """The longest part of a title (of equal ones the last) if it has more than 10 bytes, else all of it; null without text."""
    parts = F.transform(F.split(text, TITLE_CUT), lambda p, k: F.struct(F.octet_length(p).alias("n"), k.alias("k"), C.strip(p).alias("said")))
    best = F.array_max(parts)["said"]
    return F.when(text != "", F.when((F.size(parts) > 1) & (F.octet_length(best) > 10), best).otherwise(text))


def site_part(text: Column) -> Column:
    """What stands behind the last separator of a title, where that has 3 to 49 bytes."""
    parts = F.split(text, SITE_CUT)
    last = C.strip(F.element_at(parts, -1))
    return F.when((F.size(parts) > 1) & F.octet_length(last).between(3, 49), last)


def strip_site_suffix(title: Column, site: Column | None = None) -> Column:
    """A title without its site: cut at the first separator where one side begins with (or is) the site, or is short enough to be one. Null titles stay null; without a site only lengths decide."""
    site = F.lower(site if site is not None else F.lit(None).cast("string"))

    def cut(x: Column) -> Column:
        def ways(sep: str) -> Column:
            parts = F.split(x["title"], re.escape(sep))
            joined = lambda start, n: C.strip(F.array_join(F.slice(parts, start, n), sep))
            each = F.slice(F.sequence(F.lit(1), F.size(parts)), F.lit(1), F.size(parts) - 1)
            return F.transform(each, lambda k: F.struct(joined(F.lit(1), k).alias("head"), joined(k + 1, F.size(parts)).alias("tail")))

        def kept(w: Column) -> Column:
            head, tail, bytes_ = w["head"], w["tail"], F.octet_length
            return (
                F.when(F.lower(tail).startswith(x["site"]) & (head != ""), head)
                .when((F.lower(head) == x["site"]) & (tail != ""), tail)
                .when((F.size(C.words(tail)) <= 5) & (bytes_(tail) < 35) & (bytes_(head) > 10), head)
                .when((F.size(C.words(head)) <= 2) & (bytes_(head) < 20) & (bytes_(tail) > bytes_(head)), tail)
            )

        found = F.filter(F.transform(F.concat(*map(ways, SUFFIXES)), kept), lambda y: y.isNotNull())
        return F.coalesce(F.get(found, F.lit(0)), x["title"])

    return F.element_at(F.transform(F.array(F.struct(title.alias("title"), F.nullif(site, F.lit("")).alias("site"))), cut), 1)


# ---------------------------------------------------------------- SQL over nodes
def simple(selector: str, x: str) -> str:
    """SQL of a selector of one step: tag, .class, #id, [name='value'] or [name*='value']."""
    if m := re.fullmatch(r"\[([a-z-]+)(\*?)='([^']*)'\]", selector):
        name, part, value = m.groups()
        field = attribute(f"{x}.attrs", name)
        return f"contains({field}, {lit(value)})" if part else f"{field} = {lit(value)}"
    if selector[0] == ".":
        return f"array_contains(split({attribute(f'{x}.attrs', 'class')}, '\\\\s+'), {lit(selector[1:])})"
    if selector[0] == "#":
        return f"{attribute(f'{x}.attrs', 'id')} = {lit(selector[1:])}"
    return f"{x}.tag = {lit(selector)}"


def _value(x: str, name: str) -> str:
    return decoded(attribute(f"{x}.attrs", name))


def _trimmed(x: str) -> str:
    return f"trim(BOTH {lit(C.SPACES)} FROM {x})"


def _spaced(x: str) -> str:
    """The texts of a node, a blank between them."""
    return _trimmed(f"array_join(filter(slice(texts, {x}.start + 1, {x}.end - {x}.start), t -> t <> ''), ' ')")


def _cleaned(x: str) -> str:
    return f"trim(regexp_replace({_spaced(x)}, {lit(C.SPACE + '+')}, ' '))"


_INSIDE = "x.pre > __body.pre AND x.pre <= __body.post"
_BELOW = lambda x: f"slice(nodes, {x}.pre + 2, {x}.post - {x}.pre)"
_ALL = lambda test: f"filter(nodes, x -> {test})"


def _one(test: str, text: str) -> str:
    """Text of the first node x that passes the test, null without one."""
    return f"get(transform(slice({_ALL(test)}, 1, 1), x -> {text}), 0)"


def _firsts(rules, text, unless: str = "false") -> str:
    """Texts of the first node in the body for each rule, null where it has none."""
    return "array(" + ", ".join(_one(f"{_INSIDE} AND {holds(r, 'x')} AND NOT {unless}", text("x")) for r in rules) + ")"


def _lists(rules) -> str:
    """Texts of each rule's nodes: content of meta tags, else of the links in it, else its own."""
    links = f"transform(filter({_BELOW('x')}, y -> y.tag = 'a'), y -> {node_text('y')})"
    own = f"IF(x.tag = 'meta', array({_value('x', 'content')}), {let(links, 'l_', f'IF(size(l_) > 0, l_, array({node_text("x")}))')})"
    return "array(" + ", ".join(f"flatten(transform({_ALL(holds(r, 'x'))}, x -> {own}))" for r in rules) + ")"


def _dates() -> str:
    """Dates as written: of time elements, then of places named after dates (three of each)."""
    times = _ALL("x.tag = 'time'")
    parts = [f"transform({times}, x -> {_value('x', 'datetime')})", f"transform({times}, x -> {_trimmed(node_text('x'))})"]
    for place in P.DATE_PLACES:
        text = let(_trimmed(node_text("x")), "t_", "IF(octet_length(t_) < 100, t_, '')")
        parts.append(f"flatten(transform(slice({_ALL(simple(place, 'x'))}, 1, 3), x -> array({_value('x', 'datetime')}, {_value('x', 'content')}, {text})))")
    return f"filter(concat({', '.join(parts)}), t -> t <> '')"


def _licences() -> str:
    hrefs = lambda nodes: f"transform({nodes}, y -> {attribute('y.attrs', 'href')})"
    parts = [f"flatten(transform({_ALL(simple(place, 'x'))}, x -> {hrefs(f'filter({_BELOW("x")}, y -> y.tag = {lit("a")})')}))" for place in P.LICENSE_PLACES]
    parts.append(hrefs(f"filter(nodes, y -> y.tag = 'a' AND {attribute('y.attrs', 'rel')} = 'license')"))
    return f"concat({', '.join(parts)})"


_PROPERTIES = f"""transform(filter(nodes, x -> x.tag = 'meta' AND x.attrs <> ''), x -> struct(lower(coalesce({', '.join(f"nullif({attribute('x.attrs', k)}, '')" for k in _NAMES)}, '')) AS name,
 {attribute('x.attrs', 'property')} AS property, {_value('x', 'content')} AS content))"""
_TITLE = _trimmed(f"coalesce({_one("x.tag = 'title'", node_text('x'))}, '')")
_H1 = f"get(filter(transform({_ALL("x.tag = 'h1'")}, x -> {_cleaned('x')}), t -> octet_length(t) > 5 AND octet_length(t) < 200), 0)"
_CANONICAL = _one(f"x.tag = 'link' AND {attribute('x.attrs', 'rel')} = 'canonical'", _value("x", "href"))
_NOT_AUTHOR = "(" + " OR ".join(holds(r, "x") for r in R.AUTHOR_DISCARD) + ")"


# ---------------------------------------------------------------- operators
def _first(values: Column) -> Column:
    return F.get(F.filter(values, lambda v: v.isNotNull() & (v != "")), F.lit(0))


def _first_list(values: Column) -> Column:
    return F.get(F.filter(values, lambda v: F.size(v) > 0), F.lit(0))


def _first_date(texts: Column) -> Column:
    return F.get(F.filter(F.transform(texts, C.parse_date), lambda d: d.isNotNull()), F.lit(0))


def meta_fields(properties: Column) -> dict[str, Column]:
    """What meta tags (array<struct<name, property, content>>) say: for each field the first tag with one of its names and a usable value."""

    def said(field: str) -> Column:
        return F.filter(F.transform(F.filter(properties, lambda m: m["name"].isin(*P.META[field])), lambda m: C.strip(m["content"])), lambda v: v != "")

    out = {k: F.get(said(k), F.lit(0)) for k in ("title", "description", "sitename", "url", "image", "og_type")}
    out["author"] = F.get(F.filter(said("author"), C.is_name), F.lit(0))
    out["date"] = _first_date(said("date"))
    out |= {k: _first_list(F.transform(said(k), lambda v: C.tag_list(v))) for k in LISTS}
    out["language"] = _first(F.transform(said("language"), C.meta_language))
    out["license"] = F.get(F.transform(said("license"), C.normalize_license), F.lit(0))
    return out


def _unique(texts: str, most: int) -> Column:
    """Parts of the texts found by each rule, until there are `most`."""
    parts = F.transform(F.col(texts), lambda found: F.filter(F.flatten(F.transform(found, lambda t: C.tag_list(t, "[,;/]"))), lambda x: F.octet_length(x) < 100))
    return F.aggregate(parts, F.array().cast("array<string>"), lambda o, p: F.when(F.size(o) >= most, o).otherwise(F.array_distinct(F.concat(o, p))))


def _fence(df: DataFrame, **columns: Column) -> DataFrame:
    return df.withColumns({k: F.when(F.spark_partition_id() >= 0, v) for k, v in columns.items()})


def _read(df: DataFrame, html: str) -> DataFrame:
    """df with the tree, the meta tags, and the title's and the first good heading's text."""
    return fenced(with_tree(df, html), __properties=_PROPERTIES, __title=_TITLE, __h1=_H1)


def with_metadata(df: DataFrame, html: str = "html", url: str | None = None, blacklist: tuple[str, ...] = (), keep_tree: bool = False) -> DataFrame:
    """df with `metadata`: a struct of FIELDS (strings; date a timestamp; categories and tags arrays). What only fields that aren't used later need isn't worked out.

    url: the column of the page's own URL, which goes before what the page says. blacklist:
    words that no author's name may hold (in any case). keep_tree: leave texts and nodes of
    the page in df, for operators that take a tree."""
    df = _read(df, html).withColumn("__ld", jsonld.blocks(html))
    df = fenced(df, __body="get(filter(nodes, x -> x.tag = 'body'), 0)")
    df = fenced(df, nodes=f"transform(nodes, x -> struct(x.pre, x.post, x.parent, x.depth, x.tag, x.attrs, x.start, x.end, {attribute('x.attrs', 'class')} AS class, {attribute('x.attrs', 'id')} AS id))")
    df = fenced(
        df,
        __titles=_firsts(R.TITLE, _cleaned),
        __authors=_firsts(R.AUTHOR, _cleaned, _NOT_AUTHOR),
        __sites=_firsts(R.SITENAME, _spaced),
        __dates=_dates(),
        __categories=_lists(R.CATEGORIES),
        __tags_found=_lists(R.TAGS),
        __licences=_licences(),
        __canonical=_CANONICAL,
        __lang=_LANGUAGE.format(html=f"`{html}`"),
    )
    # a column for each field: the optimiser drops unused columns, but can't look into a fenced struct
    said = meta_fields(F.col("__properties"))
    df = _fence(df, __data=jsonld.harvest("__ld"), **{f"__meta_{k}": v for k, v in said.items()})
    meta = {k: F.col(f"__meta_{k}") for k in said}
    data, title, h1 = F.col("__data"), title_part(F.col("__title")), F.col("__h1")
    sized = lambda found, least, most: F.filter(found, lambda t: F.octet_length(t).between(least, most))
    licence = F.transform("__licences", lambda h: F.regexp_extract(h, r"creativecommons\.org/licenses/([a-z-]+)/", 1))
    own = {
        "title": F.coalesce(F.when(F.lower(title).contains(F.lower(h1)), h1), title, h1, F.get(F.filter("__titles", lambda t: F.octet_length(t) > 5), F.lit(0))),
        "author": _first(F.transform(sized(F.col("__authors"), 2, 149), C.normalize_author)),
        "date": _first_date(F.col("__dates")),
        "url": F.when(C.hostname("__canonical").isNotNull(), F.col("__canonical")),
        "sitename": F.coalesce(site_part(F.col("__title")), F.get(sized(F.col("__sites"), 1, 99), F.lit(0))),
        "categories": _unique("__categories", 5),
        "tags": _unique("__tags_found", 10),
        "license": F.concat(F.lit("CC "), F.upper(_first(licence))),
        "language": F.nullif(F.lower(F.split_part("__lang", F.lit("-"), F.lit(1))), F.lit("")),
    }
    known = {k: data[k] for k in ("title", "author", "sitename", "description", "image")} | {"date": jsonld.first_date(data["date_text"])}
    given = {"url": F.nullif(F.col(url).cast("string"), F.lit(""))} if url else {}

    def found(k: str) -> Column:
        ways = [w[k] for w in (given, known, {k: meta[k]}, own) if k in w]
        return F.coalesce(*ways)

    filled = {k: found(k) for k in FIELDS if k not in ("hostname", *LISTS)}
    no = F.array().cast("array<string>")
    filled["categories"] = F.coalesce(F.when(F.size(data["categories"]) > 0, data["categories"]), meta["categories"], own["categories"], no)
    filled["tags"] = F.coalesce(meta["tags"], own["tags"], no)
    df = _fence(df, **{f"__filled_{k}": v for k, v in filled.items()})
    x = {k: F.col(f"__filled_{k}") for k in filled}
    for k in ("title", "author", "description", "sitename"):
        x[k] = F.nullif(C.decode_entities(C.strip(x[k])), F.lit(""))
    x["title"] = strip_site_suffix(x["title"], x["sitename"])
    for k, more in (("url", "^/"), ("image", "^(/|data:)")):
        x[k] = F.when(C.hostname(x[k]).isNotNull() | x[k].rlike(more), x[k])
    for word in blacklist:
        x["author"] = F.when(~F.contains(F.lower(x["author"]), F.lit(word.lower())), x["author"])
    x["hostname"] = C.hostname(x["url"])
    df = df.withColumn("metadata", F.struct(*(x[k].alias(k) for k in FIELDS)))
    return df.drop(*(() if keep_tree else ("texts", "nodes")), *_MADE, *(f"__meta_{k}" for k in said), *(f"__filled_{k}" for k in filled))


_MADE = ("__properties", "__title", "__h1", "__ld", "__body", "__titles", "__authors", "__sites", "__dates", "__categories", "__tags_found", "__licences", "__canonical", "__lang", "__data")


def with_light_metadata(df: DataFrame, html: str = "html", url: str | None = None) -> DataFrame:
    """df with `metadata`: the URL as given and its host, the fields of meta tags, and the title element's or a heading's text where no meta tag has a title."""
    df = _read(df, html)
    meta = meta_fields(F.col("__properties"))
    meta["title"] = F.coalesce(meta["title"], title_part(F.col("__title")), F.col("__h1"))
    meta["url"] = F.coalesce(F.col(url).cast("string"), meta["url"]) if url else meta["url"]
    meta["hostname"] = C.hostname(url) if url else F.lit(None).cast("string")
    meta |= {k: F.coalesce(meta[k], F.array().cast("array<string>")) for k in LISTS}
    return _fence(df, metadata=F.struct(*(meta[k].alias(k) for k in FIELDS))).drop("texts", "nodes", *_MADE)


def open_graph(df: DataFrame, html: str = "html") -> DataFrame:
    """df with `graph`: struct of the Open Graph properties, the first of each with a value."""
    df = _read(df, html)
    said = lambda name: _first(F.transform(F.filter("__properties", lambda m: m["property"] == name), lambda m: m["content"]))
    fields = [(C.meta_language(said(name)) if k == "language" else said(name)).alias(k) for name, k in GRAPH.items()]
    return _fence(df, graph=F.struct(*fields)).drop("texts", "nodes", *_MADE)


def title_texts(df: DataFrame, html: str = "html") -> DataFrame:
    """df with title_element (its text), title_part (its longest part), heading (the first of fair length) and title_site, null where there is none."""
    df = _read(df, html)
    return _fence(df, title_element=F.nullif(F.col("__title"), F.lit("")), title_part=title_part(F.col("__title")), heading=F.col("__h1"), title_site=site_part(F.col("__title"))).drop("texts", "nodes", *_MADE)
