"""What a page says of its type and language, its images and its comments, as columns over its tree (see tree.py). No Python runs on the executors.

A null page has no signals, language or comments (null), and no images (an empty list); an
empty one has counts of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import profiles as P
from ..operators import rules as R
from . import columns as C
from . import jsonld
from .content import BODY, any_word
from .metadata import _BELOW, _fence, _one, _value
from .tree import among, attribute, fenced, let, lit, node_text, with_tree

_has = lambda words: f"exists(__classes, c -> {any_word('c', words)})"
_count = lambda test: f"size(filter(nodes, x -> {test}))"


def ld_types(texts: str) -> str:
    """SQL: the @type values in JSON texts, however deep; texts that aren't JSON are passed over."""
    many = f"transform(filter(CAST(m_ AS array<variant>), t -> {jsonld._is('t', 'STRING')}), t -> CAST(t AS string))"
    own = f"IF({jsonld._is('v', 'OBJECT')}, {let(jsonld._member('v', '@type'), 'm_', f"CASE WHEN {jsonld._is('m_', 'STRING')} THEN array(CAST(m_ AS string)) WHEN {jsonld._is('m_', 'ARRAY')} THEN {many} ELSE CAST(array() AS array<string>) END")}, CAST(array() AS array<string>))"
    start = f"filter(transform({texts}, t -> try_parse_json({jsonld._trimmed('t')})), v -> v IS NOT NULL)"
    step = f"IF(size(s.level) = 0, s, struct(flatten(transform(s.level, v -> {jsonld._children('v')})) AS level, concat(s.found, flatten(transform(s.level, v -> {own}))) AS found))"
    steps = jsonld._STEPS.format(text=f"array_join({texts}, {lit('')})")
    return f"aggregate({steps}, struct({start} AS level, CAST(array() AS array<string>) AS found), (s, i) -> {step}, s -> s.found)"


_CART = f"({_has(P.CART)} OR exists(nodes, x -> x.tag IN ('button', 'a', 'input') AND {any_word(f'lower({node_text("x")})', P.CART_TEXT)}))"
_LABEL = f"lower({attribute('x.attrs', 'aria-label')})"
_PAGINATION = f"({_has(P.PAGINATION)} OR exists(nodes, x -> (x.tag = 'link' AND {attribute('x.attrs', 'rel')} IN ('next', 'prev')) OR (x.tag = 'nav' AND {any_word(_LABEL, ('pagination', 'paging'))})))"
_WORDS = f"coalesce(aggregate(filter(nodes, x -> x.tag = 'p'), 0L, (n, x) -> n + size(filter(split({node_text('x')}, {lit(C.SPACE + '+')}), w -> w <> ''))), 0L)"
_OG_TYPE = _one(f"x.tag = 'meta' AND {attribute('x.attrs', 'property')} = 'og:type'", _value("x", "content"))


def refine_type(kind: Column, s: Column) -> Column:
    """The URL's type, or for articles what the page's signals (a struct as with_signals makes it) say."""
    typed = lambda *names: F.arrays_overlap(s["ld_types"], F.array(*map(F.lit, names)))
    og, many, grid, cart, offers = F.lower(F.coalesce(s["og_type"], F.lit(""))), s["product_element_count"] >= 5, s["has_product_grid"], s["has_add_to_cart"], s["has_aggregate_offer"]
    product = typed("Product", "ProductGroup")
    told = (
        F.when(typed("CollectionPage", "OfferCatalog", "ProductCollection") | (product & offers) | (typed("ItemList") & (grid | many)), "collection")
        .when(og.isin("product.group", "product:group") | (many & (s["has_pagination"] | (grid & cart))), "collection")
        .when(~offers & (product | og.contains("product")), F.when(grid & ~product, "collection").otherwise("product"))
        .when(grid & cart, "collection")
        .when((s["has_docs_nav"] & (s["code_block_count"] >= 3)) | (s["code_block_count"] >= 500), "documentation")
        .when((s["link_ratio"] >= 3.0) & (s["paragraph_word_count"] < 30), "listing")
        .otherwise("article")
    )
    return F.when(kind == "article", F.when(s.isNull(), "article").otherwise(told)).otherwise(kind)


def with_signals(df: DataFrame, html: str = "html", url: str | None = None) -> DataFrame:
    """df with `signals` (struct) and `page_type`: the type that a page's URL and signals give."""
    df = fenced(with_tree(df, html), __classes=f"filter(transform(nodes, x -> lower({attribute('x.attrs', 'class')})), c -> c <> '')")
    df = df.withColumn("__ld", jsonld.blocks(html))
    code = _count("x.tag IN ('pre', 'code')")
    found = {
        "og_type": _OG_TYPE,
        "ld_types": "l_",
        "has_aggregate_offer": "array_contains(l_, 'AggregateOffer')",
        "has_product_grid": _has(P.PRODUCT_GRID),
        "has_add_to_cart": _CART,
        "product_element_count": f"CAST(size(filter(__classes, c -> {any_word('c', P.PRODUCT_ITEM)})) AS BIGINT)",
        "has_pagination": _PAGINATION,
        "code_block_count": f"CAST({code} AS BIGINT)",
        "has_docs_nav": f"({_has(P.DOCS_NAV)} OR ({code} >= 10 AND {_has(('sidebar',))}))",
        "link_ratio": f"{_count(among('x.tag', ('a',)))} / CAST(greatest({_count(among('x.tag', ('p',)))}, 1) AS DOUBLE)",
        "paragraph_word_count": _WORDS,
    }
    made = "struct(" + ", ".join(f"{v} AS {k}" for k, v in found.items()) + ")"
    df = fenced(df, signals=f"IF(nodes IS NULL, NULL, {let(ld_types('__ld'), 'l_', made)})")
    kind = C.url_page_type(url) if url else F.lit("article")
    return df.withColumn("page_type", refine_type(kind, F.col("signals"))).drop("texts", "nodes", "__classes", "__ld")


_SOURCE = lambda x: let(_value(x, "src"), "s_", f"IF(s_ <> '', s_, {_value(x, 'data-src')})")
_IMAGE = lambda x, caption: f"struct({_SOURCE(x)} AS src, nullif({_value(x, 'alt')}, '') AS alt, {caption} AS caption)"
_FIRST = lambda x, tag: f"get(filter({_BELOW(x)}, y -> y.tag = '{tag}'), 0)"
_CAPTION = f"nullif(trim(regexp_replace({node_text('c_')}, {lit(C.SPACE + '+')}, ' ')), '')"
_FIGURES = f"filter(transform(filter(nodes, f -> f.tag = 'figure'), f -> {let(_FIRST('f', 'img'), 'i_', f"IF(i_ IS NULL, NULL, {let(_FIRST('f', 'figcaption'), 'c_', _IMAGE('i_', _CAPTION))})")}), i -> i IS NOT NULL)"
_SINGLE = f"transform(filter(nodes, i -> i.tag = 'img'), i -> {_IMAGE('i', 'CAST(NULL AS STRING)')})"
_OG_IMAGE = _one(f"x.tag = 'meta' AND {attribute('x.attrs', 'property')} = 'og:image' AND {attribute('x.attrs', 'content')} <> ''", _value("x", "content"))


def with_images(df: DataFrame, html: str = "html", hero: str | None = None) -> DataFrame:
    """df with `images`: array<struct<src, filename, alt, caption, is_hero>> of a page, those in figures first, each source once.

    The hero has the file name (in any case) or else the source of the image in column
    `hero` (by default the page's Open Graph image); where none has, it is the first."""
    df = fenced(with_tree(df, html), __found=f"filter(concat({_FIGURES}, {_SINGLE}), i -> i.src <> '')")
    df = fenced(df, __sources="transform(__found, i -> i.src)", __hero=f"`{hero}`" if hero else _OG_IMAGE)
    df = fenced(df, __once="filter(__found, (i, k) -> array_position(__sources, i.src) = k + 1)")
    name = F.lower(C.filename("__hero"))
    place = lambda values, x: F.nullif(F.array_position(values, x), F.lit(0))
    chosen = F.coalesce(F.when(name != "", place(F.transform("__once", lambda i: F.lower(C.filename(i["src"]))), name)), place(F.transform("__once", lambda i: i["src"]), F.col("__hero")), F.lit(1))
    df = _fence(df, __place=chosen)
    each = lambda i, k: F.struct(i["src"].alias("src"), C.filename(i["src"]).alias("filename"), i["alt"].alias("alt"), i["caption"].alias("caption"), (k + 1 == F.col("__place")).alias("is_hero"))
    none = F.array().cast("array<struct<src: string, filename: string, alt: string, caption: string, is_hero: boolean>>")
    df = _fence(df, images=F.coalesce(F.transform("__once", each), none))
    return df.drop("texts", "nodes", "__found", "__sources", "__hero", "__once", "__place")


# ---------------------------------------------------------------- language and comments
_HTML_LANG = attribute("regexp_extract({html}, '(?is)<html(?=[^a-z])([^>]*)>', 1)", "lang")
_CONTENTS = lambda key, value: f"transform(filter(nodes, x -> x.tag = 'meta' AND lower({attribute('x.attrs', key)}) = '{value}'), x -> {_value('x', 'content')})"


def with_language(df: DataFrame, html: str = "html") -> DataFrame:
    """df with `language`: what a page declares on its root, else as a header, else by name; null where it declares none."""
    df = fenced(with_tree(df, html), __said=f"concat(array({_HTML_LANG.format(html=f'`{html}`')}), {_CONTENTS('http-equiv', 'content-language')}, {_CONTENTS('name', 'language')})")
    said = F.filter("__said", lambda x: C.strip(x) != "")
    return df.withColumn("language", C.normalize_language(F.get(said, F.lit(0)))).drop("texts", "nodes", "__said")


def matches_language(language, target: str) -> Column:
    """Whether a page with a declared language (a column) can be in the target language: so are those that declare none."""
    own = C.normalize_language(language)
    return F.coalesce((own == "") | (own == C.normalize_language(F.lit(target))), F.lit(True))


_CLASSES = "split({x}, '\\\\s+')".format(x=attribute("x.attrs", "class"))
_RANK = (
    "CASE " + " ".join(f"WHEN {attribute('x.attrs', 'id')} = '{k}' THEN {n}" for n, k in enumerate(P.COMMENT_IDS))
    + " " + " ".join(f"WHEN array_contains({_CLASSES}, '{k}') THEN {n}" for n, k in enumerate(P.COMMENT_CLASSES, len(P.COMMENT_IDS))) + " END"
)
_CLEAN = f"trim(regexp_replace({node_text('x')}, {lit(C.SPACE + '+')}, ' '))"
_LIKE = f"({attribute('x.attrs', 'id')} RLIKE {lit(R.COMMENT_ID.pattern)} OR {attribute('x.attrs', 'class')} RLIKE {lit(R.COMMENT_CLASS.pattern)})"


def with_comments(df: DataFrame, html: str = "html") -> DataFrame:
    """df with `comments`: struct<pre, tag, text> of the element that holds a page's comments, null without one.

    First come the known ids and classes, in their order; else the element of the body with
    the longest text (of equal ones the first) among those whose id or class is like them."""
    df = fenced(with_tree(df, html), __body=BODY)
    df = fenced(df, __known=f"array_min(filter(transform(filter(nodes, x -> x.attrs <> ''), x -> struct({_RANK} AS rank, x.pre AS pre)), y -> y.rank IS NOT NULL)).pre")
    like = f"filter(nodes, x -> x.attrs <> '' AND x.pre > __body.pre AND x.pre <= __body.post AND {_LIKE})"
    df = fenced(df, __at=f"coalesce(__known, -array_max(transform({like}, x -> struct(octet_length({_CLEAN}) AS n, -x.pre AS pre))).pre)")
    df = fenced(df, comments=f"IF(__at IS NULL, NULL, transform(array(nodes[__at]), x -> struct(x.pre AS pre, x.tag AS tag, {_CLEAN} AS text))[0])")
    return df.drop("texts", "nodes", "__body", "__known", "__at")
