"""Where a page's content is, as columns over measured trees (see tree.py): the scored node, the first node that the content rules accept, and elements dense in links. No Python runs on the executors.

All three see a page as cleaning leaves it (`clean`): without the elements that never hold
content, and without footers outside of articles.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from ..operators import profiles as P
from ..operators import rules as R
from .tree import among, attribute, below, fenced, let, lit, with_measures, with_tree, within

CANDIDATES = ("div", "section", "article", "main")
LEAST_CONTENT = 1000  # bytes
BODY = "get(filter(nodes, x -> x.tag = 'body'), 0)"
GONE = f"{among('x.tag', sorted(P.CLEAN - {'footer', 'head'}))} OR x.tag = 'head'"


# ---------------------------------------------------------------- names
def any_word(x: str, words) -> str:
    return f"{x} RLIKE {lit('|'.join(re.escape(w) for w in words))}"


_SIDEBAR = rf"(?:^|(?:^|[-_])(?:{'|'.join(R.SIDE)})[-_])sidebar(?:[-_]|$)"
_BOX = "|".join(sorted(R.AUTHOR_BOX))
_TOKEN = rf"{_SIDEBAR}|^author$|(?:^|[-_])(?:{_BOX})[-_]author(?:[-_]|$)|(?:^|[-_])author[-_](?:{_BOX})(?:[-_]|$)|(?:^|(?<!(?:^|[-_])elementor)[-_])widget(?:[-_]|$)"


def boilerplate(x: str) -> str:
    """SQL: whether a class or id names boilerplate, by one of its words or a first word that means advertising."""
    names = rf"{R.NAVIGATION.pattern}|{R.JUNK_OR_COMMENT.pattern}"
    told = "IF(y RLIKE '^[lc]-', regexp_replace(y, 'sidebar|social', ''), y)"
    return f"({x} <> '' AND (exists(split({x}, '\\\\s+'), y -> y RLIKE {lit(_TOKEN)} OR {told} RLIKE {lit(names)}) OR split({x}, '[^0-9A-Za-z]')[0] RLIKE {lit(R.ADVERT.pattern)}))"


def around_boilerplate(x: str) -> str:
    """SQL: whether a class says that what stands inside is not main content."""
    bounded = rf"(?:^|[ \-_.])(?:{'|'.join(R.AROUND)})(?:[ \-_.]|$)"
    words = " OR ".join(rf"(lower({x}) RLIKE {lit(rf'(?:^|[^\p{{L}}\p{{N}}_-]){w}(?:[^\p{{L}}\p{{N}}]|$)')} AND NOT lower({x}) RLIKE {lit(rf'js[-_]{w}(?![a-z0-9])')})" for w in sorted(R.AROUND_WORDS))
    side = f"exists(split(lower({x}), '\\\\s+'), y -> y RLIKE {lit(_SIDEBAR)})"
    return f"({x} <> '' AND (lower({x}) RLIKE {lit(bounded)} OR {words} OR {side}))"


def name_score(x: str) -> str:
    """SQL: 25 for each good name part in a node's class and id, -25 for each bad one."""
    both = f"lower(concat({x}.class, ' ', {x}.id))"
    count = lambda words: " + ".join(f"IF(contains(b_, {lit(w)}), 1, 0)" for w in words)
    return f"IF({x}.class = '' AND {x}.id = '', 0, {let(both, 'b_', f'25 * ({count(R.GOOD_NAMES)} - ({count(R.BAD_NAMES)}))')})"


# ---------------------------------------------------------------- rules of content
_FIELDS = {R.cls: "{x}.class", R.ident: "{x}.id", R.low_cls: "lower({x}.class)", R.low_ident: "lower({x}.id)", R.joined: "concat({x}.id, {x}.class)"}


def _field(field, x: str) -> str:
    return _FIELDS[field].format(x=x) if field in _FIELDS else attribute(f"{x}.attrs", field.attribute)


def _test(test, x: str) -> str:
    how, field, words = test.says
    value = _field(field, x)
    if how == "filled":
        return f"{value} <> ''"
    if how == "equals":
        return among(value, words)
    return f"{value} RLIKE {lit(('^' if how == 'starts' else '') + '(?:' + '|'.join(re.escape(w) for w in words) + ')')}"


def holds(rule: R.Rule, x: str) -> str:
    tags = among(f"{x}.tag", rule.tags) if rule.tags else "true"
    return f"({tags} AND {x}.attrs <> '' AND ({' OR '.join(_test(t, x) for t in rule.tests)}))" if rule.tests else f"({tags})"


def content_rules(x: str) -> list[str]:
    """SQL of the six rules, in order."""
    names = f"lower(concat({x}.id, ' ', {x}.class))"
    return [
        f"({holds(R.CONTENT[0], x)} OR {holds(R.STORY_CELL, x)})",
        *(holds(rule, x) for rule in R.CONTENT[1:4]),
        f"({x}.tag = 'main' OR {holds(R.MAIN, x)})",
        f"({among(f'{x}.tag', ('div', 'section', 'td'))} AND contains({names}, 'content') AND NOT {any_word(names, R.NOT_CONTENT)})",
    ]


_NESTED = ("content_main", "content-main", "article-content", "article_content", "post-content", "post_content", "story-content", "blogInner__content", "blog-content", "blog_content", "blogContent", "entry-content")
_SPECIFIC = ("content_main", "content-main", "article-body", "article-content", "entry-content", "post-content")
_BESIDE = ("sidebar", "social", "share-", "-share", "author-", "sticky-", "toc-", "-toc", "related-", "widget")
_CONTENT_SUMS = {
    "articles": "IF(x.tag = 'article', 1, 0)",
    "long_articles": f"IF(x.tag = 'article' AND x.bytes >= {LEAST_CONTENT}, 1, 0)",
    "named": f"IF(x.bytes >= {LEAST_CONTENT} AND ({any_word('x.class', _NESTED)} OR {attribute('x.attrs', 'itemprop')} = 'articleBody'), 1, 0)",
    "beside": f"IF(x.tag IN ('aside', 'nav') OR {any_word('x.class', _BESIDE)}, 1, 0)",
    "specific": f"IF(x.tag = 'article' AND {any_word('x.class', _SPECIFIC)}, 1, 0)",
}


# ---------------------------------------------------------------- operators
def clean(df: DataFrame, html: str = "html", sums: dict[str, str] | None = None) -> DataFrame:
    """df with texts, nodes and sums of its pages as cleaning leaves them."""
    df = with_tree(df, html)
    df = fenced(df, __kept=within("x.tag IN ('article', 'main')"))
    return with_measures(df, f"{GONE} OR (x.tag = 'footer' AND NOT __kept[x.pre])", sums).drop("__kept")


def _depth(x: str) -> str:
    return f"({x}.depth - 3)"  # elements between it and body


_DENSITY = f"IF(x.clean > 0, {below('x', 'a_clean')} / x.clean, 1D)"
_PLAIN = f"least(x.clean, 8000) + 200 * {below('x', 'p')} + 100 * {below('x', 'h')} + 300 * {below('x', 'p100')} + 50 * least(x.sentences, least(x.clean, 8000) div 50) + IF(x.tag = 'body', 0, 10 * {_depth('x')}) + {name_score('x')}"
SCORE = let(f"struct({_PLAIN} AS s, {_DENSITY} AS d)", "z_", "CAST(CASE WHEN z_.d > 0.5 THEN z_.s * (1 - z_.d) WHEN z_.d > 0.25 THEN z_.s * (1 - z_.d * 0.5) ELSE z_.s END AS BIGINT)")


def content_scores(df: DataFrame, html: str = "html", least: int = 1000) -> DataFrame:
    """df with `scores`: array<struct<score, order, pre, tag, class, clean>> of a page's candidates (div, section, article, main with a name that isn't boilerplate and some text, and body where the page has 500 bytes at most), and `content`: the best one (struct with coverage, its share of the body's text), null if its score is under `least` or its coverage under 0.3.

    Of equal scores body goes first, then div, section, article, main, and then the first in the page."""
    df = fenced(clean(df, html), __body=BODY)
    order = "CASE x.tag WHEN 'body' THEN 0 " + " ".join(f"WHEN '{t}' THEN {k}" for k, t in enumerate(CANDIDATES, 1)) + " END"
    # a div outranks body only by a greater score, and so on: the least order first
    candidate = f"NOT x.gone AND x.clean > 0 AND (({among('x.tag', CANDIDATES)} AND NOT {boilerplate('x.class')} AND NOT {boilerplate('x.id')}) OR (x.tag = 'body' AND x.clean <= 500))"
    df = fenced(df, __candidates=f"filter(nodes, x -> {candidate})")
    df = fenced(df, scores=f"transform(__candidates, x -> struct({SCORE} AS score, {order} AS order, x.pre AS pre, x.tag AS tag, x.class AS class, x.clean AS clean))")
    best = "array_max(transform(scores, x -> struct(x.score AS score, -x.order AS order, -x.pre AS pre, x.tag AS tag, x.class AS class, x.clean AS clean)))"
    df = fenced(df, __best=f"transform(array({best}), x -> struct(x.score AS score, -x.pre AS pre, x.tag AS tag, x.class AS class, x.clean / __body.clean AS coverage))[0]")
    df = fenced(df, content=f"IF(__best.score >= {least} AND __best.coverage >= 0.3, __best, NULL)")
    return df.drop("__body", "__candidates", "__best", "texts", "nodes", "sums")


def find_content(df: DataFrame, html: str = "html") -> DataFrame:
    """df with `found`: struct<rule, pre, tag, class, bytes> of the first node, by rule and place in the page, that the six content rules accept, or its parent where that has the content; null if there is none.

    Not accepted: what stands inside header, nav, aside, footer or a class that means
    boilerplate; a div or section around both boilerplate and more specific content; a
    nameless article around a more specific one; less than 1000 bytes of trimmed text,
    unless the parent has more than twice as many."""
    df = fenced(clean(df, html, _CONTENT_SUMS), __body=BODY)
    df = fenced(df, __inside=within(f"x.pre > __body.pre AND x.pre <= __body.post AND NOT x.gone AND ({among('x.tag', ('header', 'nav', 'aside', 'footer'))} OR {around_boilerplate('x.class')})"))
    rules = ", ".join(f"IF({sql}, {k}, NULL)" for k, sql in enumerate(content_rules("x"), 1))
    named = f"transform(filter(nodes, x -> NOT x.gone AND x.pre > __body.pre AND x.pre <= __body.post AND NOT __inside[x.pre]), x -> struct(x AS x, filter(array({rules}), k -> k IS NOT NULL) AS rules))"
    df = fenced(df, __named=f"filter({named}, y -> size(y.rules) > 0)")
    nested = f"IF({below('y.x', 'articles')} > 1, {below('y.x', 'long_articles')} > 0, {below('y.x', 'named')} > 0)"
    wrapper = f"{nested} AND ((y.x.tag IN ('div', 'section') AND {below('y.x', 'beside')} > 0) OR (y.x.tag = 'article' AND y.x.class = '' AND {below('y.x', 'specific')} > 0))"
    up = "nodes[y.x.parent]"
    chosen = f"CASE WHEN {wrapper} THEN NULL WHEN y.x.bytes >= {LEAST_CONTENT} THEN y.x WHEN y.x.parent >= __body.pre AND NOT __inside[y.x.parent] AND {up}.bytes > 2 * y.x.bytes AND {up}.bytes >= {LEAST_CONTENT} THEN {up} END"
    taken = f"filter(transform(__named, y -> struct(array_min(y.rules) AS rule, y.x.pre AS place, {chosen} AS x)), y -> y.x IS NOT NULL)"
    df = fenced(df, __first=f"array_min(transform({taken}, y -> struct(y.rule AS rule, y.place AS place, y.x.pre AS pre, y.x.tag AS tag, y.x.class AS class, y.x.bytes AS bytes)))")
    df = fenced(df, found="IF(__first IS NULL, NULL, struct(__first.rule, __first.pre, __first.tag, __first.class, __first.bytes))")
    return df.drop("__body", "__inside", "__named", "__first", "texts", "nodes", "sums")


def link_dense(precision: bool = False) -> str:
    """SQL: whether a node x is rich in links and so most likely boilerplate."""
    later = "(sums[nodes[x.parent].post + 1].n - sums[x.post + 1].n > 0)"  # another element follows under its parent
    links, used, short, length = (below("x", k) for k in ("a", "a_used", "a_short", "a_chars"))
    limit = f"CASE WHEN x.tag = 'p' THEN IF({later}, 30, 60) ELSE IF({later}, 100, 300) END"
    one = f"({links} = 1 AND {length} > {10 if precision else 100} AND {length} > x.chars * 0.9D)"
    small = f"(x.chars < {limit} AND ({used} = 0 OR {length} > x.chars * 0.8D OR ({used} > 1 AND {short} / {used} > 0.8D)))"
    large = f"({links} >= 5 AND x.tag <> 'p' AND {below('x', 'p')} = 0 AND {used} > 0 AND {length} / greatest(x.chars, 1) > 0.5D AND {short} / {used} > 0.5D)"
    return f"({links} > 0 AND ({one} OR {small} OR {large}))"


def table_link_dense() -> str:
    """SQL: the same for a table x, by share of link text."""
    used, length = below("x", "a_used"), below("x", "a_chars")
    return f"({below('x', 'a')} > 0 AND x.chars >= 200 AND ({used} = 0 OR {length} > x.chars * IF(x.chars < 1000, 0.8D, 0.5D)))"


def link_density(df: DataFrame, html: str = "html", tags=("div", "ul", "ol", "li", "p", "nav", "section", "article", "table"), precision: bool = False, cleaned: bool = False) -> DataFrame:
    """df with `dense`: array<struct<pre, tag, chars, links, link_chars>> of the elements of `tags` that are dense in links (tables by the rule for tables), in document order."""
    df = clean(df, html) if cleaned else with_measures(with_tree(df, html), "x.tag IN ('head', 'script', 'style')")
    rule = f"IF(x.tag = 'table', {table_link_dense()}, {link_dense(precision)})"
    df = fenced(df, dense=f"transform(filter(nodes, x -> NOT x.gone AND {among('x.tag', tags)} AND {rule}), x -> struct(x.pre AS pre, x.tag AS tag, x.chars AS chars, {below('x', 'a')} AS links, {below('x', 'a_chars')} AS link_chars))")
    return df.drop("texts", "nodes", "sums")
