"""JSON-LD and JSON search as columns, on VARIANT: a recursive descent by levels, folded within the row.

A block is parsed once (try_parse_json; what doesn't parse is passed over). Each step of the
fold takes all values of one level to the values inside them, and each value carries the
path of positions that led to it, so that sorting by path gives document order again
(members of an object go by key). The fold has as many steps as the text has brackets at
most; steps on an empty level cost next to nothing. No Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import SPACES, parse_date
from .tree import among, let, lit

PERSON = ("person", "author", "reviewedby", "creator")
ORGANIZATION = ("organization", "newsmediaorganization", "website", "publisher")
ARTICLE = ("article", "newsarticle", "blogposting", "webpage", "report", "techarticle", "scholarlyarticle", "socialmediaposting")

_SCRIPT = r"""(?is)<script[^>]+type\s*=\s*["']?application/ld\+json["']?[^>]*>(.*?)</script"""


def blocks(html: str = "html") -> Column:
    """The texts of a page's JSON-LD scripts."""
    return F.regexp_extract_all(F.col(html), F.lit(_SCRIPT), F.lit(1))


# ---------------------------------------------------------------- SQL on variants
def _is(v: str, kind: str) -> str:
    return f"coalesce(schema_of_variant({v}) LIKE '{kind}%', false)"


def _trimmed(x: str) -> str:
    return f"trim(BOTH {lit(SPACES)} FROM {x})"


def _children(v: str) -> str:
    return f"CASE WHEN {_is(v, 'OBJECT')} THEN map_values(CAST({v} AS map<string, variant>)) WHEN {_is(v, 'ARRAY')} THEN CAST({v} AS array<variant>) ELSE CAST(array() AS array<variant>) END"


def _member(v: str, key: str) -> str:
    return f"try_variant_get({v}, {lit(f'$["{key}"]')}, 'variant')"


def _string(v: str) -> str:
    """A string, or an array's first item if that is one; trimmed, null if empty."""
    first = let("get(CAST(m_ AS array<variant>), 0)", "f_", f"IF({_is('f_', 'STRING')}, nullif({_trimmed('CAST(f_ AS string)')}, ''), NULL)")
    return let(v, "m_", f"CASE WHEN {_is('m_', 'STRING')} THEN nullif({_trimmed('CAST(m_ AS string)')}, '') WHEN {_is('m_', 'ARRAY')} THEN {first} END")


def _types(v: str) -> str:
    """Lower-case @type values of an object."""
    many = f"transform(filter(CAST(m_ AS array<variant>), t -> {_is('t', 'STRING')}), t -> lower(CAST(t AS string)))"
    return f"IF({_is(v, 'OBJECT')}, {let(_member(v, '@type'), 'm_', f"CASE WHEN {_is('m_', 'STRING')} THEN array(lower(CAST(m_ AS string))) WHEN {_is('m_', 'ARRAY')} THEN {many} ELSE CAST(array() AS array<string>) END")}, CAST(array() AS array<string>))"


_ANY = lambda types, known: f"exists({types}, t -> {among('t', known)})"
_STEPS = "sequence(0, greatest(0, 1 + length({text}) - length(translate({text}, '{{[', ''))))"
_FOUND = "struct(CAST(NULL AS variant) AS v, 0 AS importance, array(0) AS path, '' AS kind)"
_KIND = f"CASE WHEN {_ANY('y.types', PERSON)} THEN 'person' WHEN {_ANY('y.types', ORGANIZATION)} THEN 'organization' WHEN {_ANY('y.types', ARTICLE)} THEN 'article' ELSE '' END"


def _nodes(texts: str) -> str:
    """SQL: array<struct<kind, rank, path, v>> of the persons, organizations and articles in JSON texts, each kind by importance and then in document order. Importance: 100 for articles, else 50, less 10 for each typed object around it, 5 more if there is any."""
    start = f"filter(transform({texts}, (t, k) -> struct(try_parse_json({_trimmed('t')}) AS v, 0 AS depth, false AS inner, array(k) AS path)), x -> x.v IS NOT NULL)"
    typed = f"transform(s.level, x -> struct(x.v AS v, x.depth AS depth, x.inner AS inner, x.path AS path, {_types('x.v')} AS types))"
    found = f"transform(filter(l_, y -> size(y.types) > 0), y -> struct(y.v AS v, IF({_ANY('y.types', ARTICLE)}, 100, 50) - 10 * y.depth + IF(y.inner, 5, 0) AS importance, y.path AS path, {_KIND} AS kind))"
    below = f"flatten(transform(l_, y -> transform({_children('y.v')}, (c, k) -> struct(c AS v, IF(size(y.types) > 0, y.depth + 1, y.depth) AS depth, y.inner OR size(y.types) > 0 AS inner, array_append(y.path, k) AS path))))"
    step = f"IF(size(s.level) = 0, s, {let(typed, 'l_', f'struct({below} AS level, concat(s.found, filter({found}, y -> y.kind <> {lit('')})) AS found)')})"
    fold = f"aggregate({_STEPS.format(text=f'array_join({texts}, {lit('')})')}, struct({start} AS level, slice(array({_FOUND}), 1, 0) AS found), (s, i) -> {step}, s -> s.found)"
    order = "CASE WHEN a.importance <> b.importance THEN b.importance - a.importance WHEN a.path < b.path THEN -1 WHEN a.path > b.path THEN 1 ELSE 0 END"
    return f"array_sort({fold}, (a, b) -> {order})"


def _first(kind: str, value: str) -> str:
    return f"get(filter(transform(filter(n_, x -> x.kind = '{kind}'), x -> {value}), y -> y IS NOT NULL), 0)"


def _name(v: str) -> str:
    plain = lambda key: f"IF({_is(_member(v, key), 'STRING')}, {_trimmed(f'CAST({_member(v, key)} AS string)')}, '')"
    return f"coalesce(nullif({plain('name')}, ''), nullif({_trimmed(f"concat({plain('givenName')}, ' ', {plain('familyName')})")}, ''))"


def _image(v: str) -> str:
    url = lambda x: f"IF({_is(_member(x, 'url'), 'STRING')}, CAST({_member(x, 'url')} AS string), NULL)"
    one = lambda x: f"CASE WHEN {_is(x, 'STRING')} THEN CAST({x} AS string) WHEN {_is(x, 'OBJECT')} THEN {url(x)} END"
    return let(_member(v, "image"), "m_", f"CASE WHEN {_is('m_', 'ARRAY')} THEN {let('get(CAST(m_ AS array<variant>), 0)', 'f_', one('f_'))} ELSE {one('m_')} END")


def _keywords(v: str) -> str:
    many = f"transform(filter(CAST(m_ AS array<variant>), t -> {_is('t', 'STRING')}), t -> {_trimmed('CAST(t AS string)')})"
    parts = f"transform(split(CAST(m_ AS string), ','), t -> {_trimmed('t')})"
    got = let(_member(v, "keywords"), "m_", f"filter(CASE WHEN {_is('m_', 'STRING')} THEN {parts} WHEN {_is('m_', 'ARRAY')} THEN {many} ELSE CAST(array() AS array<string>) END, t -> t <> '')")
    return let(got, "k_", "IF(size(k_) > 0, k_, NULL)")


FIELDS = {
    "author": _first("person", _name("x.v")),
    "sitename": _first("organization", _name("x.v")),
    "title": _first("article", f"coalesce({_string(_member('x.v', 'headline'))}, {_string(_member('x.v', 'name'))})"),
    "description": _first("article", _string(_member("x.v", "description"))),
    "date_text": f"filter(transform(filter(n_, x -> x.kind = 'article'), x -> {_string(_member('x.v', 'datePublished'))}), y -> y IS NOT NULL)",
    "image": _first("article", _image("x.v")),
    "categories": f"coalesce({_first('article', _keywords('x.v'))}, CAST(array() AS array<string>))",
}


def harvest(texts: str) -> Column:
    """What JSON-LD texts (a column: array of strings) say of a page: struct<author, sitename, title, description, date_text (dates as written, best first), image, categories>. Null texts give null, texts that aren't JSON nothing."""
    return F.expr(f"IF({texts} IS NULL, NULL, {let(_nodes(texts), 'n_', 'struct(' + ', '.join(f'{v} AS {k}' for k, v in FIELDS.items()) + ')')})")


def first_date(dates: Column) -> Column:
    """The first of some dates as written that can be read: days, and times with or without a zone, as the standard writes them."""
    known = F.transform(dates, lambda d: F.when(d.rlike(r"^\d{4}-\d\d-\d\d(T\d\d:\d\d:\d\d.*)?$"), parse_date(d)))
    return F.get(F.filter(known, lambda d: d.isNotNull()), F.lit(0))


def json_strings(text: str, key: str) -> Column:
    """All strings under a key (in any case) of a JSON text, in document order, however deep; strings that hold an object or array are looked into as well (JSON in JSON). Null where the text is no JSON."""
    parsed = lambda v: f"IF({_is(v, 'STRING')} AND CAST({v} AS string) RLIKE '^\\\\s*[{{\\\\[]', coalesce(try_parse_json(CAST({v} AS string)), {v}), {v})"
    inside = f"""CASE WHEN {_is('x.v', 'OBJECT')} THEN transform(map_entries(CAST(x.v AS map<string, variant>)), (e, k) -> struct({parsed('e.value')} AS v, lower(e.key) = {lit(key.lower())} AS named, array_append(x.path, k) AS path))
 WHEN {_is('x.v', 'ARRAY')} THEN transform(CAST(x.v AS array<variant>), (e, k) -> struct({parsed('e')} AS v, false AS named, array_append(x.path, k) AS path)) ELSE s.none END"""
    here = f"transform(filter(s.level, x -> x.named AND {_is('x.v', 'STRING')}), x -> struct(x.path AS path, CAST(x.v AS string) AS said))"
    step = f"IF(size(s.level) = 0, s, struct(flatten(transform(s.level, x -> {inside})) AS level, concat(s.found, {here}) AS found, s.none AS none))"
    root = f"array(struct({parsed('p_')} AS v, false AS named, array(0) AS path))"
    fold = f"aggregate({_STEPS.format(text=text)}, struct({root} AS level, slice(array(struct(array(0) AS path, '' AS said)), 1, 0) AS found, slice({root}, 1, 0) AS none), (s, i) -> {step}, s -> transform(array_sort(s.found), y -> y.said))"
    return F.expr(let(f"try_parse_json({text})", "p_", f"IF(p_ IS NULL, NULL, {fold})"))
