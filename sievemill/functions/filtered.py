"""The filtered text of a page as a column over its measured tree (see tree.py): which elements are kept, and their text with paragraph breaks. No Python runs on the executors.

An element goes, with all in it, if it never holds content, has a boilerplate name, is a
header or footer outside of articles, is dense in links, repeats the page's title or is a
share text. A table with rows and columns gives one line a row; one for layout gives what
it holds. What is left becomes pieces (breaks by element, texts behind tags), sorted into
document order and joined, so a page of n tags costs n log n and n times its top-level
removals.

Null pages have no text (null), empty ones an empty text. Not modelled: what tree.py leaves
out; text split by a tag that the parser ignores gets a blank there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import profiles as P
from ..operators import rules as R
from . import columns as C
from . import tables as T
from .content import BODY, any_word, boilerplate, link_dense, table_link_dense
from .metadata import _cleaned, _fence, _spaced
from .tree import HEADINGS, among, attribute, below, fenced, lit, with_measures, with_tree, within

# ---------------------------------------------------------------- fixed values
HEADLINE = ("entry-title", "post-title", "article-title", "story-title", "pg-headline", "headline")
PARAGRAPHS = ("p", "div", "section", "article", *HEADINGS)
LINES = ("br", "li")
SHORT_P, SHORT_DIV = 50, 80  # bytes under which a paragraph or div can be a share text

_SUMS = {"rows": "IF(x.tag = 'tr', 1, 0)", "cells": "IF(x.tag IN ('td', 'th'), 1, 0)"}
_OUT = lambda v: f"({v} <> '' AND ({any_word(f'lower({v})', R.ALWAYS_OUT)} OR {boilerplate(v)}))"
_NAMED_OUT = f"({_OUT('x.class')} OR {_OUT('x.id')} OR contains(lower({attribute('x.attrs', 'itemtype')}), 'breadcrumblist'))"
LAYOUT = f"(lower({attribute('x.attrs', 'role')}) = 'presentation' OR {below('x', 'rows')} <= 1 OR {below('x', 'cells')} <= 1)"
_HEADING = among("x.tag", HEADINGS)
#: the text by which an element is judged: a heading's, or that of a short paragraph or div
_SAID = f"CASE WHEN {_HEADING} THEN {_cleaned('x')} WHEN x.tag = 'p' AND x.bytes < {SHORT_P} OR x.tag = 'div' AND x.bytes < {SHORT_DIV} THEN {_spaced('x')} END"
_BY_TEXT = f"(__share[x.pre] AND ({_HEADING} OR octet_length(__said[x.pre]) < IF(x.tag = 'p', {SHORT_P}, {SHORT_DIV})))"
_BY_HEADING = f"({_HEADING} AND ({any_word('lower(x.class)', HEADLINE)} OR lower({attribute('x.attrs', 'itemprop')}) = 'headline' OR (x.tag = 'h1' AND __same[x.pre])))"
_BY_PLACE = f"({among('x.tag', sorted(P.NEVER))} OR (x.tag IN ('header', 'footer') AND NOT __within[x.pre]))"
_DENSE = f"IF(x.tag = 'table', {table_link_dense()}, x.tag IN ('div', 'ul', 'ol') AND {link_dense()})"
#: why an element goes: 1 for good, 2 for a table whose text takes its place
_GOES = f"CASE WHEN {_NAMED_OUT} OR {_BY_PLACE} OR {_BY_TEXT} OR {_BY_HEADING} OR {_DENSE} THEN 1 WHEN x.tag = 'table' AND NOT {LAYOUT} THEN 2 ELSE 0 END"

_TABLE = f"array_join(aggregate({T._ROWS}, {T._ZERO}, (s, r) -> {T._STEP}).lines, '\\n')"
_BREAK = f"CASE WHEN {among('x.tag', PARAGRAPHS)} THEN '\\n\\n' WHEN {among('x.tag', LINES)} THEN '\\n' ELSE '' END"
_PIECE = lambda k, order, said: f"struct({k} AS k, {order} AS order, {said} AS said)"


def with_filtered_text(df: DataFrame, html: str = "html", title: str | None = None, tables: bool = True, has_tree: bool = False) -> DataFrame:
    """df with `text`: what is kept of a page's body. title: the column of the page's title, which a first-level heading must not repeat. Without tables all that stands in one goes. has_tree: df already has texts and nodes of its pages, as with_tree makes them."""
    own = F.col(title).cast("string") if title else F.lit(None).cast("string")
    df = df.withColumn("__own", own)
    df = with_measures(df if has_tree else with_tree(df, html), "x.tag = 'head'", _SUMS)
    df = fenced(df, __body=BODY, __said=f"transform(nodes, x -> {_SAID})", __within=within("x.tag IN ('article', 'main')"))
    df = _fence(df, __share=F.transform("__said", lambda t: F.coalesce(C.is_share_text(t), F.lit(False))))
    df = _fence(df, __same=F.transform("__said", lambda t: F.coalesce(C.titles_match(t, F.col("__own")), F.lit(False))) if title else F.transform("__said", lambda t: F.lit(False)))
    goes = _GOES if tables else f"IF(x.tag = 'table', 1, {_GOES})"
    df = fenced(df, __goes=f"transform(nodes, x -> IF(x.gone, 1, IF(x.pre > __body.pre AND x.pre <= __body.post, {goes}, 0)))")
    df = fenced(df, __under=within("__goes[x.pre] > 0"))
    df = fenced(df, __tops="filter(nodes, x -> __goes[x.pre] > 0 AND NOT __under[x.pre] AND x.end > x.start)")
    kept = f"transform(filter(nodes, x -> x.pre > __body.pre AND x.pre <= __body.post AND NOT __under[x.pre] AND __goes[x.pre] = 0 AND {among('x.tag', (*PARAGRAPHS, *LINES))}), x -> {_PIECE('x.start', 'x.pre', _BREAK)})"
    lines = f"transform(filter(__tops, t -> __goes[t.pre] = 2), t -> {_PIECE('t.start', 't.pre', f'concat({lit(chr(10) * 2)}, {_TABLE}, {lit(chr(10) * 2)})')})"
    said = f"filter(transform(texts, (t, k) -> {_PIECE('CAST(k AS INT)', 'CAST(2147483647 AS INT)', "IF(t = '', '', concat(t, ' '))")}), y -> y.said <> '' AND y.k >= __body.start AND y.k < __body.end AND NOT exists(__tops, x -> x.start <= y.k AND y.k < x.end))"
    df = fenced(df, __pieces=f"array_sort(concat({kept}, {lines}, {said}))")
    df = _fence(df, text=C.normalize_text(F.array_join(F.transform("__pieces", lambda p: p["said"]), "")))
    return df.drop("texts", "nodes", "sums", "__own", "__body", "__said", "__share", "__same", "__within", "__goes", "__under", "__tops", "__pieces")
