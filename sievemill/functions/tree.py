"""Document trees as a column: interval-encoded nodes, made and measured inside Catalyst.

`with_tree` cuts the source with one regular expression and folds the tags with an explicit
stack (implied end tags, void elements, implied head, body, tbody and tr). A page becomes

* `texts`: the text behind each tag, array<string>, and
* `nodes`: array<struct<pre, post, parent, depth, tag, attrs, start, end>> in document
  order; `pre` is a node's place in the array, `post` that of its last descendant, and its
  text is texts[start, end). "Below" is pre < x <= post, so containment needs no join.

`with_measures` adds what running sums at pre and post give for every subtree: bytes of
clean text, sentences, trimmed length, links and their lengths, paragraphs, headings.

Folds append to an array of one block of items and hand whole blocks on, so a page of n
tags costs n * (BLOCK + n / BLOCK) pointer copies, not n * n.

Not modelled: formatting that a closed block leaves open is not opened again; what a table
can't hold stays where it stands; a tag inside a title or textarea counts as a tag; named
character references other than those of NAMED stay as they are. A null page has no nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import SPACE

BLOCK = 256

# ---------------------------------------------------------------- fixed values
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
HEAD_ONLY = ("title", "meta", "link", "script", "style", "base", "noscript", "template")
FORMATTING = ("a", "b", "big", "code", "em", "font", "i", "nobr", "s", "small", "strike", "strong", "tt", "u")
CLOSES_P = ("address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "ul", "dd", "dt")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
SCOPE = ("html", "table", "td", "th", "caption", "marquee", "object", "template", "applet")
TABULAR = ("table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption")
ROWS = ("thead", "tbody", "tfoot", "tr", "td", "th")
#: tag -> open tags that it ends, tags at which the search for them stops, whether only the nearest one ends
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu"), True),
    "dd": (("dd", "dt"), ("dl",), True),
    "dt": (("dd", "dt"), ("dl",), True),
    "option": (("option",), ("select",), True),
    "a": (("a",), (*CLOSES_P, *SCOPE), True),
    "tr": (("tr", "td", "th"), ("table",), False),
    "td": (("td", "th"), ("table", "tr"), False),
    "th": (("td", "th"), ("table", "tr"), False),
    "tbody": (ROWS, ("table",), False),
    "tfoot": (ROWS, ("table",), False),
    "thead": (ROWS, ("table",), False),
}
NAMED = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&reg;", "®"), ("&trade;", "™"), ("&hellip;", "…"), ("&mdash;", "—"), ("&ndash;", "–"), ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&ldquo;", "“"), ("&rdquo;", "”"), ("&bull;", "•"), ("&middot;", "·"), ("&laquo;", "«"), ("&raquo;", "»"), ("&euro;", "€"), ("&amp;", "&"))

_SILENT = r"(?is)(?=<)(?:<!--(?:>|->|.*?(?:--!?>|\z))|(<(script|style|xmp|iframe|noembed|noframes)(?=[\s/>])[^>]*>).*?(</\2(?=[\s/>])[^>]*>|\z)|<[!?][^>]*(?:>|\z)|</[^a-zA-Z>][^>]*(?:>|\z)|</>)"
_NAME = r"([a-zA-Z][^\t\n\r\f />\x00]*)"
_TAG = rf"""<(/?){_NAME}((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?){_NAME}([^>]*)>"""
_MARK, _PART = "\x01", "\x02"


# ---------------------------------------------------------------- SQL pieces
def lit(x: str) -> str:
    """A SQL string literal."""
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def strings(xs) -> str:
    return f"array({', '.join(map(lit, xs))})" if xs else "CAST(array() AS array<string>)"


def among(x: str, xs) -> str:
    return f"{x} IN ({', '.join(map(lit, xs))})"


def let(value: str, name: str, body: str) -> str:
    """body with name for the value, which is evaluated once. The end of a fold over nothing: transform would copy what body gives with all that is in it, a fold's whole state at each step."""
    return f"aggregate(array(), {value}, (same_, none_) -> same_, {name} -> {body})"


def scan(items: str, zero: str, step: str) -> str:
    """Running states of a fold, the first one included: one more than there are items. step(acc, x) gives the next state."""
    inner = f"aggregate(slice({items}, b * {BLOCK} + 1, {BLOCK}), struct(o.acc AS acc, slice(array(o.acc), 1, 0) AS got), (acc_, x) -> {let(step.replace('{acc}', 'acc_.acc'), 'new_', 'struct(new_ AS acc, array_append(acc_.got, new_) AS got)')})"
    blocks = f"sequence(0, (size({items}) - 1) div {BLOCK})"
    outer = f"aggregate({blocks}, struct({zero} AS acc, array(array({zero})) AS got), (o, b) -> {let(inner, 'i_', 'struct(i_.acc AS acc, array_append(o.got, i_.got) AS got)')}, o -> flatten(o.got))"
    return f"IF(size({items}) > 0, {outer}, array({zero}))"


def attribute(x: str, name: str) -> str:
    """The value of an attribute in a start tag's text, '' without it."""
    pattern = lit(rf"""(?is)(?:^|[\s"'/]){name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']*))""")
    return f"IF(contains(lower({x}), {lit(name)}), concat(regexp_extract({x}, {pattern}, 1), regexp_extract({x}, {pattern}, 2), regexp_extract({x}, {pattern}, 3)), '')"


def decoded(t: str) -> str:
    """Text with character references replaced: those of NAMED, some also without their semicolon, and numbers."""
    x = f"regexp_replace({t}, '&(lt|gt|quot|copy|reg|nbsp|amp)(?!;)', '&$1;')"
    number = "(n_, r) -> replace(n_, r, decode(unhex(lpad(hex(CAST(IF(r ILIKE '&#x%', conv(regexp_extract(r, '&#[xX]([0-9a-fA-F]+)', 1), 16, 10), regexp_extract(r, '&#([0-9]+)', 1)) AS BIGINT)), 8, '0')), 'UTF-32'))"
    x = f"aggregate(array_distinct(regexp_extract_all({x}, '&#(?:[1-9][0-9]{{1,4}}|[xX][0-9a-fA-F]{{1,4}});', 0)), {x}, {number})"
    for entity, raw in NAMED:
        x = f"replace({x}, {lit(entity)}, {lit(raw)})"
    return f"IF(contains({t}, '&'), {x}, {t})"


# ---------------------------------------------------------------- the fold
def _implied(field: int, of) -> str:
    return "CASE e_tag " + " ".join(f"WHEN {lit(t)} THEN {of(v[field])}" for t, v in IMPLIED.items())


_EVENT = f"""struct(i AS i, e_close AS close, e_tag AS tag, e_attrs AS attrs, {among('e_tag', VOID)} AS void, {among('e_tag', HEAD_ONLY)} AS head, {among('e_tag', FORMATTING)} AS fmt,
 {among('e_tag', CLOSES_P)} AS block, {among('e_tag', HEADINGS)} AS heading, {among('e_tag', TABULAR)} AS tabular, e_says AS says, {_implied(0, strings)} ELSE {strings(())} END AS ends, {_implied(1, strings)} ELSE {strings(())} END AS stops, {_implied(2, lambda x: str(x).lower())} ELSE true END AS nearest)"""


def _event() -> str:
    x = _EVENT
    for name, value in (("e_close", "t.close"), ("e_tag", "t.tag"), ("e_attrs", "t.attrs"), ("e_says", "t.says")):
        x = x.replace(name, value)
    return x


_NO = "CAST(array() AS array<string>)"
_plan = lambda cut, names=_NO, own="0", dead="0": f"struct(CAST({cut} AS INT) AS cut, {names} AS names, CAST({own} AS INT) AS own, CAST({dead} AS INT) AS dead)"
_SIZE = "size(s.tags)"
_STAY = _plan(_SIZE)
_OWN = "IF(e.void, 2, 1)"
_first = lambda tags, among_: f"array_min(filter(transform({among_}, y -> CAST(array_position({tags}, y) AS INT)), q -> q > 0))"

_IN_HEAD = f"""CASE WHEN e.close THEN CASE WHEN e.tag = 'head' THEN {_plan(1, "array('body')")}
 WHEN {_SIZE} > 2 AND element_at(s.tags, -1) = e.tag THEN IF({_SIZE} = 3 AND e.says, {_plan(1, "array('body')")}, {_plan(f'{_SIZE} - 1')}) ELSE {_STAY} END
 WHEN e.tag = 'head' THEN {_STAY} WHEN e.tag = 'body' THEN {_plan(1, own='1')}
 WHEN e.head AND ({_SIZE} = 2 OR e.tag IN ('meta', 'link')) THEN {_plan(_SIZE, own=_OWN)} ELSE {_plan(1, "array('body')", _OWN)} END"""

#: q: how far from the top the element stands that the end tag closes
_CLOSE = f"""CASE WHEN e.tag = 'br' OR (e.tag = 'p' AND NOT array_contains(s.tags, 'p')) THEN {_plan(_SIZE, own='2')}
 ELSE {let(f"IF(e.heading, {_first('reverse(s.tags)', strings(HEADINGS))}, CAST(array_position(reverse(s.tags), e.tag) AS INT))", 'q_',
 f"CASE WHEN coalesce(q_, 0) = 0 OR {_SIZE} - q_ < 2 THEN {_STAY} "
 f"WHEN e.fmt AND arrays_overlap(slice(s.tags, {_SIZE} - q_ + 2, q_ - 1), {strings((*CLOSES_P, *SCOPE))}) THEN {_plan(_SIZE, dead=f'{_SIZE} - q_ + 1')} "
 f"WHEN NOT e.fmt AND NOT e.tabular AND arrays_overlap(slice(s.tags, {_SIZE} - q_ + 2, q_ - 1), {strings(SCOPE)}) THEN {_STAY} ELSE {_plan(f'{_SIZE} - q_')} END")} END"""

_P_CUT = f"""IF(e.block AND array_contains(s.tags, 'p'), {let("CAST(array_position(reverse(s.tags), 'p') AS INT)", 'q_', f"IF(arrays_overlap(slice(s.tags, {_SIZE} - q_ + 2, q_ - 1), {strings((*SCOPE, 'button'))}), {_SIZE}, {_SIZE} - q_)")}, {_SIZE})"""
_UNDER = f"(c_ - coalesce({_first('reverse(t_)', 'e.stops')} - 1, c_))"  # place of the nearest stop, 0 without one
_ENDED = let("slice(s.tags, 1, c_)", "t_", f"IF(arrays_overlap(t_, e.ends), {let(_UNDER, 'u_', let('slice(t_, u_ + 1, c_ - u_)', 'v_', f'IF(e.nearest, c_ - coalesce({_first('reverse(v_)', 'e.ends')}, 0), u_ - 1 + coalesce({_first('v_', 'e.ends')}, c_ - u_ + 1))'))}, c_)")
_MADE = "CASE WHEN e.tag = 'tr' AND s.tags[d_ - 1] = 'table' THEN array('tbody') WHEN e.tag IN ('td', 'th') AND s.tags[d_ - 1] = 'table' THEN array('tbody', 'tr') WHEN e.tag IN ('td', 'th') AND s.tags[d_ - 1] IN ('tbody', 'thead', 'tfoot') THEN array('tr') ELSE CAST(array() AS array<string>) END"
_START = let(_P_CUT, "b_", let(f"IF(e.heading AND {among('s.tags[b_ - 1]', HEADINGS)}, b_ - 1, b_)", "c_", let(f"IF(size(e.ends) > 0, {_ENDED}, c_)", "d_", _plan("d_", f"IF(e.tabular, {_MADE}, {_NO})", _OWN))))

_NODE = lambda x, post, end: f"struct({x}.pre AS pre, CAST({post} AS INT) AS post, {x}.parent AS parent, {x}.depth AS depth, {x}.tag AS tag, {x}.attrs AS attrs, {x}.start AS start, CAST({end} AS INT) AS end)"
_ALIVE = "IF(p_.cut < size(s.tags) AND array_contains(s.tags, ''), array_max(filter(sequence(1, p_.cut), z -> s.tags[z - 1] <> '')), p_.cut)"
_NEW = """transform(concat(p_.names, IF(p_.own > 0, array(e.tag), CAST(array() AS array<string>))), (y, k) -> struct(CAST(s.n + k AS INT) AS pre, y AS tag, IF(p_.own > 0 AND k = size(p_.names) AND NOT e.close, e.attrs, '') AS attrs, CAST(IF(k = 0, s.stack[k_ - 1].pre, s.n + k - 1) AS INT) AS parent, CAST(s.stack[k_ - 1].depth + 1 + k AS INT) AS depth, e.i AS start))"""
_MOVED = f"""struct(concat(slice(s.stack, 1, k_), IF(p_.own = 2, slice(m_, 1, size(m_) - 1), m_)) AS stack,
 IF(p_.dead > 0, transform(s.tags, (y, k) -> IF(k = p_.dead - 1, '', y)), concat(slice(s.tags, 1, k_), p_.names, IF(p_.own = 1, array(e.tag), {_NO}))) AS tags,
 CAST(s.n + size(m_) AS INT) AS n,
 concat(s.out, transform(slice(s.stack, k_ + 1, {_SIZE}), y -> {_NODE('y', 's.n - 1', 'e.i')}), IF(p_.own = 2, transform(slice(m_, size(m_), 1), y -> {_NODE('y', 'y.pre', 'e.i')}), slice(s.out, 1, 0))) AS out)"""
_STEP = let(f"CASE WHEN s.tags[1] = 'head' THEN {_IN_HEAD} WHEN e.tag IN ('head', 'body') THEN {_STAY} WHEN e.close THEN {_CLOSE} ELSE {_START} END", "p_", f"IF(p_.cut = {_SIZE} AND p_.own = 0 AND size(p_.names) = 0 AND p_.dead = 0, s, {let(_ALIVE, 'k_', let(_NEW, 'm_', _MOVED))})")
_OPEN = "struct(CAST({pre} AS INT) AS pre, '{tag}' AS tag, '' AS attrs, CAST({parent} AS INT) AS parent, {depth} AS depth, 0 AS start)"
_ROOTS = f"array({_OPEN.format(pre=0, tag='html', parent=-1, depth=1)}, {_OPEN.format(pre=1, tag='head', parent=0, depth=2)})"
_NONE = f"slice(transform({_ROOTS}, y -> {_NODE('y', '0', '0')}), 1, 0)"
_ZERO = f"struct({_ROOTS} AS stack, array('html', 'head') AS tags, 2 AS n, {_NONE} AS out)"
#: blocks of events: the state goes on, the nodes closed in a block are set aside
_FOLD = f"""aggregate(sequence(0, greatest(size(__events) - 1, 0) div {BLOCK}), struct({_ZERO} AS s, array({_NONE}) AS done),
 (o, b) -> {let(f"aggregate(slice(__events, b * {BLOCK} + 1, {BLOCK}), struct(o.s.stack AS stack, o.s.tags AS tags, o.s.n AS n, {_NONE} AS out), (s, e) -> {_STEP})", 'r_', 'struct(r_ AS s, array_append(o.done, r_.out) AS done)')},
 o -> struct(flatten(o.done) AS done, o.s.stack AS stack, o.s.n AS n))"""
_HEADLESS = "__fold.stack[1].tag = 'head'"  # nothing has opened the body
_BODY = "array(struct(__fold.n AS pre, 'body' AS tag, '' AS attrs, 0 AS parent, 2 AS depth, CAST(size(texts) AS INT) AS start))"
_REST = f"transform(IF({_HEADLESS}, concat(__fold.stack, {_BODY}), __fold.stack), y -> {_NODE('y', f'__fold.n - 1 + IF({_HEADLESS} AND y.tag IN ({lit('html')}, {lit('body')}), 1, 0)', 'size(texts)')})"


def with_tree(df: DataFrame, html: str = "html") -> DataFrame:
    """df with texts and nodes of its pages. Columns of df with these names are replaced."""
    return with_nodes(with_texts(with_source(df, html))).drop("__source")


def with_source(df: DataFrame, html: str = "html") -> DataFrame:
    """df with __source: its pages with what is silent taken out, and each tag marked as such in four parts (close, name, attributes, the text behind it)."""
    df = df.drop("texts", "nodes").withColumn("__source", F.translate(F.col(html).cast("string"), _MARK + _PART, ""))
    df = df.withColumn("__source", F.expr(f"regexp_replace(regexp_replace(__source, {lit(_SILENT)}, '$1$3'), '(?s)<[a-zA-Z/!?][^>]*+\\\\z', '')"))
    return df.withColumn("__source", F.regexp_replace("__source", _TAG, f"{_MARK}$1$4{_PART}$2$5{_PART}$3$6{_PART}"))


def with_texts(df: DataFrame) -> DataFrame:
    """df (see with_source) with texts."""
    return fenced(fenced(df, __raw=f"transform(split(__source, '{_MARK}'), x -> substring_index(x, '{_PART}', -1))"), texts=f"transform(__raw, t -> {decoded('t')})").drop("__raw")


def markup(source: str) -> str:
    """SQL for what nodes depend on of a __source: each text by whether it says something (x) or not."""
    blank = f"regexp_replace(concat('{_PART}', {source}), {lit(f'{_PART}[{SPACE[1:-1]}]++(?=[{_MARK}]|\\z)')}, '{_PART}')"
    return f"substring(regexp_replace({blank}, {lit(f'{_PART}[^{_MARK}{_PART}]++(?=[{_MARK}]|\\z)')}, '{_PART}x'), 2)"


def with_nodes(df: DataFrame) -> DataFrame:
    """df (see with_texts) with nodes; none where __source is null."""
    cut = f"transform(split(__source, '{_MARK}'), x -> {let(f"split(x, '{_PART}')", 'c_', "IF(size(c_) < 4, struct(false AS close, '' AS tag, '' AS attrs, c_[0] AS text), struct(c_[0] = '/' AS close, lower(c_[1]) AS tag, c_[2] AS attrs, c_[3] AS text))")})"
    df = fenced(df, __tags=cut)
    said = f"t.text RLIKE {lit(f'[^{SPACE[1:-1]}]')}"
    kinds = f"transform(__tags, (t, i) -> struct(i AS i, t.close AS close, IF(i = 0 AND {said}, 'body', t.tag) AS tag, t.attrs AS attrs, t.close AND {said} AS says))"
    df = df.withColumn("__kinds", F.expr(f"filter({kinds}, t -> t.tag NOT IN ('', 'html') AND NOT (t.close AND t.tag = 'body'))"))
    df = fenced(df, __events=f"transform(__kinds, t -> {_event().replace('i AS i', 't.i AS i', 1)})")
    df = fenced(df, __fold=_FOLD)
    df = fenced(df, nodes=f"IF(__source IS NULL, NULL, array_sort(concat(__fold.done, {_REST})))")
    return df.drop("__tags", "__kinds", "__events", "__fold")


def fenced(df: DataFrame, **columns: str) -> DataFrame:
    """df with columns by SQL that the optimiser leaves where they are. A fold is dear, and a filter on its result (or explode, which brings one) would otherwise be pushed below it with a copy of the fold. What depends on the partition's number stays."""
    return df.withColumns({k: F.expr(f"IF(spark_partition_id() >= 0, {v}, NULL)") for k, v in columns.items()})


def node_text(x: str) -> str:
    """SQL for the text of a node x."""
    return f"array_join(slice(texts, {x}.start + 1, {x}.end - {x}.start), '')"


# ---------------------------------------------------------------- measures
_CHUNK = f"""transform(texts, t -> {let(f"trim(regexp_replace(t, {lit(SPACE + '+')}, ' '))", 'c_', "struct(t AS text, octet_length(c_) - (length(c_) - length(replace(c_, ' ', ''))) AS solid, IF(c_ = '', 0, 1 + length(c_) - length(replace(c_, ' ', ''))) AS words, regexp_count(c_, '[.!?]+') AS stops, t <> '' AS any, c_ <> '' AS says, "
    "c_ <> '' AND left(t, 1) = left(c_, 1) AS lead, c_ <> '' AND right(t, 1) = right(c_, 1) AS trail, left(t, 1) IN ('.', '!', '?') AS stop_lead, right(t, 1) IN ('.', '!', '?') AS stop_trail, length(t) AS chars, octet_length(t) AS bytes, "
    "IF(c_ = '', 0, instr(t, left(c_, 1)) - 1) AS blanks, IF(c_ = '', 0, instr(reverse(t), right(c_, 1)) - 1) AS after)")})"""
_AHEAD = scan("__chunks", "struct(0 AS solid, 0 AS words, 0 AS stops, false AS trail, false AS stop_trail, 0 AS chars, 0 AS bytes, 0 AS last, 0 AS last_b)", "struct({acc}.solid + x.solid AS solid, {acc}.words + x.words - IF({acc}.trail AND x.lead, 1, 0) AS words, {acc}.stops + x.stops - IF({acc}.stop_trail AND x.stop_lead, 1, 0) AS stops, IF(x.any, x.trail, {acc}.trail) AS trail, IF(x.any, x.stop_trail, {acc}.stop_trail) AS stop_trail, {acc}.chars + x.chars AS chars, {acc}.bytes + x.bytes AS bytes, IF(x.says, {acc}.chars + x.chars - x.after, {acc}.last) AS last, IF(x.says, {acc}.bytes + x.bytes - octet_length(right(x.text, x.after)), {acc}.last_b) AS last_b)")
_BACK = f"reverse({scan('__both', 'struct(false AS lead, false AS stop_lead, 0 AS first, 0 AS first_b)', 'struct(IF(x.c.any, x.c.lead, {acc}.lead) AS lead, IF(x.c.any, x.c.stop_lead, {acc}.stop_lead) AS stop_lead, IF(x.c.says, x.f.chars + x.c.blanks, {acc}.first) AS first, IF(x.c.says, x.f.bytes + octet_length(left(x.c.text, x.c.blanks)), {acc}.first_b) AS first_b)')})"


def _measured(x: str) -> str:
    a, b, r = f"__ahead[{x}.start]", f"__ahead[{x}.end]", f"__back[{x}.start]"
    any_ = f"{b}.bytes > {a}.bytes"
    words = f"({b}.words - {a}.words + IF({any_} AND {a}.trail AND {r}.lead, 1, 0))"
    stops = f"({b}.stops - {a}.stops + IF({any_} AND {a}.stop_trail AND {r}.stop_lead, 1, 0))"
    return let(words, "w_", f"struct({x}.pre AS pre, {x}.post AS post, {x}.parent AS parent, {x}.depth AS depth, {x}.tag AS tag, {x}.attrs AS attrs, {x}.start AS start, {x}.end AS end, {x}.gone AS gone, {attribute(f'{x}.attrs', 'class')} AS class, {attribute(f'{x}.attrs', 'id')} AS id, CAST(IF(w_ > 0, {b}.solid - {a}.solid + w_ - 1, 0) AS INT) AS clean, CAST({stops} AS INT) AS sentences, CAST(IF(w_ > 0, {b}.last - {r}.first, 0) AS INT) AS chars, CAST(IF(w_ > 0, {b}.last_b - {r}.first_b, 0) AS INT) AS bytes)")


#: what is summed over the nodes of a subtree
SUMS = {
    "n": "1",
    "p": "IF(x.tag = 'p', 1, 0)",
    "p100": "IF(x.tag = 'p' AND x.clean >= 100, 1, 0)",
    "h": f"IF({among('x.tag', HEADINGS)}, 1, 0)",
    "a": "IF(x.tag = 'a', 1, 0)",
    "a_clean": "IF(x.tag = 'a', x.clean, 0)",
    "a_chars": "IF(x.tag = 'a', x.chars, 0)",
    "a_used": "IF(x.tag = 'a' AND x.chars > 0, 1, 0)",
    "a_short": "IF(x.tag = 'a' AND x.chars BETWEEN 1 AND 9, 1, 0)",
}


def within(banned: str, nodes: str = "nodes") -> str:
    """SQL: for each node whether one of its ancestors is banned (a predicate of x): the farthest end of a banned node so far reaches it."""
    ends = scan(nodes, "-1", f"greatest({{acc}}, IF({banned}, x.post, -1))")
    return let(ends, "e_", f"transform({nodes}, (x, k) -> e_[k] >= x.pre)")


def with_measures(df: DataFrame, gone: str = "false", sums: dict[str, str] | None = None) -> DataFrame:
    """df (see with_tree) with measured nodes and `sums`: running sums over the nodes, one state more than nodes, so that sums[post + 1] - sums[pre + 1] is what stands below a node.

    gone: a predicate of a node x; such nodes and all below them are left out of texts and
    sums, and marked in the field gone. sums: further numbers of a node x to sum up. Each
    node gets class, id, clean (bytes of its text with white space collapsed), sentences
    (runs of . ! ?), chars and bytes (of its trimmed text)."""
    fields = SUMS | (sums or {})
    df = fenced(df, __within=within(f"({gone})"))
    df = fenced(df, nodes=f"transform(nodes, (x, k) -> struct(x.pre, x.post, x.parent, x.depth, x.tag, x.attrs, x.start, x.end, (__within[k] OR ({gone})) AS gone, ({gone}) AND NOT __within[k] AS top))")
    df = df.withColumn("__out", F.expr("filter(nodes, x -> x.top AND x.end > x.start)"))
    df = fenced(df, texts="IF(size(__out) > 0, transform(texts, (t, k) -> IF(exists(__out, x -> x.start <= k AND k < x.end), '', t)), texts)")
    df = fenced(fenced(df, __chunks=_CHUNK), __ahead=_AHEAD)
    df = fenced(fenced(df, __both="reverse(transform(__chunks, (c, k) -> struct(c AS c, __ahead[k] AS f)))"), __back=_BACK)
    df = fenced(df, nodes=f"transform(nodes, x -> {_measured('x')})")
    zero = "struct(" + ", ".join(f"0 AS {k}" for k in fields) + ")"
    step = "IF(x.gone, {acc}, struct(" + ", ".join(f"{{acc}}.{k} + {v} AS {k}" for k, v in fields.items()) + "))"
    df = fenced(df, sums=scan("nodes", zero, step))
    return df.drop("__within", "__out", "__chunks", "__ahead", "__both", "__back")


def below(x: str, field: str) -> str:
    """SQL: a running sum over what stands below node x."""
    return f"(sums[{x}.post + 1].{field} - sums[{x}.pre + 1].{field})"
