"""Text of tables as a column: a fold over the rows of a table that carries open row spans as its state. No Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import SPACE
from .tree import attribute, fenced, let, lit, markup, node_text, with_nodes, with_source, with_texts

MOST_CELLS, MOST_BYTES = 20_000, 200_000  # of a table, as the original behaviour has it

_NONE = "named_struct('left', 0, 'text', '')"
_TEXTS = "CAST(array() AS array<string>)"
_SPAN = lambda x, name: let(f"trim({attribute(f'{x}.attrs', name)})", "v_", "IF(v_ RLIKE '^[+]?[0-9]{1,9}$', greatest(CAST(v_ AS INT), 1), 1)")
#: rows of a table t, each with its cells (those of tables inside it too), cleaned
_ROWS = f"""transform(filter(slice(nodes, t.pre + 2, t.post - t.pre), r -> r.tag = 'tr'), r -> transform(filter(slice(nodes, r.pre + 2, r.post - r.pre), c -> c.tag IN ('td', 'th')),
 c -> struct(trim(regexp_replace({node_text('c')}, {lit(SPACE + '+')}, ' ')) AS text, {_SPAN('c', 'colspan')} AS wide, {_SPAN('c', 'rowspan')} AS tall)))"""

# a: struct<spans, row, col, cells>; open spans from col on go into the row
_OPEN = "IF({a}.col < size({a}.spans), coalesce(array_min(filter(sequence({a}.col, size({a}.spans) - 1), i -> {a}.spans[i].left = 0)), size({a}.spans)), {a}.col)"
_CARRIED = "struct(transform({a}.spans, (s, i) -> IF(i >= {a}.col AND i < e_, IF(s.left > 1, named_struct('left', s.left - 1, 'text', s.text), " + _NONE + "), s)) AS spans, concat({a}.row, transform(slice({a}.spans, {a}.col + 1, e_ - {a}.col), s -> s.text)) AS row, e_ AS col, {a}.cells AS cells)"


def _carry(a: str) -> str:
    return let(_OPEN.replace("{a}", a), "e_", f"IF(e_ = {a}.col, {a}, {_CARRIED.replace('{a}', a)})")


_PUT = f"""struct(IF(x.tall > 1, concat(slice(b_.spans, 1, b_.col), array_repeat({_NONE}, greatest(0, b_.col - size(b_.spans))), array_repeat(named_struct('left', x.tall - 1, 'text', x.text), n_), slice(b_.spans, b_.col + n_ + 1, greatest(0, size(b_.spans) - b_.col - n_))), b_.spans) AS spans,
 concat(b_.row, array_repeat(x.text, n_)) AS row, b_.col + n_ AS col, IF(x.wide > n_, {MOST_CELLS}, b_.cells + n_) AS cells)"""
_CELL = f"IF(a.cells >= {MOST_CELLS}, a, {let(_carry('a'), 'b_', let(f'least(x.wide, {MOST_CELLS - 1} - b_.cells)', 'n_', _PUT))})"
_ROW = f"aggregate(r, struct(s.spans AS spans, {_TEXTS} AS row, 0 AS col, s.cells AS cells), (a, x) -> {_CELL})"
_LINE = "array_join(c_.row, ' | ')"
_STEP = f"""IF(s.cells >= {MOST_CELLS} OR s.bytes >= {MOST_BYTES}, s, {let(_ROW, 'd_', let(_carry('d_'), 'c_', f"IF(forall(c_.row, t -> t = ''), struct(c_.spans AS spans, c_.cells AS cells, s.bytes AS bytes, s.lines AS lines), struct(c_.spans AS spans, c_.cells AS cells, s.bytes + octet_length({_LINE}) + IF(size(s.lines) > 0, 1, 0) AS bytes, array_append(s.lines, {_LINE}) AS lines))"))})"""
_ZERO = f"struct(slice(array({_NONE}), 1, 0) AS spans, 0 AS cells, 0 AS bytes, {_TEXTS} AS lines)"


#: a table's text from the places of its cells (see _LAYOUT)
_FILLED = f"""array_join(aggregate(g, struct(0 AS bytes, {_TEXTS} AS lines), (s, r) -> IF(s.bytes >= {MOST_BYTES}, s, {let("transform(r, i -> __cells[i])", "c_", let("array_join(c_, ' | ')", "l_", "IF(forall(c_, t -> t = ''), s, struct(s.bytes + octet_length(l_) + IF(size(s.lines) > 0, 1, 0) AS bytes, array_append(s.lines, l_) AS lines))"))})).lines, '\\n')"""
_PLACES = _ROWS.replace(f"trim(regexp_replace({node_text('c')}, {lit(SPACE + '+')}, ' '))", "CAST(c.pre AS string)")
#: where the texts of a markup's cells come from, by node, and the nodes that stand in each row of each table
_LAYOUT = """struct(transform(nodes, x -> struct(IF(x.tag IN ('td', 'th'), x.start, 0) AS start, IF(x.tag IN ('td', 'th'), x.end, 0) AS end)) AS cells, transform(__grids, g -> transform(g.lines, l -> transform(split(l, ' [|] '), i -> CAST(i AS INT)))) AS grids)"""

SHARED, SHARED_CHARS, SHARED_BYTES = 256, 4_000, 16_000  # markups that are laid out once, their length, the length of their layouts


def _layouts(df: DataFrame) -> DataFrame:
    """The layouts of the markups that most rows of df have: those of some size, so that all of them together are small."""
    often = df.where(f"length(__markup) <= {SHARED_CHARS}").groupBy("__markup").count().where("count > 1").orderBy(F.desc("count"), "__markup").limit(SHARED)
    made = with_nodes(with_texts(often.select("__markup", F.col("__markup").alias("__source"))))
    made = fenced(made, __rows=f"transform(filter(nodes, t -> t.tag = 'table'), t -> {_PLACES})")
    made = fenced(made, __grids=f"transform(__rows, rs -> aggregate(rs, {_ZERO}, (s, r) -> {_STEP}))")
    made = made.where(f"aggregate(__grids, 0, (n, g) -> n + g.bytes) < {SHARED_BYTES} AND forall(__grids, g -> g.cells < {MOST_CELLS})")
    return made.select("__markup", F.expr(_LAYOUT).alias("__layout"))


def with_table_texts(df: DataFrame, html: str = "html") -> DataFrame:
    """df with `tables`: array<string>, the text of each table of a page (inner ones too) in document order: a line for each row, cells apart by " | ", a cell again for each further column it spans and in each further row. Rows without text are left out; a span of 0 or of no number is 1; beyond 20,000 cells or 200,000 bytes a table goes no further.

    Where cells stand depends on the markup alone. The markups that most pages have are laid out once and sent to all tasks; pages of any other markup have a fold of their own. A stream has no counts, so there each page has its own."""
    df = with_source(df, html)
    if df.isStreaming:
        return _own(with_texts(df.withColumn("__layout", F.lit(None)))).withColumnRenamed("__own_tables", "tables").drop("__layout", "texts")
    df = fenced(df, __markup=markup("__source"))
    df = df.join(F.broadcast(_layouts(df)), "__markup", "left").drop("__markup")
    df = _own(with_texts(df))
    df = fenced(df, __cells=f"transform(__layout.cells, c -> IF(c.end > c.start, trim(regexp_replace(IF(c.end = c.start + 1, texts[c.start], {node_text('c')}), {lit(SPACE + '+')}, ' ')), ''))")
    df = fenced(df, tables=f"IF(__layout IS NULL, __own_tables, transform(__layout.grids, g -> {_FILLED}))")
    return df.drop("__layout", "__cells", "__own_tables", "texts")


def _own(df: DataFrame) -> DataFrame:
    """df (see with_texts) with __own_tables: the tables of pages without a layout, by a fold of their own."""
    df = with_nodes(df.withColumn("__source", F.expr("IF(__layout IS NULL, __source, NULL)")))
    df = fenced(df, __rows=f"transform(filter(nodes, t -> t.tag = 'table'), t -> {_ROWS})")
    df = fenced(df, __own_tables=f"transform(__rows, rs -> array_join(aggregate(rs, {_ZERO}, (s, r) -> {_STEP}).lines, '\\n'))")
    return df.drop("__source", "__rows", "nodes")
