"""Source divergence audit by a heavy-light split.

Of every language, the sources are compared by the smoothed shares of the language's terms:
p = 1 + floor(10^9 * (count + 5) / (N + 5 * V)), the distance of two sources the sum of
|p - p'| over all V kept terms. Terms that stand in many of the language's sources are
heavy: a task fills a dense numpy tile (sources by terms) and takes all differences of a
pair of source blocks at once. All other terms are light, and most pairs of sources have
neither or one of them; what such a term adds depends on p alone. So each source keeps a
histogram of the p of its light terms, which gives the sum against any other source's p of
an absent term, and only pairs that stand in one posting list get a correction:

  sum over light = R d + (f_A(b) - n_A d) + (f_B(a) - n_B d) + corrections,

R light terms of the language, a and b the p of an absent term in A and B, d = |a - b|,
f_A(x) = sum over A's light terms of |p - x|, n_A their number. The parts are integers and
are added as such, so the sum is exact and doesn't depend on the split.

Scale: counts are added up within a task before the shuffle, so a hot source or term costs
a row a task. Tasks of tiles and postings hold at most a tile of terms times two blocks of
sources; the tables of counts, terms and sources are staged in the shared folder. The pairs
of sources within a language are the result itself; nothing else is paired.

Defined cases: null text, lang and source count as ''; a language without kept terms has
distance 0 between its sources and no term rows; repeated rows count as often as they
stand there; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, drop_staged, lean, stage, staged_so_far, table, workers_import

TERM = re.compile(rb"[a-z\x80-\xff]+")
LEAST_DOCS = 30
SHARE, FEWEST = 0.25, 4  # a term is heavy in this share of its language's sources, if these are as many at least
TILE, BLOCK = 512, 256  # terms of a tile, sources of a block
HELD = 300_000  # counters of a task before it hands them on
TOP = 50


def count(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs; a row with a null term for each group, so that groups without terms are there too."""
    workers_import(docs.sparkSession)

    def flush(groups, rows):
        cols: list[list] = [[], [], [], [], []]
        for (lang, source), (terms, has) in groups.items():
            k = len(terms)
            for col, more in zip(cols, ([lang] * k, [source] * k, list(terms), list(terms.values()), [has[t] for t in terms]), strict=True):
                col += more
        for (lang, source), k in rows.items():
            for col, x in zip(cols, (lang, source, None, 0, k), strict=True):
                col.append(x)
        groups.clear()
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())], names=["lang", "source", "term", "n", "docs"])

    def run(batches):
        groups: dict[tuple, tuple[Counter, Counter]] = {}
        rows: Counter = Counter()
        held = 0
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                rows[lang, source] += 1
                own = TERM.findall(text.translate(_LOWER))
                if own:
                    terms, has = groups.setdefault((lang, source), (Counter(), Counter()))
                    before = len(terms)
                    terms.update(own)
                    has.update(set(own))
                    held += len(terms) - before
                if held > HELD:
                    yield flush(groups, rows)
                    held = 0
        if rows:
            yield flush(groups, rows)

    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(empty("lang"), empty("source"), empty("text").cast("binary").alias("text"))
    found = rows.mapInArrow(lean(run), "lang string, source string, term binary, n long, docs long")
    return found.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


_LOWER = LOWER.tobytes()


def share(count_: Column, total: Column, terms: Column) -> Column:
    """p of a count, exactly, for counts that 10^9 times over are no longs any more."""
    whole = F.lit(10**9).cast("decimal(10,0)") * (count_ + 5).cast("decimal(19,0)")
    return F.lit(1).cast("long") + F.call_function("div", whole, (total + terms * 5).cast("decimal(19,0)"))


def _by_block(df: DataFrame) -> DataFrame:
    """A row for each pair of blocks (i <= j) that its source's block is in; `blocks` is their number in the language."""
    j = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    return df.select("*", j).select("*", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).drop("other", "block", "blocks")


def _pairs(lang: str, a: np.ndarray, b: np.ndarray, value: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"lang": lang, "a": a, "b": b, "value": value})


PAIR = "lang string, a int, b int, value long"


def _sides(no: np.ndarray, i: int, j: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """The sources of both blocks among the numbers given, ascending."""
    no = np.unique(no)
    return no[no // block == i], no[no // block == j]


def _all(left: np.ndarray, right: np.ndarray, value: np.ndarray, lang: str, keep_zero: bool) -> pd.DataFrame:
    """Pairs a < b with their values."""
    use = left[:, None] < right[None, :]
    if not keep_zero:
        use &= value != 0
    r, c = np.nonzero(use)
    return _pairs(lang, left[r], right[c], value[r, c])


def dense(key, rows: pd.DataFrame, block: int) -> pd.DataFrame:
    """A tile of heavy terms: |p - p'| summed over its terms, for all pairs of two blocks of sources. Every source is a row with a null term, too, that says how many terms the tile has."""
    lang, _, i, j = key
    left, right = _sides(rows["no"].to_numpy(), i, j, block)
    every = np.union1d(left, right)
    at = np.searchsorted(every, rows["no"].to_numpy())
    p0 = np.zeros(len(every), np.int64)
    p0[at] = rows["p0"].to_numpy()
    has = rows["term"].notna().to_numpy()
    code, names = pd.factorize(rows["term"][has])
    tile = np.repeat(p0[:, None], len(names), 1)
    tile[at[has], code] = rows["p"].to_numpy()[has].astype(np.int64)
    l, r = tile[np.searchsorted(every, left)], tile[np.searchsorted(every, right)]
    value = np.stack([np.abs(r - x).sum(1) for x in l]) if len(l) else np.zeros((0, len(right)), np.int64)
    elsewhere = int(rows["terms"].max()) - len(names)  # terms of the tile that no source of these blocks has
    value = value + elsewhere * np.abs(p0[np.searchsorted(every, left)][:, None] - p0[np.searchsorted(every, right)][None, :])
    return _all(left, right, value, lang, False)


def sparse(key, rows: pd.DataFrame, block: int) -> pd.DataFrame:
    """Posting lists of light terms: what pairs that share a term have to be corrected by."""
    lang, _, i, j = key
    rows = rows.sort_values(["term", "no"])
    no, p, p0 = (rows[k].to_numpy().astype(np.int64) for k in ("no", "p", "p0"))
    left, right = _sides(no, i, j, block)
    value = np.zeros((len(left), len(right)), np.int64)
    term = rows["term"].to_numpy()
    cut = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else []
    for s, e in zip(cut, np.append(cut[1:], len(term)), strict=True):
        if e - s == 1:
            continue
        own = no[s:e] // block
        x, y = np.flatnonzero(own == i) + s, np.flatnonzero(own == j) + s
        if len(x) and len(y):
            pa_, pb, a, b = p[x][:, None], p[y][None, :], p0[x][:, None], p0[y][None, :]
            value[np.ix_(np.searchsorted(left, no[x]), np.searchsorted(right, no[y]))] += np.abs(pa_ - pb) - np.abs(pa_ - b) - np.abs(pb - a) + np.abs(a - b)
    return _all(left, right, value, lang, False)


def base(key, rows: pd.DataFrame, block: int) -> pd.DataFrame:
    """All pairs of two blocks of sources, with what light terms add if no source shares one with another."""
    lang, i, j = key
    rows = rows.sort_values("no")
    no, p0 = rows["no"].to_numpy(), rows["p0"].to_numpy().astype(np.int64)
    light = int(rows["light"].iloc[0])
    x = np.flatnonzero(no // block == i), np.flatnonzero(no // block == j)

    def against(own, others):
        out = np.zeros((len(own), len(others)), np.int64)
        for k, r in enumerate(own):
            ps, ns = rows["ps"].iloc[r], rows["ns"].iloc[r]
            if ps is None or not len(ps):
                continue
            ps, ns = np.asarray(ps, np.int64), np.asarray(ns, np.int64)
            n, w = np.append(0, np.cumsum(ns)), np.append(0, np.cumsum(ns * ps))
            b = p0[others]
            c = np.searchsorted(ps, b)
            out[k] = (n[c] * b - w[c]) + (w[-1] - w[c]) - (n[-1] - n[c]) * b - n[-1] * np.abs(p0[r] - b)
        return out

    value = light * np.abs(p0[x[0]][:, None] - p0[x[1]][None, :]) + against(*x) + against(x[1], x[0]).T
    return _all(no[x[0]], no[x[1]], value, lang, True)


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, block: int = BLOCK, tile: int = TILE, heavy_share: float = SHARE) -> DataFrame:
    """lang, source, part, item, value, rank of docs (lang, source, text): how far each source is from each other one of its language (part pair, all of them), and the terms it has most above the language's share (part term, the first `top`)."""
    spark, mark = docs.sparkSession, staged_so_far()
    counts = stage(count(docs), "counts")
    terms = stage(counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("of_lang"), F.sum("docs").alias("docs"), F.count(F.lit(1)).alias("sources")).where(F.col("docs") >= least_docs).drop("docs"), "terms")
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("of_lang").alias("lang_n"))
    kept = counts.where("term is not null").join(terms, ["lang", "term"]).select("lang", "source", "term", "n", "of_lang", "sources")
    known = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term is null").select("lang", "source").join(known, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "v", "lang_n"])
    groups = groups.withColumn("no", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    sizes = groups.groupBy("lang").agg(F.count(F.lit(1)).cast("int").alias("size"))
    groups = groups.join(sizes, "lang").withColumns({"block": F.floor(F.col("no") / block).cast("int"), "blocks": F.ceil(F.col("size") / block).cast("int"), "p0": F.when(F.col("v") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("v"))).otherwise(F.lit(0).cast("long"))})
    groups = stage(groups, "groups")

    rows = kept.join(groups, ["lang", "source"]).withColumns({"p": share(F.col("n"), F.col("total"), F.col("v")), "heavy": (F.col("sources") >= F.greatest(F.lit(FEWEST), F.col("size") * heavy_share)), "tile": F.pmod(F.xxhash64("term"), F.ceil(F.col("v") / tile)).cast("int")})
    rows = stage(rows.select("lang", "source", "no", "block", "blocks", "term", "n", "p", "p0", share(F.col("of_lang"), F.col("lang_n"), F.col("v")).alias("q"), "heavy", "tile"), "shares")

    light = rows.where("not heavy")
    histogram = light.groupBy("lang", "no", "p").agg(F.count(F.lit(1)).alias("k")).groupBy("lang", "no").agg(F.array_sort(F.collect_list(F.struct("p", "k"))).alias("h"))
    light_terms = light.select("lang", "term").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("light"))
    ends = groups.select("lang", "no", "block", "blocks", "p0").join(histogram, ["lang", "no"], "left").join(light_terms, "lang", "left").na.fill(0, ["light"])
    ends = _by_block(ends.select("lang", "no", "block", "blocks", "p0", "light", F.col("h.p").alias("ps"), F.col("h.k").alias("ns")))
    tiles = rows.where("heavy").groupBy("lang", "tile").agg(F.count_distinct("term").alias("terms"))
    absent = groups.join(tiles, "lang").select("lang", "tile", "no", "block", "blocks", F.lit(None).cast("string").alias("term"), F.lit(None).cast("long").alias("p"), "p0", "terms")
    heavy = _by_block(rows.where("heavy").select("lang", "tile", "no", "block", "blocks", "term", "p", "p0").unionByName(absent, allowMissingColumns=True))
    postings = _by_block(light.select("lang", "tile", "no", "block", "blocks", "term", "p", "p0"))

    by = lambda f: lambda key, part: f(key, part, block)
    parts = [ends.groupBy("lang", "i", "j").applyInPandas(by(base), PAIR), heavy.groupBy("lang", "tile", "i", "j").applyInPandas(by(dense), PAIR), postings.groupBy("lang", "tile", "i", "j").applyInPandas(by(sparse), PAIR)]
    sums = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = sums.select("lang", F.explode(F.array(F.struct(F.col("a").alias("no"), F.col("b").alias("other")), F.struct(F.col("b").alias("no"), F.col("a").alias("other")))).alias("x"), "value").select("lang", "x.*", "value")
    named = groups.select("lang", "no", "source")
    pair = both.join(named, ["lang", "no"]).join(named.select("lang", F.col("no").alias("other"), F.col("source").alias("item")), ["lang", "other"])
    pair = pair.select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    term = rows.where("n > 0 and p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")).alias("rank")
    out = stage(pair.select("*", order).unionByName(term.select("*", order).where(F.col("rank") <= top)), "audit")
    drop_staged(spark, mark, out)
    return out


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: every source against every other one of its language, and each source's 50 most typical terms."""
    return audit(table(spark, sf_dir, "documents").select("lang", "source", "text"))
