"""N-gram Jaccard join (operator 6) by token-combination prefixes.

Tokens are 64-bit fingerprints of the distinct word 5-grams of a text. Texts with
equal token sets are one node (a 64-bit fingerprint `sid`) from the start.

1. Counts of all tokens in a table of 2**22 counters (fixed size, all texts) put
   tokens into classes: rare, or frequent by power of two above the noise. The
   global token order is class first, then fingerprint.
2. Index keys. Of n tokens in that order the first p = n - ceil(0.8 n) + 1 are the
   prefix: similar sets share a token there. Rare prefix tokens are indexed alone. If
   the prefix reaches frequent tokens it is extended, so that similar sets share k
   tokens in it, and combinations of successive tokens are indexed: two for frequent,
   three for very frequent ones. That suffices: similar sets of n and m tokens differ
   in at most d = (n + m) / 9 tokens, so at most d of the places between successive
   shared tokens are broken by a token of one set alone; k = n / 4 + 2 shared tokens
   have more places than that, and twice as many have two unbroken ones in a row.
   A token alone carries its reach: the greatest size of a set that it can be the first
   shared token with, as enough tokens must follow it for a link. Only a token in the
   first ninth of its set reaches sets of its own size.
3. The members of a key, in order of size, are cut where sizes differ too much for a
   link; each part gets the label of its first member (least size, then sid) that
   reaches its own size. Members before it and those that don't reach its size have no
   link that this key must find. Keys of one group of near copies have few such first
   members, so there are far fewer distinct rows (label, member) than rows of keys, and
   a pair is compared once a label. A task sends a member once a label; labels are
   members of themselves, which is added once all rows are distinct. Keys of tokens
   that over 2**HOT_CLASS sets share are labels themselves, ungathered.
4. Members of a label are compared by parity bitmaps, which bound the symmetric
   difference from below: pairs beyond 2/9 of the sizes are ruled out for certain. Only
   a spanning forest of the near pairs, closest first, leaves the task: rows grow with
   the members, not with their square. Its edges are verified on the token sets.
5. Where an edge of a label is refuted, all near pairs of that label between different
   components are verified too. Where none is, the forest has the components of all
   near pairs, so nothing is lost.

Links are decided on 64-bit tokens within a pair, where a collision has a chance
below 10**-12. Different sets with one sid would be merged: about three pairs are to
be expected among 10**10 distinct texts.

Defined cases: null or empty text or text without words: no shingle, linked with
nothing, a component of its own; fewer than five words: the whole sequence is the
one shingle; repeated rows and copies link; rows of one doc_id are separate rows with
that id; a null doc_id is kept, and no component is named by it unless it has no
other; very long texts are worked on whole, in a run of their own; ties in size go by
sid; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, U, chunks, drop_staged, grams, lean, mix, prefix_hash, span_hash, stage, staged_so_far, table, text_bytes, words, workers_import
from .graph import components, in_filter, merged, slices

NUM, DEN = 80, 100  # similarity as a fraction
CLASS_BITS = 22
VERY_CLASS = 10  # from here on (about 2**9 sets) three tokens make a key
HOT_CLASS = 20  # from here on keys are not gathered by a task
SMALL = 15  # from this size on very frequent tokens make no pairs; sets of NUM / DEN of it already make triples
BLOCK = 8192  # members of a label that one task compares
FEW = 8  # members of a label of which all near pairs are verified
SEEN = 1 << 18  # sets that a task remembers, to skip copies
CLASS = U((1 << CLASS_BITS) - 1)
ANY = (1 << 31) - 1  # reach of combinations of tokens


# ---------------------------------------------------------------- token sets
def shingle_sets(a: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct tokens of texts end to end, and offsets (n + 1)."""
    a = LOWER[a]
    s, e, doc = words(a, offsets)
    n_docs = len(offsets) - 1
    h = span_hash(prefix_hash(a), s, e)
    count = np.bincount(doc, minlength=n_docs)
    first = np.cumsum(count) - count
    g = grams(h, size)
    ok = doc[: len(g)] == doc[size - 1 :] if len(g) else np.empty(0, bool)
    owner, g = doc[: len(g)][ok], g[ok]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        own = np.array([int(mix(np.add.reduce(grams(h[first[d] : first[d] + count[d]], int(count[d])), keepdims=True) + U(count[d]))[0]) for d in short], np.uint64)
        owner, g = np.concatenate((owner, short)), np.concatenate((g, own))
        order = np.argsort(owner, kind="stable")
        owner, g = owner[order], g[order]
    bounds = np.searchsorted(owner, np.arange(n_docs + 1))
    for i in range(n_docs):
        g[bounds[i] : bounds[i + 1]].sort()
    keep = np.ones(len(g), bool)
    keep[1:] = (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])
    return g[keep], np.searchsorted(owner[keep], np.arange(n_docs + 1))


def set_ids(t: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(t + U(0x632BE59BD9B4E019)))))
    return mix(total[b[1:]] - total[b[:-1]] + np.diff(b).astype(np.uint64) * U(0x9E3779B97F4A7C15)).view(np.int64)


def parity(tokens: np.ndarray) -> bytes:
    """Bit i: whether an odd number of tokens falls there. Width: the power of two from four times the number of tokens on."""
    width = 1 << max(6, int(4 * len(tokens) - 1).bit_length())
    at = (mix(tokens) >> U(40)) & U(width - 1)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=width) & 1).astype(np.uint8)).tobytes()


class Seen:
    """Which sets are new to a task; starts anew when full, so a copy may count as new."""

    def __init__(self):
        self.own: set[int] = set()

    def new(self, sid: np.ndarray) -> np.ndarray:
        if len(self.own) > SEEN:
            self.own.clear()
        return np.array([s not in self.own and not self.own.add(s) for s in sid.tolist()], bool)


def token_sets(batches, column: str):
    """Of each run of texts: its place in the batch, tokens, offsets, sids."""
    for batch in batches:
        a, offsets = text_bytes(batch.column(column))
        for i, j in chunks(offsets):
            t, b = shingle_sets(a[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            yield batch.slice(i, j - i), t, b, set_ids(t, b)


def sets_table(texts: DataFrame) -> DataFrame:
    """Staged rows doc_id, tid, sid, n of all texts (doc_id, tid, text), and rows slice, counts of the token counters of each partition."""

    def run(batches):
        counts, seen, held, size = np.zeros(1 << CLASS_BITS, np.int64), Seen(), [], 0
        for part, t, b, sid in token_sets(batches, "text"):
            n = np.diff(b)
            held.append((t[np.repeat(seen.new(sid) & (n > 1), n)] & CLASS).astype(np.int64))
            size += len(held[-1])
            if size > 1 << 20:
                counts += np.bincount(np.concatenate(held), minlength=len(counts))
                held, size = [], 0
            empty = [pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tid"), pa.array(sid), pa.array(n.astype(np.int32)), *empty], names=["doc_id", "tid", "sid", "n", "slice", "counts"])
        if held:
            counts += np.bincount(np.concatenate(held), minlength=len(counts))
        for k, c in slices(counts):
            none = pa.nulls(1, pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, pa.nulls(1, pa.int32()), pa.array([k], pa.int32()), pa.array([c], pa.binary())], names=["doc_id", "tid", "sid", "n", "slice", "counts"])

    return stage(texts.mapInArrow(lean(run), "doc_id long, tid long, sid long, n int, slice int, counts binary"), "sets")


def classes_of(counts: np.ndarray) -> np.ndarray:
    mid = np.median(counts)
    return np.where(counts > mid + 5 * (np.sqrt(mid) + 1), np.log2(np.maximum(counts - mid, 1)).astype(np.int64) + 1, 0).astype(np.uint8)


# ---------------------------------------------------------------- index
def keys_of(t: np.ndarray, classes: np.ndarray, very_class: int = VERY_CLASS, hot_class: int = HOT_CLASS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index keys of a set, whether a key may be a hot one, and its reach. Similar sets share a key that reaches the size of either."""
    n = len(t)
    p = n - -(-NUM * n // DEN) + 1
    c = classes[(t & CLASS).astype(np.int64)]
    order = np.argsort(c, kind="stable")
    t, c = t[order], c[order]
    rare = int(np.searchsorted(c, 1))
    if rare >= p:
        return t[:p], np.zeros(p, bool), reach(n, p)
    very = max(rare, int(np.searchsorted(c, very_class)))
    most = (DEN - NUM) * n // NUM  # tokens in which the smaller of two similar sets differs from the other
    end = p + most + 1  # the prefix in which similar sets share most + 2 tokens
    if end > very:
        end = min(n, p + 2 * most + 3)
    two, three = np.arange(rare, end - 1), np.arange(very, end - 2)
    if n >= SMALL:  # smaller sets can be linked to some that share no three tokens in a row
        two = two[: max(very - rare, 0)]
    if DEN * n < NUM * SMALL:
        three = three[:0]
    pairs = mix(t[two] * U(0xD1342543DE82EF95) ^ mix(t[two + 1])) | U(1 << 63)
    triples = mix((t[three] * U(0xD1342543DE82EF95) ^ mix(t[three + 1])) * U(0xF1357AEA2E62A9C5) ^ mix(t[three + 2])) | U(1 << 63)
    far = np.concatenate((reach(n, rare), np.full(len(two) + len(three), ANY)))
    return np.concatenate((t[:rare], pairs, triples)), np.concatenate((np.zeros(rare, bool), c[two] >= hot_class, c[three] >= hot_class)), far


def reach(n: int, first: int) -> np.ndarray:
    """For the first tokens of a set of n: the greatest m so that sets of n and m can be linked if this is the first token that they share. They share the n - i tokens from it on at most, and NUM / (DEN + NUM) of n + m at least."""
    return (DEN + NUM) * (n - np.arange(first)) // NUM - n


def labelled(batches):
    """Rows label, sid, hot of rows key, size, sid in this order, each once but for what a task forgets. size: n << 32 | reach, or -1 for a hot key, which is its own label. State between batches: the last row's key and size, and the leader of its part (sid, n), if it has one yet."""
    last_key = last_n = leader = None
    held, many = [], 0
    for batch in batches:
        key, size, sid = (batch.column(c).to_numpy() for c in ("key", "size", "sid"))
        hot = size < 0
        if hot.any():
            held.append(np.stack((key[hot], sid[hot], np.ones(hot.sum(), np.int64)), 1))
            many += len(held[-1])
            key, size, sid = key[~hot], size[~hot], sid[~hot]
        if len(key):
            n, far = size >> 32, size & ANY
            first = np.empty(len(key), bool)
            first[1:] = (key[1:] != key[:-1]) | (NUM * n[1:] > DEN * n[:-1])
            first[0] = last_key is None or key[0] != last_key or NUM * int(n[0]) > DEN * int(last_n)
            begin = np.flatnonzero(first) if first[0] else np.append(0, np.flatnonzero(first))
            at = np.minimum.reduceat(np.where(far >= n, np.arange(len(key)), len(key)), begin)  # the leader of each part
            lead_sid, lead_n = np.append(sid, 0)[at], np.append(n, ANY + 1)[at]  # a part without one: nothing reaches it
            if not first[0] and leader is not None:
                at[0], lead_sid[0], lead_n[0] = -1, *leader
            leader = (int(lead_sid[-1]), int(lead_n[-1])) if at[-1] < len(key) else None
            last_key, last_n = key[-1], n[-1]
            part = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(key))))
            more = (np.arange(len(key)) > at[part]) & (far >= lead_n[part]) & (sid != lead_sid[part])
            held.append(np.stack((lead_sid[part][more], sid[more], np.zeros(more.sum(), np.int64)), 1))
            many += len(held[-1])
        if many > 1 << 20:
            held = [np.unique(np.concatenate(held), axis=0)]
            many = len(held[0])
            if many > 1 << 19:
                yield from put(held.pop())
                many = 0
    if held:
        yield from put(np.unique(np.concatenate(held), axis=0))


def put(rows: np.ndarray):
    for k in range(0, len(rows), 100_000):
        part = np.ascontiguousarray(rows[k : k + 100_000].T)
        yield pa.RecordBatch.from_arrays([pa.array(part[0]), pa.array(part[1]), pa.array(part[2] > 0)], names=["label", "sid", "hot"])


def index(texts: DataFrame, classes, very_class: int, hot_class: int) -> DataFrame:
    """Distinct rows label, sid, from staged tables: sets of one label may be linked."""

    def emit(batches):
        seen = Seen()
        for _, t, b, sid in token_sets(batches, "text"):
            n, rows = np.diff(b), []
            for k in np.flatnonzero((n > 3) & seen.new(sid)):
                key, hot, far = keys_of(t[b[k] : b[k + 1]], classes.value, very_class, hot_class)
                rows.append((key, np.full(len(key), sid[k]), np.where(hot, -1, int(n[k]) << 32 | far)))
            if rows:
                key, own, size = (np.concatenate(x) for x in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(own), pa.array(size)], names=["key", "sid", "size"])

    rows = texts.select("text").mapInArrow(lean(emit), "key long, sid long, size long")
    dealt = rows.repartition(F.when(F.col("size") < 0, F.xxhash64("key", "sid")).otherwise(F.col("key"))).sortWithinPartitions("key", "size", "sid")
    found = stage(dealt.mapInArrow(lean(labelled), "label long, sid long, hot boolean").distinct(), "labels")
    leaders = stage(found.where("not hot").select("label").distinct(), "leaders")
    return found.select("label", "sid").union(leaders.select("label", F.col("label").alias("sid")))


def of_sets(texts: DataFrame, nodes: DataFrame, wanted: DataFrame, make, field: str) -> DataFrame:
    """Rows sid, n and field = make(tokens) of the sets in wanted (sid). Only texts that a bit table can't rule out are read on."""
    only = in_filter(nodes.join(wanted, "sid", "left_semi").select("tid"))

    def run(batches):
        seen = Seen()
        for _, t, b, sid in token_sets(only(batches), "text"):
            own = np.flatnonzero(seen.new(sid))
            n = np.diff(b)[own].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(sid[own]), pa.array(n), pa.array([make(t[b[k] : b[k + 1]]) for k in own], pa.binary())], names=["sid", "n", field])

    return texts.select("tid", "text").mapInArrow(lean(run), f"sid long, n int, {field} binary").dropDuplicates(["sid"])


# ---------------------------------------------------------------- comparison
def differing(bits: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of the parity bitmaps (an array of bytes objects) of x and y. The wider one is folded, which keeps it a parity bitmap."""
    widths = np.array([len(b) for b in bits])
    out = np.empty(len(x), np.int64)
    rank = np.empty(len(bits), np.int64)
    rows = {}
    for w in np.unique(widths):
        own = np.flatnonzero(widths == w)
        rank[own] = np.arange(len(own))
        rows[int(w)] = np.frombuffer(b"".join(bits[own]), np.uint64).reshape(len(own), -1)
    sign = widths[x] * (1 << 31) + widths[y]
    for z in np.unique(sign):
        wx, wy = divmod(int(z), 1 << 31)
        a, b = rows[wx], rows[wy]
        while a.shape[1] > b.shape[1]:
            a = a[:, : a.shape[1] // 2] ^ a[:, a.shape[1] // 2 :]
        while b.shape[1] > a.shape[1]:
            b = b[:, : b.shape[1] // 2] ^ b[:, b.shape[1] // 2 :]
        own = np.flatnonzero(sign == z)
        some = max(1, (16 << 20) // min(wx, wy))
        for k in range(0, len(own), some):
            i = own[k : k + some]
            out[i] = np.bitwise_count(a[rank[x[i]]] ^ b[rank[y[i]]]).sum(1, dtype=np.int64)
    return out


def near_pairs(n: np.ndarray, bits: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Those of the index pairs whose sizes and bitmaps allow a link, and their differing bits over their sizes."""
    ok = NUM * np.maximum(n[x], n[y]) <= DEN * np.minimum(n[x], n[y])
    x, y = x[ok], y[ok]
    differ, both = differing(bits, x, y), n[x] + n[y]
    hit = differ * (DEN + NUM) <= both * (DEN - NUM)  # |x ^ y| <= (|x| + |y|) (DEN - NUM) / (DEN + NUM) for linked sets
    return x[hit], y[hit], differ[hit] / both[hit]


def spanning(m: int, x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Which edges make a minimum spanning forest of m nodes: in rounds, each component takes its cheapest edge to another."""
    order = np.argsort(cost, kind="stable")
    x, y, comp, taken = x[order], y[order], np.arange(m), np.zeros(len(x), bool)
    live = np.arange(len(x))
    while True:
        live = live[comp[x[live]] != comp[y[live]]]
        if not len(live):
            return order[taken]
        best = np.full(m, len(x))
        np.minimum.at(best, comp[x[live]], live)
        np.minimum.at(best, comp[y[live]], live)
        chosen = np.unique(best[best < len(x)])
        taken[chosen] = True
        up = np.arange(m)
        for a, b in zip(comp[x[chosen]].tolist(), comp[y[chosen]].tolist(), strict=True):
            while up[a] != a:
                a = up[a]
            while up[b] != b:
                b = up[b]
            up[max(a, b)] = min(a, b)
        while (up[up] != up).any():
            up = up[up]
        comp = up[comp]


def compare(members: DataFrame, attributes: DataFrame, roots: DataFrame | None, block: int, few: int) -> DataFrame:
    """Staged near pairs label, a, b among the members of each label: a spanning forest, or (with roots) all pairs of different components."""
    count = members.groupBy("label").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > block)
    at = members.join(attributes, "sid")
    at = at.withColumn("root", F.col("sid")) if roots is None else at.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    large = stage(count, "large")
    if large.take(1):  # a label of many members: each pair of blocks is a group of its own
        at = at.join(large, "label", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("m") / block), F.lit(1)).cast("int"))
        at = at.withColumn("own", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        at = at.select("label", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "sid", "root", "n", "bits")
    else:
        at = at.select("label", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("own"), "sid", "root", "n", "bits")

    whole = roots is not None

    def run(batches):
        def rows(label, x, y):
            """Pairs of sids; a label where more pairs of it may follow."""
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.nulls(len(x), pa.int64()) if label is None else pa.array(np.full(len(x), label)), pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["label", "a", "b"])

        def group(label, own, sid, root, n, bits):
            m, cross = len(sid), own.min() != own.max()
            forest = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
            step = max(1, 500_000 // m)
            for first in range(0, m, step):  # some rows against all after them
                x, y = np.nonzero(root[first : first + step, None] != root[None, :])
                x += first
                ok = y > x
                if cross:
                    ok &= own[x] != own[y]
                found = near_pairs(n, bits, x[ok], y[ok])
                if whole:
                    yield from rows(None, sid[found[0]], sid[found[1]])
                elif len(found[0]):
                    forest = tuple(np.concatenate(z) for z in zip(forest, found, strict=True))
                    if len(forest[0]) > 1_000_000:
                        kept = spanning(m, *forest)
                        forest = tuple(z[kept] for z in forest)
            if len(forest[0]):
                kept = spanning(m, *forest)
                yield from rows(label, sid[forest[0][kept]], sid[forest[1][kept]])

        def settle(t, cut):
            """The groups that begin at cut."""
            label, own, sid, root, n = (t.column(c).to_numpy() for c in ("label", "own", "sid", "root", "n"))
            n, bits = n.astype(np.int64), np.array(t.column("bits").to_pylist(), object)
            end = np.append(cut[1:], t.num_rows)
            size = end - cut
            begin = cut[(size > 1) & (size <= few)]
            left = end[(size > 1) & (size <= few)]
            for d in range(1, few):  # all small groups at once, by distance: all near pairs
                m = np.maximum(left - begin - d, 0)
                x = np.repeat(begin - np.cumsum(m) + m, m) + np.arange(m.sum())
                x = x[root[x] != root[x + d]]
                x, y, _ = near_pairs(n, bits, x, x + d)
                yield from rows(None, sid[x], sid[y])
            for s, e in zip(cut[size > few], end[size > few], strict=True):
                g = slice(s, e)
                if (root[g] != root[s]).any():
                    yield from group(label[s], own[g], sid[g], root[g], n[g], bits[g])

        held = []
        for batch in batches:
            held.append(batch)
            t = pa.Table.from_batches(held).combine_chunks()
            sign = [t.column(c).to_numpy() for c in ("label", "i", "j")]
            cut = np.append(0, np.flatnonzero((np.diff(sign[0]) != 0) | (np.diff(sign[1]) != 0) | (np.diff(sign[2]) != 0)) + 1)
            if len(cut) > 1:
                yield from settle(t.slice(0, int(cut[-1])).combine_chunks(), cut[:-1])
            held = t.slice(int(cut[-1])).to_batches()
        if held:
            yield from settle(pa.Table.from_batches(held).combine_chunks(), np.zeros(1, np.int64))

    dealt = at.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j")
    return stage(dealt.mapInArrow(lean(run), "label long, a long, b long"), "near")


def verified(texts: DataFrame, nodes: DataFrame, near: DataFrame) -> DataFrame:
    """Staged links (a, b): the pairs of near (a, b) whose token sets are similar enough."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                same = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(DEN * same >= NUM * (len(x) + len(y) - same))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = stage(near.select("a", "b").distinct(), "pairs")
    ends = pairs.select(F.col("a").alias("sid")).union(pairs.select(F.col("b").alias("sid"))).distinct()
    full = of_sets(texts, nodes, ends, lambda t: t.astype("<u8").tobytes(), "tokens")
    of = lambda side: full.select(F.col("sid").alias(side), F.col("tokens").alias(f"t_{side}"))
    return stage(pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "t_a", "t_b").mapInArrow(lean(run), "a long, b long"), "links")


def link(docs: DataFrame, row: bool = False, block: int = BLOCK, few: int = FEW, very_class: int = VERY_CLASS, hot_class: int = HOT_CLASS) -> DataFrame:
    """doc_id, n_shingles, component_id for docs (doc_id, text); with row also text_hash (xxhash64 of the text) and first: whether the row is its component's least by doc_id (nulls last) and text_hash."""
    spark = docs.sparkSession
    workers_import(spark)
    text, mark = F.col("text").cast("string"), staged_so_far()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tid"), text.alias("text"))
    made = sets_table(texts)
    sets = made.where("slice is null").select("doc_id", "tid", "sid", "n")
    classes = spark.sparkContext.broadcast(classes_of(merged(made.where("slice is not null").select("slice", "counts"), CLASS_BITS)))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tid"))
    nodes = stage(sets.where("n > 0").groupBy("sid").agg(F.min("tid").alias("tid"), least.alias("first")), "nodes")  # copies end here, by partial sums
    members = index(texts, classes, very_class, hot_class)
    bits = stage(of_sets(texts, nodes, members.select("sid").distinct(), parity, "bits"), "bits")
    near = compare(members, bits, None, block, few)
    links = verified(texts, nodes, near)
    open_ = stage(near.where("label is not null").join(links, ["a", "b"], "left_anti").select("label").distinct(), "open")
    if open_.take(1):
        roots = components(links)
        at = members.join(open_, "label", "left_semi")
        some = at.join(roots.withColumnRenamed("node", "sid"), "sid", "left").groupBy("label").agg(F.min(F.coalesce("root", "sid")).alias("lo"), F.max(F.coalesce("root", "sid")).alias("hi")).where("lo < hi").select("label")
        links = links.union(verified(texts, nodes, compare(at.join(some, "label", "left_semi"), bits, roots, block, few)))
    out, names = named(sets, nodes, components(links), row)
    drop_staged(spark, mark, made, names)
    return out


def named(sets: DataFrame, nodes: DataFrame, roots: DataFrame, row: bool) -> tuple[DataFrame, DataFrame]:
    """doc_id, n_shingles, component_id; and the staged names that these are read from. Ids are gathered by set and then by component with partial sums, so copies meet in no task before the last join, where Spark splits skewed sides."""
    first = stage(nodes.join(roots.withColumnRenamed("node", "sid"), "sid", "left").select("sid", "first", F.coalesce("root", "sid").alias("root")), "first")
    least = first.groupBy("root").agg(F.min("first").alias("least"))
    name = stage(first.join(least, "root").select("sid", "least"), "names")
    own = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("tid") == F.col("least.tid"))
    full = sets.where("n > 0").join(name, "sid").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("least.doc_id").alias("component_id"), F.col("tid").alias("text_hash"), own.alias("first"))
    out = full.union(sets.where("n = 0").select("doc_id", F.lit(0).cast("long"), F.col("doc_id"), "tid", F.lit(True)))
    return (out if row else out.drop("text_hash", "first")), name


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"))
