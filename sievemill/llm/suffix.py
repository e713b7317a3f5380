"""Suffix-array dedup (operator 5): removal of byte strings of a given length that start anywhere twice.

A sparse suffix array decides exactly which windows of LENGTH bytes repeat:

1. Anchors. In each window the 32-gram with the least hash (the leftmost of equal
   ones) is its anchor; equal windows have their anchors at equal places. About
   one position in 185 is an anchor. Anchors whose 32-gram occurs once are dropped.
2. The suffixes at the other anchors, with the bytes before them that their windows
   need, are range-partitioned by their leading 8 bytes with splitters from a sample
   of them. Cuts lie between different leading bytes, so two suffixes that share an
   anchor never stand on two sides of a boundary. A partition is worked on in buckets
   of about PER_BUCKET suffixes, cut the same way.
3. A bucket is sorted by multikey quicksort (three-way partition around a pivot word
   of 8 bytes, all open ranges in one pass), once by the suffixes and once by the
   reversed bytes before the anchors. Common prefixes of neighbours give classes at
   any depth: two windows that start d bytes before their anchors are equal if their
   suffixes agree in LENGTH - d bytes and what precedes them in d bytes.
4. Leading bytes that more than HOT suffixes share go another exact way: their
   windows' fingerprints (128 bits) are counted with partial sums, so no task gets
   them all.
5. The intervals found are joined with the texts by a fingerprint of the text.

Copies: a text that stands in several rows is worked on once and removed whole (if
it has LENGTH bytes). Windows that repeat within one partition's contexts are
settled there and sent once.

Defined cases: null text counts as empty; texts shorter than LENGTH stay as they
are; repeated rows are copies; an empty table gives no rows; other columns are
ignored; the whole text is read, whatever its length.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .common import _A_INV, U, chunks, drop_staged, mix, powers, prefix_hash, span_hash, lean, stage, staged_so_far, table, text_bytes, workers_import
from .graph import FILTER_BITS, in_filter, tally

GRAM = 32
PER_BUCKET = 25_000
COLUMNS = ["key", "tid", "at", "s0", "s1", "lead"]  # at = -1: bytes s0 to s1 are known to repeat
SECOND = 0xBF58476D1CE4E5B9  # of the second fingerprint, and its inverse
SECOND_INV = pow(SECOND, -1, 2**64)
HOT = 50_000
MOST_PARTITIONS = 20_000


def anchors(a: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Anchor position, first and last window start (in a), text number and hash of each anchor of a run of texts; and the prefix hash."""
    none = np.empty(0, np.int64)
    p = prefix_hash(a)
    if len(a) < length:
        return none, none, none, none, none.view(np.uint64), p
    h = mix((p[GRAM:] - p[:-GRAM]) * powers(_A_INV, len(a))[: len(a) - GRAM + 1])
    bits = U(int(len(h)).bit_length())
    b = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    width, span = length - GRAM + 1, 1
    while 2 * span <= width:
        b = np.minimum(b[:-span], b[span:])
        span *= 2
    if span < width:
        b = np.minimum(b[: len(b) - (width - span)], b[width - span :])
    n = np.maximum(np.diff(offsets) - length + 1, 0)  # windows of each text
    if not n.sum():
        return none, none, none, none, none.view(np.uint64), p
    s = np.repeat(offsets[:-1] - np.cumsum(n) + n, n) + np.arange(n.sum())
    doc = np.repeat(np.arange(len(n)), n)
    at = (b[s] & ((U(1) << bits) - U(1))).astype(np.int64)
    cut = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
    return at[cut], s[cut], s[np.append(cut[1:], len(s)) - 1], doc[cut], h[at[cut]], p


def multikey_sort(rows: np.ndarray) -> np.ndarray:
    """Order of rows (n x depth words) by multikey quicksort: every open range is split three ways around its own pivot; the middle part goes on with the next word."""
    n, depth = rows.shape
    order = np.arange(n)
    begin, end, level = np.array([0]), np.array([n]), np.array([0])
    while True:
        live = (end - begin > 1) & (level < depth)
        begin, end, level = begin[live], end[live], level[live]
        if not len(begin):
            return order
        size = end - begin
        base = np.cumsum(size) - size
        where = np.arange(size.sum()) + np.repeat(begin - base, size)
        word = rows[order[where], np.repeat(level, size)]
        pivot = np.repeat(word[base + size // 2], size)
        side = np.where(word < pivot, 0, np.where(word == pivot, 1, 2))
        part = np.repeat(np.arange(len(size)) * 3, size) + side
        order[where] = order[where[np.argsort(part, kind="stable")]]
        count = np.bincount(part, minlength=3 * len(size))
        ends = np.repeat(begin, 3) + np.cumsum(count.reshape(-1, 3), axis=1).ravel()
        level = np.repeat(level, 3) + np.tile([0, 1, 0], len(size))
        begin, end = ends - count, ends


def padded(flat: np.ndarray, begin: np.ndarray, size: np.ndarray, width: int, back: bool = False) -> np.ndarray:
    """Bytes flat[begin:begin + size] as rows of width; back: read from begin towards the front."""
    out = np.zeros((len(begin), width), np.uint8)
    row = np.repeat(np.arange(len(begin)), size)
    col = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out[row, col] = flat[np.repeat(begin, size) + (-col if back else col)]
    return out


def ranked(rows: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of rows, and the common prefix of each with the one before it (-1 for the first)."""
    order = multikey_sort(np.ascontiguousarray(rows).view(">u8").astype(np.uint64))
    lcp = np.full(len(order), -1, np.int64)
    for k in range(1, len(order), 4096):
        i = np.arange(k, min(k + 4096, len(order)))
        differ = rows[order[i]] != rows[order[i - 1]]
        first = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
        lcp[i] = np.minimum(first, np.minimum(size[order[i]], size[order[i - 1]]))
    return order, lcp


def repeats(flat: np.ndarray, offsets: np.ndarray, left: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of contexts (bytes flat[offsets[i]:offsets[i + 1]], anchor at left[i]): least and greatest d with a repeated window, (length, -1) for none. Windows of one anchor overlap, so all between the two is covered."""
    n = len(left)
    pad = -(-length // 8) * 8
    size = np.diff(offsets) - left
    low, high = np.full(n, length), np.full(n, -1)
    if n < 2:
        return low, high
    r_order, r_lcp = ranked(padded(flat, offsets[:-1] + left, size, pad), size)
    l_order, l_lcp = ranked(padded(flat, offsets[:-1] + left - 1, left, pad, back=True), left)
    best = np.empty(n, np.int64)  # longest agreement with any other, either side
    best[r_order] = np.maximum(r_lcp, np.append(r_lcp[1:], -1))
    near = np.empty(n, np.int64)
    near[l_order] = np.maximum(l_lcp, np.append(l_lcp[1:], -1))
    first, last = np.maximum(length - best, length - size), np.minimum(near, left)  # d that can repeat
    open_ = first <= last
    r_class, l_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(int(first[open_].min(initial=length)), int(last[open_].max(initial=-1)) + 1):
        own = np.flatnonzero((first <= d) & (d <= last))
        if len(own) < 2:
            continue
        r_class[r_order] = np.cumsum(r_lcp < length - d)
        l_class[l_order] = np.cumsum(l_lcp < d)
        key = r_class[own] * (n + 1) + l_class[own]
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        hit = own[order[np.append(same, False) | np.append(False, same)]]
        low[hit] = np.minimum(low[hit], d)
        high[hit] = d
    return low, high


def repeated_anchors(rows: DataFrame) -> DataFrame:
    """Of rows dealt by key, those whose key is not alone, and those with known repeats."""

    def run(batches):
        held = None
        for batch in batches:
            t = pa.Table.from_batches([held, batch] if held is not None else [batch]).combine_chunks()
            key = t.column(0).to_numpy()
            same = key[1:] == key[:-1]
            dup = np.append(same, False) | np.append(False, same)
            if held is not None:
                dup[0] |= held_dup
            dup |= t.column(2).to_numpy() < 0
            held_dup = bool(dup[-1])
            yield from t.slice(0, len(key) - 1).filter(pa.array(dup[:-1])).drop_columns(["key"]).to_batches()
            held = t.slice(len(key) - 1).combine_chunks().to_batches()[0]
        if held is not None and held_dup:
            yield held.drop_columns(["key"])

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(lean(run), "tid long, at int, s0 int, s1 int, lead long")


def intervals(texts: DataFrame, length: int, per_bucket: int, hot: int) -> DataFrame:
    """Staged rows tid, s, e: repeated stretches of the texts (tid, text)."""
    spark = texts.sparkSession

    def find(batches):
        seen: set[int] = set()
        for batch in batches:
            a, offsets = text_bytes(batch.column(1))
            tids = batch.column(0).to_numpy()
            new = np.array([t not in seen and not seen.add(t) for t in tids.tolist()], bool)
            for i, j in chunks(offsets):
                if not new[i:j].any():
                    continue
                x = a[offsets[i] : offsets[j]]
                at, s0, s1, doc, h, p = anchors(x, offsets[i : j + 1] - offsets[i], length)
                keep = np.flatnonzero(new[i:j][doc])
                at, s0, s1, doc, h = (v[keep] for v in (at, s0, s1, doc, h))
                base = offsets[i:j] - offsets[i]
                # equal contexts within this run of texts repeat whole: their bytes are noted now, and one of them goes on
                _, first, which, count = np.unique(mix(span_hash(p, s0, s1 + length) + (at - s0).astype(np.uint64)), return_index=True, return_inverse=True, return_counts=True)
                twice = np.flatnonzero(count[which] > 1)
                if len(twice):
                    d, s, e = doc[twice], s0[twice], s1[twice] + length
                    cut = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (s[1:] > e[:-1])))
                    d, s, e = d[cut], s[cut] - base[d[cut]], e[np.append(cut[1:], len(e)) - 1] - base[d[cut]]
                    t = tids[i:j][d]
                    yield pa.RecordBatch.from_arrays([pa.array(mix(t.view(np.uint64)).view(np.int64)), pa.array(t), pa.array(np.full(len(t), -1, np.int32)), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(np.zeros(len(t), np.int64))], names=COLUMNS)
                at, s0, s1, doc, h = (v[np.sort(first)] for v in (at, s0, s1, doc, h))
                lead = np.zeros(len(at), np.uint64)
                for k in range(8):
                    lead = lead << U(8) | x[at + k].astype(np.uint64)
                base = base[doc]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(tids[i:j][doc]), *(pa.array((v - base).astype(np.int32)) for v in (at, s0, s1)), pa.array((lead >> U(1)).astype(np.int64))], names=COLUMNS)

    rows = stage(repeated_anchors(texts.mapInArrow(lean(find), "key long, tid long, at int, s0 int, s1 int, lead long")), "anchors")
    known = rows.where("at < 0").select("tid", F.col("s0").alias("s"), F.col("s1").alias("e"))
    found = rows.where("at >= 0")
    n = found.count()
    if not n:
        return known
    n_buckets = min(MOST_PARTITIONS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // per_bucket)))
    some = np.sort(found.select("lead").sample(min(1.0, 100 * n_buckets / n), 7).toPandas()["lead"].to_numpy())  # about 100 for each splitter; they only balance the work
    cuts = some[np.arange(1, n_buckets) * len(some) // n_buckets] if len(some) else np.empty(0, np.int64)
    mask = U((1 << FILTER_BITS) - 1)

    def count_leads(batches):
        out = np.zeros(1 << FILTER_BITS, np.int64)
        for batch in batches:
            out += np.bincount((mix(batch.column(0).to_numpy().view(np.uint64)) & mask).astype(np.int64), minlength=len(out))
        return out

    often = spark.sparkContext.broadcast(tally(found.select("lead"), count_leads, FILTER_BITS) > hot)
    wanted = in_filter(found.select("tid"))

    def contexts(batches):
        seen: set[int] = set()
        first: dict[int, tuple] = {}  # context -> its text and window starts, until a second one is met
        for batch in batches:
            out: list[tuple] = []
            bodies: list[bytes] = []
            if len(first) > 1 << 17:  # what is forgotten here is compared in its bucket
                first.clear()
            for tid, text, marks in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                if tid in seen:
                    continue
                seen.add(tid)
                raw = text.as_buffer().to_pybytes()
                for m in marks:
                    at, s0, s1, lead = m["at"], m["s0"], m["s1"], m["lead"]
                    body = raw[s0 : s1 + length]
                    if often.value[int(mix(np.array([lead], np.int64).view(np.uint64))[0] & mask)]:
                        b = np.frombuffer(body, np.uint8)
                        p = prefix_hash(b)
                        k = np.arange(s1 - s0 + 1)
                        p2 = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(b.astype(np.uint64) + U(0x51ED270B)) * powers(SECOND, len(b)))))
                        first_hash, second = (mix((x[k + length] - x[k]) * powers(inverse, len(x))[k]).view(np.int64).tolist() for x, inverse in ((p, _A_INV), (p2, SECOND_INV)))
                        for i, w, w2 in zip(k.tolist(), first_hash, second, strict=True):
                            out.append((2, w, w2, tid, s0 + i, 0))
                            bodies.append(b"")
                        continue
                    sign = hash((at - s0, body))
                    if sign in first:
                        if first[sign]:
                            tid0, s0_0, e_0 = first[sign]
                            out.append((1, 0, 0, tid0, s0_0, 0))
                            bodies.append(e_0.to_bytes(4, "little"))
                            first[sign] = ()
                        out.append((1, 0, 0, tid, s0, 0))
                        bodies.append((s1 + length).to_bytes(4, "little"))
                    else:
                        first[sign] = (tid, s0, s1 + length)
                        out.append((0, int(np.searchsorted(cuts, lead, side="left")), lead, tid, s0, at - s0))
                        bodies.append(body)
            if out:
                kind, k, lead, tid, s, left = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(k, pa.int64()), pa.array(lead, pa.int64()), pa.array(tid, pa.int64()), pa.array(s, pa.int32()), pa.array(left, pa.int32()), pa.array(bodies, pa.binary())], names=["kind", "k", "lead", "tid", "s", "left", "body"])

    def once(batches):
        """One text of those with equal tid in a partition, if it has marks: copies don't meet in one task."""
        seen: set[int] = set()
        for batch in wanted(batches):
            yield batch.filter(pa.array([t not in seen and not seen.add(t) for t in batch.column(0).to_pylist()], pa.bool_()))

    marks = found.groupBy("tid").agg(F.collect_set(F.struct("at", "s0", "s1", "lead")).alias("marks"))
    made = texts.mapInArrow(lean(once), "tid long, text string").join(marks, "tid").select("tid", "text", "marks").mapInArrow(lean(contexts), "kind int, k long, lead long, tid long, s int, left int, body binary")

    def bucket(batches):
        """Rows come by kind and leading bytes: buckets first, one after the other, then what needs no comparison."""
        held: list[pa.RecordBatch] = []
        names = ["tid", "s", "e", "w", "w2"]

        def settle(t):
            tid, s, left = (t.column(c).to_numpy() for c in ("tid", "s", "left"))
            flat, offsets = text_bytes(t.column("body"))
            low, high = repeats(flat, offsets, left.astype(np.int64), length)
            hit = np.flatnonzero(high >= 0)
            at = s[hit] + left[hit]
            none = pa.nulls(len(hit), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(tid[hit]), pa.array((at - high[hit]).astype(np.int32)), pa.array((at - low[hit] + length).astype(np.int32)), none, none], names=names)

        for batch in batches:
            kind = batch.column("kind").to_numpy()
            own = batch.filter(pa.array(kind == 0))
            if own.num_rows:
                held.append(own)
                if sum(x.num_rows for x in held) >= per_bucket:
                    t = pa.Table.from_batches(held).combine_chunks()
                    lead = t.column("lead").to_numpy()
                    cut = np.flatnonzero(lead[1:] != lead[:-1])
                    if len(cut):
                        yield settle(t.slice(0, int(cut[-1]) + 1).combine_chunks())
                        held = t.slice(int(cut[-1]) + 1).to_batches()
            own = batch.filter(pa.array(kind == 1))
            if own.num_rows:
                none = pa.nulls(own.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([own.column("tid"), own.column("s"), pa.array([int.from_bytes(b, "little") for b in own.column("body").to_pylist()], pa.int32()), none, none], names=names)
            own = batch.filter(pa.array(kind == 2))
            if own.num_rows:
                yield pa.RecordBatch.from_arrays([own.column("tid"), own.column("s"), pa.array(own.column("s").to_numpy() + length, pa.int32()), own.column("k"), own.column("lead")], names=names)
        if held:
            yield settle(pa.Table.from_batches(held).combine_chunks())

    spread = F.when(F.col("kind") == 0, F.col("k")).otherwise(F.pmod(F.xxhash64("tid", "s"), F.lit(n_buckets)))
    dealt = made.repartition(n_buckets, spread).sortWithinPartitions("kind", "lead")
    got = stage(dealt.mapInArrow(lean(bucket), "tid long, s int, e int, w long, w2 long"), "stretches")
    windows = got.where("w is not null")
    often_ = windows.groupBy("w", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w", "w2")
    return known.union(got.where("w is null").select("tid", "s", "e")).union(windows.join(often_, ["w", "w2"]).select("tid", "s", "e"))


def dedup(docs: DataFrame, length: int = 400, per_bucket: int = PER_BUCKET, hot: int = HOT, cut_text: bool = False) -> DataFrame:
    """docs with new columns n_bytes, n_removed, n_spans, kept (the remaining bytes), which replace columns of these names (__tid and __cuts are reserved). cut_text: text becomes what remains, without the parts of characters that a cut has split."""
    workers_import(docs.sparkSession)
    text, mark = F.coalesce(F.col("text").cast("string"), F.lit("")), staged_so_far()
    texts = docs.select(F.xxhash64(text).alias("tid"), text.alias("text"))
    long = texts.select("tid", F.octet_length("text").alias("e"), F.xxhash64(F.lit(1), "text").alias("again")).where(F.col("e") >= length)
    whole = long.groupBy("tid", "e", "again").agg(F.count(F.lit(1)).alias("n")).where("n > 1")  # equal in length and in two 64-bit hashes
    cut = intervals(texts, length, per_bucket, hot).union(whole.select("tid", F.lit(0), "e"))
    cut = stage(cut.groupBy("tid").agg(F.sort_array(F.collect_set(F.struct("s", "e"))).alias("cuts")), "cuts")
    drop_staged(docs.sparkSession, mark, cut)
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "kept")
    names = docs.columns
    tagged = docs.withColumn("__tid", F.xxhash64(text))
    cut = cut.select(F.col("tid").alias("__tid"), F.col("cuts").alias("__cuts"))
    out_schema = StructType([*docs.schema.fields, StructField("n_bytes", LongType()), StructField("n_removed", LongType()), StructField("n_spans", LongType()), StructField("kept", BinaryType())])
    t = names.index("text")

    def apply(batches):
        for batch in batches:
            made: list[tuple] = []
            for text, cuts in zip(batch.column(t), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                parts, end, removed, spans = [], 0, 0, 0
                for c in cuts or ():
                    s, e = c["s"], c["e"]
                    if s > end or not spans:
                        parts.append(raw[end:s])
                        spans += 1
                        removed += e - s
                        end = e
                    elif e > end:
                        removed += e - end
                        end = e
                parts.append(raw[end:])
                made.append((len(raw), removed, spans, b"".join(parts)))
            n, removed, spans, kept = zip(*made, strict=True) if made else ((), (), (), ())
            cols = list(batch.columns[: len(names)])
            if cut_text:
                cols[t] = pa.array([b.decode("utf-8", "ignore") if r else x for b, r, x in zip(kept, removed, cols[t].to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], names=[*names, "n_bytes", "n_removed", "n_spans", "kept"])

    def split(keep):
        return tagged.mapInArrow(lean(in_filter(cut.select("__tid"), keep, "__tid")), tagged.schema)

    touched = split(True).join(cut, "__tid", "left").select(*[F.col(f"`{c}`") for c in names], "__cuts").mapInArrow(lean(apply), out_schema)
    rest = split(False).select(*[F.col(f"`{c}`") for c in names], F.octet_length(text).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), text.cast("binary").alias("kept"))
    return touched.union(rest)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup(docs, cut_text=True)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), (F.col("n_removed") > 0).alias("changed"), "text")
