"""Language identification (operator 3).

Fit: letters of the training texts are cut into words; hashed 1- to 4-grams of
each word (with its edges) are counted by language over a bounded sample, at most
about `per_lang` texts of each language (a threshold on a hash of doc_id and text, set
from the exact counts; nothing of it reaches the driver but counts by slot). The model is a table of fixed size: log-probabilities by slot
and language, and the share of each script in each language's letters.

Predict: a word's script is that of its letters by Unicode ranges; languages that
hardly use it are ruled out for the word (none is if all hardly use it). A word's score for a language is the sum of its
grams' log-probabilities, divided by the three orders in which each letter counts. Viterbi then labels the words of a text with a penalty
for each change of language; spans are runs of one label, and the language with
the most letters wins. A path without changes is optimal whenever no stretch of
words gains more than half the penalty in another language (two language switches
would cost more), which is tested for all texts of a batch at once; only the
others run the recursion.

Defined cases: `und` for null text or text without letters (score 0); null lang
rows are not trained on; an empty training set gives `und` for all; repeated rows
and rows of one doc_id are rows of their own, with equal results for equal texts; a
null doc_id is kept and not held out; ties go to the first language by name; an empty
table gives no rows; a text of any length is read whole; other columns are ignored or,
with keep, kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from .common import U, chunks, mix, lean, table, text_bytes, workers_import

SLOTS = 1 << 16
SCRIPT_RANGES = (  # fixed values: first and last code point, script
    (0x41, 0x24F, 1), (0x370, 0x3FF, 2), (0x400, 0x52F, 3), (0x530, 0x58F, 4), (0x590, 0x5FF, 5), (0x600, 0x77F, 6), (0x900, 0x97F, 7), (0x980, 0x9FF, 8), (0xB80, 0xBFF, 9),
    (0xE00, 0xE7F, 10), (0x10A0, 0x10FF, 11), (0x1100, 0x11FF, 12), (0x1E00, 0x1EFF, 1), (0x1F00, 0x1FFF, 2), (0x3040, 0x30FF, 13), (0x3400, 0x9FFF, 14), (0xAC00, 0xD7AF, 12),
)
N_SCRIPTS = 16
_tables: list[np.ndarray] = []


def letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code point of each letter of the basic plane (0 for the rest), and its script."""
    if not _tables:
        low = np.zeros(0x10000, np.uint32)
        for c in range(0x10000):
            if chr(c).isalpha():
                low[c] = ord(x) if len(x := chr(c).lower()) == 1 else c
        script = np.zeros(0x10000, np.int64)
        for first, last, k in SCRIPT_RANGES:
            script[first : last + 1] = k
        _tables.extend((low, script))
    return _tables[0], _tables[1]


def word_grams(text: str, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts end to end (ends in code points): gram slots, first gram of each word, and of each word its text, script and letters."""
    low, script = letter_tables()
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.concatenate((c, np.zeros(1, np.uint32)))
    far = c > 0xFFFF
    v = low[np.where(far, 0, c)]
    if far.any():
        v[far] = [ord(chr(x).lower()[0]) if chr(x).isalpha() else 0 for x in c[far]]
    letter = v > 0
    edge = np.zeros(len(c), bool)
    edge[ends[:-1]] = True
    start = letter.copy()
    start[1:] &= ~letter[:-1] | edge[1:]
    at = np.flatnonzero(letter)
    if not len(at):
        none = np.empty(0, np.int64)
        return none, none, none, none, none
    n_word = np.cumsum(start[at]) - 1
    first = np.flatnonzero(start[at])
    # letters with an edge mark before each word: grams never cross words
    x = np.zeros(len(at) + len(first) + 4, np.uint64)
    pos = np.arange(len(at)) + n_word + 1
    x[pos] = v[at]
    marks = first + np.arange(len(first))
    x[marks] = U(1)
    total = len(at) + len(first)
    word_of = np.searchsorted(marks, np.arange(total), side="right") - 1
    h, slots, owner = x[:total] * U(0x9E3779B97F4A7C15), [], []
    whole = np.ones(total, bool)
    for n in range(2, 5):  # the mark counts as a letter
        nxt = x[n - 1 : n - 1 + total]
        whole &= (nxt != 1) & (nxt != 0)
        h = mix(h ^ (nxt * U(0xC2B2AE3D27D4EB4F) + U(n)))
        ok = np.flatnonzero(whole)
        slots.append((h[ok] >> U(48)).astype(np.int64))
        owner.append(word_of[ok])
    slots_, owner_ = np.concatenate(slots), np.concatenate(owner)
    order = np.argsort(owner_, kind="stable")
    slots_ = slots_[order]
    n_grams = np.bincount(owner_, minlength=len(first))
    p = at[first]
    return slots_, np.cumsum(n_grams) - n_grams, np.searchsorted(ends, p, side="right") - 1, script[np.where(far[p], 0, c[p])], np.diff(np.append(first, len(at)))


def texts_of(batch_col):
    a, offsets = text_bytes(batch_col)
    for i, j in chunks(offsets, 1 << 19):
        raw = a[offsets[i] : offsets[j]]
        count = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))  # code points before each byte
        yield i, j, raw.tobytes().decode(), count[offsets[i : j + 1] - offsets[i]]


def fit(docs: DataFrame, per_lang: int = 2500, train: Column | None = None) -> dict:
    """docs: doc_id, text, lang. The sample: texts whose hash is below per_lang / (number of texts of the language)."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.lit(True) if train is None else train))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return {"langs": [], "log_p": np.zeros((SLOTS, 0), np.float32), "scripts": np.zeros((N_SCRIPTS, 0), bool)}
    spark = docs.sparkSession
    keep = spark.createDataFrame([(x, i, min(1.0, per_lang / n)) for i, (x, n) in enumerate(sorted(counts.items()))], "lang string, k int, share double")
    sample = rows.join(F.broadcast(keep), "lang").where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < F.col("share") * (1 << 30)).select("k", "text")

    def count(batches):
        grams, scripts = np.zeros((len(langs), SLOTS), np.int64), np.zeros((len(langs), N_SCRIPTS), np.int64)
        for batch in batches:
            k = batch.column(0).to_numpy()
            for i, j, text, ends in texts_of(batch.column(1)):
                slots, first, doc, script, letters = word_grams(text, ends)
                if len(doc):
                    lang = k[i:j][doc]
                    grams += np.bincount(np.repeat(lang, np.diff(np.append(first, len(slots)))) * SLOTS + slots, minlength=grams.size).reshape(grams.shape)
                    scripts += np.bincount(lang * N_SCRIPTS + script, letters, scripts.size).astype(np.int64).reshape(scripts.shape)
        k, s = np.nonzero(grams)
        k2, s2 = np.nonzero(scripts)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((k, k2)).astype(np.int32)), pa.array(np.concatenate((s, s2 + SLOTS)).astype(np.int32)), pa.array(np.concatenate((grams[k, s], scripts[k2, s2])))], names=["k", "slot", "n"])

    got = sample.mapInArrow(lean(count), "k int, slot int, n long").groupBy("k", "slot").agg(F.sum("n").alias("n")).toPandas()  # at most len(langs) x (SLOTS + N_SCRIPTS) rows
    all_counts = np.zeros((SLOTS + N_SCRIPTS, len(langs)))
    all_counts[got.slot, got.k] = got.n
    grams, scripts = all_counts[:SLOTS] + 0.3, all_counts[SLOTS:]
    return {"langs": langs, "log_p": np.log(grams / grams.sum(0)).astype(np.float32), "scripts": scripts >= 0.001 * np.maximum(scripts.sum(0), 1)}


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """Best labels (words x languages) with a penalty for each change."""
    n, k = scores.shape
    back, best = np.empty((n, k), np.int32), scores[0].copy()
    own = np.arange(k)
    for i in range(1, n):
        top = int(best.argmax())
        stay = best >= best[top] - penalty
        back[i] = np.where(stay, own, top)
        best = np.where(stay, best, best[top] - penalty) + scores[i]
    out = np.empty(n, np.int32)
    out[-1] = best.argmax()
    for i in range(n - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


def label_words(scores: np.ndarray, starts: np.ndarray, penalty: float) -> np.ndarray:
    """Labels of the words of many texts; text i has words starts[i]:starts[i + 1] (none empty)."""
    n, k = scores.shape
    size = np.diff(starts)
    total = np.add.reduceat(scores, starts[:-1], axis=0)
    main = total.argmax(1)
    labels = np.repeat(main, size)
    if k == 1:
        return labels
    gain = scores - scores[np.arange(n), labels][:, None]
    run = np.cumsum(gain, axis=0, dtype=np.float64)
    run -= np.repeat(run[starts[:-1]] - gain[starts[:-1]], size, axis=0)
    # largest gain of a stretch: running sum less its minimum so far, text by text (a falling base keeps texts apart)
    fall = np.repeat(np.arange(len(size)) * (np.abs(run).max() * 2 + 1), size)[:, None]
    low = np.minimum.accumulate(np.minimum(run, 0) - fall, axis=0) + fall
    before = np.vstack((np.zeros((1, k)), low[:-1]))
    before[starts[:-1]] = 0
    most = np.maximum.reduceat((run - np.minimum(before, 0)).max(1), starts[:-1])
    for i in np.flatnonzero(most > penalty / 2):
        labels[starts[i] : starts[i + 1]] = viterbi(scores[starts[i] : starts[i + 1]], penalty)
    return labels


BARRED = -1000.0  # for a word in a script that a language hardly uses


def predict(docs: DataFrame, model: dict, penalty: float = 30.0, spans: bool = False, keep: bool = False) -> DataFrame:
    """doc_id, lang_pred, score (share of letters with that label); with spans also the labelled runs as `lang:words`; with keep all columns of docs instead of doc_id (lang_pred, score and spans replace columns of that name)."""
    spark = docs.sparkSession
    workers_import(spark)
    made = ["lang_pred", "score", *["spans"] * spans]
    docs = docs.drop(*made) if keep else docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    names_in, at = docs.columns, docs.columns.index("text")
    out_names = names_in if keep else ["doc_id"]
    schema = StructType([*(docs.schema[c] for c in out_names), StructField("lang_pred", StringType()), StructField("score", DoubleType()), *[StructField("spans", ArrayType(StringType()))] * spans])
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        names, barred = np.array([*m["langs"], "und"], object), np.where(m["scripts"] | ~m["scripts"].any(1, keepdims=True), 0, BARRED).astype(np.float32)
        for batch in batches:
            n = batch.num_rows
            pred, score, runs = np.full(n, len(names) - 1), np.zeros(n), [[] for _ in range(n)]
            for i, j, text, ends in texts_of(batch.column(at)) if len(names) > 1 else ():
                slots, first, doc, script, letters = word_grams(text, ends)
                if not len(doc):
                    continue
                scores = np.add.reduceat(m["log_p"][slots], first, axis=0) / np.float32(3) + barred[script]  # a letter stands in grams of three orders
                begin = np.flatnonzero(np.diff(doc, prepend=-1))
                starts = np.append(begin, len(doc))
                labels = label_words(scores, starts, penalty)
                share = np.zeros((j - i, len(names) - 1))
                np.add.at(share, (doc, labels), letters)
                rows = doc[begin]
                best = share[rows].argmax(1)
                pred[i + rows], score[i + rows] = best, share[rows, best] / share[rows].sum(1)
                if spans:
                    for r, s, e in zip(rows, starts[:-1], starts[1:], strict=True):
                        cut = np.flatnonzero(np.diff(labels[s:e], prepend=-1))
                        runs[i + r] = [f"{names[labels[s + c]]}:{w}" for c, w in zip(cut, np.diff(np.append(cut, e - s)), strict=True)]
            out = [*(batch.column(c) for c in out_names), pa.array(names[pred], pa.string()), pa.array(score)]
            yield pa.RecordBatch.from_arrays([*out, pa.array(runs, pa.list_(pa.string()))] if spans else out, names=[*out_names, *made])

    return docs.mapInArrow(lean(run), schema)


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    model = fit(docs.select("doc_id", "text", "lang"), train=~held_out())
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
