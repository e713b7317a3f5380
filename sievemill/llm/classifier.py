"""Quality classifier (operator 7): a weak-label model and a hashed linear scorer.

Overlapping heuristic labellers vote good, bad or abstain. Texts with the same
votes are alike to the label model, so vote patterns are counted over all texts in
a table of fixed size; expectation-maximisation on the counts gives each
labeller's accuracy on good and bad texts, and the posterior of every pattern. A
linear scorer over hashed words and counts is fitted to the posteriors of a bounded
sample (a hash threshold set for about `sample` texts) and then scores all texts.
A text is kept if posterior and score average 0.5 or more.

Defined cases: null text counts as empty (no words: posterior 0 and not kept);
repeated rows and rows of one doc_id get their own, equal results for equal texts; a
null doc_id is kept; ties (posterior and score average exactly 0.5) are kept; very long
texts are measured whole, in a run of their own; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, U, chunks, prefix_hash, span_hash, lean, table, text_bytes, words, workers_import
from .graph import tally
from .stats import measure

SLOTS = 1 << 16
VOTERS = ("symbols", "capitals", "exclamations", "repeated lines", "repeated words", "word length", "short words", "length", "insults")
N_VOTERS = len(VOTERS)
PATTERN_BITS = 15  # 3 ** 9 patterns fit
#: fixed values: English insults
INSULTS = ("idiot", "stupid", "moron", "trash", "loser", "scum", "disgusting", "pathetic", "worthless")


#: bad, good texts: chance of abstaining, voting bad, voting good, before any text is seen
PRIOR = np.array([[0.55, 0.3, 0.15], [0.6, 0.005, 0.395]])

#: texts that the prior counts as, for each labeller and class: enough to tell the classes apart, nothing against a corpus
PRIOR_WEIGHT = 30.0


def word_slots(a: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a = LOWER[a]
    s, e, doc = words(a, offsets)
    return span_hash(prefix_hash(a), s, e), doc, np.searchsorted(doc, np.arange(len(offsets)))


def insult_hashes() -> np.ndarray:
    out = []
    for w in INSULTS:
        for tail in ("", ".", ","):
            b = np.frombuffer((w + tail).encode(), np.uint8)
            out.append(span_hash(prefix_hash(b), np.zeros(1, np.int64), np.array([len(b)])))
    return np.unique(np.concatenate(out))


def votes(t: dict[str, np.ndarray], insults: np.ndarray) -> np.ndarray:
    """texts x labellers: 2 good, 1 bad, 0 abstains."""
    w, letters = np.maximum(t["n_words"], 1), np.maximum(t["upper"] + t["lower"], 1)
    mean = t["word_chars"] / w
    short = t["short"] - np.minimum(t["n_symbols"], t["short"])  # a symbol that stands alone is no word

    def rule(bad, good):
        return np.where(bad, 1, np.where(good, 2, 0))

    return np.stack([
        rule(t["n_symbols"] > 0.1 * w, False),
        rule(t["upper"] > 0.4 * letters, False),
        rule(t["bangs"] > 0.1 * w, False),
        rule(t["n_dup_lines"] * 3 > t["lines"], False),
        rule(t["n_repeat_words"] > 0.3 * w, False),
        rule((mean < 2.5) | (mean > 11), False),
        rule((short < 0.05 * w) & (w >= 20), short > 0.15 * w),
        rule(t["n_words"] < 1, t["n_words"] > 60),
        rule(insults >= 2, False),
    ], 1)


def patterns(v: np.ndarray) -> np.ndarray:
    return v @ 3 ** np.arange(N_VOTERS)


def expectation_maximisation(counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good by pattern; by labeller the share of right votes among its votes on bad and on good texts; share of good texts. Each labeller has a chance of each outcome on bad and on good texts, estimated from how labellers agree; a prior of PRIOR_WEIGHT texts only says which class is which."""
    seen = np.flatnonzero(counts[: 3**N_VOTERS])
    v = seen[:, None] // 3 ** np.arange(N_VOTERS) % 3
    n = counts[seen].astype(float)
    chance = np.repeat(PRIOR[:, None, :], N_VOTERS, 1)  # class x labeller x outcome
    share, post = 0.6, np.full(len(seen), 0.6)
    for _ in range(rounds if len(seen) else 0):
        logs = np.log(chance)[:, np.arange(N_VOTERS), v].sum(2)
        post = 1 / (1 + np.exp(np.clip(np.log(1 - share) + logs[0] - np.log(share) - logs[1], -500, 500)))
        share = float(np.clip((n @ post + 8) / (n.sum() + 10), 0.01, 0.99))
        for c, w in ((0, n * (1 - post)), (1, n * post)):
            for outcome in range(3):
                chance[c, :, outcome] = w @ (v == outcome) + PRIOR_WEIGHT * PRIOR[c, outcome]
            chance[c] /= chance[c].sum(1, keepdims=True)
    out = np.zeros(1 << PATTERN_BITS)
    out[seen] = post
    return out, np.stack((chance[0, :, 1], chance[1, :, 2])) / np.stack((chance[0, :, 1:].sum(1), chance[1, :, 1:].sum(1))), share


def fit_linear(rows, posterior: np.ndarray, rounds: int = 60, rate: float = 0.3) -> tuple[np.ndarray, float]:
    """Logistic weights for the normalised word counts in rows (slots, values, pattern), against soft labels."""
    weights, bias = np.zeros(SLOTS), 0.0
    if not len(rows):
        return weights, bias
    doc = np.repeat(np.arange(len(rows)), [len(b) // 4 for b in rows.slots])
    slot = np.concatenate([np.frombuffer(b, "<i4") for b in rows.slots]).astype(np.int64)
    value = np.concatenate([np.frombuffer(b, "<f4") for b in rows["values"]]).astype(float)
    goal, g_sq, b_sq = posterior[rows.pattern.to_numpy()], np.full(SLOTS, 1e-8), 1e-8
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(np.bincount(doc, value * weights[slot], len(rows)) + bias)))
        diff = (goal - p) / len(rows)
        g, b = np.bincount(slot, value * diff[doc], SLOTS) - 1e-6 * weights, diff.sum()
        g_sq, b_sq = g_sq + g * g, b_sq + b * b
        weights, bias = weights + rate * g / np.sqrt(g_sq), bias + rate * b / np.sqrt(b_sq)
    return weights, float(bias)


def classify(docs: DataFrame, sample: int = 4000) -> DataFrame:
    """doc_id, posterior, score, kept. The estimated accuracies of the labellers go to the log."""
    spark = docs.sparkSession
    workers_import(spark)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    bad_words = insult_hashes()

    def seen(batch_col):
        a, offsets = text_bytes(batch_col)
        for i, j in chunks(offsets):
            x, o = a[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            h, doc, _ = word_slots(x, o)
            hit = bad_words[np.minimum(np.searchsorted(bad_words, h), len(bad_words) - 1)] == h
            t = measure(x, o)[0]
            slot = (h >> U(48)).astype(np.int64)
            yield i, j, t, patterns(votes(t, np.bincount(doc, hit, j - i))), slot, doc

    def count(batches):
        out = np.zeros(1 << PATTERN_BITS, np.int64)
        for batch in batches:
            for _, _, _, p, _, _ in seen(batch.column(1)):
                out += np.bincount(p, minlength=len(out))
        return out

    counts = tally(rows, count, PATTERN_BITS)
    posterior, accuracy, share_good = expectation_maximisation(counts)

    def vectors(batches):
        for batch in batches:
            for i, j, t, p, slot, doc in seen(batch.column(1)):
                one = np.unique(doc * SLOTS + slot, return_counts=True)
                d, value = one[0] // SLOTS, (one[1] / np.sqrt(np.maximum(t["n_words"], 1))[one[0] // SLOTS]).astype("<f4")
                cut, s = np.searchsorted(d, np.arange(j - i + 1)), (one[0] % SLOTS).astype("<i4")
                yield pa.RecordBatch.from_arrays([pa.array([s[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)], pa.binary()), pa.array([value[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)], pa.binary()), pa.array(p.astype(np.int32))], names=["slots", "values", "pattern"])

    share = min(1.0, sample / max(int(counts.sum()), 1))
    chosen = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < share * (1 << 30)).groupBy("doc_id", F.xxhash64("text")).agg(F.min("text").alias("text")).select("doc_id", "text")  # equal rows count once: the sample stays bounded
    weights, bias = fit_linear(chosen.mapInArrow(lean(vectors), "slots binary, values binary, pattern int").toPandas(), posterior)  # the bounded sample
    sent = spark.sparkContext.broadcast((posterior, weights, bias))
    told = [f"{name}: {a:.3f} of its votes on bad texts right, {b:.3f} on good ones" for name, a, b in zip(VOTERS, *accuracy, strict=True)]
    logging.getLogger(__name__).info("share of good texts %.3f; %s", share_good, "; ".join(told))

    def score(batches):
        posterior, weights, bias = sent.value
        for batch in batches:
            for i, j, t, p, slot, doc in seen(batch.column(1)):
                z = np.bincount(doc, weights[slot], j - i) / np.sqrt(np.maximum(t["n_words"], 1)) + bias
                has = t["n_words"] > 0
                s, q = np.where(has, 1 / (1 + np.exp(-np.clip(z, -500, 500))), 0.0), np.where(has, posterior[p], 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(q), pa.array(s), pa.array(s + q >= 1)], names=["doc_id", "posterior", "score", "kept"])

    return rows.mapInArrow(score, "doc_id long, posterior double, score double, kept boolean")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"))
