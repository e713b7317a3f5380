"""Quality rules (operator 10): a linear-chain conditional random field labels lines.

Each line gets binary features of its counts (see `features`); the field has two
states, content and boilerplate. It is fitted by the exact gradient of the
conditional likelihood (forward-backward) on a bounded sample: at most about
`sample` labelled texts of each quality, chosen by a hash threshold; a line takes
its text's label. Without labels the prior weights PRIOR stand. Viterbi decoding
labels the lines of every text; the share of words in content lines decides.

Defined cases: null text has no words and fails the base rules, as does any text
of under 20 words; repeated rows and rows of one doc_id get their own results; a
null doc_id is kept and has no label; ties between the states count as content; very
long texts are labelled whole, in a run of their own; an empty table gives no rows;
other columns are ignored; labels of unknown or repeated ids do no harm.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, lean, table, text_bytes, workers_import
from .stats import measure

N_FEATURES = 14
#: content minus boilerplate, by feature; the fit starts here and is drawn towards it
PRIOR = np.array([0.5, 0, 0, 0, -3.0, -1.0, -3.0, 0, -2.0, -1.0, -0.5, 0.5, 0, 0], float)
COLUMNS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"


def features(line: dict[str, np.ndarray]) -> np.ndarray:
    w, b = np.maximum(line["words"], 1), np.maximum(line["bytes"], 1)
    letters = np.maximum(line["upper"] + line["lower"], 1)
    return np.stack([
        np.ones(len(w)), line["words"] == 0, line["words"] < 4, line["words"] >= 12,
        line["symbols"] > 0.2 * w, line["symbols"] > 0, line["upper"] > 0.5 * letters, line["upper"] > 0.15 * letters,
        line["bangs"] > 0.3 * w, line["dup"], line["digits"] > 0.1 * b, line["short"] > 0.25 * w, line["short"] < 0.05 * w, b > 9 * w,
    ], 1).astype(np.float32)


def by_step(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First line and number of lines of each text that has lines, longest first, for running all chains side by side."""
    first = np.flatnonzero(np.diff(text, prepend=-1))
    size = np.diff(np.append(first, len(text)))
    order = np.argsort(-size, kind="stable")
    return first[order], size[order], text[first[order]]


def decode(score: np.ndarray, text: np.ndarray, stay: float) -> np.ndarray:
    """Whether each line is content: Viterbi over chains; score: content minus boilerplate; stay: reward for keeping the state."""
    out = np.zeros(len(score), bool)
    if not len(score):
        return out
    first, size, _ = by_step(text)
    back = np.zeros((len(score), 2), bool)
    best = np.stack((score[first], np.zeros(len(first))), 1)  # content, boilerplate
    for t in range(1, int(size[0])):
        n = int(np.searchsorted(-size, -t, side="left"))
        i, own = first[:n] + t, best[:n]
        to_c, to_b = own[:, 1] > own[:, 0] + stay, own[:, 0] > own[:, 1] + stay
        back[i, 0], back[i, 1] = to_c, to_b
        best[:n] = np.stack((np.where(to_c, own[:, 1], own[:, 0] + stay) + score[i], np.where(to_b, own[:, 0], own[:, 1] + stay)), 1)
    state = best[:, 1] > best[:, 0]
    for t in range(int(size[0]) - 1, -1, -1):
        n = int(np.searchsorted(-size, -t, side="left"))
        i = first[:n] + t
        out[i] = ~state[:n]
        state[:n] ^= back[i, state[:n].astype(int)]
    return out


def slope(x: np.ndarray, text: np.ndarray, content: np.ndarray, weights: np.ndarray, stay: float) -> tuple[float, np.ndarray, float]:
    """Log-likelihood of the given line labels and its derivatives by weights and stay: forward-backward over all chains side by side."""
    first, size, _ = by_step(text)
    kept = np.flatnonzero(text[1:] == text[:-1])
    same_seen = float((content[1:] == content[:-1])[kept].sum())
    f = (x @ weights) / 2
    node = np.stack((f, -f), 1)
    alpha, beta, same = node.copy(), np.zeros_like(node), 0.0
    for t in range(1, int(size[0])):
        n = int(np.searchsorted(-size, -t, side="left"))
        i = first[:n] + t
        p = alpha[i - 1]
        alpha[i] += np.stack((np.logaddexp(p[:, 0] + stay, p[:, 1]), np.logaddexp(p[:, 1] + stay, p[:, 0])), 1)
    for t in range(int(size[0]) - 1, 0, -1):
        n = int(np.searchsorted(-size, -t, side="left"))
        i = first[:n] + t
        q = beta[i] + node[i]
        beta[i - 1] = np.stack((np.logaddexp(q[:, 0] + stay, q[:, 1]), np.logaddexp(q[:, 1] + stay, q[:, 0])), 1)
    z = alpha + beta
    z_all = np.logaddexp(z[:, 0], z[:, 1])
    if len(kept):
        same = float(np.exp(alpha[kept] + node[kept + 1] + beta[kept + 1] + stay - z_all[kept][:, None]).sum())
    value = float(np.where(content > 0.5, f, -f).sum() + stay * same_seen - z_all[first].sum())
    return value, x.T @ (content - np.exp(z[:, 0] - z_all)), same_seen - same


def fit(x: np.ndarray, text: np.ndarray, content: np.ndarray, steps: int = 120, rate: float = 0.5, pull: float = 0.02) -> tuple[np.ndarray, float]:
    """Weights and stay reward of greatest penalised conditional likelihood of the given line labels."""
    weights, stay = PRIOR.copy(), 1.0
    if not len(x):
        return weights, stay
    grad_sq, gs_sq = np.full(N_FEATURES, 1e-3), 1e-3
    for _ in range(steps):
        _, g, gs = slope(x, text, content, weights, stay)
        g, gs = g / len(x) - pull * (weights - PRIOR), gs / len(x) - pull * (stay - 1.0)
        grad_sq, gs_sq = grad_sq + g * g, gs_sq + gs * gs
        weights, stay = weights + rate * g / np.sqrt(grad_sq), stay + rate * gs / np.sqrt(gs_sq)
    return weights, float(stay)


def train(docs: DataFrame, labels: DataFrame, sample: int = 1500) -> tuple[np.ndarray, float]:
    """Fit on about `sample` texts of each quality among docs (doc_id, text) with labels (doc_id, quality)."""
    known = labels.where("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    counts = {r.quality: r.n for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).where("quality in (0, 1)").collect()}
    share = F.when(F.col("quality") == 1, min(1.0, sample / max(counts.get(1, 1), 1))).otherwise(min(1.0, sample / max(counts.get(0, 1), 1)))
    chosen = known.where(F.col("quality").isin(0, 1) & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30)))

    def lines(batches):
        for batch in batches:
            a, offsets = text_bytes(batch.column(0))
            q = batch.column(1).to_numpy()
            for i, j in chunks(offsets):
                per_text, line = measure(a[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                x = features(line)
                cut = np.searchsorted(line["text"], np.arange(j - i + 1))
                yield pa.RecordBatch.from_arrays([pa.array([np.packbits(x[s:e].astype(bool)).tobytes() for s, e in zip(cut[:-1], cut[1:], strict=True)], pa.binary()), pa.array(np.diff(cut).astype(np.int32)), pa.array(q[i:j])], names=["x", "n", "quality"])

    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))  # a text an id, so that the sample stays bounded
    rows = texts.select("text", F.col("quality").cast("int")).mapInArrow(lean(lines), "x binary, n int, quality int").toPandas()  # the bounded sample: 14 bits a line
    if rows.empty:
        return PRIOR, 1.0
    x = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8))[: n * N_FEATURES].reshape(n, N_FEATURES) for b, n in zip(rows.x, rows.n, strict=True)]).astype(np.float32)
    return fit(x, np.repeat(np.arange(len(rows)), rows.n), np.repeat(rows.quality.to_numpy() == 1, rows.n).astype(float))


def judge(docs: DataFrame, model: tuple[np.ndarray, float], least_share: float = 0.5) -> DataFrame:
    workers_import(docs.sparkSession)
    weights, stay = model

    def run(batches):
        for batch in batches:
            a, offsets = text_bytes(batch.column(1))
            for i, j in chunks(offsets):
                t, line = measure(a[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                content = decode(features(line) @ weights, line["text"], stay)
                good = np.bincount(line["text"], line["words"] * content, j - i)
                share = good / np.maximum(t["n_words"], 1)
                failed = (t["n_words"] < 20) | (100 * t["n_repeat_words"] > 30 * t["n_words"])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(t[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), pa.array(failed), pa.array(~failed & (share >= least_share)), pa.array(share)], names=[c.split()[0] for c in COLUMNS.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), COLUMNS)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, train(docs, table(spark, sf_dir, "labels")))
