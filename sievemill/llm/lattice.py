"""LM scoring by the likelihood of a subword lattice.

The probability of a text is the sum over all ways to cut it into pieces of the product of
the pieces' probabilities. Pieces never cross words, so it is a product over words, each of
which is a forward recursion in log space over its lattice: words lose A-Z's case, get the
mark U+2581 in front, and an end token follows the last one. A character that is no piece
is one step of its byte pieces.

The weights are those of an existing vocabulary. Where its scores are no log probabilities
but whole numbers, ranks of merges (as in a file that merges pairs), the piece of rank r gets
a weight of 1 / (1 + r).
They are the prior; expectation-maximisation over the counted words of the training
documents re-estimates them (`rounds` passes; expected counts of pieces from forward and
backward states), with the prior worth `strength` pieces. The sum over all texts is at most
1: spaces are not modelled.

Scale: words are counted within tasks before the shuffle, the lattice of each distinct word
is worked on once, and documents meet the words' values in two ways. Words that make up at
least 1/2^18 of all tokens, of 64 bytes at most, are broadcast (there can't be more than
2^18 of them); each other word is rare enough that no key is hot, and goes through a join
as posting lists, a row per word and task. All corpus counts grow with the input and stay
in staged tables; the driver sees the piece vocabulary, the broadcast words and two sums.

Defined cases: null and empty texts have the end token alone; a null doc_id counts as ''
in the crc32; repeated rows are rows of their own; without training documents N = V = 0,
the base score's fraction is 0.1 / 0.1 and the weights are the prior; words of any length
take time in proportion to it; an empty table gives no rows; further columns are ignored.
Pieces are found by 64-bit hashes of their beginnings, in arrays of words of equal length.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CACHES, LOWER, drop_staged, lean, stage, staged_so_far, table, workers_import

MARK = "▁"
HEAVY, HEAVY_BYTES = 1 << 18, 64
HELD = 400_000  # counters or list entries of a task before it hands them on
ROUNDS, STRENGTH = 2, 1000.0
LONG = 48  # characters from which a word is worked on alone
_LOWER = LOWER.tobytes()
_U = np.uint64
_BASE, _ALL = _U(0x9E3779B97F4A7C15), 2**64 - 1
LOG10 = math.log(10)


# ---------------------------------------------------------------- vocabulary
class Vocabulary:
    """Pieces of a file with the natural logarithms of their weights, and where to find them by hash."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        scores, self.pieces, self.byte_piece = [], [], [0] * 256
        for i in range(sp.get_piece_size()):
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                continue
            text = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_piece[int(text[3:5], 16)] = len(self.pieces)
            elif MARK in text[1:]:
                continue  # pieces of several words
            self.pieces.append(None if sp.is_byte(i) else text)
            scores.append(None if sp.is_byte(i) else sp.get_score(i))
        known = [s for s in scores if s is not None]
        least = min(known, default=0.0)
        scores = np.array([least if s is None else s for s in scores])
        if all(s == int(s) for s in known):  # ranks
            logs = np.empty(len(scores))
            logs[np.argsort(-scores, kind="stable")] = -np.log1p(np.arange(len(scores)))
        else:
            logs = scores
        self.log = logs - np.logaddexp.reduce(np.append(logs, logs.max()))  # the end token is as likely as the first piece
        self.end = float(logs.max() - np.logaddexp.reduce(np.append(logs, logs.max())))
        self.index()

    def index(self) -> None:
        """A table of all beginnings of pieces by hash: the piece's number, or -1 where it is a beginning only."""
        self.of = {t: k for k, t in enumerate(self.pieces) if t is not None}
        self.longest = max(map(len, self.of), default=1)
        known: dict[int, int] = {}
        for text, k in self.of.items():
            h = 0
            for i, c in enumerate(text, 1):
                h = (h + ord(c) + 1) * int(_BASE) & _ALL
                if i == len(text):
                    known[h] = k
                else:
                    known.setdefault(h, -1)
        h = _mix(np.fromiter(known, np.uint64, len(known)))
        order = np.argsort(h)
        self.shift = _U(64 - max(1, (8 * len(h)).bit_length()))
        slot = (h[order] >> self.shift).astype(np.int64)
        self.first = np.searchsorted(slot, np.arange((1 << (64 - int(self.shift))) + 1)).astype(np.int32)
        self.most = int(np.diff(self.first).max())
        self.keys = np.append(h[order], np.zeros(self.most, np.uint64))
        self.ids = np.append(np.fromiter(known.values(), np.int64, len(known))[order], np.full(self.most, -2))

    def find(self, h: np.ndarray) -> np.ndarray:
        """For each hash the number of the piece, -1 for a beginning of pieces, -2 for neither."""
        h = _mix(h)
        at = self.first[(h >> self.shift).astype(np.int64)]
        out = np.full(len(h), -2, np.int64)
        for _ in range(self.most):
            hit = np.flatnonzero(self.keys[at] == h)
            out[hit] = self.ids[at[hit]]
            at = at + 1
        return out

    def spelled(self, c: str) -> list[int]:
        """Byte pieces of a character; a lone surrogate stands for a mark in a text (see marked)."""
        return [self.byte_piece[b] for b in (MARK if c == "\ud800" else c).encode("utf-8", "surrogateescape")]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(32))


def marked(word: bytes) -> str:
    return MARK + word.decode("utf-8", "surrogateescape").replace(MARK, "\ud800")


# ---------------------------------------------------------------- lattices
def forward(words: list[str], v: Vocabulary, log: np.ndarray, expect: np.ndarray | None = None, times: np.ndarray | None = None) -> np.ndarray:
    """Natural log of the marginal probability of each of some words of one length; with expect, the expected counts of their pieces, `times` over, are added to it.

    From each place, the words are followed for as long as they go on like a piece."""
    length, m = len(words[0]), len(words)
    codes = np.ascontiguousarray(np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(m, length).T).astype(np.uint64) + _U(1)
    alpha = np.full((length + 1, m), -np.inf)
    alpha[0] = 0
    edges = []
    for i in range(length):
        here, alive, h = alpha[i], np.arange(m), np.zeros(m, np.uint64)
        for n in range(1, min(v.longest, length - i) + 1):
            h = (h + codes[i + n - 1][alive]) * _BASE
            found = v.find(h)
            yes = np.flatnonzero(found >= 0)
            if len(yes):
                at, k = alive[yes], found[yes]
                w = log[k]
                alpha[i + n, at] = np.logaddexp(alpha[i + n, at], here[at] + w)
                if expect is not None:
                    edges.append((i, n, at, w, k))
            if n == 1 and len(yes) < m:
                at = np.flatnonzero(found < 0)
                own, which = np.unique(codes[i][at], return_inverse=True)
                spelt = [v.spelled(chr(int(c) - 1)) for c in own]
                w = np.array([log[x].sum() for x in spelt])[which]
                alpha[i + 1, at] = np.logaddexp(alpha[i + 1, at], here[at] + w)
                if expect is not None:
                    edges.append((i, 1, at, w, (spelt, which)))
            on = np.flatnonzero(found > -2)
            if not len(on):
                break
            alive, h = alive[on], h[on]
    if expect is not None:
        beta = np.full((length + 1, m), -np.inf)
        beta[length] = 0
        for i, n, at, w, k in reversed(edges):  # from the last place on: what leads on from i + n is complete
            through = w + beta[i + n, at]
            beta[i, at] = np.logaddexp(beta[i, at], through)
            share = times[at] * np.exp(alpha[i, at] + through - alpha[length, at])
            if isinstance(k, tuple):
                for x, total in zip(k[0], np.bincount(k[1], share, len(k[0])), strict=True):
                    np.add.at(expect, x, total)
            else:
                expect += np.bincount(k, share, len(expect))
    return alpha[length]


def forward_one(word: str, v: Vocabulary, log: np.ndarray, expect: np.ndarray | None = None, times: float = 0.0) -> float:
    """The same for one word, however long."""
    n = len(word)
    into: list[list] = [[] for _ in range(n + 1)]
    for j in range(1, n + 1):
        for i in range(max(0, j - v.longest), j):
            k = v.of.get(word[i:j])
            if k is not None:
                into[j].append((i, log[k], (k,)))
        if word[j - 1] not in v.of:
            ks = tuple(v.spelled(word[j - 1]))
            into[j].append((j - 1, float(sum(log[k] for k in ks)), ks))
    alpha = [0.0] * (n + 1)
    for j in range(1, n + 1):
        x = [alpha[i] + w for i, w, _ in into[j]]
        top = max(x)
        alpha[j] = top + math.log(sum(math.exp(y - top) for y in x))
    if expect is not None:
        beta = [-math.inf] * n + [0.0]
        for j in range(n, 0, -1):
            for i, w, ks in into[j]:
                t = w + beta[j]
                a, b = (beta[i], t) if beta[i] > t else (t, beta[i])
                beta[i] = a + (math.log1p(math.exp(b - a)) if b > -math.inf else 0.0)
                np.add.at(expect, list(ks), times * math.exp(alpha[i] + t - alpha[n]))
    return alpha[n]


def likelihoods(words: list[bytes], v: Vocabulary, log: np.ndarray, expect: np.ndarray | None = None, times: np.ndarray | None = None) -> np.ndarray:
    """Natural log of the marginal probability of each word (of none: the empty word's 0)."""
    out = np.zeros(len(words))
    texts = [marked(w) if w else "" for w in words]
    by: dict[int, list[int]] = {}
    for k, t in enumerate(texts):
        if len(t) >= LONG:
            out[k] = forward_one(t, v, log, expect, float(times[k]) if times is not None else 0.0)
        elif t:
            by.setdefault(len(t), []).append(k)
    for same in by.values():
        for s in range(0, len(same), 8192):
            ks = same[s : s + 8192]
            out[ks] = forward([texts[k] for k in ks], v, log, expect, times[ks] if times is not None else None)
    return out


def gathered(batches, rows: int = 100_000):
    """Tables of at least so many rows, but the last one: array operations over words of one length want many of them."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


_made: dict[str, Vocabulary] = {}
CACHES["lattice"] = _made


def vocabulary(path: str) -> Vocabulary:
    """The file's, made once by a worker."""
    if path not in _made:
        _made[path] = Vocabulary(path)
    return _made[path]


# ---------------------------------------------------------------- corpus
def held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(10)) == 0


def count_words(docs: DataFrame) -> DataFrame:
    """word (binary; empty: the end token), c (in rows with train), n (in all), of docs (text binary, train)."""

    def flush(train: Counter, rest: Counter):
        words = list(train.keys() | rest.keys())
        c = np.fromiter((train[w] for w in words), np.int64, len(words))
        n = c + np.fromiter((rest[w] for w in words), np.int64, len(words))
        train.clear()
        rest.clear()
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(c), pa.array(n)], names=["word", "c", "n"])

    def run(batches):
        train, rest = Counter(), Counter()
        for batch in batches:
            for text, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                into = train if own else rest
                into.update(text.translate(_LOWER).split())
                into[b""] += 1
                if len(train) + len(rest) > HELD:
                    yield flush(train, rest)
        if train or rest:
            yield flush(train, rest)

    return docs.mapInArrow(lean(run), "word binary, c long, n long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


class Model:
    """Weights (natural log) of the pieces and of the end token."""

    def __init__(self, vocabulary: Vocabulary, log: np.ndarray, end: float):
        self.vocabulary, self.log, self.end = vocabulary, log, end


def fit(words: DataFrame, path: str, rounds: int = ROUNDS, strength: float = STRENGTH) -> Model:
    """Weights from the counted words (word, c); the end token is the empty word. What comes to the driver is a number for each piece."""
    v = Vocabulary(path)
    model = Model(v, v.log, v.end)
    known = words.where((F.col("c") > 0) & (F.col("word") != F.lit(b"")))
    ends = words.where(F.col("word") == F.lit(b"")).agg(F.sum("c")).first()[0] or 0
    prior, prior_end = np.exp(v.log), math.exp(v.end)
    for _ in range(rounds):
        log = model.log

        def run(batches, log=log):
            own = vocabulary(path)
            expect = np.zeros(len(log))
            for part in gathered(batches):
                likelihoods(part.column(0).to_pylist(), own, log, expect, part.column(1).to_numpy().astype(float))
            k = np.flatnonzero(expect)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(expect[k])], names=["piece", "n"])

        got = known.select("word", "c").mapInArrow(lean(run, "lattice"), "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()  # at most one row a piece of the vocabulary
        expect = strength * prior
        for r in got:
            expect[r.piece] += r.n
        end = strength * prior_end + ends
        total = math.log(expect.sum() + end)
        with np.errstate(divide="ignore"):
            model = Model(v, np.log(expect) - total, math.log(end) - total)
    return model


def word_values(words: DataFrame, model: Model, path: str) -> DataFrame:
    """words with lp, the log10 of each word's marginal probability (of the empty word: of the end token)."""
    log, end = model.log, model.end

    def run(batches):
        own = vocabulary(path)
        for part in gathered(batches):
            words_ = part.column(0).to_pylist()
            lp = likelihoods(words_, own, log)
            lp[[k for k, w in enumerate(words_) if not w]] = end
            yield from part.append_column("lp", pa.array(lp / LOG10)).to_batches(max_chunksize=20_000)

    return words.select("word", "c", "n").mapInArrow(lean(run, "lattice"), "word binary, c long, n long, lp double")


def look_up(docs: DataFrame, heavy: dict[bytes, tuple[int, float, float]]) -> DataFrame:
    """A row for each of docs (r, doc_id, held_out, text), of what its broadcast words give: n_tokens, n_known, base, score; and, in rows with a word, posting lists of the other words: the rows (r), and how often each has it."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(heavy)
    names = [c.split()[0] for c in LOOKED.split(", ")]

    def flush(lists: dict):
        k = len(lists)
        none = lambda t: pa.nulls(k, t)
        cols = [none(pa.int64()), none(pa.int64()), none(pa.bool_()), none(pa.int64()), none(pa.int64()), none(pa.float64()), none(pa.float64()), pa.array(list(lists), pa.binary()), pa.array([x[0] for x in lists.values()], pa.list_(pa.int64())), pa.array([x[1] for x in lists.values()], pa.list_(pa.int64()))]
        lists.clear()
        return pa.RecordBatch.from_arrays(cols, names=names)

    def run(batches):
        known = shared.value
        lists: dict[bytes, tuple[list, list]] = {}
        held = 0
        for batch in batches:
            tokens, sure, bases, scores = [], [], [], []
            for r, text in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words = text.translate(_LOWER).split()
                own = Counter(words)
                own[b""] = 1
                n_known, base, score = 0, 0.0, 0.0
                for w, n in own.items():
                    got = known.get(w)
                    if got is None:
                        to = lists.get(w)
                        if to is None:
                            lists[w] = to = ([], [])
                        to[0].append(r)
                        to[1].append(n)
                        held += 1
                    else:
                        if got[0]:
                            n_known += n
                        base += n * got[1]
                        score += n * got[2]
                tokens.append(len(words) + 1)
                sure.append(n_known)
                bases.append(base)
                scores.append(score)
            k = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(tokens, pa.int64()), pa.array(sure, pa.int64()), pa.array(bases), pa.array(scores), pa.nulls(k, pa.binary()), pa.nulls(k, pa.list_(pa.int64())), pa.nulls(k, pa.list_(pa.int64()))], names=names)
            if held > 2 * HELD:
                yield flush(lists)
                held = 0
        if lists:
            yield flush(lists)

    return docs.mapInArrow(lean(run), LOOKED)


LOOKED = "r long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, word binary, rows array<bigint>, times array<bigint>"


def score(docs: DataFrame, path: str, rounds: int = ROUNDS, strength: float = STRENGTH, heavy: int = HEAVY) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs (doc_id, text)."""
    spark, mark = docs.sparkSession, staged_so_far()
    workers_import(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    words = stage(count_words(rows.select("text", (~F.col("held_out")).alias("train"))), "words")
    n, v, every = words.agg(F.sum("c"), F.count(F.when(F.col("c") > 0, 1)), F.sum("n")).first()
    n, v = n or 0, v or 0
    model = fit(words, path, rounds, strength)
    values = stage(word_values(words, model, path).withColumn("base", F.log10((F.col("c") + 0.1) / F.lit(n + 0.1 * (v + 1)))), "values")
    common = values.where((F.col("n") * heavy >= (every or 0)) & (F.octet_length("word") <= HEAVY_BYTES)).select("word", "c", "base", "lp").collect()  # at most `heavy` words, as their n sum up to `every` at most
    looked = stage(look_up(rows.select(F.monotonically_increasing_id().alias("r"), "doc_id", "held_out", "text"), {bytes(x.word): (x.c, x.base, x.lp) for x in common}), "looked")  # r is fixed from here on
    lists = looked.where("word is not null").select("word", F.arrays_zip("rows", "times").alias("x")).join(values.select("word", "c", "base", "lp"), "word")
    rare = lists.select(F.explode("x").alias("x"), "c", "base", "lp").select(F.col("x.rows").alias("r"), F.when(F.col("c") > 0, F.col("x.times")).otherwise(F.lit(0).cast("long")).alias("n_known"), (F.col("x.times") * F.col("base")).alias("base"), (F.col("x.times") * F.col("lp")).alias("score"))
    own = looked.where("word is null")
    both = own.select("r", "doc_id", "held_out", "n_tokens", "n_known", "base", "score").unionByName(rare, allowMissingColumns=True)
    summed = both.groupBy("r").agg(*(F.max(c).alias(c) for c in ("doc_id", "held_out", "n_tokens")), *(F.sum(c).alias(c) for c in ("n_known", "base", "score")))
    out = stage(summed.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score"), "scored")
    drop_staged(spark, mark, out)
    return out


def op13_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, by the pieces of a public vocabulary."""
    import public_tokenizers

    return score(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
