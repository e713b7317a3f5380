"""Source divergence, fill-in-middle and lattice scores against brute force on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sievemill.llm import divergence, fim, lattice
from sievemill.llm.common import workers_import

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, p long, n long, r long, value string"


def table(spark, rows):
    workers_import(spark)
    return spark.createDataFrame([(*r, 1, 2, 3, "x") for r in rows], SCHEMA).repartition(3)


# ---------------------------------------------------------------- divergence
def divergence_brute(rows, least):
    docs = [(t or "", l or "", s or "") for _, t, l, s in rows]
    has, counts, groups = defaultdict(Counter), defaultdict(Counter), {(l, s) for _, l, s in docs}
    for t, l, s in docs:
        own = TERM.findall(t.translate(LOW))
        has[l].update(set(own))
        counts[l, s].update(own)
    out = []
    p_of = lambda c, n, v: 1 + 10**9 * (c + 5) // (n + 5 * v)
    for lang, source in groups:
        kept = [t for t, d in has[lang].items() if d >= least]
        total = {s: sum(counts[lang, s][t] for t in kept) for l, s in groups if l == lang}
        whole, v = sum(total.values()), len(kept)
        p = {s: {t: p_of(counts[lang, s][t], total[s], v) for t in kept} for s in total}
        pairs = [(sum(abs(p[source][t] - p[o][t]) for t in kept), o) for o in total if o != source]
        q = {t: p_of(sum(counts[lang, s][t] for s in total), whole, v) for t in kept}
        terms = [(p[source][t] - q[t], t) for t in kept if counts[lang, source][t] and p[source][t] > q[t]]
        for part, items in (("pair", pairs), ("term", terms)):
            ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, k) for k, (value, item) in enumerate(ranked, 1) if part == "pair" or k <= 50]
    return sorted(out)


def speech(seed, n_docs=400, langs=("en", "de", None), sources=13):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdéß日") for _ in range(r.randint(1, 6))) for _ in range(400)]
    rows = [(0, None, None, None), (1, "", "en", "only"), (2, "  12 ,", "xx", "b"), (3, "Wörd Word WORD word's", "xx", None)]
    for k in range(n_docs):
        s = r.randrange(sources)
        words = [vocab[min(int(r.expovariate(0.03)) + (7 * s if r.random() < 0.3 else 0), 399)] for _ in range(r.randint(0, 60))]
        rows.append((k + 4, " ".join(w.upper() if r.random() < 0.1 else w for w in words), r.choice(langs), f"s{s}" if s else None))
    return [*rows, rows[-1], (10**6, "é " * 50_000, "de", "long")]


@pytest.mark.parametrize("block,tile,share,least", [(256, 512, 0.25, 5), (4, 16, 0.25, 5), (3, 8, 0.0, 2), (5, 7, 2.0, 2), (256, 512, 0.25, 10**6)])
def test_divergence(spark, block, tile, share, least):
    rows = speech(3)
    got = divergence.audit(table(spark, rows), least_docs=least, block=block, tile=tile, heavy_share=share)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == divergence_brute(rows, least)


def test_divergence_of_nothing(spark):
    assert divergence.audit(table(spark, [(1, "a b", "en", "x")]).limit(0)).count() == 0
    one = divergence.audit(table(spark, [(1, "a b", "en", "x")] * 40)).collect()
    assert one == []  # no other source, and no share above the language's


def test_share_is_exact_beyond_longs(spark):
    big = 10**12
    got = spark.range(1).select(divergence.share(F.lit(big), F.lit(3 * big + 7), F.lit(11)).alias("p")).first().p
    assert got == 1 + 10**9 * (big + 5) // (3 * big + 7 + 55)


def test_counters_are_handed_on(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 5)
    rows = speech(8, 60)
    assert sorted(map(tuple, divergence.audit(table(spark, rows), least_docs=3).collect())) == divergence_brute(rows, 3)


# ---------------------------------------------------------------- fill-in-middle
def fim_brute(doc_id, text, pattern=r"[^\n]*\n|[^\n]+", rate=100, spm=50):
    text = text or ""
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    units = re.findall(pattern, text)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text, text
    if h4 % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text


def fim_texts():
    r = random.Random(11)
    texts = [None, "", "\n", "\n\n\n", "a", "a\n", "\na", "x<P>y\nz", "<S", "<\n<S", "é\n日本\n\r\nü", "a\x85b c\nd", "no end\nof line", "<M>"]
    for _ in range(200):
        texts.append("".join(r.choice(["\n", " ", "a", "é", "日", "😀", "<", ">", "P", "S", "M"]) for _ in range(r.randint(0, 90))))
    return [*texts, "line of text\n" * 40_000, "x" * 300_000, "\n" * 100_000]


@pytest.mark.parametrize("units,pattern,rate,spm", [("lines", r"[^\n]*\n|[^\n]+", 100, 50), ("chars", r"(?s).", 100, 50), ("words", r"^[ \t-\r]*[^ \t-\r]*[ \t-\r]*|[^ \t-\r]+[ \t-\r]*", 60, 0), ("lines", r"[^\n]*\n|[^\n]+", 0, 50)])
def test_fill_in_middle(spark, units, pattern, rate, spm):
    rows = [(i, t, "en", "s") for i, t in enumerate(fim_texts())] + [(None, "a\nb\nc", None, None)] * 2
    made = fim.transform(table(spark, rows), units=units, rate=rate, spm=spm)
    made = made.withColumn("again", fim.restore(F.col("output"), F.col("form")))
    got = sorted(((x.doc_id, x.n, x.form, x.prefix_chars, x.middle_chars, x.output, x.again) for x in made.collect()), key=str)
    want = sorted(((i, *((n[0] if n[-1] else 0, *n[1:]) if units == "words" else n)) for i, t, _, _ in rows for n in [fim_brute(i, t, pattern, rate, spm)]), key=str)
    assert got == want


def test_fill_in_middle_of_nothing(spark):
    assert fim.transform(table(spark, [(1, "a", "en", "s")]).limit(0)).count() == 0


def test_select():
    r = random.Random(2)
    for _ in range(200):
        width = r.choice([1, 7, 64, 65, 200, 3000])
        bits = r.getrandbits(width) | 1
        places = [k for k in range(width) if bits >> k & 1]
        k = r.randrange(len(places))
        assert fim.select(bits, width, k) == places[k]


# ---------------------------------------------------------------- lattice
class Small(lattice.Vocabulary):
    """A vocabulary of given pieces, without a file."""

    def __init__(self, pieces):
        self.pieces = [*pieces, *[None] * 256]
        self.byte_piece = [len(pieces) + b for b in range(256)]
        r = random.Random(1)
        w = np.array([r.random() + 0.01 for _ in self.pieces])
        self.log, self.end = np.log(w / (w.sum() + 1)), -math.log(w.sum() + 1)
        self.index()


def all_cuts(word, v):
    """Every segmentation of a marked word, as lists of pieces."""
    if not word:
        return [[]]
    out = [[v.of[word[:k]], *rest] for k in range(1, len(word) + 1) if word[:k] in v.of for rest in all_cuts(word[k:], v)]
    if word[0] not in v.of:
        out += [[*v.spelled(word[0]), *rest] for rest in all_cuts(word[1:], v)]
    return out


def test_marginals_and_expectations():
    v = Small(["▁", "a", "b", "é", "ab", "▁a", "▁ab", "ba", "bab", "aa", "éa", "▁é"])
    r = random.Random(4)
    words = [bytes("".join(r.choice("abécx日▁") for _ in range(r.randint(1, 8))), "utf-8") for _ in range(150)] + [b"ab" * 6, b"\xff\xfea", "▁".encode()]
    times = np.array([float(r.randint(1, 5)) for _ in words])
    want, expected = [], np.zeros(len(v.pieces))
    for w, t in zip(words, times, strict=True):
        cuts = all_cuts(lattice.marked(w), v)
        ps = [math.exp(sum(v.log[k] for k in c)) for c in cuts]
        want.append(math.log(math.fsum(ps)))
        for c, p in zip(cuts, ps, strict=True):
            for k in c:
                expected[k] += t * p / sum(ps)
    got = np.zeros(len(v.pieces))
    assert np.allclose(lattice.likelihoods(words, v, v.log, got, times), want, rtol=1e-12)
    assert np.allclose(got, expected, rtol=1e-9)
    one = np.zeros(len(v.pieces))
    assert np.allclose([lattice.forward_one(lattice.marked(w), v, v.log, one, t) for w, t in zip(words, times, strict=True)], want, rtol=1e-12)
    assert np.allclose(one, expected, rtol=1e-9)


def test_long_words_go_alone(monkeypatch):
    v = Small(["▁", "a", "b", "ab"])
    w = [b"ab" * 40, b"ba" * 40]
    alone = lattice.likelihoods(w, v, v.log)
    monkeypatch.setattr(lattice, "LONG", 10**9)
    assert np.allclose(alone, lattice.likelihoods(w, v, v.log), rtol=1e-12)


PATH = public_tokenizers.path("piece_bpe_32k.model")


def scored(spark, rows, **more):
    return lattice.score(table(spark, rows), PATH, **more)


def texts():
    r = random.Random(9)
    vocab = ["".join(r.choice("abcdeé▁日") for _ in range(r.randint(1, 7))) for _ in range(300)]
    say = lambda n: " ".join(r.choice(vocab[: r.choice([20, 300])]) for _ in range(n))
    return [None, "", " \n", "A b a", "a\x0bb\x1cc", *[say(r.randint(1, 80)) for _ in range(120)], "z" * 5000, say(4000)]


def score_brute(rows, model):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    tokens = [[*WORD.findall((t or "").translate(LOW)), ""] for _, t, _, _ in rows]
    c = Counter(w for (i, *_), ws in zip(rows, tokens, strict=True) if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    lp = {w: model.end if not w else float(lattice.forward_one(lattice.marked(w.encode()), model.vocabulary, model.log)) for ws in tokens for w in ws}
    out = []
    for (i, *_), ws in zip(rows, tokens, strict=True):
        base = math.fsum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        out.append((i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, base, math.fsum(lp[w] for w in ws) / math.log(10)))
    return out


@pytest.mark.parametrize("heavy", [lattice.HEAVY, 200, 1])
def test_scores(spark, monkeypatch, heavy):
    monkeypatch.setattr(lattice, "HELD", 700)
    rows = [(i, t, "en", "s") for i, t in enumerate(texts())] + [(None, "a b c", None, None), (None, "a b c", None, None), (7, "twice", "en", "s"), (7, "twice", "en", "s")]
    got = sorted(map(tuple, scored(spark, rows, heavy=heavy, rounds=1).collect()), key=str)
    words = lattice.count_words(table(spark, rows).select(F.coalesce("text", F.lit("")).cast("binary").alias("text"), (~lattice.held_out()).alias("train")))
    want = sorted(score_brute(rows, lattice.fit(words, PATH, rounds=1)), key=str)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert np.allclose([x[5:] for x in got], [x[5:] for x in want], rtol=1e-9)


def test_scores_of_nothing(spark):
    assert scored(spark, [(1, "a", "en", "s")]).count() == 1
    assert lattice.score(table(spark, [(1, "a", "en", "s")]).limit(0), PATH).count() == 0
    alone = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    row = scored(spark, [(alone, "a", "en", "s")]).first()
    assert (row.train_tokens, row.n_known, row.base_score) == (0, 0, 0.0) and -20 < row.score < 0


def test_weights_are_a_distribution_and_learning_helps(spark):
    rows = [(i, t, "en", "s") for i, t in enumerate(texts()[3:-2])]
    words = lattice.count_words(table(spark, rows).select(F.col("text").cast("binary").alias("text"), (~lattice.held_out()).alias("train")))
    values = {}
    for rounds in (0, 1, 2):
        model = lattice.fit(words, PATH, rounds=rounds)
        assert abs(np.exp(model.log).sum() + math.exp(model.end) - 1) < 1e-9
        values[rounds] = sum(x[6] for x in score_brute(rows, model) if x[1])
    assert values[0] < values[1] < values[2]  # of held-out texts
