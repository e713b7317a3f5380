"""Counts per text and per line, by array operations over the bytes of many texts."""

from __future__ import annotations

import numpy as np

from .common import grams, prefix_hash, span_hash, words

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
WINDOW = 8
LINE = ("bytes", "words", "upper", "lower", "digits", "symbols", "bangs", "short")
_IS = {
    "upper": np.isin(np.arange(256), np.arange(65, 91)),
    "lower": np.isin(np.arange(256), np.arange(97, 123)) | (np.arange(256) >= 0xC3),
    "digits": np.isin(np.arange(256), np.arange(48, 58)),
    "symbols": SYMBOLS,
    "bangs": np.arange(256) == 33,
}


def measure(a: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Per text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, upper, lower, bangs, short. Per line (split at \\n): text, the counts of LINE, dup (equal to an earlier line of its text)."""
    n = len(offsets) - 1
    s, e, doc = words(a, offsets)
    prefix = prefix_hash(a)
    total = lambda flags: np.concatenate(([0], np.cumsum(flags)))
    points = total((a & 0xC0) != 0x80)
    sums = {k: total(f[a]) for k, f in _IS.items()}
    per_text = {"n_words": np.bincount(doc, minlength=n), "word_chars": np.bincount(doc, points[e] - points[s], n).astype(np.int64)}
    per_text |= {k: sums[x][offsets[1:]] - sums[x][offsets[:-1]] for k, x in (("n_symbols", "symbols"), ("upper", "upper"), ("lower", "lower"), ("bangs", "bangs"))}
    short = total(points[e] - points[s] <= 3)
    first_word = np.searchsorted(s, offsets)
    per_text["short"] = short[first_word[1:]] - short[first_word[:-1]]

    nl = np.flatnonzero(a == 10)
    nl_doc = np.searchsorted(offsets, nl, side="right") - 1
    begin = np.sort(np.concatenate((offsets[:-1], nl + 1)), kind="stable")
    end = np.sort(np.concatenate((offsets[1:], nl)), kind="stable")
    owner = np.repeat(np.arange(n), np.bincount(nl_doc, minlength=n) + 1)
    w = np.searchsorted(s, begin), np.searchsorted(s, end)
    line = {"text": owner, "bytes": end - begin, "words": w[1] - w[0], "short": short[w[1]] - short[w[0]]} | {k: sums[k][end] - sums[k][begin] for k in _IS}
    h = span_hash(prefix, begin, end) if len(a) else np.zeros(len(begin), np.uint64)
    order = np.lexsort((h, owner))
    dup = np.zeros(len(h), bool)
    dup[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])  # lexsort is stable: the first stays
    line["dup"] = dup & (line["words"] > 0)
    per_text["n_dup_lines"] = np.bincount(owner, line["dup"], n).astype(np.int64)
    per_text["lines"] = np.bincount(owner, line["words"] > 0, n).astype(np.int64)

    g = grams(span_hash(prefix, s, e), WINDOW) if len(s) else np.empty(0, np.uint64)
    at = np.flatnonzero(doc[: len(g)] == doc[WINDOW - 1 :]) if len(g) else np.empty(0, np.int64)
    order = at[np.lexsort((g[at], doc[at]))]
    same = (g[order[1:]] == g[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    hit = order[np.append(same, False) | np.append(False, same)] if len(order) else order
    cover = np.zeros(len(s) + 1, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, np.minimum(hit + WINDOW, len(s)), -1)
    per_text["n_repeat_words"] = np.bincount(doc, np.cumsum(cover)[:-1] > 0, n).astype(np.int64)
    return per_text, line
