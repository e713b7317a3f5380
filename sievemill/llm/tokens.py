"""Exact, cached use of the tokenizers library on whole Arrow batches.

Both vocabularies split a text before every space or newline that follows a word,
and encode what lies between on its own, so a text's ids are the ids of its
chunks one after the other (`leading` says whether a chunk takes the white space
before its word along, as byte-level BPE needs). Chunks are found and hashed for
a whole batch at once, looked up in a table, and their ids laid out by array
operations. The library encodes each chunk that the table lacks, many in one
call; the lengths of the tokens then tell where each chunk ends. Texts with any
other white space are encoded whole. The table has a fixed size and starts anew
when full.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from .common import CACHES, LOWER, SPACE, U, prefix_hash, span_hash

OTHER_SPACE = re.compile(r"[^\S \n]")
SLOTS = 1 << 20
FULL = 400_000
WIDE = 3  # times as many entries in twice the slots, for a task that does nothing else
AT_ONCE = 16  # groups of 512 chunks in one call of the library
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
_made: dict[tuple[str, bool, bool], "BatchTokenizer"] = {}
CACHES["tokens"] = _made


def tokenizer(path: str, leading: bool, wide: bool = False) -> "BatchTokenizer":
    """One per worker process, until another operator works there. Tasks fill the cores already: threads of the library would only hold memory."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if (path, leading, wide) not in _made:
        _made[path, leading, wide] = BatchTokenizer(path, leading, wide)
    return _made[path, leading, wide]


class BatchTokenizer:
    def __init__(self, path: str, leading: bool, wide: bool = False):
        from tokenizers import Tokenizer

        self.slots, self.full = (2 * SLOTS, WIDE * FULL) if wide else (SLOTS, FULL)
        self.tok, self.leading = Tokenizer.from_file(path), leading
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)  # bytes that a token stands for
        for t, i in vocab.items():
            self.width[i] = len(t) if leading else len(t.removesuffix("</w>"))
        self.special = [t["content"].encode() for t in json.load(open(path))["added_tokens"]]
        self.reset()

    def reset(self) -> None:
        self.keys = np.zeros(self.slots, np.uint64)
        self.entry = np.zeros(self.slots, np.int32)
        self.n = self.used = 0
        self.at = np.zeros(1 << 16, np.int64)  # of an entry's ids in flat
        self.count = np.zeros(1 << 16, np.int64)
        self.flat = np.zeros(1 << 18, np.uint32)

    # ------------------------------------------------------------ the table
    def find(self, h: np.ndarray) -> np.ndarray:
        """Entry of each hash, or -1."""
        out = np.full(len(h), -1, np.int64)
        slot, left = (h & U(self.slots - 1)).astype(np.int64), None
        while True:
            k = self.keys[slot]
            hit = k == (h if left is None else h[left])
            if left is None:
                out[hit] = self.entry[slot[hit]]
                left = np.flatnonzero(~hit & (k != 0))
                slot = (slot[left] + 1) & (self.slots - 1)
            else:
                out[left[hit]] = self.entry[slot[hit]]
                on = ~hit & (k != 0)
                left, slot = left[on], (slot[on] + 1) & (self.slots - 1)
            if not len(left):
                return out

    def add(self, h: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """New distinct hashes with their ids, laid end to end."""
        while self.n + len(h) > len(self.at):
            self.at, self.count = np.concatenate([self.at, self.at]), np.concatenate([self.count, self.count])
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, self.flat])
        self.flat[self.used : self.used + len(ids)] = ids
        own = np.arange(self.n, self.n + len(h))
        self.at[own], self.count[own] = self.used + np.cumsum(counts) - counts, counts
        self.n, self.used = self.n + len(h), self.used + len(ids)
        slot = (h & U(self.slots - 1)).astype(np.int64)
        while len(h):
            free = np.flatnonzero(self.keys[slot] == 0)
            self.keys[slot[free]] = h[free]
            got = np.zeros(len(h), bool)
            got[free] = self.keys[slot[free]] == h[free]
            self.entry[slot[got]] = own[got]
            h, own, slot = h[~got], own[~got], (slot[~got] + 1) & (self.slots - 1)

    # ------------------------------------------------------------ the library
    def encode_alone(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.empty(0, np.uint32), *got]), np.array([len(g) for g in got], np.int64)

    def learn(self, h: np.ndarray, a: np.ndarray, s: np.ndarray, e: np.ndarray, special: bool) -> None:
        """Encode distinct chunks a[s:e]. Those of code points below U+0100 keep their byte length when normalised: many go in one call, and the tokens' widths tell where each ends."""
        wide = np.concatenate(([0], np.cumsum(a >= 0xC4)))
        plain = (wide[e] == wide[s]) & (not special)
        if self.leading:
            plain &= SPACE[a[s]]
        fast, slow = np.flatnonzero(plain), [np.flatnonzero(~plain)]
        gap = 0 if self.leading else 1
        groups = [fast[k : k + 512] for k in range(0, len(fast), 512)]
        for k in range(0, len(groups), AT_ONCE):
            some = groups[k : k + AT_ONCE]
            slow += self.learn_joined(some, h, a, s, e, gap)
        rest = np.concatenate(slow)
        if len(rest):
            for k in range(0, len(rest), 8192):
                some = rest[k : k + 8192]
                self.add(h[some], *self.encode_alone([a[x:y].tobytes().decode() for x, y in zip(s[some].tolist(), e[some].tolist(), strict=True)]))

    def learn_joined(self, groups: list[np.ndarray], h: np.ndarray, a: np.ndarray, s: np.ndarray, e: np.ndarray, gap: int) -> list[np.ndarray]:
        """Encode groups of chunks, each as one text; returns the groups whose tokens cross chunks."""
        texts, slow = [], []
        for g in groups:
            size = e[g] - s[g]
            at = np.cumsum(size + gap) - size
            out = np.full(int(at[-1] + size[-1]), 0x20, np.uint8)
            inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            out[np.repeat(at, size) + inside] = a[np.repeat(s[g], size) + inside]
            texts.append(out.tobytes().decode())
        for g, enc in zip(groups, self.tok.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(enc.ids, np.uint32)
            ends, cuts = np.cumsum(self.width[ids]), np.cumsum(e[g] - s[g])
            k = np.minimum(np.searchsorted(ends, cuts), len(ends) - 1)
            if len(ends) and ends[-1] == cuts[-1] and (ends[k] == cuts).all():
                self.add(h[g], ids, np.diff(k, prepend=-1))
            else:
                slow.append(g)
        return slow

    # ------------------------------------------------------------ batches
    def chunks(self, a: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the chunks of a run of texts, in order. A point or comma between an ASCII letter and white space is a chunk of its own."""
        inside = ~SPACE[a]
        first = np.zeros(len(a) + 1, bool)
        first[offsets] = True
        before, after = np.empty(len(a), bool), np.empty(len(a), bool)
        before[:1], before[1:] = False, inside[:-1]
        after[-1:], after[:-1] = False, inside[1:]
        before &= ~first[:-1]
        last = inside & (~after | first[1:])
        mark = last & before & ((a == 0x2E) | (a == 0x2C))
        mark[1:] &= LETTER[a[:-1]]
        cut = last.copy()
        cut[:-1] |= mark[1:]
        if not self.leading:
            return np.flatnonzero((inside & ~before) | mark), np.flatnonzero(cut) + 1
        cut[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = True
        e = np.flatnonzero(cut) + 1
        return np.concatenate((np.zeros(1, np.int64), e))[:-1], e

    def run(self, a: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a run of texts end to end, and the offset of each text's ids (n + 1)."""
        n = len(offsets) - 1
        if not len(a):
            return np.empty(0, np.uint32), np.zeros(n + 1, np.int64)
        blob = a.tobytes()
        odd = {}
        if OTHER_SPACE.search(blob.decode()):
            for i in range(n):
                t = blob[offsets[i] : offsets[i + 1]].decode()
                if OTHER_SPACE.search(t):
                    odd[i] = np.array(self.tok.encode(t, add_special_tokens=False).ids, np.uint32)
        s, e = self.chunks(a, offsets)
        if odd:
            keep = ~np.isin(np.searchsorted(offsets, s, side="right") - 1, list(odd))
            s, e = s[keep], e[keep]
        special = any(x in blob for x in self.special)
        if not self.leading and not special and b"<|" not in blob:
            a = LOWER[a]  # as the vocabulary's normaliser does
        h = np.maximum(span_hash(prefix_hash(a), s, e), U(1))
        if self.n > self.full:
            self.reset()
        got = self.find(h)
        miss = np.flatnonzero(got < 0)
        if len(miss):
            new, at = np.unique(h[miss], return_index=True)
            at = miss[at]
            if self.n + len(new) > self.slots * 9 // 10:  # a huge text of ever new words: no table helps
                parts = [np.array(self.tok.encode(blob[x:y].decode(), add_special_tokens=False).ids, np.uint32) for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
            self.learn(new, a, s[at], e[at], special)
            got[miss] = self.find(h[miss])
        count = self.count[got]
        starts = np.cumsum(count) - count
        total = int(count.sum())
        ids = self.flat[np.repeat(self.at[got] - starts, count) + np.arange(total)]
        bounds = np.append(starts, total)[np.searchsorted(s, offsets)]
        if odd:
            parts = [odd.get(i, ids[bounds[i] : bounds[i + 1]]) for i in range(n)]
            return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        return ids, bounds
