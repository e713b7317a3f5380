"""SentencePiece encoding and decoding (operator 8): shared-prefix Viterbi.

Spaces become the mark U+2581 and one leads the text. No piece of the vocabulary
has a mark after another character, so marked words segment on their own. The
distinct new words of a batch are sorted, which is a depth-first walk of their
trie: a word keeps the forward states of the prefix it shares with the one before,
and only the rest is worked on.

The file's model merges pairs of pieces, best score first. Its segmentation of a
prefix is a path through the lattice of pieces, and the one path whose neighbouring
pieces all stay apart when they are merged on their own; so the transition from one
piece to the next costs nothing where the pair stays apart and is forbidden where
it does not, and the forward state of a prefix is the last piece of its only open
path. That gives the library's own ids (tests compare whole texts). Characters
without a piece become byte pieces.

Defined cases: null and empty texts have no ids and decode to the empty text;
a text with a mark of its own decodes to a space there (round_trip false); a text
without spaces is one word, worked on in time proportional to its length; repeated
rows get equal results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CACHES, crc, lean, table, workers_import

MARK = "\u2581"
KEEP = 1_000_000  # words, and pairs of pieces, kept at most by a worker
_made: dict[str, "Pieces"] = {}
CACHES["pieces"] = _made


class Pieces:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.bytes = [-1] * 256
        self.byte_of: dict[int, int] = {}
        self.silent = {i for i in range(n) if sp.is_control(i)}
        self.piece: dict[str, tuple[float, int]] = {}
        for i in range(n):
            if sp.is_byte(i):
                b = int(self.text[i][3:5], 16)
                self.bytes[b], self.byte_of[i] = i, b
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.piece[self.text[i]] = (sp.get_score(i), i)
        self.unknown = sp.unk_id()
        self.score = {t: x[0] for t, x in self.piece.items()}
        self.piece = {t: x for t, x in self.piece.items() if len(t) == 1 or self.merged(t) == [t]}  # others never come of merging
        self.ends: dict = {}  # pieces by their characters from the last one back; "" leads to the piece
        for t in self.piece:
            node = self.ends
            for c in reversed(t):
                node = node.setdefault(c, {})
            node[""] = t
        inner = any(MARK in p.lstrip(MARK) for p in self.piece)
        self.words = (lambda t: [t]) if inner else re.compile(f"{MARK}*[^{MARK}]+|{MARK}+$").findall
        self.cache: dict[str, bytes] = {}
        self.apart: dict[str, dict[str, bool]] = {}  # by left piece and right piece
        self.pairs = 0

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging: the best pair, the leftmost of equal ones, as long as there is any."""
        parts, score, none = list(text), self.score.get, float("-inf")
        worth = [score(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while worth and (best := max(worth)) > none:
            k = worth.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del worth[k]
            if k:
                worth[k - 1] = score(parts[k - 1] + parts[k], none)
            if k < len(worth):
                worth[k] = score(parts[k] + parts[k + 1], none)
        return parts

    def learn(self, words: list[str]) -> None:
        """Segment distinct words, in sorted order, sharing forward states along common prefixes."""
        piece, ends, merged, before = self.piece, self.ends, self.merged, ""
        if self.pairs > KEEP:
            self.apart, self.pairs = {}, 0
        apart = self.apart
        last: list[str] = [""]  # of each prefix: the last piece of its path
        rows: list[dict] = [{}]  # and what is known of the pieces that follow it
        for w in sorted(words):
            shared, top = 0, min(len(w), len(before))
            while shared < top and w[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], rows[shared + 1 :]
            for i in range(shared + 1, len(w) + 1):
                found, node, k = [], ends, i
                while k:
                    k -= 1
                    node = node.get(w[k])
                    if node is None:
                        break
                    if "" in node:
                        found.append(node[""])
                t = w[i - 1]
                for t in reversed(found):  # the longest that may follow what stands before it
                    j = i - len(t)
                    if not j:
                        break
                    row = rows[j]
                    ok = row.get(t)
                    if ok is None:
                        ok = row[t] = merged(last[j] + t) == [last[j], t]
                        self.pairs += 1
                    if ok:
                        break
                last.append(t)
                row = apart.get(t)
                if row is None:
                    row = apart[t] = {}
                rows.append(row)
            ids, i = [], len(w)
            while i:
                t = last[i]
                if got := piece.get(t):
                    ids.append(got[1])
                else:
                    own = [self.bytes[b] for b in t.encode("utf-8", "surrogatepass")]
                    ids += reversed(own) if min(own) >= 0 else [self.unknown]
                i -= len(t)
            self.cache[w] = np.array(ids[::-1], "<u4").tobytes()
            before = w

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        parts = [self.words(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.cache) > KEEP:
            self.cache.clear()
        self.learn(list({w for p in parts for w in p if w not in self.cache}))
        return [np.frombuffer(b"".join([self.cache[w] for w in p]), "<u4") for p in parts]

    def decode(self, ids: np.ndarray) -> str:
        out, raw = [], bytearray()
        for i in ids.tolist():
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if i not in self.silent:
                out.append(self.text[i])
        out.append(raw.decode("utf-8", "replace"))
        text = "".join(out).replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


def pieces(path: str) -> Pieces:
    if path not in _made:
        _made[path] = Pieces(path)
    return _made[path]


def encode(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_ids, ids_crc32, round_trip (the decoded ids are the text); with_ids: also the ids."""
    workers_import(docs.sparkSession)

    def run(batches):
        model = pieces(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids = model.encode(texts)
                out = [part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([crc(x) for x in ids], pa.int64()), pa.array([model.decode(x) == t for x, t in zip(ids, texts, strict=True)])]
                yield pa.RecordBatch.from_arrays([*out, pa.array([x.tolist() for x in ids], pa.list_(pa.int32()))] if with_ids else out, names=["doc_id", "n_ids", "ids_crc32", "round_trip", "ids"][: 4 + with_ids])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run, "pieces"), "doc_id long, n_ids long, ids_crc32 long, round_trip boolean" + ", ids array<int>" * with_ids)


def decode(rows: DataFrame, path: str) -> DataFrame:
    """doc_id, text of rows doc_id, ids (null ids: null text)."""
    workers_import(rows.sparkSession)

    def run(batches):
        model = pieces(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else model.decode(np.array(x, "<u4")) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(lean(run, "pieces"), "doc_id long, text string")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
