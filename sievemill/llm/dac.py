"""Token-id output as directly addressable codes (operator 9).

A block holds the ids of successive texts. Each id is split into 8-bit chunks:
level 0 has the lowest chunk of every id, level 1 the next chunk of the ids that
have one, and so on. A bitmap per level tells which ids continue; a rank
directory holds the number of set bits before every 512th position. To read id i,
take chunk i of level 0; while its bit is set, go to position rank(i) of the next
level. No other id is decoded.

File format of a block (little-endian): magic `DAC1`, levels (u32), ids (u64),
texts (u64); text offsets (u64 x texts + 1), doc ids (i64 x texts), which
of them are null (u8 x texts); then per level
its length (u64), chunks (u8), bitmap (ceil(n / 64) u64), directory
(ceil(n / 512) u64). Blocks stand in a Parquet table (part, block, body), so that
Spark's writer commits them whole on any store; parts follow doc_id, and blocks in
a part follow each other.

Defined cases: null text counts as empty (the end id alone); repeated doc ids keep
a row each, in the order of a hash of their texts, so that a very common id is dealt
out too; null doc ids come first; an empty table gives no blocks and no rows; other columns are ignored.
A text of any length stays within one block, which then is longer than usual.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunks, crc, lean, stage, table, text_bytes, workers_import
from .tokens import tokenizer as tokenizer_of

BLOCK_IDS = 1 << 18  # a block ends with the text that reaches this many ids


def encode_block(ids: np.ndarray, bounds: np.ndarray, docs: np.ndarray, none: np.ndarray | None = None) -> bytes:
    """none: which doc ids are null."""
    none = np.zeros(len(docs), bool) if none is None else none
    levels, left = [], ids.astype(np.uint32)
    while True:
        rest = left >> np.uint32(8)
        more = rest > 0
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % 8, np.uint8)])
        before = np.cumsum(np.add.reduceat(more.astype(np.int64), np.arange(0, len(more), 512))) if len(more) else np.empty(0, np.int64)
        directory = np.concatenate(([0], before[:-1])).astype("<u8") if len(before) else before.astype("<u8")
        levels.append(struct.pack("<Q", len(left)) + left.astype(np.uint8).tobytes() + bits.tobytes() + directory.tobytes())
        left = rest[more]
        if not len(left):
            break
    return b"".join([b"DAC1", struct.pack("<IQQ", len(levels), len(ids), len(docs)), bounds.astype("<u8").tobytes(), docs.astype("<i8").tobytes(), none.astype("u1").tobytes(), *levels])


class Block:
    """A block read back; `ids` decodes all, `[i]` one."""

    def __init__(self, body: bytes):
        if body[:4] != b"DAC1":
            raise ValueError("not a DAC1 block")
        n_levels, self.n, texts = struct.unpack_from("<IQQ", body, 4)
        at = 24

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(body, kind, n, at)
            at += got.nbytes
            return got

        self.bounds, self.docs, self.none, self.levels = take("<u8", texts + 1).astype(np.int64), take("<i8", texts), take("u1", texts).astype(bool), []
        for _ in range(n_levels):
            n = int(take("<u8", 1)[0])
            self.levels.append((take("u1", n), take("u1", -(-n // 64) * 8), take("<u8", -(-n // 512))))

    def __getitem__(self, i: int) -> int:
        out = 0
        for k, (low, bits, directory) in enumerate(self.levels):
            out |= int(low[i]) << 8 * k
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            start = i >> 9 << 6
            i = int(directory[i >> 9]) + int(np.unpackbits(bits[start : (i >> 3) + 1], bitorder="little")[: i - (start << 3)].sum())
        return out

    def ids(self) -> np.ndarray:
        out = np.zeros(self.n, np.uint32)
        own = np.arange(self.n)
        for k, (low, bits, _) in enumerate(self.levels):
            out[own] |= low.astype(np.uint32) << np.uint32(8 * k)
            own = own[np.unpackbits(bits, bitorder="little")[: len(own)].astype(bool)]
        return out


def write(docs: DataFrame, tokenizer: str, end_id: int, leading: bool) -> DataFrame:
    """The staged block table (part, block, body) of docs (doc_id, text)."""
    workers_import(docs.sparkSession)

    def run(batches):
        tok, part, number = tokenizer_of(tokenizer, leading, wide=True), TaskContext.get().partitionId(), 0
        held: list = []

        def block():
            nonlocal number
            ids, size, names, none = (np.concatenate(x) for x in zip(*held, strict=True))
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([encode_block(ids, np.concatenate(([0], np.cumsum(size))), names, none)], pa.binary())], names=["part", "block", "body"])
            number += 1
            held.clear()
            return out

        for batch in batches:
            a, offsets = text_bytes(batch.column(1))
            for i, j in chunks(offsets):
                ids, bounds = tok.run(a[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                names = batch.column(0).slice(i, j - i)
                held.append((np.insert(ids, bounds[1:], end_id), np.diff(bounds) + 1, names.fill_null(0).to_numpy(), names.is_null().to_numpy(zero_copy_only=False)))
                if sum(len(x[0]) for x in held) >= BLOCK_IDS:
                    yield block()
        if held:
            yield block()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return stage(ordered.mapInArrow(lean(run, "tokens"), "part int, block int, body binary"), "dac")


def read(blocks: DataFrame) -> DataFrame:
    """A row per text, from the blocks: doc_id, start, n_tokens, ids_crc32."""

    def run(batches):
        for batch in batches:
            for part, number, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                b = Block(body)
                ids, n = b.ids(), len(b.docs)
                yield pa.RecordBatch.from_arrays([pa.array(b.docs, mask=b.none), pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, number, np.int32)), pa.array(b.bounds[:-1]), pa.array(np.diff(b.bounds)), pa.array([crc(ids[s:e]) for s, e in zip(b.bounds[:-1], b.bounds[1:], strict=True)], pa.int64())], names=["doc_id", "part", "block", "at", "n_tokens", "ids_crc32"])

    rows = stage(blocks.select("part", "block", "body").mapInArrow(lean(run), "doc_id long, part int, block int, at long, n_tokens long, ids_crc32 long"), "dac_rows")
    size = rows.groupBy("part", "block").agg(F.sum("n_tokens").alias("n"))
    in_part = F.sum("n").over(Window.partitionBy("part").orderBy("block")) - F.col("n")
    parts = size.groupBy("part").agg(F.sum("n").alias("n_part"))  # a row per partition of the writer
    before = parts.select("part", (F.sum("n_part").over(Window.orderBy("part")) - F.col("n_part")).alias("before"))
    base = size.withColumn("in_part", in_part).join(before, "part").select("part", "block", (F.col("in_part") + F.col("before")).alias("base"))
    return rows.join(base, ["part", "block"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read(write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 0, True))
