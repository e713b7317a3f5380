"""Fill-in-middle transformation by big-integer bit-parallelism.

A text is one Python integer with a bit a byte of its UTF-8 form: bytes.translate makes the
mask of a class of bytes, shifts and boolean operations turn it into the mask of unit
starts, bit_count says how many units there are, and the start of unit k is the bit of rank
k, found by halving the mask and counting one half until a word is left. No list of units
is made, so a text costs some bits a byte, however many units it has.

Which units end the prefix and the middle, and the form, follow from a hash of the
document's id alone, so a row gives the same output in any run, partition or order.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, table, workers_import

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM = 7, 100, 50

_ONE, _ZERO = ord("1"), ord("0")


def _digits(members) -> bytes:
    return bytes(_ONE if b in members else _ZERO for b in range(256))


NEWLINE = _digits({10})
BLANK = _digits({0x20, *range(0x09, 0x0E)})
LEAD = _digits(set(range(256)) - set(range(0x80, 0xC0)))


def mask(data: bytes, table_: bytes) -> int:
    """Bit i is 1 where byte i of data is in the class of the table."""
    return int(data.translate(table_)[::-1], 2) if data else 0


def line_starts(data: bytes) -> int:
    """Lines with their line feed: a unit begins at byte 0 and after each line feed that isn't the last byte."""
    return ((mask(data, NEWLINE) << 1) | 1) & ((1 << len(data)) - 1)


def word_starts(data: bytes) -> int:
    """Words with the white space behind them; white space in front of the first word belongs to it."""
    blank = mask(data, BLANK)
    whole = (1 << len(data)) - 1
    starts = (~blank & (blank << 1)) & whole
    first = ~blank & whole
    # what precedes the first word is part of its unit
    return (starts & ~(first & -first) | 1) & whole


def char_starts(data: bytes) -> int:
    return mask(data, LEAD)


UNITS = {"lines": line_starts, "words": word_starts, "chars": char_starts}


def select(bits: int, width: int, k: int) -> int:
    """Place of the 1 bit of rank k (from 0): the half that holds it, again and again."""
    at = 0
    while width > 64:
        half = width >> 1
        low = bits & ((1 << half) - 1)
        n = low.bit_count()
        if k < n:
            bits, width = low, half
        else:
            bits, width, at, k = bits >> half, width - half, at + half, k - n
    for _ in range(k):
        bits &= bits - 1
    return at + (bits & -bits).bit_length() - 1


def cut(data: bytes, h1: int, h2: int, units: str = "lines") -> tuple[int, int, int]:
    """Number of units, and the bytes where prefix and middle end."""
    starts = UNITS[units](data)
    n = starts.bit_count()
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    place = lambda k: len(data) if k == n else select(starts, len(data), k)
    return n, place(a), place(b)


def transform(df: DataFrame, units: str = "lines", seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output and text of every row of df.

    rate: of 100 documents, so many are transformed; spm: of 100 of those, so many have the
    suffix first. Plain are also empty and null texts (as empty ones), and texts that hold
    one of the three marks, so that restore() is exact for all. A null doc_id is hashed as
    no digits. Rows don't matter to each other: repeated rows give repeated rows, an empty
    table an empty one, and further columns of df are left out, whatever their names. A
    narrow map: nothing is shuffled."""
    workers_import(df.sparkSession)
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))), 256)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    known = df.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *(F.conv(F.substring(h, 8 * k - 7, 8), 16, 10).cast("long").alias(f"h{k}") for k in (1, 2, 3, 4)))
    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    form = F.when((F.col("text") == "") | marked | (F.col("h3") % 100 >= rate), "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm")
    rows = known.select("doc_id", F.col("text").cast("binary").alias("text"), "h1", "h2", form.alias("form"))

    def run(batches):
        for batch in batches:
            data = batch.column("text").to_pylist()
            n, prefix, middle, out = [], [], [], []
            for t, form, h1, h2 in zip(data, batch.column("form").to_pylist(), batch.column("h1").to_pylist(), batch.column("h2").to_pylist(), strict=True):
                k, a, b = cut(t, h1, h2, units)
                n.append(k)
                if form == "plain":
                    prefix.append(None)
                    middle.append(None)
                    out.append(t)
                    continue
                p, m, s = t[:a], t[a:b], t[b:]
                prefix.append(mask(p, LEAD).bit_count())
                middle.append(mask(m, LEAD).bit_count())
                out.append(b"<P>" + p + b"<S>" + s + b"<M>" + m if form == "psm" else b"<S>" + s + b"<P>" + p + b"<M>" + m)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), batch.column("form"), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.binary()).cast(pa.string()), batch.column("text").cast(pa.string())], names=NAMES)

    return rows.mapInArrow(lean(run), SCHEMA)


SCHEMA = T.StructType([T.StructField(k, t) for k, t in (("doc_id", T.LongType()), ("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output", T.StringType()), ("text", T.StringType()))])
NAMES = SCHEMA.names


def restore(output: Column, form: Column) -> Column:
    """The text that an output of transform() was made of: of psm and spm outputs, in which each mark stands once, prefix, middle and suffix joined."""
    between = lambda a, b: F.split_part(F.split_part(output, F.lit(a), F.lit(2)), F.lit(b), F.lit(1)) if b else F.split_part(output, F.lit(a), F.lit(2))
    middle = between(MIDDLE, None)
    return F.when(form == "psm", F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))).when(form == "spm", F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))).otherwise(output)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, cut in lines; digests of the output and of the text rebuilt from it."""
    made = transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
