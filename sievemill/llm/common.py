"""Shared pieces of the training-data operators: staged tables, Arrow access, vectorised word hashing."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

U = np.uint64
_FALLBACK = None


# ---------------------------------------------------------------- staged tables
def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local master gets a temporary folder; a cluster is an error, as its machines share none."""
    global _FALLBACK
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _FALLBACK is None:
        _FALLBACK = tempfile.mkdtemp(prefix="sievemill_")
        spark.conf.set("spark.checkpoint.dir", f"file://{_FALLBACK}")
    return f"file://{_FALLBACK}"


def stage(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df as a table in the shared folder and read it back: the lineage ends there, so lost executors cost no recomputation. Spark deletes the folder when the session ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sievemill/{name}_{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", codec).parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    out = spark.read.schema(schema).parquet(path)
    out._staged = path
    _staged.append(path)
    return out


_staged: list[str] = []  # folders of this process, in order


def staged_so_far() -> int:
    return len(_staged)


def drop_staged(spark: SparkSession, since: int, *keep: DataFrame) -> None:
    """Delete the tables staged from number `since` on, but those in keep: what nobody will read again needn't wait for the session's end."""
    kept = {x._staged for x in keep}
    fs_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in [p for p in _staged[since:] if p not in kept]:
        _staged.remove(path)
        target = fs_of(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def workers_import(spark: SparkSession) -> None:
    """Python workers find this package where the driver found it, whatever folder they start in, and get Arrow batches of 4 MB where the session has Spark's default of 64 MB: long texts make large batches otherwise, held by the JVM and the worker at once."""
    if spark.conf.get(BATCH, "64MB") in ("64MB", "67108864", "67108864b"):
        spark.conf.set(BATCH, str(4 << 20))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), root) if x)


CACHES: dict[str, dict] = {}  # what worker processes keep between partitions, by the operator that needs it


def release(but: str = "") -> None:
    """Empty the caches of all other operators, and give freed memory back."""
    for name, c in CACHES.items():
        if name != but:
            c.clear()
    _powers.clear()
    trim()


def trim() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def lean(run, keeps: str = ""):
    """run, for mapInArrow, in a worker that holds little besides: workers live on between stages and operators, and each would keep the most it ever held. Caches of other operators go when it begins (keeps: its own), freed memory goes back after every few batches and at the end of the partition."""

    def trimmed(batches):
        for k, batch in enumerate(batches):
            yield batch
            if k % 4 == 3:
                del batch
                trim()

    def lean_run(batches):
        release(keeps)
        try:
            yield from run(trimmed(batches))
        finally:
            release(keeps)

    return lean_run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    workers_import(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- Arrow
def text_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (n + 1) of an Arrow string column, nulls as empty texts."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        import pyarrow.compute as pc

        col = pc.fill_null(col, "" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    buffers = col.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    if buffers[2] is None or offsets[-1] == offsets[0]:
        return np.empty(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = 1 << 20):
    """Runs [i, j) of texts of about limit bytes in all; a longer text is a run of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j
        i = j


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())


# ---------------------------------------------------------------- hashing
_A = 0x9E3779B97F4A7C15
_A_INV = pow(_A, -1, 2**64)
_BYTE = (np.arange(1, 257, dtype=np.uint64) * U(0xD6E8FEB86659FD93)) ^ (np.arange(1, 257, dtype=np.uint64) * U(0xC2B2AE3D27D4EB4F) >> U(29))
_powers: dict[int, np.ndarray] = {}
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(base: int, n: int) -> np.ndarray:
    got = _powers.get(base)
    if got is None or len(got) < n:
        got = np.full(max(n, 1 << 20), base, np.uint64)
        got[0] = 1
        _powers[base] = got = np.multiply.accumulate(got)
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> U(31))
    x = x * U(0x7FB5D329728EA185)
    x ^= x >> U(27)
    x *= U(0x81DADEF4BC2DD44D)
    x ^= x >> U(33)
    return x


def prefix_hash(a: np.ndarray) -> np.ndarray:
    """P with P[e] - P[s] = sum of byte values times powers: a polynomial hash of any span in two reads (see span_hash)."""
    out = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_BYTE[a] * powers(_A, len(a)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    return mix((prefix[e] - prefix[s]) * powers(_A_INV, len(prefix))[s] + (e - s).astype(np.uint64))


def words(a: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word [^\\x20\\x09-\\x0D]+ of a run of texts; words never cross texts."""
    inside = ~SPACE[a]
    first = np.zeros(len(a) + 1, bool)
    first[offsets] = True
    before = np.empty(len(a), bool)
    before[:1], before[1:] = False, inside[:-1]
    s = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.empty(len(a), bool)
    after[-1:], after[:-1] = False, inside[1:]
    e = np.flatnonzero(inside & (~after | first[1:])) + 1
    return s, e, np.searchsorted(offsets, s, side="right") - 1


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n successive items of h."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    m = len(h) - n + 1
    out = h[:m].copy()
    for j in range(1, n):
        out = out * U(0xF1357AEA2E62A9C5) + h[j : j + m]
    return mix(out)
