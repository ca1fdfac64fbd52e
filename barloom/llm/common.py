"""Shared pieces: tables in the cluster's shared folder, word and shingle hashing."""

from __future__ import annotations

import atexit
import ctypes
import ctypes.util
import functools
import json
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space of all word operators, as an SQL/Java and Python pattern.
WORD = r"[^\x20\x09-\x0D]+"


def qualified(spark: SparkSession, path: str) -> str:
    """A path with scheme and host, by Spark's default file system where it has none.

    So Spark and filesystem() mean the same place, whichever of them writes or reads.
    """
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return "file://" + out.removeprefix("file:") if out.startswith("file:/") and not out.startswith("file://") else out


def filesystem(uri: str):
    """The pyarrow file system of a qualified path, and the path in it."""
    return pafs.FileSystem.from_uri(uri)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir), qualified.

    It is set here only where a local session has none, as in tests.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = known.get() if known.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: the cluster must name a shared folder")
        base = "file://" + tempfile.mkdtemp(prefix="barloom-shared-")
        atexit.register(shutil.rmtree, base.removeprefix("file://"), ignore_errors=True)
        spark.sparkContext.setCheckpointDir(base)
    return qualified(spark, base.rstrip("/"))


_SWEPT: set[str] = set()


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path for the application in the shared folder.

    The application's folder there is deleted when the driver's JVM ends, since results may be read until then.
    """
    folder = f"{shared_dir(spark)}/barloom/{spark.sparkContext.applicationId}"
    if folder not in _SWEPT:
        _SWEPT.add(folder)
        p = spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(p)
        fs.deleteOnExit(p)
    return f"{folder}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cuts lineage: df as a Parquet table in the shared folder, read back."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._barloom_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables of materialize() that nothing reads any more."""
    for t in tables:
        path = getattr(t, "_barloom_path", None)
        if path:
            jvm, conf = t.sparkSession._jvm, t.sparkSession._jsc.hadoopConfiguration()
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


#: Rows of (long) ids up to which an id set is broadcast; beyond it the join shuffles.
BROADCAST_IDS = 500_000


def pick(table: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows of table whose key is in ids (a materialized one-column table `id`)."""
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return table.join(ids, table[key] == ids["id"], "left_semi")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Rows of an Arrow batch: whole texts, and pairs of them, are in a Python worker at once.
BATCH_ROWS = 2_000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows of an Arrow batch to BATCH_ROWS, if they are more."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def release() -> None:
    """Returns freed memory to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(ctypes.util.find_library("c") or None), "malloc_trim", None):
        trim(0)


def lean(f):
    """f, a function of batches, that returns freed memory to the system when a task ends.

    Python workers live on between tasks; what they keep counts against their executor.
    """

    @functools.wraps(f)
    def run(batches):
        yield from f(batches)
        release()

    return run


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def literal(values: list, kind: str) -> Column:
    """A constant array of values of a type, one node in the plan however long it is."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def rank_in(cuts: Column, key: Column, n: int, below: bool = False) -> Column:
    """How many of n ascending cuts lie at or below the key (with `below`: only below), by binary search."""
    if not n:
        return F.lit(0)

    def go(at: Column, d: Column) -> Column:
        cut = F.get(cuts, at + d - 1)
        return F.when((at + d <= n) & (cut < key if below else cut <= key), at + d).otherwise(at)

    return F.aggregate(F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))]), F.lit(0), go)


# ---------------------------------------------------------------- hashing

U64 = np.uint64
_P = U64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D  # odd: has an inverse modulo 2^64
_BLOCK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@functools.cache
def _tables():
    byte = mix(np.arange(1, 257, dtype=np.uint64) * _P)
    byte[65:91] = byte[97:123]  # A-Z as a-z
    space = np.zeros(256, dtype=bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    return byte, space


@functools.lru_cache(maxsize=2)
def _powers(n: int):
    with np.errstate(over="ignore"):
        up = np.cumprod(np.r_[U64(1), np.full(n, _BASE, dtype=np.uint64)])
        down = np.cumprod(np.r_[U64(1), np.full(n, pow(_BASE, -1, 1 << 64), dtype=np.uint64)])
    return up, down


def words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of UTF-8 bytes: a 64-bit hash of each lower-cased word, and its first byte and end."""
    byte, space = _tables()
    b = np.frombuffer(data, dtype=np.uint8)
    edge = np.flatnonzero(np.diff(np.r_[True, space[b], True].view(np.int8)))
    start, end = edge[0::2], edge[1::2]
    n = len(start)
    out = np.empty(n, dtype=np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < n:
            at = start[i]
            j = max(i + 1, int(np.searchsorted(end, at + _BLOCK, side="right")))
            span = int(end[j - 1] - at)
            up, down = _powers(max(_BLOCK, span))
            c = np.zeros(span + 1, dtype=np.uint64)
            np.cumsum(byte[b[at : at + span]] * up[:span], out=c[1:])
            s, e = start[i:j] - at, end[i:j] - at
            out[i:j] = (c[e] - c[s]) * down[s]
            i = j
        return mix(out + (end - start).astype(np.uint64)), start, end


def runs(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the runs of words from start to end (exclusive), from the words' hashes."""
    with np.errstate(over="ignore"):
        up, down = _powers(max(_BLOCK, len(h)))
        c = np.zeros(len(h) + 1, dtype=np.uint64)
        np.cumsum(h * up[: len(h)], out=c[1:])
        return mix((c[end] - c[start]) * down[start] + (end - start).astype(np.uint64))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, from the words' hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        s = np.full(n, k, dtype=np.uint64)
        for j in range(k):
            s = s * _P + h[j : j + n]
        return mix(s)


def shingle_set(text: str | None, k: int = 5) -> np.ndarray:
    """The sorted distinct shingle hashes; with fewer than k words one for the whole."""
    if not text:
        return np.empty(0, dtype=np.uint64)
    h = words(text.encode("utf-8"))[0]
    return np.unique(grams(h, min(k, len(h)))) if len(h) else h
