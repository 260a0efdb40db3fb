"""Shared pieces: whole-column text kernels on Arrow buffers, durable intermediate tables, connected components.

The text kernels work on the bytes of a whole Arrow column with numpy, so no Python string is made per word.
``slices`` bounds what a kernel holds at a time.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the word rule of the contracts: separators \x20 and \x09-\x0D, lower-casing of A-Z only.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


# ---------------------------------------------------------------- durable tables


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; where that is unset in local mode (tests), one of this machine is set once."""
    conf = spark.sparkContext.getConf()
    named = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.loom.shared.dir", None):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.conf.set("spark.loom.shared.dir", "file://" + tempfile.mkdtemp(prefix="loom-shared-"))
    return spark.conf.get("spark.loom.shared.dir")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended: the folder is the cluster's to clean
        pass


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors. The table
    is removed at exit, or by ``discard`` before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._durable_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove durable tables that nothing will read any more, and let Spark drop the shuffle files of what made them:
    it does so once the JVM has collected the plans."""
    for df in tables:
        _remove(df.sparkSession, df._durable_path)
    gc.collect()
    tables[0].sparkSession._jvm.System.gc()


# ---------------------------------------------------------------- workers


def give_back() -> None:
    """Hand what this process no longer uses back to the system: allocators keep it otherwise."""
    _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc alone has it
        trim(0)


def returning(run):
    """``run``, a map over the batches of a task, which gives memory back at the task's end: Spark keeps its worker idle
    beside the JVM while stages without Python run, with all that it holds."""

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


# ---------------------------------------------------------------- text kernels


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.large_string())
    wide = pa.types.is_large_string(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, body = column.buffers()
    off = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(body, np.uint8)[off[0] : off[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20):
    """Consecutive row slices of a batch with at most ``most`` bytes of text, or one row."""
    _, off = utf8(batch.column(batch.schema.get_field_index(column)))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield batch.slice(at, min(to, n) - at)
        at = min(to, n)


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text index of each word."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = SPACE[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0] = after[-1] = True
    before[1:], after[:-1] = space[:-1], space[1:]
    before[off[:-1][off[:-1] < n]] = True
    after[off[1:][off[1:] > 0] - 1] = True
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads all bits of a 64-bit value."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of each lower-cased word, from one prefix sum over the bytes."""
    n = len(data)
    if len(_powers[0]) < n + 1:
        size = 1 << max(n, 1 << 19).bit_length()
        for k, base in enumerate((_BASE, _BASE_INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * _powers[0][:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _powers[1][starts] + (ends - starts).astype(np.uint64))


def shingles(words: np.ndarray, doc: np.ndarray, texts: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each text, as sorted 64-bit hashes, with offsets.

    A text of fewer than k words has its whole sequence as one shingle, a text without words none.
    """
    counts = np.bincount(doc, minlength=texts)
    first = np.concatenate(([0], np.cumsum(counts)))
    n = len(words)
    rolled = np.zeros(n, np.uint64)
    for j in range(k):
        rolled[: n - j] = mix(rolled[: n - j] * np.uint64(0x9FB21C651E98DF25) + words[j:] + np.uint64(j + 1)) if j < n else rolled[: n - j]
    out, off = [], np.zeros(texts + 1, np.int64)
    for d in range(texts):
        a, b = first[d], first[d + 1]
        if b - a >= k:
            got = np.unique(rolled[a : b - k + 1])
        elif b > a:
            one = np.uint64(b - a)
            for w in words[a:b]:
                one = mix(np.array([one * np.uint64(0xD6E8FEB86659FD93) + w], np.uint64))[0]
            got = np.array([one], np.uint64)
        else:
            got = rolled[:0]
        out.append(got)
        off[d + 1] = off[d] + len(got)
    return (np.concatenate(out) if out else rolled[:0]), off


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    data, off = utf8(column)
    starts, ends, doc = word_spans(data, off)
    with np.errstate(over="ignore"):
        return shingles(word_hashes(data, starts, ends), doc, len(off) - 1, k)


# ---------------------------------------------------------------- connected components


def _mark(df: DataFrame) -> tuple:
    r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable over ``edges`` (u, v), by alternating large-star and small-star.

    Neighbourhoods are only ever reduced to a minimum (a partial aggregate), never collected, so a hub of any
    degree is safe. Each round is written to the shared folder.
    """
    e = durable(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(e)
    while mark[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        e, last = durable(small), mark
        mark = _mark(e)
        if mark == last:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
