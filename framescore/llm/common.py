"""Shared pieces of the corpus operators: tables written between steps, words of a text
found and hashed without a Python object a word, and connected components."""

from __future__ import annotations

import ctypes
import functools
import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text worked on at once by the numpy helpers (a longer text is a chunk of its own).
CHUNK = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is unset
    (tests on one machine), a new temporary folder."""
    have = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not have:
        have = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(have)
    return have.rstrip("/")


#: Rows and bytes that a Python worker takes at once while a step is written: texts and blocks are large rows.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def written(df: DataFrame, what: str = "step") -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends there, so that a lost executor costs
    a re-read and two uses see the same rows."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    had = {k: spark.conf.get(k) for k in (rows, size)}
    try:
        spark.conf.set(rows, str(BATCH_ROWS if int(had[rows]) <= 0 else min(int(had[rows]), BATCH_ROWS)))
        spark.conf.set(size, str(BATCH_BYTES))
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in had.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, n: int) -> DataFrame:
    """``df`` written as a table in n buckets of ``key`` in the warehouse, which executors share: a join on the key
    shuffles only the other side."""
    name = f"step_{uuid.uuid4().hex}"
    df.repartition(n, key).write.option("compression", "zstd").bucketBy(n, key).sortBy(key).saveAsTable(name)
    return df.sparkSession.table(name)


def carried(docs: DataFrame, *own: str) -> DataFrame:
    """``docs`` as its columns ``own``, which an operator reads, and ``row``, all of them but the text: so no name that an operator adds, and no
    dot in a name, can clash with one of theirs."""
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"))
    return docs.select(*(F.col(f"`{c}`") for c in dict.fromkeys((*own, "text"))), rest.alias("row"))


def put_back(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The ``columns`` that ``carried`` took, and the text as it is now."""
    return rows.select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in columns))


def released(run: Callable) -> Callable:
    """``run`` for mapInArrow, after which the worker gives memory that it has freed back to the system: workers wait for later tasks, of other
    steps too, beside those that are at work."""

    @functools.wraps(run)
    def task(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
            trim(0)

    return task


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ascii_lower(text):
    """``text`` with A-Z lower-cased and nothing else changed; null gives the empty text."""
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(F.coalesce(text, F.lit("")), upper, upper.lower())


# --- words of many texts at once -------------------------------------------------------------------


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BASE = np.uint64(0xD6E8FEB86659FD93)
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
#: Bytes of words split at white space: all but 0x09-0x0D and 0x20.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW, _INV = _powers(_BASE, CHUNK), _powers(_UNBASE, CHUNK)


class Words:
    """Words of texts ``lo`` to ``hi`` of a column: ``doc`` (row less ``lo``), ``start`` and ``end`` (bytes in ``buf``),
    ``hash`` (64 bits of the word's bytes)."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, lower: bool, isword: np.ndarray, classes: np.ndarray | None = None):
        """``classes``: a number a byte; a word also ends where two different ones above 0 meet."""
        self.buf, self.offs = buf, offs
        n = len(buf)
        m = isword[buf]
        before, after = np.empty(n, bool), np.empty(n, bool)
        if n:
            before[0], after[-1] = False, False
            before[1:], after[:-1] = m[:-1], m[1:]
            before[offs[:-1][offs[:-1] < n]] = False
            after[offs[1:][offs[1:] > 0] - 1] = False
        if classes is not None and n:
            kind = classes[buf]
            turn = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
            before[1:] &= ~turn
            after[:-1] &= ~turn
        self.start = np.flatnonzero(m & ~before)
        self.end = np.flatnonzero(m & ~after) + 1
        self.doc = np.searchsorted(offs, self.start, "right") - 1
        power, inverse = (_POW, _INV) if n <= CHUNK else (_powers(_BASE, n), _powers(_UNBASE, n))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((_BYTE_LOWER if lower else _BYTE)[buf] * power[:n], out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * inverse[self.start] + (self.end - self.start).astype(np.uint64) * _ODD)
        #: Words before each text, one more at the end.
        self.first = np.searchsorted(self.doc, np.arange(len(offs)))

    def word(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.end[i]].tobytes()


def words(col: pa.Array, lower: bool, isword: np.ndarray = NOT_SPACE, size: int = CHUNK, classes: np.ndarray | None = None) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, their words) of a string column, about ``size`` bytes at a time; null is an empty text."""
    col = col.fill_null("").cast(pa.large_string())
    if len(col) == 0:
        return
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + size, "right")) - 1)
        yield lo, hi, Words(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], lower, isword, classes)
        lo = hi


def grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` consecutive words that lie in one text, and the word each starts at."""
    m = len(w.hash) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    g = np.zeros(m, np.uint64)
    for j in range(n):
        g = g * _BASE + w.hash[j : j + m]
    at = np.flatnonzero(w.doc[:m] == w.doc[n - 1 :])
    return mix(g[at]), at


def binary(rows: list[bytes]) -> pa.Array:
    return pa.array(rows, pa.binary())


# --- blocks: many small records of one bucket sent as one row ----------------------------------------

#: What a record is, the bucket it is for, the batch it came from, and its arrays.
BLOCK = "kind string, bucket long, batch long, block binary"


def block(kind: str, bucket: int, batch: int, *arrays) -> tuple:
    return kind, int(bucket), int(batch), pickle.dumps(arrays, 5)


def block_rows(rows: list[tuple]) -> pa.RecordBatch:
    kind, bucket, batch, data = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(bucket, pa.int64()), pa.array(batch, pa.int64()), binary(list(data))], ["kind", "bucket", "batch", "block"])


def groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts rows by keys, the last first, and where each group of equal rows begins."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    return order, np.flatnonzero(new)


def by_bucket(key: np.ndarray, buckets: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Order of records by bucket and key, and (bucket, first, after the last) of each bucket that has some."""
    to = (key % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((key, to))
    cuts = np.searchsorted(to[order], np.arange(buckets + 1))
    return order, [(i, a, z) for i, (a, z) in enumerate(zip(cuts[:-1], cuts[1:])) if z > a]


# --- connected components --------------------------------------------------------------------------


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long), where component is the smallest node reachable.

    Alternating large-star and small-star rounds; each is an aggregate and a join over narrow rows, written to
    the shared folder, and halves path lengths. A star's centre may be linked to a third of all nodes: minima are
    combined before the shuffle and the join back is one that Spark can split."""
    pair = lambda df: df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    now = written(pair(edges), "edges")
    for _ in range(max_rounds):
        # large star: every larger neighbour of a node is linked to the node's smallest neighbour
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: every smaller neighbour of a node, and the node, are linked to the smallest of them
        large = written(pair(large), "edges")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        after = written(pair(small), "edges")
        same = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if same == now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first():
            break
        now = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
