"""Shared helpers: text buffers, polynomial hashes, files in the shared folder, components."""

from __future__ import annotations

import atexit
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Multiplier of all polynomial hashes, odd and so invertible modulo 2**64.
BASE = 0x9E3779B97F4A7C15
#: One odd random word for each byte value: the letters of the polynomials.
LETTER = np.random.default_rng(20240607).integers(0, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder from ``spark.checkpoint.dir``.

    A folder of this machine only where that is unset and all tasks run in this
    machine's own process (tests); elsewhere executors wouldn't share it, so
    that an unset folder raises.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not path:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="gridflow-")
        sc.setCheckpointDir(path)
    elif not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name in the shared folder, removed when the driver ends."""
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone at exit
        pass


#: Lets Spark remove the shuffle files of an action when that ends; set only while a table is written, whose readers need none of them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to ``path`` as Parquet and read again; what was shuffled for it is removed."""
    spark = df.sparkSession
    was = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path)


class Tables:
    """Tables in the shared folder that one call of an operator writes to cut lineage, and removes as it is done with them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.count = spark, shared_path(spark, name), 0

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` written and read again: its size is known to the planner and executors may be lost."""
        self.count += 1
        path = f"{self.path}/{self.count}"
        out = write(df, path)
        out._written_at = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            remove(self.spark, t._written_at)


def spare(names: Iterable[str], want: str) -> str:
    """``want``, or it with underscores in front so that it meets none of ``names``, whatever their case."""
    taken = {n.lower() for n in names}
    while want.lower() in taken:
        want = "_" + want
    return want


def identity(id_col: str, text_col: str) -> tuple[Column, Column]:
    """128 bits that stand for a row's id and text, as two longs; repeated rows share them."""
    return F.xxhash64(id_col, text_col), F.xxhash64(F.lit(0x5DEECE66D), F.length(text_col), id_col, text_col)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty."""
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = pc.fill_null(column.cast(kind), b"" if kind == pa.large_binary() else "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets is not None and offsets.size else np.zeros(1, np.int64)
    b = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return (b[o[0] : o[-1]], o - o[0]) if len(o) else (b[:0], np.zeros(1, np.int64))


@functools.cache
def _trim():
    """The C library's call that returns free memory, where there is one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return lambda pad: 0


def give_back() -> None:
    """A worker that waits for its next task shouldn't hold what this one's batches took."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def slices(batches: Iterable[pa.RecordBatch], name: str, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``most`` bytes in column ``name`` (one row at least), so that work arrays stay small."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, o = utf8(batch.column(batch.schema.get_field_index(name)))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(o, o[i] + most, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j
        give_back()


@functools.lru_cache(4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0], m = 1, 1
    while m < n:
        k = min(m, n - m)
        out[m : m + k] = out[:k] * U64(pow(base, m, 1 << 64))
        m += k
    return out


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE**i (or its inverse's powers) modulo 2**64 for i < n."""
    size = 1 << max(16, int(n - 1).bit_length())
    return _powers(pow(BASE, -1, 1 << 64) if inverse else BASE, size)[:n]


def prefix_hashes(letters: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = sum of letters[k] * BASE**-k for i <= k < j."""
    out = np.zeros(len(letters) + 1, np.uint64)
    np.cumsum(letters * powers(max(1, len(letters)), True)[: len(letters)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Position-free polynomial hash of [lo, hi)."""
    return (prefix[hi] - prefix[lo]) * powers(len(prefix))[lo]


def mix(x: np.ndarray) -> np.ndarray:
    """Final mixing, a bijection of 64-bit words."""
    x = x ^ (x >> U64(31))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def as_long(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def runs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of the half-open intervals [starts, ends); touching ones join."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], s[1:] > e[:-1]])
    return s[new], e[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(s) - 1]])]


def components(edges: DataFrame, tables: Tables, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of the nodes with an edge; the component is its smallest node.

    Alternating large-star and small-star rounds over the edge table, each
    written among ``tables``: after each round every edge points to a smaller
    node, and no node's neighbours are ever gathered in one row. It ends when a
    round changes nothing. Null ends and loops are ignored. Joins on a star's
    hub come straight from a written table, so that adaptive execution can
    split a hub of very many neighbours.
    """
    def state(d: DataFrame):
        return d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    e = tables.keep(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct())
    was = state(e)
    while was[0]:
        both = e.union(e.select(F.col("v"), F.col("u"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.when(F.col("v") > F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        before, e = e, tables.keep(small)
        tables.drop(before)
        now = state(e)
        if was == now:
            break
        was = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
