"""Best-fit packing of token sequences with certified bin counts."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, batch_of, slices, utf8
from .tokens import SLICE, with_end, word_ids

PIECES = pa.schema([("doc_id", pa.int64()), ("doc_key", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end: int, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, doc_key, piece, start, length, ids_crc32): each document's ids with ``end``, cut every ``capacity`` ids.

    Null and empty texts are one piece holding the end id. ``doc_key`` is a
    hash of id and text that tells rows of one doc_id apart.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer)
        for b in slices(batches, "text", SLICE):
            ids, at = with_end(*words.encode(*utf8(b.column(2))), end)
            n = np.diff(at)
            parts = -(-n // capacity)
            of = np.repeat(np.arange(len(n)), parts)
            piece = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
            start = piece * capacity
            length = np.minimum(capacity, n[of] - start)
            wide = memoryview(ids.astype("<u4").tobytes())
            lo = 4 * (at[of] + start)
            crc = [zlib.crc32(wide[i:j]) for i, j in zip(lo.tolist(), (lo + 4 * length).tolist(), strict=True)]
            row = pa.array(of)
            yield batch_of(PIECES, b.column(0).take(row), b.column(1).take(row), piece.astype(np.int32), start, length, crc)

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(id_col, text_col).alias("doc_key"), F.col(text_col).cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id long, doc_key long, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item by best-fit decreasing; bins numbered from 0.

    Open bins wait in stacks by free space; the tightest stack that fits is
    found in a sorted list of at most ``capacity`` spaces.
    """
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    spaces: list[int] = []
    n = 0
    for i, s in zip(order.tolist(), sizes[order].tolist(), strict=True):
        at = bisect.bisect_left(spaces, s)
        if at < len(spaces):
            free = spaces[at]
            b = stacks[free].pop()
            if not stacks[free]:
                spaces.pop(at)
        else:
            free, b, n = capacity, n, n + 1
        bins[i], offsets[i] = b, capacity - free
        free -= s
        if free:
            if not stacks[free]:
                bisect.insort(spaces, free)
            stacks[free].append(b)
    return bins, offsets


def lower_bound(histogram: np.ndarray, capacity: int) -> int:
    """A bound on the bins that any packing needs, from dual feasible functions.

    ``histogram[s]`` counts the items of size s. For a threshold t the function
    rounds sizes above capacity - t up to the capacity, drops sizes below t and
    keeps the others; further ones count the items by multiples of capacity/k.
    No bin holds more than one capacity of any such function's values, so each
    total divided by the capacity is a bound.
    """
    size = np.arange(len(histogram))
    best = -(-int((size * histogram).sum()) // capacity)
    count, mass = np.concatenate([[0], np.cumsum(histogram)]), np.concatenate([[0], np.cumsum(size * histogram)])
    for t in range(1, capacity // 2 + 1):
        big = count[capacity + 1] - count[capacity - t + 1]
        middle = mass[capacity - t + 1] - mass[t]
        best = max(best, int(big) + -(-int(middle) // capacity))
    for k in range(2, 101):
        # k+1 parts: sizes that are multiples of capacity/(k+1) keep their value, others are rounded down in k parts
        scaled = size * (k + 1)
        value = np.where(scaled % capacity == 0, size * k, (scaled // capacity) * capacity)
        best = max(best, -(-int((value * histogram).sum()) // (capacity * k)))
    return best


PACKED = pa.schema([("doc_id", pa.int64()), ("doc_key", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("stays", pa.bool_())])
_DDL = "doc_id long, doc_key long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, stays boolean"


def _pack_partition(capacity: int, most: int, base: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = base + (TaskContext.get().partitionId() << 40)

        def out(table: pa.Table, at: int) -> tuple[pa.RecordBatch, int]:
            t = table.combine_chunks()
            size = t.column("length").to_numpy()
            # a defined order of equal sizes, whatever order the rows came in
            by = np.lexsort((t.column("piece").to_numpy(), t.column("doc_key").to_numpy()))
            b, o = best_fit(size[by], capacity)
            bins, offsets = np.empty_like(b), np.empty_like(o)
            bins[by], offsets[by] = b, o
            filled = np.bincount(bins, size).astype(np.int64)
            if len(filled) <= lower_bound(np.bincount(size, minlength=capacity + 1), capacity):
                stays = np.arange(len(filled)) != filled.argmin()  # no packing of the block needs fewer; its emptiest bin may still meet others'
            else:
                stays = filled >= capacity
            cols = [t.column(i).combine_chunks() if t.column(i).num_chunks != 1 else t.column(i).chunk(0) for i in range(6)]
            return batch_of(PACKED, *cols, first + at + bins, offsets, stays[bins]), at + len(filled)

        held, rows, at = [], 0, 0
        for batch in batches:
            for i in range(0, batch.num_rows, most):
                held.append(batch.slice(i, most))
                rows += held[-1].num_rows
                if rows >= most:
                    made, at = out(pa.Table.from_batches(held), at)
                    yield made
                    held, rows = [], 0
        if held:
            made, at = out(pa.Table.from_batches(held), at)
            yield made

    return run


#: Pieces that a partition gets, about: each partition's bound is rounded up, so that small ones would waste a bin each.
BLOCK = 32_768


def pack_pieces(items: DataFrame, capacity: int, most: int = 400_000, rounds: int = 2) -> DataFrame:
    """Pack pieces into bins of ``capacity``: the columns of ``pieces`` with sequence_id, offset.

    Pieces spread over partitions of about BLOCK pieces by a hash. Each
    partition packs blocks of up to ``most`` pieces by best-fit decreasing and compares its bin count with
    ``lower_bound``. A block that meets its bound keeps all bins but its
    emptiest; one with a gap keeps its full bins. The pieces of the other bins
    meet in fewer partitions and are packed again, ``rounds`` times; what the
    last round makes is final. Nothing is ever gathered on the driver.
    """
    spark = items.sparkSession
    # full pieces and the others are read apart; making them once costs a few bytes a document
    tables = Tables(spark, "packing")
    items = tables.keep(items)
    key = F.xxhash64("doc_key", "piece")
    full = items.where(F.col("length") >= capacity)
    # a piece that fills its sequence needs no packing; its number is that of its written row, as repeated rows share a key, in a range of its own
    done = [full.select(*PIECES.names, F.monotonically_increasing_id().bitwiseOR(F.lit(-(2**63))).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    rest, base = items.where(F.col("length") < capacity), 0
    width = max(1, -(-rest.count() // BLOCK))
    for k in range(rounds + 1):
        parts = max(1, width >> (3 * k))
        packed = rest.repartition(parts, key).mapInArrow(_pack_partition(capacity, most, base), _DDL)
        if k == rounds:
            done.append(packed.select(*PIECES.names, "sequence_id", "offset"))
            break
        packed = tables.keep(packed)
        done.append(packed.where("stays").select(*PIECES.names, "sequence_id", "offset"))
        rest, base = packed.where("not stays").select(*PIECES.names), base + (1 << 60)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out
