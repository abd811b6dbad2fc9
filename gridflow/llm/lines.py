"""Line dedup: lines of many documents stay in one of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Tables, batch_of, identity, slices, spare, utf8

SPACES = b" \t\n\x0b\x0c\r"
#: Bits of a filter for each byte of text, and the bounds of a filter's size in bits.
BITS_A_BYTE, LEAST_BITS, MOST_BITS = 0.1, 1 << 16, 1 << 27
CHUNK = 1 << 18  # bytes of a filter that travel as one row


def line_key(line: bytes, least: int) -> bytes | None:
    """Spaces stripped at both ends, A-Z lower-cased; None if under ``least`` code points."""
    key = line.strip(SPACES)
    if len(key) < least:
        return None
    if len(key) < 4 * least and len(key.decode("utf-8", "replace")) < least:
        return None
    return key.lower()


def _keys(text: bytes, least: int) -> set[bytes]:
    return {xxhash.xxh3_128_digest(k) for line in text.split(b"\n") if len(line) >= least and (k := line_key(line, least)) is not None}


def _texts(b: pa.RecordBatch, name: str) -> list[bytes]:
    data, o = utf8(b.column(b.schema.get_field_index(name)))
    raw = data.tobytes()
    o = o.tolist()
    return [raw[i:j] for i, j in zip(o, o[1:], strict=False)]


def _positions(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return keys[:, 0] & np.uint64(bits - 1), keys[:, 1] & np.uint64(bits - 1)


def _get(filt: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (filt[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1)


def _set(filt: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(filt, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))


def _as_pairs(keys) -> np.ndarray:
    return np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)


PART = pa.schema([("chunk", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])


def seen_twice(docs: DataFrame, least: int, bits: int) -> np.ndarray:
    """The Bloom filter of keys seen in two documents or more, of ``bits`` bits.

    Each partition keeps a filter of keys seen once and one of keys seen
    twice; two such pairs merge by once = a|b and twice = a2|b2|(a&b), so a
    key seen in two partitions is in the merged second filter. The filters
    travel in compressed chunks, each merged by one streaming pass. What the
    driver gets and sends is one filter of at most MOST_BITS bits.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for b in slices(batches, "text"):
            lists = [k for t in _texts(b, "text") for k in _keys(t, least)]
            if not lists:
                continue
            keys, n = np.unique(_as_pairs(lists), axis=0, return_counts=True) if len(lists) > 1 else (_as_pairs(lists), np.ones(1, int))
            p, q = _positions(keys, bits)
            again = (n > 1) | ((_get(once, p) & _get(once, q)) > 0)
            for filt, at in ((twice, p[again]), (twice, q[again]), (once, p), (once, q)):
                _set(filt, at)
        squeeze = zstandard.ZstdCompressor(level=1)
        for k in range(0, bits // 8, CHUNK):
            o, t = once[k : k + CHUNK], twice[k : k + CHUNK]
            if o.any():
                yield batch_of(PART, [k // CHUNK], [squeeze.compress(o.tobytes())], [squeeze.compress(t.tobytes())])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand, now, o, t = zstandard.ZstdDecompressor(), None, b"", b""

        def made() -> pa.RecordBatch:
            return batch_of(pa.schema([("chunk", pa.int32()), ("twice", pa.binary())]), [now], [zstandard.ZstdCompressor(level=1).compress(t.tobytes())])

        for b in batches:
            for chunk, a, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
                a, c = (np.frombuffer(expand.decompress(x), np.uint8) for x in (a, c))
                if chunk != now:
                    if now is not None:
                        yield made()
                    now, o, t = chunk, a, c
                else:
                    t, o = t | c | (o & a), o | a
        if now is not None:
            yield made()

    parts = docs.select("text").mapInArrow(build, "chunk int, once binary, twice binary")
    merged = parts.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(merge, "chunk int, twice binary").collect()
    import zstandard

    out = np.zeros(bits // 8, np.uint8)
    for r in merged:
        x = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(r["twice"])), np.uint8)
        out[r["chunk"] * CHUNK : r["chunk"] * CHUNK + len(x)] = x
    return out


def filter_bits(n_bytes: int) -> int:
    want = int(n_bytes * BITS_A_BYTE)
    return 1 << max(LEAST_BITS.bit_length() - 1, min(MOST_BITS.bit_length() - 1, max(1, want).bit_length()))


SUSPECT = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("r1", pa.int64()), ("r2", pa.int64()), ("id", pa.int64())])
ROW = ["r1", "r2"]


def repeated_lines(docs: DataFrame, least_docs: int, least_chars: int, tables: Tables) -> DataFrame:
    """(r1, r2, drop): for rows (r1, r2, id, text), the keys whose lines go, as 16-byte words joined."""
    spark: SparkSession = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = filter_bits(size)
    twice = spark.sparkContext.broadcast(seen_twice(docs, least_chars, bits).tobytes())

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filt = np.frombuffer(twice.value, np.uint8)
        for b in slices(batches, "text"):
            found, of = [], []
            for i, t in enumerate(_texts(b, "text")):
                keys = _keys(t, least_chars)
                found += keys
                of += [i] * len(keys)
            if found:
                keys = _as_pairs(found)
                p, q = _positions(keys, bits)
                hit = (_get(filt, p) & _get(filt, q)) > 0
                at = pa.array(np.array(of)[hit])
                k = keys[hit].view(np.int64)
                yield batch_of(SUSPECT, np.ascontiguousarray(k[:, 0]), np.ascontiguousarray(k[:, 1]), *(b.column(i).take(at) for i in range(3)))

    seen = tables.keep(docs.select(*ROW, "id", "text").mapInArrow(suspects, "k1 long, k2 long, r1 long, r2 long, id long"))
    # partial sets first: a line of every document is one row for each task and id
    many = F.count_distinct("id") + F.count_if(F.col("id").isNull()) >= least_docs
    found = tables.keep(seen.groupBy("k1", "k2").agg(many.alias("many"), F.max("id").alias("last")).where("many and last is not null").select("k1", "k2", "last"))
    # both sides are tables of known size: the few lines are broadcast, or adaptive execution splits a line of very many documents
    gone = seen.join(found, ["k1", "k2"]).where(~F.col("id").eqNullSafe(F.col("last")))
    out = tables.keep(gone.select(*ROW, F.struct("k1", "k2").alias("k")).groupBy(*ROW).agg(F.collect_set("k").alias("drop")))
    tables.drop(seen, found)
    return out


def dedup_lines(docs: DataFrame, least_docs: int = 5, least_chars: int = 40, text_col: str = "text", id_col: str = "doc_id", prefix: str = "") -> DataFrame:
    """``docs`` with text_col cut, n_lines (before) and n_dropped behind ``prefix``.

    A line's key is the line without ASCII spaces at its ends, A-Z
    lower-cased. Lines whose key has at least ``least_chars`` code points and
    is in at least ``least_docs`` documents go everywhere but in the row (or
    rows) of the largest id that holds it. Other lines stay in order, joined by
    a newline. Null and empty texts are one empty line, returned as the empty
    text. Rows of one id are one document, and each gives a row of the result;
    each row without an id counts as a document, is never the largest, and
    where all ids are null nothing goes. Keys are compared by 128-bit hashes.
    Columns of ``docs`` named like the new ones are replaced.
    """
    names = [f"{prefix}n_lines", f"{prefix}n_dropped"]
    d = docs.drop(*[n for n in names if n in docs.columns])
    keys = identity(id_col, text_col)
    base = d.select(*(x.alias(n) for x, n in zip(keys, ROW, strict=True)), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    gone = repeated_lines(base, least_docs, least_chars, Tables(docs.sparkSession, "lines"))
    rows, mark = [spare(d.columns, f"__{n}") for n in ROW], spare(d.columns, "__drop")
    gone = gone.select(*(F.col(o).alias(n) for o, n in zip(ROW, rows, strict=True)), F.col("drop").alias(mark))
    both = d.select("*", *(x.alias(n) for x, n in zip(keys, rows, strict=True))).join(gone, rows, "left").drop(*rows)
    fields = [f for f in d.schema.fields]
    out = T.StructType([*[T.StructField(f.name, T.StringType()) if f.name == text_col else f for f in fields], T.StructField(names[0], T.LongType()), T.StructField(names[1], T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col):
            texts, kept, lines, dropped = _texts(b, text_col), [], [], []
            drops = b.column(b.schema.get_field_index(mark))
            k1, k2 = drops.values.field("k1"), drops.values.field("k2")
            words = np.stack([np.asarray(k1, np.int64), np.asarray(k2, np.int64)], 1).tobytes() if len(drops.values) else b""
            o, there = drops.offsets.to_pylist(), drops.is_valid().to_pylist()
            for i, t in enumerate(texts):
                n = t.count(b"\n") + 1
                gone_here = 0
                if there[i]:
                    bad = {words[16 * j : 16 * j + 16] for j in range(o[i], o[i + 1])}
                    stay = [x for x in t.split(b"\n") if len(x) < least_chars or (k := line_key(x, least_chars)) is None or xxhash.xxh3_128_digest(k) not in bad]
                    gone_here, t = n - len(stay), b"\n".join(stay)
                kept.append(t)
                lines.append(n)
                dropped.append(gone_here)
            cols, at = [], b.schema.get_field_index(text_col)
            for i, f in enumerate(b.schema):
                if f.name != mark:
                    cols.append(pa.array(kept, pa.binary()).cast(pa.string()) if i == at else b.column(i))
            sch = pa.schema([pa.field(f.name, pa.string()) if f.name == text_col else f for f in b.schema if f.name != mark] + [pa.field(names[0], pa.int64()), pa.field(names[1], pa.int64())])
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], schema=sch)

    return both.mapInArrow(run, out)
