"""Token ids of whole texts, memoised by words, and their Huffman-coded file format."""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, mix, remove, shared_path, slices, utf8

#: ASCII marks that make a token of their own after a letter or digit.
MARKS = b".,;:!?"
#: Words kept in each worker's memory; the memory is emptied when full.
MEMORY = 400_000
SLICE = 1 << 21


class WordIds:
    """Ids of whole texts by a tokenizer that folds case and drops white space.

    Such a tokenizer collapses white space and never makes a token across it,
    so a text's ids are those of its words in order. The words of a slice of
    texts are found, lower-cased (ASCII and Latin-1) and told apart by array operations, only
    its distinct words are looked up in a memory, and only new ones are encoded
    by the library. Marks behind a letter or digit are words of their own.
    """

    def __init__(self, path: str, most: int = MEMORY):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok, self.most, self.memory = Tokenizer.from_file(path), most, {}
        spec = json.loads(self.tok.to_str())
        pattern = json.dumps(spec.get("pre_tokenizer"))
        normal = json.dumps(spec.get("normalizer"))
        if "\\\\s+" not in normal or "Lowercase" not in normal or "[^\\\\s" not in pattern:
            raise ValueError("this tokenizer doesn't drop white space and fold case; words can't be encoded one by one")
        if self.tok.get_vocab_size() > 1 << 16:
            raise ValueError("ids need more than 16 bits")
        # strings that the library finds before it folds case; texts that hold their beginning keep their case
        self.special = [t["content"].encode() for t in spec.get("added_tokens", [])]
        # the byte alphabet of byte-level models: printable bytes stand for themselves, others follow from 256
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [i for i in range(256) if i not in printable]
        self.alphabet = {i: i for i in printable} | {b: 256 + k for k, b in enumerate(other)}
        self.pair = [i.to_bytes(2, "little") for i in range(1 << 16)]

    def _library(self, word: str) -> bytes:
        return np.array(self.tok.encode(word, add_special_tokens=False).ids, "<u2").tobytes()

    def _word(self, raw: bytes) -> bytes:
        """Ids of one word without spaces. Plain small letters are one token of the splitting pattern and go to the model itself."""
        if raw.isalpha() and raw.islower():  # ASCII
            plain = raw.decode()
        else:
            word = raw.decode("utf-8", "replace")
            if not (word.isalpha() and word == word.lower() and max(word) < "\u0250" and unicodedata.is_normalized("NFC", word)):
                return self._library(word)
            plain = raw.decode("latin-1").translate(self.alphabet)
        pair = self.pair
        return b"".join([pair[t.id] for t in self.tok.model.tokenize(plain)])

    def look_up(self, words: list[bytes]) -> list[bytes]:
        memory = self.memory
        out = list(map(memory.get, words))
        for i, ids in enumerate(out):
            if ids is None:
                ids = out[i] = self._word(words[i])
                if len(words[i]) < 64:
                    memory[words[i]] = ids
        if len(memory) >= self.most:
            memory.clear()
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets into them by text) of the texts data[offsets[i] : offsets[i + 1]]."""
        if not len(data):
            return np.zeros(0, np.uint16), np.zeros(len(offsets), np.int64)
        if any(x in memoryview(data).tobytes() for x in self.special):
            # found before case is folded: each text that holds one goes to the library whole
            raw = data.tobytes()
            each = [np.frombuffer(self._library(t.decode("utf-8", "replace")), "<u2") if any(x in t for x in self.special) else self._plain(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in (raw[i:j] for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))]
            return np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])
        return self._plain(data, offsets)

    def _plain(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, np.uint16), np.zeros(len(offsets), np.int64)
        low = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
        # A-Z and, behind their lead byte, the capitals of Latin-1
        lead = np.flatnonzero(low[:-1] == 0xC3) + 1
        low[lead[(low[lead] >= 0x80) & (low[lead] <= 0x9E) & (low[lead] != 0x97)]] += 32
        raw = low.tobytes()
        space = np.flatnonzero((data == 32) | ((data >= 9) & (data <= 13)))
        start = np.insert(space + 1, np.searchsorted(space, offsets[:-1]), offsets[:-1])
        stop = np.insert(space, np.searchsorted(space, offsets[1:]), offsets[1:])
        by_text = np.searchsorted(space, offsets) + np.arange(len(offsets))
        # marks at the end, if a letter or digit stands before them
        size, cut = stop - start, stop.copy()
        for _ in range(3):
            i = np.flatnonzero((cut - start > 1) & _IS_MARK[low[np.maximum(cut - 1, 0)]])
            cut[i] -= 1
        last, before = low[np.maximum(cut - 1, 0)], low[np.maximum(cut - 2, 0)]
        latin = (cut - start > 1) & (before >= 0xC3) & (before <= 0xC5) & ((before > 0xC3) | ((last != 0x97) & (last != 0xB7))) & ((before != 0xC4) | (last != 0xB0))  # no letters; a letter that folds to a mark
        plain = (_IS_PLAIN[last] | latin) & (size > 0)
        cut = np.where(plain, cut, stop)
        # units: each word without its marks, then its marks; most are empty
        n = len(start)
        a, b = np.empty(2 * n, np.int64), np.empty(2 * n, np.int64)
        a[0::2], b[0::2], a[1::2], b[1::2] = start, cut, cut, stop
        used = np.flatnonzero(b > a)
        a, b = a[used], b[used]
        code, words = _distinct(raw, a, b)
        found = self.look_up(words)
        length = np.fromiter(map(len, found), np.int64, len(found)) >> 1
        flat = np.frombuffer(b"".join(found), "<u2")
        first = np.cumsum(length) - length
        count = length[code]
        total = np.cumsum(count)
        ids = flat[np.repeat(first[code] - (total - count), count) + np.arange(int(total[-1]) if len(total) else 0)]
        # where each text's units begin among the used ones
        ends = np.concatenate([[0], total])
        return ids, ends[np.searchsorted(used, 2 * by_text)]


_IS_MARK, _IS_PLAIN = np.zeros(256, bool), np.zeros(256, bool)
_IS_MARK[list(MARKS)] = True
_IS_PLAIN[[*range(97, 123), *range(48, 58)]] = True
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


def _distinct(raw: bytes, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """(code of each word raw[a:b], the distinct words): by their first and last eight bytes, longer ones by a dictionary."""
    import pandas as pd

    padded = np.frombuffer(raw + b"\0" * 8, np.uint8)
    eight = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))
    n = b - a
    x = eight[a] & _KEEP[np.minimum(n, 8)]
    y = np.where(n > 8, eight[np.maximum(b - 8, 0)], np.uint64(0))
    key = mix(x ^ mix(y + n.astype(np.uint64)))
    code, distinct = pd.factorize(key)
    one = np.empty(len(distinct), np.int64)
    one[code[::-1]] = np.arange(len(code))[::-1]
    words = [raw[i:j] for i, j in zip(a[one].tolist(), b[one].tolist(), strict=True)]
    # up to 16 bytes the two parts and the size are the word; all others are told apart by their bytes
    odd = np.flatnonzero((n > 16) | (x != x[one][code]) | (y != y[one][code]) | (n != n[one][code]))
    if len(odd):
        known: dict[bytes, int] = {}
        for i, p, q in zip(odd.tolist(), a[odd].tolist(), b[odd].tolist(), strict=True):
            w = raw[p:q]
            at = known.get(w)
            if at is None:
                at = known[w] = len(words)
                words.append(w)
            code[i] = at
    return code, words


_MEMORIES: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """This worker's memory for a tokenizer file."""
    if path not in _MEMORIES:
        _MEMORIES[path] = WordIds(path)
    return _MEMORIES[path]


ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])


def with_end(ids: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end`` after each text's."""
    return np.insert(ids, offsets[1:], np.uint16(end)).astype("<u2"), offsets + np.arange(len(offsets))


def encode(docs: DataFrame, tokenizer: str, end: int, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, ids) with ids as little-endian unsigned 16-bit words, ``end`` appended to each document.

    Null and empty texts give the end id alone. Special strings in a text are
    what the tokenizer makes of them.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer)
        for b in slices(batches, "text", SLICE):
            ids, at = with_end(*words.encode(*utf8(b.column(1))), end)
            offsets = pa.array((2 * at).astype(np.int32))
            yield batch_of(ENCODED, b.column(0), pa.Array.from_buffers(pa.binary(), b.num_rows, [None, offsets.buffers()[1], pa.py_buffer(ids)]))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary")


# --- canonical length-limited Huffman code -------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int = 16) -> np.ndarray:
    """Code lengths of at most ``limit`` bits that minimise the total (package-merge); 0 where a count is 0."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols don't fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    # each level's list of coins is the leaves merged with the pairs of the level below; which of the first 2n-2 are leaves gives the lengths
    n, level, marks = len(order), weights, []
    kinds = np.ones(n, bool)
    for _ in range(limit - 1):
        marks.append(kinds)
        m = len(level) // 2
        packed = level[: 2 * m].reshape(-1, 2).sum(1)
        merged = np.concatenate([weights, packed])
        leaf = np.concatenate([np.ones(n, bool), np.zeros(m, bool)])
        by = np.argsort(merged, kind="stable")
        level, kinds = merged[by], leaf[by]
    marks.append(kinds)
    take, depth = 2 * n - 2, np.zeros(n, np.int64)
    for kinds in reversed(marks):
        leaves = int(kinds[:take].sum())
        depth[:leaves] += 1
        take = 2 * (take - leaves)
    lengths[order] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes: shorter first, then by id."""
    codes = np.zeros(len(lengths), np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        size = lengths[order].astype(np.int64)
        top = int(size[-1])
        start = np.concatenate([[0], np.cumsum(np.int64(1) << (top - size))[:-1]])
        codes[order] = start >> (top - size)
    return codes


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, every: int) -> tuple[bytes, int, np.ndarray]:
    """(payload, bits, bit offsets of each ``every``-th id) of one block, most significant bit first."""
    size = lengths[ids].astype(np.int64)
    if len(ids) and not size.min():
        raise ValueError("an id has no code")
    stop = np.cumsum(size)
    bits = int(stop[-1]) if len(ids) else 0
    at = stop - size
    word, shift = at >> 5, at & 31
    value = codes[ids].astype(np.uint64) << (64 - size - shift).astype(np.uint64)
    out = np.zeros((bits >> 5) + 2, np.uint64)
    if len(ids):
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out[word[first]] += np.add.reduceat(value >> np.uint64(32), first)
        out[word[first] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
    return out.astype(">u4").tobytes()[: (bits + 7) // 8], bits, at[::every].astype(np.uint32)


def decode_table(lengths: np.ndarray, codes: np.ndarray, limit: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """(id, code length) for each ``limit``-bit lookahead."""
    ids, sizes = np.zeros(1 << limit, np.uint16), np.zeros(1 << limit, np.uint8)
    for i in np.flatnonzero(lengths):
        n = int(lengths[i])
        lo = int(codes[i]) << (limit - n)
        ids[lo : lo + (1 << (limit - n))], sizes[lo : lo + (1 << (limit - n))] = i, n
    return ids, sizes


def unpack(payload: bytes, n: int, checkpoints: np.ndarray, every: int, table: tuple[np.ndarray, np.ndarray], limit: int = 16) -> np.ndarray:
    """The ``n`` ids of a block: all checkpointed segments advance together, one table look-up for each id."""
    raw = np.frombuffer(payload + b"\0" * 8, np.uint8).astype(np.uint32)
    ahead = (raw[:-3] << np.uint32(24)) | (raw[1:-2] << np.uint32(16)) | (raw[2:-1] << np.uint32(8)) | raw[3:]
    symbol, size = table
    at = checkpoints.astype(np.int64)
    out = np.zeros((every, len(at)), np.uint16)
    for k in range(min(every, n)):
        if k and (len(at) - 1) * every + k >= n:
            at = at[: (n - k + every - 1) // every]
        look = (ahead[at >> 3] >> (32 - limit - (at & 7)).astype(np.uint32)) & np.uint32((1 << limit) - 1)
        out[k, : len(at)] = symbol[look]
        at = at + size[look]
    return out.T.reshape(-1)[:n]


BLOCK = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.binary()), ("lengths", pa.binary()), ("first", pa.int64()), ("n", pa.int64()), ("bits", pa.int64()), ("checkpoints", pa.binary()), ("payload", pa.binary())])


def write_tokens(encoded: DataFrame, path: str, block: int = 1 << 18, every: int = 1024, limit: int = 16) -> None:
    """Write (doc_id, ids) in ascending doc_id order as Huffman-coded blocks.

    ``encoded`` must hold its partitions in range order of doc_id, each sorted
    (``sorted_docs``). Files in ``path``: ``codebook`` (id, code length, count),
    ``blocks`` (part, block, the documents' ids and lengths, ids before it in
    its part, id count, bit count, bit offset of each ``every``-th id, payload),
    ``starts`` (part, ids before it) and ``format``. A block ends with a document, holds about ``block`` ids,
    and can be decoded by itself. Null doc_ids come first; an empty table gives
    empty files.
    """
    spark = encoded.sparkSession

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # sorted documents to compressed raw blocks; the counts of ids go with the first one
        import zstandard
        from pyspark import TaskContext

        part, no, first, docs, sizes, held, total = TaskContext.get().partitionId(), 0, 0, [], [], [], 0
        squeeze = zstandard.ZstdCompressor(level=1)

        def flush() -> pa.RecordBatch:
            raw = b"".join(held)
            ids = np.frombuffer(raw, "<u2")
            count = np.bincount(ids, minlength=0)
            seen = np.flatnonzero(count)
            return batch_of(RAW, [part], [no], [_ids(docs)], [np.array(sizes, "<i8").tobytes()], [first], [len(ids)], [squeeze.compress(raw)], [seen.astype("<u2").tobytes()], [count[seen].astype("<i8").tobytes()])

        for b in batches:
            for d, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                docs.append(d)
                sizes.append(len(x) // 2)
                held.append(x)
                total += len(x) // 2
                if total >= block:
                    yield flush()
                    no, first, docs, sizes, held, total = no + 1, first + total, [], [], [], 0
        if docs:
            yield flush()

    tmp = shared_path(spark, "token-ids")
    encoded.select("doc_id", "ids").mapInArrow(stage, "part int, block int, doc_ids binary, lengths binary, first long, n long, raw binary, seen binary, counts binary").write.option("compression", "uncompressed").parquet(tmp)
    raw = spark.read.parquet(tmp)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for b in batches:
            for s, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[np.frombuffer(s, "<u2")] += np.frombuffer(c, "<i8")
        at = np.flatnonzero(total)
        yield batch_of(pa.schema([("id", pa.int32()), ("n", pa.int64())]), at.astype(np.int32), total[at])

    # at most 65,536 rows, whatever the input
    table = raw.select("seen", "counts").mapInArrow(tally, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(1 << 16, np.int64)
    for r in table:
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts, limit)
    codes = canonical_codes(lengths)
    used = np.flatnonzero(lengths)
    spark.createDataFrame([(int(i), int(lengths[i]), int(counts[i])) for i in used], "id int, length int, n long").coalesce(1).write.parquet(f"{path}/codebook")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand = zstandard.ZstdDecompressor()
        for b in batches:
            for r in b.to_pylist():
                ids = np.frombuffer(expand.decompress(r["raw"]), "<u2")
                payload, bits, marks = pack(ids, lengths, codes, every)
                yield batch_of(BLOCK, [r["part"]], [r["block"]], [r["doc_ids"]], [r["lengths"]], [r["first"]], [r["n"]], [bits], [marks.astype("<u4").tobytes()], [payload])

    raw.drop("seen", "counts").mapInArrow(code, "part int, block int, doc_ids binary, lengths binary, first long, n long, bits long, checkpoints binary, payload binary").write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    parts = raw.groupBy("part").agg(F.sum("n").alias("n")).collect()  # a row for each partition
    starts, before = [], 0
    for r in sorted(parts, key=lambda r: r["part"]):
        starts.append((r["part"], before))
        before += r["n"]
    spark.createDataFrame(starts, "part int, start long").coalesce(1).write.parquet(f"{path}/starts")
    spark.createDataFrame([(every, limit)], "every int, code_limit int").coalesce(1).write.parquet(f"{path}/format")
    remove(spark, tmp)


RAW = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.binary()), ("lengths", pa.binary()), ("first", pa.int64()), ("n", pa.int64()), ("raw", pa.binary()), ("seen", pa.binary()), ("counts", pa.binary())])


def _ids(docs: list) -> bytes:
    """Document ids with a leading flag byte for each: nulls are kept."""
    return np.array([d is not None for d in docs], np.uint8).tobytes() + np.array([d or 0 for d in docs], "<i8").tobytes()


TOKENS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) from the files of ``write_tokens``; ids as little-endian unsigned 16-bit words, start counts all ids before."""
    book = spark.read.parquet(f"{path}/codebook").collect()
    form = spark.read.parquet(f"{path}/format").first()
    every, limit = form["every"], form["code_limit"]
    lengths = np.zeros(1 << 16, np.uint8)
    for r in book:
        lengths[r["id"]] = r["length"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(lengths, canonical_codes(lengths), limit)
        for b in batches:
            for r in b.to_pylist():
                ids = unpack(r["payload"], r["n"], np.frombuffer(r["checkpoints"], "<u4"), every, table, limit)
                n = np.frombuffer(r["lengths"], "<i8")
                stop = np.cumsum(n)
                there = np.frombuffer(r["doc_ids"][: len(n)], np.uint8).astype(bool)
                doc = np.frombuffer(r["doc_ids"][len(n) :], "<i8")
                raw = ids.astype("<u2").tobytes()
                yield batch_of(TOKENS, pa.array(doc, mask=~there), r["start"] + r["first"] + stop - n, [raw[2 * (e - k) : 2 * e] for e, k in zip(stop.tolist(), n.tolist(), strict=True)])

    blocks = spark.read.parquet(f"{path}/blocks").select("part", "doc_ids", "lengths", "first", "n", "checkpoints", "payload")
    # one row for each partition of the writer
    return blocks.join(F.broadcast(spark.read.parquet(f"{path}/starts")), "part").mapInArrow(run, "doc_id long, start long, ids binary")


def sorted_docs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) in ascending doc_id order over the partitions; equal ids by text, so the order is defined."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    return d.repartitionByRange(*order).sortWithinPartitions(*order)


def id_digests(ids: DataFrame) -> DataFrame:
    """Adds n_tokens and ids_crc32 (unsigned CRC-32 of the ids as little-endian unsigned 32-bit words) to (doc_id, start, ids)."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(2).to_pylist()
            yield batch_of(schema, b.column(0), b.column(1), [len(x) // 2 for x in raw], [zlib.crc32(np.frombuffer(x, "<u2").astype("<u4").tobytes()) for x in raw])

    return ids.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")

