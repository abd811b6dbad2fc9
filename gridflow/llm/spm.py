"""SentencePiece encoding and decoding on the tokenizers library."""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, slices

SPACE = "▁"
#: Piece types and field numbers of the public model format (fixed values).
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
MEMORY = 250_000
#: Words that go to the library as one text, whose ids fall apart where a piece starts a word.
TOGETHER = 16


def wire(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protobuf message: integers, raw 4 or 8 bytes, or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, data[at : at + n]
        at += n


@dataclass
class Model:
    """What a model file says: pieces with scores and types, the kind of model, and how texts are normalised."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra: bool = True
    escape: bool = True


def parse(data: bytes) -> Model:
    m = Model()
    for number, value in wire(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in wire(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            m.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in wire(value):
                if n == 3:
                    m.kind = v
                elif n == 35:
                    m.byte_fallback = bool(v)
        elif number == 3:
            for n, v in wire(value):
                if n == 2:
                    m.charsmap = v
                elif n == 3:
                    m.dummy_prefix = bool(v)
                elif n == 4:
                    m.remove_extra = bool(v)
                elif n == 5:
                    m.escape = bool(v)
    return m


def build(m: Model):
    """The model as a tokenizer of the tokenizers library."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
    from tokenizers import AddedToken, Regex, Tokenizer, models, normalizers

    vocab = {p: i for i, (p, _, _) in enumerate(m.pieces)}
    unknown = next((i for i, (_, _, k) in enumerate(m.pieces) if k == UNKNOWN), 0)
    if m.kind == UNIGRAM:
        # pieces of other types never match a text: none of their characters can be written
        pairs = [(p if k in (NORMAL, USER, BYTE, UNKNOWN) else f"{i}", s) for i, (p, s, k) in enumerate(m.pieces)]
        tok = Tokenizer(models.Unigram(pairs, unk_id=unknown, byte_fallback=m.byte_fallback))
    elif m.kind == BPE:
        usable = {p: (s, i) for i, (p, s, k) in enumerate(m.pieces) if k in (NORMAL, USER)}
        merges = sorted(((-s, i, a, p[: a]) for p, (s, i) in usable.items() for a in range(1, len(p)) if p[:a] in usable and p[a:] in usable), key=lambda x: x[:3])
        tok = Tokenizer(models.BPE(vocab, [(left, m.pieces[i][0][a:]) for _, i, a, left in merges], unk_token=m.pieces[unknown][0], fuse_unk=True, byte_fallback=m.byte_fallback, cache_capacity=0))
    else:
        raise ValueError(f"models of type {m.kind} aren't supported")
    steps = []
    if m.charsmap:
        steps.append(normalizers.Precompiled(m.charsmap))
    if m.remove_extra:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if m.dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    if m.escape:
        steps.append(normalizers.Replace(" ", SPACE))
    tok.normalizer = normalizers.Sequence(steps)
    own = [AddedToken(p, normalized=False) for p, _, k in m.pieces if k == USER]
    if own:
        tok.add_tokens(own)
    return tok


class Pieces:
    """Encodes texts in batches on all of a worker's threads and checks each result against the sentencepiece library.

    Where no piece reaches over the start of a word, a text's ids are those of
    its words, each with the spaces before it, and words are kept. Results that
    differ from the sentencepiece library's are counted, by the texts that went
    to the library: TOGETHER words or one.
    """

    def __init__(self, path: str, threads: int = 2, verify: bool = True):
        with open(path, "rb") as f:
            data = f.read()
        self.model, self.threads = parse(data), threads
        self.tok = build(self.model)
        self.verify = None
        self.differences = 0
        if verify:
            import sentencepiece

            self.verify = sentencepiece.SentencePieceProcessor(model_proto=data)
        m = self.model
        self.by_words = not m.charsmap and not m.remove_extra and m.dummy_prefix and m.escape and not any(k == USER or re.search(f"[^{SPACE}]{SPACE}", p) for p, _, k in m.pieces if k in (NORMAL, USER))
        self.memory: dict[str, bytes] = {}
        self.starts = np.array([p.startswith(SPACE) for p, _, _ in m.pieces], bool)
        self.texts = [bytes([int(p[3:5], 16)]) if k == BYTE else (b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(SPACE, " ").encode()) for p, _, k in m.pieces] + [" ⁇ ".encode()]

    def library(self, texts: list[str]) -> list[bytes]:
        ids = [e.ids if t else [] for e, t in zip(self.tok.encode_batch_fast(texts, add_special_tokens=False), texts, strict=True)]
        if self.verify is not None:
            want = self.verify.encode(texts, num_threads=self.threads)
            self.differences += sum(a != b for a, b in zip(ids, want, strict=True))
        return [np.array(x, "<u4").tobytes() for x in ids]

    def separate(self, words: list[str]) -> list[bytes]:
        """Ids of each word, encoded several at a time."""
        raw = b"".join(self.library([" ".join(words[i : i + TOGETHER]) for i in range(0, len(words), TOGETHER)]))
        at = 4 * np.flatnonzero(self.starts[np.frombuffer(raw, "<u4")])
        if not words:
            return []
        if len(at) != len(words):  # a model whose words don't all begin with a piece of their own
            return self.library(words)
        return [raw[i:j] for i, j in zip(at.tolist(), [*at[1:].tolist(), len(raw)], strict=True)]

    @staticmethod
    def words(text: str) -> list[str]:
        """Words without the space before them; further spaces stay in front, those at the end are a word of their own."""
        parts = text.split(" ")
        if "" not in parts:
            return parts
        out, wait = [], ""
        for p in parts[:-1]:
            if p:
                out.append(wait + p)
                wait = ""
            else:
                wait += " "
        return [*out, wait + parts[-1]]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit words."""
        if not self.by_words:
            return self.library([t or "" for t in texts])
        words = [self.words(t) if t else [] for t in texts]
        if len(self.memory) >= MEMORY:
            self.memory.clear()
        # a lone space before nothing is a word too: the library drops a text of no characters
        new = list({w for ws in words for w in ws if w not in self.memory})
        plain = [w for w in new if w and " " not in w and SPACE not in w]
        self.memory.update(zip(plain, self.separate(plain), strict=True))
        rest = [w for w in new if w not in self.memory]
        self.memory.update(zip(rest, self.library(rest), strict=True))
        if "" in self.memory:
            self.memory[""] = np.array(self._bare_space(), "<u4").tobytes()
        get = self.memory.__getitem__
        return [b"".join(map(get, ws)) for ws in words]

    def _bare_space(self) -> list[int]:
        i = next((i for i, (p, _, k) in enumerate(self.model.pieces) if p == SPACE and k == NORMAL), None)
        return [i] if i is not None else []

    def decode(self, ids: bytes) -> str:
        """Text of ids: pieces joined, byte pieces as UTF-8 (bad bytes as U+FFFD), the dummy prefix dropped."""
        number = np.frombuffer(ids, "<u4")
        # ids beyond the model take the place behind its pieces, the unknown text
        out = b"".join(map(self.texts.__getitem__, np.minimum(number, len(self.texts) - 1).tolist())).decode("utf-8", "replace")
        return out[1:] if self.model.dummy_prefix and out.startswith(" ") else out


_LOADED: dict[tuple, Pieces] = {}


def pieces(path: str, threads: int, verify: bool) -> Pieces:
    key = (path, threads, verify)
    if key not in _LOADED:
        _LOADED[key] = Pieces(path, threads, verify)
    return _LOADED[key]


ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("differences", pa.int64())])


def encode(docs: DataFrame, model_path: str, threads: int = 2, verify: bool = True, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, ids, differences): ids of whole texts as little-endian unsigned 32-bit words.

    ``differences`` counts, on the last row of each slice, results of the
    rebuilt tokenizer that differ from the sentencepiece library's. Null and
    empty texts have no ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model_path, threads, verify)
        for b in slices(batches, "text"):
            was = p.differences
            ids = p.encode(b.column(1).to_pylist())
            wrong = np.zeros(b.num_rows, np.int64)
            wrong[-1] = p.differences - was
            yield batch_of(ENCODED, b.column(0), ids, wrong)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary, differences long")


def agreed(encoded: DataFrame) -> DataFrame:
    """``encoded``, which fails as it is read where the sentencepiece library had other ids."""
    differ = F.raise_error(F.concat(F.lit("the sentencepiece library has other ids, by doc_id "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    return encoded.withColumn("ids", F.when(F.col("differences") == 0, F.col("ids")).otherwise(differ))


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids, text) from rows of ids; other columns are dropped.

    Ids beyond the model decode like its unknown piece, null ids to null. The
    model file is opened by the path on each worker, as a tokenizer is installed
    there like a library.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model_path, 1, False)
        for b in slices(batches, "ids", 1 << 21):
            yield batch_of(schema, b.column(0), b.column(1), [p.decode(x) if x is not None else None for x in b.column(1).to_pylist()])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")
