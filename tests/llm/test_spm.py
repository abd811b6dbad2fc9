"""The rebuilt SentencePiece tokenizer against the library."""

import struct

import numpy as np
import pytest

from gridflow.llm import spm

sentencepiece = pytest.importorskip("sentencepiece")
P = pytest.importorskip("public_tokenizers")
PATH = P.path("piece_bpe_32k.model")
TEXTS = ["Hello World, it's 12 ÉTÉ!", "", "  double  spaces\n\nlines\ttabs ", "naïve é ﬁ 中文字 🙂🙂", " ", " x", "x  ", "   ", "▁▁a▁b ▁", "<s> </s> <0x41>", "a\0b", "word " * 5000]


def ids(x):
    return np.frombuffer(x, "<u4").tolist()


@pytest.mark.parametrize("by_words", [True, False])
def test_parity_with_the_library(by_words):
    p, sp = spm.Pieces(PATH, verify=False), sentencepiece.SentencePieceProcessor(model_file=PATH)
    p.by_words = p.by_words and by_words
    for t, x in zip(TEXTS, p.encode(TEXTS)):
        assert ids(x) == sp.encode(t)
        assert p.decode(x) == sp.decode(sp.encode(t))


def test_query_columns_and_nulls(spark):
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*TEXTS, None])], "doc_id long, text string, ids string")
    got = {r["doc_id"]: r["text"] for r in spm.decode(spm.encode(d, PATH), PATH).collect()}
    assert got == dict(enumerate([*TEXTS[:8], "  a b  ", *TEXTS[9:], ""]))
    assert spm.encode(d.where("false"), PATH).count() == 0
    assert spm.encode(d, PATH).agg({"differences": "sum"}).first()[0] == 0


def message(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def test_unigram_models_with_byte_fallback():
    """A model file of our own making: two ways to cut a word, and bytes for unknown characters."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256)), ("▁ab", -1.0, 1), ("c", -2.0, 1), ("▁a", -1.5, 1), ("bc", -1.2, 1), ("▁", -3.0, 1), ("a", -4.0, 1), ("b", -4.0, 1)]
    data = b"".join(message(1, message(1, p.encode()) + b"\x15" + struct.pack("<f", s) + message(3, k)) for p, s, k in pieces)
    data += message(2, message(3, 1) + message(35, 1)) + message(3, message(3, 1) + message(4, 1) + message(5, 1))
    m = spm.parse(data)
    assert m.kind == spm.UNIGRAM and m.byte_fallback and m.pieces[3][0] == "<0x00>"
    sp = sentencepiece.SentencePieceProcessor(model_proto=data)
    tok = spm.build(m)
    for t in ("abc", "ab  abc c", "aé b", " bca "):
        assert tok.encode(t, add_special_tokens=False).ids == sp.encode(t), t


def test_differences_are_neither_mended_nor_passed_over(spark):
    class Other:
        def encode(self, texts, num_threads):
            return [[1, 2, 3] for _ in texts]

    p, own = spm.Pieces(PATH), spm.Pieces(PATH, verify=False)
    p.verify = Other()
    assert p.encode(["one text"]) == own.encode(["one text"]) and p.differences == 1  # both words went as one text
    d = spark.createDataFrame([(1, b"\x01\x00\x00\x00", 0), (2, b"", 0)], "doc_id long, ids binary, differences long")
    assert spm.agreed(d).select("ids").count() == 2 and len(spm.agreed(d).collect()) == 2
    with pytest.raises(Exception, match="other ids, by doc_id 3"):
        spm.agreed(d.unionByName(spark.createDataFrame([(3, b"", 1)], d.schema))).collect()


def test_repeated_rows_very_long_texts_and_unknown_ids(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    long = "some words and nümbers 12345 " * 60_000
    d = spark.createDataFrame([(1, long), (2, "twice"), (2, "twice")], "doc_id long, text string")
    got = spm.decode(spm.agreed(spm.encode(d, PATH)), PATH).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 2, 2] and next(ids(r["ids"]) for r in got if r["doc_id"] == 1) == sp.encode(long)
    bad = spark.createDataFrame([(1, np.array([4_000_000_000], "<u4").tobytes()), (2, None)], "doc_id long, ids binary")
    assert {r["doc_id"]: r["text"] for r in spm.decode(bad, PATH).collect()} == {1: "⁇ ", 2: None}


def test_a_broken_model_fails_the_query(spark, monkeypatch):
    """A rebuilt tokenizer with other scores gives other ids, which the query doesn't return."""
    p = spm.Pieces(PATH)
    broken = spm.Pieces(PATH)
    broken.tok = spm.build(spm.Model([(x[::-1] if k == spm.NORMAL else x, s, k) for x, s, k in p.model.pieces], p.model.kind, p.model.byte_fallback))
    broken.encode(["whole sentences of words"])
    assert broken.differences > 0 and p.encode(["whole sentences of words"]) and p.differences == 0


def test_words_encoded_together_fall_apart_rightly():
    p, sp = spm.Pieces(PATH, verify=False), sentencepiece.SentencePieceProcessor(model_file=PATH)
    r = np.random.default_rng(6)
    letters = list("abcdefghéüß中🙂.,!\n\t0<>_") + [" ", "́", " "]
    words = ["".join(r.choice(letters, r.integers(1, 14))) for _ in range(3000)]
    assert [ids(x) for x in p.separate(words)] == [sp.encode(w) for w in words]
    text = " ".join(words)
    assert ids(p.encode([text])[0]) == sp.encode(text)
