"""Operators on texts against brute force on small tables."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from gridflow.llm import langid, lines, packing, suffix, tokens, toxicity

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")
WORD = P.path("word_bpe_49k.json")


def table(spark, texts, extra=True):
    rows = [(i, t, "x", None, i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_spans string, h string, n_lines int").repartition(3) if extra else spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdeéü") for _ in range(r.randint(1, 7))) for _ in range(n))


def brute_repeats(texts, L):
    seen = defaultdict(list)
    raw = [(t or "").encode() for t in texts]
    for i, b in enumerate(raw):
        for s in range(len(b) - L + 1):
            seen[b[s : s + L]].append((i, s))
    cover = [np.zeros(len(b), bool) for b in raw]
    for places in seen.values():
        if len(places) > 1:
            for i, s in places:
                cover[i][s : s + L] = True
    out = {}
    for i, (b, c) in enumerate(zip(raw, cover)):
        n = int((np.diff(np.concatenate([[0], c.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~c]) if b else b""
        out[i] = (len(b), int(c.sum()), n, hashlib.sha256(kept).hexdigest())
    return out


def repeat_texts():
    a, b, c = prose(1, 120), prose(2, 200), prose(3, 60)
    near = a[:150] + "X" + a[151:]
    return [a, b + c, c + " " + b[40:], a, near, near[5:], None, "", "é" * 300, "abc" * 200, "abc" * 90, b[:100] + a[50:400] + b[100:], prose(9, 2000), prose(9, 2000)[3000:3500], a[:99], a[:100], a[1:101]]


@pytest.mark.parametrize("most", [4096, 1])
def test_suffix_dedup_is_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(suffix, "MOST_IN_GROUP", most)
    texts = repeat_texts()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in suffix.cut_repeats(table(spark, texts), 100).collect()}
    assert got == brute_repeats(texts, 100)


def test_shorter_repeats_are_counted_beside(spark):
    texts = repeat_texts()
    rows = suffix.cut_repeats(table(spark, texts).withColumnRenamed("h", "__s0").withColumnRenamed("n_lines", "__R1"), 100, passage=40).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in rows} == brute_repeats(texts, 100)
    assert {r["doc_id"]: r["n_repeated"] for r in rows} == {i: w[1] for i, w in brute_repeats(texts, 40).items()}
    assert all(r["__s0"] is None and r["__R1"] == r["doc_id"] for r in rows)


def test_suffix_dedup_of_a_text_longer_than_a_slice(spark):
    texts = [prose(21, 400_000), prose(22, 60) + prose(21, 400_000)[900_000:901_000], "x" * 3_000_000]
    got = {r["doc_id"]: r for r in suffix.cut_repeats(table(spark, texts), 400).collect()}
    assert got[0]["n_removed"] == got[1]["n_removed"] == len(texts[0][900_000:901_000].encode()) and got[2]["n_removed"] == 3_000_000 and got[2]["n_spans"] == 1


def test_suffix_dedup_of_an_empty_table_and_repeated_rows(spark):
    assert suffix.cut_repeats(table(spark, ["x"]).where("false"), 100).count() == 0
    d = spark.createDataFrame([(1, prose(5, 100)), (1, prose(5, 100)), (None, prose(6, 100))], "doc_id long, text string")
    got = sorted((r["doc_id"] is None, r["n_bytes"] - r["n_removed"] > 0) for r in suffix.cut_repeats(d, 100).collect())
    assert got == [(False, False), (False, False), (True, True)]


def test_suffix_sort_orders_by_group_and_bytes():
    r = np.random.default_rng(3)
    buf = r.integers(0, 2, 400, dtype=np.uint8)
    start = r.integers(0, 380, 60)
    size = np.minimum(400 - start, r.integers(0, 50, 60))
    group = r.integers(0, 4, 60)
    order, lcp = suffix.suffix_sort(buf, start, size, group)
    keys = [(int(group[i]), bytes(buf[start[i] : start[i] + size[i]])) for i in order]
    assert keys == sorted(keys)
    for i in range(1, 60):
        (g, x), (f, y) = keys[i - 1], keys[i]
        n = next((k for k, (c, d) in enumerate(zip(x, y)) if c != d), min(len(x), len(y)))
        assert lcp[i] == (n if g == f else -1)


def test_suffix_sort_survives_hash_collisions(monkeypatch):
    monkeypatch.setattr(suffix, "span_hash", lambda P, lo, hi: np.zeros(len(lo), np.uint64))
    buf = np.frombuffer(b"banana bandana", np.uint8)
    start = np.arange(14)
    order, _ = suffix.suffix_sort(buf, start, 14 - start, np.zeros(14, int))
    assert [bytes(buf[i:]) for i in order] == sorted(bytes(buf[i:]) for i in range(14))


def brute_lines(texts):
    key = lambda x: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x)
    low = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    docs = defaultdict(set)
    for i, t in enumerate(texts):
        for x in (t or "").split("\n"):
            docs[low(key(x))].add(i)
    out = {}
    for i, t in enumerate(texts):
        xs = (t or "").split("\n")
        stay = [x for x in xs if not (len(low(key(x))) >= 40 and len(docs[low(key(x))]) >= 5 and i != max(docs[low(key(x))]))]
        out[i] = (len(xs), len(xs) - len(stay), "\n".join(stay))
    return out


def test_line_dedup_is_brute_force(spark):
    a, b = "Once more this LINE is long enough to count é", "ü" * 39
    texts = [f"{a}\nown {i}\n  {a.lower()}\t\n{b}\n{'z' * 40 if i < 4 else ''}" for i in range(7)] + [None, "", a + "\n", "\n\n", ("long " * 20000) + "\n" + a, "ü" * 40, *["ü" * 40] * 5]
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in lines.dedup_lines(table(spark, texts)).collect()}
    assert got == brute_lines(texts)
    assert lines.dedup_lines(table(spark, ["x"]).where("false")).count() == 0


def test_line_dedup_counts_documents_not_rows(spark):
    line = "a line that is long enough to be counted by this test"
    d = spark.createDataFrame([(1, line)] * 3 + [(2, line)] * 2, "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_dropped"]) for r in lines.dedup_lines(d).collect()) == [(1, 0)] * 3 + [(2, 0)] * 2
    more = d.union(spark.createDataFrame([(None, line), (None, line), (3, line), (3, line)], d.schema)).withColumnsRenamed({}).selectExpr("*", "1 as __r1", "2 as __DROP")
    got = lines.dedup_lines(more)
    assert got.columns == ["doc_id", "text", "__r1", "__DROP", "n_lines", "n_dropped"]
    assert sorted((r["doc_id"] or 0, r["n_dropped"], r["text"]) for r in got.collect()) == [(0, 1, "")] * 2 + [(1, 1, "")] * 3 + [(2, 1, "")] * 2 + [(3, 0, line)] * 2


def test_line_dedup_without_ids_keeps_everything(spark):
    d = spark.createDataFrame([(None, "x" * 50)] * 6, "doc_id long, text string")
    assert {r["n_dropped"] for r in lines.dedup_lines(d).collect()} == {0}


def test_seen_twice_holds_every_repeat(spark):
    texts = [f"line number {i % 40} {'y' * 40}" for i in range(80)]
    bits = lines.filter_bits(sum(map(len, texts)))
    f = lines.seen_twice(table(spark, texts), 40, bits)
    keys = lines._as_pairs([k for t in set(texts) for k in lines._keys(t.encode(), 40)])
    p, q = lines._positions(keys, bits)
    assert (lines._get(f, p) & lines._get(f, q)).all()


TEXTS = ["Hello World, it's 12 ÉTÉ!", None, "", "  double  spaces\n\nlines\ttabs ", "naïve café's é ﬁ İstanbul ΣΑΣ 中文字 🙂🙂", "x" * 300, "don't we're I'LL they'd", "a" * 70 + ".,!", "<|endoftext|> word", "Σ", "각,", prose(4, 3000)]


def library_ids(t):
    return tokenizers.Tokenizer.from_file(WORD).encode(t or "", add_special_tokens=False).ids


HARD = ["\u00c0\u00c9\u00d7. \u00d7, \u00f7! \u0130. \u0149; \u017f? \u00ca\u0301. X\u00c3\u00d0\u00deY", "a\r\nb\x0bc\x0cd\u00a0e\u2003f", "A.B,C.. d;:!?e f?!. g... ...", "x\u2026. \u00bd, 5. 5th 1,000.5", "E\u0301. I\u0307, \u1e9e.", "<|STARTOFTEXT|> <|startoftext|>", "a" * 17 + " " + "a" * 16 + "b " + "a" * 17 + "c, " + "a" * 17, " .", ". ", "l'\u00e9t\u00e9, d\u00e9j\u00e0. \u00fc.", "'s 't. X's, y'll; z'RE!"]


def test_words_encode_like_the_library():
    w = tokens.WordIds(WORD, 50)
    texts = [*TEXTS, *HARD]
    for _ in range(2):
        for group in (texts, *[[t] for t in texts]):
            raw = [(t or "").encode() for t in group]
            ids, at = w.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
            for i, t in enumerate(group):
                assert ids[at[i] : at[i + 1]].tolist() == library_ids(t), t


def test_token_files_round_trip(spark, tmp_path):
    docs = table(spark, TEXTS).union(table(spark, TEXTS).selectExpr("null", "'null id'", "n_spans", "h", "n_lines").limit(1))
    tokens.write_tokens(tokens.encode(tokens.sorted_docs(docs), WORD, 1), str(tmp_path / "t"), block=50, every=7)
    rows = tokens.read_tokens(spark, str(tmp_path / "t")).collect()
    rows.sort(key=lambda r: r["start"])
    want = [(None, [*library_ids("null id"), 1]), *((i, [*library_ids(t), 1]) for i, t in enumerate(TEXTS))]
    assert [(r["doc_id"], np.frombuffer(r["ids"], "<u2").tolist()) for r in rows] == want
    assert [r["start"] for r in rows] == np.cumsum([0, *(len(x) for _, x in want)])[:-1].tolist()
    digest = {r["doc_id"]: r for r in tokens.id_digests(tokens.read_tokens(spark, str(tmp_path / "t"))).collect()}
    assert digest[0]["ids_crc32"] == zlib.crc32(np.array(want[1][1], "<u4").tobytes()) and digest[0]["n_tokens"] == len(want[1][1])


def test_token_files_of_an_empty_table(spark, tmp_path):
    tokens.write_tokens(tokens.encode(tokens.sorted_docs(table(spark, ["x"]).where("false")), WORD, 1), str(tmp_path / "t"))
    assert tokens.read_tokens(spark, str(tmp_path / "t")).count() == 0


@pytest.mark.parametrize("limit", [4, 16])
def test_huffman_lengths_are_complete_and_limited(limit):
    counts = np.zeros(100, np.int64)
    counts[3:17] = [2**k if limit == 16 else k + 1 for k in range(14)]
    n = tokens.code_lengths(counts, limit)
    assert n.max() <= limit and (2.0 ** -n[n > 0].astype(float)).sum() == 1 and not n[:3].any()
    if limit == 16:
        assert sorted(n[n > 0].tolist(), reverse=True) == [13, *range(13, 0, -1)]
    codes = tokens.canonical_codes(n)
    ids = np.random.default_rng(1).choice(np.flatnonzero(counts), 1000)
    payload, bits, marks = tokens.pack(ids, n, codes, 64)
    assert bits == n[ids].sum() and tokens.unpack(payload, 1000, marks, 64, tokens.decode_table(n, codes, limit), limit).tolist() == ids.tolist()


def test_best_fit_and_its_bound():
    r = np.random.default_rng(5)
    for cap, sizes in ((10, [6, 6, 6, 4, 4, 4]), (10, [4] * 7), (100, r.integers(1, 100, 500).tolist()), (7, [7, 7])):
        sizes = np.array(sizes)
        b, o = packing.best_fit(sizes, cap)
        for k in range(b.max() + 1):
            rows = np.flatnonzero(b == k)
            rows = rows[np.argsort(o[rows])]
            assert o[rows].tolist() == np.cumsum([0, *sizes[rows]])[:-1].tolist() and sizes[rows].sum() <= cap
        low = packing.lower_bound(np.bincount(sizes, minlength=cap + 1), cap)
        assert low <= b.max() + 1 <= low * 1.3 + 1
    assert packing.lower_bound(np.bincount([4] * 7, minlength=11), 10) == 4 and packing.lower_bound(np.bincount([6] * 5, minlength=11), 10) == 5


def test_packing_covers_every_document(spark):
    docs = table(spark, TEXTS)
    rows = packing.pack_pieces(packing.pieces(docs, WORD, 64, 0), 64).collect()
    ids = {i: [*library_ids(t), 0] for i, t in enumerate(TEXTS)}
    bins = defaultdict(list)
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == 64 * r["piece"] and len(part) == r["length"] and zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sum(r["length"] for r in rows) == sum(map(len, ids.values()))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 64
    assert len(bins) <= -(-sum(map(len, ids.values())) // 64) + 1
    assert packing.pack_pieces(packing.pieces(docs.where("false"), WORD, 64, 0), 64).count() == 0


def test_repeated_long_rows_fill_sequences_of_their_own(spark):
    docs = spark.createDataFrame([(1, "word " * 300)] * 5 + [(2, None)] * 3, "doc_id long, text string").repartition(3)
    rows = packing.pack_pieces(packing.pieces(docs, WORD, 64, 0), 64).collect()
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sum(r["length"] == 64 for r in rows) >= 20
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == np.cumsum([0, *(n for _, n in b)])[:-1].tolist() and sum(n for _, n in b) <= 64


def test_blocks_that_meet_their_bound_keep_their_bins(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 100)
    items = spark.range(400).selectExpr("id as doc_id", "id as doc_key", "0 as piece", "0L as start", "6L as length", "0L as ids_crc32")
    rows = packing.pack_pieces(items, 10).collect()
    assert len({r["sequence_id"] for r in rows}) == 400
    # a round's numbers begin at its multiple of 2^60; one bin of each of the 4 blocks may meet others'
    assert sum(r["sequence_id"] < 1 << 60 for r in rows) >= 396


def test_language_model_learns_and_rejects(spark):
    words = {"aa": "foo bar baz qux", "bb": "zim zam zoom zut"}
    r = random.Random(1)
    make = lambda k: " ".join(r.choice(words[k].split()) for _ in range(30))
    texts = [make("aa" if i % 2 else "bb") for i in range(200)]
    m = langid.train(texts, ["aa" if i % 2 else "bb" for i in range(200)])
    docs = table(spark, [make("aa"), make("bb"), None, "", "123 !!", "中文"])
    got = {r["doc_id"]: r for r in langid.predict(docs, m).collect()}
    assert [got[i]["lang_pred"] for i in range(5)] == ["aa", "bb", "und", "und", "und"] and got[5]["lang_pred"] in ("aa", "bb")
    assert got[2]["rejected"] and got[4]["rejected"] and not got[0]["rejected"] and all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.predict(docs.where("false"), m).count() == 0
    assert {r["lang_pred"] for r in langid.predict(docs, langid.train([], [])).collect()} == {"und"}


def test_whole_ordinary_texts_enter_the_dictionary(monkeypatch):
    seen, make = [], toxicity.dictionary
    monkeypatch.setattr(toxicity, "dictionary", lambda samples, size: seen.append(b"".join(samples)) or make(samples, size))
    texts = [*(["fine words " * 900 + "the end", "\u00e9\u4e2d" * 400 + " tail"] * 5), *["bad blargh snorf"] * 10]
    toxicity.train(texts, [0] * 10 + [1] * 10)
    assert seen[1] == "".join(texts[:10]).encode()


def test_toxicity_finds_listed_words(spark):
    texts, y = [], []
    for i in range(300):
        t = prose(i + 100, 40).split()
        if i % 3 == 0:
            t[i % 40] = ["blargh", "snorf"][i % 2]
            t[(i + 7) % 40] = ["blargh", "snorf"][(i + 1) % 2]
        texts.append(" ".join(t))
        y.append(int(i % 3 == 0))
    m = toxicity.train(texts[:240], y[:240])
    d = table(spark, [*texts[240:], None, "", "  "])
    got = {r["doc_id"]: r["score"] for r in toxicity.score(d, m).collect()}
    right = sum((got[i] >= 0.7) == bool(y[240 + i]) for i in range(60))
    assert right >= 57 and all(0 <= s <= 1 for s in got.values()) and got[60] < 0.5 and got[61] == got[60]
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(d, toxicity.train([], [])).collect())


def test_toxic_sample_is_bounded_and_balanced(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, None if i == 3 else f"t{i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(150)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    texts, y = toxicity.fit_sample(docs, labels, langid.crc_mod("doc_id", 3) != 1, 40)
    assert len(texts) <= 40 and abs(sum(y) - 20) <= 1 and all(zlib.crc32(t[1:].encode()) % 3 != 1 and int(t[1:]) % 2 == v for t, v in zip(texts, y))
    assert toxicity.fit_sample(docs, labels.where(F.lit(False)), F.lit(True), 40) == ([], [])


def long_text(n=1_600_000):
    """Beyond one slice of any operator."""
    words = prose(77, 4000)
    return (words + " ") * (n // len(words) + 1)


def test_token_files_of_repeated_ids_and_a_very_long_text(spark, tmp_path):
    texts = [(5, "same id b"), (5, "same id a"), (5, "same id a"), (1, long_text()), (9, None)]
    d = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    tokens.write_tokens(tokens.encode(tokens.sorted_docs(d), WORD, 1), str(tmp_path / "t"))
    rows = sorted(tokens.read_tokens(spark, str(tmp_path / "t")).collect(), key=lambda r: r["start"])
    got = [(r["doc_id"], np.frombuffer(r["ids"], "<u2").tolist()) for r in rows]
    assert [i for i, _ in got] == [1, 5, 5, 5, 9] and got[0][1] == [*library_ids(texts[3][1]), 1]
    assert sorted(x for i, x in got if i == 5) == sorted([*library_ids(t), 1] for i, t in texts if i == 5)
    assert [r["start"] for r in rows] == np.cumsum([0, *(len(x) for _, x in got)])[:-1].tolist()


@pytest.mark.parametrize("parts", [1, 64, 211])
def test_the_bound_decides_in_many_partitions(spark, monkeypatch, parts):
    sizes = np.random.default_rng(3).integers(1, 2048, 20_000)
    monkeypatch.setattr(packing, "BLOCK", -(-len(sizes) // parts))
    items = spark.createDataFrame([(i, i, 0, 0, int(s), 0) for i, s in enumerate(sizes)], "doc_id long, doc_key long, piece int, start long, length long, ids_crc32 long")
    rows = packing.pack_pieces(items, 2048).collect()
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == np.cumsum([0, *(n for _, n in b)])[:-1].tolist() and sum(n for _, n in b) <= 2048
    assert sorted(r["doc_id"] for r in rows) == list(range(len(sizes)))
    bound = packing.lower_bound(np.bincount(sizes, minlength=2049), 2048)
    # blocks keep their bins by bounds of their own: small ones hold more large pieces by chance, by about the square root
    assert bound <= len(bins) <= (1 + 0.5 / (len(sizes) / parts) ** 0.5) * bound + parts + 1


def test_packing_of_a_very_long_text(spark):
    d = spark.createDataFrame([(1, long_text()), (1, long_text()), (2, "short")], "doc_id long, text string")
    rows = packing.pack_pieces(packing.pieces(d, WORD, 2048, 0), 2048).collect()
    ids = [*library_ids(long_text()), 0]
    crcs = sorted((k, zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 2048)))
    assert sorted((r["piece"], r["ids_crc32"]) for r in rows if r["doc_id"] == 1) == sorted(crcs * 2)
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)


def test_language_of_long_and_repeated_texts_with_clashing_columns(spark):
    m = langid.train(["foo bar baz", "zim zam zoom"] * 30, ["aa", "bb"] * 30)
    d = spark.createDataFrame([(1, "foo bar " * 200_000, 1, 2, 3), (2, "zim zam", 1, 2, 3), (2, "zim zam", 1, 2, 3)], "doc_id long, text string, lang_pred int, SCORE int, __has_letter int")
    got = langid.predict(d.drop("SCORE"), m)
    assert got.columns == ["doc_id", "text", "__has_letter", "lang_pred", "score", "rejected"]
    assert sorted((r["doc_id"], r["lang_pred"], r["__has_letter"]) for r in got.collect()) == [(1, "aa", 3), (2, "bb", 3), (2, "bb", 3)]
    assert langid.fit_sample(d.withColumn("lang", d.doc_id.cast("string")).where("false"), langid.crc_mod("doc_id", 5) >= 0, 10) == ([], [])


def test_toxicity_of_empty_tables_long_texts_and_repeated_labels(spark):
    texts, y = ["fine words in a row"] * 40 + ["bad blargh snorf here"] * 20, [0] * 40 + [1] * 20
    m = toxicity.train(texts, y)
    d = spark.createDataFrame([(1, "fine " * 300_000 + "blargh snorf", 7), (2, "fine words", 7), (2, "fine words", 7)], "doc_id long, text string, score int")
    got = toxicity.score(d, m)
    assert got.columns == ["doc_id", "text", "score"] and [r["doc_id"] for r in got.collect()].count(2) == 2 and all(0 <= r["score"] <= 1 for r in got.collect())
    assert toxicity.score(d.where("false"), m).count() == 0
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (2, 0)], "doc_id long, toxic int")
    assert sorted(toxicity.fit_sample(d, labels, langid.crc_mod("doc_id", 3) >= 0, 10)[1]) == [0, 1]  # a label of 1 outweighs one of 0; repeated texts count once
