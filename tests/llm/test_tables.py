"""The registered queries on the generated tables: brute force, round trips, recall and held-out accuracy."""

import hashlib
import os
import zlib
from collections import defaultdict

import numpy as np
import pytest

from gridflow.llm import packing, queries

ROOT = os.environ.get("GRIDFLOW_TESTDATA", "/root/testdata")
pytestmark = pytest.mark.skipif(not os.path.isdir(f"{ROOT}/sf0.001"), reason="no test tables")
TINY, SMALL = f"{ROOT}/sf0.001", f"{ROOT}/sf0.01"


def table(spark, sf, name, *cols):
    return {r[0]: r[1] for r in spark.read.parquet(f"{sf}/{name}.parquet").select(*cols).collect()}


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    tok = tokenizers.Tokenizer.from_file(queries.tokenizer())
    return lambda t: tok.encode(t or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op1_is_brute_force(spark):
    raw = {i: (t or "").encode() for i, t in table(spark, TINY, "documents", "doc_id", "text").items()}
    seen = defaultdict(int)
    keys = {i: [hashlib.blake2b(b[s : s + 400], digest_size=12).digest() for s in range(len(b) - 399)] for i, b in raw.items()}
    for ks in keys.values():
        for k in ks:
            seen[k] += 1
    got = {r["doc_id"]: r for r in queries.op1_suffix_dedup(spark, TINY).collect()}
    assert set(got) == set(raw)
    for i, b in raw.items():
        gone = np.zeros(len(b), bool)
        for s, k in enumerate(keys[i]):
            if seen[k] > 1:
                gone[s : s + 400] = True
        n = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (len(b), int(gone.sum()), n, hashlib.sha256(kept).hexdigest())


def test_op3_is_the_library(spark, library):
    at = 0
    got = {r["doc_id"]: r for r in queries.op3_token_ids(spark, TINY).collect()}
    for i, t in sorted(table(spark, TINY, "documents", "doc_id", "text").items()):
        ids = [*library(t), 1]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), crc(ids))
        at += len(ids)


def test_op5_round_trips(spark):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=queries.tokenizer("piece_bpe_32k.model"))
    got = {r["doc_id"]: r for r in queries.op5_sentencepiece(spark, TINY).collect()}
    for i, t in table(spark, TINY, "documents", "doc_id", "text").items():
        ids = sp.encode(t or "")
        assert (got[i]["n_tokens"], got[i]["ids_crc32"], got[i]["decoded_sha256"]) == (len(ids), crc(ids), hashlib.sha256(sp.decode(ids).encode()).hexdigest())


def test_op6_held_out(spark):
    toxic = table(spark, SMALL, "labels", "doc_id", "toxic")
    rows = [r for r in queries.op6_toxicity(spark, SMALL).collect()]
    assert len(rows) == len(table(spark, SMALL, "documents", "doc_id", "text"))
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    kept = [(r["predicted"], toxic[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in toxic]
    assert sum(p == y for p, y in kept) >= 0.93 * len(kept)


def test_op7_fills_sequences(spark, library):
    rows = queries.op7_packing(spark, SMALL).collect()
    bins, own = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        own[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == np.cumsum([0, *(n for _, n in b)])[:-1].tolist() and b[-1][0] + b[-1][1] <= 2048
    texts = table(spark, SMALL, "documents", "doc_id", "text")
    assert set(own) == set(texts)
    for i in texts:
        ids = [*library(texts[i]), 0]
        assert sorted(own[i]) == [(k, s, len(ids[s : s + 2048]), crc(ids[s : s + 2048])) for k, s in enumerate(range(0, len(ids), 2048))]
    bound = packing.lower_bound(np.bincount([r["length"] for r in rows], minlength=2049), 2048)
    assert bound <= len(bins) <= 1.02 * bound + 2


def test_op8_held_out(spark):
    lang = table(spark, SMALL, "documents", "doc_id", "lang")
    rows = queries.op8_language_id(spark, SMALL).collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
    kept = [r for r in rows if r["held_out"] and lang[r["doc_id"]]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in kept) >= 0.97 * len(kept)
    assert sum(r["rejected"] for r in rows if r["lang_pred"] != "und") <= 0.01 * len(rows)


def test_op10_recall(spark):
    v = {i: np.array(x, float) for i, x in table(spark, SMALL, "embeddings", "vec_id", "embedding").items() if x is not None}
    ids = np.array(sorted(v))
    x = np.stack([v[i] for i in ids])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = defaultdict(dict)
    for r in queries.op10_nearest(spark, SMALL).collect():
        got[r["query_id"]][r["vec_id"]] = r["score"]
    hits = total = 0
    for k in np.flatnonzero(ids % 50 == 0):
        s = x @ x[k]
        s[k] = -2
        best = ids[np.argsort(-s, kind="stable")[:5]]
        hits, total = hits + len(set(best.tolist()) & set(got[int(ids[k])])), total + 5
        for i, score in got[int(ids[k])].items():
            assert abs(score - s[np.searchsorted(ids, i)]) < 1e-12
    assert hits >= 0.9 * total
