"""The corpus pipeline: each stage against a plain version on a small table, and the whole run."""

import random
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline

from .test_jaccard import brute
from .test_text_ops import brute_lines, library_ids


def prose(r, words, n):
    return " ".join(r.choice(words) for _ in range(n))


def corpus():
    r = random.Random(7)
    en = "the cat sat on mat with hat and bat while rain fell over town square near river bank".split()
    de = "der hund lief schnell über die straße und sah einen großen baum neben dem haus".split()
    line = "This very line is found in many of the documents here, more than five."
    rows = []
    for i in range(60):
        words, lang = (en, "en") if i % 2 else (de, "de")
        text = prose(r, words, 80)
        rows.append((text + (f"\n{line}" if i % 4 == 0 else ""), lang))
    shared = prose(r, en, 100)  # over 400 bytes in two documents that are otherwise different
    rows += [(prose(r, en, 150) + " " + shared, "en"), (shared + " " + prose(r, en, 160), "en")]
    near = prose(r, en, 120).split()
    rows += [(" ".join(near), "en"), (" ".join([*near[:60], "changed", *near[61:]]), "en"), (" ".join(near), "en")]
    rows += [(None, "en"), ("", "de"), ("123 456 !!", None)]
    return [(i, t, lang, "src", len(t or "")) for i, (t, lang) in enumerate(rows)]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


def texts(d):
    return {r["doc_id"]: r["text"] for r in d.collect()}


def test_language_stage_keeps_clean_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.language(spark, docs, sf)
    assert out.columns == docs.columns and set(texts(out)) == set(range(65))


def test_line_stage(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    t = texts(docs)
    out = corpus_pipeline.line_dedup(spark, docs, sf)
    want = brute_lines([t[i] for i in range(len(t))])
    assert texts(out) == {i: w[2] for i, w in want.items()} and out.columns == docs.columns
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect())


def test_near_duplicate_stage_keeps_one_of_each(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    t = texts(docs)
    want = brute([t[i] for i in range(len(t))])
    assert texts(corpus_pipeline.near_duplicates(spark, docs, sf)) == {i: t[i] for i, (n, c) in want.items() if c == i}


def test_substring_stage(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    t = texts(docs)
    seen, raw = defaultdict(int), {i: (x or "").encode() for i, x in t.items()}
    for b in raw.values():
        for s in range(len(b) - 199):
            seen[b[s : s + 200]] += 1
    want = {}
    for i, b in raw.items():
        keep = np.ones(len(b), bool)
        for s in range(len(b) - 199):
            if seen[b[s : s + 200]] > 1:
                keep[s : s + 200] = False
        want[i] = np.frombuffer(b, np.uint8)[keep].tobytes().decode("utf-8", "ignore")
    out = corpus_pipeline.substring_dedup(spark, docs, sf)
    assert texts(out) == want and out.columns == docs.columns and want != {i: x or "" for i, x in t.items()}


def test_a_passage_of_51_words_is_cut_and_its_document_stays(spark, sf):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(3, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage = prose(51)
    rows = [(i, f"{prose(80)} {passage} {prose(70)}" if i < 4 else prose(150), "en", "s", 1) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = texts(corpus_pipeline.substring_dedup(spark, docs, sf))
    assert len(out) == 12 and all((passage not in out[i]) == (i < 4) for i in range(12) if i < 4) and all(out[i] == rows[i][1] for i in range(4, 12))


def test_run_packs_what_the_stages_kept(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
    kept = texts(docs)
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in rows} == set(kept) and 64 not in kept and 62 in kept
    n = {i: len(library_ids(t)) + 1 for i, t in kept.items()}
    got = defaultdict(int)
    for r in rows:
        got[r["doc_id"]] += r["length"]
    assert dict(got) == n


def test_empty_documents(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/documents.parquet").where("false").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_repeated_rows_long_texts_near_copies_and_clashing_columns(spark, tmp_path):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(3, 7)))
    prose_ = lambda n: " ".join(word() for _ in range(n))
    near = prose_(150).split()
    long = prose_(260_000)
    rows = [(i, prose_(90), "en", "s", 1, 5) for i in range(30)]
    rows += [(40, " ".join(near), "en", "s", 1, 5), (41, " ".join([*near[:70], "xyzzy", *near[71:]]), "en", "s", 1, 5)]
    rows += [(50, long, "en", "s", 1, 5), (51, "repeated row " + rows[0][1][:40], "en", "s", 1, 5), (51, "repeated row " + rows[0][1][:40], "en", "s", 1, 5)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __r1 int")
    d.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x["doc_id"] for x in got} == {*range(30), 40, 50, 51}
    assert sum(x["length"] for x in got if x["doc_id"] == 50) == len(library_ids(long)) + 1
    assert sum(x["doc_id"] == 51 for x in got) == 1
