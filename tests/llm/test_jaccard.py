"""The Jaccard join against brute force."""

import random

import numpy as np
import pytest

from gridflow.llm import common, jaccard


def table(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, node string, n int, component int").repartition(3)


def sets(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(texts):
    s = [sets(t) for t in texts]
    c = list(range(len(texts)))
    root = lambda i: i if c[i] == i else root(c[i])
    for i in range(len(s)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]):
                a, b = sorted((root(i), root(j)))
                c[b] = a
    return {i: (len(x), root(i)) for i, x in enumerate(s)}


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 4)))
    line = " ".join(word() for _ in range(12))
    out = []
    for _ in range(12):
        base = [word() for _ in range(r.choice([6, 30, 80, 200]))]
        for _ in range(r.choice([1, 3, 9])):
            t = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 4])):
                t[r.randrange(len(t))] = word()
            out.append((line + "\n" if r.random() < 0.4 else "") + r.choice([" ", "  ", "\t"]).join(t))
    return [*out, None, "", " \n", "One two", "one  TWO", "one two three", "É a", "é a", "rep " * 500, "rep " * 7, out[0].upper()]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_are_brute_force(spark, seed):
    texts = corpus(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.with_components(table(spark, texts)).collect()}
    assert got == brute(texts)


def test_ties_nulls_and_repeats(spark):
    t = "a b c d e f g h"
    d = spark.createDataFrame([(5, t), (5, t), (None, t), (3, "A b c d e f g h"), (None, "z"), (9, None)], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in jaccard.with_components(d).collect())
    assert got == [("3", 4, 3), ("5", 4, 3), ("5", 4, 3), ("9", 0, 9), ("None", 1, None), ("None", 4, 3)]
    assert jaccard.with_components(d.where("false")).count() == 0
    assert sorted(str(r["doc_id"]) for r in jaccard.one_of_each(d).collect()) == ["3", "9", "None", "None"]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200, 200), (None, 3), (7, 5)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long"), common.Tables(spark, "t")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}


def test_prefix_length():
    n = np.arange(1, 50)
    assert (jaccard.prefix_length(n, 80) == [k - int(np.ceil(0.8 * k - 1e-9)) + 1 for k in n]).all()


def test_suffix_filter_bounds_the_difference_from_below():
    r = np.random.default_rng(4)
    for _ in range(300):
        x, y = (np.unique(r.integers(0, 60, r.integers(0, 40)).astype(np.uint64)) for _ in range(2))
        true = len(np.setxor1d(x, y))
        for most in (0, 3, 10, 100):
            bound = jaccard.suffix_difference(x, y, most)
            assert bound <= true
        assert jaccard.suffix_difference(x, y, 10**6, 30) == true


def test_sets_of_one_node_are_told_apart(spark, monkeypatch):
    texts = corpus(1)
    make = jaccard.set_hashes

    def clashing(h, text, rows):
        n, node, more = make(h, text, rows)
        return n, np.where(n > 0, node % np.uint64(5) + np.uint64(1), node), more

    monkeypatch.setattr(jaccard, "set_hashes", clashing)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.with_components(table(spark, texts)).collect()}
    assert got == brute(texts)


def test_very_long_texts_clashing_columns_and_exact_copies(spark):
    long = " ".join(f"w{i % 9973}x{i % 31}" for i in range(150_000))  # over a slice of 1 MiB
    d = spark.createDataFrame([(i, long if i < 3 else f"{long} tail {i}", 1, 2) for i in range(5)], "doc_id long, text string, __r1 int, R2 int")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.with_components(d).collect()}
    assert got == dict.fromkeys(range(5), 0)
    one = jaccard.one_of_each(d)
    assert one.columns == d.columns and [r["doc_id"] for r in one.collect()] == [0]


def test_parity_bitmaps_bound_the_difference(spark):
    r = np.random.default_rng(9)
    rows = []
    for n in (1, 300, 1100, 4000, 70_000):
        x = r.integers(0, 2**63, n, dtype=np.uint64)
        for share in (0.0, 0.05, 0.3, 1.0):
            y = np.concatenate([x[: n - int(share * n)], r.integers(0, 2**63, int(share * n * 1.1), dtype=np.uint64)])
            one, two = np.unique(x), np.unique(y)
            h, text = np.concatenate([one, two]), np.repeat([0, 1], [len(one), len(two)])
            bits, brief = jaccard.parity(h, text, np.array([len(one), len(two)]))
            same = len(np.intersect1d(one, two))
            both = brief.to_pylist()
            assert sum((a ^ b).bit_count() if a ^ b >= 0 else 64 - (~(a ^ b)).bit_count() for a, b in zip(*both)) <= len(np.setxor1d(one, two))
            rows.append((bits[0].as_py(), bits[1].as_py(), len(one), len(two), 100 * same >= 80 * (len(one) + len(two) - same), share))
    d = spark.createDataFrame(rows, "x array<long>, y array<long>, n int, m int, links boolean, share double")
    got = d.select("links", "share", "n", jaccard._few_differences("x", "y", "n", "m", 80).alias("may")).collect()
    assert all(g["may"] for g in got if g["links"]) and not any(g["may"] for g in got if g["share"] == 1.0)


def prefix_rows(spark, found):
    """The prefixes of sets of numbers, in the order of the numbers, as ``_meet`` takes them, each set a component of its own."""
    rows = []
    for node, x in enumerate(found):
        h = common.mix(np.array(sorted(x), np.uint64))
        brief = jaccard.parity(np.sort(h), np.zeros(len(h), np.int64), np.array([len(h)]))[1][0].as_py()
        rows += [(int(t), node, len(x), i, node, *brief) for i, t in enumerate(sorted(x)[: int(jaccard.prefix_length(np.array([len(x)]), 80)[0])])]
    return spark.createDataFrame(rows, "token long, node long, n int, pos int, c long, b0 long, b1 long, b2 long, b3 long")


def test_sets_that_share_late_ngrams_only_do_not_meet(spark):
    # 120 n-grams of their own stand before 680 common ones: 680 of 920 are no link, and brief bitmaps are too full to tell
    found = [{*range(1000 * k, 1000 * k + 120), *range(10**6, 10**6 + 680)} for k in range(40)]
    assert jaccard._meet(prefix_rows(spark, found), 80).count() == 0


def test_linked_sets_meet_at_the_first_ngram_they_share(spark):
    r, found = random.Random(6), []
    for n in (1, 2, 5, 9, 10, 45, 90, 180, 700):
        base = r.sample(range(10**6), n)
        for _ in range(12):
            gone, more = r.randint(0, max(1, n // 6)), r.randint(0, max(1, n // 6))
            found.append({*r.sample(base, max(1, n - gone)), *r.sample(range(10**6), more)})
    found = [set(x) for x in {tuple(sorted(x)) for x in found}]
    links = {(i, j) for j in range(len(found)) for i in range(j) if 100 * len(found[i] & found[j]) >= 80 * len(found[i] | found[j])}
    edge = sum(100 * len(found[i] & found[j]) == 80 * len(found[i] | found[j]) for i, j in links)
    got = {tuple(sorted(x)) for x in jaccard._meet(prefix_rows(spark, found), 80).collect()}
    assert edge and len(links) > 100 and links <= got
