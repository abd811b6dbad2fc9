"""N-gram Jaccard join: prefix filtering with rare n-grams first, and the components of its links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LETTER, U64, Tables, as_long, batch_of, components, give_back, identity, mix, prefix_hashes, slices, spare, span_hash, utf8

#: The counts that order n-grams by rarity: a fixed table of 2**SKETCH_BITS cells, whatever the input.
SKETCH_BITS = 20
SKETCH_CHUNK = 1 << 15
#: Least words of 64 bits of a set's parity bitmap, where each n-gram flips one bit, so that two sets differ in no fewer
#: n-grams than bits; larger sets have as many bits as n-grams or more. BRIEF words are a bitmap folded for a first look.
WORDS, BRIEF = 16, 4
#: How often the suffix filter halves two sets, and how many sets a task remembers whose prefixes it has already given.
SUFFIX_DEPTH, REMEMBERED = 6, 1 << 20
ROW = ["r1", "r2"]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each word of the texts: runs of bytes other than ASCII spaces, A-Z lower-cased."""
    low = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    inside = ~((low == 32) | ((low >= 9) & (low <= 13)))
    start, stop = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    stop[:-1] &= ~inside[1:]
    # words end with their text
    bounds = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    start[bounds] |= inside[bounds]
    stop[bounds - 1] |= inside[bounds - 1]
    lo, hi = np.flatnonzero(start), np.flatnonzero(stop) + 1
    P = prefix_hashes(LETTER[low])
    return mix(span_hash(P, lo, hi) + (hi - lo).astype(np.uint64)), np.searchsorted(offsets, lo, "right") - 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each text's distinct shingles of ``size`` words, sorted; a text of fewer words has the whole sequence."""
    word, text = word_hashes(data, offsets)
    if not len(word):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    out, owner = [], []
    if len(word) >= size:
        n = len(word) - size + 1
        h = np.zeros(n, np.uint64)
        for k in range(size):
            h = mix(h + word[k : k + n])
        same = text[:n] == text[size - 1 :]
        out.append(h[same])
        owner.append(text[:n][same])
    count = np.bincount(text, minlength=len(offsets) - 1)
    first = np.concatenate([[0], np.cumsum(count)])
    for i in np.flatnonzero((count > 0) & (count < size)):
        h = np.array([count[i]], np.uint64)
        for w in word[first[i] : first[i + 1]]:
            h = mix(h + w)
        out.append(h ^ U64(0x5851F42D4C957F2D))
        owner.append(np.array([i]))
    h, t = np.concatenate(out), np.concatenate(owner)
    order = np.lexsort((h, t))
    h, t = h[order], t[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (t[1:] != t[:-1])])
    return t[new], h[new]


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    """Sets of n n-grams that reach the similarity share one among the first so many of either."""
    return n - -(-n * percent // 100) + 1


SETS = pa.schema([("r1", pa.int64()), ("r2", pa.int64()), ("id", pa.int64()), ("n", pa.int32()), ("node", pa.int64()), ("more", pa.int64()), ("bits", pa.list_(pa.int64())), ("brief", pa.list_(pa.int64())), ("chunk", pa.int32()), ("counts", pa.binary())])
_SETS = "r1 long, r2 long, id long, n int, node long, more long, bits array<long>, brief array<long>, chunk int, counts binary"


def set_hashes(h: np.ndarray, text: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, node, more): how many n-grams each text has and 128 bits of hash of their set; zeros without any."""
    n = np.bincount(text, minlength=rows)
    node, more = np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
    if len(h):
        at = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        t = text[at]
        node[t] = mix(np.add.reduceat(mix(h), at) ^ mix(np.bitwise_xor.reduceat(mix(h ^ U64(0x2545F4914F6CDD1D)), at) + n[t].astype(np.uint64)))
        more[t] = mix(np.add.reduceat(mix(h ^ U64(0x9FB21C651E98DF25)), at) ^ mix(np.bitwise_xor.reduceat(mix(h ^ U64(0xD6E8FEB86659FD93)), at)))
    return n, node, more


def parity(h: np.ndarray, text: np.ndarray, n: np.ndarray) -> tuple[pa.ListArray, pa.ListArray]:
    """Parity bitmaps of each text's set, of a power of two of words with room for its n-grams, and folded to BRIEF words."""
    words = np.full(len(n), WORDS, np.int64)
    while (small := words * 64 < n).any():
        words[small] *= 2
    at = np.concatenate([[0], np.cumsum(words)])
    place = at[text] * 64 + (h.astype(np.int64) & (words[text] * 64 - 1))
    bits = np.packbits((np.bincount(place, minlength=int(at[-1]) * 64) & 1).astype(np.uint8), bitorder="little").view(np.int64)
    # words come in whole runs of BRIEF: a fold is the exclusive or of all runs
    brief = np.bitwise_xor.reduceat(bits.reshape(-1, BRIEF), at[:-1] // BRIEF, axis=0).ravel() if len(n) else bits
    lists = lambda x, offsets: pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(x))
    return lists(bits, at), lists(brief, np.arange(len(n) + 1) * BRIEF)


def renamed(node: np.ndarray, more: np.ndarray, clashes: dict[tuple[int, int], int]) -> np.ndarray:
    """``node``, but for sets that share it with another one: those get a number of their own."""
    if clashes:
        node = node.copy()
        for i, k in enumerate(zip(as_long(node).tolist(), as_long(more).tolist(), strict=True)):
            if k in clashes:
                node[i] = np.int64(clashes[k]).view(np.uint64)
    return node


def _describe(size: int):
    """Each row's set size, two hashes of its set, and its parity bitmap; at the end the partition's sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        sketch = np.zeros(1 << SKETCH_BITS, np.int64)
        for b in slices(batches, "text"):
            data, o = utf8(b.column(3))
            text, h = shingle_sets(data, o, size)
            np.add.at(sketch, (h >> U64(64 - SKETCH_BITS)).astype(np.int64), 1)
            n, node, more = set_hashes(h, text, b.num_rows)
            bits, brief = parity(h, text, n)
            yield batch_of(SETS, b.column(0), b.column(1), b.column(2), n.astype(np.int32), pa.array(as_long(node), mask=n == 0), as_long(more), bits, brief, pa.nulls(b.num_rows, pa.int32()), pa.nulls(b.num_rows, pa.binary()))
        for k in range(0, len(sketch), SKETCH_CHUNK):
            part = sketch[k : k + SKETCH_CHUNK]
            if part.any():
                none = [None]
                yield batch_of(SETS, none, none, none, none, none, none, none, none, [k // SKETCH_CHUNK], [zstandard.ZstdCompressor(level=1).compress(part.astype("<i8").tobytes())])

    return run


def _sketch(info: DataFrame) -> np.ndarray:
    """Counts of n-grams by the first bits of their hash, of the whole table; at most 2**SKETCH_BITS numbers reach the driver."""
    import zstandard

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand, now, total = zstandard.ZstdDecompressor(), None, np.zeros(0)
        schema = pa.schema([("chunk", pa.int32()), ("counts", pa.binary())])
        made = lambda: batch_of(schema, [now], [zstandard.ZstdCompressor(level=1).compress(total.tobytes())])
        for b in batches:
            for chunk, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                c = np.frombuffer(expand.decompress(c), "<i8")
                if chunk != now:
                    if now is not None:
                        yield made()
                    now, total = chunk, c
                else:
                    total = total + c
        if now is not None:
            yield made()

    rows = info.where("chunk is not null").select("chunk", "counts").repartition("chunk").sortWithinPartitions("chunk").mapInArrow(merge, "chunk int, counts binary").collect()
    out = np.zeros(1 << SKETCH_BITS, np.int64)
    for r in rows:
        c = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(r["counts"])), "<i8")
        out[r["chunk"] * SKETCH_CHUNK : r["chunk"] * SKETCH_CHUNK + len(c)] = c
    return out


TOKEN = pa.schema([("token", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])


def _prefixes(size: int, percent: int, sketch, clashes: dict[tuple[int, int], int]):
    """(token, node, n, pos): the first n-grams of each set in the order of rarity, once for all copies that a task meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.frombuffer(sketch.value, "<u4")
        given: set[int] = set()
        for b in slices(batches, "text"):
            data, o = utf8(b.column(0))
            text, h = shingle_sets(data, o, size)
            if not len(h):
                continue
            n, node, more = set_hashes(h, text, b.num_rows)
            node = renamed(node, more, clashes)
            first = np.zeros(b.num_rows, bool)
            if len(given) > REMEMBERED:
                given.clear()
            for i, x in enumerate(node.tolist()):
                if n[i] and x not in given:
                    given.add(x)
                    first[i] = True
            own = first[text]
            text, h = text[own], h[own]
            if not len(h):
                continue
            at = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
            rarity = count[(h >> U64(64 - SKETCH_BITS)).astype(np.int64)]
            order = np.lexsort((h, rarity, text))
            pos = np.arange(len(h)) - np.repeat(at, n[text[at]])
            keep = pos < prefix_length(n, percent)[text]
            pick = order[keep]
            yield batch_of(TOKEN, as_long(h[pick]), as_long(node[text[keep]]), n[text[keep]].astype(np.int32), pos[keep].astype(np.int32))

    return run


SHARED = pa.schema([*TOKEN, ("hub", pa.int64()), ("hub_n", pa.int32()), ("hub_pos", pa.int32())])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by token, place and node: those of tokens of several nodes, with the token's first node as its hub.

    The set in which the n-gram stands first has the fewest rarer n-grams: of a
    group of near copies it is the one that the others were made from.

    Only one row of the group at hand is kept between batches.
    """
    carry: tuple | None = None
    for b in batches:
        if not b.num_rows:
            continue
        t, v, n, p = (c.to_numpy() for c in b.columns)
        sent = np.zeros(len(t), bool)
        if carry is not None:
            t, v, n, p = (np.concatenate([[x], y]) for x, y in zip(carry[:4], (t, v, n, p), strict=True))
            sent = np.concatenate([[carry[4]], sent])
        # copies have equal places, so that they stand together
        keep = np.concatenate([[True], (t[1:] != t[:-1]) | (v[1:] != v[:-1])])
        t, v, n, p, sent = t[keep], v[keep], n[keep], p[keep], sent[keep]
        first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        size = np.diff(np.concatenate([first, [len(t)]]))
        hub = np.repeat(first, size)
        several = np.repeat(size > 1, size) & ~sent
        if several.any():
            i, j = np.flatnonzero(several), hub[several]
            yield batch_of(SHARED, t[i], v[i], n[i].astype(np.int32), p[i].astype(np.int32), v[j], n[j].astype(np.int32), p[j].astype(np.int32))
        k = first[-1]
        carry = (t[k], v[k], n[k], p[k], bool(size[-1] > 1 or sent[k]))


def _can_link(n: str, m: str, p: str, q: str, percent: int):
    """Length filter, and the positional filter: before a shared n-gram at places p and q at most the smaller place can be shared, and after it what the shorter rest holds."""
    n_, m_, p_, q_ = (F.col(x) for x in (n, m, p, q))
    most = F.least(p_, q_) + 1 + F.least(n_ - 1 - p_, m_ - 1 - q_)
    return (100 * F.least(n_, m_) >= percent * F.greatest(n_, m_)) & ((100 + percent) * most >= percent * (n_ + m_))


def _can_open(n: str, m: str, p: str, q: str, percent: int):
    """Positional filter of the first shared n-gram, at places p and q: none before it is shared, so that either set must hold enough from it on.

    Linked sets pass at the first n-gram that they share, so they may be ruled
    out at all others. What it asks for is more than the length filter does.
    """
    n_, m_, p_, q_ = (F.col(x) for x in (n, m, p, q))
    return (100 + percent) * F.least(n_ - p_, m_ - q_) >= percent * (n_ + m_)


def _enough(differ, n: str, m: str, percent: int):
    """Whether sets that differ in ``differ`` n-grams or more can reach the share."""
    total = F.col(n) + F.col(m)
    return (100 + percent) * (total - differ) >= 2 * percent * total


def _few_differences(x: str, y: str, n: str, m: str, percent: int):
    """Bits that differ in the parity bitmaps of whole sets bound the overlap from above.

    Sets whose sizes pass the length filter have as many words or twice as
    many; the larger bitmap folds to the size of the smaller.
    """
    size = F.least(F.size(x), F.size(y))

    def fold(c: str):
        half = F.zip_with(F.slice(F.col(c), F.lit(1), size), F.slice(F.col(c), size + 1, size), lambda a, b: a.bitwiseXOR(b))
        return F.when(F.size(c) > size, half).otherwise(F.col(c))

    differ = F.aggregate(F.zip_with(fold(x), fold(y), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, b: a + b)
    return _enough(differ, n, m, percent)


def suffix_difference(x: np.ndarray, y: np.ndarray, most: int, depth: int = SUFFIX_DEPTH) -> int:
    """The suffix filter: a bound from below on how many elements are in only one of two sorted sets.

    The middle element of the one splits both; what the halves differ in by
    their sizes can't be shared. Halves are split again, ``depth`` times, until
    the bound passes ``most``.
    """
    if not depth or not len(x) or not len(y):
        return abs(len(x) - len(y))
    m = len(x) >> 1
    j = int(np.searchsorted(y, x[m]))
    hit = j < len(y) and y[j] == x[m]
    right = (x[m + 1 :], y[j + hit :])
    out, rest = 1 - hit, abs(len(right[0]) - len(right[1]))
    if out + rest + abs(m - j) > most:
        return out + rest + abs(m - j)
    out += suffix_difference(x[:m], y[:j], most - out - rest, depth - 1)
    return out + rest if out + rest > most else out + suffix_difference(*right, most - out, depth - 1)


def _meet(at: DataFrame, percent: int) -> DataFrame:
    """(a, b) for each n-gram that may be the first one shared by sets of different components, a being the smaller set or that of the smaller node.

    ``at`` has (token, node, n, pos, c) and the brief bitmaps of n-grams in
    prefixes. The first shared n-gram lies in the first ninth or so of the
    smaller set (at a share of 80 %), so that only such rows meet the others of
    their n-gram: sets that share a passage which is common, and so comes late
    in all of them, don't meet by it.
    """
    small = at.where(_can_open("n", "n", "pos", "pos", percent)).withColumnRenamed("node", "a")
    large = at.select("token", F.col("node").alias("b"), F.col("n").alias("m"), F.col("pos").alias("q"), F.col("c").alias("d"), *[F.col(f"b{i}").alias(f"d{i}") for i in range(BRIEF)])
    differ = sum((F.bit_count(F.col(f"b{i}").bitwiseXOR(F.col(f"d{i}"))) for i in range(1, BRIEF)), F.bit_count(F.col("b0").bitwiseXOR(F.col("d0"))))
    larger = (F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("a") < F.col("b")))
    return small.join(large, "token").where((F.col("c") != F.col("d")) & larger & _can_open("n", "m", "pos", "q", percent) & _enough(differ, "n", "m", percent)).select("a", "b")


LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _verify(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, np.zeros(0, np.uint64)

        def of(text: str) -> np.ndarray:
            x = np.frombuffer((text or "").encode(), np.uint8)
            return shingle_sets(x, np.array([0, len(x)]), size)[1]

        for b in batches:
            a, c = [], []
            for x, y, s, t in zip(*(k.to_pylist() for k in b.columns), strict=True):
                if x != last:
                    last, kept = x, of(s)
                other = of(t)
                # sets that reach the share differ in so many elements at the most
                total = len(kept) + len(other)
                most = total - 2 * -(-total * percent // (100 + percent))
                if suffix_difference(kept, other, most) > most:
                    continue
                both = len(np.intersect1d(kept, other, assume_unique=True))
                if 100 * both >= percent * (len(kept) + len(other) - both):
                    a.append(x)
                    c.append(y)
            yield batch_of(LINK, a, c)
            give_back()

    return run


def similar(docs: DataFrame, tables: Tables, percent: int = 80, size: int = 5, text_col: str = "text", id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(members, links) of the join of all pairs whose shingle sets have Jaccard similarity of ``percent`` or more.

    members: (r1, r2, id, n, node) for each row, ``node`` standing for its set
    (null if empty); rows of one node have the same set, compared by 128 bits
    of hash. links: (a, b) between nodes, enough of them that nodes in one
    component are those which links of all pairs would connect.

    N-grams are ordered by a fixed-size table of counts, rare ones first. Two
    sets that reach the threshold share an n-gram of their prefixes. Each
    n-gram's nodes are first compared with one hub, which joins groups of near
    copies by as many pairs as members; then nodes of the n-gram that are still
    in different components are compared with each other, where it may be the
    first one that they share. Lengths, places in the prefix and parity bitmaps
    rule pairs out before the texts of each remaining pair meet, once; the suffix filter then rules out more before
    their sets are intersected.
    """
    spark: SparkSession = docs.sparkSession
    base = docs.select(*(x.alias(n) for x, n in zip(identity(id_col, text_col), ROW, strict=True)), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    info = tables.keep(base.mapInArrow(_describe(size), _SETS))
    sets = info.where("node is not null")
    # two sets of one node by chance: all but one get other numbers; among 10^10 sets some three are expected, so the list stays short
    double = sets.groupBy("node").agg(F.min("more").alias("m0"), F.max("more").alias("m1")).where("m0 != m1")
    clashes = {(r["node"], r["more"]): r["name"] for r in sets.join(double, "node").where("more != m0").select("node", "more", F.xxhash64("node", "more").alias("name")).distinct().collect()}
    if clashes:
        name = F.lit(None).cast("long")
        for (node, more), new in clashes.items():
            name = F.when((F.col("node") == node) & (F.col("more") == more), F.lit(new)).otherwise(name)
        sets = sets.withColumn("node", F.coalesce(name, "node"))
    members = info.where("chunk is null and node is null").select(*ROW, "id", "n", "node").unionByName(sets.select(*ROW, "id", "n", "node"))
    sketch = spark.sparkContext.broadcast(np.minimum(_sketch(info), 2**32 - 1).astype("<u4").tobytes())
    tokens = base.select("text").mapInArrow(_prefixes(size, percent, sketch, clashes), "token long, node long, n int, pos int")
    shared = tables.keep(tokens.repartition("token").sortWithinPartitions("token", "pos", "node").mapInArrow(_stars, "token long, node long, n int, pos int, hub long, hub_n int, hub_pos int"))

    wanted = tables.keep(shared.select("node").distinct().join(sets.groupBy("node").agg(*(F.first(x).alias(x) for x in ("r1", "r2", "n")), *(F.first(x).alias(x) for x in ("bits", "brief"))), "node"))
    # keys alone are a small table, so that whole texts needn't move to meet them unless there are very many
    places = tables.keep(wanted.select("node", *ROW))
    texts = tables.keep(base.select(*ROW, "text").join(places, ROW).select("node", "text"))

    def verify(pairs: DataFrame) -> DataFrame:
        left = wanted.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bits").alias("pa"))
        right = wanted.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("pb"))
        fit = tables.keep(pairs.join(left, "a").join(right, "b").where(_few_differences("pa", "pb", "na", "nb", percent)).select("a", "b"))
        # only texts of pairs that are left move; a repeated row would give its node's text twice
        at = lambda end: texts.join(fit.select(F.col(end).alias("node")).distinct(), "node", "left_semi").dropDuplicates(["node"])
        full = fit.join(at("b").select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").join(at("a").select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
        out = tables.keep(full.select("a", "b", "ta", "tb").mapInArrow(_verify(size, percent), "a long, b long"))
        tables.drop(fit)
        return out

    star = tables.keep(shared.where((F.col("node") != F.col("hub")) & _can_link("n", "hub_n", "pos", "hub_pos", percent)).select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct())
    first = verify(star)
    known = components(first, tables)
    at = shared.select("token", "node", "n", "pos").join(known, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
    # an n-gram that can't be the first one shared by its sets has nothing to find
    open_ = at.groupBy("token").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.bool_or(_can_open("n", "n", "pos", "pos", percent)).alias("opens")).where("c0 != c1 and opens").select("token")
    at = tables.keep(at.join(open_, "token").join(wanted.select("node", *[F.col("brief")[i].alias(f"b{i}") for i in range(BRIEF)]), "node"))
    tables.drop(shared)
    pairs = _meet(at, percent).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = pairs.join(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    links = first.union(verify(pairs))
    tables.drop(texts, at, star, wanted, places)
    return members, links


def with_components(docs: DataFrame, percent: int = 80, size: int = 5, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(r1, r2, doc_id, n_shingles, component_id) for each row of ``docs``.

    r1 and r2 are 128 bits of hash of id and text. component_id is the smallest
    id reachable by links, the row's own included; null ids are passed over, so
    it is null only where all ids of a component are. Null, empty and blank
    texts have no shingle and no link. Repeated rows have the same set, so they
    link.
    """
    tables = Tables(docs.sparkSession, "jaccard")
    members, links = similar(docs, tables, percent, size, text_col, id_col)
    groups = components(links, tables)
    least = members.where("node is not null").groupBy("node").agg(F.min("id").alias("least"))
    joined = tables.keep(least.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node")))
    of = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = joined.join(of, "component").select("node", "component_id")
    out = members.join(ids, "node", "left")
    return out.select(*ROW, F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, percent: int = 80, size: int = 5, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` without rows whose component holds a smaller id; rows without shingles or ids stay.

    Of rows that share id and text one stays; other rows of one id are one
    document and stay or go together.
    """
    d = with_components(docs, percent, size, text_col, id_col)
    rows = [spare(docs.columns, f"__{n}") for n in ROW]
    mine = d.where(F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))).select(*(F.col(o).alias(n) for o, n in zip(ROW, rows, strict=True))).distinct()
    kept = docs.select("*", *(x.alias(n) for x, n in zip(identity(id_col, text_col), rows, strict=True))).join(mine, rows, "left_semi")
    # by the key of the join just made, which needs no shuffle of its own
    return kept.dropDuplicates(rows).drop(*rows)
