"""Vector search: exact top-k by a bit-sliced index, approximate neighbours by a permutation index."""

from __future__ import annotations

import decimal
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_of

#: Rows of an indexed block at the most, but for chance; queries that one copy of a block's index serves.
BLOCK_ROWS, BLOCK_QUERIES = 16_384, 200_000
#: Components of integer vectors are held to this size either way, so that a score has at most 38 digits.
LARGEST = 1 << 59


def usable(vectors: DataFrame, vec_col: str, id_col: str, nonzero: bool) -> DataFrame:
    """(id, v): rows with an id and a vector without null or non-finite components, as doubles."""
    v = F.col("v")
    fine = F.col("id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: F.coalesce((~F.isnan(x)) & (F.abs(x) < float("inf")), F.lit(False)))
    if nonzero:
        fine = fine & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(fine)


Search = Callable[[np.ndarray, np.ndarray], Iterator[tuple[int, np.ndarray, list]]]


def search_blocks(rows: DataFrame, queries: DataFrame, index: Callable[[np.ndarray, np.ndarray], Search], k: int, score: pa.DataType) -> DataFrame:
    """(query_id, rank, vec_id, score): queries pass the index of each block of rows, which gives its best k; the best of all remain.

    Rows are dealt to blocks by a hash of their id. The task of a block gets
    its rows first, calls ``index(ids, vectors)`` once and streams the queries
    through the search that this returns. Beyond BLOCK_QUERIES queries a block
    has several such tasks.
    """
    n, m, width = rows.count(), queries.count(), int(rows.agg(F.max(F.size("v"))).first()[0] or 0)
    nr, nq = max(1, -(-n // BLOCK_ROWS)), max(1, -(-m // BLOCK_QUERIES))
    block = F.pmod(F.xxhash64("id"), F.lit(nr)).cast("int")
    share = F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(nq)).cast("int")
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = rows.select(block.alias("block"), each(nq).alias("qblock"), F.lit(False).alias("asks"), "id", "v")
    right = queries.select(each(nr).alias("block"), share.alias("qblock"), F.lit(True).alias("asks"), "id", "v")
    found = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", score)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, search = None, [], None
        for b in batches:
            key = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], 1)
            v = b.column(4)
            x, size = np.zeros((b.num_rows, width)), np.diff(v.offsets.to_numpy())
            x[np.repeat(np.arange(b.num_rows), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = v.flatten().to_numpy(zero_copy_only=False)
            ids = b.column(3).to_numpy()
            edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), b.num_rows]
            for i, j in zip(edges, edges[1:], strict=False):
                if i == j:
                    continue
                if tuple(key[i, :2]) != now:
                    now, held, search = tuple(key[i, :2]), [], None
                if not key[i, 2]:
                    held.append((ids[i:j], x[i:j]))
                    continue
                if not held:
                    continue
                if search is None:
                    own, of = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                    order = np.lexsort((*of.T[:1], own)) if width else np.argsort(own)
                    search = index(own[order], of[order])
                for q in range(i, j, 1024):
                    made = list(search(ids[q : min(j, q + 1024)], x[q : min(j, q + 1024)]))
                    if made:
                        yield batch_of(found, np.concatenate([np.full(len(f), query) for query, f, _ in made]), np.concatenate([f for _, f, _ in made]), pa.array([s for _, _, scores in made for s in scores], score))

    kind = "double" if pa.types.is_floating(score) else "decimal(38,0)"
    dealt = left.unionByName(right).repartition(nr * nq, "block", "qblock").sortWithinPartitions("block", "qblock", "asks")
    best = dealt.mapInArrow(run, f"query_id long, vec_id long, score {kind}")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def best_rows(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k highest scores, ties to smaller ids."""
    return np.array(sorted(range(len(ids)), key=lambda i: (-score[i], ids[i]))[:k], np.int64) if score.dtype == object else np.lexsort((ids, -score))[:k]


# --- bit-sliced index --------------------------------------------------------------------------


def slices_of(values: np.ndarray) -> np.ndarray:
    """Bitmaps of each bit of non-negative integers, least significant first; a row of 64-bit words each."""
    bits = max(1, int(values.max(initial=0)).bit_length())
    n = -(-len(values) // 64) * 64
    out = np.zeros((bits, n // 8), np.uint8)
    for j in range(bits):
        out[j, : -(-len(values) // 8)] = np.packbits(((values >> j) & 1).astype(np.uint8), bitorder="little")
    return out.view(np.uint64)


class BitSlices:
    """Bit slices of each attribute, shifted to start at 0, without their ``drop`` lowest bits."""

    def __init__(self, x: np.ndarray, drop: int):
        self.n, self.x, self.least = len(x), x, x.min(0)
        self.words = -(-len(x) // 64)
        self.span = x.max(0) - self.least
        self.drop = drop
        self.slices = [slices_of((x[:, d] - self.least[d]) >> drop) for d in range(x.shape[1])]
        self.all = slices_of(np.ones(len(x), np.int64))[0]

    def weighted_sum(self, w: np.ndarray) -> tuple[list[np.ndarray], int]:
        """(slices of an under-estimate of x @ w, up to a constant; by how much it can fall short).

        Weights add shifted bitmaps: those of one place meet in carry-save
        adders, three bitmaps giving a sum and a carry, until one is left.
        Attributes with negative weights enter by their complements.
        """
        places: dict[int, list[np.ndarray]] = {}
        short = 0
        for d, weight in enumerate(w.tolist()):
            s, a = self.slices[d], abs(weight)
            if not a:
                continue
            short += a * ((1 << self.drop) - 1)
            if weight < 0:
                s = ~s & self.all
            for bit in range(a.bit_length()):
                if a >> bit & 1:
                    for j in range(len(s)):
                        places.setdefault(bit + j, []).append(s[j : j + 1])
        out: list[np.ndarray] = []
        place, most = 0, max(places, default=-1)
        while place <= most:
            m = np.concatenate(places.get(place) or [np.zeros((1, self.words), np.uint64)])
            carries = []
            while len(m) > 2:
                t = len(m) // 3
                a, b, c = m[:t], m[t : 2 * t], m[2 * t : 3 * t]
                ab = a ^ b
                carries.append((a & b) | (c & ab))
                m = np.concatenate([ab ^ c, m[3 * t :]])
            if len(m) == 2:
                carries.append(m[:1] & m[1:])
                m = m[:1] ^ m[1:]
            out.append(m[0])
            if carries:
                places.setdefault(place + 1, []).extend(carries)
                most = max(most, place + 1)
            place += 1
        return out, short

    def at_least(self, s: list[np.ndarray], bound: int) -> np.ndarray:
        """Bitmap of rows whose sum is ``bound`` or more."""
        if bound <= 0:
            return self.all
        if bound >> len(s):
            return np.zeros_like(self.all)
        more, equal = np.zeros_like(self.all), self.all
        for j in reversed(range(len(s))):
            if bound >> j & 1:
                equal = equal & s[j]
            else:
                more, equal = more | (equal & s[j]), equal & ~s[j]
        return more | equal

    def kth(self, s: list[np.ndarray], k: int) -> int:
        """The k-th highest sum, walking from the most significant slice downward."""
        value, more, equal = 0, 0, self.all
        for j in reversed(range(len(s))):
            high = equal & s[j]
            n = int(np.bitwise_count(high).sum())
            if more + n >= k:
                equal, value = high, value | 1 << j
            else:
                more, equal = more + n, equal & ~s[j]
        return value

    def candidates(self, w: np.ndarray, k: int) -> np.ndarray:
        """Rows that can be among the k highest of x @ w."""
        if k >= self.n:
            return np.arange(self.n)
        s, short = self.weighted_sum(w)
        if not s:
            return np.arange(self.n)
        hit = self.at_least(s, (self.kth(s, k) << self.drop) - short >> self.drop) if self.drop else self.at_least(s, self.kth(s, k))
        return np.flatnonzero(np.unpackbits(hit.view(np.uint8), bitorder="little")[: self.n])


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), held to ``LARGEST`` either way."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * x), -LARGEST, LARGEST).astype(np.int64)


def products(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows with w: as 64-bit words where none can overflow, else as whole numbers of any size."""
    most = int(np.abs(x).max(initial=0)) * int(np.abs(w).max(initial=0)) * max(1, x.shape[1])
    return x @ w if most < 1 << 62 else x.astype(object) @ w.astype(object)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, drop_bits: int = 3, vec_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products of floor(scale * x).

    ``is_query`` is over the column ``id``. Rows without an id or with a
    vector that is null or holds null or non-finite components take no part;
    shorter vectors count as padded with zeros. Products are whole numbers
    throughout: components beyond 2**59 after scaling count as 2**59 with their
    sign, and a score beyond 64 bits is ranked by its exact value and returned
    as the nearest long. Repeated ids are each a candidate, never of a query
    with their own id; a query id counts once, by its least vector.
    """
    rows = usable(vectors, vec_col, id_col, False)
    queries = rows.where(is_query).groupBy("id").agg(F.min("v").alias("v"))

    def index(ids: np.ndarray, x: np.ndarray) -> Search:
        x = whole(x, scale)
        slices = BitSlices(x, drop_bits)
        own = dict(zip(*np.unique(ids, return_counts=True), strict=True))

        def search(qids: np.ndarray, q: np.ndarray):
            for query, w in zip(qids.tolist(), whole(q, scale), strict=True):
                c = slices.candidates(w, k + int(own.get(query, 0)))
                c = c[ids[c] != query]
                # rows at the boundary are resolved by their exact products
                score = products(x[c], w)
                top = best_rows(ids[c], score, k)
                if len(top):
                    yield query, ids[c][top], [decimal.Decimal(int(v)) for v in score[top]]

        return search

    found = search_blocks(rows, queries, index, k, pa.decimal128(38, 0))
    low, high = (F.lit(v).cast("decimal(38,0)") for v in (-(2**63), 2**63 - 1))
    return found.withColumn("score", F.greatest(low, F.least(high, "score")).cast("long"))


# --- permutation index -------------------------------------------------------------------------


class Permutations:
    """Inverted files: for each pivot the rows that have it among their nearest, with its place in their order."""

    def __init__(self, x: np.ndarray, pivots: np.ndarray, nearest: int):
        self.m = min(nearest, len(pivots))
        self.pivots = pivots
        order = self.order(x)
        row, place = np.repeat(np.arange(len(x)), self.m), np.tile(np.arange(self.m), len(x))
        by = np.argsort(order.ravel(), kind="stable")
        bounds = np.searchsorted(order.ravel()[by], np.arange(len(pivots) + 1))
        self.files = [(row[by[a:b]].astype(np.int32), place[by[a:b]].astype(np.int32)) for a, b in zip(bounds, bounds[1:], strict=False)]
        self.n = len(x)

    def order(self, x: np.ndarray, rows: int = 2048) -> np.ndarray:
        out = [np.argsort(-(x[i : i + rows] @ self.pivots.T), axis=1, kind="stable")[:, : self.m].astype(np.int32) for i in range(0, len(x), rows)]
        return np.concatenate(out) if out else np.zeros((0, self.m), np.int32)

    def footrule(self, order: np.ndarray) -> np.ndarray:
        """Spearman's footrule to a query's order of pivots, less a constant; a pivot outside an order has place m."""
        out = np.zeros(self.n, np.int32)
        for i, p in enumerate(order.tolist()):
            rows, places = self.files[p]
            # both sides place it: |i - j| in place of (m - i) + (m - j)
            out[rows] += np.abs(places - np.int32(i)) - np.int32(2 * self.m - i) + places
        return out


def choose_pivots(rows: DataFrame, pivots: int, sample: int) -> np.ndarray:
    """Pivots of length 1 among the ``sample`` rows of smallest hash: each next one is the row farthest from those chosen in a random half."""
    n = rows.count()
    near = rows.withColumn("h", F.xxhash64(F.lit(3), "id", "v")).where((F.col("h") / 2.0**64 + 0.5) * F.lit(float(n)) <= 2.0 * sample)
    got = near.orderBy("h").limit(sample).collect()
    width = max((len(r["v"]) for r in got), default=0)
    x = np.array([[*r["v"], *[0.0] * (width - len(r["v"]))] for r in got]).reshape(len(got), width)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    if len(x) <= pivots:
        return x
    rng = np.random.default_rng(17)
    chosen, best = [0], x @ x[0]
    while len(chosen) < pivots:
        half = rng.choice(len(x), max(1, len(x) // 2), replace=False)
        chosen.append(int(half[np.argmin(best[half])]))
        best = np.maximum(best, x @ x[chosen[-1]])
    return x[chosen]


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, pivots: int = 256, nearest_pivots: int = 96, rerank: float = 6.0, sample: int = 4096, vec_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k rows of largest cosine among those found by a permutation index.

    Pivots come from a sample of at most ``sample`` rows; every row is indexed.
    In each block of n rows the ``rerank`` * sqrt(n) rows of least footrule, and
    k more, get their exact cosine in double precision, which of equal vectors
    is equal wherever they stand. Rows without an id or with a vector that is
    null, zero or holds null or non-finite components take no part; shorter
    vectors count as padded with zeros. Repeated ids as in ``top_k``.
    """
    rows = usable(vectors, vec_col, id_col, True)
    queries = rows.where(is_query).groupBy("id").agg(F.min("v").alias("v"))
    chosen = choose_pivots(rows, pivots, sample)

    def unit(x: np.ndarray) -> np.ndarray:
        x = x / np.abs(x).max(1, keepdims=True)  # keeps squares finite and away from 0
        return x / np.sqrt((x**2).sum(1, keepdims=True))

    def index(ids: np.ndarray, x: np.ndarray) -> Search:
        u = unit(x)
        p = np.zeros((len(chosen), u.shape[1]))
        p[:, : chosen.shape[1]] = chosen[:, : u.shape[1]]
        files = Permutations(u, p, nearest_pivots)
        most = min(len(ids), k + int(np.ceil(rerank * np.sqrt(len(ids)))))

        def search(qids: np.ndarray, q: np.ndarray):
            v = unit(q)
            for i, (query, order) in enumerate(zip(qids.tolist(), files.order(v), strict=True)):
                far = files.footrule(order).astype(np.int64)
                far[ids == query] = np.iinfo(np.int32).max
                # rows stand by their ids: of equal footrules the smaller ids come first
                c = np.argpartition(far * len(ids) + np.arange(len(ids)), most - 1)[:most]
                c = c[ids[c] != query]
                score = np.clip((u[c] * v[i]).sum(1), -1, 1)
                top = best_rows(ids[c], score, k)
                if len(top):
                    yield query, ids[c][top], score[top].tolist()

        return search

    return search_blocks(rows, queries, index, k, pa.float64())
