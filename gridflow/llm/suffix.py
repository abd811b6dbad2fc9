"""Suffix-array dedup: bytes covered by a long string that occurs anywhere else."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LETTER, U64, Tables, as_long, batch_of, give_back, identity, mix, prefix_hashes, runs, slices, spare, span_hash, utf8

#: Length of the strings by whose hashes anchors are chosen, as a share of the repeat's length.
ANCHOR_SHARE = 0.25
#: A group of more different contexts is dealt by finer keys: NARROW windows and the bytes that all of them hold;
#: where that leaves as many in one group, by hashes of single windows. No task gets an unbounded group.
MOST_IN_GROUP, NARROW = 4096, 32


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by running minima of blocks from both sides."""
    n = len(h)
    x = np.full(-(-n // width) * width, U64(2**64 - 1))
    x[:n] = h
    x = x.reshape(-1, width)
    left = np.minimum.accumulate(x, axis=1).ravel()
    right = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """(text, h, g, at, lo, hi): the anchors of all windows of ``length`` bytes in the texts of a buffer.

    A window's anchor is its leftmost k-byte string of smallest hash h, so equal
    windows have equal anchors at the same place in them. An anchor owns the
    windows that start at lo..hi (places in the text); g is the hash of all
    bytes that these windows cover, with the anchor's place among them.
    """
    none = tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64, np.int64))
    n = len(data)
    if n < length:
        return none
    if n >= 1 << 28:
        raise ValueError("a text of 256 MiB or more")
    P = prefix_hashes(LETTER[data])
    at = np.arange(n - k + 1)
    h = mix(span_hash(P, at, at + k))
    # the place in the low bits makes the leftmost of equal hashes the least, and comes out with the minimum
    low = U64((1 << 28) - 1)
    least = sliding_min(h & ~low | at.astype(np.uint64), length - k + 1)
    edge = np.zeros(n + 2, np.int8)
    long = np.flatnonzero(np.diff(offsets) >= length)
    edge[offsets[long]] += 1
    edge[offsets[long + 1] - length + 1] -= 1
    start = np.flatnonzero(np.cumsum(edge[: len(least)], dtype=np.int8))
    if not len(start):
        return none
    anchor = (least[start] & low).astype(np.int64)
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)])
    first = np.flatnonzero(new)
    lo, hi, at = start[first], start[np.concatenate([first[1:] - 1, [len(start) - 1]])], anchor[first]
    g = mix(span_hash(P, lo, hi + length) + mix((at - lo).astype(np.uint64) << U64(32) | (hi - lo).astype(np.uint64)))
    text = np.searchsorted(offsets, lo, "right") - 1
    base = offsets[text]
    return text, h[at], g, at - base, lo - base, hi - base


ANCHOR = pa.schema([("r1", pa.int64()), ("r2", pa.int64()), ("h", pa.int64()), ("g", pa.int64()), ("c", pa.int32()), ("at", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32())])
_ANCHOR = "r1 long, r2 long, h long, g long, c int, at int, lo int, hi int"


# --- suffix sort of the contexts of one block -------------------------------------------------


def common(P: np.ndarray, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common extension of the suffixes at x and y, at most ``most``, by binary search on prefix hashes."""
    lo, hi = np.zeros(len(x), np.int64), most.astype(np.int64).copy()
    while (lo < hi).any():
        mid = (lo + hi + 1) >> 1
        same = span_hash(P, x, x + mid) == span_hash(P, y, y + mid)
        lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
    return lo


def suffix_sort(buf: np.ndarray, start: np.ndarray, size: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp) of the suffixes buf[start : start+size], by group and then by bytes.

    A mergesort whose comparisons take logarithmic time: a binary search on
    polynomial prefix hashes finds where two suffixes part. All pairs of runs
    of one width merge together, each suffix finding its rank in the other run.
    lcp[i] is what order[i] shares with order[i-1] (-1 at a group's start).
    Every lcp is compared byte by byte afterwards; on a collision of hashes the
    block is sorted by its bytes instead.
    """
    n = len(start)
    P = prefix_hashes(LETTER[buf])
    tail = np.append(buf, np.uint8(0)).astype(np.int16)

    def before(x: np.ndarray, y: np.ndarray, ties: bool) -> np.ndarray:
        """Whether suffix x sorts before y; equal ones as ``ties`` says."""
        most = np.minimum(size[x], size[y])
        same = group[x] == group[y]
        k = common(P, start[x], start[y], np.where(same, most, 0))
        a = np.where(k < size[x], tail[np.minimum(start[x] + k, len(buf))], -1)
        b = np.where(k < size[y], tail[np.minimum(start[y] + k, len(buf))], -1)
        return np.where(same, (a < b) | ((a == b) & ties), group[x] < group[y])

    order = np.argsort(group, kind="stable")
    width = 1
    while width < n:
        place = np.arange(n)
        pair = place // (2 * width) * (2 * width)
        left = place - pair < width
        # the other run of the pair, and how many of its suffixes come first
        lo = np.where(left, np.minimum(pair + width, n), pair)
        base, hi = lo.copy(), np.where(left, np.minimum(pair + 2 * width, n), np.minimum(pair + width, n))
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            x, y = order[open_], order[mid]
            # of equal suffixes those of the left run come first
            first = np.where(left[open_], before(y, x, False), before(y, x, True))
            lo[open_] = np.where(first, mid + 1, lo[open_])
            hi[open_] = np.where(first, hi[open_], mid)
            open_ = open_[lo[open_] < hi[open_]]
        to = pair + np.where(left, place - pair, place - pair - width) + (lo - base)
        merged = np.empty_like(order)
        merged[to] = order
        order, width = merged, 2 * width
    a, b = order[:-1], order[1:]
    most = np.minimum(size[a], size[b])
    same = group[a] == group[b]
    lcp = np.concatenate([[-1], np.where(same, common(P, start[a], start[b], np.where(same, most, 0)), -1)])[:n]
    if not _verified(tail, start, size, a[same], b[same], lcp[1:][same]):
        keys = [(int(group[i]), buf[start[i] : start[i] + size[i]].tobytes()) for i in range(n)]
        order = np.array(sorted(range(n), key=keys.__getitem__), np.int64)
        for i in range(1, n):
            (g, x), (f, y) = keys[order[i - 1]], keys[order[i]]
            lcp[i] = next((k for k, (c, d) in enumerate(zip(x, y, strict=False)) if c != d), min(len(x), len(y))) if g == f else -1
    return order, lcp


def _verified(tail: np.ndarray, start: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray, lcp: np.ndarray, rows: int = 2048) -> bool:
    """Whether neighbours agree in exactly their first lcp bytes and are in order."""
    for i in range(0, len(a), rows):
        x, y, k = a[i : i + rows], b[i : i + rows], lcp[i : i + rows]
        step = np.arange(int(k.max()) + 1)[None, :]
        u = tail[np.minimum(start[x][:, None] + step, len(tail) - 1)]
        v = tail[np.minimum(start[y][:, None] + step, len(tail) - 1)]
        inside = step < k[:, None]
        if ((u != v) & inside).any():
            return False
        r = np.arange(len(x))
        c = np.where(k < size[x], u[r, k], -1)
        d = np.where(k < size[y], v[r, k], -1)
        if ((c >= d) & ~((c == -1) & (d == -1))).any():
            return False
    return True


def repeated_windows(contexts: list[bytes], place: np.ndarray, owned: np.ndarray, group: np.ndarray, length: int) -> list[np.ndarray]:
    """For each context, the starts of its windows (from 0) that another context of its group holds too.

    ``place`` is the anchor's place in the context and ``owned`` the number of
    windows. One suffix sort from the anchors to the right and one to the left
    give, for each distance d before the anchor, classes of equal d bytes to
    the left and of equal length-d bytes to the right; a window at d repeats if
    its pair of classes does.
    """
    sizes = np.array([len(c) for c in contexts])
    stop = np.cumsum(sizes)
    begin = stop - sizes
    buf = np.frombuffer(b"".join(contexts), np.uint8)
    right, right_lcp = suffix_sort(buf, begin + place, np.minimum(sizes - place, length), group)
    total = len(buf)
    left, left_lcp = suffix_sort(buf[::-1].copy(), total - begin - place, np.minimum(place, length), group)
    n = len(contexts)
    lclass, rclass = np.empty(n, np.int64), np.empty(n, np.int64)
    out: list[list[int]] = [[] for _ in range(n)]
    hits_i, hits_s = [], []
    far, near = place, place - owned + 1
    for d in range(int(near.min()), int(far.max()) + 1):
        own = np.flatnonzero((near <= d) & (d <= far))
        if len(own) < 2:
            continue
        lclass[left] = np.cumsum(left_lcp < d)
        rclass[right] = np.cumsum(right_lcp < length - d)
        key = lclass[own] * n + rclass[own]
        by = np.argsort(key, kind="stable")
        k = key[by]
        twin = np.concatenate([[False], k[1:] == k[:-1]])
        twin[:-1] |= twin[1:]
        rows = own[by[twin]]
        hits_i.append(rows)
        hits_s.append(place[rows] - d)
    if hits_i:
        i, s = np.concatenate(hits_i), np.concatenate(hits_s)
        order = np.lexsort((s, i))
        i, s = i[order], s[order]
        bounds = np.searchsorted(i, np.arange(n + 1))
        return [s[bounds[j] : bounds[j + 1]] for j in range(n)]
    return [np.array(x, np.int64) for x in out]


RANGE = pa.schema([("r1", pa.int64()), ("r2", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])
_RANGE = "r1 long, r2 long, lo int, hi int"
ROW = ["r1", "r2"]


def _starts_to_ranges(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s, e = runs(starts, starts + 1)
    return s, e - 1


def repeated_ranges(base: DataFrame, length: int, tables: Tables) -> DataFrame:
    """(r1, r2, spans): runs lo..hi of window starts that occur elsewhere, for rows (r1, r2, text); a table among ``tables``."""
    k = max(1, int(length * ANCHOR_SHARE))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # anchors with the same bytes twice in a slice are settled here: their runs of windows, and one row that counts them
        for b in slices(batches, "text"):
            data, offsets = utf8(b.column(2))
            text, h, g, at, lo, hi = anchors(data, offsets, length, k)
            if not len(text):
                continue
            r1, r2 = b.column(0).to_numpy(), b.column(1).to_numpy()
            order = np.lexsort((g, h))
            new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])])
            first = np.flatnonzero(new)
            count = np.diff(np.concatenate([first, [len(order)]]))
            one = order[first]
            yield batch_of(ANCHOR, r1[text[one]], r2[text[one]], as_long(h[one]), as_long(g[one]), count.astype(np.int32), at[one].astype(np.int32), lo[one].astype(np.int32), hi[one].astype(np.int32))
            again = np.sort(order[np.repeat(count > 1, count)])
            if len(again):
                base = offsets[text[again]]
                s, e = runs(base + lo[again], base + hi[again] + 1)
                of = np.searchsorted(offsets, s, "right") - 1
                none, small = pa.nulls(len(s), pa.int64()), pa.nulls(len(s), pa.int32())
                yield batch_of(ANCHOR, r1[of], r2[of], none, none, small, small, (s - offsets[of]).astype(np.int32), (e - 1 - offsets[of]).astype(np.int32))

    every = tables.keep(base.select("r1", "r2", "text").mapInArrow(choose, _ANCHOR))
    settled = every.where("h is null").select(*ROW, "lo", "hi")
    some = every.where("h is not null")
    # one record for each anchor's different surroundings; counts are summed in each task before they travel
    kinds = tables.keep(some.groupBy("h", "g").agg(F.sum("c").alias("c"), *(F.first(x).alias(x) for x in ("r1", "r2", "at", "lo", "hi"))))
    # the same bytes around the same anchor twice: all its windows repeat
    whole = tables.keep(some.where("c = 1").join(kinds.where("c > 1").select("h", "g"), ["h", "g"]).select(*ROW, "lo", "hi").unionByName(settled))
    tables.drop(every)
    # an anchor with several surroundings is settled by its bytes; tables of known size let a join split a frequent anchor or broadcast the few
    mixed = tables.keep(kinds.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").select("h", (F.col("k") > MOST_IN_GROUP).alias("large")))
    asked = tables.keep(kinds.join(mixed, "h").groupBy(*ROW).agg(F.collect_list(F.struct("h", "at", "lo", "hi", (F.col("c") > 1).alias("known"), "large")).alias("asked")))
    tables.drop(kinds, mixed)
    context = tables.keep(base.join(asked, ROW).select(*ROW, "text", "asked").mapInArrow(lambda it: _contexts(it, length), _CONTEXT))
    crowd = tables.keep(context.where("large").groupBy("h").count().where(F.col("count") > MOST_IN_GROUP).select("h"))
    fine = context.where("large").join(crowd, "h", "left_anti")
    small = context.where("not large").unionByName(fine).drop("large").repartition("h").sortWithinPartitions("h").mapInArrow(lambda it: _sorted_groups(it, length), _RANGE)
    windows = context.where("large").join(crowd, "h", "left_semi").drop("large").mapInArrow(lambda it: _windows(it, length), "w long, v long, r1 long, r2 long, at int, known boolean")
    twice = windows.groupBy("w", "v").count().where("count > 1").select("w", "v")
    large = windows.where("not known").join(twice, ["w", "v"]).select(*ROW, F.col("at").alias("lo"), F.col("at").alias("hi"))
    found = whole.unionByName(small).unionByName(large)
    out = tables.keep(found.groupBy(*ROW).agg(F.collect_list(F.struct("lo", "hi")).alias("spans")))
    tables.drop(whole, asked, context, crowd)
    return out


CONTEXT = pa.schema([("h", pa.int64()), ("r1", pa.int64()), ("r2", pa.int64()), ("lo", pa.int32()), ("place", pa.int32()), ("owned", pa.int32()), ("known", pa.bool_()), ("large", pa.bool_()), ("context", pa.binary())])
_CONTEXT = "h long, r1 long, r2 long, lo int, place int, owned int, known boolean, large boolean, context binary"


def _contexts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes that the asked anchors' windows cover."""
    for b in slices(batches, "text", 1 << 22):
        data, o = utf8(b.column(2))
        raw, rows = data.tobytes(), []
        for i, (r1, r2, asked) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True)):
            for a in asked:
                start, at = int(o[i]), a["at"]
                if not a["large"]:
                    rows.append((a["h"], r1, r2, a["lo"], at - a["lo"], a["hi"] - a["lo"] + 1, a["known"], False, raw[start + a["lo"] : start + a["hi"] + length]))
                    continue
                for j in range((at - a["hi"]) // NARROW, (at - a["lo"]) // NARROW + 1):
                    lo, hi = max(a["lo"], at - NARROW * j - NARROW + 1), min(a["hi"], at - NARROW * j)
                    # what all windows of this distance from the anchor hold
                    core = raw[start + at - NARROW * j : start + at - NARROW * j - NARROW + 1 + length]
                    key = int.from_bytes(hashlib.blake2b(core, digest_size=8, key=f"{a['h']},{j}".encode()).digest(), "little", signed=True)
                    rows.append((key, r1, r2, lo, at - lo, hi - lo + 1, a["known"], True, raw[start + lo : start + hi + length]))
        if rows:
            yield batch_of(CONTEXT, *zip(*rows, strict=True))


def _sorted_groups(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Whole groups of rows sorted by h, gathered to blocks of about MOST_IN_GROUP contexts."""
    held: list[tuple] = []

    def solve(rows: list[tuple]) -> pa.RecordBatch | None:
        h, r1, r2, lo, place, owned, known, context = zip(*rows, strict=True)
        starts = repeated_windows(list(context), np.array(place), np.array(owned), np.unique(np.array(h), return_inverse=True)[1].reshape(-1), length)
        found: tuple[list, ...] = ([], [], [], [])
        for i, x in enumerate(starts):
            if len(x) and not known[i]:
                a, b = _starts_to_ranges(x)
                for to, new in zip(found, ([r1[i]] * len(a), [r2[i]] * len(a), (a + lo[i]).tolist(), (b + lo[i]).tolist()), strict=True):
                    to += new
        return batch_of(RANGE, *found) if found[0] else None

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if len(held) >= MOST_IN_GROUP and row[0] != held[-1][0]:
                if made := solve(held):
                    yield made
                held = []
            held.append(row)
    if held and (made := solve(held)):
        yield made
    give_back()


WINDOW = pa.schema([("w", pa.int64()), ("v", pa.int64()), ("r1", pa.int64()), ("r2", pa.int64()), ("at", pa.int32()), ("known", pa.bool_())])


def _windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """128 bits of hash for each window of the contexts of large groups."""
    for b in batches:
        for h, r1, r2, lo, place, owned, known, context in zip(*(c.to_pylist() for c in b.columns), strict=True):
            P = prefix_hashes(LETTER[np.frombuffer(context, np.uint8)])
            at = np.arange(owned)
            w = span_hash(P, at, at + length)
            yield batch_of(WINDOW, as_long(mix(w)), as_long(mix(np.full(owned, h, np.int64).view(np.uint64) ^ (place - at).astype(np.uint64))), np.full(owned, r1), np.full(owned, r2), (lo + at).astype(np.int32), np.full(owned, known))


def cut_repeats(docs: DataFrame, length: int = 400, text_col: str = "text", id_col: str = "doc_id", prefix: str = "", bytes_col: str = "kept", text_out: bool = False, passage: int | None = None) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans behind ``prefix`` and the kept bytes.

    A byte goes if a string of ``length`` bytes that covers it also starts
    anywhere else in the table; repeats may overlap and are judged on the input.
    Null texts are empty; each row is a document of its own, so repeated rows
    are copies. With ``text_out`` the text column itself gets the kept bytes,
    where parts of characters at a cut go as well; else they are in ``bytes_col``.
    Columns of ``docs`` of these names are replaced, all others are kept. A text
    of 256 MiB or more raises.

    With ``passage``, a further column n_repeated counts the bytes covered by
    strings of that many bytes that also start anywhere else; they aren't removed.
    """
    names = [f"{prefix}{n}" for n in ("n_bytes", "n_removed", "n_spans", *(["n_repeated"] if passage else []))]
    d = docs.drop(*names, *([] if text_out else [bytes_col]))
    tables = Tables(docs.sparkSession, "repeats")
    keys = identity(id_col, text_col)
    base = d.select(*(x.alias(n) for x, n in zip(keys, ROW, strict=True)), F.col(text_col).alias("text"))
    spans = repeated_ranges(base, length, tables).withColumnRenamed("spans", "s0")
    if passage:
        spans = spans.join(repeated_ranges(base, passage, tables).withColumnRenamed("spans", "s1"), ROW, "full")
    rows, marks = [spare(d.columns, f"__{n}") for n in ROW], [spare(d.columns, f"__s{i}") for i in range(2 if passage else 1)]
    for old, new in zip([*ROW, *(f"s{i}" for i in range(len(marks)))], [*rows, *marks], strict=True):
        spans = spans.withColumnRenamed(old, new)
    both = d.select("*", *(x.alias(n) for x, n in zip(keys, rows, strict=True))).join(spans, rows, "left").drop(*rows)
    fields = [T.StructField(f.name, T.StringType()) if f.name == text_col else f for f in d.schema.fields]
    out = T.StructType([*fields, *([] if text_out else [T.StructField(bytes_col, T.BinaryType())]), *[T.StructField(n, T.LongType()) for n in names]])

    def covered(column: pa.ListArray, width: int, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Maximal runs of the bytes that each row's windows cover."""
        lo, hi = np.asarray(column.values.field("lo"), np.int64), np.asarray(column.values.field("hi"), np.int64)
        o, there = column.offsets.to_pylist(), column.is_valid().to_pylist()
        for i in range(n):
            yield runs(lo[o[i] : o[i + 1]], hi[o[i] : o[i + 1]] + width) if there[i] else (lo[:0], hi[:0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col):
            at = b.schema.get_field_index(text_col)
            data, o = utf8(b.column(at))
            raw = data.tobytes()
            column = lambda name: b.column(b.schema.get_field_index(name))
            kept, removed, count = [], [], []
            for i, (s, e) in enumerate(covered(column(marks[0]), length, b.num_rows)):
                t = raw[int(o[i]) : int(o[i + 1])]
                if len(s):
                    edges = [0, *np.stack([s, e], 1).ravel().tolist(), len(t)]
                    t = b"".join(t[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
                kept.append(t)
                removed.append(int((e - s).sum()))
                count.append(len(s))
            more = [np.diff(o), removed, count]
            if passage:
                more.append([int((e - s).sum()) for s, e in covered(column(marks[1]), passage, b.num_rows)])
            cols = [(pa.array([t.decode("utf-8", "ignore") for t in kept], pa.string()) if i == at and text_out else c) for i, c in enumerate(b.columns) if b.schema.names[i] not in marks]
            sch = [f for f in b.schema if f.name not in marks] + ([] if text_out else [pa.field(bytes_col, pa.binary())]) + [pa.field(n, pa.int64()) for n in names]
            yield pa.RecordBatch.from_arrays([*cols, *([] if text_out else [pa.array(kept, pa.binary())]), *(pa.array(x, pa.int64()) for x in more)], schema=pa.schema(sch))

    return both.mapInArrow(run, out)
