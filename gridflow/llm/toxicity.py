"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

STRIP = ".,;:!?\"'()[]{}<>*#$%&|-_=+/\\~`^@"
#: Stand around each window and each word that a dictionary lists, so that short windows still compress and a listed one is a single match.
LEAD, TAIL = bytes(range(1, 9)) + bytes(range(14, 32)), bytes(range(31, 13, -1))
MEMORY = 500_000


def window(word: str) -> bytes:
    return f" {word.strip(STRIP).lower()} ".encode("utf-8", "replace")


@dataclass
class ToxicityModel:
    """Both dictionaries' content, what a window's pair of compressed lengths says, and a logistic score over document features."""

    toxic: bytes
    ordinary: bytes
    table: np.ndarray
    weights: np.ndarray
    center: np.ndarray
    scale: np.ndarray


class Lengths(dict):
    """word -> code of its window's two compressed lengths; kept for this worker.

    The upper four bits hold the length under the toxic dictionary beyond that
    of an empty window, the lower four by how much the ordinary one's is longer.
    """

    def __init__(self, toxic: bytes, ordinary: bytes):
        super().__init__()
        make = lambda content: zstandard.ZstdCompressor(
            dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
            compression_params=zstandard.ZstdCompressionParameters.from_level(3, min_match=3, strategy=zstandard.STRATEGY_BTOPT, window_log=18, search_log=7, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False),
        )
        self.toxic, self.ordinary = make(toxic), make(ordinary)
        self.least = len(self.toxic.compress(LEAD + b"  " + TAIL))

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMORY:
            self.clear()
        w = window(word)
        if w == b"  ":
            code = 4
        else:
            key = w.decode("utf-8", "replace")
            code = self.get(key)
            if code is None:
                w = LEAD + w + TAIL
                n = len(self.toxic.compress(w))
                code = 16 * max(0, min(15, n - self.least)) + max(0, min(15, len(self.ordinary.compress(w)) - n + 4))
                if len(word) < 64:
                    self[key] = code
        if len(word) < 64:
            self[word] = code
        return code


def codes(memory: Lengths, text: str | None) -> np.ndarray:
    return np.frombuffer(bytes(map(memory.__getitem__, text.split())), np.uint8) if text else np.zeros(0, np.uint8)


def features(c: np.ndarray, table: np.ndarray) -> list[float]:
    """Highest weight of a window, mean of the three highest, telling windows (logarithm) and their share."""
    if not len(c):
        return [0.0, 0.0, 0.0, 0.0]
    g = table[c]
    top = np.sort(g)[-3:] if len(g) < 8 else np.partition(g, -3)[-3:]
    hits = int((g >= 2).sum())
    return [float(g.max()), float(np.maximum(top, 0).sum()) / 3, float(np.log1p(hits)), hits / len(g)]


def dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary's content; the samples themselves where there are too few to train on."""
    try:
        content = zstandard.train_dictionary(size, samples, k=64, d=6).as_bytes() if len(samples) >= 50 else b"".join(samples)[-size:]
    except zstandard.ZstdError:
        content = b"".join(samples)[-size:]
    return content


def contrast(texts: list[str], toxic: np.ndarray, least: int = 2) -> list[tuple[str, int]]:
    """(word, weight) of words that toxic texts use more than ordinary ones, heaviest first.

    A word counts by its texts or by the different words before it, whichever
    are fewer: neither copies of one document nor one long document lift their
    rare words.
    """
    before: dict[str, set[str]] = defaultdict(set)
    count: Counter[str] = Counter()
    ordinary: Counter[str] = Counter()
    for t, y in zip(texts, toxic, strict=True):
        words = [w.strip(STRIP).lower() for w in t.split()]
        if y:
            count.update(set(words))
            for b, w in zip(["", *words], words, strict=False):
                before[w].add(b)
        else:
            ordinary.update(set(words))
    ratio = max(1.0, (len(toxic) - toxic.sum()) / max(1, toxic.sum()))
    weight = {w: min(n, len(before[w])) for w, n in count.items()}
    out = [(w, n) for w, n in weight.items() if n >= least and len(w) >= 2 and ordinary[w] <= 0.02 * n * ratio]
    return sorted(out, key=lambda x: (-x[1], x[0]))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights with bias last, centre, scale) by Newton's method."""
    center, scale = x.mean(0), x.std(0) + 1e-6
    z = np.concatenate([(x - center) / scale, np.ones((len(x), 1))], 1)
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + ridge * w
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + ridge * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w, center, scale


def train(texts: list[str], toxic: list[int], toxic_size: int = 65_536, ordinary_size: int = 114_688) -> ToxicityModel:
    """Train both dictionaries on two thirds of the rows; calibrate the windows' weights and the score on the third kept apart, as words of copied rows then are new."""
    y = np.array(toxic, int)
    if not len(y) or y.min() == y.max():
        base = float(y.mean()) if len(y) else 0.0
        return ToxicityModel(LEAD, LEAD, np.zeros(256), np.array([0, 0, 0, 0, np.log((base + 0.01) / (1.01 - base))]), np.zeros(4), np.ones(4))
    fold = np.zeros(len(y), bool)
    if len(y) >= 60:  # every third row of each label
        for v in (0, 1):
            fold[np.flatnonzero(y == v)[2::3]] = True
    fit = [t for t, k in zip(texts, fold, strict=True) if not k]
    words = contrast(fit, y[~fold], max(1, min(3, int((y[~fold] == 1).sum()) // 5), int((y[~fold] == 1).sum()) // 100))
    # the heaviest words come last in raw content and often in the samples: near matches cost fewer bits
    samples = [f" {w} ".encode() for w, n in words for _ in range(min(n, 20))]
    listed = b"".join(LEAD + f" {w} ".encode() + TAIL for w, _ in reversed(words))[-toxic_size:]
    tox = dictionary(samples, toxic_size // 4) + listed + LEAD + b"  " + TAIL
    whole = [t.lower().encode("utf-8", "replace") for t, k in zip(fit, y[~fold], strict=True) if not k]
    plain = [b[i : i + 512] for b in whole for i in range(0, len(b), 512)]
    ordinary = dictionary(plain, ordinary_size) + LEAD + b"  " + TAIL
    memory = Lengths(tox, ordinary)
    rows = np.flatnonzero(fold) if fold.any() else np.arange(len(y))
    c = [codes(memory, texts[i]) for i in rows]
    yy = y[rows]
    # each code's weight: how much likelier a toxic row holds it, shrunk where few rows do
    seen = np.zeros((2, 256))
    for h, v in zip(c, yy, strict=True):
        seen[v, np.unique(h)] += 1
    n = np.bincount(yy, minlength=2)
    table = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    table *= seen.sum(0) / (seen.sum(0) + 2)
    w, center, s = logistic(np.array([features(h, table) for h in c]), yy.astype(float))
    return ToxicityModel(tox, ordinary, table, w, center, s)


_MEMORY: dict[int, Lengths] = {}


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a toxicity score from 0 to 1, which replaces a column of that name.

    Null, empty and blank texts score as texts without a telling window.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    d = docs.drop(name)
    out = T.StructType([*d.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        key = hash((m.toxic, m.ordinary))
        if key not in _MEMORY:
            _MEMORY.clear()
            _MEMORY[key] = Lengths(m.toxic, m.ordinary)
        memory = _MEMORY[key]
        for b in slices(batches, text_col):
            x = np.array([features(codes(memory, t), m.table) for t in b.column(b.schema.get_field_index(text_col)).to_pylist()])
            z = (x - m.center) / m.scale @ m.weights[:-1] + m.weights[-1]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], schema=b.schema.append(pa.field(name, pa.float64())))

    return d.mapInArrow(run, out)


def fit_sample(docs: DataFrame, labels: DataFrame, where, most: int, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic") -> tuple[list[str], list[int]]:
    """At most ``most`` labelled texts, half of each label where there are enough, those of smallest hash.

    ``where`` is over the id column. Ids are chosen from the labels alone, so
    that the texts are found by a broadcast of ``most`` ids at the most.
    """
    known = labels.where(where & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("__y"))
    known = known.withColumn("__h", F.xxhash64(F.lit(5), "__id"))
    share = max(1, most // 2)
    top = [known.where(F.col("__y") == v).orderBy("__h", "__id").limit(share) for v in (0, 1)]
    chosen = F.broadcast(top[0].unionByName(top[1]))
    text = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    rows = text.join(chosen, "__id").dropDuplicates(["__id"]).collect()
    rows.sort(key=lambda r: (r["__h"], r["__text"]))
    return [r["__text"] for r in rows], [r["__y"] for r in rows]
