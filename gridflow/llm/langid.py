"""Language identification: averaged hashed subword embeddings and a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, spare, utf8

#: Languages scripts aside, the letters that make a text readable: any Unicode letter.
LETTERS = r"\p{L}"


@dataclass
class LanguageModel:
    """Languages, the logit of each hashed subword for each language, biases, temperature and rejection threshold."""

    languages: list[str]
    logits: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float


def subwords(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text number) of the byte n-grams of 3 and 4 bytes that lie in one text.

    ASCII letters are lower-cased; all other bytes that aren't letters of a
    multi-byte character count as spaces, so digits and marks say nothing.
    """
    low = data | ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    low = np.where(((low >= 97) & (low <= 122)) | (low >= 128), low, np.uint8(32)).astype(np.uint32)
    text = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    out, owner = [], []
    for n, salt in ((3, 0x51ED270B), (4, 0x2545F491)):
        if len(low) < n:
            continue
        gram = low[: len(low) - n + 1].copy()
        for k in range(1, n):
            gram = gram << np.uint32(8) | low[k : len(low) - n + 1 + k]
        same = text[: len(gram)] == text[n - 1 :]
        h = (gram ^ np.uint32(salt)) * np.uint32(2654435761)
        h ^= h >> np.uint32(15)
        h = h * np.uint32(2246822519)
        out.append((h >> np.uint32(32 - bits))[same])
        owner.append(text[: len(gram)][same])
    if not out:
        return np.zeros(0, np.uint32), np.zeros(0, np.int32)
    return np.concatenate(out), np.concatenate(owner)


def mean_logits(model_logits: np.ndarray, bits: int, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Average of the subwords' rows for each text; zeros where a text has none."""
    n = len(offsets) - 1
    total, count = np.zeros((n, model_logits.shape[1])), np.zeros(n)
    bucket, owner = subwords(data, offsets, bits)
    count += np.bincount(owner, minlength=n)
    for k in range(model_logits.shape[1]):
        total[:, k] = np.bincount(owner, model_logits[bucket, k], minlength=n)
    return total / np.maximum(count, 1)[:, None]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], langs: list[str], bits: int = 15, dim: int = 16, epochs: int = 12, rate: float = 0.5, seed: int = 1, reject_share: float = 0.0005) -> LanguageModel:
    """Fit embeddings and softmax by stochastic gradient descent, then calibrate on the fifth of the rows kept apart.

    The temperature minimises the log loss of the kept rows; a prediction is
    rejected when its probability lies below what all but ``reject_share`` of
    the rightly predicted kept rows reach, and below 1/2 in any case.
    """
    languages = sorted(set(langs))
    if not languages:
        return LanguageModel([], np.zeros((1 << bits, 0), np.float32), np.zeros(0), 1.0, 0.0)
    y = np.searchsorted(languages, langs)
    rng = np.random.default_rng(seed)
    sets: list[tuple[np.ndarray, np.ndarray]] = []
    for t in texts:
        b = np.frombuffer(t.encode(), np.uint8)
        bucket, _ = subwords(b, np.array([0, len(b)]), bits)
        ids, n = np.unique(bucket, return_counts=True)
        sets.append((ids, (n / max(1, n.sum())).astype(np.float32)))
    kept = np.arange(len(texts)) % 5 == 4 if len(texts) >= 20 else np.zeros(len(texts), bool)
    E = (rng.standard_normal((1 << bits, dim)) / dim).astype(np.float32)
    W, bias = np.zeros((dim, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    fit = np.flatnonzero(~kept)
    # adaptive rates by coordinate: rare subwords move as readily as common ones
    gE, gW = np.full(1 << bits, 1e-6, np.float32), np.full(W.shape, 1e-6, np.float32)
    for _ in range(epochs):
        for i in rng.permutation(fit):
            ids, w = sets[i]
            if not len(ids):
                continue
            v = w @ E[ids]
            p = softmax((v @ W + bias)[None])[0]
            p[y[i]] -= 1
            gv = W @ p
            gw = np.outer(v, p)
            gW += gw * gw
            W -= rate * gw / np.sqrt(gW)
            bias -= 0.01 * p
            step = w[:, None] * gv
            gE[ids] += (step * step).mean(1)
            E[ids] -= 0.2 * step / np.sqrt(gE[ids])[:, None]
    table = (E @ W).astype(np.float32)

    def logits(rows: np.ndarray) -> np.ndarray:
        return np.array([sets[i][1] @ table[sets[i][0]] + bias if len(sets[i][0]) else bias for i in rows], np.float64).reshape(len(rows), len(languages))

    rows = np.flatnonzero(kept) if kept.any() else fit
    z, t = logits(rows), y[rows]
    losses = [(-np.log(softmax(z / k)[np.arange(len(rows)), t] + 1e-12).mean(), k) for k in np.geomspace(0.25, 16, 25)]
    temperature = float(min(losses)[1])
    p = softmax(z / temperature)
    right = np.sort(p.max(1)[p.argmax(1) == t])
    low = float(right[int(reject_share * len(right))]) if len(right) else 0.0
    return LanguageModel(languages, table, bias.astype(np.float64), temperature, min(low, 0.5))


def fit_sample(docs: DataFrame, where, most: int, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> tuple[list[str], list[str]]:
    """At most ``most`` labelled texts for fitting: for each language its rows of smallest hash, as many of each."""
    from pyspark.sql import Window

    d = docs.where(where & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(F.lit(11), id_col).alias("h"))
    # a row for each language
    sizes = d.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not sizes:
        return [], []
    share = max(1, most // len(sizes))
    # the hash's share of its range bounds what is sorted; twice the share leaves room for chance
    known = docs.sparkSession.createDataFrame([(r["lang"], r["n"]) for r in sizes], "lang string, n long")
    near = d.join(F.broadcast(known), "lang").where((F.col("h") / 2.0**64 + 0.5) * F.col("n") <= 2.0 * share)
    top = near.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= share)
    rows = top.select("text", "lang", "h").collect()
    rows.sort(key=lambda r: (r["h"], r["lang"], r["text"]))
    return [r["text"] for r in rows], [r["lang"] for r in rows]


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with lang_pred, score and rejected (each behind ``prefix``).

    Null texts and texts without a letter are ``und`` with score 0 and
    rejected; other texts get the likeliest language, and ``rejected`` says
    whether its calibrated probability is below the model's threshold. Columns
    of ``docs`` named like the three are replaced, all others kept.
    """
    bits = int(model.logits.shape[0]).bit_length() - 1
    names = docs.columns
    added = [f"{prefix}lang_pred", f"{prefix}score", f"{prefix}rejected"]
    d = docs.drop(*[c for c in added if c in names])
    schema = d.schema
    from pyspark.sql import types as T

    full = T.StructType([*schema.fields, T.StructField(added[0], T.StringType()), T.StructField(added[1], T.DoubleType()), T.StructField(added[2], T.BooleanType())])
    letters = spare([*names, *added], "__has_letter")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col):
            at = b.schema.get_field_index(text_col)
            data, offsets = utf8(b.column(at))
            n = b.num_rows
            has = np.asarray(b.column(b.schema.get_field_index(letters)).fill_null(False))
            if model.languages:
                p = softmax((mean_logits(model.logits, bits, data, offsets) + model.bias) / model.temperature)
                best, score = p.argmax(1), p.max(1)
                lang = [model.languages[k] if h else "und" for k, h in zip(best, has, strict=True)]
            else:
                score, lang, has = np.zeros(n), ["und"] * n, np.zeros(n, bool)
            score = np.where(has, np.clip(score, 0, 1), 0.0)
            cols = [b.column(i) for i in range(b.num_columns) if b.schema.names[i] != letters]
            rejected = ~has | (score < model.reject_below)
            fields = [b.schema.field(i) for i in range(b.num_columns) if b.schema.names[i] != letters]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], schema=pa.schema([*fields, pa.field(added[0], pa.string()), pa.field(added[1], pa.float64()), pa.field(added[2], pa.bool_())]))

    return d.withColumn(letters, F.coalesce(F.col(text_col).rlike(LETTERS), F.lit(False))).mapInArrow(run, full)


def crc_mod(column: str, by: int):
    """crc32 of the id as text, modulo ``by``; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % by

