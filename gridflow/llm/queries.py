"""The registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard, langid, lines, packing, spm, suffix, tokens, toxicity, vectors
from .common import shared_path

#: Rows that the classifiers are fitted on, at most; they come to the driver.
LANG_ROWS, TOXIC_ROWS = 3_000, 6_000
#: 50 words of three letters and a space: what a passage of over 50 words holds at the least, but for very short words.
PASSAGE_BYTES = 200


def tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = suffix.cut_repeats(_docs(spark, sf_dir).select("doc_id", "text"), 400, passage=PASSAGE_BYTES)
    return d.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_repeated")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.with_components(_docs(spark, sf_dir), 80, 5).select("doc_id", "n_shingles", "component_id")


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "op3")
    tokens.write_tokens(tokens.encode(tokens.sorted_docs(_docs(spark, sf_dir)), tokenizer(), 1), path)
    return tokens.id_digests(tokens.read_tokens(spark, path))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lines.dedup_lines(_docs(spark, sf_dir).select("doc_id", "text"), 5, 40)
    return d.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer("piece_bpe_32k.model")
    d = spm.decode(spm.agreed(spm.encode(_docs(spark, sf_dir), path)), path)
    return d.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), F.sha2("text", 256).alias("decoded_sha256"))


def toxic_model(spark: SparkSession, sf_dir: str) -> toxicity.ToxicityModel:
    d, labels = _docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.train(*toxicity.fit_sample(d, labels, langid.crc_mod("doc_id", 3) != 1, TOXIC_ROWS))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = toxic_model(spark, sf_dir)
    d = toxicity.score(_docs(spark, sf_dir).select("doc_id", "text"), model)
    return d.select("doc_id", (langid.crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = packing.pieces(_docs(spark, sf_dir), tokenizer(), 2048, 0)
    return packing.pack_pieces(items, 2048).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def language_model(spark: SparkSession, docs: DataFrame) -> langid.LanguageModel:
    return langid.train(*langid.fit_sample(docs, langid.crc_mod("doc_id", 5) != 0, LANG_ROWS))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    d = langid.predict(docs.select("doc_id", "text"), language_model(spark, docs))
    return d.select("doc_id", (langid.crc_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "rejected")


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 100 == 0, 10, 1024)


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 50 == 0, 5)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_ngram_join, op3_token_ids, op4_line_dedup, op5_sentencepiece, op6_toxicity, op7_packing, op8_language_id, op9_exact_top_k, op10_nearest)}


#: Lines of every document; the whole semantics in SQL.
_OP4 = r"""
WITH l AS (
  SELECT r, doc_id, i, n, line, lower_key AS k FROM (
    SELECT r, doc_id, i, len(a) AS n, a[i] AS line,
      translate(trim(a[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_key
    FROM (SELECT r, doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)))),
f AS (SELECT k, max(doc_id) AS last FROM (SELECT DISTINCT k, doc_id FROM l WHERE length(k) >= 40) GROUP BY k HAVING count(*) >= 5),
m AS (SELECT l.*, (f.k IS NOT NULL AND l.doc_id <> f.last) AS gone FROM l LEFT JOIN f ON l.k = f.k)
SELECT doc_id, CAST(max(n) AS BIGINT) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""


#: All pairs of documents that share a shingle, and the closure of their links.
_OP2 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS a FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(a) >= 5 THEN list_transform(range(1, len(a) - 3), lambda i: array_to_string(a[i:i + 4], ' ')) WHEN len(a) > 0 THEN [array_to_string(a, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT r.a AS doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(r.b) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a
"""

#: Whole scores fit doubles exactly: |floor(1024 x)| stays far below 2**26 for unit vectors of 64 dimensions.
_OP9 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_join": _OP2, "op4_line_dedup": _OP4, "op9_exact_top_k": _OP9}
