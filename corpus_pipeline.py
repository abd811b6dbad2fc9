"""A corpus pipeline of five stages, each on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridflow.llm import jaccard, langid, lines, packing, queries, suffix
from gridflow.llm.common import remove, shared_path, write


def _as_documents(d: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``, n_chars following the text."""
    chars: Column = F.length("text").cast(dict(like.dtypes).get("n_chars", "long"))
    return (d.withColumn("n_chars", chars) if "n_chars" in like.columns else d).select(*like.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with calibrated confidence; null texts, texts without letters and rejected ones go."""
    d = langid.predict(docs, queries.language_model(spark, docs), prefix="__")
    return d.where(~F.col("__rejected")).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 characters or more in 5 documents or more stay in the document of largest id."""
    return _as_documents(lines.dedup_lines(docs, 5, 40, prefix="__"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by word shingles of five and a similarity of 0.8, that of smallest id stays."""
    return jaccard.one_of_each(docs, 80, 5).select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings as long as a passage of 50 words that start anywhere else go, and parts of characters at the cuts."""
    return _as_documents(suffix.cut_repeats(docs, queries.PASSAGE_BYTES, prefix="__", text_out=True), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of at most 2048 ids."""
    items = packing.pieces(docs, queries.tokenizer(), 2048, 0)
    return packing.pack_pieces(items, 2048).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("language ID", language), ("line dedup", line_dedup), ("n-gram Jaccard join", near_duplicates), ("suffix-array dedup", substring_dedup), ("best-fit packing", packed)]

#: Learned models and token ids can't be told in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of ``sf_dir``, each written to the shared folder and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name.replace(' ', '-')}")
        docs = write(stage(spark, docs, sf_dir), path)
        if before:
            remove(spark, before)
        before = path
    return docs
