"""Relational kernel: key normalisation, checked joins, key sets and redaction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridflow.functions import iso_text


def normalize_keys(df: DataFrame, keys: Sequence[str], time: str = "timestamp") -> DataFrame:
    """Identifier keys as strings, the time key as a UTC timestamp: text is parsed, a value without zone is taken as UTC."""
    kinds = dict(df.dtypes)
    return df.withColumns({k: (F.col(k).cast("timestamp") if k == time else F.col(k).cast("string")) for k in keys if k in kinds})


def canonical_keys(df: DataFrame, keys: Sequence[str], time: str = "timestamp") -> DataFrame:
    """The key columns alone, as text; times as ISO 8601 with Z."""
    return df.select(*[(iso_text(F.col(k)) if k == time else F.col(k).cast("string")).alias(k) for k in keys])


def target_template(df: DataFrame, keys: Sequence[str], values: Sequence[str], fill: float | int = 0) -> DataFrame:
    """Distinct keys with every value column set to a placeholder."""
    return df.select(*keys).distinct().withColumns({v: F.lit(fill) for v in values})


def join_unique(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join whose right side must have unique keys; a repeated key that is met raises when the plan runs.

    The check rides on the same shuffle as the join: rows are counted by key
    over the join's own partitioning.
    """
    on = list(on)
    n = right.groupBy(*on).agg(F.count("*").alias("__n"), *[F.first(c).alias(c) for c in right.columns if c not in on])
    checked = n.withColumn("__n", F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("repeated key: "), F.concat_ws(", ", *on))).cast("long")).otherwise(F.col("__n")))
    return left.join(checked.where("__n = 1"), on, how).drop("__n")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def keyset_difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys on one side only: side is 'missing' (left only) or 'extra' (right only)."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, list(keys), "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, list(keys), "left_anti").withColumn("side", F.lit("extra")))


def union_diagonal(*tables: DataFrame) -> DataFrame:
    """All rows; columns that a table lacks are null and numeric types widen."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def redact_rows(df: DataFrame, hidden: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Null ``columns`` (those that exist) in rows whose key is in ``hidden``; rows and other columns stay."""
    there = [c for c in columns if c in df.columns]
    if not there:
        return df
    hit = hidden.select(*keys).distinct().withColumn("__hit", F.lit(True))
    out = df.join(hit, list(keys), "left")
    return out.withColumns({c: F.when(F.col("__hit"), F.lit(None)).otherwise(F.col(c)) for c in there}).select(*df.columns)


def latest_per_group(df: DataFrame, group: Sequence[str], time: str) -> DataFrame:
    """All rows at each group's latest time."""
    last = df.groupBy(*group).agg(F.max(time).alias(time))
    return df.join(last, [*group, time], "left_semi")


def explode_list(df: DataFrame, column: str, item: str, place: str = "place", sep: str = ";") -> DataFrame:
    """One row for each item of a separated text column, with its place; empty texts give no row."""
    kept = [c for c in df.columns if c != column]
    d = df.where((F.col(column).isNotNull()) & (F.col(column) != ""))
    return d.select(*kept, F.posexplode(F.split(column, sep)).alias(place, item))


def restore_answers(observed: DataFrame, answers: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Fill null values of ``observed`` from ``answers`` by key."""
    a = answers.select(*keys, *[F.col(v).alias(f"__{v}") for v in values])
    out = observed.join(a, list(keys), "left")
    return out.withColumns({v: F.coalesce(v, f"__{v}") for v in values}).select(*observed.columns)


def split_intervals(calendar: DataFrame, start, end) -> DataFrame:
    """Each split's part of a requested half-open interval; empty parts go."""
    d = calendar.withColumns({"start": F.greatest("start", F.lit(start)), "end": F.least("end", F.lit(end))})
    return d.where(F.col("start") < F.col("end"))


def empty_table(spark, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def strict_double(c: str) -> Column:
    """Cast that raises on text that is no number, whatever the session's ANSI setting."""
    x = F.col(c).cast("string")
    number = F.expr(f"try_cast(`{c}` AS double)")
    return F.when(x.isNotNull() & number.isNull(), F.raise_error(F.concat(F.lit(f"{c} is no number: "), x)).cast("double")).otherwise(number)
