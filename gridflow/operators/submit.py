"""One submission table from the predictions of all tasks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridflow.functions import iso_text
from gridflow.operators.rel import join_unique, strict_double
from gridflow.operators.validate import SUBMISSION_VALUES, ContractError, require_valid, submission_violations
from gridflow.sources.files import hadoop_path
from gridflow.sources.schemas import KEYS, VALUES


def assemble(template: DataFrame, predictions: dict[str, DataFrame], place: str | None = None) -> DataFrame:
    """submission_id, task and the four value columns of each template row; values that a task doesn't use are 0.

    Each task's rows meet its template rows by the task's keys as text in one
    left join, where a repeated prediction raises; a missing one is null and
    shows in the validation. Rows are in the order of the column ``place`` of
    the template, if one is named, and in none otherwise.
    """
    more = [place] if place else []
    parts = []
    for task, keys in KEYS.items():
        rows = template.where(F.col("task") == task).select("submission_id", "task", *more, *keys)
        own = VALUES[task]
        if task in predictions:
            p = predictions[task]
            values = p.select(*_text_keys(p, keys), *[strict_double(v).alias(v) for v in own])
            rows = join_unique(rows, values, keys)
        else:
            rows = rows.withColumns({v: F.lit(None).cast("double") for v in own})
        parts.append(rows.select("submission_id", "task", *more, *[(F.col(v) if v in own else F.lit(0.0)).cast("double").alias(v) for v in SUBMISSION_VALUES]))
    out = reduce(DataFrame.unionByName, parts)
    return out.orderBy(place).drop(place) if place else out


def _text_keys(d: DataFrame, keys: list[str]) -> list:
    kinds = dict(d.dtypes)
    return [(iso_text(F.col(k)) if kinds[k].startswith("timestamp") else F.col(k).cast("string")).alias(k) for k in keys]


def extra_predictions(template: DataFrame, predictions: dict[str, DataFrame]) -> DataFrame:
    """(task, n): predictions that no template row asks for."""
    parts = []
    for task, p in predictions.items():
        keys = KEYS[task]
        rows = template.where(F.col("task") == task).select(*keys)
        parts.append(p.select(*_text_keys(p, keys)).join(rows, keys, "left_anti").agg(F.count("*").alias("n")).select(F.lit(task).alias("task"), "n"))
    return reduce(DataFrame.unionByName, parts)


def write_submission(template: DataFrame, predictions: dict[str, DataFrame], path: str, file_format: str = "csv", one_file: bool = True) -> None:
    """Assemble, validate and only then publish, rows in the order of the template's file; an existing path is refused.

    All is written beside ``path`` and renamed. With ``one_file`` a single task
    writes one file of that name; else a folder of part files, in order, which
    suits a very large submission.
    """
    spark = template.sparkSession
    target, fs = hadoop_path(spark, path)
    if fs.exists(target):
        raise ContractError(f"{path} exists")
    staged = f"{path.rstrip('/')}.staged"
    numbered = template.withColumn("__place", F.monotonically_increasing_id())
    out = assemble(numbered, predictions, "__place")
    w = (out.coalesce(1) if one_file else out).write.mode("overwrite")
    here = hadoop_path(spark, staged)[0]
    try:
        (w.option("header", True).csv(staged) if file_format == "csv" else w.parquet(staged))
        back = spark.read.schema(out.schema).option("header", True).csv(staged) if file_format == "csv" else spark.read.parquet(staged)
        extra = {r["task"]: r["n"] for r in extra_predictions(template, predictions).where("n > 0").collect()}
        if extra:
            raise ContractError(f"predictions without a template row: {extra}")
        require_valid(submission_violations(back, template), "submission")
    except Exception:
        fs.delete(here, True)
        raise
    if not one_file:
        fs.rename(here, target)
        return
    part = next(s.getPath() for s in fs.listStatus(here) if s.getPath().getName().startswith("part-"))
    fs.rename(part, target)
    fs.delete(here, True)
