"""Contracts of predictions, answers and submissions, each checked in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridflow.functions import any_null, is_finite
from gridflow.operators.metrics import network_keys
from gridflow.sources.schemas import KEYS, VALUES

SUBMISSION_VALUES = ("speed_kmh", "flow_vph", "queue_pred", "path_flow")
TASK_VALUES = {t: tuple(v) for t, v in VALUES.items()}


class ContractError(ValueError):
    """Rows that break a contract, counted by kind."""


def _sum(c) -> F.Column:
    return F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))


def prediction_violations(pred: DataFrame, targets: DataFrame, keys: Sequence[str], values: Sequence[str], binary: Sequence[str] = (), not_negative: Sequence[str] = ()) -> DataFrame:
    """(violation, n): null keys, repeated, missing and extra keys, and values that aren't finite, binary or non-negative.

    Both sides are tagged, unioned and grouped by key once: a single shuffle.
    """
    absent = [c for c in (*keys, *values) if c not in pred.columns]
    if absent:
        raise ContractError(f"columns missing: {absent}")
    a = pred.select(*keys, *[F.col(v).cast("double").alias(v) for v in values], F.lit(1).alias("__p"), F.lit(0).alias("__t"))
    b = targets.select(*keys, *[F.lit(None).cast("double").alias(v) for v in values], F.lit(0).alias("__p"), F.lit(1).alias("__t"))
    bad = {"non_finite": [~is_finite(F.col(v)) for v in values], "non_binary": [~F.col(v).isin(0.0, 1.0) for v in binary], "negative": [F.col(v) < 0 for v in not_negative]}
    flags = {}
    for name, tests in bad.items():
        flag = F.lit(False)
        for t in tests:
            flag = flag | F.coalesce(t, F.lit(False))
        flags[name] = F.sum(((F.col("__p") == 1) & flag).cast("long")).alias(name)
    g = a.unionByName(b).groupBy(*keys).agg(F.sum("__p").alias("p"), F.sum("__t").alias("t"), *flags.values())
    null = any_null(list(keys))
    one = g.agg(
        _sum(F.when(null, F.col("p")).otherwise(0)).alias("null_key"), _sum(F.when(null, F.col("t")).otherwise(0)).alias("null_target_key"),
        _sum(F.when(~null & (F.col("p") > 1), F.col("p") - 1).otherwise(0)).alias("duplicate"), _sum(F.when(~null & (F.col("t") > 1), F.col("t") - 1).otherwise(0)).alias("duplicate_target"),
        _sum(~null & (F.col("p") == 0)).alias("missing"), _sum(~null & (F.col("t") == 0)).alias("extra"), *[F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(n) for n in bad],
    )
    names = ["null_key", "null_target_key", "duplicate", "duplicate_target", "missing", "extra", *bad]
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("violation"), F.col(n).alias("n")) for n in names])).alias("x")).select("x.*")


def task_violations(pred: DataFrame, targets: DataFrame, task: str) -> DataFrame:
    return prediction_violations(pred, targets, KEYS[task], VALUES[task], ["queue_pred"] if task == "queue" else [], ["path_flow"] if task == "odme" else [])


def require_valid(violations: DataFrame, what: str) -> None:
    """Raise if any violation counts; the only action of a validation, on a handful of rows."""
    found = {r["violation"]: r["n"] for r in violations.where("n > 0").collect()}
    if found:
        raise ContractError(f"{what}: {found}")


def template_diff(a: DataFrame, b: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows that differ between two tables by key: side and key; nulls equal nulls."""
    x = a.select(key, F.struct(*columns).alias("x"), F.lit(True).alias("in_a"))
    y = b.select(key, F.struct(*columns).alias("y"), F.lit(True).alias("in_b"))
    d = x.join(y, key, "full_outer")
    side = F.when(F.col("in_b").isNull(), "missing").when(F.col("in_a").isNull(), "extra").when(~F.col("x").eqNullSafe(F.col("y")), "changed")
    return d.select(key, side.alias("side")).where(F.col("side").isNotNull())


def submission_violations(sub: DataFrame, template: DataFrame) -> DataFrame:
    """(violation, n) of a submission against its template: ids, tasks and values; columns that a task doesn't use must be 0."""
    want = ["submission_id", "task", *SUBMISSION_VALUES]
    if sub.columns != want:
        raise ContractError(f"columns must be {want}")
    s = sub.select("submission_id", "task", *[F.expr(f"try_cast({v} AS double)").alias(v) for v in SUBMISSION_VALUES], F.lit(1).alias("__s"))
    finite, unused = F.lit(True), F.lit(False)
    for v in SUBMISSION_VALUES:
        finite = finite & is_finite(F.col(v))
        tasks = [t for t, vs in TASK_VALUES.items() if v in vs]
        unused = unused | (~F.col("task").isin(*tasks) & (F.col(v) != 0))
    g = s.groupBy("submission_id").agg(
        F.count("*").alias("n"), F.first("task").alias("task_in"), _sum(~finite).alias("non_finite"), _sum((F.col("task") == "queue") & ~F.col("queue_pred").isin(0.0, 1.0)).alias("non_binary"),
        _sum((F.col("task") == "odme") & (F.col("path_flow") < 0)).alias("negative"), _sum(F.coalesce(unused, F.lit(False))).alias("unused_not_zero"),
    )
    t = template.select("submission_id", F.col("task").alias("task_want")).groupBy("submission_id").agg(F.count("*").alias("m"), F.first("task_want").alias("task_want"))
    d = g.join(t, "submission_id", "full_outer")
    one = d.agg(
        _sum(F.col("submission_id").isNull() | (F.col("submission_id").cast("string") == "")).alias("empty_id"), _sum(F.col("n") > 1).alias("duplicate"), _sum(F.col("n").isNull()).alias("missing"), _sum(F.col("m").isNull()).alias("extra"),
        _sum(F.coalesce(F.col("task_in") != F.col("task_want"), F.lit(False))).alias("wrong_task"), *[_sum(F.col(c)).alias(c) for c in ("non_finite", "non_binary", "negative", "unused_not_zero")],
        (F.coalesce(F.sum("n"), F.lit(0)) == 0).cast("long").alias("no_rows"),
    )
    names = [c for c in one.columns]
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("violation"), F.col(n).alias("n")) for n in names])).alias("x")).select("x.*")


def partition_answers(answers: DataFrame, templates: DataFrame, keys: Sequence[str], parts: Sequence[str] = ("panel", "split")) -> DataFrame:
    """answers with the parts of the one template that each row matches; matches counts them, and only 1 is right.

    Where answers have columns of ``parts`` they narrow the match.
    """
    own = [p for p in parts if p in answers.columns]
    on = [*keys, *[p for p in own if p not in keys]]
    t = templates.select(*dict.fromkeys([*keys, *parts])).distinct()
    given = [p for p in parts if p not in on]
    n = t.groupBy(*on).agg(F.count("*").alias("matches"), *[F.min(p).alias(p) for p in given])
    return answers.join(n, on, "left").withColumn("matches", F.coalesce("matches", F.lit(0)))


def incidence_violations(incidence: DataFrame, paths: DataFrame, counts: DataFrame) -> DataFrame:
    """(violation, n): repeated path ids, incidence of unknown paths, counted links without incidence.

    Ids are those of one network; where all tables name panels, of each panel.
    """
    panel = network_keys(incidence, paths, counts)
    path, link = [*panel, "path_id"], [*panel, "link_id"]
    dup = paths.groupBy(*path).count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit("duplicate_path").alias("violation"), "n")
    unknown = incidence.select(*path).distinct().join(paths.select(*path), path, "left_anti").agg(F.count("*").alias("n")).select(F.lit("unknown_path").alias("violation"), "n")
    bare = counts.select(*link).distinct().join(incidence.select(*link), link, "left_anti").agg(F.count("*").alias("n")).select(F.lit("link_without_path").alias("violation"), "n")
    return dup.unionByName(unknown).unionByName(bare)
