"""Forecast windows: candidates by coverage and condition, and their spaced selection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridflow.functions import any_true
from gridflow.operators.series import future_frame, history_frame


@dataclass(frozen=True)
class WindowRules:
    history_steps: int = 12
    future_steps: int = 6
    step_minutes: int = 5
    history_coverage: float = 0.7
    future_coverage: float = 0.7
    per_condition: int = 5
    spacing_minutes: int = 360
    seed: int = 69420


def candidates(grid: DataFrame, rules: WindowRules = WindowRules(), group: tuple[str, ...] = ("panel",), entity: str = "link_id", time: str = "timestamp") -> DataFrame:
    """(group, time, condition, coverages) of possible origins of a dense grid with int columns ``queued`` and ``eligible``.

    An origin needs its whole history before it and its whole future after it,
    enough eligible cells in both over all entities, and a queue in the future.
    It is ongoing if an entity was queued twice or more in the history.
    """
    by = [*group, entity]
    h, f = history_frame(by, time, rules.history_steps), future_frame(by, time, rules.future_steps)
    rows = grid.select(
        *group, entity, time,
        F.sum("queued").over(h).alias("hq"), F.sum("eligible").over(h).alias("he"), F.count("*").over(h).alias("hn"),
        F.sum("queued").over(f).alias("fq"), F.sum("eligible").over(f).alias("fe"), F.count("*").over(f).alias("fn"),
    )
    origins = rows.groupBy(*group, time).agg(
        (F.sum("he") / F.sum("hn")).alias("history_coverage"), (F.sum("fe") / F.sum("fn")).alias("future_coverage"),
        any_true(F.col("hq") >= 2).alias("ongoing"), any_true(F.col("fq") > 0).alias("ahead"), F.min("hn").alias("hn"), F.min("fn").alias("fn"),
    )
    good = (F.col("hn") == rules.history_steps) & (F.col("fn") == rules.future_steps) & (F.col("history_coverage") >= rules.history_coverage) & (F.col("future_coverage") >= rules.future_coverage) & F.col("ahead")
    return origins.where(good).select(*group, time, F.when(F.col("ongoing"), "queue_ongoing").otherwise("queue_onset").alias("condition"), "history_coverage", "future_coverage")


def sample_spaced(origins: DataFrame, rules: WindowRules = WindowRules(), group: tuple[str, ...] = ("panel",), time: str = "timestamp") -> DataFrame:
    """At most ``per_condition`` origins for each group and condition, spaced apart, in a repeatable random order; adds number.

    A greedy choice is sequential, so each (group, condition) is one small
    task; its rows are origins that passed all rules, a few for each day.
    """
    schema = T.StructType([*origins.schema.fields, T.StructField("number", T.IntegerType())])
    order = F.xxhash64(F.lit(rules.seed), *group, F.col(time))

    def pick(pdf):
        pdf = pdf.sort_values(["__order", time])
        at = pdf[time].astype("int64").to_numpy() // 60_000_000_000 if str(pdf[time].dtype).startswith("datetime64[ns") else pdf[time].astype("datetime64[ns]").astype("int64").to_numpy() // 60_000_000_000
        chosen: list[int] = []
        for i, t in enumerate(at):
            if len(chosen) == rules.per_condition:
                break
            if all(abs(t - at[j]) >= rules.spacing_minutes for j in chosen):
                chosen.append(i)
        out = pdf.iloc[chosen].drop(columns="__order")
        return out.assign(number=range(1, len(out) + 1)).astype({"number": "int32"})

    return origins.withColumn("__order", order).groupBy(*group, "condition").applyInPandas(pick, schema)
