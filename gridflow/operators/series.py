"""Series on regular grids: densify, fill, interpolate, and frames of history and future."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def densify_grid(df: DataFrame, entity: str, time: str, step: str) -> DataFrame:
    """All times from the first to the last by ``step`` for every entity, with the columns of ``df`` where there is a row.

    The grid is times x entities by definition: one row a task of bounds is
    exploded over the entities, so nothing but the bounds is broadcast.
    """
    bounds = df.agg(F.min(time).alias("__a"), F.max(time).alias("__b"))
    grid = df.select(entity).distinct().crossJoin(F.broadcast(bounds)).select(entity, F.explode(F.sequence("__a", "__b", F.expr(f"interval {step}"))).alias(time))
    return grid.join(df, [entity, time], "left")


def forward_fill(column: str, by: Sequence[str], order: str) -> Column:
    return F.last(column, ignorenulls=True).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def backward_fill(column: str, by: Sequence[str], order: str) -> Column:
    return F.first(column, ignorenulls=True).over(Window.partitionBy(*by).orderBy(order).rowsBetween(0, Window.unboundedFollowing))


def interpolate(df: DataFrame, column: str | Sequence[str], by: Sequence[str], order: str, out: str | Sequence[str]) -> DataFrame:
    """Linear interpolation by row position between known neighbours; the ends take the nearest known value.

    Several columns share one sort of the series.
    """
    columns, outs = ([column], [out]) if isinstance(column, str) else (list(column), list(out))
    w = Window.partitionBy(*by).orderBy(order)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    d = df.withColumn("__i", F.row_number().over(w))
    frames, values, helpers = {}, {}, ["__i"]
    for n, (c, name) in enumerate(zip(columns, outs, strict=True)):
        va, vb, ia, ib = (f"__{k}{n}" for k in ("a", "b", "ia", "ib"))
        known = F.when(F.col(c).isNotNull(), F.col("__i"))
        frames |= {va: F.last(c, True).over(back), vb: F.first(c, True).over(ahead), ia: F.last(known, True).over(back), ib: F.first(known, True).over(ahead)}
        line = F.col(va) + (F.col(vb) - F.col(va)) * (F.col("__i") - F.col(ia)) / (F.col(ib) - F.col(ia))
        values[name] = F.when(F.col(va).isNull(), F.col(vb)).when(F.col(vb).isNull() | (F.col(ia) == F.col(ib)), F.col(va)).otherwise(line)
        helpers += [va, vb, ia, ib]
    return d.withColumns(frames).withColumns(values).drop(*helpers)


def history_frame(by: Sequence[str], order: str, steps: int = 12):
    """The ``steps`` rows before the current one."""
    return Window.partitionBy(*by).orderBy(order).rowsBetween(-steps, -1)


def future_frame(by: Sequence[str], order: str, steps: int = 6):
    """The ``steps`` rows after the current one."""
    return Window.partitionBy(*by).orderBy(order).rowsBetween(1, steps)
