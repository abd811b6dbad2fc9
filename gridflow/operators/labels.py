"""Leakage-safe labels: state answers, queue labels, complete windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridflow.functions import all_true, half_open
from gridflow.operators.rel import join_unique

MIN_OBSERVED_PERCENT, QUEUE_SPEED_FRACTION = 75, 0.6


def eligible(speed: str = "speed_kmh", flow: str | None = "flow_vph", observed: str = "pct_observed", least: float = MIN_OBSERVED_PERCENT):
    """Enough of the interval was observed and the measurements are there."""
    e = (F.col(observed) >= least) & F.col(speed).isNotNull()
    return e & F.col(flow).isNotNull() if flow else e


def state_answers(template: DataFrame, states: DataFrame, keys: Sequence[str] = ("timestamp", "station_id", "link_id")) -> DataFrame:
    """Measured speed and flow of the template's rows, where coverage suffices; states must be unique by key."""
    s = states.select(*keys, "speed_kmh", "flow_vph", "pct_observed")
    t = template.drop("speed_kmh", "flow_vph", "pct_observed")
    return join_unique(t, s, keys).where(eligible()).drop("pct_observed")


def link_conditions(states: DataFrame, by: Sequence[str] = ("timestamp", "link_id")) -> DataFrame:
    """Mean speed of each link's detectors, and whether every one of them is eligible (a null coverage or speed isn't)."""
    return states.groupBy(*by).agg(F.avg("speed_kmh").alias("mean_speed"), all_true(eligible(flow=None)).alias("all_eligible"))


def is_queued(speed: str, free_speed: str):
    return F.coalesce(F.col(speed) <= QUEUE_SPEED_FRACTION * F.col(free_speed), F.lit(False)).cast("int")


def queue_labels(targets: DataFrame, states: DataFrame, links: DataFrame, by: Sequence[str] = ("timestamp", "link_id")) -> DataFrame:
    """targets with queue_true and eligible: a link is queued at 0.6 of its free speed or less; only links whose every detector is eligible are labelled; links must be unique, within their panel if ``by`` holds panel."""
    means = link_conditions(states, by)
    link = [*(["panel"] if "panel" in by and "panel" in links.columns else []), "link_id"]
    d = join_unique(targets.join(means, list(by), "left"), links.select(*link, "free_speed_kmh"), link)
    return d.select(*targets.columns, F.when(F.col("all_eligible"), is_queued("mean_speed", "free_speed_kmh")).otherwise(0).alias("queue_true"), F.coalesce("all_eligible", F.lit(False)).alias("eligible"))


def complete_windows(rows: DataFrame, window: str, time: str, start, end) -> DataFrame:
    """Rows of windows that lie wholly in [start, end)."""
    spans = rows.groupBy(window).agg(F.min(time).alias("a"), F.max(time).alias("b"))
    whole = spans.where((F.col("a") >= F.lit(start)) & half_open(F.col("b"), None, end)).select(window)
    return rows.join(whole, window, "left_semi")


def historical_queue_labels(labels: DataFrame, index: DataFrame, history_start, history_end) -> DataFrame:
    """Labels of windows with history_start >= start and forecast_end < end."""
    w = index.where((F.col("history_start") >= F.lit(history_start)) & (F.col("forecast_end") < F.lit(history_end))).select("window_id").distinct()
    return labels.join(w, "window_id", "left_semi")
