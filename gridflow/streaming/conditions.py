"""Extension: link conditions and queue labels of a stream of detector rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridflow.functions import all_true
from gridflow.operators.labels import eligible, is_queued


def stream_link_conditions(rows: DataFrame, links: DataFrame, minutes: int = 5, late: str = "10 minutes") -> DataFrame:
    """For each link and interval the mean speed, whether all its rows are eligible, and the queue label.

    Rows later than ``late`` behind the newest time are dropped and finished
    intervals are emitted once (append mode). ``links`` is a network table.
    """
    w = rows.withWatermark("timestamp", late).groupBy(F.window("timestamp", f"{minutes} minutes"), "link_id")
    d = w.agg(F.avg("speed_kmh").alias("mean_speed"), all_true(eligible(flow=None)).alias("all_eligible"), F.count("*").alias("n"))
    d = d.join(links.select("link_id", "free_speed_kmh"), "link_id", "left")
    return d.select(F.col("window.start").alias("timestamp"), "link_id", "n", "mean_speed", "all_eligible", F.when(F.col("all_eligible"), is_queued("mean_speed", "free_speed_kmh")).otherwise(0).alias("queue_true"))
