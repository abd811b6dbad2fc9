"""A small synthetic release that exercises every reader and operator."""

from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridflow.functions import uniform
from gridflow.sources.files import hadoop_path, write_csv, write_text
from gridflow.sources.release import CALENDAR, CORRIDORS, COUNTS, PRIOR, TEMPLATES, WINDOW_HISTORY, WINDOW_INDEX
from gridflow.sources.schemas import MASK_REGIMES, SCHEMAS

#: The fixture's world (fixed values that tests rely on).
PANEL, FAMILY, FIRST_DAY, DAYS = "D12_I5_N", "D12_I5", datetime(2030, 11, 3), 35
SPLIT_DATES = {"train": ("2030-06-01", "2031-03-01"), "validation": ("2031-03-01", "2031-04-01"), "private": ("2031-04-01", "2031-05-01")}
LINKS = [("L01", 1.0, 2.0, 100.0, 4000.0, 40.0, 200.0, "S01", 2000.0), ("L02", 1.0, 4.0, 100.0, 8000.0, 80.0, 400.0, "S02", 4000.0)]
PATHS = [("P01", "Z0", "Z1", "L01", 900.0), ("P02", "Z0", "Z2", "L01;L02", 1200.0)]
COUNTED = {"L01": 2200.0, "L02": 1300.0}
MASK_SHARE = {"R1": 0.2, "R2": 0.3, "R3": 0.5}


def state_rows(spark: SparkSession, days: int = DAYS, panel: str = PANEL, scale: float = 1.0, first: datetime = FIRST_DAY) -> DataFrame:
    """Unmasked states on a 5-minute grid: slow in hours 8 and 9; flows are multiplied by ``scale``."""
    links = spark.createDataFrame([(x[0], x[7], x[8] * scale) for x in LINKS], "link_id string, station_id string, flow double")
    last = first + timedelta(days=days) - timedelta(minutes=5)
    grid = spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last), F.expr("interval 5 minutes"))).alias("timestamp"))
    d = grid.crossJoin(F.broadcast(links))  # two links by definition
    values = {
        "corridor_id": F.lit(panel), "date": F.date_format("timestamp", "yyyy-MM-dd"), "milepost": F.lit(1.0), "direction": F.lit("N"), "speed_kmh": F.when(F.hour("timestamp").between(8, 9), 40.0).otherwise(95.0),
        "flow_vph": F.col("flow"), "occupancy": F.lit(0.2), "density_occ_linear_vehpkm": F.lit(30.0), "pct_observed": F.lit(100), "is_observed": F.lit(1), "is_imputed": F.lit(0), "is_score_eligible": F.lit(1), "is_missing": F.lit(0),
    }
    schema = SCHEMAS["mainline_states"]
    return d.withColumns(values).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def regime(ts) -> F.Column:
    return F.element_at(F.array(*[F.lit(m) for m in MASK_REGIMES]), (F.dayofmonth(ts) % 3 + 1).cast("int"))


def masked_rows(states: DataFrame) -> DataFrame:
    """States whose masked cells, chosen by a hash of their key, and hour 12 lack measurements."""
    d = states.withColumn("mask_regime", regime(F.col("timestamp")))
    share = F.coalesce(*[F.when(F.col("mask_regime") == m, F.lit(s)) for m, s in MASK_SHARE.items()])
    hide = is_masked(share) | (F.hour("timestamp") == 12)
    gone = ["speed_kmh", "flow_vph", "occupancy", "density_occ_linear_vehpkm"]
    return d.withColumns({c: F.when(~hide, F.col(c)) for c in gone})


def is_masked(share) -> F.Column:
    return uniform(F.lit(42), F.unix_timestamp("timestamp"), F.col("link_id")) < share


def _write_daily(d: DataFrame, folder: str, stem: str) -> None:
    """One file for each day, named by its date."""
    spark = d.sparkSession
    tmp = f"{folder}.tmp"
    days = [r["d"] for r in d.select(F.date_format("timestamp", "yyyy_MM_dd").alias("d")).distinct().collect()]
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop_path(spark, folder)[1]
    part = d.withColumn("__day", F.date_format("timestamp", "yyyy_MM_dd"))
    part.repartition(8, "__day").write.partitionBy("__day").parquet(tmp)
    fs.mkdirs(path(folder))
    for day in days:
        one = [s.getPath() for s in fs.listStatus(path(f"{tmp}/__day={day}")) if s.getPath().getName().endswith(".parquet")]
        fs.rename(one[0], path(f"{folder}/{stem}_{day}.parquet"))
    fs.delete(path(tmp), True)


def queue_windows(panel: str, split: str, family: str, days: Sequence[date]) -> list[tuple]:
    """Index rows of two forecast windows a day: before the slow hours and within them."""
    out = []
    for day in days:
        for condition, hour in (("queue_onset", 7), ("queue_ongoing", 9)):
            at = datetime(day.year, day.month, day.day, hour, 30)
            step = timedelta(minutes=5)
            out.append((f"{panel}_{split}_{day:%Y%m%d}_{hour}", panel, family, split, str(day), at, at - 12 * step, at, at + step, at + 6 * step, condition, 1.0, 1.0))
    return out


def make_fixture(spark: SparkSession, folder: str, days: int = DAYS, panels: Sequence[tuple[str, str]] = ((PANEL, FAMILY),), validation_days: int = 0, queue_days: int = 0) -> str:
    """Write the release below an empty or new folder and return it.

    All ``panels`` (name, family) share the ids of their links and paths, as
    ids are unique within a panel only; flows, counts and free speeds differ
    from the first to the next. The training split has ``days`` days from
    FIRST_DAY on, the validation split its first ``validation_days``;
    ``queue_days`` days of either have forecast windows.
    """
    p, fs = hadoop_path(spark, folder)
    if fs.exists(p) and fs.listStatus(p):
        raise ValueError("the folder isn't empty")
    cal = {s: {"start": f"{a}T00:00:00Z", "end_exclusive": f"{b}T00:00:00Z"} for s, (a, b) in SPLIT_DATES.items()}
    write_text(spark, json.dumps({"synthetic_calendar": cal}), f"{folder}/{CALENDAR}")
    write_text(spark, json.dumps({"panels": [{"corridor_id": n, "family_id": f} for n, f in panels]}), f"{folder}/{CORRIDORS}")
    parts = {"train": (FIRST_DAY, days)}
    if validation_days:
        parts["validation"] = (datetime.fromisoformat(SPLIT_DATES["validation"][0]), validation_days)
    for k, (panel, family) in enumerate(panels):
        _write_network(spark, folder, panel, 20.0 * k)
        for split, (first, length) in parts.items():
            _write_split(spark, folder, panel, family, split, state_rows(spark, length, panel, 1 / (1 + k), first), 1 / (1 + k), [(first + timedelta(days=i)).date() for i in range(min(queue_days, length))])
    return folder


RAMPS = [("R01", "OR", "L01"), ("R02", "FR", "L02")]


def _write_network(spark: SparkSession, folder: str, panel: str, faster: float) -> None:
    links = [(*x[:3], x[3] + faster, *x[4:7]) for x in LINKS]
    net = {
        "links": [x[:5] for x in links],
        "fd_parameters": links,
        "path_set": [p[:4] for p in PATHS],
        "path_link_incidence": [(link, p[0]) for p in PATHS for link in p[3].split(";")],
        "lwr_mainline_topology": [("L01", "", "L02", "R01", "", "", "1", 2, 1.0, 4000.0, 100.0, 0, "L01", 1, 2, 1, "S01", 0, 1, 0, 0, 100.0), ("L02", "L01", "", "", "R02", "1", "", 4, 1.0, 8000.0, 100.0, 1, "L02", 2, 3, 1, "S02", 1, 0, 0, 0, 100.0)],
        "ramp_attachment_map": RAMPS,
        "synthetic_ramp_attachment_map": [(f"SYN_RAMP_{r[0]}", *r[1:]) for r in RAMPS],
    }
    for name, rows in net.items():
        write_csv(spark.createDataFrame(rows, SCHEMAS[name]), f"{folder}/corridors/{panel}/network/{name}.csv")


def _write_split(spark: SparkSession, folder: str, panel: str, family: str, split: str, states: DataFrame, scale: float, window_days: Sequence[date]) -> None:
    """Daily states and the task tables of one panel and split; only the training split has unmasked states."""
    corridor = f"{folder}/corridors/{panel}/{split}"
    name = lambda pattern: f"{folder}/{pattern.format(panel=panel, split=split)}"
    if split == "train":
        _write_daily(states, f"{corridor}/mainline_states", "synthetic_mainline")
    _write_daily(masked_rows(states), f"{corridor}/mainline_states_masked", "synthetic_mainline")
    types = spark.createDataFrame(RAMPS, "ramp_link_id string, ramp_type string, link_id string")
    ramp = states.join(F.broadcast(types), "link_id").withColumn("flow_vph", F.lit(300.0))
    _write_daily(ramp.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS["ramp_states"].fields]), f"{corridor}/ramp_states", "synthetic_ramp")
    share = F.coalesce(*[F.when(regime(F.col("timestamp")) == m, F.lit(s)) for m, s in MASK_SHARE.items()])
    targets = states.where(is_masked(share)).select(F.lit(panel).alias("panel"), "timestamp", "station_id", "link_id", regime(F.col("timestamp")).alias("mask_regime"), F.lit(0.0).alias("speed_kmh"), F.lit(0.0).alias("flow_vph"))
    write_csv(targets, name(TEMPLATES["state"]))
    flows = [(panel, f"{split.upper()}_PM", p[0], p[1], p[2], p[4] * scale) for p in PATHS]
    for pattern in (PRIOR, TEMPLATES["odme"]):
        write_csv(spark.createDataFrame(flows, SCHEMAS["weak_prior"]), name(pattern))
    write_csv(spark.createDataFrame([(panel, k, v * scale) for k, v in COUNTED.items()], SCHEMAS["link_counts"]), name(COUNTS))
    if window_days:
        index = spark.createDataFrame(queue_windows(panel, split, family, window_days), SCHEMAS["queue_window_index"])
        write_csv(index, name(WINDOW_INDEX))
        step = F.expr("interval 5 minutes")
        seen = index.select("window_id", F.explode(F.sequence("history_start", F.col("history_end") - step, step)).alias("timestamp"))
        seen.join(states, "timestamp").select(*SCHEMAS["queue_history"].names).write.parquet(name(WINDOW_HISTORY))
        asked = index.select("window_id", F.explode(F.sequence("forecast_start", "forecast_end", step)).alias("timestamp")).withColumn("link_id", F.explode(F.array(*[F.lit(x[0]) for x in LINKS])))
        write_csv(asked.withColumn("queue_pred", F.lit(0)), name(TEMPLATES["queue"]))
