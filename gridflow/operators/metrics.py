"""Scores of predictions and their equal-weight hierarchy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridflow.functions import is_finite

MASK_REGIMES = ("R1", "R2", "R3")
SPEED_SCALE, FLOW_SCALE, SPEED_WEIGHT, FLOW_WEIGHT = 25.0, 600.0, 0.54, 0.46
EMPTY_FLOW, MOST_EMPTY = 50.0, 0.2
ODME_WEIGHTS = {"path": 0.45, "link": 0.25, "deviation": 0.15, "attraction": 0.15}
METRIC_ENDINGS = ("score", "iou", "diagnostic", "movement", "rmse")


def at_least_zero(c: Column) -> Column:
    return F.greatest(F.lit(0.0), c)


def checked_lanes(c: Column) -> Column:
    return F.when(c.isNull() | (c <= 0), F.raise_error(F.lit("a link has no positive number of lanes")).cast("double")).otherwise(c)


def state_rmse(d: DataFrame, by: Sequence[str], speed=("speed_kmh_pred", "speed_kmh"), flow=("flow_vph_pred", "flow_vph"), lanes: str = "lanes") -> DataFrame:
    """Rows, RMSE of speed and of flow by lane, for each group."""
    dv, dq = F.col(speed[0]) - F.col(speed[1]), (F.col(flow[0]) - F.col(flow[1])) / checked_lanes(F.col(lanes))
    return d.groupBy(*by).agg(F.count("*").alias("n"), F.sqrt(F.avg(dv * dv)).alias("speed_rmse"), F.sqrt(F.avg(dq * dq)).alias("flow_per_lane_rmse"))


def state_score(d: DataFrame, by: Sequence[str], flow_scale: float = FLOW_SCALE, **columns) -> DataFrame:
    """``state_rmse`` with the weighted score, by regime among others."""
    r = state_rmse(d, by, **columns)
    return r.withColumn("state_score", SPEED_WEIGHT * at_least_zero(1 - F.col("speed_rmse") / SPEED_SCALE) + FLOW_WEIGHT * at_least_zero(1 - F.col("flow_per_lane_rmse") / flow_scale))


def fd_component(d: DataFrame, by: Sequence[str] = (), regime: str = "mask_regime", speed: str = "speed_kmh", flow: str = "flow_vph", empty_flow: float = EMPTY_FLOW) -> DataFrame:
    """Agreement of predictions with each link's triangular flow-density diagram, averaged over regimes, and three diagnostics.

    ``d`` has the predictions with lanes, critical_density, capacity_vph, k_jam
    and free_speed_kmh of their link. By-lane quantities give the score, link
    totals the relative-error diagnostic; both come from one aggregate.
    """
    q, v, lanes = F.col(flow), F.col(speed), F.col("lanes")
    k, kc, kj, cap, free = q / F.greatest(v, F.lit(1.0)), F.col("critical_density"), F.col("k_jam"), F.col("capacity_vph"), F.col("free_speed_kmh")

    def expected(per: Column) -> Column:
        wave = (cap / per) / F.greatest(kj / per - kc / per, F.lit(1e-9))
        return F.when(k / per <= kc / per, free * (k / per)).otherwise(wave * F.greatest(kj / per - k / per, F.lit(0.0)))

    # a missing number must not shrink a sum
    missing = q.isNull() | v.isNull()
    q = F.when(missing, F.raise_error(F.lit("a predicted speed or flow is null")).cast("double")).otherwise(q)
    one = F.lit(1.0)
    parts = d.groupBy(*by, regime).agg(
        F.sum(F.abs(q / lanes - expected(lanes))).alias("lane_off"), F.sum(F.abs(q / lanes)).alias("lane_all"),
        F.sum(F.abs(q - expected(one))).alias("off"), F.sum(F.abs(q)).alias("all"),
        F.count("*").alias("rows"), F.sum((q < empty_flow).cast("long")).alias("low"), F.sum(((q < 0) | (v < 0)).cast("long")).alias("negative"),
    )
    score = F.when(F.col("low") / F.col("rows") > MOST_EMPTY, 0.0).otherwise(at_least_zero(1 - F.col("lane_off") / F.greatest(F.col("lane_all"), F.lit(1e-9))))
    return parts.withColumn("s", score).groupBy(*by).agg(
        F.avg("s").alias("fd_component_score"), (F.sum("off") / F.greatest(F.sum("all"), F.lit(1e-9))).alias("fd_relative_error_diagnostic"),
        (F.sum("low") / F.sum("rows")).alias("low_flow_fraction_diagnostic"), (F.sum("negative") / F.sum("rows")).alias("negative_state_fraction_diagnostic"),
    )


def window_iou(d: DataFrame, by: Sequence[str], truth: str = "queue_true", pred: str = "queue_pred", eligible: str = "eligible", strict: bool = False) -> DataFrame:
    """Overlap of queued cells among eligible rows, for all windows in one aggregate; 1 where neither has any.

    A window without eligible rows has no row here; with ``strict`` it raises.
    """
    t, p = F.col(truth) == 1, F.col(pred) == 1
    rows = d.where(F.col(eligible).cast("boolean"))
    if strict:
        e = F.coalesce(F.col(eligible).cast("boolean"), F.lit(False))
        t, p, rows = t & e, p & e, d.withColumn(eligible, e)
        g = rows.groupBy(*by).agg(F.sum(F.col(eligible).cast("long")).alias("n"), F.sum((t & p).cast("long")).alias("both"), F.sum((t | p).cast("long")).alias("either"))
        none = F.raise_error(F.concat(F.lit("no eligible cell in "), F.concat_ws(", ", *[F.col(k).cast("string") for k in by]))).cast("long")
        return g.select(*by, F.when(F.col("n") == 0, none).otherwise(F.col("n")).alias("n"), F.when(F.col("either") == 0, 1.0).otherwise(F.col("both") / F.col("either")).alias("queue_proxy_iou"))
    g = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum((t & p).cast("long")).alias("both"), F.sum((t | p).cast("long")).alias("either"))
    return g.select(*by, "n", F.when(F.col("either") == 0, 1.0).otherwise(F.col("both") / F.col("either")).alias("queue_proxy_iou"))


def relative_l1(a: Column, b: Column) -> Column:
    """Aggregate: sum |a - b| over the sum of b."""
    return F.sum(F.abs(a - b)) / F.greatest(F.sum(b), F.lit(1e-9))


def network_keys(*tables: DataFrame) -> list[str]:
    """``panel`` where all tables have it: ids of links and paths are unique within a panel only."""
    return ["panel"] if all("panel" in t.columns for t in tables) else []


def matvec(incidence: DataFrame, flows: DataFrame, by: Sequence[str] = (), flow: str = "path_flow", out: str = "modelled") -> DataFrame:
    """Link totals of path flows: distinct incidence rows joined by path and summed by link.

    Where both tables have a column panel, paths meet links of their own panel
    and totals are by panel as well.
    """
    panel = network_keys(incidence, flows)
    pairs = incidence.select(*panel, "path_id", "link_id").distinct()
    return pairs.join(flows, [*panel, "path_id"]).groupBy(*dict.fromkeys([*by, *panel]), "link_id").agg(F.sum(flow).alias(out))


def odme_score(pred: DataFrame, counts: DataFrame, prior: DataFrame, incidence: DataFrame, truth: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Count fit and prior movement of path flows; with ``truth`` the weighted synthetic score.

    pred (by, path_id, destination_zone, path_flow), counts (by, link_id,
    count), prior and truth (by, path_id, path_flow). All matching is by key;
    with several panels ``by`` holds panel, which no table may lack then.
    """
    by, key = list(by), [*by, "path_id"]
    for t in (pred, counts, prior, incidence) if truth is None else (pred, counts, prior, incidence, truth):
        if "panel" in t.columns and "panel" not in by:
            raise ValueError("tables with a column panel are scored by panel")
    p = pred.join(prior.select(*key, F.col("path_flow").alias("prior")), key)
    links = counts.join(matvec(incidence, pred.select(*key, "path_flow"), by), [*by, "link_id"], "left")
    fit = links.groupBy(*by).agg(at_least_zero(1 - relative_l1(F.coalesce("modelled", F.lit(0.0)), F.col("count"))).alias("odme_link_score_diagnostic"))
    if truth is not None:
        p = p.join(truth.select(*key, F.col("path_flow").alias("true")), key)
    aggs = [relative_l1(F.col("path_flow"), F.col("prior")).alias("odme_prior_relative_movement")]
    if truth is not None:
        moved, should = F.sum(F.abs(F.col("path_flow") - F.col("prior"))), F.sum(F.abs(F.col("true") - F.col("prior")))
        aggs += [at_least_zero(1 - relative_l1(F.col("path_flow"), F.col("true"))).alias("path_score"), F.exp(-F.abs(moved / F.greatest(should, F.lit(1e-9)) - 1)).alias("deviation_score")]
    m = p.groupBy(*by).agg(*aggs)
    out = _join(fit, m, by)
    if truth is None:
        return out
    out = _join(out, attraction_score(p, by), by)
    w = ODME_WEIGHTS
    total = w["path"] * F.col("path_score") + w["link"] * F.col("odme_link_score_diagnostic") + w["deviation"] * F.col("deviation_score") + w["attraction"] * F.col("attraction_score")
    return out.select(*by, "odme_link_score_diagnostic", "odme_prior_relative_movement", total.alias("odme_synthetic_score"))


def attraction_score(d: DataFrame, by: Sequence[str] = (), zone: str = "destination_zone", flow: str = "path_flow", true: str = "true") -> DataFrame:
    """1 less half the L1 distance between predicted and true shares of the destinations."""
    z = d.groupBy(*by, zone).agg(F.sum(flow).alias("p"), F.sum(true).alias("t"))
    total = z.groupBy(*by).agg(F.sum("p").alias("ps"), F.sum("t").alias("ts"))
    off = F.sum(F.abs(F.col("p") / F.greatest(F.col("ps"), F.lit(1e-9)) - F.col("t") / F.greatest(F.col("ts"), F.lit(1e-9))))
    return _join(z, total, list(by)).groupBy(*by).agg(at_least_zero(1 - off / 2).alias("attraction_score"))


def _join(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join by keys; without keys ``b`` is one row of totals."""
    return a.join(b, list(by)) if by else a.crossJoin(F.broadcast(b))


def metric_columns(d: DataFrame) -> list[str]:
    return [c for c in d.columns if c.endswith(METRIC_ENDINGS)]


def hierarchical_mean(d: DataFrame, levels: Sequence[Sequence[str]] = (("case_id", "split", "panel", "family"), ("case_id", "split", "family"), ("case_id", "split"), ()), metrics: Sequence[str] | None = None, first_levels: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """(metric, value): means of means from the finest level to the last, every group weighing the same.

    Values that are no finite number are left out; a null key of a value that
    counts raises. All metrics go through as rows of one long table.
    ``first_levels`` names a finer first level for single metrics.
    """
    metrics = list(metrics or metric_columns(d))
    first_levels = first_levels if first_levels is not None else {"queue_proxy_iou": ("case_id", "split", "panel", "family", "condition")}
    finest = list(dict.fromkeys([*levels[0], *(k for m in metrics for k in first_levels.get(m, ()))]))
    there = [k for k in finest if k in d.columns]
    long = d.select(*there, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("string").try_cast("double").alias("value")) for m in metrics])).alias("x")).select(*there, "x.*").where(is_finite(F.col("value")))
    missing = F.lit(False)
    for k in levels[0]:
        missing = missing | F.col(k).isNull()
    long = long.withColumn("value", F.when(missing, F.raise_error(F.concat(F.lit("a level of the hierarchy is null for "), F.col("metric"))).cast("double")).otherwise(F.col("value")))
    extra = {m: [k for k in ks if k not in levels[0]] for m, ks in first_levels.items() if m in metrics}
    names = sorted({k for ks in extra.values() for k in ks})
    if names:
        # other metrics skip the finer level: each of their rows is a group of its own
        own = [F.when(F.col("metric").isin([m for m, ks in extra.items() if k in ks]), F.when(F.col(k).isNull(), F.raise_error(F.concat(F.lit("a level of the hierarchy is null for "), F.col("metric"))).cast("string")).otherwise(F.col(k).cast("string"))).alias(k) for k in names]
        long = long.select(*levels[0], "metric", "value", *own)
        fine, plain = long.where(F.col("metric").isin(*extra)), long.where(~F.col("metric").isin(*extra)).select(*levels[0], "metric", "value")
        long = fine.groupBy("metric", *levels[0], *names).agg(F.avg("value").alias("value")).select(*levels[0], "metric", "value").unionByName(plain)
    for i, keys in enumerate(levels):
        long = long.groupBy("metric", *keys).agg(F.avg("value").alias("value"))
        if not i:  # a row for each panel and metric is left: further levels need no exchange
            long = long.coalesce(1)
    if levels[-1]:
        long = long.groupBy("metric").agg(F.avg("value").alias("value"))
    return long.select("metric", "value")


def lwr_conservation(d: DataFrame, by: Sequence[str], order: str, hours: float) -> DataFrame:
    """Extension: residual of dN = dt (in + on - out - off) along each link, over the sum of |dN|.

    ``d`` has vehicles, inflow, onflow, outflow and offflow for each step.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(order)
    change = F.lead("vehicles").over(w) - F.col("vehicles")
    r = d.withColumn("change", change).where("change is not null").withColumn("r", F.col("change") - hours * (F.col("inflow") + F.col("onflow") - F.col("outflow") - F.col("offflow")))
    return r.groupBy(*by).agg(at_least_zero(1 - F.sum(F.abs("r")) / F.greatest(F.sum(F.abs("change")), F.lit(1e-9))).alias("lwr_conservation_score"))


OVERALL_WEIGHTS = {"state": 0.35, "queue": 0.30, "physics": 0.15, "odme": 0.20}


def overall_score(scores: dict[str, float]) -> float:
    """Extension: the documented weights of the four tasks; a missing or further task raises."""
    if set(scores) != set(OVERALL_WEIGHTS):
        raise ValueError(f"scores must be those of {sorted(OVERALL_WEIGHTS)}")
    return sum(w * scores[k] for k, w in OVERALL_WEIGHTS.items())
