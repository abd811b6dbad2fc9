"""Scores on tables with known answers."""

import math

import pytest
from pyspark.sql import functions as F

from gridflow.operators import metrics, odme, predict, validate


def near(a, b, tol=1e-9):
    assert math.isclose(a, b, rel_tol=tol, abs_tol=tol), (a, b)


def test_two_windows_are_scored_apart(spark):
    d = spark.createDataFrame([("a", 1, 1, True), ("b", 1, 0, True)], "window_id string, queue_true int, queue_pred int, eligible boolean")
    assert {r["window_id"]: r["queue_proxy_iou"] for r in metrics.window_iou(d, ["window_id"]).collect()} == {"a": 1.0, "b": 0.0}


def test_overlap_ignores_ineligible_rows_and_empty_unions(spark):
    d = spark.createDataFrame([(1, 1, 1, True), (1, 0, 1, True), (1, 0, 1, False), (2, 0, 0, True)], "w int, queue_true int, queue_pred int, eligible boolean")
    assert {r["w"]: r["queue_proxy_iou"] for r in metrics.window_iou(d, ["w"]).collect()} == {1: 0.5, 2: 1.0}


def test_state_score_by_lane(spark):
    d = spark.createDataFrame([(f"R{i}", 90.0, 100.0, 2400.0, 2000.0, 4.0) for i in (1, 2, 3)], "mask_regime string, speed_kmh_pred double, speed_kmh double, flow_vph_pred double, flow_vph double, lanes double")
    for r in metrics.state_score(d, ["mask_regime"]).collect():
        near(r["flow_per_lane_rmse"], 100.0)
        near(r["state_score"], 0.54 * 0.6 + 0.46 * (1 - 100 / 600))
    with pytest.raises(Exception, match="number of lanes"):
        metrics.state_score(d.withColumn("lanes", F.lit(0.0)), ["mask_regime"]).collect()


def rows(spark):
    a = [("c", "train", "A", "f", "onset", 1.0)] * 20 + [("c", "train", "A", "f", "ongoing", 0.0), ("c", "train", "B", "f", "onset", 0.0)]
    return spark.createDataFrame(a, "case_id string, split string, panel string, family string, condition string, queue_proxy_iou double")


def test_hierarchy_weighs_groups_equally(spark):
    got = metrics.hierarchical_mean(rows(spark)).collect()
    assert [(r["metric"], r["value"]) for r in got] == [("queue_proxy_iou", 0.25)]
    for d in (rows(spark).repartition(7), rows(spark).union(rows(spark)), rows(spark).unionByName(rows(spark).withColumn("queue_proxy_iou", F.lit(float("nan"))))):
        assert metrics.hierarchical_mean(d).first()["value"] == 0.25


def test_hierarchy_mixes_metrics_and_refuses_null_keys(spark):
    d = rows(spark).withColumn("x_score", F.lit(2.0)).unionByName(rows(spark).withColumn("queue_proxy_iou", F.lit(None).cast("double")).withColumn("condition", F.lit(None).cast("string")).withColumn("x_score", F.lit(2.0)))
    assert {r["metric"]: r["value"] for r in metrics.hierarchical_mean(d).collect()} == {"queue_proxy_iou": 0.25, "x_score": 2.0}
    with pytest.raises(Exception, match="level of the hierarchy"):
        metrics.hierarchical_mean(rows(spark).withColumn("panel", F.lit(None).cast("string"))).collect()


def test_fd_component_of_a_perfect_and_an_empty_prediction(spark):
    schema = "mask_regime string, speed_kmh double, flow_vph double, lanes double, critical_density double, k_jam double, capacity_vph double, free_speed_kmh double"
    good = spark.createDataFrame([("R1", 100.0, 2000.0, 2.0, 40.0, 200.0, 4000.0, 100.0), ("R2", 20.0, 25.0 * 200 / 2.25, 2.0, 40.0, 200.0, 4000.0, 100.0)], schema)
    r = metrics.fd_component(good).first()
    near(r["fd_component_score"], 1.0)
    near(r["fd_relative_error_diagnostic"], 0.0)
    r = metrics.fd_component(good.withColumn("flow_vph", F.lit(10.0))).first()
    assert r["fd_component_score"] == 0.0 and r["low_flow_fraction_diagnostic"] == 1.0


def test_odme_score_of_the_truth(spark):
    inc = spark.createDataFrame([("L1", "P1"), ("L1", "P2"), ("L2", "P2"), ("L2", "P2")], "link_id string, path_id string")
    p = spark.createDataFrame([("P1", "Z1", 5.0), ("P2", "Z2", 7.0)], "path_id string, destination_zone string, path_flow double")
    counts = spark.createDataFrame([("L1", 12.0), ("L2", 7.0)], "link_id string, count double")
    prior = p.withColumn("path_flow", F.col("path_flow") * 2).drop("destination_zone")
    r = metrics.odme_score(p, counts, prior, inc, p.drop("destination_zone")).first()
    near(r["odme_synthetic_score"], 1.0)
    near(r["odme_prior_relative_movement"], 0.5)


def test_lwr_conservation_of_a_balanced_link(spark):
    d = spark.createDataFrame([(1, i, 10.0 + 2 * i, 30.0, 0.0, 6.0, 0.0) for i in range(5)], "link int, t int, vehicles double, inflow double, onflow double, outflow double, offflow double")
    near(metrics.lwr_conservation(d, ["link"], "t", 1 / 12).first()["lwr_conservation_score"], 1.0)


def two_networks(spark):
    """Panels A and B whose path P01 shares its name and uses other links."""
    inc = spark.createDataFrame([("A", "P01", "L01"), ("A", "P01", "L01"), ("B", "P01", "L09"), ("B", "P02", "L01")], "panel string, path_id string, link_id string")
    flows = spark.createDataFrame([("A", "P01", 100.0), ("B", "P01", 50.0), ("B", "P02", 7.0)], "panel string, path_id string, path_flow double")
    return inc, flows


def test_paths_meet_links_of_their_own_panel(spark):
    inc, flows = two_networks(spark)
    got = {(r["panel"], r["link_id"]): r["modelled"] for r in metrics.matvec(inc, flows).collect()}
    assert got == {("A", "L01"): 100.0, ("B", "L09"): 50.0, ("B", "L01"): 7.0}
    counts = spark.createDataFrame([("A", "L01", 100.0), ("B", "L09", 50.0), ("B", "L01", 14.0)], "panel string, link_id string, count double")
    r = {x["panel"]: x["odme_link_score_diagnostic"] for x in metrics.odme_score(flows.withColumn("destination_zone", F.lit("z")), counts, flows, inc, by=["panel"]).collect()}
    assert r["A"] == 1.0 and abs(r["B"] - (1 - 7 / 64)) < 1e-12
    with pytest.raises(ValueError, match="by panel"):
        metrics.odme_score(flows, counts, flows, inc)


def test_scenarios_and_estimates_keep_panels_apart(spark):
    inc, flows = two_networks(spark)
    truth, counts = odme.synthetic_scenarios(flows, inc, 2, 1, 0.0, 0.0)
    assert {(r["panel"], r["link_id"], r["count"]) for r in counts.collect()} == {("A", "L01", 100.0), ("B", "L09", 50.0), ("B", "L01", 7.0)} and truth.count() == 6
    measured = counts.where("scenario = 1").select("panel", "link_id", (F.col("count") * 2).alias("count"))
    got = {(r["panel"], r["path_id"]): r["path_flow"] for r in odme.estimate_flows(flows, measured, inc, ["panel"], 1e-9).collect()}
    for k, v in {("A", "P01"): 200.0, ("B", "P01"): 100.0, ("B", "P02"): 14.0}.items():
        near(got[k], v, 1e-6)
    with pytest.raises(ValueError, match="by panel"):
        odme.estimate_flows(flows.drop("panel"), measured.drop("panel"), inc, [])


def test_a_valid_pair_of_panels_has_no_violation(spark):
    inc, flows = two_networks(spark)
    counts = spark.createDataFrame([("A", "L01"), ("B", "L09")], "panel string, link_id string")
    bad = counts.union(spark.createDataFrame([("A", "L09")], counts.schema))
    assert {r["n"] for r in validate.incidence_violations(inc, flows, counts).collect()} == {0}
    assert {r["violation"]: r["n"] for r in validate.incidence_violations(inc, flows.union(flows.where("panel = 'A'")), bad).collect()} == {"duplicate_path": 1, "unknown_path": 0, "link_without_path": 1}


def test_queue_persistence_takes_the_panel_s_free_speed(spark):
    h = spark.sql("select 'A' as panel, 'w' as window_id, timestamp'2024-01-01 00:00:00' as timestamp, 'L' as link_id, 50.0D as speed_kmh, 100L as pct_observed union all select 'B', 'v', timestamp'2024-01-01 00:00:00', 'L', 50.0D, 100L")
    links = spark.createDataFrame([("A", "L", 60.0), ("B", "L", 120.0)], "panel string, link_id string, free_speed_kmh double")
    t = spark.createDataFrame([("w", "L", 0), ("v", "L", 0)], "window_id string, link_id string, queue_pred long")
    assert {r["window_id"]: r["queue_pred"] for r in predict.queue_persistence(h, t, links).collect()} == {"w": 0, "v": 1}
    with pytest.raises(Exception, match="repeated key"):
        predict.queue_persistence(h, t, links.union(links)).collect()
    with pytest.raises(ValueError, match="panel"):
        predict.queue_persistence(h.drop("panel"), t, links)


def test_nulls_and_windows_without_eligible_cells_raise(spark):
    d = spark.createDataFrame([(1, 1, 1, False)], "w int, queue_true int, queue_pred int, eligible boolean")
    assert metrics.window_iou(d, ["w"]).count() == 0
    with pytest.raises(Exception, match="no eligible cell"):
        metrics.window_iou(d, ["w"], strict=True).collect()
    fd = spark.createDataFrame([("R1", 50.0, None, 2.0, 40.0, 200.0, 4000.0, 100.0)], "mask_regime string, speed_kmh double, flow_vph double, lanes double, critical_density double, k_jam double, capacity_vph double, free_speed_kmh double")
    with pytest.raises(Exception, match="is null"):
        metrics.fd_component(fd).collect()


def test_overall_score_weighs_the_tasks():
    near(metrics.overall_score({"state": 1.0, "queue": 0.5, "physics": 0.0, "odme": 1.0}), 0.7)
    with pytest.raises(ValueError):
        metrics.overall_score({"state": 1.0})


def test_hierarchy_has_a_finer_first_level_and_refuses_its_null_key(spark):
    d = rows(spark).withColumn("condition", F.when(F.col("panel") == "B", F.lit(None)).otherwise(F.col("condition")))
    with pytest.raises(Exception, match="level of the hierarchy"):
        metrics.hierarchical_mean(d).collect()
