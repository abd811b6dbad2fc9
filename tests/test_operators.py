"""Relational, series, label, window, path-flow and contract operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridflow.functions import all_true, any_true, half_open, hash_seed, is_finite, normal, not_negative, week_slot
from gridflow.operators import labels, odme, predict, rel, series, submit, validate, windows


def values(d, *cols):
    return sorted(tuple(r) for r in d.select(*cols).collect())


def test_expressions(spark):
    d = spark.createDataFrame([(1.0, True), (None, None), (float("nan"), False), (float("-inf"), None), (-2.0, True)], "x double, b boolean")
    assert [r[0] for r in d.select(is_finite(F.col("x"))).collect()] == [True, False, False, False, True]
    assert d.select(F.min(not_negative(F.col("x"))).alias("x")).first()[0] == 0.0 and d.where("x is null").select(not_negative(F.col("x"))).first()[0] is None
    n = d.where("b is null")
    assert tuple(n.agg(all_true(F.col("b")), all_true(F.col("b"), False), any_true(F.col("b"))).first()) == (False, True, False)
    assert d.where(half_open(F.col("x"), -2, 1)).count() == 1
    t = spark.createDataFrame([("2024-01-01 00:04:59",), ("2024-01-07 23:59:00",)], "t string").select(week_slot(F.col("t").cast("timestamp")).alias("s"))
    assert [r[0] for r in t.collect()] == [0, 7 * 288 - 1]
    import hashlib

    assert spark.range(1).select(hash_seed(F.lit("a"), F.lit("b"))).first()[0] == int(hashlib.sha256(b"a|b").hexdigest()[:8], 16)
    z = np.array([r[0] for r in spark.range(4000).select(normal(F.col("id"))).collect()])
    assert abs(z.mean()) < 0.06 and abs(z.std() - 1) < 0.05


def test_keys_are_normalised(spark):
    d = spark.createDataFrame([(7, "2024-01-01T00:00:00Z"), (None, "2024-01-01T02:00:00+02:00")], "panel int, timestamp string")
    n = rel.canonical_keys(rel.normalize_keys(d, ["panel", "timestamp"]), ["panel", "timestamp"])
    assert [tuple(r) for r in n.collect()] == [("7", "2024-01-01T00:00:00Z"), (None, "2024-01-01T00:00:00Z")]


def test_unique_join_raises_on_repeats(spark):
    a = spark.createDataFrame([(1,), (2,)], "k int")
    b = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    assert values(rel.join_unique(a, b.limit(1), ["k"]), "k", "v") == [(1, "x"), (2, None)]
    with pytest.raises(Exception, match="repeated key"):
        rel.join_unique(a, b, ["k"]).collect()


def test_redaction_keeps_rows_and_other_columns(spark):
    d = spark.createDataFrame([(1, 2.0, "a"), (2, 3.0, "b"), (None, 4.0, "c")], "k int, v double, w string")
    h = spark.createDataFrame([(1,), (1,), (None,)], "k int")
    assert sorted(rel.redact_rows(d, h, ["k"], ["v", "zz"]).collect(), key=lambda r: r["w"]) == [(1, None, "a"), (2, 3.0, "b"), (None, 4.0, "c")]
    assert rel.redact_rows(d, h, ["k"], ["zz"]) is d


def test_interpolation_is_by_position(spark):
    x = [None, 10.0, None, None, 40.0, None]
    d = spark.createDataFrame([(1, i * i, v) for i, v in enumerate(x)] + [(2, 0, None)], "g int, t int, v double").repartition(3)
    got = {(r["g"], r["t"]): r["o"] for r in series.interpolate(d, "v", ["g"], "t", "o").collect()}
    assert [got[1, i * i] for i in range(6)] == [10, 10, 20, 30, 40, 40] and got[2, 0] is None


def test_grid_and_frames(spark):
    d = spark.sql("select 1 as e, timestamp'2024-01-01 00:00:00' as t, 5 as v union all select 2, timestamp'2024-01-01 00:20:00', 6")
    g = series.densify_grid(d, "e", "t", "5 minutes")
    assert g.count() == 10 and g.where("v is not null").count() == 2
    n = g.withColumn("n", F.count("*").over(series.history_frame(["e"], "t", 2))).agg(F.sum("n")).first()[0]
    assert n == 2 * (0 + 1 + 2 + 2 + 2)


def test_queue_labels_need_every_detector(spark):
    s = spark.createDataFrame([(1, "L01", 40.0, 100), (1, "L02", 40.0, 100), (1, "L02", 40.0, 50), (2, "L01", 90.0, 100)], "timestamp int, link_id string, speed_kmh double, pct_observed int")
    links = spark.createDataFrame([("L01", 100.0), ("L02", 100.0)], "link_id string, free_speed_kmh double")
    t = s.select("timestamp", "link_id").distinct().unionByName(spark.createDataFrame([(3, "L01")], "timestamp int, link_id string"))
    got = {(r[0], r[1]): (r[2], r[3]) for r in labels.queue_labels(t, s, links).select("timestamp", "link_id", "queue_true", "eligible").collect()}
    assert got == {(1, "L01"): (1, True), (1, "L02"): (0, False), (2, "L01"): (0, True), (3, "L01"): (0, False)}
    assert labels.link_conditions(s.withColumn("pct_observed", F.lit(None).cast("int"))).where("all_eligible").count() == 0


def test_only_complete_windows(spark):
    d = spark.createDataFrame([("a", 1), ("a", 5), ("b", 5), ("b", 10), ("c", 0)], "w string, t int")
    assert {r["w"] for r in labels.complete_windows(d, "w", "t", 1, 10).collect()} == {"a"}


def test_window_candidates_and_spacing(spark):
    rules = windows.WindowRules(per_condition=2, spacing_minutes=60)
    g = spark.sql("select 'P' as panel, 'L' as link_id, explode(sequence(timestamp'2024-01-01', timestamp'2024-01-03', interval 5 minutes)) as timestamp")
    g = g.withColumns({"queued": F.hour("timestamp").isin(8, 9).cast("int"), "eligible": F.lit(1)})
    c = windows.candidates(g, rules)
    kinds = {r["condition"]: r["count"] for r in c.groupBy("condition").count().collect()}
    assert set(kinds) == {"queue_onset", "queue_ongoing"}
    onset = c.where("condition = 'queue_onset' and timestamp < '2024-01-02'").agg(F.date_format(F.min("timestamp"), "HH:mm").alias("a"), F.date_format(F.max("timestamp"), "HH:mm").alias("b")).first()
    assert tuple(onset) == ("07:30", "08:05")
    s = windows.sample_spaced(c, rules).collect()
    again = windows.sample_spaced(c.repartition(5), rules).collect()
    assert sorted(s) == sorted(again) and len(s) == 4
    by = {}
    for r in s:
        by.setdefault(r["condition"], []).append(r["timestamp"])
    assert all(abs((a - b).total_seconds()) >= 3600 for a, b in by.values())


def test_path_flow_estimate(spark):
    """Two paths whose normal equations can be solved by hand, and a problem with active bounds against a projected-gradient solution."""
    f = odme.solve(np.array([[1.0, 1.0], [0.0, 1.0]]), np.array([2200.0, 1300.0]), np.array([900.0, 1200.0]), 0.05)
    assert np.allclose(f, [904.338, 1295.445], atol=0.01)
    r = np.random.default_rng(1)
    a, c, b = r.random((8, 20)), r.random(8) * 5 - 3, r.random(20)
    x = odme.solve(a, c, b, 0.05)
    y, h, g = np.zeros(20), a.T @ a + 0.05 * np.eye(20), a.T @ c + 0.05 * b
    for _ in range(20000):
        y = np.maximum(0, y - (h @ y - g) / np.linalg.norm(h, 2))
    assert np.allclose(x, y, atol=1e-5) and (x == 0).any()
    inc = spark.createDataFrame([("L01", "P01"), ("L01", "P02"), ("L02", "P02")], "link_id string, path_id string")
    prior = spark.createDataFrame([("A", "P01", 900.0), ("A", "P02", 1200.0)], "panel string, path_id string, path_flow double")
    counts = spark.createDataFrame([("A", "L01", 2200.0), ("A", "L02", 1300.0)], "panel string, link_id string, count double")
    got = {r["path_id"]: r["path_flow"] for r in odme.estimate_flows(prior, counts, inc, ["panel"]).collect()}
    assert abs(got["P01"] - 904.338) < 0.01 and abs(got["P02"] - 1295.445) < 0.01


def test_scenarios_are_repeatable(spark):
    inc = spark.createDataFrame([("L1", f"P{i}") for i in range(20)], "link_id string, path_id string")
    prior = spark.createDataFrame([(f"P{i}", 10.0) for i in range(20)], "path_id string, path_flow double")
    a, b = (sorted(odme.synthetic_scenarios(p, inc, 2, 5)[0].collect()) for p in (prior, prior.repartition(6)))
    assert a == b and len({r["path_flow"] for r in a}) == 40
    assert odme.synthetic_scenarios(prior, inc, 0, 5)[0].count() == 0


def targets(spark):
    return spark.createDataFrame([("w", 1, "a", 0), ("w", 1, "b", 0)], "window_id string, timestamp int, link_id string, queue_pred int")


@pytest.mark.parametrize(
    "damage, kind",
    [("link_id = 'a'", "missing"), (None, None), ("twice", "duplicate"), ("other", "extra"), ("nan", "non_finite"), ("half", "non_binary"), ("null", "null_key")],
)
def test_predictions_are_checked(spark, damage, kind):
    p = targets(spark).withColumn("queue_pred", F.col("queue_pred").cast("double"))
    if damage == "twice":
        p = p.union(p.limit(1))
    elif damage == "other":
        p = p.union(p.limit(1).withColumn("link_id", F.lit("z")))
    elif damage == "null":
        p = p.union(p.limit(1).withColumn("link_id", F.lit(None).cast("string")))
    elif damage == "nan":
        p = p.withColumn("queue_pred", F.lit(float("nan")))
    elif damage == "half":
        p = p.withColumn("queue_pred", F.lit(0.5))
    elif damage:
        p = p.where(damage)
    found = {r["violation"] for r in validate.task_violations(p, targets(spark), "queue").where("n > 0").collect()}
    assert (kind in found) if kind else not found
    if kind:
        with pytest.raises(validate.ContractError, match=kind):
            validate.require_valid(validate.task_violations(p, targets(spark), "queue"), "queue")


def submission(spark):
    ts = "2024-01-01T00:00:00Z"
    t = spark.createDataFrame([("1", "state", "train", "A", ts, "S", "L", "R1", *["-"] * 5), ("2", "queue", "train", "-", ts, "-", "L", "-", "w", *["-"] * 4), ("3", "odme", "train", "A", *["-"] * 5, "am", "P", "Z0", "Z1")], "submission_id string, task string, split string, panel string, timestamp string, station_id string, link_id string, mask_regime string, window_id string, departure_time string, path_id string, origin_zone string, destination_zone string")
    p = {
        "state": spark.createDataFrame([("A", ts, "S", "L", "R1", 90.0, 2000.0)], "panel string, timestamp string, station_id string, link_id string, mask_regime string, speed_kmh double, flow_vph double").withColumn("timestamp", F.to_timestamp("timestamp")),
        "queue": spark.createDataFrame([("w", ts, "L", "1")], "window_id string, timestamp string, link_id string, queue_pred string"),
        "odme": spark.createDataFrame([("A", "am", "P", "Z0", "Z1", 25.0)], "panel string, departure_time string, path_id string, origin_zone string, destination_zone string, path_flow double"),
    }
    return t, p


def test_submission_is_assembled_and_published_once(spark, tmp_path):
    t, p = submission(spark)
    out = str(tmp_path / "s")
    submit.write_submission(t, p, out)
    got = sorted(tuple(r) for r in spark.read.option("header", True).schema("submission_id string, task string, speed_kmh double, flow_vph double, queue_pred double, path_flow double").csv(out).collect())
    assert got == [("1", "state", 90.0, 2000.0, 0.0, 0.0), ("2", "queue", 0.0, 0.0, 1.0, 0.0), ("3", "odme", 0.0, 0.0, 0.0, 25.0)]
    with pytest.raises(validate.ContractError, match="exists"):
        submit.write_submission(t, p, out)
    backwards = t.orderBy(F.desc("submission_id")).coalesce(1)
    submit.write_submission(backwards, p, out + ".csv")
    submit.write_submission(backwards, p, out + ".parts", one_file=False)
    assert [x.split(",")[0] for x in open(out + ".csv").read().split()] == ["submission_id", "3", "2", "1"]
    assert [r["submission_id"] for r in spark.read.option("header", True).csv(out + ".parts").collect()] == ["3", "2", "1"]


@pytest.mark.parametrize("damage", ["missing", "extra", "twice", "zone", "negative", "text"])
def test_damaged_predictions_publish_nothing(spark, tmp_path, damage):
    t, p = submission(spark)
    o = p["odme"]
    p["odme"] = {"missing": o.where("false"), "extra": o.union(o.withColumn("path_id", F.lit("Q"))), "twice": o.union(o), "zone": o.withColumn("origin_zone", F.lit("Z9")), "negative": o.withColumn("path_flow", F.lit(-1.0)), "text": o.withColumn("path_flow", F.lit("x"))}[damage]
    with pytest.raises(Exception):
        submit.write_submission(t, p, str(tmp_path / "s"))
    assert not (tmp_path / "s").exists() and not (tmp_path / "s.staged").exists()


@pytest.mark.parametrize("damage, kind", [("empty", "empty_id"), ("twice", "duplicate"), ("less", "missing"), ("task", "wrong_task"), ("nan", "non_finite"), ("half", "non_binary"), ("unused", "unused_not_zero"), ("none", "no_rows")])
def test_damaged_submissions_are_found(spark, damage, kind):
    t, p = submission(spark)
    s = submit.assemble(t, p)
    s = {
        "empty": s.withColumn("submission_id", F.lit("")), "twice": s.union(s), "less": s.limit(2), "task": s.withColumn("task", F.lit("queue")), "nan": s.withColumn("flow_vph", F.lit(float("nan"))),
        "half": s.withColumn("queue_pred", F.lit(0.5)), "unused": s.withColumn("path_flow", F.lit(3.0)), "none": s.where("false"),
    }[damage]
    assert kind in {r["violation"] for r in validate.submission_violations(s, t).where("n > 0").collect()}


def test_predictors_refuse_unknown_names_and_parameters():
    with pytest.raises(ValueError, match="no predictor"):
        predict.predictor("nobody")
    with pytest.raises(ValueError, match="parameters"):
        predict.predictor("baseline", {"x": 1})
    with pytest.raises(ValueError, match="blend"):
        predict.interpolate_blend(None, None, blend=2)


def test_profile_falls_back_from_slot_to_link_to_panel(spark):
    s = spark.sql("select 'A' as panel, 'L1' as link_id, timestamp'2024-01-01 00:00:00' as timestamp, 10.0D as v union all select 'A', 'L1', timestamp'2024-01-01 01:00:00', 20.0D union all select 'A', 'L2', timestamp'2024-01-01 01:00:00', -90.0D")
    t = spark.sql("select 'A' as panel, 'L1' as link_id, timestamp'2024-01-08 00:00:00' as timestamp union all select 'A', 'L1', timestamp'2024-01-09 00:00:00' union all select 'A', 'L3', timestamp'2024-01-09 00:00:00'")
    got = values(predict.weekly_profile(s, t, ["v"], panel=("panel",)), "link_id", "v")
    assert got == [("L1", 10.0), ("L1", 15.0), ("L3", 0.0)]


def test_stream_of_link_conditions(spark, tmp_path):
    from gridflow.streaming.conditions import stream_link_conditions

    schema = "timestamp timestamp, link_id string, speed_kmh double, pct_observed int"
    rows = [("2024-01-01 00:01:00", "L", 40.0, 100), ("2024-01-01 00:04:00", "L", 60.0, 100), ("2024-01-01 02:00:00", "L", 90.0, 50)]
    spark.createDataFrame(rows, "timestamp string, link_id string, speed_kmh double, pct_observed int").withColumn("timestamp", F.to_timestamp("timestamp")).write.parquet(str(tmp_path / "in"))
    links = spark.createDataFrame([("L", 100.0)], "link_id string, free_speed_kmh double")
    q = stream_link_conditions(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), links).writeStream.format("memory").queryName("conditions").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("conditions").collect()
    assert [(r["n"], r["mean_speed"], r["queue_true"]) for r in got] == [(2, 50.0, 1)]
