"""Release reader and lifecycle on the synthetic release."""

import json
from datetime import date, datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gridflow import cli
from gridflow.operators import predict, validate
from gridflow.plans import lifecycle, shards
from gridflow.sources import fixture, release
from gridflow.sources.schemas import KEYS, SCHEMAS

DAYS = 12
DATES = (date(2030, 11, 3), date(2030, 11, 10), date(2030, 11, 10), date(2030, 11, 15))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    return fixture.make_fixture(spark, str(tmp_path_factory.mktemp("release") / "r"), DAYS)


@pytest.fixture(scope="module")
def benchmark(spark, folder, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("bench") / "b")
    scheme = lifecycle.Scheme(windows_per_condition=2, minimum_spacing_minutes=60)
    return out, lifecycle.prepare(spark, folder, out, *DATES, scheme=scheme)


def test_reader(spark, folder):
    r = release.Release(spark, folder)
    assert r.families == {fixture.PANEL: fixture.FAMILY} and r.calendar["train"].end == datetime(2031, 3, 1)
    assert r.fingerprint == release.Release(spark, folder).fingerprint
    d = r.states([fixture.PANEL], ["train"], "mainline_states", date(2030, 11, 4), date(2030, 11, 6))
    assert d.count() == 2 * 288 * 2 and len(d.inputFiles()) == 2
    assert [f.name for f in d.schema.fields[:-2]] == SCHEMAS["mainline_states"].names
    with pytest.raises(ValueError, match="no mainline_states"):
        r.states([fixture.PANEL], ["private"], "mainline_states", date(2030, 11, 4), date(2030, 11, 6))
    assert r.states([fixture.PANEL], ["private"], "ramp_states", date(2030, 11, 4), date(2030, 11, 6), allow_empty=True).count() == 0
    net = r.network([fixture.PANEL])
    assert set(net) == set(release.NETWORK_TABLES) and net["lwr_mainline_topology"].where("incoming_link_ids is null").count() == 1
    with pytest.raises(ValueError):
        release.Release(spark, folder + "/config")


def test_dates_are_checked(spark, folder):
    c = release.Release(spark, folder).calendar
    release.check_dates(*DATES, c)
    for bad in ((date(2030, 1, 1), *DATES[1:]), (DATES[1], *DATES[1:]), (*DATES[:2], date(2030, 11, 9), DATES[3]), (*DATES[:3], DATES[2]), (*DATES[:3], date(2032, 1, 1))):
        with pytest.raises(ValueError):
            release.check_dates(*bad, c)
    assert list(release.Release(spark, folder).split_parts(date(2031, 2, 1), date(2031, 3, 5))) == ["train", "validation"]


def test_slice_hides_targets(spark, folder):
    r = release.Release(spark, folder)
    s = release.load_slice(r, [fixture.PANEL], *DATES[:2], *DATES[2:])
    t = release.load_targets(r, [fixture.PANEL], *DATES[2:])
    assert set(t) == {"state", "odme"} and t["state"].agg(F.max("timestamp")).first()[0] < datetime(2030, 11, 15)
    key = ["timestamp", "station_id", "link_id"]
    cells = release.redact(s, "state", t["state"]).states.join(t["state"].select(*key), key, "left_semi")
    assert cells.count() > 0 and cells.where("speed_kmh is not null or flow_vph is not null").count() == 0
    assert s.state_labels.where("speed_kmh is null").count() == 0 and s.state_labels.agg(F.max("timestamp")).first()[0] < datetime(2030, 11, 10)


def test_queue_redaction_covers_all_tables(spark, folder):
    r = release.Release(spark, folder)
    s = release.load_slice(r, [fixture.PANEL], *DATES[:2], *DATES[2:])
    t = spark.createDataFrame([(fixture.PANEL, datetime(2030, 11, 11, 9, 0))], "panel string, timestamp timestamp")
    x = release.redact(s, "queue", t)
    assert x.states.where("timestamp = '2030-11-11 09:00:00' and pct_observed is not null").count() == 0
    assert x.ramps.where("timestamp = '2030-11-11 09:00:00' and flow_vph is not null").count() == 0
    assert x.states.where("pct_observed is null").count() == 2


def test_benchmark_and_its_hashes(spark, benchmark):
    out, m = benchmark
    assert lifecycle.verify_benchmark(spark, out)["benchmark_id"] == m["benchmark_id"]
    truth, hidden = spark.read.parquet(f"{out}/state_truth"), spark.read.parquet(f"{out}/states")
    assert truth.count() == spark.read.parquet(f"{out}/state_targets").count() > 0
    seen = hidden.join(truth.select("timestamp", "link_id"), ["timestamp", "link_id"], "left_semi")
    assert seen.where("speed_kmh is not null").count() == 0
    index = spark.read.parquet(f"{out}/queue_index")
    assert {r["condition"] for r in index.collect()} == {"queue_onset", "queue_ongoing"}
    per = spark.read.parquet(f"{out}/queue_targets").groupBy("window_id").count().collect()
    assert {r["count"] for r in per} == {6 * 2} and len(per) == index.count()
    hist = spark.read.parquet(f"{out}/queue_history").groupBy("window_id").agg(F.count("*").alias("n"), F.max("timestamp").alias("b")).join(index, "window_id")
    assert hist.where("n = 24 and b < forecast_origin").count() == index.count()
    spark.createDataFrame([(1,)], "x int").write.mode("overwrite").parquet(f"{out}/ramps_copy")
    assert lifecycle.content_hash(truth) == lifecycle.content_hash(truth.repartition(5))


@pytest.mark.parametrize("task, metric, least", [("state", "state_score", 0.9), ("queue", "queue_proxy_iou", 0.2), ("odme", "odme_link_score_diagnostic", 0.9)])
def test_baselines_end_to_end(spark, benchmark, task, metric, least):
    out, m = benchmark
    run = lifecycle.experiment(spark, out, task)
    assert run.status == "completed" and run.scores[metric] >= least and "|" in lifecycle.report(run, run)
    one = lifecycle.combine(spark, [f"{out}/runs/{run.run_id}"], m["panels"], f"{out}/combined-{task}")
    assert one.scores == pytest.approx(run.scores) and one.seconds == run.seconds and one.peak_memory_mb == run.peak_memory_mb > 0
    assert lifecycle.attach_baseline(run, [run], None) is run and run.evaluator_hash == lifecycle.evaluator_hash()
    assert "|" in (Path(out) / "runs" / run.run_id / "report.md").read_text() and (Path(out) / "runs" / run.run_id / "metrics.csv").read_text().count("\n") > 1
    other = lifecycle.Run(**{**vars(run), "evaluator_hash": "x"})
    assert lifecycle.attach_baseline(other, [run], lambda: other) is other
    with pytest.raises(ValueError, match="different code"):
        lifecycle.compare([run, other])


def test_example_blends_and_compares(spark, benchmark):
    out, _ = benchmark
    a, b = lifecycle.experiment(spark, out, "state"), lifecycle.experiment(spark, out, "state", "example", {"blend": 0.25})
    assert len(lifecycle.compare([a, b])) == 2 and b.baseline_run == a.run_id and b.baseline_scores == a.scores
    assert lifecycle.write_summary(spark, f"{out}/runs", f"{out}/summary.csv").where("state_score is not null").count() >= 2 and "state_score" in (Path(out) / "summary.csv").read_text()
    with pytest.raises(ValueError):
        lifecycle.compare([a, lifecycle.Run("x", "queue", "baseline", a.benchmark_id, a.panels, status="completed")])
    assert lifecycle.summary(spark, f"{out}/runs").where("status = 'completed'").count() >= 2


def test_failures_are_recorded(spark, benchmark):
    out, _ = benchmark
    predict.register("broken", lambda task, tables, targets, params: targets.where("false"))
    with pytest.raises(validate.ContractError, match="missing"):
        lifecycle.experiment(spark, out, "state", "broken")
    with pytest.raises(ValueError, match="no panels"):
        lifecycle.experiment(spark, out, "state", panels=["nowhere"])
    assert lifecycle.summary(spark, f"{out}/runs").where("status = 'failed' and solution = 'broken'").count() == 1


def test_direct_predictions_fill_the_templates(spark, folder):
    got = lifecycle.predict_release(spark, folder, *DATES[2:], *DATES[:2])
    targets = release.load_targets(release.Release(spark, folder), [fixture.PANEL], *DATES[2:])
    for task, d in got.items():
        validate.require_valid(validate.task_violations(d, targets[task], task), task)
        assert set(KEYS[task]) <= set(d.columns)


def test_queue_tables_of_a_release(spark, folder, tmp_path):
    import shutil

    shutil.copytree(folder, tmp_path / "r")
    base = tmp_path / "r/task2" / fixture.PANEL / "train"
    base.mkdir(parents=True)
    head = ",".join(SCHEMAS["queue_window_index"].names)
    row = lambda w, h: f"{w},{fixture.PANEL},F,train,2030-11-11,2030-11-11T{h}:00:00Z,2030-11-11T{h - 1:02d}:00:00Z,2030-11-11T{h}:00:00Z,2030-11-11T{h}:05:00Z,2030-11-11T{h}:30:00Z,queue_onset,1.0,1.0"
    (base / "window_index.csv").write_text("\n".join([head, row("w1", 10), row("w2", 23).replace("11-11T23:30", "11-12T00:05")]))
    cells = [f"w1,2030-11-11T10:{m:02d}:00Z,L01,0" for m in range(5, 35, 5)] + [f"w2,2030-11-{d}Z,L01,0" for d in ("11T23:50:00", "12T00:05:00")]
    (base / "sample_submission_queue.csv").write_text("\n".join(["window_id,timestamp,link_id,queue_pred", *cells]))
    spark.sql("select 'w1' as window_id, timestamp'2030-11-11 09:55:00' as timestamp, 'L01' as link_id, 40.0D as speed_kmh, 1.0D as flow_vph, 0.1D as occupancy, 100L as pct_observed, 1L as is_score_eligible").write.parquet(str(base / "window_history.parquet"))
    r = release.Release(spark, str(tmp_path / "r"))
    t = release.load_targets(r, [fixture.PANEL], date(2030, 11, 11), date(2030, 11, 12))["queue"]
    assert {x["window_id"] for x in t.collect()} == {"w1"} and t.count() == 6
    s = release.load_slice(r, [fixture.PANEL], date(2030, 11, 4), date(2030, 11, 12), date(2030, 11, 11), date(2030, 11, 12))
    got = s.queue_labels.collect()
    assert s.queue_history.count() == 1 and len(got) == 6
    out = predict.queue_persistence(s.queue_history, t, s.network["links"]).collect()
    assert {x["queue_pred"] for x in out} == {1}
    shutil.rmtree(base / "window_history.parquet")
    with pytest.raises(ValueError, match="without their history"):
        release.load_slice(release.Release(spark, str(tmp_path / "r")), [fixture.PANEL], date(2030, 11, 4), date(2030, 11, 12), date(2030, 11, 11), date(2030, 11, 12))


def test_scheme_file(tmp_path):
    f = tmp_path / "s.yaml"
    f.write_text("name: n\nseed: 1\nprofiles:\n  quick:\n    panels: [A]\n  full:\n    panels: all\nqueue:\n  windows_per_condition: 3\nodme:\n  synthetic_cases: 2\n")
    s = lifecycle.Scheme.load(str(f))
    assert (s.seed, s.quick_panels, s.windows_per_condition, s.synthetic_cases) == (1, ("A",), 3, 2)
    f.write_text("name: n\nseed: 1\nqueue:\n  nonsense: 3\n")
    with pytest.raises(ValueError):
        lifecycle.Scheme.load(str(f))


def test_command_line(spark, folder, tmp_path):
    assert cli.main(["new", "mine", "--folder", str(tmp_path)]) == 0 and "def odme(" in (tmp_path / "mine.py").read_text()
    with pytest.raises(ValueError):
        cli.main(["new", "Not-a-name"])
    cli.main(["predict", folder, str(tmp_path / "p"), "--history-start", "2030-11-03", "--history-end", "2030-11-10", "--start", "2030-11-10", "--end", "2030-11-12"])
    assert spark.read.parquet(str(tmp_path / "p/state")).count() > 0


def test_shards_run_and_combine_to_the_same_scores(spark, benchmark, tmp_path):
    out, m = benchmark
    whole = lifecycle.experiment(spark, out, "state")
    folders = shards.package(spark, out, str(tmp_path / "s"))
    assert len(folders) == 1 and lifecycle.verify_benchmark(spark, folders[0])["panels"] == m["panels"] and fixture.PANEL in shards.matrix(spark, folders, "state")
    run = lifecycle.experiment(spark, folders[0], "state")
    got = lifecycle.combine(spark, [f"{folders[0]}/runs/{run.run_id}"], m["panels"])
    assert got.scores == pytest.approx(whole.scores)
    index = shards.archives(spark, folders, str(tmp_path / "a"))
    assert index["shards"][0]["tasks"] == ["state", "queue", "odme"] and fixture.PANEL in shards.archive_matrix(index, "odme")
    archive = str(tmp_path / "a" / index["shards"][0]["asset"])
    back = shards.unpack(archive, str(tmp_path / "u"), index["shards"][0]["sha256"])
    assert lifecycle.verify_benchmark(spark, back)["panels"] == m["panels"]
    with open(archive, "ab") as f:
        f.write(b"changed")
    with pytest.raises(ValueError, match="isn't the archive"):
        shards.unpack(archive, str(tmp_path / "v"), index["shards"][0]["sha256"])
    with pytest.raises(ValueError, match="empty"):
        shards.package(spark, out, str(tmp_path / "s"))
    with pytest.raises(ValueError):
        lifecycle.combine(spark, [f"{folders[0]}/runs/{run.run_id}"], [*m["panels"], "other"])
    spark.read.parquet(f"{folders[0]}/ramps").limit(3).write.parquet(str(tmp_path / "r"))
    spark.read.parquet(str(tmp_path / "r")).write.mode("overwrite").parquet(f"{folders[0]}/ramps")
    with pytest.raises(ValueError, match="ramps"):
        lifecycle.verify_benchmark(spark, folders[0])


def test_answers_narrow_the_targets(spark, folder):
    t = release.load_targets(release.Release(spark, folder), [fixture.PANEL], *DATES[2:])["state"]
    some = t.select(*KEYS["state"]).orderBy("timestamp", "link_id").limit(5)
    got = lifecycle.predict_release(spark, folder, *DATES[2:], *DATES[:2], tasks=["state"], answers={"state": some})["state"]
    assert got.count() == 5
    with pytest.raises(validate.ContractError, match="match no"):
        lifecycle.answer_targets(some.withColumn("link_id", F.lit("zz")), t, "state")


PAIR = (("N1", "F1"), ("N2", "F2"))


@pytest.fixture(scope="module")
def pair(spark, tmp_path_factory):
    """A release of two panels that share the ids of links and paths, with forecast windows and a validation split."""
    return fixture.make_fixture(spark, str(tmp_path_factory.mktemp("pair") / "r"), 9, PAIR, 2, 2)


def test_two_panels_prepare_and_score_apart(spark, pair, tmp_path):
    out = str(tmp_path / "b")
    scheme = lifecycle.Scheme(windows_per_condition=2, minimum_spacing_minutes=60, synthetic_cases=2)
    days = (date(2030, 11, 3), date(2030, 11, 9), date(2030, 11, 9), date(2030, 11, 12))
    m = lifecycle.prepare(spark, pair, out, *days, panels=["N1", "N2"], scheme=scheme)
    counts = {(r["panel"], r["scenario"], r["link_id"]): r["count"] for r in spark.read.parquet(f"{out}/odme_counts").collect()}
    truth = spark.read.parquet(f"{out}/odme_truth")
    assert len(counts) == 2 * 3 * 2 and truth.count() == 2 * 2 * 2
    flows = {(r["panel"], r["scenario"], r["path_id"]): r["path_flow"] for r in truth.collect()}
    for p in ("N1", "N2"):
        for k in (1, 2):
            assert counts[p, k, "L02"] == pytest.approx(flows[p, k, "P02"], rel=0.2) and counts[p, k, "L01"] == pytest.approx(flows[p, k, "P01"] + flows[p, k, "P02"], rel=0.2)
    for task, metric in (("state", "state_score"), ("queue", "queue_proxy_iou"), ("odme", "odme_link_score_diagnostic")):
        run = lifecycle.experiment(spark, out, task)
        own = [lifecycle.experiment(spark, out, task, panels=[p]) for p in ("N1", "N2")]
        assert {r["panel"] for r in spark.read.parquet(f"{out}/runs/{run.run_id}/metrics").collect()} == {"N1", "N2"}
        assert run.scores[metric] == pytest.approx(sum(r.scores[metric] for r in own) / 2)
        both = lifecycle.combine(spark, [f"{out}/runs/{r.run_id}" for r in own], ["N1", "N2"])
        assert both.scores == pytest.approx(run.scores) and both.seconds == own[0].seconds + own[1].seconds
    own[0].commit = "another"
    from gridflow.sources import files

    files.write_json(spark, vars(own[0]), f"{out}/runs/{own[0].run_id}/run.json")
    with pytest.raises(ValueError, match="commit"):
        lifecycle.combine(spark, [f"{out}/runs/{r.run_id}" for r in own], ["N1", "N2"])
    assert len(shards.package(spark, out, str(tmp_path / "s"))) == 2 and m["profile"] == "custom"


def test_states_of_several_panels_are_one_scan(spark, pair):
    r = release.Release(spark, pair)
    d = r.states(["N1", "N2"], ["train", "validation"], "mainline_states_masked", date(2030, 11, 10), date(2031, 3, 2))
    got = {(x["panel"], x["split"]): x["count"] for x in d.groupBy("panel", "split").count().collect()}
    assert got == {(p, s): 576 * n for p in ("N1", "N2") for s, n in (("train", 2), ("validation", 1))}
    assert d._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1 and len(d.inputFiles()) == 6
    with pytest.raises(ValueError, match="no rows"):
        release.require_rows(d.where("false"), "x")


def test_direct_runs_with_and_without_answers(spark, pair, tmp_path):
    runs = str(tmp_path / "runs")
    run = lifecycle.run_release(spark, pair, "state", shortcut="validation", history_start=date(2030, 11, 3), history_end=date(2030, 11, 12), runs=runs)
    assert run.status == "completed" and run.splits == ["validation"] and run.final_submission_eligible and not run.scored and "fd_component_score" in run.scores
    span = {"start": date(2030, 11, 10), "end": date(2030, 11, 12), "history_start": date(2030, 11, 3), "history_end": date(2030, 11, 10), "runs": runs}
    t = release.load_targets(release.Release(spark, pair), ["N1", "N2"], span["start"], span["end"])
    state = t["state"].select(*KEYS["state"]).withColumns({"speed_kmh": F.lit(95.0), "flow_vph": F.when(F.col("link_id") == "L01", 2000.0).otherwise(4000.0) * F.when(F.col("panel") == "N1", 1.0).otherwise(0.5)}).where("hour(timestamp) = 15")
    run = lifecycle.run_release(spark, pair, "state", answers=state, **span)
    assert run.scored and not run.final_submission_eligible and run.scores["state_score"] > 0.99
    assert (tmp_path / "runs" / run.run_id / "predictions.csv").read_text().count("\n") == state.count() + 1
    odme = t["odme"].select(*KEYS["odme"]).withColumn("path_flow", F.lit(500.0))
    assert "odme_synthetic_score" in lifecycle.run_release(spark, pair, "odme", answers=odme, **span).scores
    span |= {"start": date(2030, 11, 4), "end": date(2030, 11, 5), "history_end": date(2030, 11, 4)}
    queue = release.load_targets(release.Release(spark, pair), ["N1", "N2"], span["start"], span["end"])["queue"].select(*KEYS["queue"]).withColumn("queue_pred", (F.hour("timestamp").between(8, 9)).cast("int"))
    assert 0 < lifecycle.run_release(spark, pair, "queue", answers=queue, **span).scores["queue_proxy_iou"] <= 1
    with pytest.raises(ValueError, match="not both"):
        lifecycle.run_release(spark, pair, "state", shortcut="both", **span)


def test_solutions_are_loaded_from_files(spark, pair, tmp_path):
    cli.main(["new", "own_idea", "--folder", str(tmp_path)])
    name = predict.load(str(tmp_path / "own_idea.py"))
    assert name == "own_idea" and predict.source(name) == tmp_path / "own_idea.py" and predict.load("baseline") == "baseline"
    before = lifecycle.solution_hash(name)
    (tmp_path / "own_idea.py").write_text((tmp_path / "own_idea.py").read_text() + "\n# changed\n")
    assert lifecycle.solution_hash(name) != before != lifecycle.solution_hash("baseline")
    (tmp_path / "nothing.py").write_text("x = 1\n")
    with pytest.raises(TypeError, match="nothing"):
        predict.load(str(tmp_path / "nothing.py"))
    with pytest.raises(ValueError):
        predict.load(str(tmp_path / "absent.py"))
    args = ["--history-start", "2030-11-03", "--history-end", "2030-11-10", "--start", "2030-11-10", "--end", "2030-11-11", "--solution", str(tmp_path / "own_idea.py"), "--runs", str(tmp_path / "runs")]
    assert cli.main(["run", pair, "state", *args]) == 0
    assert lifecycle.records(spark, str(tmp_path / "runs"))[0].solution == "own_idea"


def test_parameters_have_types_and_ranges():
    for bad in ({"blend": 2.0}, {"blend": "x"}, {"blend": True}, {"regularisation": 0}, {"blend": float("nan")}):
        with pytest.raises(ValueError):
            predict.predictor("example", bad)
    assert predict.predictor("example", {"blend": 1, "regularisation": 0.5})


def test_predictors_of_single_panels_are_united(spark, pair):
    r = release.Release(spark, pair)
    s = release.load_slice(r, ["N1", "N2"], date(2030, 11, 3), date(2030, 11, 10), date(2030, 11, 10), date(2030, 11, 11))
    t = release.load_targets(r, ["N1", "N2"], date(2030, 11, 10), date(2030, 11, 11))["state"]
    tables = predict.ReleaseTables(s.states, s.network["links"], state_labels=s.state_labels)
    seen = []

    def one(panel, own, targets, params):
        seen.append(panel)
        return predict.baseline_state(own, targets)

    got = predict.map_panels(tables, t, {}, one, ["N1", "N2"])
    whole = predict.baseline_state(tables, t)
    key = lambda d: sorted(tuple(x) for x in d.select(*KEYS["state"], "speed_kmh", "flow_vph").collect())
    assert seen == ["N1", "N2"] and key(got) == key(whole)


def test_csv_is_read_by_its_header_and_configs_are_checked(spark, pair, tmp_path):
    (tmp_path / "x.csv").write_text("count,more,link_id,panel\n5.5,hi,007,A\n,,L2,A\n")
    r = release.Release(spark, str(tmp_path), False)
    got = [tuple(x) for x in r.csv("x.csv", "link_counts").collect()]
    assert got == [("A", "007", 5.5, "hi"), ("A", "L2", None, None)]
    (tmp_path / "y.csv").write_text("count,panel\n1,A\n")
    with pytest.raises(ValueError, match="link_id"):
        r.csv("y.csv", "link_counts")
    (tmp_path / "config").mkdir()
    for corridors in ({"panels": [{"corridor_id": "A"}]}, {}, {"panels": [{"corridor_id": "A", "family_id": "f"}] * 2}):
        (tmp_path / release.CORRIDORS).write_text(json.dumps(corridors))
        with pytest.raises(ValueError):
            release.Release(spark, str(tmp_path)).families  # noqa: B018
    for calendar in ({}, {"synthetic_calendar": {"train": {"start": "2030-01-01"}}}, {"synthetic_calendar": {s: {"start": "2030-01-02T00:00:00Z", "end_exclusive": "2030-01-03T00:00:00Z"} for s in ("train", "validation", "private")}}):
        (tmp_path / release.CALENDAR).write_text(json.dumps(calendar))
        with pytest.raises(ValueError):
            release.Release(spark, str(tmp_path)).calendar  # noqa: B018


def test_a_state_score_without_a_known_regime_raises(spark):
    t = spark.sql("select 'A' as panel, 'train' as split, timestamp'2030-01-01 00:00:00' as timestamp, 'S' as station_id, 'L' as link_id, 'R9' as mask_regime, 1.0D as speed_kmh, 1.0D as flow_vph")
    net = spark.createDataFrame([("A", "L", 1.0, 40.0, 200.0, 4000.0, 100.0)], "panel string, link_id string, lanes double, critical_density double, k_jam double, capacity_vph double, free_speed_kmh double")
    with pytest.raises(Exception, match="no regime"):
        lifecycle.score_state(t, t, net).collect()
