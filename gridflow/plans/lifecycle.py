"""From a release to scored or submitted predictions: prepare, experiment, predict, compare, summarise, combine."""

from __future__ import annotations

import hashlib
import json
import platform
import subprocess
import time
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from datetime import date
from functools import reduce
from pathlib import Path

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from gridflow.functions import to_datetime
from gridflow.operators import labels, metrics, odme, predict, validate, windows
from gridflow.operators.rel import join_unique
from gridflow.operators.series import densify_grid
from gridflow.sources import files
from gridflow.sources import release as rel_io
from gridflow.sources.schemas import KEYS, MASK_REGIMES, SPLITS, VALUES


@dataclass(frozen=True)
class Scheme:
    """How cases are made (defaults are fixed values of the benchmark)."""

    name: str = "cutoff_holdout_v1"
    seed: int = 69420
    quick_panels: tuple[str, ...] = ("D12_I5_N",)
    windows_per_condition: int = 5
    minimum_spacing_minutes: int = 360
    minimum_history_coverage: float = 0.7
    minimum_future_coverage: float = 0.7
    excluded_panels: tuple[str, ...] = ("D12_I405_N", "D12_I405_S")
    synthetic_cases: int = 3
    demand_log_sigma: float = 0.35
    count_noise_fraction: float = 0.03

    @staticmethod
    def load(path: str) -> Scheme:
        """From YAML of the sections profiles, queue and odme; unknown keys raise."""
        import yaml

        with open(path) as f:
            raw = yaml.safe_load(f)
        flat = {"name": raw.pop("name"), "seed": raw.pop("seed"), **raw.pop("queue", {}), **raw.pop("odme", {})}
        profiles = raw.pop("profiles", {})
        if raw:
            raise ValueError(f"unknown keys {sorted(raw)}")
        if "quick" in profiles:
            flat["quick_panels"] = tuple(profiles["quick"]["panels"])
        if unknown := set(flat) - set(Scheme.__dataclass_fields__):
            raise ValueError(f"unknown keys {sorted(unknown)}")
        return Scheme(**{k: tuple(v) if isinstance(v, list) else v for k, v in flat.items()})

    def window_rules(self) -> windows.WindowRules:
        return windows.WindowRules(history_coverage=self.minimum_history_coverage, future_coverage=self.minimum_future_coverage, per_condition=self.windows_per_condition, spacing_minutes=self.minimum_spacing_minutes, seed=self.seed)


TABLES = ("network_links", "network_fd", "incidence", "states", "ramps", "state_labels", "state_targets", "state_truth", "queue_index", "queue_history", "queue_targets", "queue_truth", "odme_targets", "odme_truth", "odme_prior", "odme_counts")


def content_hash(d: DataFrame) -> str:
    """Of a table's rows in any order: their count and the sum of their hashes."""
    r = d.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*[F.col(c) for c in sorted(d.columns)]).cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return hashlib.sha256(f"{sorted(d.dtypes)}|{r['n']}|{r['h']}".encode()).hexdigest()


def build_queue_windows(measured: DataFrame, links: DataFrame, families: dict[str, str], scheme: Scheme, history_end, start, end, case: str) -> dict[str, DataFrame]:
    """index, history, targets and truth of sampled forecast windows, over dense grids of all links of each panel."""
    rules = scheme.window_rules()
    cond = labels.link_conditions(measured, ["panel", "timestamp", "link_id"])
    cells = cond.join(links.select("panel", "link_id", "free_speed_kmh"), ["panel", "link_id"], "left")
    cells = cells.select("panel", "link_id", "timestamp", F.when(F.col("all_eligible"), labels.is_queued("mean_speed", "free_speed_kmh")).otherwise(0).alias("queued"), F.col("all_eligible").cast("int").alias("eligible"))
    entity = F.struct("panel", "link_id")
    everywhere = links.select("panel", "link_id").withColumn("e", entity)
    grid = densify_grid(cells.withColumn("e", entity).drop("panel", "link_id").unionByName(everywhere.select("e").join(F.broadcast(cells.agg(F.min("timestamp").alias("timestamp")))), allowMissingColumns=True).groupBy("e", "timestamp").agg(F.max("queued").alias("queued"), F.max("eligible").alias("eligible")), "e", "timestamp", f"{rules.step_minutes} minutes")
    grid = grid.select("e.panel", "e.link_id", "timestamp", F.coalesce("queued", F.lit(0)).alias("queued"), F.coalesce("eligible", F.lit(0)).alias("eligible"))
    step = F.expr(f"interval {rules.step_minutes} minutes")
    ahead, behind = F.expr(f"interval {rules.future_steps * rules.step_minutes} minutes"), F.expr(f"interval {rules.history_steps * rules.step_minutes} minutes")
    t = F.col("timestamp")
    first = max(to_datetime(start), to_datetime(history_end))
    origins = windows.candidates(grid, rules).where((t + step >= F.lit(first)) & (t + ahead < F.lit(to_datetime(end))))
    chosen = windows.sample_spaced(origins, rules)
    family = F.coalesce(*[F.when(F.col("panel") == p, F.lit(f)) for p, f in families.items()], F.col("panel"))
    index = chosen.select(
        F.format_string(f"proxy_%s_{case}_%s_%02d", "panel", "condition", "number").alias("window_id"), "panel", family.alias("family_id"), F.lit("train").alias("split"), F.date_format("timestamp", "yyyy-MM-dd").alias("date"), t.alias("forecast_origin"),
        (t - behind).alias("history_start"), t.alias("history_end"), (t + step).alias("forecast_start"), (t + ahead).alias("forecast_end"), "condition", "history_coverage", "future_coverage",
    )
    w = index.select("window_id", "panel", "condition", "history_start", "history_end", "forecast_start", "forecast_end")
    hist_times = w.select("window_id", "panel", F.explode(F.sequence("history_start", F.col("history_end") - step, step)).alias("timestamp"))
    history = measured.join(hist_times, ["panel", "timestamp"]).select("window_id", "panel", "timestamp", "link_id", "speed_kmh", "flow_vph", "occupancy", "pct_observed", "is_score_eligible")
    times = w.select("window_id", "panel", "condition", F.explode(F.sequence("forecast_start", "forecast_end", step)).alias("timestamp"))
    truth = times.join(grid, ["panel", "timestamp"]).select("window_id", "panel", "timestamp", "link_id", "condition", F.col("queued").alias("queue_true"), (F.col("eligible") == 1).alias("eligible"))
    return {"index": index, "history": history, "targets": truth.select("panel", *KEYS["queue"]).withColumn("queue_pred", F.lit(0).cast("long")), "truth": truth}


def prepare(spark: SparkSession, release_path: str, out: str, history_start: date, history_end: date, prediction_start: date, prediction_end: date, panels: Sequence[str] | None = None, profile: str = "quick", scheme: Scheme = Scheme()) -> dict:
    """Write a benchmark: inputs, labels, targets and truth in separate tables, and a manifest with the hash of each table's rows."""
    release = rel_io.Release(spark, release_path)
    rel_io.check_dates(history_start, history_end, prediction_start, prediction_end, release.calendar)
    chosen = panels
    panels = list(dict.fromkeys(panels or (scheme.quick_panels if profile == "quick" else release.families)))
    if unknown := [p for p in panels if p not in release.families]:
        raise ValueError(f"unknown panels {unknown}")
    hs, pe = to_datetime(history_start), to_datetime(prediction_end)
    net = release.network(panels)
    measured = rel_io.require_rows(release.states(panels, ["train"], "mainline_states", hs, pe), "mainline_states")
    masked = rel_io.require_rows(release.states(panels, ["train"], "mainline_states_masked", hs, pe), "mainline_states_masked")
    ramps = release.states(panels, ["train"], "ramp_states", hs, pe, allow_empty=True)
    state_labels, _ = rel_io.historical_labels(release, panels, net, history_start, history_end)
    targets = rel_io.load_targets(release, panels, prediction_start, prediction_end)
    key = ["panel", "timestamp", "station_id", "link_id"]
    tables: dict[str, DataFrame | None] = {"network_links": net["links"], "network_fd": net["fd_parameters"], "incidence": net["path_link_incidence"], "states": masked, "ramps": ramps, "state_labels": state_labels}
    if "state" in targets:
        truth = labels.state_answers(targets["state"].drop(*VALUES["state"]), measured, key)
        tables |= {"state_truth": truth, "state_targets": truth.select(*targets["state"].columns[:-2]).withColumns({v: F.lit(0.0) for v in VALUES["state"]})}
    queue_panels = [p for p in panels if p not in scheme.excluded_panels]
    if queue_panels:
        q = build_queue_windows(measured.where(F.col("panel").isin(queue_panels)), net["links"].where(F.col("panel").isin(queue_panels)), release.families, scheme, history_end, prediction_start, prediction_end, "q")
        tables |= {f"queue_{k}": v for k, v in q.items()}
    prior = release.table(panels, ["train"], rel_io.PRIOR, "weak_prior")
    counts = release.table(panels, ["train"], rel_io.COUNTS, "link_counts")
    if prior is not None and counts is not None:
        validate.require_valid(validate.incidence_violations(net["path_link_incidence"], net["path_set"], counts), "incidence")
        truth, noisy = odme.synthetic_scenarios(prior, net["path_link_incidence"], scheme.synthetic_cases, scheme.seed, scheme.demand_log_sigma, scheme.count_noise_fraction)
        base = prior.withColumn("scenario", F.lit(0))
        cases = base.unionByName(prior.withColumn("scenario", F.explode(F.sequence(F.lit(1), F.lit(scheme.synthetic_cases)))))
        tables |= {"odme_truth": truth, "odme_prior": cases, "odme_targets": cases.withColumn("path_flow", F.lit(0.0)), "odme_counts": counts.select("panel", F.lit(0).alias("scenario"), "link_id", "count").unionByName(noisy.select("panel", "scenario", "link_id", "count"))}
    hashes = {}
    for name, d in tables.items():
        if d is not None:
            d.write.parquet(f"{out}/{name}")
            hashes[name] = content_hash(spark.read.parquet(f"{out}/{name}"))
    if queue_panels:
        short = spark.read.parquet(f"{out}/queue_index").groupBy("panel").agg(F.countDistinct("condition").alias("c")).where("c = 2").count()
        if short < len(queue_panels):
            raise ValueError("no windows of both conditions for some panel; enlarge the prediction dates")
    manifest = {"scheme": asdict(scheme), "profile": profile if not chosen else "custom", "files": files.file_digests(spark, out), "release": release.fingerprint, "panels": panels, "families": {p: release.families[p] for p in panels}, "dates": [str(x) for x in (history_start, history_end, prediction_start, prediction_end)], "tables": hashes}
    manifest["benchmark_id"] = hashlib.sha256(json.dumps({"s": manifest["scheme"], "t": hashes, "d": manifest["dates"]}, sort_keys=True).encode()).hexdigest()[:16]
    files.write_json(spark, manifest, f"{out}/manifest.json")
    return manifest


def verify_benchmark(spark: SparkSession, path: str, panels: Sequence[str] | None = None) -> dict:
    """The manifest, after every file gave its SHA-256 and every table's rows their hash again; ``panels`` must be in it."""
    m = files.read_json(spark, f"{path}/manifest.json")
    got = {k: v for k, v in files.file_digests(spark, path).items() if k.split("/")[0] in m["tables"]}
    wrong = {k.split("/")[0] for k in {*got, *m["files"]} if got.get(k) != m["files"].get(k)}
    wrong |= {t for t, h in m["tables"].items() if t not in wrong and content_hash(spark.read.parquet(f"{path}/{t}")) != h}
    if wrong:
        raise ValueError(f"tables differ from the manifest: {sorted(wrong)}")
    if unknown := set(panels or ()) - set(m["panels"]):
        raise ValueError(f"the benchmark has no panels {sorted(unknown)}")
    return m


def _source_hash(paths: Sequence[Path]) -> str:
    return hashlib.sha256(json.dumps([(p.name, hashlib.sha256(p.read_bytes()).hexdigest()) for p in sorted(paths)]).encode()).hexdigest()


def evaluator_hash() -> str:
    """Of the library's own modules, which run and score; the optional subpackage takes no part."""
    root = Path(__file__).parent.parent
    return _source_hash([p for p in root.rglob("*.py") if p.relative_to(root).parts[0] in ("functions", "operators", "plans", "sources")])


def solution_hash(name: str) -> str:
    """Of the file that a registered predictor comes from, and of all Python files of its package where it is one."""
    path = predict.source(name)
    package = path.name == "__init__.py"
    return _source_hash(list(path.parent.rglob("*.py")) if package else [path])


def dependencies() -> dict[str, str]:
    return {"python": platform.python_version(), "pyspark": pyspark.__version__}


def commit() -> str | None:
    """The commit that the library lies in, if it is a checkout."""
    try:
        return subprocess.run(["git", "-C", str(Path(__file__).parent), "rev-parse", "HEAD"], capture_output=True, text=True, timeout=10, check=True).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        return None


def peak_memory_mb() -> float | None:
    """Highest memory of the driver's Python process, where the platform tells it."""
    try:
        import resource
    except ImportError:
        return None
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024


@dataclass
class Run:
    """What a run did; one record for scored and direct runs."""

    run_id: str
    task: str
    solution: str
    benchmark_id: str
    panels: list[str]
    params: dict = field(default_factory=dict)
    status: str = "running"
    seconds: float = 0.0
    scores: dict = field(default_factory=dict)
    error: str = ""
    profile: str = ""
    peak_memory_mb: float | None = None
    solution_hash: str = ""
    baseline_hash: str = ""
    evaluator_hash: str = ""
    dependencies: dict = field(default_factory=dict)
    commit: str | None = None
    baseline_run: str = ""
    baseline_scores: dict = field(default_factory=dict)
    dates: list[str] = field(default_factory=list)
    splits: list[str] = field(default_factory=list)
    scored: bool = True
    final_submission_eligible: bool = False

    def identify(self) -> None:
        """Note what code runs."""
        self.solution_hash, self.baseline_hash, self.evaluator_hash = solution_hash(self.solution), solution_hash("baseline"), evaluator_hash()
        self.dependencies, self.commit = dependencies(), commit()


def _family(families: dict[str, str]):
    return F.coalesce(*[F.when(F.col("panel") == p, F.lit(f)) for p, f in families.items()])


def score_state(truth: DataFrame, pred: DataFrame, network: DataFrame) -> DataFrame:
    """Metric rows by panel, split and regime, and of the flow-density diagram by panel and split.

    Each truth row meets its prediction and each link its lanes, once. Rows of
    other regimes don't count; a panel and split without any known one raises.
    """
    key = KEYS["state"]
    d = join_unique(truth, pred.select(*key, *[F.col(v).alias(f"{v}_pred") for v in VALUES["state"]]), key)
    d = join_unique(d, network.select("panel", "link_id", "lanes"), ["panel", "link_id"])
    rows = metrics.state_score(d, ["panel", "split", "mask_regime"])
    known = F.col("mask_regime").isin(*MASK_REGIMES)
    any_known = F.max(known.cast("int")).over(Window.partitionBy("panel", "split"))
    none = F.raise_error(F.concat(F.lit("no regime to score in "), F.col("panel"), F.lit(", "), F.col("split"))).cast("boolean")
    rows = rows.withColumn("__known", any_known).where(F.when(F.col("__known") == 1, known).otherwise(none)).drop("__known")
    fd = metrics.fd_component(join_unique(pred, network, ["panel", "link_id"], "inner"), ["panel", "split"])
    return rows.unionByName(fd, allowMissingColumns=True)


def score_odme(pred: DataFrame, counts: DataFrame, prior: DataFrame, incidence: DataFrame, truth: DataFrame | None) -> DataFrame:
    """Metric rows by panel, split and, where there are some, scenario; scenarios from 1 on have a truth."""
    by = ["panel", "split", *(["scenario"] if "scenario" in pred.columns else [])]
    if "scenario" not in by:
        return metrics.odme_score(pred, counts, prior, incidence, truth, by)
    known = metrics.odme_score(pred.where("scenario > 0"), counts.where("scenario > 0"), prior, incidence, truth, by)
    return known.unionByName(metrics.odme_score(pred.where("scenario = 0"), counts.where("scenario = 0"), prior, incidence, None, by), allowMissingColumns=True)


def score_rows(task: str, pred: DataFrame, read, families: dict[str, str]) -> DataFrame:
    """Metric rows of one task's predictions on a benchmark's tables, with case, split, panel and family."""
    if task == "state":
        out = score_state(read("state_truth"), pred, read("network_fd"))
    elif task == "queue":
        d = join_unique(read("queue_truth"), pred.select(*KEYS["queue"], "queue_pred"), KEYS["queue"])
        out = metrics.window_iou(d, ["panel", "condition", "window_id"], strict=True).withColumn("split", F.lit("train"))
    else:
        out = score_odme(pred, read("odme_counts").withColumn("split", F.lit("train")), read("odme_prior"), read("incidence"), read("odme_truth"))
    case = F.col("scenario").cast("string") if "scenario" in out.columns else F.lit("case")
    return out.withColumns({"case_id": case, "family": _family(families), "task": F.lit(task)})


def _finish(spark: SparkSession, run: Run, folder: str, began: float, rows: DataFrame | None = None, base: Run | None = None) -> None:
    """Write the record, the report and, where there are some, the metric rows as CSV."""
    run.seconds, run.peak_memory_mb = run.seconds or time.time() - began, peak_memory_mb()
    if rows is not None:
        files.write_csv(rows, f"{folder}/metrics.csv")
    files.write_json(spark, asdict(run), f"{folder}/run.json")
    files.write_text(spark, report(run, base), f"{folder}/report.md")


def experiment(spark: SparkSession, path: str, task: str, solution: str = "baseline", params: dict | None = None, runs: str | None = None, panels: Sequence[str] | None = None, compare_baseline: bool = True) -> Run:
    """Run a predictor on a prepared benchmark and score it; a failure is recorded and raised again.

    ``panels`` limits tables and targets. Another solution than the baseline is
    reported beside the newest fitting baseline run, or a new one.
    """
    m = verify_benchmark(spark, path, panels)
    panels = list(panels or m["panels"])
    runs = runs or f"{path}/runs"
    run = Run(f"{time.strftime('%Y%m%dT%H%M%S', time.gmtime())}-{uuid.uuid4().hex[:6]}", task, solution, m["benchmark_id"], panels, params or {}, profile=m.get("profile", ""))
    out, began, rows = f"{runs}/{run.run_id}", time.time(), None

    def read(t: str) -> DataFrame | None:
        if t not in m["tables"]:
            return None
        d = spark.read.parquet(f"{path}/{t}")
        return d.where(F.col("panel").isin(panels)) if "panel" in d.columns and panels != m["panels"] else d

    try:
        solve = predict.predictor(solution, params)
        run.identify()
        targets = read(f"{task}_targets")
        if targets is None or targets.isEmpty():
            raise ValueError(f"the benchmark has no {task} cases of these panels")
        s = rel_io.ReleaseSlice({"links": read("network_links")}, read("states"), read("ramps"), read("queue_history"), read("queue_index"), read("odme_prior"), read("odme_counts"), read("state_labels"), None, m["scheme"]["seed"])
        s = rel_io.redact(s, task, targets)
        counts = s.counts.withColumn("split", F.lit("train")) if s.counts is not None else None
        pred = solve(task, predict.ReleaseTables(s.states, s.network["links"], s.queue_history, s.prior, counts, read("incidence"), s.state_labels), targets, params or {})
        key = [*KEYS[task], *(["scenario"] if "scenario" in targets.columns else [])]
        pred.write.parquet(f"{out}/predictions")
        pred = spark.read.parquet(f"{out}/predictions")
        validate.require_valid(validate.prediction_violations(pred, targets, key, VALUES[task], ["queue_pred"] if task == "queue" else [], ["path_flow"] if task == "odme" else []), f"{solution} {task}")
        score_rows(task, pred, read, m["families"]).write.parquet(f"{out}/metrics")
        rows = spark.read.parquet(f"{out}/metrics")
        run.scores = {r["metric"]: r["value"] for r in metrics.hierarchical_mean(rows).collect()}
        run.status = "completed"
    except Exception as e:
        run.status, run.error = "failed", str(e)[:500]
        raise
    finally:
        _finish(spark, run, out, began, rows)
    if compare_baseline and solution != "baseline":
        base = attach_baseline(run, records(spark, runs), lambda: experiment(spark, path, task, "baseline", {}, runs, panels, False))
        run.baseline_run, run.baseline_scores = base.run_id, base.scores
        _finish(spark, run, out, began, None, base)
    return run


def records(spark: SparkSession, runs: str) -> list[Run]:
    """All readable run records right below a folder, by their ids and so in order of time."""
    if not files.exists(spark, runs):
        return []
    p, fs = files.hadoop_path(spark, runs)
    out = []
    for s in fs.listStatus(p):
        name = f"{s.getPath().toString()}/run.json"
        if files.exists(spark, name):
            try:
                out.append(Run(**files.read_json(spark, name)))
            except (TypeError, ValueError):  # no record of this kind
                continue
    return sorted(out, key=lambda r: r.run_id)


SHORTCUTS = {"validation": ("validation", "validation"), "private": ("private", "private"), "both": ("validation", "private")}


def run_release(spark: SparkSession, release_path: str, task: str, solution: str = "baseline", panels: Sequence[str] | None = None, start=None, end=None, history_start=None, history_end=None, shortcut: str | None = None, answers: DataFrame | None = None, params: dict | None = None, runs: str = "runs") -> Run:
    """Predict a release's own templates of a range, or the rows that answers name, and score them where there are answers.

    Without dates the validation and private splits are predicted, or the one
    that ``shortcut`` names; the history is the training split unless given.
    Answers' values stay out of the solution's sight.
    """
    release = rel_io.Release(spark, release_path)
    panels = list(dict.fromkeys(panels or release.families))
    if unknown := set(panels) - set(release.families):
        raise ValueError(f"unknown panels {sorted(unknown)}")
    c = release.calendar
    history_start, history_end = history_start or c["train"].start, history_end or c["train"].end
    if shortcut and (start or end):
        raise ValueError("give dates or a shortcut, not both")
    if not (start or end):
        first, last = SHORTCUTS[shortcut or "both"]
        start, end = c[first].start, c[last].end
    elif end is None:
        raise ValueError("a range needs its end")
    start = start or history_end
    rel_io.check_dates(history_start, history_end, start, end, c)
    run = Run(f"{time.strftime('%Y%m%dT%H%M%S', time.gmtime())}-{solution}-{task}-{uuid.uuid4().hex[:6]}", task, solution, release.fingerprint, panels, params or {}, dates=[str(x) for x in (history_start, history_end, start, end)], scored=answers is not None)
    out, began, rows = f"{runs}/{run.run_id}", time.time(), None
    try:
        run.identify()
        pred = predict_release(spark, release_path, start, end, history_start, history_end, panels, solution, params, [task], {task: answers} if answers is not None else None).get(task)
        if pred is None or pred.isEmpty():
            raise ValueError("no template row lies in this range")
        pred.write.parquet(f"{out}/predictions")
        pred = spark.read.parquet(f"{out}/predictions")
        files.write_csv(pred, f"{out}/predictions.csv")
        run.splits = [r["split"] for r in pred.select("split").distinct().orderBy("split").collect()]
        run.final_submission_eligible = "train" not in run.splits
        rows = direct_scores(release, panels, task, pred, answers)
        if rows is not None:
            rows.withColumns({"family": _family(release.families), "case_id": F.lit("direct"), "task": F.lit(task)}).write.parquet(f"{out}/metrics")
            rows = spark.read.parquet(f"{out}/metrics")
            run.scores = {r["metric"]: r["value"] for r in metrics.hierarchical_mean(rows).collect()}
        run.status = "completed"
    except Exception as e:
        run.status, run.error = "failed", str(e)[:500]
        raise
    finally:
        _finish(spark, run, out, began, rows)
    return run


def direct_scores(release: rel_io.Release, panels: Sequence[str], task: str, pred: DataFrame, answers: DataFrame | None) -> DataFrame | None:
    """Metric rows of direct predictions: scores where there are answers, else the diagnostics that need none; None for queues without answers."""
    net = release.network(panels)
    keys = KEYS[task]
    if answers is not None:
        # panel and split come from the prediction that each answer asked for
        truth = pred.select(*dict.fromkeys([*keys, "panel", "split"])).join(answers.select(*keys, *[F.col(v).cast("double").alias(v) for v in VALUES[task]]), keys)
    if task == "state":
        fd = net["fd_parameters"]
        if answers is not None:
            return score_state(truth, pred, fd)
        return metrics.fd_component(join_unique(pred, fd, ["panel", "link_id"], "inner"), ["panel", "split"])
    if task == "queue":
        if answers is None:
            return None
        index = release.table(panels, list(SPLITS), rel_io.WINDOW_INDEX, "queue_window_index").select("panel", "split", "window_id", "condition")
        d = join_unique(truth.withColumnRenamed("queue_pred", "queue_true"), pred.select(*keys, "queue_pred"), keys).withColumn("eligible", F.lit(True))
        return metrics.window_iou(join_unique(d, index, ["panel", "split", "window_id"]), ["panel", "split", "condition", "window_id"], strict=True)
    splits = list(SPLITS)
    prior, counts = release.table(panels, splits, rel_io.PRIOR, "weak_prior"), release.table(panels, splits, rel_io.COUNTS, "link_counts")
    here = pred.select("panel", "split").distinct()
    return score_odme(pred, counts.join(here, ["panel", "split"], "left_semi"), prior, net["path_link_incidence"], truth if answers is not None else None)


def predict_release(spark: SparkSession, release_path: str, start, end, history_start, history_end, panels: Sequence[str] | None = None, solution: str = "baseline", params: dict | None = None, tasks: Sequence[str] = ("state", "queue", "odme"), answers: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Predictions of a release's own templates in [start, end), by task; where ``answers`` has a task, of its rows alone."""
    release = rel_io.Release(spark, release_path)
    panels = list(panels or release.families)
    s = rel_io.load_slice(release, panels, history_start, history_end, start, end)
    targets = rel_io.load_targets(release, panels, start, end)
    solve = predict.predictor(solution, params)
    out = {}
    for task in tasks:
        if task in targets:
            if answers and task in answers:
                targets[task] = answer_targets(answers[task], targets[task], task)
            safe = rel_io.redact(s, task, targets[task])
            tables = predict.ReleaseTables(safe.states, safe.network["links"], safe.queue_history, safe.prior, safe.counts, safe.network["path_link_incidence"], safe.state_labels)
            out[task] = solve(task, tables, targets[task], params or {})
    return out


def answer_targets(answers: DataFrame, templates: DataFrame, task: str) -> DataFrame:
    """The template rows that answers ask for; every answer must match one panel and split, and queue windows must be whole.

    The checks are one small aggregate each, run here.
    """
    keys = KEYS[task]
    found = validate.partition_answers(answers, templates, keys)
    wrong = found.where("matches <> 1").count()
    if wrong:
        raise validate.ContractError(f"{wrong} answers match no template row or several")
    rows = found.select(*keys, *[c for c in ("panel", "split") if c not in keys])
    if task == "queue":
        need = templates.join(rows.select("window_id").distinct(), "window_id", "left_semi")
        short = need.join(rows, keys, "left_anti").count()
        if short:
            raise validate.ContractError(f"{short} rows of answered queue windows have no answer")
    return rows.withColumns({v: F.lit(0).cast(dict(templates.dtypes)[v]) for v in VALUES[task]})


def summary(spark: SparkSession, runs: str) -> DataFrame:
    """A row for each run record below a folder; records may lack fields."""
    d = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "run.json").json(runs)
    names = ["run_id", "task", "solution", "benchmark_id", "status", "seconds", "peak_memory_mb", "scores"]
    return d.select(*[(F.col(n) if n in d.columns else F.lit(None)).alias(n) for n in names])


def write_summary(spark: SparkSession, runs: str, path: str) -> DataFrame:
    """``summary`` as one CSV file with a column for each score."""
    d = summary(spark, runs)
    kind = dict(d.dtypes)["scores"]
    scores = [f.name for f in d.schema["scores"].dataType.fields] if kind.startswith("struct") else []
    out = d.select(*[c for c in d.columns if c != "scores"], *[F.col(f"scores.`{s}`").alias(s) for s in scores]).orderBy("run_id")
    files.write_csv(out, path)
    return out


def compare(records: Sequence[Run]) -> list[dict]:
    """Scores and seconds of completed runs of one benchmark, task, panel list and evaluator; anything else raises."""
    if any(r.status != "completed" for r in records):
        raise ValueError("only completed runs compare")
    if len({(r.benchmark_id, r.task, tuple(sorted(r.panels))) for r in records}) != 1:
        raise ValueError("runs differ in benchmark, task or panels")
    if len({r.evaluator_hash for r in records}) != 1:
        raise ValueError("runs were scored by different code")
    return [{"run_id": r.run_id, "solution": r.solution, "seconds": r.seconds, **r.scores} for r in records]


SAME = ("task", "solution", "params", "profile", "solution_hash", "evaluator_hash", "dependencies", "commit")


def combine(spark: SparkSession, runs: Sequence[str], panels: Sequence[str], out: str | None = None) -> Run:
    """One record over runs of one solution on separate panels, scored from their metric rows and never from their means.

    Code, dependencies, parameters and profile must agree and the panels be
    covered once. Seconds add up; the peak memory is the largest.
    """
    parts = [Run(**files.read_json(spark, f"{r}/run.json")) for r in runs]
    got = sorted(p for r in parts for p in r.panels)
    if got != sorted(panels) or any(r.status != "completed" for r in parts):
        raise ValueError("the runs aren't one completed run for each panel")
    if differ := [k for k in SAME if len({json.dumps(getattr(r, k), sort_keys=True) for r in parts}) != 1]:
        raise ValueError(f"the runs differ in {differ}")
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [spark.read.parquet(f"{r}/metrics") for r in runs])
    one = parts[0]
    run = Run(f"combined-{uuid.uuid4().hex[:12]}", one.task, one.solution, hashlib.sha256(json.dumps(sorted(r.benchmark_id for r in parts)).encode()).hexdigest()[:16] if len({r.benchmark_id for r in parts}) > 1 else one.benchmark_id, sorted(panels), one.params, "completed", profile=one.profile)
    for k in SAME[4:]:
        setattr(run, k, getattr(one, k))
    run.baseline_hash = one.baseline_hash
    run.seconds = sum(r.seconds for r in parts)
    run.scores = {r["metric"]: r["value"] for r in metrics.hierarchical_mean(rows).collect()}
    if out:
        rows.write.parquet(f"{out}/metrics")
        _finish(spark, run, out, time.time(), rows)
    known = [r.peak_memory_mb for r in parts if r.peak_memory_mb is not None]
    run.peak_memory_mb = max(known, default=None)
    if out:
        files.write_json(spark, asdict(run), f"{out}/run.json")
    return run


def attach_baseline(run: Run, earlier: Sequence[Run], again) -> Run:
    """The newest completed baseline without parameters of the same benchmark, task, panels, evaluator, baseline code and dependencies, else a new one from ``again()``."""
    fits = lambda r: (r.benchmark_id, r.task, sorted(r.panels), r.evaluator_hash, r.baseline_hash, r.dependencies)
    for r in sorted(earlier, key=lambda r: r.run_id, reverse=True):
        if r.status == "completed" and r.solution == "baseline" and not r.params and fits(r) == fits(run):
            return r
    return again()


def report(run: Run, base: Run | None = None) -> str:
    """Markdown with each metric, the baseline's and the difference."""
    lines = [f"# {run.solution} on {run.task}", "", "| metric | value | baseline | difference |", "| --- | --- | --- | --- |"]
    for k, v in sorted(run.scores.items()):
        b = (base.scores if base else run.baseline_scores).get(k)
        lines.append(f"| {k} | {v:.6f} | {'' if b is None else f'{b:.6f}'} | {'' if b is None else f'{v - b:+.6f}'} |")
    return "\n".join(lines) + "\n"
