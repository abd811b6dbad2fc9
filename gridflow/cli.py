"""Commands: prepare, new, run, experiment, predict, package-ci, ci, compare, summary, combine, assemble, validate, fixture."""

from __future__ import annotations

import argparse
import json
import re
from datetime import date
from pathlib import Path

from gridflow import session
from gridflow.operators import predict, submit, validate
from gridflow.plans import lifecycle, shards
from gridflow.sources import files, fixture, release
from gridflow.sources.schemas import SCHEMAS

STARTER = '''"""A solution: a function for each task, of (tables, targets, params), that returns the targets' rows with predicted values.

Run it with ``--solution`` and this file's path. PARAMETERS names what params may hold.
"""

from gridflow.operators import predict

PARAMETERS = {{}}


def state(tables, targets, params):
    return predict.baseline("state", tables, targets, params)


def queue(tables, targets, params):
    return predict.baseline("queue", tables, targets, params)


def odme(tables, targets, params):
    return predict.baseline("odme", tables, targets, params)
'''


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gridflow")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *args: str, **options):
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a)
        for o, kw in options.items():
            c.add_argument(f"--{o.replace('_', '-')}", **kw)
        return c

    day = {"type": date.fromisoformat, "required": True}
    maybe = {"type": date.fromisoformat}
    several = {"action": "append"}
    spans = ("history_start", "history_end", "start", "end")
    dates = {k: day for k in spans}
    solver = {"solution": {"default": "baseline"}, "params": {"default": "{}"}}
    add("prepare", "release", "out", **dates, panel=several, profile={"default": "quick"}, scheme={})
    add("run", "release", "task", **{k: maybe for k in spans}, **solver, shortcut={"choices": sorted(lifecycle.SHORTCUTS)}, answers={}, panel=several, runs={"default": "runs"})
    add("experiment", "benchmark", "task", **solver, runs={}, panel=several, no_baseline={"action": "store_true"})
    add("predict", "release", "out", **dates, panel=several, **solver)
    add("assemble", "template", "predictions", "out", format={"default": "csv"}, parts={"action": "store_true"})
    add("validate", "template", "submission")
    add("compare", run=several)
    add("summary", "runs", csv={})
    add("combine", run=several, panel=several, out={})
    add("package-ci", "benchmark", "out")
    ci = sub.add_parser("ci").add_subparsers(dest="step", required=True)
    for name, args in {"matrix": ("index", "task"), "unpack": ("archive", "out", "sha256")}.items():
        c = ci.add_parser(name)
        for x in args:
            c.add_argument(x)
    c = ci.add_parser("combine")
    for x in ("--run", "--panel"):
        c.add_argument(x, action="append")
    c.add_argument("--out")
    add("fixture", "out", days={"type": int, "default": fixture.DAYS}, panel=several, validation_days={"type": int, "default": 0}, queue_days={"type": int, "default": 0})
    add("new", "name", folder={"default": "solutions"})
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "new":
        if not re.fullmatch("[a-z][a-z0-9_]*", a.name):
            raise ValueError("a name has lower-case letters, digits and underscores")
        path = Path(a.folder) / f"{a.name}.py"
        if path.exists():
            raise ValueError(f"{path} exists")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(STARTER.format())
        return 0
    if a.command == "ci" and a.step == "matrix":
        print(shards.archive_matrix(json.loads(Path(a.index).read_text()), a.task))
        return 0
    if a.command == "ci" and a.step == "unpack":
        print(shards.unpack(a.archive, a.out, a.sha256))
        return 0
    solution = predict.load(a.solution) if hasattr(a, "solution") else None
    spark = session.build()
    table = lambda path, name: spark.read.schema(SCHEMAS[name]).option("header", True).csv(path) if ".csv" in path else spark.read.parquet(path)
    if a.command == "prepare":
        scheme = lifecycle.Scheme.load(a.scheme) if a.scheme else lifecycle.Scheme()
        print(json.dumps(lifecycle.prepare(spark, a.release, a.out, a.history_start, a.history_end, a.start, a.end, a.panel, a.profile, scheme)["benchmark_id"]))
    elif a.command == "run":
        answers = release.Release(spark, a.answers.rsplit("/", 1)[0] or ".", False).csv(a.answers.rsplit("/", 1)[-1], f"{a.task}_targets") if a.answers else None
        run = lifecycle.run_release(spark, a.release, a.task, solution, a.panel, a.start, a.end, a.history_start, a.history_end, a.shortcut, answers, json.loads(a.params), a.runs)
        print(lifecycle.report(run))
    elif a.command == "experiment":
        run = lifecycle.experiment(spark, a.benchmark, a.task, solution, json.loads(a.params), a.runs, a.panel, not a.no_baseline)
        print(lifecycle.report(run))
    elif a.command == "predict":
        for task, d in lifecycle.predict_release(spark, a.release, a.start, a.end, a.history_start, a.history_end, a.panel, solution, json.loads(a.params)).items():
            d.write.parquet(f"{a.out}/{task}")
    elif a.command == "package-ci":
        folders = shards.package(spark, a.benchmark, f"{a.out}/folders")
        print(json.dumps(shards.archives(spark, folders, f"{a.out}/archives"), indent=1))
    elif a.command == "assemble":
        path = spark._jvm.org.apache.hadoop.fs.Path
        there = lambda t: path(f"{a.predictions}/{t}").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path(f"{a.predictions}/{t}"))
        submit.write_submission(table(a.template, "submission_key"), {t: spark.read.parquet(f"{a.predictions}/{t}") for t in ("state", "queue", "odme") if there(t)}, a.out, a.format, not a.parts)
    elif a.command == "validate":
        validate.require_valid(validate.submission_violations(table(a.submission, "submission"), table(a.template, "submission_key")), "submission")
    elif a.command == "compare":
        print(json.dumps(lifecycle.compare([lifecycle.Run(**files.read_json(spark, f"{r}/run.json")) for r in a.run]), indent=1))
    elif a.command == "summary":
        (lifecycle.write_summary(spark, a.runs, a.csv) if a.csv else lifecycle.summary(spark, a.runs)).show(1000, False)
    elif a.command in ("combine", "ci"):
        print(lifecycle.report(lifecycle.combine(spark, a.run, a.panel, a.out)))
    elif a.command == "fixture":
        fixture.make_fixture(spark, a.out, a.days, [(p, p.rsplit("_", 1)[0]) for p in a.panel] if a.panel else ((fixture.PANEL, fixture.FAMILY),), a.validation_days, a.queue_days)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
