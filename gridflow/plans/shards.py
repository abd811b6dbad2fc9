"""A benchmark by panels: separate folders that run on their own and whose results combine."""

from __future__ import annotations

import hashlib
import json
import shutil
import tarfile
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gridflow.plans.lifecycle import content_hash, verify_benchmark
from gridflow.sources.files import file_digests, hadoop_path, read_json, write_json


def package(spark: SparkSession, benchmark: str, out: str) -> list[str]:
    """A folder below ``out`` for each panel with its rows of every table and a manifest of its own; returns the folders.

    Each table is read once and written partitioned by panel, then its parts
    are found by their partition; no loop filters the table again.
    """
    m = verify_benchmark(spark, benchmark)
    p, fs = hadoop_path(spark, out)
    if fs.exists(p) and len(fs.listStatus(p)):
        raise ValueError(f"{out} isn't empty")
    for t in m["tables"]:
        spark.read.parquet(f"{benchmark}/{t}").withColumn("__panel", F.col("panel")).repartition("__panel").write.partitionBy("__panel").parquet(f"{out}/.parts/{t}")
    path = spark._jvm.org.apache.hadoop.fs.Path
    folders = []
    for p in m["panels"]:
        tables = {}
        fs.mkdirs(path(f"{out}/{p}"))
        for t in m["tables"]:
            part = path(f"{out}/.parts/{t}/__panel={p}")
            if fs.exists(part):
                fs.rename(part, path(f"{out}/{p}/{t}"))
            else:
                spark.read.parquet(f"{benchmark}/{t}").where(F.lit(False)).write.parquet(f"{out}/{p}/{t}")
            tables[t] = content_hash(spark.read.parquet(f"{out}/{p}/{t}"))
        write_json(spark, {**m, "panels": [p], "families": {p: m["families"][p]}, "tables": tables, "files": file_digests(spark, f"{out}/{p}")}, f"{out}/{p}/manifest.json")
        folders.append(f"{out}/{p}")
    fs.delete(path(f"{out}/.parts"), True)
    return folders


def matrix(spark: SparkSession, folders: list[str], task: str) -> str:
    """JSON list of the shards that have rows of the task's targets."""
    rows = [{"panel": read_json(spark, f"{f}/manifest.json")["panels"][0], "path": f} for f in folders if not spark.read.parquet(f"{f}/{task}_targets").isEmpty()]
    return json.dumps({"include": rows})


#: Largest archive that a hosted release takes.
MOST_BYTES = 2 * 1024**3
TASKS = ("state", "queue", "odme")


def sha256(path: Path) -> str:
    with path.open("rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def archives(spark: SparkSession, folders: list[str], out: str) -> dict:
    """A tar.gz beside the others for each panel's folder, and an index of their digests and tasks; ``out`` is an empty folder of the driver.

    Archives are for upload from the driver's machine, so they are made there.
    """
    target = Path(out)
    if target.exists() and any(target.iterdir()):
        raise ValueError(f"{out} isn't empty")
    target.mkdir(parents=True, exist_ok=True)
    index: dict = {"profile": "", "benchmark_id": "", "shards": []}
    for folder in folders:
        m = read_json(spark, f"{folder}/manifest.json")
        index |= {"profile": m["profile"], "benchmark_id": m["benchmark_id"]}
        local = target / f".{m['panels'][0]}"
        p, fs = hadoop_path(spark, folder)
        fs.copyToLocalFile(False, p, spark._jvm.org.apache.hadoop.fs.Path(local.resolve().as_uri()), True)
        archive = target / f"{m['profile']}-{m['panels'][0]}.tar.gz"
        with tarfile.open(archive, "w:gz", compresslevel=1) as tar:
            for f in sorted(x for x in local.rglob("*") if x.is_file()):
                name = f.relative_to(local)
                if name.parts[0] in m["tables"] or name.name == "manifest.json":
                    tar.add(f, arcname=str(name), recursive=False)
        shutil.rmtree(local)
        if archive.stat().st_size >= MOST_BYTES:
            raise ValueError(f"{archive.name} has {MOST_BYTES} bytes or more")
        tasks = [t for t in TASKS if f"{t}_targets" in m["tables"] and not spark.read.parquet(f"{folder}/{t}_targets").isEmpty()]
        index["shards"].append({"panel": m["panels"][0], "asset": archive.name, "sha256": sha256(archive), "tasks": tasks})
    (target / f"{index['profile']}-index.json").write_text(json.dumps(index, indent=1))
    return index


def archive_matrix(index: dict, task: str) -> str:
    """JSON list of the archives that hold cases of a task."""
    return json.dumps({"include": [{k: s[k] for k in ("panel", "asset", "sha256")} for s in index["shards"] if task in s["tasks"]]})


def unpack(archive: str, out: str, expected: str) -> str:
    """Extract an archive whose digest is the expected one and that holds regular files only; returns the folder."""
    path = Path(archive)
    if sha256(path) != expected:
        raise ValueError(f"{path.name} isn't the archive of the index")
    with tarfile.open(path, "r:gz") as tar:
        if any(not m.isfile() for m in tar.getmembers()):
            raise ValueError(f"{path.name} holds more than regular files")
        Path(out).mkdir(parents=True, exist_ok=True)
        tar.extractall(out, filter="data")
    return out
