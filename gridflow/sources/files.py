"""Small files on any Hadoop file system: text, JSON, single CSV files, digests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ssXXX"


def hadoop_path(spark: SparkSession, name: str):
    """(path, its file system)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(name)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, name: str) -> bool:
    p, fs = hadoop_path(spark, name)
    return fs.exists(p)


def write_text(spark: SparkSession, text: str, name: str) -> None:
    p, fs = hadoop_path(spark, name)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def write_json(spark: SparkSession, value: dict, name: str) -> None:
    write_text(spark, json.dumps(value, sort_keys=True, indent=1, default=str), name)


def read_json(spark: SparkSession, name: str) -> dict:
    return json.loads(spark.read.text(name, wholetext=True).first()["value"])


def write_csv(d: DataFrame, name: str) -> None:
    """One CSV file under its exact name, rows in the order of ``d``; one task writes it."""
    spark = d.sparkSession
    p, fs = hadoop_path(spark, name)
    staged, _ = hadoop_path(spark, f"{name}.tmp")
    d.coalesce(1).write.mode("overwrite").option("header", True).option("timestampFormat", TIME_FORMAT).csv(f"{name}.tmp")
    one = next((s.getPath() for s in fs.listStatus(staged) if s.getPath().getName().endswith(".csv")), None)
    fs.mkdirs(p.getParent())
    if one is None:  # Spark writes no part of a table without rows
        write_text(spark, ",".join(d.columns) + "\n", name)
    else:
        fs.rename(one, p)
    fs.delete(staged, True)


def file_digests(spark: SparkSession, folder: str) -> dict[str, str]:
    """SHA-256 of each Parquet file below a folder by its name in it; the files are read where the tasks run."""
    p, fs = hadoop_path(spark, folder)
    root = fs.getFileStatus(p).getPath().toString()
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(folder).select("path", F.sha2("content", 256).alias("sha")).collect()
    plain = lambda x: x.split(":", 1)[-1].lstrip("/")
    return {plain(r["path"])[len(plain(root)) + 1 :]: r["sha"] for r in rows}
