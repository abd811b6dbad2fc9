"""Every registered query with SQL against DuckDB on the smallest tables, if they are there."""

import math
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gridflow.operators import odme, windows
from gridflow.plans import driver_queries

SF = os.environ.get("GRIDFLOW_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    want = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_spaced_windows_are_spaced_and_can_take_no_more(spark):
    rules = windows.WindowRules(step_minutes=1440, spacing_minutes=2 * 1440, per_condition=3)
    every = [(r["panel"], r["condition"], r["timestamp"]) for r in windows.candidates(driver_queries.origin_grid(spark, SF), rules).collect()]
    got = entry.queries()["spaced_windows"](spark, SF).collect()
    chosen = {}
    for r in got:
        chosen.setdefault((r["panel"], r["condition"]), []).append(datetime.strptime(r["day"], "%Y-%m-%d"))
    assert got and set(chosen) == {(p, c) for p, c, _ in every}
    for key, days in chosen.items():
        days.sort()
        possible = [t for p, c, t in every if (p, c) == key]
        assert all((b - a).days >= 2 for a, b in zip(days, days[1:])) and set(days) <= set(possible) and len(days) <= 3
        assert len(days) == 3 or all(any(abs((t - d).days) < 2 for d in days) for t in possible)


def test_bounded_least_squares_meets_the_optimality_conditions(spark):
    got, prior, counts, inc = driver_queries.bounded_problem(spark, SF)
    flow = {(r["panel"], r["path_id"]): r["path_flow"] for r in got.collect()}
    b = {(r["panel"], r["path_id"]): float(r["path_flow"]) for r in prior.collect()}
    links = {}
    for r in inc.collect():
        links.setdefault((r["panel"], r["path_id"]), set()).add(r["link_id"])
    off = {(r["panel"], r["link_id"]): -float(r["count"]) for r in counts.collect()}
    for k, ls in links.items():
        for x in ls:
            off[k[0], x] += flow[k]
    assert flow.keys() == b.keys()
    for k, f in flow.items():
        gradient = sum(off[k[0], x] for x in links.get(k, ())) + 0.05 * (f - b[k])
        assert f >= 0 and gradient >= -1e-4 * max(1, b[k]) and abs(gradient * f) <= 1e-4 * max(1, b[k]) ** 2


def test_synthetic_flows_add_up(spark):
    inc, p = driver_queries.path_tables(spark, SF)
    truth, counts = odme.synthetic_scenarios(p.select("panel", "path_id", "path_flow"), inc, 3, 69420, noise=0.0)
    pairs = inc.distinct().groupBy("panel", "path_id").agg(F.count("*").alias("k"))
    want = {(r[0], r[1]): r[2] for r in truth.join(pairs, ["panel", "path_id"]).groupBy("panel", "scenario").agg(F.sum(F.col("path_flow") * F.col("k"))).collect()}
    got = {(r[0], r[1]): r[2] for r in counts.groupBy("panel", "scenario").agg(F.sum("count")).collect()}
    assert got == pytest.approx(want) and len(got) == 6
    rows = entry.queries()["synthetic_flows"](spark, SF).collect()
    assert len(rows) == 6 and {r["n"] for r in rows} == {p.count() // 2}
    spread = truth.join(p.select("panel", "path_id", F.col("path_flow").alias("b")), ["panel", "path_id"]).agg(F.stddev(F.log(F.col("path_flow") / F.col("b"))), F.avg(F.log(F.col("path_flow") / F.col("b")))).first()
    assert abs(spread[0] - 0.35) < 0.02 and abs(spread[1]) < 0.02


def test_every_order_gets_a_flow(spark):
    got = [r.path_id for r in entry.queries()["bounded_least_squares"](spark, SF).collect()]
    want = [r.o_orderkey for r in spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey").collect()]
    assert sorted(got) == sorted(want)
