"""Path flows: synthetic scenarios and the regularised non-negative least-squares estimate."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridflow.functions import normal
from gridflow.operators.metrics import matvec, network_keys

LOG_SIGMA, COUNT_NOISE, REGULARISATION = 0.35, 0.03, 0.05


def synthetic_scenarios(prior: DataFrame, incidence: DataFrame, cases: int, seed: int, log_sigma: float = LOG_SIGMA, noise: float = COUNT_NOISE) -> tuple[DataFrame, DataFrame]:
    """(truth, counts) of ``cases`` scenarios: prior flows times log-normal factors, and noisy link counts of them.

    The random numbers follow from the seed, scenario and key, so every
    partitioning and every retry gives the same scenarios. Panels, where both
    tables name them, are networks of their own.
    """
    panel = network_keys(prior, incidence)
    own = [F.col(k) for k in panel]
    flows = prior.withColumn("scenario", F.explode(F.sequence(F.lit(1), F.lit(cases)))) if cases > 0 else prior.withColumn("scenario", F.lit(1)).where(F.lit(False))
    truth = flows.withColumn("path_flow", F.col("path_flow") * F.exp(F.lit(log_sigma) * normal(F.lit(seed), F.col("scenario"), *own, F.col("path_id"))))
    clean = matvec(incidence, truth.select(*panel, "scenario", "path_id", "path_flow"), ["scenario"], out="count")
    counts = clean.withColumn("count", F.greatest(F.lit(0.0), F.col("count") * (1 + F.lit(noise) * normal(F.lit(seed + 1), F.col("scenario"), *own, F.col("link_id")))))
    return truth, counts


def solve(a: np.ndarray, c: np.ndarray, b: np.ndarray, weight: float, tol: float = 1e-10, most: int = 20_000) -> np.ndarray:
    """min |A f - c|^2 + weight |f - b|^2 over f >= 0: an active-set method on the strictly convex normal equations.

    Only the columns of the free paths are ever squared, so memory follows the
    paths in use and not all candidates. Raises RuntimeError if the optimality
    conditions aren't met in the end.
    """
    if weight <= 0:
        raise ValueError("the regularisation must be positive")
    n = len(b)
    g = a.T @ c + weight * b
    free = np.zeros(n, bool)
    f = np.zeros(n)
    slack = tol * max(1.0, float(np.abs(g).max(initial=0)))
    for _ in range(most):
        gain = np.where(free, -np.inf, a.T @ (c - a @ f) + weight * (b - f))
        if not n or gain.max() <= slack:
            return f
        free[int(gain.argmax())] = True
        while True:
            want = np.zeros(n)
            x = a[:, free]
            want[free] = np.linalg.solve(x.T @ x + weight * np.eye(x.shape[1]), g[free])
            low = free & (want <= 0)
            if not low.any():
                f = want
                break
            step = float((f[low] / (f[low] - want[low])).min())
            f = f + step * (want - f)
            free &= f > slack * 1e-3
            f[~free] = 0
    raise RuntimeError("path-flow estimate didn't converge")


def estimate_flows(prior: DataFrame, counts: DataFrame, incidence: DataFrame, by: Sequence[str] = ("panel", "split"), weight: float = REGULARISATION) -> DataFrame:
    """(by, path_id, path_flow): one bounded least-squares problem for each group, a network's candidate paths.

    A group is one scenario of one network, whose size is that of the network
    and doesn't grow with time or panels; groups are solved in parallel. Where
    incidence names panels, so must ``by``.
    """
    by = list(by)
    panel = [k for k in network_keys(prior, incidence) if k in by]
    if "panel" in incidence.columns and not panel:
        raise ValueError("an incidence of panels needs path flows by panel")
    pairs = incidence.select(*panel, "path_id", "link_id").distinct().groupBy(*panel, "path_id").agg(F.collect_list("link_id").alias("links"))
    p = prior.select(*by, "path_id", "path_flow").join(pairs, [*panel, "path_id"], "left")
    rows = p.select(*by, F.struct("path_id", "path_flow", "links").alias("path"), F.lit(None).cast("struct<link_id:string,count:double>").alias("measured"))
    more = counts.select(*by, F.lit(None).cast(rows.schema["path"].dataType).alias("path"), F.struct(F.col("link_id").cast("string").alias("link_id"), F.col("count").cast("double").alias("count")).alias("measured"))
    kinds = dict((f.name, f.dataType) for f in prior.schema.fields)
    schema = T.StructType([*[T.StructField(k, kinds[k]) for k in by], T.StructField("path_id", kinds["path_id"]), T.StructField("path_flow", T.DoubleType())])

    def run(pdf):
        import pandas as pd

        paths = sorted((x for x in pdf["path"] if x is not None), key=lambda x: x["path_id"])
        links = sorted((x for x in pdf["measured"] if x is not None), key=lambda x: x["link_id"])
        row = {x["link_id"]: i for i, x in enumerate(links)}
        a = np.zeros((len(links), len(paths)))
        for j, x in enumerate(paths):
            for link in x["links"] if x["links"] is not None else ():
                if str(link) in row:
                    a[row[str(link)], j] = 1.0
        f = solve(a, np.array([x["count"] for x in links]), np.array([x["path_flow"] for x in paths]), weight)
        out = pd.DataFrame({"path_id": [x["path_id"] for x in paths], "path_flow": f})
        for k in by:
            out[k] = pdf[k].iloc[0]
        return out[[f_.name for f_ in schema.fields]]

    return rows.unionByName(more).groupBy(*by).applyInPandas(run, schema)
