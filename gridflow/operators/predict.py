"""Predictors over DataFrames, and their registry."""

from __future__ import annotations

import importlib.util
import inspect
import sys
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, fields, replace
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridflow.functions import any_true, not_negative, week_slot
from gridflow.operators.labels import MIN_OBSERVED_PERCENT, eligible, is_queued
from gridflow.operators.metrics import network_keys
from gridflow.operators.odme import REGULARISATION, estimate_flows
from gridflow.operators.rel import join_unique, latest_per_group, restore_answers
from gridflow.operators.series import interpolate


@dataclass
class ReleaseTables:
    """The tables that a predictor may see; each has the columns panel and split."""

    states: DataFrame
    links: DataFrame
    queue_history: DataFrame | None = None
    prior: DataFrame | None = None
    counts: DataFrame | None = None
    incidence: DataFrame | None = None
    state_labels: DataFrame | None = None
    extra: dict[str, DataFrame] = field(default_factory=dict)


def weekly_profile(states: DataFrame, targets: DataFrame, values: Sequence[str] = ("speed_kmh", "flow_vph"), link: str = "link_id", panel: Sequence[str] = (), time: str = "timestamp", minutes: int = 5, good=None) -> DataFrame:
    """targets with values from the mean of the link's slot of the week, else of the link, else of the panel; never negative.

    ``good`` says which rows of states count. The panel's mean is one row for
    each panel and is joined by key or as a single row.
    """
    slot = week_slot(F.col(time), minutes)
    s = (states.where(good) if good is not None else states).select(*panel, link, slot.alias("__slot"), *values)
    key = [*panel, link]
    means = lambda by, mark: s.groupBy(*by).agg(*[F.avg(v).alias(f"__{mark}_{v}") for v in values])
    d = targets.drop(*values).withColumn("__slot", slot)
    d = d.join(means([*key, "__slot"], "s"), [*key, "__slot"], "left").join(means(key, "l"), key, "left")
    d = d.join(means(panel, "p"), list(panel), "left") if panel else d.crossJoin(F.broadcast(means([], "p")))
    return d.select(*[c for c in targets.columns if c not in values], *[not_negative(F.coalesce(f"__s_{v}", f"__l_{v}", f"__p_{v}")).alias(v) for v in values])


def baseline_state(tables: ReleaseTables, targets: DataFrame) -> DataFrame:
    """Weekly profile of states with the answers of the history put back; where a panel has no data the free speed and no flow."""
    states = tables.states
    if tables.state_labels is not None:
        states = restore_answers(states, tables.state_labels, ["panel", "timestamp", "station_id", "link_id"], ["speed_kmh", "flow_vph"])
    d = weekly_profile(states, targets, panel=("panel",), good=eligible())
    free = tables.links.select("panel", "link_id", "free_speed_kmh")
    out = join_unique(d, free, ["panel", "link_id"])
    return out.withColumns({"speed_kmh": F.coalesce("speed_kmh", "free_speed_kmh", F.lit(0.0)), "flow_vph": F.coalesce("flow_vph", F.lit(0.0))}).select(*targets.columns)


def queue_persistence(history: DataFrame, targets: DataFrame, links: DataFrame) -> DataFrame:
    """targets with queue_pred: each link's state at its window's latest history time; missing or badly observed rows are no queue.

    Links are unique, within their panel where history and links both name it.
    """
    link = [*network_keys(history, links), "link_id"]
    if len(link) == 1 and "panel" in links.columns:
        raise ValueError("links of panels need a history that names its panel")
    last = join_unique(latest_per_group(history, ["window_id"], "timestamp"), links.select(*link, "free_speed_kmh"), link)
    seen = F.col("pct_observed") >= MIN_OBSERVED_PERCENT
    q = last.groupBy("window_id", "link_id").agg(any_true(seen & (is_queued("speed_kmh", "free_speed_kmh") == 1)).alias("__q"))
    d = targets.drop("queue_pred").join(q, ["window_id", "link_id"], "left")
    return d.withColumn("queue_pred", F.coalesce(F.col("__q").cast("long"), F.lit(0).cast("long"))).drop("__q")


def interpolate_blend(states: DataFrame, base: DataFrame, values: Sequence[str] = ("speed_kmh", "flow_vph"), by: Sequence[str] = ("panel", "station_id", "link_id"), time: str = "timestamp", blend: float = 0.5) -> DataFrame:
    """base mixed with the interpolated series: (1 - blend) base + blend series, base alone where the series has no value."""
    if not 0 <= blend <= 1:
        raise ValueError("blend must lie in [0, 1]")
    s = interpolate(states.select(*by, time, *values), list(values), by, time, [f"__{v}" for v in values])
    d = base.join(s.select(*by, time, *[f"__{v}" for v in values]).dropDuplicates([*by, time]), [*by, time], "left")
    return d.withColumns({v: (1 - blend) * F.col(v) + blend * F.coalesce(f"__{v}", v) for v in values}).select(*base.columns)


def baseline(task: str, tables: ReleaseTables, targets: DataFrame, params: dict) -> DataFrame:
    """The built-in predictors: weekly profile, persistence, regularised path flows."""
    if task == "state":
        return baseline_state(tables, targets)
    if task == "queue":
        return queue_persistence(tables.queue_history, targets, tables.links)
    weight = float(params.get("regularisation", REGULARISATION))
    by = [c for c in ("panel", "split", "scenario") if c in targets.columns]
    flows = estimate_flows(tables.prior, tables.counts, tables.incidence, by, weight)
    return targets.drop("path_flow").join(flows, [*by, "path_id"], "left").select(*targets.columns)


def blended(task: str, tables: ReleaseTables, targets: DataFrame, params: dict) -> DataFrame:
    """The built-in example: the state baseline blended with interpolated series."""
    out = baseline(task, tables, targets, params)
    return interpolate_blend(tables.states, out, blend=float(params.get("blend", 0.5))) if task == "state" else out


Predictor = Callable[[str, ReleaseTables, DataFrame, dict], DataFrame]


@dataclass(frozen=True)
class Parameter:
    """What a parameter may be: a type, and for numbers the range, whose ends count."""

    kind: type = object
    least: float | None = None
    most: float | None = None

    def check(self, name: str, value) -> None:
        number = self.kind in (int, float)
        fits = isinstance(value, (int, float) if self.kind is float else self.kind) and not (number and isinstance(value, bool))
        if not fits or (number and value != value):
            raise ValueError(f"{name} must be of type {self.kind.__name__}")
        if (self.least is not None and value < self.least) or (self.most is not None and value > self.most):
            raise ValueError(f"{name} must lie between {self.least} and {self.most}")


_WEIGHT = {"regularisation": Parameter(float, 1e-12)}
_PREDICTORS: dict[str, tuple[Predictor, dict[str, Parameter]]] = {"baseline": (baseline, _WEIGHT), "example": (blended, {**_WEIGHT, "blend": Parameter(float, 0.0, 1.0)})}


_SOURCES: dict[str, Path] = {}


def register(name: str, predictor: Predictor, parameters: Sequence[str] | Mapping[str, Parameter] = ()) -> None:
    """Add a predictor: (task, tables, targets with placeholder values, params) -> the targets' rows with predicted values."""
    if not name.isidentifier() or name != name.lower():
        raise ValueError("a name has lower-case letters, digits and underscores")
    _PREDICTORS[name] = (predictor, dict(parameters) if isinstance(parameters, Mapping) else {p: Parameter() for p in parameters})


def predictor(name: str, params: dict | None = None) -> Predictor:
    if name not in _PREDICTORS:
        raise ValueError(f"no predictor {name}; there are {sorted(_PREDICTORS)}")
    f, known = _PREDICTORS[name]
    if unknown := set(params or {}) - set(known):
        raise ValueError(f"{name} has no parameters {sorted(unknown)}")
    for k, v in (params or {}).items():
        known[k].check(k, v)
    return f


def load(solution: str) -> str:
    """The name of a predictor: a registered one, or that of a Python file or package folder, which is imported.

    The module registers a predictor under its own name, or has a function for
    each task that it solves: state, queue or odme of (tables, targets, params).
    """
    if solution in _PREDICTORS:
        return solution
    path = Path(solution)
    source = path / "__init__.py" if path.is_dir() else path
    if not source.is_file():
        raise ValueError(f"{solution} is neither a registered predictor nor a file")
    name = path.name if path.is_dir() else path.stem
    spec = importlib.util.spec_from_file_location(name, source, submodule_search_locations=[str(path)] if path.is_dir() else None)
    module = importlib.util.module_from_spec(spec)
    sys.modules[name] = module
    spec.loader.exec_module(module)
    tasks = {t: f for t in ("state", "queue", "odme") if callable(f := getattr(module, t, None))}
    if name not in _PREDICTORS:
        if not tasks:
            raise TypeError(f"{source} registers no predictor {name} and has no function of a task")

        def solve(task: str, tables: ReleaseTables, targets: DataFrame, params: dict) -> DataFrame:
            if task not in tasks:
                raise TypeError(f"{name} has no function {task}")
            return tasks[task](tables, targets, params)

        register(name, solve, getattr(module, "PARAMETERS", ()))
    _SOURCES[name] = source
    return name


def source(name: str) -> Path:
    """The file that a predictor comes from."""
    return _SOURCES.get(name) or Path(inspect.getsourcefile(predictor(name)))


def map_panels(tables: ReleaseTables, targets: DataFrame, params: dict, predict_panel: Callable[[str, ReleaseTables, DataFrame, dict], DataFrame], panels: Sequence[str]) -> DataFrame:
    """The union of a predictor's results on each panel alone: (panel, its tables, its targets, params).

    One plan for each panel of the list; a predictor that can take panel as a
    key among others needs no such loop.
    """
    def own(d, panel: str):
        return d.where(F.col("panel") == panel) if isinstance(d, DataFrame) and "panel" in d.columns else d

    out = []
    for panel in panels:
        part = {f.name: own(getattr(tables, f.name), panel) for f in fields(tables) if f.name != "extra"}
        one = replace(tables, **part, extra={k: own(d, panel) for k, d in tables.extra.items()})
        out.append(predict_panel(panel, one, own(targets, panel), params).select(*targets.columns))
    return reduce(DataFrame.unionByName, out)
