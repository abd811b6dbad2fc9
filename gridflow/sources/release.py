"""Reader of a partitioned release: config, network tables, daily state files, task tables."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridflow.functions import half_open, to_datetime
from gridflow.operators import labels
from gridflow.operators.rel import empty_table, normalize_keys
from gridflow.sources.schemas import KEYS, NETWORK_TABLES, SCHEMAS, SPLITS, VALUES

_DAY = re.compile(r"(20\d\d)_([01]\d)_([0-3]\d)\.parquet$")
#: Where task tables lie below the release (fixed values of the format).
TEMPLATES = {"state": "task1/{panel}/{split}/sample_submission_state.csv", "queue": "task2/{panel}/{split}/sample_submission_queue.csv", "odme": "task4/{panel}/{split}/sample_submission_path_flow.csv"}
WINDOW_INDEX, WINDOW_HISTORY = "task2/{panel}/{split}/window_index.csv", "task2/{panel}/{split}/window_history.parquet"
PRIOR, COUNTS = "task4/{panel}/{split}/synthetic_weak_prior.csv", "task4/{panel}/{split}/synthetic_link_counts.csv"
CALENDAR, CORRIDORS = "config/synthetic_release_v1.json", "config/corridors.json"


@dataclass(frozen=True)
class Interval:
    start: datetime
    end: datetime

    def meet(self, other: Interval) -> Interval | None:
        a, b = max(self.start, other.start), min(self.end, other.end)
        return Interval(a, b) if a < b else None


def _field(value: dict, name: str, kind: type, where: str):
    """A required field of a configuration file, of its type."""
    if not isinstance(value, dict) or not isinstance(value.get(name), kind):
        raise ValueError(f"{where}: {name} is missing or no {kind.__name__}")
    return value[name]


class Release:
    """A release folder on any Hadoop file system, listed once on the driver."""

    def __init__(self, spark: SparkSession, path: str, check: bool = True):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if check and CORRIDORS not in self.files:
            raise ValueError(f"{path} is no release folder: {CORRIDORS} is missing")

    @cached_property
    def _listed(self) -> list[tuple[str, int, int]]:
        root = self._path(self.path)
        if not self._fs.exists(root) or not self._fs.getFileStatus(root).isDirectory():
            raise ValueError(f"{self.path} is no folder")
        base = self._fs.getFileStatus(root).getPath().toString()
        it, out = self._fs.listFiles(root, True), []
        while it.hasNext():
            s = it.next()
            out.append((s.getPath().toString()[len(base) + 1 :], s.getLen(), s.getModificationTime()))
        return sorted(x for x in out if not x[0].rsplit("/", 1)[-1].startswith((".", "_")))

    @property
    def files(self) -> list[str]:
        return [x[0] for x in self._listed]

    @property
    def fingerprint(self) -> str:
        """SHA-256 of the names, sizes and times of all files."""
        return hashlib.sha256(json.dumps(self._listed).encode()).hexdigest()

    def json(self, name: str) -> dict:
        rows = self.spark.read.text(f"{self.path}/{name}", wholetext=True).collect()
        return json.loads(rows[0]["value"])

    @cached_property
    def families(self) -> dict[str, str]:
        """Family by panel; a panel that lacks one of the two names, or is named twice, raises."""
        rows = _field(self.json(CORRIDORS), "panels", list, CORRIDORS)
        pairs = [(_field(p, "corridor_id", str, CORRIDORS), _field(p, "family_id", str, CORRIDORS)) for p in rows]
        if len(dict(pairs)) != len(pairs):
            raise ValueError(f"{CORRIDORS} names a panel twice")
        return dict(pairs)

    @cached_property
    def calendar(self) -> dict[str, Interval]:
        """Interval by split; all splits must be there, in order and apart."""
        c = _field(self.json(CALENDAR), "synthetic_calendar", dict, CALENDAR)

        def read(split: str, name: str) -> datetime:
            at = datetime.fromisoformat(_field(_field(c, split, dict, CALENDAR), name, str, CALENDAR).replace("Z", "+00:00"))
            return at.astimezone(timezone.utc).replace(tzinfo=None) if at.tzinfo else at

        out = {s: Interval(read(s, "start"), read(s, "end_exclusive")) for s in SPLITS}
        ends = [x for i in out.values() for x in (i.start, i.end)]
        if any(i.start >= i.end for i in out.values()) or ends != sorted(ends):
            raise ValueError(f"{CALENDAR}: splits are empty, out of order or overlap")
        return out

    def has(self, name: str) -> bool:
        """Whether there is such a file, or a folder of part files under that name."""
        return name in self._names or any(f.startswith(f"{name}/") for f in self.files)

    @cached_property
    def _names(self) -> set[str]:
        return set(self.files)

    def csv(self, name: str, table: str, start=None, end=None) -> DataFrame:
        """A CSV file by its header: the table's columns, wherever they stand, in their types, further ones as text; optionally rows with start <= timestamp < end.

        Identifiers are text and empty cells null; a missing column raises.
        """
        raw = self.spark.read.option("header", True).csv(f"{self.path}/{name}")
        known = {f.name: f.dataType for f in SCHEMAS[table].fields}
        if absent := [c for c in known if c not in raw.columns]:
            raise ValueError(f"{name} has no columns {absent}")
        d = raw.select(*[F.col(c).cast(t).alias(c) for c, t in known.items()], *[c for c in raw.columns if c not in known])
        if "timestamp" in known and (start or end):
            d = d.where(half_open(F.col("timestamp"), start, end))
        return d

    def parquet(self, name: str, table: str) -> DataFrame:
        """A Parquet file with the table's columns and types; absent columns are null."""
        d = self.spark.read.parquet(f"{self.path}/{name}")
        return d.select(*[(F.col(f.name).cast(f.dataType) if f.name in d.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in SCHEMAS[table].fields])

    def network(self, panels: Sequence[str]) -> dict[str, DataFrame]:
        """Network tables of all panels with a column panel; the known seven are required, others are read as text."""
        out: dict[str, DataFrame] = {}
        for p in panels:
            prefix = f"corridors/{p}/network/"
            stems = {f[len(prefix) : -4]: f for f in self.files if f.startswith(prefix) and f.endswith(".csv")}
            if missing := [t for t in NETWORK_TABLES if t not in stems]:
                raise ValueError(f"{p}: network tables missing: {missing}")
            for stem, f in stems.items():
                d = self.csv(f, stem) if stem in SCHEMAS else self.spark.read.option("header", True).csv(f"{self.path}/{f}")
                d = d.withColumn("panel", F.lit(p))
                out[stem] = out[stem].unionByName(d, allowMissingColumns=True) if stem in out else d
        return out

    def states(self, panels: Sequence[str], splits: Sequence[str], kind: str, start, end, allow_empty: bool = False) -> DataFrame:
        """Daily files of one kind with panel and split, rows with start <= timestamp < end.

        Files whose name tells a day outside the interval aren't opened; the
        rest are one scan, whose rows get panel and split from their file's
        path. Nothing runs here; ``require_rows`` tells an empty table.
        """
        a, b = to_datetime(start), to_datetime(end)
        schema = SCHEMAS[kind]
        chosen = []
        for f in self.files:
            m = re.fullmatch(f"corridors/([^/]+)/([^/]+)/{kind}/.*\\.parquet", f)
            if not m or m[1] not in panels or m[2] not in splits:
                continue
            if day := _DAY.search(f):
                first = datetime(*map(int, day.groups()))
                if first + timedelta(days=1) <= a or first >= b:
                    continue
            chosen.append(f"{self.path}/{f}")
        if not chosen:
            if allow_empty:
                return empty_table(self.spark, schema).withColumns({"panel": F.lit(""), "split": F.lit("")})
            raise ValueError(f"no {kind} files for {list(panels)}/{list(splits)} in [{start}, {end})")
        d = self.spark.read.option("mergeSchema", True).option("recursiveFileLookup", True).parquet(*chosen)
        place = lambda i: F.regexp_extract(F.col("_metadata.file_path"), f"/corridors/([^/]+)/([^/]+)/{kind}/", i)
        columns = [(F.col(f.name).cast(f.dataType) if f.name in d.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields]
        rows = d.select(*columns, place(1).alias("panel"), place(2).alias("split"))
        return rows.where(half_open(F.col("timestamp"), F.lit(a).cast("timestamp"), F.lit(b).cast("timestamp")))

    def split_parts(self, start, end) -> dict[str, Interval]:
        """Each split's part of [start, end)."""
        want = Interval(to_datetime(start), to_datetime(end))
        return {s: m for s, i in self.calendar.items() if (m := i.meet(want))}

    def table(self, panels: Sequence[str], splits: Sequence[str], pattern: str, table: str) -> DataFrame | None:
        """One task table of all panels and splits that have it, with panel and split; None if none has."""
        parts = []
        for p in panels:
            for s in splits:
                f = pattern.format(panel=p, split=s)
                if self.has(f):
                    d = self.parquet(f, table) if f.endswith(".parquet") else self.csv(f, table)
                    parts.append(d.withColumns({"panel": F.lit(p), "split": F.lit(s)}))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None


def require_rows(d: DataFrame, what: str) -> DataFrame:
    """``d``, after a look for one row; an empty table raises."""
    if d.isEmpty():
        raise ValueError(f"no rows of {what}")
    return d


def check_dates(history_start: date, history_end: date, prediction_start: date, prediction_end: date, calendar: dict[str, Interval]) -> None:
    """The history lies in the training split and ends before the prediction, which ends with the last split."""
    hs, he, ps, pe = map(to_datetime, (history_start, history_end, prediction_start, prediction_end))
    train = calendar["train"]
    if not train.start <= hs < he <= train.end:
        raise ValueError("the history must be a non-empty part of the training split")
    if not he <= ps < pe:
        raise ValueError("the prediction must start at the history's end or later and not be empty")
    if pe > max(i.end for i in calendar.values()):
        raise ValueError("the prediction ends after the release")


@dataclass
class ReleaseSlice:
    """What a solution may read, all tables with panel and split, and the labels of the history."""

    network: dict[str, DataFrame]
    states: DataFrame
    ramps: DataFrame
    queue_history: DataFrame | None
    queue_index: DataFrame | None
    prior: DataFrame | None
    counts: DataFrame | None
    state_labels: DataFrame | None
    queue_labels: DataFrame | None
    seed: int = 0


def load_slice(release: Release, panels: Sequence[str], history_start, history_end, prediction_start, prediction_end, seed: int = 0) -> ReleaseSlice:
    """Masked states and ramps of [history start, prediction end), histories of forecast windows in that range, whole path tables, and labels of the history."""
    splits = list(release.split_parts(history_start, prediction_end))
    a, b = F.lit(to_datetime(history_start)), F.lit(to_datetime(prediction_end))
    net = release.network(panels)
    for p in panels:
        for x in splits:
            if release.has(WINDOW_INDEX.format(panel=p, split=x)) and not release.has(WINDOW_HISTORY.format(panel=p, split=x)):
                raise ValueError(f"{p}/{x} has forecast windows without their history")
    index = release.table(panels, splits, WINDOW_INDEX, "queue_window_index")
    history = release.table(panels, splits, WINDOW_HISTORY, "queue_history")
    if index is not None:
        index = index.where((F.col("forecast_start") >= a) & (F.col("forecast_start") < b))
        if history is not None:
            history = history.join(index.select("panel", "split", "window_id").distinct(), ["panel", "split", "window_id"], "left_semi")
    return ReleaseSlice(
        net,
        release.states(panels, splits, "mainline_states_masked", history_start, prediction_end, allow_empty=True),
        release.states(panels, splits, "ramp_states", history_start, prediction_end, allow_empty=True),
        history,
        index,
        release.table(panels, splits, PRIOR, "weak_prior"),
        release.table(panels, splits, COUNTS, "link_counts"),
        *historical_labels(release, panels, net, history_start, history_end),
        seed,
    )


def historical_labels(release: Release, panels: Sequence[str], network: dict[str, DataFrame], history_start, history_end) -> tuple[DataFrame | None, DataFrame | None]:
    """(state, queue) labels of the history, from unmasked training states; each None where the release has no template."""
    measured = release.states(panels, ["train"], "mainline_states", history_start, history_end, allow_empty=True)
    a, b = to_datetime(history_start), to_datetime(history_end)
    state = release.table(panels, ["train"], TEMPLATES["state"], "state_targets")
    if state is not None:
        rows = state.where(half_open(F.col("timestamp"), F.lit(a), F.lit(b)))
        state = labels.state_answers(rows, measured, ["panel", "timestamp", "station_id", "link_id"])
    queue = release.table(panels, ["train"], TEMPLATES["queue"], "queue_targets")
    index = release.table(panels, ["train"], WINDOW_INDEX, "queue_window_index")
    if queue is not None and index is not None:
        rows = labels.historical_queue_labels(queue, index, a, b)
        means = labels.link_conditions(measured, ["panel", "timestamp", "link_id"])
        free = network["links"].select("panel", "link_id", "free_speed_kmh")
        d = rows.join(means, ["panel", "timestamp", "link_id"], "left").join(free, ["panel", "link_id"], "left")
        queue = d.where(F.coalesce("all_eligible", F.lit(False))).select("panel", *KEYS["queue"], labels.is_queued("mean_speed", "free_speed_kmh").alias("queue_true"))
    else:
        queue = None
    return state, queue


def load_targets(release: Release, panels: Sequence[str], start, end) -> dict[str, DataFrame]:
    """Targets of [start, end) by task, with panel and split and placeholder values: states by time, queue windows if complete, path flows by split."""
    parts = release.split_parts(start, end)
    out = {}
    for task, pattern in TEMPLATES.items():
        tables = []
        for s, i in parts.items():
            d = release.table(panels, [s], pattern, f"{task}_targets")
            if d is None:
                continue
            a, b = F.lit(i.start), F.lit(i.end)
            if task == "state":
                d = d.where((F.col("timestamp") >= a) & (F.col("timestamp") < b))
            elif task == "queue":
                d = labels.complete_windows(d, "window_id", "timestamp", i.start, i.end)
            tables.append(d)
        if tables:
            d = reduce(DataFrame.unionByName, tables)
            keys = KEYS[task]
            out[task] = normalize_keys(d, keys).select(*dict.fromkeys([*keys, "panel", "split"]), *[F.lit(0).cast(SCHEMAS[f"{task}_targets"][v].dataType).alias(v) for v in VALUES[task]])
    return out


REDACTED = {"state": ["speed_kmh", "flow_vph", "occupancy", "density_occ_linear_vehpkm"], "queue": ["speed_kmh", "flow_vph", "occupancy", "density_occ_linear_vehpkm", "pct_observed", "is_observed", "is_imputed", "is_score_eligible", "is_missing"]}


def redact(s: ReleaseSlice, task: str, targets: DataFrame) -> ReleaseSlice:
    """The slice without what it would tell about the targets: measurements of the same cells (state), or of the forecast times of any split, at once for all of them (queue)."""
    from dataclasses import replace

    from gridflow.operators.rel import redact_rows

    if task == "state":
        return replace(s, states=redact_rows(s.states, targets, ["panel", "split", "timestamp", "station_id", "link_id"], REDACTED["state"]))
    if task == "queue":
        keys, columns = ["panel", "timestamp"], REDACTED["queue"]
        return replace(s, states=redact_rows(s.states, targets, keys, columns), ramps=redact_rows(s.ramps, targets, keys, columns), queue_history=redact_rows(s.queue_history, targets, keys, columns) if s.queue_history is not None else None)
    return s
