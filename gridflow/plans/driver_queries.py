"""Every operator as a query over the driver's tables, with its DuckDB twin.

Roles: events are a detector series (user_id = link, ts, value, coverage k in
props), lineitem is a prediction against part means, suppliers' nations and
regions are panels and families, orders and parts are paths and links.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridflow.functions import all_true, any_true, half_open, hash_seed, is_finite, iso_text, week_slot
from gridflow.operators import labels, metrics, odme, predict, rel, series, submit, validate, windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    """The series with its coverage k."""
    e = read(spark, d, "events")
    return e.select("event_id", "ts", "user_id", "event_type", "value", F.regexp_extract("props", '"k": ([0-9]+)', 1).cast("int").alias("k"))


_E = """e AS (SELECT event_id, ts, user_id, event_type, value, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INTEGER) AS k FROM events)"""
#: A daily grid of all users, the mean of well observed values of each day.
_GRID = f"""{_E}, days AS (SELECT unnest(generate_series(a, b, INTERVAL 1 DAY)) AS day FROM (SELECT date_trunc('day', min(ts)) AS a, date_trunc('day', max(ts)) AS b FROM e)),
m AS (SELECT user_id, date_trunc('day', ts) AS day, avg(CASE WHEN k >= 40 THEN value END) AS v, bool_and(k >= 20) AS good, count(*) AS n FROM e GROUP BY ALL),
g AS (SELECT u.user_id, days.day, m.v, coalesce(m.good, false) AS good, coalesce(m.n, 0) AS n FROM (SELECT DISTINCT user_id FROM e) u CROSS JOIN days LEFT JOIN m ON m.user_id = u.user_id AND m.day = days.day)"""


def grid(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    m = e.groupBy("user_id", "day").agg(F.avg(F.when(F.col("k") >= 40, F.col("value"))).alias("v"), F.bool_and(F.col("k") >= 20).alias("good"), F.count("*").alias("n"))
    return series.densify_grid(m, "user_id", "day", "1 day").withColumns({"good": F.coalesce("good", F.lit(False)), "n": F.coalesce("n", F.lit(0))})


def r(c, n: int = 6):
    return F.round(c, n)


# --- relational --------------------------------------------------------------------------------


@query("SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, value FROM events")
def normalize_keys(spark, d):
    e = rel.normalize_keys(read(spark, d, "events"), ["user_id", "ts"], "ts")
    return e.select("event_id", "user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "value")


@query("SELECT CAST(user_id AS VARCHAR) AS user_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts FROM events")
def canonical_keys(spark, d):
    return rel.canonical_keys(read(spark, d, "events"), ["user_id", "ts"], "ts")


@query("SELECT DISTINCT l_partkey, l_suppkey, 0 AS speed_kmh, 0 AS flow_vph FROM lineitem")
def target_template(spark, d):
    return rel.target_template(read(spark, d, "lineitem"), ["l_partkey", "l_suppkey"], ["speed_kmh", "flow_vph"])


@query("SELECT event_id, user_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12'")
def half_open_filter(spark, d):
    e = read(spark, d, "events")
    return e.where(half_open(F.col("ts"), F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-12").cast("timestamp_ntz"))).select("event_id", "user_id", "value")


@query(f"WITH {_E} SELECT event_id, user_id, value, k FROM e WHERE k >= 75 AND value IS NOT NULL")
def eligible_rows(spark, d):
    return events(spark, d).where(labels.eligible("value", None, "k")).select("event_id", "user_id", "value", "k")


@query("SELECT o_orderkey, o_custkey, c_name, c_mktsegment, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def dim_enrich_left(spark, d):
    o, c, n = (read(spark, d, t) for t in ("orders", "customer", "nation"))
    dim = c.join(n.withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey", "left")
    return rel.join_unique(o.withColumnRenamed("o_custkey", "c_custkey"), dim, ["c_custkey"]).select("o_orderkey", F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment", "n_name")


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_join(spark, d):
    return read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left_semi").select("doc_id", "lang", "source")


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join(spark, d):
    return read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left_anti").select("doc_id", "lang", "source")


@query("SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def distinct_keys(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct()


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return rel.duplicate_keys(read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def union_all(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    return c.unionByName(read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")))


@query("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, CAST(NULL AS INTEGER) AS size FROM customer UNION ALL SELECT p_partkey, p_name, NULL, p_size FROM part")
def union_diagonal(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return rel.union_diagonal(c, read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))).select("id", "name", "segment", "size")


@query("SELECT doc_id, 'missing' AS side FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels WHERE quality = 1) UNION ALL SELECT doc_id, 'extra' FROM (SELECT doc_id FROM labels WHERE quality = 1 EXCEPT SELECT doc_id FROM documents)")
def keyset_difference(spark, d):
    return rel.keyset_difference(read(spark, d, "documents"), read(spark, d, "labels").where("quality = 1"), ["doc_id"])


_CAL = "(VALUES ('train', DATE '2024-01-01', DATE '2024-01-16'), ('validation', DATE '2024-01-16', DATE '2024-01-24'), ('private', DATE '2024-01-24', DATE '2024-02-01'))"


def calendar(spark):
    rows = [("train", "2024-01-01", "2024-01-16"), ("validation", "2024-01-16", "2024-01-24"), ("private", "2024-01-24", "2024-02-01")]
    return spark.createDataFrame(rows, "split string, start string, end string").select("split", F.to_date("start").alias("start"), F.to_date("end").alias("end"))


@query(f"""WITH c(split, a, b) AS (SELECT * FROM {_CAL}), i AS (SELECT split, greatest(a, DATE '2024-01-10') AS a, least(b, DATE '2024-01-20') AS b FROM c)
SELECT i.split, count(*) AS n, round(sum(value), 4) AS total FROM i JOIN events ON ts >= a AND ts < b WHERE a < b GROUP BY i.split""")
def split_interval(spark, d):
    i = rel.split_intervals(calendar(spark), F.to_date(F.lit("2024-01-10")), F.to_date(F.lit("2024-01-20")))
    days = i.select("split", F.explode(F.sequence("start", F.date_sub("end", 1))).alias("date"))  # three rows of a calendar, by day
    e = read(spark, d, "events").withColumn("date", F.to_date("ts"))
    return e.join(F.broadcast(days), "date").groupBy("split").agg(F.count("*").alias("n"), r(F.sum("value"), 4).alias("total"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def sort_limit(spark, d):
    return read(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query(f"WITH {_E} SELECT event_id, coalesce(CASE WHEN k >= 75 THEN value END, CASE WHEN k >= 50 THEN round(value, 1) END) AS value FROM e")
def restore_answers(spark, d):
    e = events(spark, d)
    observed = e.select("event_id", F.when(F.col("k") >= 75, F.col("value")).alias("value"))
    answers = e.where("k >= 50").select("event_id", r(F.col("value"), 1).alias("value"))
    return rel.restore_answers(observed, answers, ["event_id"], ["value"])


@query(f"WITH {_E} SELECT event_id, user_id, CASE WHEN h.u IS NOT NULL THEN NULL ELSE value END AS value, CASE WHEN h.u IS NOT NULL THEN NULL ELSE event_type END AS event_type FROM e LEFT JOIN (SELECT DISTINCT user_id AS u, date_trunc('day', ts) AS day FROM e WHERE k > 95) h ON u = user_id AND h.day = date_trunc('day', ts)")
def redact_rows(spark, d):
    e = events(spark, d).withColumn("day", F.to_date("ts"))
    return rel.redact_rows(e, e.where("k > 95"), ["user_id", "day"], ["value", "event_type", "absent"]).select("event_id", "user_id", "value", "event_type")


@query("SELECT event_id, user_id, value FROM (SELECT *, max(ts) OVER (PARTITION BY user_id) AS m FROM events) WHERE ts = m")
def latest_per_group(spark, d):
    return rel.latest_per_group(read(spark, d, "events"), ["user_id"], "ts").select("event_id", "user_id", "value")


_PATHS = "p AS (SELECT l_orderkey AS path_id, string_agg(DISTINCT CAST(l_partkey AS VARCHAR), ';' ORDER BY CAST(l_partkey AS VARCHAR)) AS link_seq FROM lineitem GROUP BY ALL)"


@query(f"WITH {_PATHS}, x AS (SELECT path_id, string_split(link_seq, ';') AS a FROM p) SELECT path_id, CAST(i - 1 AS INTEGER) AS place, a[i] AS link_id FROM (SELECT path_id, a, unnest(range(1, len(a) + 1)) AS i FROM x)")
def explode_link_seq(spark, d):
    p = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("path_id")).agg(F.concat_ws(";", F.array_sort(F.collect_set(F.col("l_partkey").cast("string")))).alias("link_seq"))
    return rel.explode_list(p, "link_seq", "link_id")


@query("SELECT event_id, CAST(('0x' || left(sha256(CAST(user_id AS VARCHAR) || '|' || event_type), 8)) AS BIGINT) AS seed FROM events")
def sha_seed(spark, d):
    return read(spark, d, "events").select("event_id", hash_seed(F.col("user_id").cast("string"), "event_type").alias("seed"))


# --- aggregates --------------------------------------------------------------------------------


@query(f"WITH {_E} SELECT user_id, count(*) AS n, round(avg(CASE WHEN k >= 40 THEN value END), 6) AS mean_value FROM e GROUP BY user_id")
def link_mean(spark, d):
    return events(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), r(F.avg(F.when(F.col("k") >= 40, F.col("value")))).alias("mean_value"))


@query(f"WITH {_E} SELECT user_id, date_trunc('hour', ts)::VARCHAR AS hour, bool_and(coalesce(k >= 20 AND value IS NOT NULL, false)) AS all_eligible FROM e GROUP BY ALL")
def all_detectors_eligible(spark, d):
    e = events(spark, d)
    return e.groupBy("user_id", F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm:ss").alias("hour")).agg(all_true((F.col("k") >= 20) & F.col("value").isNotNull()).alias("all_eligible"))


@query(f"WITH {_E} SELECT user_id, event_type, coalesce(bool_or(CASE WHEN k >= 50 THEN value <= 20 END), false) AS queued FROM e GROUP BY ALL")
def any_queued(spark, d):
    return events(spark, d).groupBy("user_id", "event_type").agg(any_true(F.when(F.col("k") >= 50, F.col("value") <= 20)).alias("queued"))


@query("""WITH w AS (SELECT *, user_id * 100 + day(ts) // 5 AS window_id FROM events), s AS (SELECT window_id, min(ts) AS a, max(ts) AS b FROM w GROUP BY ALL)
SELECT event_id, CAST(w.window_id AS BIGINT) AS window_id FROM w JOIN s ON w.window_id = s.window_id WHERE a >= TIMESTAMP '2024-01-06 12:00:00' AND b < TIMESTAMP '2024-01-24 00:00:00'""")
def complete_windows(spark, d):
    w = read(spark, d, "events").withColumn("window_id", F.col("user_id") * 100 + F.floor(F.dayofmonth("ts") / 5))
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    return labels.complete_windows(w, "window_id", "ts", at("2024-01-06 12:00:00"), at("2024-01-24 00:00:00")).select("event_id", "window_id")


@query("SELECT event_type, count(*) AS n, round(avg(CASE WHEN value < 50 THEN 1.0 ELSE 0.0 END), 6) AS low_fraction, round(avg(CASE WHEN value < 0 THEN 1.0 ELSE 0.0 END), 6) AS negative_fraction FROM events GROUP BY ALL")
def low_value_fraction(spark, d):
    return read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), r(F.avg((F.col("value") < 50).cast("double"))).alias("low_fraction"), r(F.avg((F.col("value") < 0).cast("double"))).alias("negative_fraction"))


@query("SELECT l_returnflag, round(greatest(0, 1 - sum(abs(l_extendedprice - l_quantity * p_retailprice)) / greatest(sum(l_extendedprice), 1e-9)), 6) AS l1_score, round(sum(abs(l_quantity - p_size)) / greatest(sum(p_size), 1e-9), 6) AS movement FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def l1_score(spark, d):
    x = read(spark, d, "lineitem").join(read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    score = metrics.at_least_zero(1 - F.sum(F.abs(F.col("l_extendedprice") - F.col("l_quantity") * F.col("p_retailprice"))) / F.greatest(F.sum("l_extendedprice"), F.lit(1e-9)))
    return x.groupBy("l_returnflag").agg(r(score).alias("l1_score"), r(metrics.relative_l1(F.col("l_quantity"), F.col("p_size"))).alias("movement"))


_STATE = """s AS (SELECT n_name AS panel, r_name AS family, l_returnflag AS regime, l_quantity AS speed, l_extendedprice AS flow, p_size AS lanes,
avg(l_quantity) OVER (PARTITION BY l_partkey) AS speed_p, avg(l_extendedprice) OVER (PARTITION BY l_partkey) AS flow_p
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
m AS (SELECT panel, family, regime, count(*) AS n, sqrt(avg((speed_p - speed) ** 2)) AS speed_rmse, sqrt(avg(((flow_p - flow) / lanes) ** 2)) AS flow_per_lane_rmse FROM s GROUP BY ALL),
t AS (SELECT *, 0.54 * greatest(0, 1 - speed_rmse / 25) + 0.46 * greatest(0, 1 - flow_per_lane_rmse / 60000) AS state_score FROM m)"""


def state_rows(spark, d):
    """lineitem as states with the mean of the part as prediction: dimensions join by broadcast, the mean by one aggregate of the scan."""
    li = read(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag")
    mean = li.groupBy("l_partkey").agg(F.avg("l_quantity").alias("speed_p"), F.avg("l_extendedprice").alias("flow_p"))
    part = read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").alias("lanes"))
    s, n, g = read(spark, d, "supplier"), read(spark, d, "nation"), read(spark, d, "region")
    places = s.join(n, s.s_nationkey == n.n_nationkey).join(g, n.n_regionkey == g.r_regionkey).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("panel"), F.col("r_name").alias("family"))
    x = li.join(mean.join(part, "l_partkey"), "l_partkey").join(places, "l_suppkey")
    return x.select("panel", "family", F.col("l_returnflag").alias("regime"), F.col("l_quantity").alias("speed"), F.col("l_extendedprice").alias("flow"), "lanes", "speed_p", "flow_p")


def state_scores(spark, d):
    return metrics.state_score(state_rows(spark, d), ["panel", "family", "regime"], 60_000.0, speed=("speed_p", "speed"), flow=("flow_p", "flow"), lanes="lanes")


@query(f"WITH {_STATE} SELECT panel, regime, n, round(speed_rmse, 6) AS speed_rmse, round(flow_per_lane_rmse, 4) AS flow_per_lane_rmse FROM m")
def state_rmse(spark, d):
    x = metrics.state_rmse(state_rows(spark, d), ["panel", "regime"], ("speed_p", "speed"), ("flow_p", "flow"), "lanes")
    return x.select("panel", "regime", "n", r(F.col("speed_rmse")).alias("speed_rmse"), r(F.col("flow_per_lane_rmse"), 4).alias("flow_per_lane_rmse"))


@query(f"WITH {_STATE} SELECT panel, family, regime, n, round(speed_rmse, 6) AS speed_rmse, round(flow_per_lane_rmse, 4) AS flow_per_lane_rmse, round(state_score, 6) AS state_score FROM t")
def state_score(spark, d):
    x = state_scores(spark, d)
    return x.select("panel", "family", "regime", "n", r(F.col("speed_rmse")).alias("speed_rmse"), r(F.col("flow_per_lane_rmse"), 4).alias("flow_per_lane_rmse"), r(F.col("state_score")).alias("state_score"))


@query(f"""WITH {_STATE}, u AS (SELECT panel, family, 'state_score' AS metric, state_score AS value FROM t UNION ALL SELECT panel, family, 'speed_rmse', speed_rmse FROM t),
a AS (SELECT metric, panel, family, avg(value) AS value FROM u GROUP BY ALL), b AS (SELECT metric, family, avg(value) AS value FROM a GROUP BY ALL) SELECT metric, round(avg(value), 6) AS value FROM b GROUP BY metric""")
def hierarchical_mean(spark, d):
    x = state_scores(spark, d).withColumns({"case_id": F.lit("c"), "split": F.lit("train")})
    return metrics.hierarchical_mean(x, metrics=["state_score", "speed_rmse"]).select("metric", r(F.col("value")).alias("value"))


# --- series ------------------------------------------------------------------------------------


@query("SELECT event_id, CAST((isodow(ts) - 1) * 288 + (hour(ts) * 60 + minute(ts)) // 5 AS INTEGER) AS slot FROM events")
def weekly_slot(spark, d):
    return read(spark, d, "events").select("event_id", week_slot(F.col("ts")).cast("int").alias("slot"))


@query(f"WITH {_GRID} SELECT user_id, strftime(day, '%Y-%m-%d') AS day, round(v, 6) AS v, good, n FROM g")
def densify_grid(spark, d):
    return grid(spark, d).select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), r(F.col("v")).alias("v"), "good", "n")


@query(f"WITH {_GRID} SELECT user_id, strftime(day, '%Y-%m-%d') AS day, round(last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY day), 6) AS v FROM g")
def forward_fill(spark, d):
    return grid(spark, d).select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), r(series.forward_fill("v", ["user_id"], "day")).alias("v"))


@query(f"WITH {_GRID} SELECT user_id, strftime(day, '%Y-%m-%d') AS day, round(first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS v FROM g")
def backward_fill(spark, d):
    return grid(spark, d).select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), r(series.backward_fill("v", ["user_id"], "day")).alias("v"))


_LERP = f"""{_GRID}, i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) AS i FROM g),
j AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS va, first_value(v IGNORE NULLS) OVER f AS vb, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER b AS ia, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER f AS ib FROM i
WINDOW b AS (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
l AS (SELECT *, CASE WHEN va IS NULL THEN vb WHEN vb IS NULL OR ia = ib THEN va ELSE va + (vb - va) * (i - ia) / (ib - ia) END AS x FROM j)"""


@query(f"WITH {_LERP} SELECT user_id, strftime(day, '%Y-%m-%d') AS day, round(x, 6) AS x FROM l")
def interpolate_series(spark, d):
    return series.interpolate(grid(spark, d), "v", ["user_id"], "day", "x").select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), r(F.col("x")).alias("x"))


@query(f"WITH {_LERP} SELECT user_id, strftime(day, '%Y-%m-%d') AS day, round(0.5 * n * 10 + 0.5 * coalesce(x, n * 10), 6) AS v FROM l")
def interpolate_blend(spark, d):
    g = grid(spark, d)
    base = g.select("user_id", "day", (F.col("n") * 10.0).alias("v"))
    return predict.interpolate_blend(g, base, ["v"], ["user_id"], "day", 0.5).select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), r(F.col("v")).alias("v"))


@query(f"WITH {_GRID} SELECT user_id, strftime(day, '%Y-%m-%d') AS day, CAST(sum(n) OVER w AS BIGINT) AS n, CAST(count(*) OVER w AS BIGINT) AS steps FROM g WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)")
def history_frame(spark, d):
    w = series.history_frame(["user_id"], "day")
    return grid(spark, d).select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), F.sum("n").over(w).alias("n"), F.count("*").over(w).alias("steps"))


@query(f"WITH {_GRID} SELECT user_id, strftime(day, '%Y-%m-%d') AS day, CAST(sum(n) OVER w AS BIGINT) AS n, CAST(count(*) OVER w AS BIGINT) AS steps FROM g WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING)")
def future_frame(spark, d):
    w = series.future_frame(["user_id"], "day")
    return grid(spark, d).select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), F.sum("n").over(w).alias("n"), F.count("*").over(w).alias("steps"))


_WIN = f"""{_GRID}, q AS (SELECT user_id % 5 AS panel, user_id, day, CASE WHEN n >= 6 THEN 1 ELSE 0 END AS queued, CASE WHEN n > 0 THEN 1 ELSE 0 END AS eligible FROM g),
f AS (SELECT *, sum(queued) OVER h AS hq, sum(eligible) OVER h AS he, count(*) OVER h AS hn, sum(queued) OVER t AS fq, sum(eligible) OVER t AS fe, count(*) OVER t AS fn FROM q
WINDOW h AS (PARTITION BY panel, user_id ORDER BY day ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING), t AS (PARTITION BY panel, user_id ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING)),
o AS (SELECT panel, day, sum(he) / sum(hn) AS hc, sum(fe) / sum(fn) AS fc, coalesce(bool_or(hq >= 2), false) AS ongoing, coalesce(bool_or(fq > 0), false) AS ahead, min(hn) AS hn, min(fn) AS fn FROM f GROUP BY ALL)"""


def origin_grid(spark, d):
    return grid(spark, d).select((F.col("user_id") % 5).alias("panel"), F.col("user_id").alias("link_id"), F.col("day").alias("timestamp"), (F.col("n") >= 6).cast("int").alias("queued"), (F.col("n") > 0).cast("int").alias("eligible"))


@query(f"WITH {_WIN} SELECT panel, strftime(day, '%Y-%m-%d') AS day, CASE WHEN ongoing THEN 'queue_ongoing' ELSE 'queue_onset' END AS condition, round(hc, 6) AS history_coverage, round(fc, 6) AS future_coverage FROM o WHERE hn = 12 AND fn = 6 AND hc >= 0.7 AND fc >= 0.7 AND ahead")
def onset_ongoing(spark, d):
    c = windows.candidates(origin_grid(spark, d))
    return c.select("panel", F.date_format("timestamp", "yyyy-MM-dd").alias("day"), "condition", r(F.col("history_coverage")).alias("history_coverage"), r(F.col("future_coverage")).alias("future_coverage"))


@query()
def spaced_windows(spark, d):
    rules = windows.WindowRules(step_minutes=1440, spacing_minutes=2 * 1440, per_condition=3)
    return windows.sample_spaced(windows.candidates(origin_grid(spark, d), rules), rules).select("panel", F.date_format("timestamp", "yyyy-MM-dd").alias("day"), "condition", "number")


@query("""WITH s AS (SELECT user_id, ts, value, (isodow(ts) - 1) * 4 + hour(ts) // 6 AS slot FROM events), t AS (SELECT * FROM s WHERE ts >= TIMESTAMP '2024-01-20'), h AS (SELECT * FROM s WHERE ts < TIMESTAMP '2024-01-08')
SELECT user_id, strftime(t.ts, '%Y-%m-%d %H:%M:%S') AS ts, round(greatest(coalesce(a.v, b.v, (SELECT avg(value) FROM h)), 0), 6) AS value FROM t LEFT JOIN (SELECT user_id, slot, avg(value) AS v FROM h GROUP BY ALL) a USING (user_id, slot) LEFT JOIN (SELECT user_id, avg(value) AS v FROM h GROUP BY ALL) b USING (user_id)""")
def weekly_profile_fallback(spark, d):
    e = read(spark, d, "events")
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    out = predict.weekly_profile(e, e.where(F.col("ts") >= at("2024-01-20")).select("user_id", "ts"), ["value"], "user_id", (), "ts", 360, F.col("ts") < at("2024-01-08"))
    return out.select("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), r(F.col("value")).alias("value"))


_HIST = f"""{_E}, h AS (SELECT user_id AS window_id, date_trunc('day', ts) AS day, event_type AS link_id, value, k FROM e),
l AS (SELECT * FROM (SELECT *, max(day) OVER (PARTITION BY window_id) AS m FROM h) WHERE day = m),
p AS (SELECT window_id, link_id, coalesce(bool_or(k >= 75 AND value <= 0.6 * (150 - 50 * (window_id % 2))), false) AS q FROM l GROUP BY ALL)"""


@query(f"WITH {_HIST} SELECT t.window_id, t.link_id, CAST(coalesce(q, false) AS BIGINT) AS queue_pred FROM (SELECT DISTINCT window_id, link_id FROM h) t LEFT JOIN p ON t.window_id = p.window_id AND t.link_id = p.link_id")
def queue_persistence(spark, d):
    """Two panels whose links share their ids and differ in free speed."""
    panel = (F.col("user_id") % 2).alias("panel")
    h = events(spark, d).select(panel, F.col("user_id").alias("window_id"), F.date_trunc("day", "ts").alias("timestamp"), F.col("event_type").alias("link_id"), F.col("value").alias("speed_kmh"), F.col("k").alias("pct_observed"))
    links = h.select("panel", "link_id").distinct().withColumn("free_speed_kmh", 150.0 - 50 * F.col("panel"))
    return predict.queue_persistence(h, h.select("window_id", "link_id").distinct(), links)


# --- domain ------------------------------------------------------------------------------------


@query(f"WITH {_E} SELECT event_id, user_id, value FROM e WHERE k >= 75 AND value IS NOT NULL")
def state_answers(spark, d):
    e = events(spark, d)
    s = e.select("event_id", F.col("value").alias("speed_kmh"), F.col("value").alias("flow_vph"), F.col("k").alias("pct_observed"))
    return labels.state_answers(e.select("event_id", "user_id"), s, ["event_id"]).select("event_id", "user_id", F.col("speed_kmh").alias("value"))


_LABEL = f"""{_E}, s AS (SELECT date_trunc('day', ts) AS day, user_id AS link_id, avg(value) AS v, bool_and(coalesce(k >= 20 AND value IS NOT NULL, false)) AS ok FROM e GROUP BY ALL),
f AS (SELECT user_id AS link_id, 1.5 * avg(value) AS free FROM e GROUP BY ALL)"""


@query(f"WITH {_LABEL} SELECT strftime(day, '%Y-%m-%d') AS day, link_id, CAST(CASE WHEN ok AND v <= 0.6 * free THEN 1 ELSE 0 END AS INTEGER) AS queue_true, ok AS eligible FROM s LEFT JOIN f USING (link_id)")
def queue_labels(spark, d):
    """A link is a user here; a day's events are its detectors, of whose intervals enough was seen where k is 20 or more."""
    e = events(spark, d).withColumns({"timestamp": F.date_trunc("day", "ts"), "link_id": F.col("user_id")})
    states = e.select("timestamp", "link_id", F.col("value").alias("speed_kmh"), F.when(F.col("k") >= 20, 100).otherwise(0).alias("pct_observed"))
    links = e.groupBy("link_id").agg((1.5 * F.avg("value")).alias("free_speed_kmh"))
    out = labels.queue_labels(e.select("timestamp", "link_id").distinct(), states, links)
    return out.select(F.date_format("timestamp", "yyyy-MM-dd").alias("day"), "link_id", "queue_true", "eligible")


@query("SELECT event_id, CAST(coalesce(value <= 0.6 * free, false) AS INTEGER) AS queued FROM events JOIN (SELECT event_type, avg(value) AS free FROM events GROUP BY ALL) f USING (event_type)")
def queue_threshold(spark, d):
    e = read(spark, d, "events")
    return e.join(e.groupBy("event_type").agg(F.avg("value").alias("free")), "event_type").select("event_id", labels.is_queued("value", "free").alias("queued"))


_FD = """x AS (SELECT n_name AS panel, l_returnflag AS regime, l_quantity AS v, l_extendedprice / 10 - 200 AS q, p_size AS lanes, p_retailprice / 4 AS kc, p_retailprice AS kj, p_retailprice * 20 AS cap, 80.0 AS free
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
k AS (SELECT *, q / greatest(v, 1) AS k FROM x),
e AS (SELECT *, CASE WHEN k / lanes <= kc / lanes THEN free * k / lanes ELSE (cap / lanes) / greatest(kj / lanes - kc / lanes, 1e-9) * greatest(kj / lanes - k / lanes, 0) END AS el, CASE WHEN k <= kc THEN free * k ELSE cap / greatest(kj - kc, 1e-9) * greatest(kj - k, 0) END AS et FROM k),
g AS (SELECT panel, regime, sum(abs(q / lanes - el)) AS lo, sum(abs(q / lanes)) AS la, sum(abs(q - et)) AS o, sum(abs(q)) AS a, count(*) AS n, sum(CASE WHEN q < 50 THEN 1 ELSE 0 END) AS low, sum(CASE WHEN q < 0 OR v < 0 THEN 1 ELSE 0 END) AS neg FROM e GROUP BY ALL)"""


@query(f"WITH {_FD} SELECT panel, round(avg(CASE WHEN low / n > 0.2 THEN 0 ELSE greatest(0, 1 - lo / greatest(la, 1e-9)) END), 6) AS fd_component_score, round(sum(o) / greatest(sum(a), 1e-9), 6) AS fd_relative_error_diagnostic, round(sum(low) / sum(n), 6) AS low_flow_fraction_diagnostic, round(sum(neg) / sum(n), 6) AS negative_state_fraction_diagnostic FROM g GROUP BY panel")
def fd_component(spark, d):
    li, p = read(spark, d, "lineitem"), read(spark, d, "part")
    s, n = read(spark, d, "supplier"), read(spark, d, "nation")
    price = F.col("p_retailprice")
    x = li.join(p, li.l_partkey == p.p_partkey).join(s.join(n, s.s_nationkey == n.n_nationkey), li.l_suppkey == s.s_suppkey)
    x = x.select(F.col("n_name").alias("panel"), F.col("l_returnflag").alias("mask_regime"), F.col("l_quantity").alias("speed_kmh"), (F.col("l_extendedprice") / 10 - 200).alias("flow_vph"), F.col("p_size").alias("lanes"), (price / 4).alias("critical_density"), price.alias("k_jam"), (price * 20).alias("capacity_vph"), F.lit(80.0).alias("free_speed_kmh"))
    out = metrics.fd_component(x, ["panel"])
    return out.select("panel", *[r(F.col(c)).alias(c) for c in out.columns if c != "panel"])


@query(f"WITH {_E} SELECT user_id AS window_id, event_type AS condition, count(*) AS n, round(CASE WHEN sum(CASE WHEN value < 50 OR k < 30 THEN 1 ELSE 0 END) = 0 THEN 1.0 ELSE sum(CASE WHEN value < 50 AND k < 30 THEN 1 ELSE 0 END) / sum(CASE WHEN value < 50 OR k < 30 THEN 1 ELSE 0 END) END, 6) AS queue_proxy_iou FROM e WHERE k % 4 <> 0 GROUP BY ALL")
def window_iou(spark, d):
    e = events(spark, d).select(F.col("user_id").alias("window_id"), F.col("event_type").alias("condition"), (F.col("value") < 50).cast("int").alias("queue_true"), (F.col("k") < 30).cast("int").alias("queue_pred"), (F.col("k") % 4 != 0).cast("int").alias("eligible"))
    return metrics.window_iou(e, ["window_id", "condition"]).withColumn("queue_proxy_iou", r(F.col("queue_proxy_iou")))


#: Two panels whose paths and links share their ids: an order is a path of either, its parts are links of the panel of their supplier.
_INC = "i AS (SELECT DISTINCT CAST(l_suppkey % 2 AS BIGINT) AS panel, l_orderkey AS path_id, l_partkey AS link_id FROM lineitem), pf AS (SELECT p.panel, o_orderkey AS path_id, o_totalprice * (1 + p.panel) AS path_flow, o_totalprice * (1 + p.panel) * (1 + (o_custkey % 7 - 3) / 20.0) AS prior, o_totalprice * (1 + p.panel) * (1 + (o_orderkey % 5 - 2) / 20.0) AS t, o_orderpriority AS zone FROM orders, (SELECT CAST(0 AS BIGINT) AS panel UNION ALL SELECT 1) p)"


def path_tables(spark, d):
    o = read(spark, d, "orders").withColumn("panel", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))))
    inc = read(spark, d, "lineitem").select((F.col("l_suppkey") % 2).cast("long").alias("panel"), F.col("l_orderkey").alias("path_id"), F.col("l_partkey").alias("link_id"))
    flow = F.col("o_totalprice") * (1 + F.col("panel"))
    return inc, o.select("panel", F.col("o_orderkey").alias("path_id"), F.col("o_orderpriority").alias("destination_zone"), flow.alias("path_flow"), (flow * (1 + (F.col("o_custkey") % 7 - 3) / 20.0)).alias("prior"), (flow * (1 + (F.col("o_orderkey") % 5 - 2) / 20.0)).alias("true"))


@query(f"WITH {_INC} SELECT panel, link_id, round(sum(path_flow), 2) AS modelled FROM i JOIN pf USING (panel, path_id) GROUP BY ALL")
def incidence_matvec(spark, d):
    inc, p = path_tables(spark, d)
    return metrics.matvec(inc, p.select("panel", "path_id", "path_flow")).withColumn("modelled", r(F.col("modelled"), 2))


@query("""WITH i AS (SELECT l_suppkey % 2 AS panel, CASE WHEN l_linenumber = 7 THEN -l_orderkey ELSE l_orderkey END AS path_id, l_partkey AS link_id FROM lineitem), paths AS (SELECT l_suppkey % 2 AS panel, l_orderkey AS path_id FROM lineitem),
c AS (SELECT p.panel, CASE WHEN p_partkey % 9 = 0 THEN -p_partkey ELSE p_partkey END AS link_id FROM part, (SELECT 0 AS panel UNION ALL SELECT 1) p)
SELECT 'duplicate_path' AS violation, count(*) AS n FROM (SELECT panel, path_id FROM paths GROUP BY ALL HAVING count(*) > 1) UNION ALL SELECT 'unknown_path', count(*) FROM (SELECT DISTINCT panel, path_id FROM i WHERE NOT EXISTS (SELECT 1 FROM paths q WHERE q.panel = i.panel AND q.path_id = i.path_id))
UNION ALL SELECT 'link_without_path', count(*) FROM c WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.panel = c.panel AND i.link_id = c.link_id)""")
def incidence_checks(spark, d):
    """The whole incidence of two panels; faults are changed ids of paths and links."""
    li, panel = read(spark, d, "lineitem"), (F.col("l_suppkey") % 2).alias("panel")
    inc = li.select(panel, F.when(F.col("l_linenumber") == 7, -F.col("l_orderkey")).otherwise(F.col("l_orderkey")).alias("path_id"), F.col("l_partkey").alias("link_id"))
    key = F.col("p_partkey")
    counts = read(spark, d, "part").select(F.explode(F.array(F.lit(0), F.lit(1))).alias("panel"), F.when(key % 9 == 0, -key).otherwise(key).alias("link_id"))
    return validate.incidence_violations(inc, li.select(panel, F.col("l_orderkey").alias("path_id")), counts)


_ZONES = "z AS (SELECT panel, zone, sum(path_flow) AS p, sum(t) AS t FROM pf GROUP BY ALL), zs AS (SELECT panel, sum(p) AS ps, sum(t) AS ts FROM z GROUP BY ALL), s AS (SELECT panel, greatest(0, 1 - sum(abs(p / ps - t / ts)) / 2) AS att FROM z JOIN zs USING (panel) GROUP BY ALL)"


@query(f"WITH {_INC}, {_ZONES} SELECT panel, round(att, 6) AS attraction_score FROM s")
def attraction_share(spark, d):
    return metrics.attraction_score(path_tables(spark, d)[1], ["panel"]).select("panel", r(F.col("attraction_score")).alias("attraction_score"))


@query(f"""WITH {_INC}, c AS (SELECT panel, link_id, count(*) * 120000.0 AS c FROM i GROUP BY ALL), mv AS (SELECT panel, link_id, sum(path_flow) AS m FROM i JOIN pf USING (panel, path_id) GROUP BY ALL),
a AS (SELECT panel, greatest(0, 1 - sum(abs(coalesce(m, 0) - c)) / greatest(sum(c), 1e-9)) AS link FROM c LEFT JOIN mv USING (panel, link_id) GROUP BY panel),
b AS (SELECT panel, sum(abs(path_flow - prior)) / greatest(sum(prior), 1e-9) AS move, greatest(0, 1 - sum(abs(path_flow - t)) / greatest(sum(t), 1e-9)) AS path, exp(-abs(sum(abs(path_flow - prior)) / greatest(sum(abs(t - prior)), 1e-9) - 1)) AS dev FROM pf GROUP BY panel),
{_ZONES}
SELECT panel, round(link, 6) AS odme_link_score_diagnostic, round(move, 6) AS odme_prior_relative_movement, round(0.45 * path + 0.25 * link + 0.15 * dev + 0.15 * att, 6) AS odme_synthetic_score FROM a JOIN b USING (panel) JOIN s USING (panel)""")
def odme_score(spark, d):
    inc, p = path_tables(spark, d)
    counts = inc.distinct().groupBy("panel", "link_id").agg((F.count("*") * 120000.0).alias("count"))
    of = lambda c: p.select("panel", "path_id", F.col(c).alias("path_flow"))
    out = metrics.odme_score(p.select("panel", "path_id", "destination_zone", "path_flow"), counts, of("prior"), inc, of("true"), ["panel"])
    return out.select("panel", *[r(F.col(c)).alias(c) for c in out.columns if c != "panel"])


@query()
def bounded_least_squares(spark, d):
    """Path flows of all orders against their counts: a network is one customer's orders, so it stays small at any size."""
    return bounded_problem(spark, d)[0].withColumn("path_flow", r(F.col("path_flow"), 3))


def bounded_problem(spark, d):
    """(estimate, prior, counts, incidence) of the query."""
    prior = read(spark, d, "orders").select(F.col("o_custkey").alias("panel"), F.col("o_orderkey").alias("path_id"), F.col("o_totalprice").alias("path_flow"))
    inc = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("path_id"), F.col("l_partkey").alias("link_id")).distinct().join(prior.select("panel", "path_id"), "path_id")
    counts = prior.join(inc, ["panel", "path_id"]).groupBy("panel", "link_id").agg((F.sum("path_flow") * 0.9).alias("count"))
    return odme.estimate_flows(prior, counts, inc, ["panel"]), prior, counts, inc


@query()
def synthetic_flows(spark, d):
    """Sums of three scenarios of two panels that share their ids."""
    inc, p = path_tables(spark, d)
    truth, counts = odme.synthetic_scenarios(p.select("panel", "path_id", "path_flow"), inc, 3, 69420)
    flows = truth.groupBy("panel", "scenario").agg(F.count("*").alias("n"), r(F.sum("path_flow"), 2).alias("total"))
    return flows.join(counts.groupBy("panel", "scenario").agg(F.count("*").alias("links"), r(F.sum("count"), 2).alias("counted")), ["panel", "scenario"])


# --- contracts ---------------------------------------------------------------------------------

_VIOLATIONS = """a AS (SELECT CASE WHEN l_linenumber = 7 THEN NULL ELSE l_orderkey END AS o, l_linenumber AS l, CASE WHEN l_quantity = 50 THEN NULL ELSE l_quantity - 2 END AS v FROM lineitem), b AS (SELECT l_orderkey AS o, l_linenumber AS l FROM lineitem WHERE l_orderkey % 10 <> 0 GROUP BY ALL),
g AS (SELECT o, l, count(*) AS p FROM a GROUP BY ALL), f AS (SELECT coalesce(g.o, b.o) AS o, g.p, b.o AS t FROM g FULL JOIN b ON g.o = b.o AND g.l = b.l)"""


@query(f"""WITH {_VIOLATIONS} SELECT 'null_key' AS violation, CAST(sum(CASE WHEN o IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n FROM a UNION ALL SELECT 'null_target_key', 0 UNION ALL SELECT 'duplicate', CAST(sum(p - 1) AS BIGINT) FROM g WHERE o IS NOT NULL UNION ALL SELECT 'duplicate_target', 0
UNION ALL SELECT 'missing', CAST(count(*) AS BIGINT) FROM f WHERE o IS NOT NULL AND p IS NULL UNION ALL SELECT 'extra', CAST(count(*) AS BIGINT) FROM f WHERE o IS NOT NULL AND t IS NULL
UNION ALL SELECT 'non_finite', CAST(sum(CASE WHEN v IS NULL THEN 1 ELSE 0 END) AS BIGINT) FROM a UNION ALL SELECT 'non_binary', CAST(sum(CASE WHEN v NOT IN (0, 1) THEN 1 ELSE 0 END) AS BIGINT) FROM a UNION ALL SELECT 'negative', CAST(sum(CASE WHEN v < 0 THEN 1 ELSE 0 END) AS BIGINT) FROM a""")
def validate_predictions(spark, d):
    li = read(spark, d, "lineitem")
    pred = li.select(F.when(F.col("l_linenumber") != 7, F.col("l_orderkey")).alias("o"), F.col("l_linenumber").alias("l"), F.when(F.col("l_quantity") != 50, F.col("l_quantity") - 2).alias("v"))
    targets = li.where("l_orderkey % 10 <> 0").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l")).distinct()
    return validate.prediction_violations(pred, targets, ["o", "l"], ["v"], ["v"], ["v"])


@query("""WITH t AS (SELECT DISTINCT l_orderkey, CASE WHEN l_suppkey % 2 = 0 THEN 'a' ELSE 'b' END AS panel, CASE WHEN l_shipdate < TIMESTAMP '1995-01-01' THEN 'train' ELSE 'private' END AS split FROM lineitem),
m AS (SELECT l_orderkey, count(*) AS n, min(panel) AS p, min(split) AS s FROM t GROUP BY ALL) SELECT o_orderkey, coalesce(n, 0) AS matches, p AS panel, s AS split FROM orders LEFT JOIN m ON o_orderkey = l_orderkey""")
def partition_answers(spark, d):
    t = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_suppkey") % 2 == 0, "a").otherwise("b").alias("panel"), F.when(F.col("l_shipdate") < F.lit("1995-01-01").cast("timestamp_ntz"), "train").otherwise("private").alias("split"))
    return validate.partition_answers(read(spark, d, "orders").select("o_orderkey"), t, ["o_orderkey"]).select("o_orderkey", "matches", "panel", "split")


@query("""SELECT coalesce(a.event_id, b.event_id) AS event_id, CASE WHEN b.event_id IS NULL THEN 'missing' WHEN a.event_id IS NULL THEN 'extra' ELSE 'changed' END AS side FROM (SELECT event_id, user_id, value FROM events WHERE event_id % 11 <> 0) a
FULL JOIN (SELECT event_id, user_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events WHERE event_id % 13 <> 0) b ON a.event_id = b.event_id WHERE a.event_id IS NULL OR b.event_id IS NULL OR a.user_id IS DISTINCT FROM b.user_id OR a.value IS DISTINCT FROM b.value""")
def template_diff(spark, d):
    e = read(spark, d, "events").select("event_id", "user_id", "value")
    b = e.where("event_id % 13 <> 0").withColumn("value", F.when(F.col("event_id") % 7 != 0, F.col("value")))
    return validate.template_diff(e.where("event_id % 11 <> 0"), b, "event_id", ["user_id", "value"])


def submission_tables(spark, d):
    """A template over events: one task by event_id modulo 3, keys as text."""
    e = read(spark, d, "events")
    task = F.element_at(F.array(F.lit("state"), F.lit("queue"), F.lit("odme")), (F.col("event_id") % 3 + 1).cast("int"))
    user, event = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    t = e.select(
        F.concat(F.lit("s"), event).alias("submission_id"), task.alias("task"), F.col("event_type").alias("panel"), iso_text(F.col("ts")).alias("timestamp"), user.alias("station_id"), event.alias("link_id"), F.lit("R1").alias("mask_regime"),
        event.alias("window_id"), F.lit("07:00").alias("departure_time"), event.alias("path_id"), user.alias("origin_zone"), user.alias("destination_zone"), "value", "event_id",
    )
    value = F.col("value")
    preds = {
        "state": t.where("event_id % 3 = 0").withColumns({"speed_kmh": value, "flow_vph": value * 2}).select("panel", "timestamp", "station_id", "link_id", "mask_regime", "speed_kmh", "flow_vph"),
        "queue": t.where("event_id % 3 = 1").withColumn("queue_pred", (value < 50).cast("int")).select("window_id", "timestamp", "link_id", "queue_pred"),
        "odme": t.where("event_id % 3 = 2").withColumn("path_flow", value - 1).select("panel", "departure_time", "path_id", "origin_zone", "destination_zone", "path_flow"),
    }
    return t.drop("value", "event_id"), preds


@query("SELECT 's' || event_id AS submission_id, ['state', 'queue', 'odme'][event_id % 3 + 1] AS task, CASE WHEN event_id % 3 = 0 THEN value ELSE 0 END AS speed_kmh, CASE WHEN event_id % 3 = 0 THEN value * 2 ELSE 0 END AS flow_vph, CASE WHEN event_id % 3 = 1 AND value < 50 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS queue_pred, CASE WHEN event_id % 3 = 2 THEN value - 1 ELSE 0 END AS path_flow FROM events")
def assemble_submission(spark, d):
    return submit.assemble(*submission_tables(spark, d))


@query("""SELECT 'empty_id' AS violation, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'duplicate', 0 UNION ALL SELECT 'missing', count(*) FROM events WHERE event_id % 17 = 0 UNION ALL SELECT 'extra', 0 UNION ALL SELECT 'wrong_task', 0
UNION ALL SELECT 'non_finite', count(*) FROM events WHERE event_id % 17 <> 0 AND event_id % 5 = 0 UNION ALL SELECT 'non_binary', 0 UNION ALL SELECT 'negative', count(*) FROM events WHERE event_id % 17 <> 0 AND event_id % 3 = 2 AND value - 1 < 0
UNION ALL SELECT 'unused_not_zero', 0 UNION ALL SELECT 'no_rows', 0""")
def validate_submission(spark, d):
    t, preds = submission_tables(spark, d)
    number = F.substring("submission_id", 2, 20).cast("long")
    s = submit.assemble(t, preds).where(number % 17 != 0).withColumn("speed_kmh", F.when(number % 5 != 0, F.col("speed_kmh")))
    return validate.submission_violations(s, t)


@query("SELECT event_id, CAST(isfinite(CASE WHEN event_id % 5 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 5 = 1 THEN 'inf'::DOUBLE WHEN event_id % 5 = 2 THEN NULL ELSE value END) IS NOT DISTINCT FROM true AS BOOLEAN) AS finite FROM events")
def finite_check(spark, d):
    k = F.col("event_id") % 5
    v = F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(float("inf"))).when(k == 2, F.lit(None).cast("double")).otherwise(F.col("value"))
    return read(spark, d, "events").select("event_id", is_finite(v).alias("finite"))


@query("SELECT event_id, CASE WHEN value - 100 < 0 THEN 0.0::DOUBLE ELSE round(value - 100, 6) END AS value FROM events")
def clip_lower(spark, d):
    from gridflow.functions import not_negative

    return read(spark, d, "events").select("event_id", r(not_negative(F.col("value") - 100)).alias("value"))
