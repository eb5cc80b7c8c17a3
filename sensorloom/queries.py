"""Named queries over the plain tables, and the DuckDB SQL with the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.functions import text as tx
from sensorloom.operators import candidates as cd
from sensorloom.operators import classify as cl
from sensorloom.operators import clean, features, metrics, reduce, scans, split, windows
from sensorloom.plans import preprocess as pp
from sensorloom.plans import reports
from sensorloom.sources import sensor as src

CH = src.EVENT_CHANNELS
ORDER = ["timestamp", "event_id"]
SIZE, STRIDE = 8, 4
IDS = ["window_id", "subject_id", "activity_id", "activity_name"]
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t in ("double", "float")})


def _sensor(spark, d):
    return src.events_as_recordings(spark, d)


def _filled(spark, d):
    return clean.interpolate(_sensor(spark, d), CH, ORDER)


def _prepared(spark, d) -> pp.Preprocessed:
    return pp.preprocess(_sensor(spark, d), CH, SIZE, STRIDE, ORDER, ratio=0.5)


# --- SQL pieces -----------------------------------------------------------------------------------

SENSOR = """sensor AS (SELECT event_id, user_id::INT AS subject_id, CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 WHEN 'view' THEN 5 END AS activity_id,
  event_type AS activity_name, epoch_us(ts)::DOUBLE / 1e6 AS timestamp, CASE WHEN event_id % 7 <> 0 THEN value END AS value, json_extract_string(props, '$.k')::DOUBLE AS k, 'user' || user_id || '.dat' AS source_file FROM events)"""
G = "PARTITION BY subject_id, activity_id ORDER BY timestamp, event_id"
FILLED = SENSOR + f""",
pos AS (SELECT *, row_number() OVER ({G}) AS p FROM sensor),
near AS (SELECT *, last_value(value IGNORE NULLS) OVER ({G} ROWS UNBOUNDED PRECEDING) AS a, first_value(value IGNORE NULLS) OVER ({G} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b,
  last_value(CASE WHEN value IS NOT NULL THEN p END IGNORE NULLS) OVER ({G} ROWS UNBOUNDED PRECEDING) AS s, first_value(CASE WHEN value IS NOT NULL THEN p END IGNORE NULLS) OVER ({G} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS t FROM pos),
filled AS (SELECT event_id, subject_id, activity_id, activity_name, timestamp, coalesce(value, a + (b - a) * (p - s) / (t - s), a, b) AS value, k, source_file FROM near)"""
RUNS = FILLED + f""",
ok AS (SELECT * FROM filled WHERE value IS NOT NULL AND k IS NOT NULL),
step AS (SELECT *, timestamp - lag(timestamp) OVER ({G}) AS delta FROM ok),
lim AS (SELECT *, median(CASE WHEN delta > 0 THEN delta END) OVER (PARTITION BY subject_id, activity_id) * 3.0 AS lim FROM step),
runs AS (SELECT * EXCLUDE (delta, lim), sum(CASE WHEN delta IS NULL OR delta <= 0 OR delta > coalesce(lim, 'inf'::DOUBLE) THEN 1 ELSE 0 END) OVER ({G} ROWS UNBOUNDED PRECEDING)::INT AS run_id FROM lim)"""
WINS = RUNS + f""",
rp AS (SELECT *, row_number() OVER (PARTITION BY subject_id, activity_id, run_id ORDER BY timestamp, event_id) - 1 AS p, count(*) OVER (PARTITION BY subject_id, activity_id, run_id) AS n FROM runs),
cut AS (SELECT *, unnest(range(0, n - {SIZE} + 1, {STRIDE})) AS st FROM rp WHERE n >= {SIZE}),
win AS (SELECT subject_id, activity_id, run_id, activity_name, st::INT AS start_index, (st + {SIZE - 1})::INT AS end_index, {SIZE}::INT AS window_length, min(timestamp) AS start_timestamp, max(timestamp) AS end_timestamp,
  arg_min(source_file, p) AS source_file, list(value ORDER BY p) AS v, list(k ORDER BY p) AS kk FROM cut WHERE p BETWEEN st AND st + {SIZE - 1} GROUP BY ALL),
wid AS (SELECT *, row_number() OVER (ORDER BY subject_id, activity_id, run_id, start_index) - 1 AS window_id FROM win)"""
CELLS = """cells AS (SELECT vec_id AS window_id, 'a' || label AS activity_name, vec_id % 2 = 1 AS generated, ((i - 1) // 16)::INT AS c, ((i - 1) % 16)::INT AS t, embedding[i]::DOUBLE AS v
  FROM embeddings, (SELECT unnest(range(1, 65)) AS i))"""


def _stat_sql(names, stats, lists, pattern, digits=6) -> str:
    made = {"mean": "list_avg({x})", "std": "list_aggregate({x}, 'stddev_pop')", "min": "list_min({x})", "max": "list_max({x})", "slope": "({x}[-1] - {x}[1]) / greatest(len({x}) - 1, 1)", "energy": "list_avg(list_transform({x}, lambda e: e * e))"}
    return ", ".join(f"round({made[s].format(x=x)}, {digits}) AS {pattern.format(channel=n, stat=s)}" for n, x in zip(names, lists, strict=True) for s in stats)


# --- scans, predicates, cleaning ------------------------------------------------------------------


@query(f"WITH {SENSOR} SELECT * FROM sensor WHERE activity_id IN (1, 3, 5) AND activity_id <> 0")
def activity_filter(spark: SparkSession, d: str) -> DataFrame:
    return clean.select_activities(_sensor(spark, d), clean.resolve_activities(["click", "3", "View"], {v: k for k, v in src.EVENT_ACTIVITIES.items()}))


@query("SELECT event_id, CASE WHEN user_id % 25 = 3 THEN 0 ELSE (user_id % 25)::INT END AS activity_id, coalesce(CASE user_id % 25 WHEN 0 THEN 'other_transient' WHEN 1 THEN 'lying' WHEN 2 THEN 'sitting' WHEN 3 THEN 'other_transient' WHEN 4 THEN 'walking' WHEN 5 THEN 'running' WHEN 6 THEN 'cycling' WHEN 7 THEN 'nordic_walking' WHEN 9 THEN 'watching_tv' WHEN 10 THEN 'computer_work' WHEN 11 THEN 'car_driving' WHEN 12 THEN 'ascending_stairs' WHEN 13 THEN 'descending_stairs' WHEN 16 THEN 'vacuum_cleaning' WHEN 17 THEN 'ironing' WHEN 18 THEN 'folding_laundry' WHEN 19 THEN 'house_cleaning' WHEN 20 THEN 'playing_soccer' WHEN 24 THEN 'rope_jumping' END, 'unknown') AS activity_name FROM events")
def label_map_unknown(spark: SparkSession, d: str) -> DataFrame:
    ev = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.when(F.col("user_id") % 25 != 3, F.col("user_id") % 25).alias("activity_id"))
    return clean.label_activities(ev)


@query(f"WITH {SENSOR} SELECT * FROM sensor WHERE (value IS NOT NULL)::INT + (k IS NOT NULL)::INT >= 2")
def row_validity(spark: SparkSession, d: str) -> DataFrame:
    return clean.valid_rows(_sensor(spark, d), CH, 0.8)


@query(f"WITH {SENSOR} SELECT event_id, subject_id, activity_id, round(timestamp - lag(timestamp) OVER ({G}), 6) AS delta FROM sensor")
def lag_delta(spark: SparkSession, d: str) -> DataFrame:
    return rounded(clean.lag_delta(_sensor(spark, d), ORDER).select("event_id", "subject_id", "activity_id", "delta"))


@query(f"WITH {FILLED} SELECT event_id, subject_id, activity_id, round(value, 6) AS value, k FROM filled")
def interpolate_fill(spark: SparkSession, d: str) -> DataFrame:
    return _filled(spark, d).select("event_id", "subject_id", "activity_id", F.round("value", 6).alias("value"), "k")


@query(f"WITH {RUNS} SELECT event_id, subject_id, activity_id, run_id FROM runs")
def gap_runs(spark: SparkSession, d: str) -> DataFrame:
    return _prepared(spark, d).runs.select("event_id", "subject_id", "activity_id", "run_id")


HOUR = 3600.0


@query(f"""WITH {FILLED}, ends AS (SELECT subject_id, min(timestamp) AS a, max(timestamp) AS b FROM filled GROUP BY subject_id),
points AS (SELECT subject_id, point, a + point * {HOUR} AS t FROM (SELECT *, unnest(range(0, floor((b - a) / {HOUR})::BIGINT + 1)) AS point FROM ends)),
low AS (SELECT p.subject_id, p.point, p.t, f.timestamp AS t0, f.value AS v0, f.k AS k0 FROM points p ASOF JOIN filled f ON p.subject_id = f.subject_id AND p.t >= f.timestamp),
met AS (SELECT l.*, f.timestamp AS t1, f.value AS v1, f.k AS k1 FROM low l ASOF LEFT JOIN filled f ON l.subject_id = f.subject_id AND l.t < f.timestamp)
SELECT subject_id, point, round(t, 6) AS timestamp, round(CASE WHEN t = t0 THEN v0 ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END, 6) AS value, round(CASE WHEN t = t0 THEN k0 ELSE k0 + (k1 - k0) * (t - t0) / (t1 - t0) END, 6) AS k FROM met""")
def resample_grid(spark: SparkSession, d: str) -> DataFrame:
    return rounded(scans.resample(_filled(spark, d), ["subject_id"], "timestamp", CH, HOUR))


@query(f"WITH {RUNS} SELECT subject_id, activity_id, run_id, round(min(timestamp), 6) AS start, round(max(timestamp), 6) AS \"end\", round(max(timestamp) - min(timestamp), 6) AS duration FROM runs GROUP BY ALL")
def run_durations(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.run_durations(_prepared(spark, d).runs))


# A third of all rows lie in one recording: what the plain forms send to one task, the long ones scan in segments.
LONG_SENSOR = SENSOR.replace("sensor AS (", "source AS (", 1) + ", sensor AS (SELECT * REPLACE (CASE WHEN subject_id % 3 = 0 THEN 0 ELSE subject_id END AS subject_id, CASE WHEN subject_id % 3 = 0 THEN 1 ELSE activity_id END AS activity_id, CASE WHEN subject_id % 3 = 0 THEN 'click' ELSE activity_name END AS activity_name) FROM source)"
LONG_FILLED, LONG_RUNS = FILLED.replace(SENSOR, LONG_SENSOR), RUNS.replace(SENSOR, LONG_SENSOR)
SEGMENT_ROWS = 500


def _long_filled(spark, d):
    rows = _sensor(spark, d)
    hot = F.col("subject_id") % 3 == 0
    rows = rows.withColumns({"subject_id": F.when(hot, 0).otherwise(F.col("subject_id")), "activity_id": F.when(hot, 1).otherwise(F.col("activity_id")), "activity_name": F.when(hot, "click").otherwise(F.col("activity_name"))})
    return scans.interpolate_long(scans.segmented(rows, list(clean.GROUP), "timestamp", SEGMENT_ROWS), CH, ORDER)


def _long_runs(spark, d):
    return scans.runs_long(_long_filled(spark, d).dropna(subset=CH), ORDER).drop("__g", "__s")


@query(f"WITH {LONG_FILLED} SELECT event_id, subject_id, activity_id, round(value, 6) AS value, k FROM filled")
def interpolate_long(spark: SparkSession, d: str) -> DataFrame:
    return _long_filled(spark, d).select("event_id", "subject_id", "activity_id", F.round("value", 6).alias("value"), "k")


@query(f"WITH {LONG_RUNS} SELECT event_id, subject_id, activity_id, run_id FROM runs")
def runs_long(spark: SparkSession, d: str) -> DataFrame:
    return _long_runs(spark, d).select("event_id", "subject_id", "activity_id", "run_id")


@query(f"WITH {FILLED}, l AS (SELECT 'value' AS channel, value AS v FROM filled UNION ALL SELECT 'k', k FROM filled) SELECT channel, round(avg(v), 6) AS mean, round(CASE WHEN stddev_pop(v) < 1e-8 THEN 1.0 ELSE stddev_pop(v) END, 6) AS scale FROM l WHERE v IS NOT NULL GROUP BY channel")
def channel_scaler(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_prepared(spark, d).scaler)


@query(f"WITH {FILLED}, l AS (SELECT 'value' AS channel, value AS v FROM filled UNION ALL SELECT 'k', k FROM filled) SELECT channel, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max FROM l GROUP BY channel")
def channel_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.channel_summary(_filled(spark, d), CH))


# --- windows and features -------------------------------------------------------------------------

META = "window_id, subject_id, activity_id, run_id, activity_name, start_index, end_index, window_length, round(start_timestamp, 6) AS start_timestamp, round(end_timestamp, 6) AS end_timestamp, source_file"


@query(f"WITH {WINS.replace(RUNS, LONG_RUNS)} SELECT {META}, list_transform(v, lambda x: round(x, 6)) AS value, kk AS k FROM wid")
def windows_long(spark: SparkSession, d: str) -> DataFrame:
    w = windows.sliding_windows(_long_runs(spark, d), CH, SIZE, STRIDE, ORDER, segment_rows=SEGMENT_ROWS)
    return rounded(w.select(*[c for c in w.columns if c != "w"], F.transform(F.col("w")[0], lambda x: F.round(x, 6)).alias("value"), F.col("w")[1].alias("k")))


@query(f"WITH {WINS} SELECT {META}, list_transform(v, lambda x: round(x, 6)) AS value, kk AS k FROM wid")
def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    w = _prepared(spark, d).windows
    meta = [c for c in w.columns if c != "w"]
    return rounded(w.select(*meta, F.transform(F.col("w")[0], lambda x: F.round(x, 6)).alias("value"), F.col("w")[1].alias("k")))


@query(f"WITH {WINS} SELECT window_id, subject_id, activity_id, activity_name, {_stat_sql(CH, ('mean', 'std', 'min', 'max', 'slope'), ('v', 'kk'), '{channel}__{stat}')} FROM wid")
def window_features(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_prepared(spark, d).features)


@query(f"WITH {WINS} SELECT window_id, {_stat_sql(('ch0', 'ch1'), ('mean', 'std', 'min', 'max', 'energy'), ('v', 'kk'), '{channel}_{stat}', 8)} FROM wid")
def har_features(spark: SparkSession, d: str) -> DataFrame:
    # mean squares of eight two-digit values have up to seven digits, so six would meet half-way cases
    return rounded(features.har_features(_prepared(spark, d).windows, 2, ["window_id"]), 8)


@query(f"WITH {WINS} SELECT window_id, {_stat_sql(CH, ('mean', 'std', 'min', 'max'), ('v', 'kk'), 'stat_{channel}_{stat}')} FROM wid")
def stat_targets(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.stat_targets(_prepared(spark, d).windows, CH, ["window_id"]))


@query(f"WITH {WINS}, s AS (SELECT avg(value) AS mv, stddev_pop(value) AS sv, avg(k) AS mk, stddev_pop(k) AS sk FROM ok) SELECT window_id, list_transform(v, lambda x: round((x - mv) / sv, 6)) AS value, list_transform(kk, lambda x: round((x - mk) / sk, 6)) AS k FROM wid, s")
def zscore_windows(spark: SparkSession, d: str) -> DataFrame:
    p = _prepared(spark, d)
    z = windows.zscore(p.windows, p.scaler, CH)
    return z.select("window_id", *[F.transform(F.col("w")[i], lambda x: F.round(x, 6)).alias(c) for i, c in enumerate(CH)])


FACTS = WINS + """,
pr AS (SELECT subject_id, activity_id, activity_name, run_id, count(*) AS nrow, max(timestamp) - min(timestamp) AS dur FROM runs GROUP BY ALL),
pw AS (SELECT subject_id, activity_id, run_id, count(*) AS nwin FROM wid GROUP BY ALL),
facts AS (SELECT pr.*, coalesce(nwin, 0) AS nwin FROM pr LEFT JOIN pw USING (subject_id, activity_id, run_id))"""
SUMS = "sum(nrow)::BIGINT AS n_rows, sum(nwin)::BIGINT AS n_windows, round(sum(dur), 3) AS duration"


@query(f"WITH {FACTS} SELECT activity_id, activity_name, {SUMS} FROM facts GROUP BY ALL")
def activity_rollup(spark: SparkSession, d: str) -> DataFrame:
    p = _prepared(spark, d)
    return rounded(features.activity_rollup(p.runs, p.windows), 3)


@query(f"WITH {FACTS} SELECT subject_id, {SUMS} FROM facts GROUP BY ALL")
def subject_rollup(spark: SparkSession, d: str) -> DataFrame:
    p = _prepared(spark, d)
    return rounded(features.subject_rollup(p.runs, p.windows), 3)


@query(f"WITH {FACTS} SELECT activity_id, subject_id, {SUMS}, CASE WHEN GROUPING(activity_id) = 0 THEN 'activity' WHEN GROUPING(subject_id) = 0 THEN 'subject' ELSE 'total' END AS level FROM facts GROUP BY GROUPING SETS ((activity_id), (subject_id), ())")
def grouping_sets_rollup(spark: SparkSession, d: str) -> DataFrame:
    p = _prepared(spark, d)
    return rounded(features.rollups(p.runs, p.windows), 3)


@query("SELECT lower(event_type) AS activity_name, count(*) AS n FROM events GROUP BY ALL")
def value_counts(spark: SparkSession, d: str) -> DataFrame:
    return features.value_counts(_sensor(spark, d).select(F.lower("activity_name").alias("activity_name")), "activity_name")


@query("SELECT count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view FROM events")
def two_label_counts(spark: SparkSession, d: str) -> DataFrame:
    return features.two_label_counts(_sensor(spark, d), "click", "view")


@query("WITH v AS (SELECT DISTINCT event_type AS a FROM events) SELECT a AS activity_name, CASE a WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS rank FROM v")
def ordered_activities(spark: SparkSession, d: str) -> DataFrame:
    return clean.ordered_categories(_sensor(spark, d), "activity_name", ["view", "click"])


@query(f"WITH {SENSOR}, l AS (SELECT DISTINCT activity_id, activity_name FROM sensor) SELECT *, (row_number() OVER (ORDER BY activity_id) - 1)::INT AS place FROM l")
def label_order(spark: SparkSession, d: str) -> DataFrame:
    return clean.label_order(_sensor(spark, d))


# --- splits ---------------------------------------------------------------------------------------

SPLIT = WINS + """,
subj AS (SELECT subject_id, row_number() OVER (ORDER BY subject_id DESC) AS r FROM (SELECT DISTINCT subject_id FROM wid)),
tagged AS (SELECT wid.*, CASE r WHEN 1 THEN 'test' WHEN 2 THEN 'val' ELSE 'train' END AS split FROM wid JOIN subj USING (subject_id))"""


@query(f"WITH {SPLIT} SELECT window_id, subject_id, split FROM tagged")
def subject_split(spark: SparkSession, d: str) -> DataFrame:
    return split.subject_split(_prepared(spark, d).windows.select("window_id", "subject_id"))


@query(f"WITH {SPLIT} SELECT split, count(*) AS n, list_sort(list(DISTINCT subject_id)) AS subjects, list_sort(list(DISTINCT activity_name)) AS activities FROM tagged GROUP BY split")
def split_profile(spark: SparkSession, d: str) -> DataFrame:
    return split.split_profile(split.subject_split(_prepared(spark, d).windows.select("subject_id", "activity_name")))


@query("SELECT vec_id AS window_id, 'a' || label AS activity_name, CASE WHEN (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) % 2 = 0 THEN 'left' ELSE 'right' END AS side FROM embeddings")
def alternating_split(spark: SparkSession, d: str) -> DataFrame:
    return split.alternating_split(src.vectors_as_windows(spark, d), ["window_id"]).select("window_id", "activity_name", "side")


@query("WITH n AS (SELECT count(*) AS n FROM embeddings) SELECT 'train' AS split, floor(n * 0.8)::BIGINT AS n FROM n UNION ALL SELECT 'val', floor(n * 0.1)::BIGINT FROM n UNION ALL SELECT 'test', n - floor(n * 0.8)::BIGINT - floor(n * 0.1)::BIGINT FROM n")
def hash_split_sizes(spark: SparkSession, d: str) -> DataFrame:
    return split.split_windows(src.vectors_as_windows(spark, d).drop("w"), "random").groupBy("split").agg(F.count("*").alias("n"))


@query("SELECT 'a' || label AS activity_name, least(count(*), 5) AS n FROM embeddings GROUP BY label")
def sample_per_activity(spark: SparkSession, d: str) -> DataFrame:
    return split.sample_per_activity(src.vectors_as_windows(spark, d), 5, "window_id").groupBy("activity_name").agg(F.count("*").alias("n"))


# --- candidate filters ----------------------------------------------------------------------------

VALUES = [f"value_{i}" for i in range(6)]
CAND = "cand AS (SELECT vec_id AS candidate_id, 'a' || label AS activity_name, " + ", ".join(f"CASE WHEN (vec_id % 97) = {i * 7 + 3} THEN NULL ELSE round(embedding[{i + 1}]::DOUBLE * (1 + (vec_id % 40 = 1)::INT * 20), {1 if i < 1 else 0}) END AS value_{i}" for i in range(6)) + " FROM embeddings WHERE vec_id % 2 = 1)"
REF = "ref AS (SELECT vec_id, " + ", ".join(f"round(embedding[{i + 1}]::DOUBLE, 3) + 0.1 AS value_{i}" for i in range(6)) + " FROM embeddings WHERE vec_id % 2 = 0)"
NORM = "sqrt(" + " + ".join(f"value_{i} * value_{i}" for i in range(6)) + ")"
BOUNDS = f"q AS (SELECT quantile_cont({NORM}, 0.25) AS q1, quantile_cont({NORM}, 0.75) AS q3 FROM ref), bounds AS (SELECT q1 - 0.5 * (q3 - q1) AS low, q3 + 0.5 * (q3 - q1) AS high FROM q)"
COMPLETE = " AND ".join(f"{v} IS NOT NULL" for v in VALUES)
REASON = f"""{CAND}, {REF}, {BOUNDS},
marked AS (SELECT *, {COMPLETE} AS complete, row_number() OVER (PARTITION BY {COMPLETE}, {', '.join(VALUES)} ORDER BY candidate_id) AS r FROM cand),
reasons AS (SELECT *, CASE WHEN NOT complete THEN 'missing_fields' WHEN r > 1 THEN 'duplicate' WHEN NOT ({NORM} BETWEEN low AND high) THEN 'norm_filter' ELSE 'kept' END AS filter_reason FROM marked, bounds)"""


def _candidates(spark, d) -> tuple[DataFrame, DataFrame]:
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    v = [F.col("embedding")[i].cast("double") for i in range(6)]
    scale = F.when(F.col("vec_id") % 40 == 1, 21).otherwise(1)
    made = [F.when(F.col("vec_id") % 97 != i * 7 + 3, F.round(v[i] * scale, 1 if i < 1 else 0)).alias(f"value_{i}") for i in range(6)]
    cand = e.where("vec_id % 2 = 1").select(F.col("vec_id").alias("candidate_id"), F.concat(F.lit("a"), "label").alias("activity_name"), *made)
    ref = e.where("vec_id % 2 = 0").select("vec_id", *[(F.round(v[i], 3) + 0.1).alias(f"value_{i}") for i in range(6)])
    return cand, ref


@query(f"WITH {REF} SELECT vec_id, round({NORM}, 6) AS norm FROM ref")
def embedding_norms(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d)[1].select("vec_id", F.round(cd.norm(VALUES), 6).alias("norm"))


@query(f"WITH {REF}, {BOUNDS} SELECT round(low, 6) AS low, round(high, 6) AS high FROM bounds")
def iqr_bounds(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cd.iqr_bounds(_candidates(spark, d)[1], VALUES, 0.5))


@query(f"WITH {REASON} SELECT candidate_id, filter_reason, list_filter([{', '.join(f'CASE WHEN {v} IS NULL THEN {chr(39)}{v}{chr(39)} END' for v in VALUES)}], lambda x: x IS NOT NULL) AS missing_columns FROM reasons")
def candidate_filter_reasons(spark: SparkSession, d: str) -> DataFrame:
    return cd.filter_candidates(*_candidates(spark, d), VALUES, factor=0.5).select("candidate_id", "filter_reason", "missing_columns")


@query(f"""WITH {REASON}, c AS (SELECT count(*) AS raw, count(*) FILTER (filter_reason <> 'missing_fields') AS after_missing, count(*) FILTER (filter_reason IN ('norm_filter', 'kept')) AS after_duplicates, count(*) FILTER (filter_reason = 'kept') AS after_norm FROM reasons)
SELECT *, round(after_norm / nullif(raw, 0), 6) AS retention_rate, round(after_duplicates / nullif(after_missing, 0), 6) AS unique_ratio, round(1 - after_duplicates / nullif(after_missing, 0), 6) AS duplicate_rate FROM c""")
def filter_stage_counts(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cd.stage_counts(cd.filter_candidates(*_candidates(spark, d), VALUES, factor=0.5)))


@query(f"WITH {CAND} SELECT candidate_id, row_number() OVER (PARTITION BY {', '.join(VALUES)} ORDER BY candidate_id) > 1 AS duplicate FROM cand")
def dedup_keep_first(spark: SparkSession, d: str) -> DataFrame:
    return cd.mark_duplicates(_candidates(spark, d)[0], VALUES, "candidate_id").select("candidate_id", "duplicate")


SC = ["c0", "c1", "c2", "c3"]
STATS = CELLS + """,
st AS (SELECT window_id, activity_name, generated, c, avg(v) AS mean, stddev_pop(v) AS std, min(v) AS mn, max(v) AS mx FROM cells GROUP BY ALL),
err AS (SELECT g.window_id AS candidate_id, g.window_id - 1 AS window_id, g.activity_name, g.c, abs(g.mean - r.mean) / greatest(r.std, 1e-6) AS m, abs(g.std - r.std) / greatest(r.std, 1e-6) AS s,
  0.5 * (abs(g.mn - r.mn) + abs(g.mx - r.mx)) / greatest(r.std, 1e-6) AS rg FROM st g JOIN st r ON r.window_id = g.window_id - 1 AND r.c = g.c WHERE g.generated),
scored AS (SELECT candidate_id, window_id, activity_name, avg(m) AS avg_mean_zerr, avg(s) AS avg_std_relerr, avg(rg) AS avg_range_zerr, 0.4 * avg(m) + 0.4 * avg(s) + 0.2 * avg(rg) AS stats_score, max(0.4 * m + 0.4 * s + 0.2 * rg) AS max_channel_stats_score FROM err GROUP BY ALL)"""
SCORE_COLS = ["candidate_id", "window_id", "activity_name", "avg_mean_zerr", "avg_std_relerr", "avg_range_zerr", "stats_score", "max_channel_stats_score"]
SCORE_SQL = ", ".join(c if i < 3 else f"round({c}, 6) AS {c}" for i, c in enumerate(SCORE_COLS))


def _scores(spark, d) -> DataFrame:
    w = src.vectors_as_windows(spark, d)
    stats = features.stat_targets(w, SC, ["window_id", "activity_name", "generated"])
    made = stats.where("generated").withColumn("candidate_id", F.col("window_id")).withColumn("window_id", F.col("window_id") - 1)
    return cd.stats_scores(made, stats.where("NOT generated"), SC)


@query(f"WITH {STATS} SELECT {SCORE_SQL} FROM scored")
def stats_scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_scores(spark, d).select(*SCORE_COLS))


TOP = "top AS (SELECT *, row_number() OVER (PARTITION BY lower(activity_name) ORDER BY stats_score, max_channel_stats_score, candidate_id) AS r, count(*) OVER (PARTITION BY lower(activity_name)) AS n FROM scored)"


@query(f"WITH {STATS}, {TOP}, f AS (SELECT 'p70' AS filter_name, 0.7::DOUBLE AS f UNION ALL SELECT 'p35', 0.35) SELECT filter_name, candidate_id FROM top, f WHERE r <= greatest(1, ceil(n * f))")
def top_fraction(spark: SparkSession, d: str) -> DataFrame:
    return cd.apply_filters(_scores(spark, d), cd.parse_filter_specs(["p70:0.7", "p35:0.35"])).select("filter_name", "candidate_id")


@query(f"WITH {STATS}, {TOP}, k AS (SELECT * FROM top WHERE r <= greatest(1, ceil(n * 0.5::DOUBLE))) SELECT (SELECT count(*) FROM k) AS kept, count(*) AS total, round((SELECT count(*) FROM k) / count(*), 6) AS fraction, (SELECT round(avg(stats_score), 6) FROM k) AS mean_score, (SELECT round(median(stats_score), 6) FROM k) AS median_score, (SELECT round(max(stats_score), 6) FROM k) AS max_score FROM scored")
def filter_summary(spark: SparkSession, d: str) -> DataFrame:
    s = _scores(spark, d)
    return rounded(cd.filter_summary(cd.top_fraction(s, 0.5), s))


@query(f"WITH {STATS}, {TOP} SELECT lower(activity_name) AS activity_name, count(*) FILTER (r <= greatest(1, ceil(n * 0.5::DOUBLE))) AS kept, count(*) AS total FROM top GROUP BY ALL")
def filter_summary_by_activity(spark: SparkSession, d: str) -> DataFrame:
    s = _scores(spark, d)
    return cd.kept_by_activity(cd.top_fraction(s, 0.5), s)


PAIRS = CELLS + """,
side AS (SELECT DISTINCT window_id, activity_name, generated FROM cells),
rk AS (SELECT *, row_number() OVER (PARTITION BY activity_name, generated ORDER BY window_id) AS rn FROM side),
pairs AS (SELECT a.activity_name, a.rn, a.window_id AS r_id, b.window_id AS s_id FROM rk a JOIN rk b ON a.activity_name = b.activity_name AND a.rn = b.rn AND NOT a.generated AND b.generated),
pc AS (SELECT p.*, x.c, x.t, x.v AS x, y.v AS y FROM pairs p JOIN cells x ON x.window_id = p.r_id JOIN cells y ON y.window_id = p.s_id AND y.c = x.c AND y.t = x.t)"""


def _sides(spark, d) -> tuple[DataFrame, DataFrame]:
    w = src.vectors_as_windows(spark, d)
    return w.where("NOT generated"), w.where("generated")


def _pairs(spark, d) -> DataFrame:
    return split.pair_windows(*_sides(spark, d), None, None)


def _sampled_pairs(spark, d) -> DataFrame:
    """The operator's own sample; no SQL has its hash order."""
    return split.pair_windows(*_sides(spark, d))


@query(f"WITH {PAIRS} SELECT activity_name, rn::INT AS rn, r_id, s_id, round(sqrt(avg((x - y) * (x - y))), 6) AS rmse_to_prompt_real, round(avg(abs(x - y)), 6) AS mae_to_prompt_real FROM pc GROUP BY ALL")
def candidate_rmse_mae(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cd.prompt_errors(_pairs(spark, d)).drop("r", "s"))


@query(f"WITH {PAIRS}, e AS (SELECT activity_name, s_id, sqrt(avg((x - y) * (x - y))) AS rmse FROM pc GROUP BY ALL) SELECT activity_name, s_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY activity_name ORDER BY rmse, s_id)::INT AS rank FROM e) WHERE rank <= 3")
def topk_per_group(spark: SparkSession, d: str) -> DataFrame:
    return cd.top_k(cd.prompt_errors(_pairs(spark, d)), 3, ["rmse_to_prompt_real", "s_id"]).select("activity_name", "s_id", "rank")


@query("WITH r AS (SELECT vec_id, label FROM embeddings WHERE vec_id % 6 = 0), f AS (SELECT label, min(vec_id) AS first FROM r GROUP BY label) SELECT g.vec_id AS candidate_id, coalesce(r.vec_id, f.first) AS real_index FROM embeddings g LEFT JOIN r ON r.vec_id = g.vec_id - 1 LEFT JOIN f ON f.label = g.label WHERE g.vec_id % 2 = 1 AND coalesce(r.vec_id, f.first) IS NOT NULL")
def fallback_join(spark: SparkSession, d: str) -> DataFrame:
    real, made = _sides(spark, d)
    real = real.where("window_id % 6 = 0").withColumn("real_index", F.col("window_id"))
    made = made.select(F.col("window_id").alias("candidate_id"), (F.col("window_id") - 1).alias("window_id"), F.upper("activity_name").alias("activity_name"))
    return cd.fallback_join(made, real).select("candidate_id", "real_index")


@query(f"WITH {STATS}, s AS (SELECT * FROM scored WHERE candidate_id % 3 = 0) SELECT e.vec_id AS candidate_id, round(s.stats_score, 6) AS stats_score FROM embeddings e LEFT JOIN s ON s.candidate_id = e.vec_id WHERE e.vec_id % 2 = 1")
def left_join_scores(spark: SparkSession, d: str) -> DataFrame:
    made = _sides(spark, d)[1].select(F.col("window_id").alias("candidate_id"))
    s = _scores(spark, d).where("candidate_id % 3 = 0").select("candidate_id", "stats_score")
    return rounded(cd.join_scores(made, s.unionByName(s)))


# --- metrics --------------------------------------------------------------------------------------

SIDES = CELLS + ", common AS (SELECT activity_name FROM cells WHERE generated INTERSECT SELECT activity_name FROM cells WHERE NOT generated), x AS (SELECT * FROM cells WHERE activity_name IN (SELECT activity_name FROM common))"


@query(f"""WITH {SIDES}, x1 AS (SELECT * FROM x WHERE t > 0),
e0 AS (SELECT activity_name, c, t, min(v) FILTER (NOT generated) AS lo, max(v) FILTER (NOT generated) AS top, count(*) FILTER (NOT generated) AS nr, count(*) FILTER (generated) AS ns FROM x1 GROUP BY ALL),
e AS (SELECT *, CASE WHEN abs(top - lo) <= 1e-8 + 1e-5 * abs(lo) THEN lo + 1e-5 ELSE top END AS hi FROM e0),
b AS (SELECT activity_name, c, t, nr, ns, lo, hi, least(floor((v - lo) / ((hi - lo) / 50)), 49) AS bin, count(*) FILTER (NOT generated) AS a, count(*) FILTER (generated) AS g FROM x1 JOIN e USING (activity_name, c, t) WHERE v BETWEEN lo AND hi GROUP BY ALL),
p AS (SELECT activity_name, c, t, sum(abs(a / nr - g / ns) / ((hi - lo) / 50)) / 50 AS dd FROM b GROUP BY ALL)
SELECT activity_name, round(avg(dd), 6) AS "MDD" FROM p GROUP BY activity_name""")
def mdd(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.mdd(*_sides(spark, d)))


@query(f"""WITH {SIDES}, m AS (SELECT activity_name, generated, c, avg(v) AS mu, count(*) AS n FROM x GROUP BY ALL),
s AS (SELECT x.activity_name, x.generated, x.c, avg(pow(v - mu, 3)) / pow(sum(pow(v - mu, 2)) / (any_value(n) - 1), 1.5) AS s FROM x JOIN m USING (activity_name, generated, c) GROUP BY ALL)
SELECT a.activity_name, round(avg(abs(a.s - b.s)), 6) AS "SD" FROM s a JOIN s b ON a.activity_name = b.activity_name AND a.c = b.c AND a.generated AND NOT b.generated GROUP BY ALL""")
def skewness_diff(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.skewness_difference(*_sides(spark, d)))


@query(f"""WITH {SIDES}, s AS (SELECT activity_name, generated, c, kurtosis_pop(v) AS s FROM x GROUP BY ALL)
SELECT a.activity_name, round(avg(abs(a.s - b.s)), 6) AS "KD" FROM s a JOIN s b ON a.activity_name = b.activity_name AND a.c = b.c AND a.generated AND NOT b.generated GROUP BY ALL""")
def kurtosis_diff(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.kurtosis_difference(*_sides(spark, d)))


@query(f"WITH {PAIRS}, p AS (SELECT activity_name, rn, c, sqrt(sum((x - y) * (x - y))) AS d FROM pc GROUP BY ALL), q AS (SELECT activity_name, rn, avg(d) AS d FROM p GROUP BY ALL) SELECT activity_name, round(avg(d), 6) AS \"ED\" FROM q GROUP BY activity_name")
def ed_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.ed(_pairs(spark, d)))


@query(f"""WITH {SIDES}, m AS (SELECT activity_name, generated, c, avg(v) AS mu, var_pop(v) AS var FROM x GROUP BY ALL),
y AS (SELECT x.*, v - mu AS y, var FROM x JOIN m USING (activity_name, generated, c)),
l AS (SELECT a.activity_name, a.generated, a.c, b.t - a.t AS lag, avg(a.y * b.y) / any_value(CASE WHEN abs(a.var) <= 1e-8 THEN 1 ELSE a.var END) AS s FROM y a JOIN y b ON a.window_id = b.window_id AND a.c = b.c AND b.t BETWEEN a.t AND a.t + 31 GROUP BY ALL),
p AS (SELECT a.activity_name, a.c, sqrt(sum((a.s - b.s) * (a.s - b.s))) AS d FROM l a JOIN l b ON a.activity_name = b.activity_name AND a.c = b.c AND a.lag = b.lag AND a.generated AND NOT b.generated GROUP BY ALL)
SELECT activity_name, round(avg(d), 6) AS "ACD" FROM p GROUP BY activity_name""")
def acd(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.autocorrelation_difference(*_sides(spark, d)))


@query(f"WITH {PAIRS}, p AS (SELECT activity_name, rn, c, sqrt(sum((x - y) * (x - y))) AS d FROM pc GROUP BY ALL), q AS (SELECT activity_name, rn, avg(d) AS d FROM p GROUP BY ALL), a AS (SELECT activity_name, count(*) AS num_real, avg(d) AS ed FROM q GROUP BY activity_name) SELECT activity_name, num_real, round(ed, 6) AS \"ED\" FROM a UNION ALL SELECT 'overall_mean', sum(num_real)::BIGINT, round(avg(ed), 6) FROM a")
def overall_mean_row(spark: SparkSession, d: str) -> DataFrame:
    per = metrics.pair_distances(_pairs(spark, d)).groupBy("activity_name").agg(F.count("*").alias("num_real"), F.avg("ed").alias("ED"))
    return rounded(metrics.with_overall(per, ["ED"], ["num_real"]))


@query(f"""WITH {CELLS}, side AS (SELECT DISTINCT window_id, activity_name FROM cells), lr AS (SELECT *, row_number() OVER (PARTITION BY activity_name ORDER BY window_id) - 1 AS i FROM side),
p AS (SELECT a.activity_name, a.window_id AS r_id, b.window_id AS s_id FROM lr a JOIN lr b ON a.activity_name = b.activity_name AND b.i = a.i + 1 AND a.i % 2 = 0),
q AS (SELECT p.activity_name, r_id, x.c, sqrt(sum((x.v - y.v) * (x.v - y.v))) AS d FROM p JOIN cells x ON x.window_id = p.r_id JOIN cells y ON y.window_id = p.s_id AND y.c = x.c AND y.t = x.t GROUP BY ALL),
e AS (SELECT activity_name, r_id, avg(d) AS d FROM q GROUP BY ALL), m AS (SELECT activity_name, avg(d) AS d FROM e GROUP BY ALL) SELECT round(avg(d), 6) AS "ED_ref" FROM m""")
def real_reference(spark: SparkSession, d: str) -> DataFrame:
    return rounded(reports.real_reference(src.vectors_as_windows(spark, d), cap=None, seed=None).select("ED_ref"))


@query()
def dtw_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.warp(_sampled_pairs(spark, d)))


@query()
def shr(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.shapelets(_sampled_pairs(spark, d)))


@query()
def similarity_all(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.similarity(*_sides(spark, d), _sampled_pairs(spark, d)))


# --- text -----------------------------------------------------------------------------------------

TV = ["value_0", "value_1", "value_2"]
ROWS = "rows AS (SELECT vec_id AS window_id, (vec_id % 9)::INT AS subject_id, label AS activity_id, CASE label WHEN 4 THEN 'walking' WHEN 5 THEN 'running' ELSE 'a' || label END AS activity_name, " + ", ".join(f"round(embedding[{i + 1}]::DOUBLE, 4) AS value_{i}" for i in range(3)) + " FROM embeddings)"
BLANK = ", ".join(f"{v} is [blank]" for v in TV)


def _rows(spark, d) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    name = F.when(F.col("label") == 4, "walking").when(F.col("label") == 5, "running").otherwise(F.concat(F.lit("a"), "label"))
    return e.select(F.col("vec_id").alias("window_id"), (F.col("vec_id") % 9).cast("int").alias("subject_id"), F.col("label").alias("activity_id"), name.alias("activity_name"), *[tx.round_signed(F.col("embedding")[i].cast("double"), 4).alias(f"value_{i}") for i in range(3)])


@query(f"WITH {ROWS} SELECT window_id, 'Condition: window_id is ' || window_id || ', subject_id is ' || subject_id || ', activity_id is ' || activity_id || ', activity_name is ' || activity_name || ' [sep] Input: {BLANK} [sep] Target: ' || printf('%.4f [answer] %.4f [answer] %.4f [answer]', value_0, value_1, value_2) || '<|endoftext|>' AS text FROM rows")
def text_records(spark: SparkSession, d: str) -> DataFrame:
    return tx.text_records(_rows(spark, d), TV).select("window_id", "text")


@query(f"WITH {ROWS} SELECT window_id, 'Condition: activity_name is ' || activity_name || ', activity_id is ' || activity_id || ', window_id is ' || window_id || ', subject_id is ' || subject_id || ' [sep] Input: {BLANK} [sep] Target: ' AS prompt, 'Condition: activity=' || activity_name || '; activity_id=' || activity_id || '; subject_id=' || subject_id || '; window_id=' || window_id || '; hint=' || CASE activity_name WHEN 'walking' THEN 'periodic locomotion' WHEN 'running' THEN 'high-energy periodic locomotion' ELSE 'human motion' END || '; task=sensor_embedding_3_values' || chr(10) || 'Target values:' || chr(10) AS compact FROM rows")
def prompts(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).select("window_id", tx.prompt(TV).alias("prompt"), tx.prompt(TV, "compact_values_v2").alias("compact"))


HINT = "CASE activity_name WHEN 'walking' THEN 'periodic locomotion' WHEN 'running' THEN 'high-energy periodic locomotion' ELSE 'human motion' END"
EVERY = [*IDS, *TV]
SHOWN = [c if c in IDS else f"printf('%.4f', {c})" for c in EVERY]


@query(f"""WITH {ROWS} SELECT window_id,
  {" || ', ' || ".join(f"'{c} is ' || {v}" for c, v in zip(EVERY, SHOWN, strict=True))} || '<|endoftext|>' AS base,
  'Input: {", ".join(f"{c} is [blank]" for c in EVERY)} [sep] Target: ' || {" || ' ' || ".join(f"{v} || ' [answer]'" for v in SHOWN)} || '<|endoftext|>' AS fim,
  'Condition:' || chr(10) || 'activity_name = ' || activity_name || chr(10) || 'activity_id = ' || activity_id || chr(10) || 'subject_id = ' || subject_id || chr(10) || 'window_id = ' || window_id || chr(10)
  || 'task = generate a standardized sensor 18-channel 256-step motion embedding' || chr(10) || 'motion_hint = ' || {HINT} || chr(10) || chr(10) || 'Input:' || chr(10) || 'values = [blank] x 3' || chr(10) || chr(10) || 'Target:' || chr(10)
  || {" || '; ' || ".join(f"'{c} = ' || printf('%.4f', {c})" for c in TV)} || '; [end]<|endoftext|>' AS structured,
  'Condition: activity=' || activity_name || '; activity_id=' || activity_id || '; subject_id=' || subject_id || '; window_id=' || window_id || '; hint=' || {HINT} || '; task=sensor_embedding_3_values' || chr(10) || 'Target values:' || chr(10)
  || {" || ', ' || ".join(f"printf('%.4f', {c})" for c in TV)} || ' [end]<|endoftext|>' AS compact FROM rows""")
def text_templates(spark: SparkSession, d: str) -> DataFrame:
    forms = {"base": "base_template", "fim": "fim_template", "structured": "structured_v2", "compact": "compact_values_v2"}
    return _rows(spark, d).select("window_id", *[tx.record(EVERY, TV, template).alias(name) for name, template in forms.items()])


MADE = f"{ROWS}, made AS (SELECT window_id AS candidate_id, CASE window_id % 5 WHEN 0 THEN 'x Target: 9' || chr(10) || '[sep] Target: value_1 = ' || value_1 || '; value_0 is ' || value_0 || '; value_2 = 1e-3 [end]' WHEN 1 THEN '[sep] target values : ' || value_0 || ' [answer] value_7 ' || value_1 || ' [answer]' WHEN 2 THEN 'no marker ' || value_0 || ', ' || value_1 || ', ' || value_2 || ' -' WHEN 3 THEN 'Target: ' ELSE 'Target:' || value_0 || '</s>' || value_1 || '<|endoftext|> .5 77' END AS text FROM rows), tails AS (SELECT *, regexp_replace(text, '[\\r\\n]', ' ', 'g') AS flat FROM made), t AS (SELECT candidate_id, text, CASE WHEN regexp_matches(flat, '(?i)(?:\\[sep\\]\\s*)?Target(?:\\s+values)?\\s*:') THEN regexp_extract(flat, '(?is)^.*(?:\\[sep\\]\\s*)?Target(?:\\s+values)?\\s*:(.*)$', 1) ELSE flat END AS tail, CASE WHEN regexp_matches(flat, '(?i)(?:\\[sep\\]\\s*)?Target(?:\\s+values)?\\s*:') THEN 'ok' ELSE 'target_marker_missing' END AS marker_status FROM tails)"
NUM = "[-+]?(?:\\d+\\.\\d+|\\d+|\\.\\d+)(?:[eE][-+]?\\d+)?"


def _made(spark, d) -> DataFrame:
    v = [tx.format_number(F.col(f"value_{i}"), 4) for i in range(3)]
    w = F.col("window_id") % 5
    text = (
        F.when(w == 0, F.concat(F.lit("x Target: 9\n[sep] Target: value_1 = "), v[1], F.lit("; value_0 is "), v[0], F.lit("; value_2 = 1e-3 [end]")))
        .when(w == 1, F.concat(F.lit("[sep] target values : "), v[0], F.lit(" [answer] value_7 "), v[1], F.lit(" [answer]")))
        .when(w == 2, F.concat(F.lit("no marker "), v[0], F.lit(", "), v[1], F.lit(", "), v[2], F.lit(" -")))
        .when(w == 3, F.lit("Target: "))
        .otherwise(F.concat(F.lit("Target:"), v[0], F.lit("</s>"), v[1], F.lit("<|endoftext|> .5 77")))
    )
    return _rows(spark, d).select(F.col("window_id").alias("candidate_id"), text.alias("text"))


for _i in range(3):
    MADE = MADE.replace(f"|| value_{_i}", f"|| printf('%.4f', value_{_i})")


@query(f"WITH {MADE} SELECT candidate_id, tail, marker_status FROM t")
def target_tail(spark: SparkSession, d: str) -> DataFrame:
    return _made(spark, d).select("candidate_id", tx.target_tail(F.col("text")).alias("tail"), tx.marker_status(F.col("text")).alias("marker_status"))


NAMED = ", ".join(f"list_filter(list_transform(range(1, len(ks) + 1), lambda i: CASE WHEN ks[i] = 'value_{j}' THEN vs[i] END), lambda x: x IS NOT NULL)[-1]::DOUBLE AS value_{j}" for j in range(3))
SEQ = ", ".join(f"ns[{j + 1}]::DOUBLE AS value_{j}" for j in range(3))
KV = f"kv AS (SELECT *, regexp_extract_all(tail, '(?i)\\b(value_\\d+)\\s*(?:=|is)\\s*({NUM})', 1) AS ks, regexp_extract_all(tail, '(?i)\\b(value_\\d+)\\s*(?:=|is)\\s*({NUM})', 2) AS vs, regexp_extract_all(replace(replace(replace(regexp_replace(tail, '(?i)value_\\d+', 'VALUE', 'g'), '<|endoftext|>', ' '), '</s>', ' '), '[answer]', ' '), '({NUM})', 1) AS ns, regexp_extract_all(tail, '({NUM})', 1) AS toks FROM t)"


@query(f"WITH {MADE}, {KV} SELECT candidate_id, {NAMED} FROM kv")
def parse_named(spark: SparkSession, d: str) -> DataFrame:
    v = tx.parse_named(tx.target_tail(F.col("text")), TV)
    return _made(spark, d).withColumn("v", v).select("candidate_id", *[F.col("v")[i].alias(c) for i, c in enumerate(TV)])


@query(f"WITH {MADE}, {KV} SELECT candidate_id, {SEQ} FROM kv")
def parse_sequential(spark: SparkSession, d: str) -> DataFrame:
    v = tx.parse_sequential(tx.target_tail(F.col("text")), TV)
    return _made(spark, d).withColumn("v", v).select("candidate_id", *[F.col("v")[i].alias(c) for i, c in enumerate(TV)])


@query(f"""WITH {MADE}, {KV}, n AS (SELECT candidate_id, {NAMED} FROM kv), s AS (SELECT candidate_id, {SEQ} FROM kv),
p AS (SELECT kv.*, coalesce(n.value_0, n.value_1, n.value_2) IS NOT NULL AS named, CASE WHEN coalesce(n.value_0, n.value_1, n.value_2) IS NOT NULL THEN [n.value_0, n.value_1, n.value_2] ELSE [s.value_0, s.value_1, s.value_2] END AS v FROM kv JOIN n USING (candidate_id) JOIN s USING (candidate_id))
SELECT candidate_id, marker_status, v[1] AS value_0, v[2] AS value_1, v[3] AS value_2, (SELECT count(*) FROM (SELECT unnest(v) AS u) WHERE u IS NULL)::INT AS missing_numeric_count, len(toks)::INT AS extracted_token_count, toks[-1] AS last_extracted_token, CASE WHEN named THEN 'named' ELSE 'sequential' END AS parse_mode, regexp_matches(rtrim(tail), '[-.\\[,]$') AS tail_truncation_hint, right(rtrim(tail), 1) AS tail_last_char FROM p""")
def parse_debug(spark: SparkSession, d: str) -> DataFrame:
    return tx.parse(_made(spark, d), "text", TV).select("candidate_id", "marker_status", *TV, "missing_numeric_count", "extracted_token_count", "last_extracted_token", "parse_mode", "tail_truncation_hint", "tail_last_char")


# --- classification -------------------------------------------------------------------------------

KX = ", ".join(f"(embedding[{i + 1}]::DOUBLE - m[{i + 1}]) / s[{i + 1}]" for i in range(64))
KNN = f"""tr AS (SELECT vec_id, label, embedding FROM embeddings WHERE vec_id % 3 <> 0), qs AS (SELECT vec_id, label, embedding FROM embeddings WHERE vec_id % 3 = 0),
z AS (SELECT [{', '.join(f'avg(embedding[{i + 1}]::DOUBLE)' for i in range(64))}] AS m, [{', '.join(f'stddev_pop(embedding[{i + 1}]::DOUBLE)' for i in range(64))}] AS s FROM tr),
a AS (SELECT vec_id, label, [{KX}] AS x FROM tr, z), b AS (SELECT vec_id, label, [{KX}] AS x FROM qs, z),
dist AS (SELECT b.vec_id AS query_id, b.label, a.label AS tl, a.vec_id AS tid, list_distance(a.x, b.x) AS d FROM a, b),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, tid) AS r FROM dist QUALIFY r <= 5),
vote AS (SELECT query_id, label, tl, sum(1 / d) AS w FROM near GROUP BY ALL),
pred AS (SELECT query_id, label, tl AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY w DESC, tl) AS r FROM vote) WHERE r = 1)"""


def _predictions(spark, d) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    train = e.where("vec_id % 3 <> 0")
    a = cl.standardize(train, train, "v").select(F.col("vec_id").alias("train_id"), "label", "x")
    return cl.knn(a, cl.standardize(e.where("vec_id % 3 = 0"), train, "v").select(F.col("vec_id").alias("query_id"), "label", "x"))


@query(f"WITH {KNN} SELECT * FROM pred")
def knn_consistency(spark: SparkSession, d: str) -> DataFrame:
    return _predictions(spark, d)


@query(f"WITH {KNN} SELECT label, {', '.join(f'count(*) FILTER (prediction = {i}) AS {chr(34)}{i}{chr(34)}' for i in range(10))} FROM pred GROUP BY label")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return cl.confusion(_predictions(spark, d), list(range(10)))


F1 = "lab AS (SELECT label AS l FROM pred UNION SELECT prediction FROM pred), f AS (SELECT l, (SELECT count(*) FROM pred WHERE label = l) AS sup, (SELECT count(*) FROM pred WHERE prediction = l) AS pr, (SELECT count(*) FROM pred WHERE label = l AND prediction = l) AS tp FROM lab), g AS (SELECT *, coalesce(2 * tp / nullif(sup + pr, 0), 0) AS f1 FROM f)"


@query(f"WITH {KNN}, {F1} SELECT round(sum(tp) / sum(sup), 6) AS accuracy, round(avg(f1), 6) AS macro_f1, round(sum(f1 * sup) / sum(sup), 6) AS weighted_f1, sum(sup)::BIGINT AS num_samples FROM g")
def f1_scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cl.scores(_predictions(spark, d)))


@query(f"WITH {KNN}, s AS (SELECT DISTINCT label FROM tr) SELECT s.label, count(pred.query_id) AS num_samples, round(avg((prediction = pred.label)::INT), 6) AS accuracy FROM s LEFT JOIN pred ON pred.label = s.label GROUP BY s.label")
def per_label_accuracy(spark: SparkSession, d: str) -> DataFrame:
    labels = spark.read.parquet(f"{d}/embeddings.parquet").where("vec_id % 3 <> 0")
    return rounded(cl.per_label_accuracy(_predictions(spark, d), labels))


@query()
def rf_utility(spark: SparkSession, d: str) -> DataFrame:
    f = features.har_features(src.vectors_as_windows(spark, d), 4, ["window_id", "generated", F.col("activity_id").alias("label")])
    cols = [c for c in f.columns if c.startswith("ch")]
    real, made = f.where("NOT generated"), f.where("generated")
    return rounded(cl.forest_utility(real.where("window_id % 4 = 0"), made, real.where("window_id % 4 = 2"), cols, depth=30))


@query("WITH a AS (SELECT n_chars::DOUBLE AS x, doc_id::DOUBLE AS y FROM documents), r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM a) SELECT round(corr(rx, ry), 6) AS spearman FROM r")
def spearman_adherence(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cl.spearman(spark.read.parquet(f"{d}/documents.parquet").select("n_chars", "doc_id"), "n_chars", "doc_id"))


# --- reducers -------------------------------------------------------------------------------------


@query()
def pca_embed(spark: SparkSession, d: str) -> DataFrame:
    w = src.vectors_as_windows(spark, d)
    model = reduce.fit(w.where("NOT generated"), SC, "pca", 3)
    return reduce.expand_values(reduce.transform(w.select("window_id", "activity_name", "w"), model), 12)


def _roundtrip(spark, d, method: str, k: int) -> DataFrame:
    w = src.vectors_as_windows(spark, d).select("window_id", "w")
    model = reduce.fit(w, SC, method, k, "per_channel_train")
    back = reduce.inverse(reduce.transform(w, model), model)
    both = w.select("window_id", F.col("w").alias("r")).join(back.select("window_id", F.col("w").alias("s")), "window_id")
    return cd.prompt_errors(both).agg(F.count("*").alias("n"), F.round(F.max("rmse_to_prompt_real"), 6).alias("worst_rmse"))


@query("SELECT count(*) AS n, 0.0::DOUBLE AS worst_rmse FROM embeddings")
def pca_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return _roundtrip(spark, d, "pca", 16)


@query("SELECT count(*) AS n, 0.0::DOUBLE AS worst_rmse FROM embeddings")
def fastica_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return _roundtrip(spark, d, "fastica", 16)


@query()
def compact_ica(spark: SparkSession, d: str) -> DataFrame:
    return reduce.compact(src.vectors_as_windows(spark, d).select("window_id", "w"), 4, "fastica")


@query()
def compact_pca(spark: SparkSession, d: str) -> DataFrame:
    return reduce.compact_pca(src.vectors_as_windows(spark, d).select("window_id", "w"), 8)


# --- reports and relational parity ----------------------------------------------------------------

RUN = "lab AS (SELECT label, count(*) AS n, avg(embedding[1]::DOUBLE) AS ed, avg(embedding[2]::DOUBLE) AS dtw FROM embeddings WHERE vec_id % 2 = 1 GROUP BY label), base AS (SELECT label, avg(embedding[1]::DOUBLE) AS ed FROM embeddings WHERE vec_id % 2 = 0 AND label < 8 GROUP BY label)"


def _runs(spark, d) -> tuple[DataFrame, DataFrame]:
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "label", F.col("embedding")[0].cast("double").alias("a"), F.col("embedding")[1].cast("double").alias("b"))
    made = e.where("vec_id % 2 = 1").groupBy("label").agg(F.count("*").alias("n"), F.avg("a").alias("ED"), F.avg("b").alias("DTW"))
    return made, e.where("vec_id % 2 = 0 AND label < 8").groupBy("label").agg(F.avg("a").alias("ED"))


@query(f'WITH {RUN} SELECT lab.label, n, round(lab.ed, 6) AS "ED", round(base.ed, 6) AS "ED_ref", round(lab.ed / nullif(base.ed, 0), 4) AS "ED_ratio" FROM lab LEFT JOIN base USING (label)')
def ratio_vs_baseline(spark: SparkSession, d: str) -> DataFrame:
    made, base = _runs(spark, d)
    return reports.with_baseline(made.drop("DTW"), base, "label", ["ED"]).select("label", "n", F.round("ED", 6).alias("ED"), F.round("ED_ref", 6).alias("ED_ref"), F.round("ED_ratio", 4).alias("ED_ratio"))


@query(f"WITH {RUN} SELECT 'ED' AS metric, 'run' || label AS best, round(ed, 6) AS value FROM (SELECT * FROM lab ORDER BY ed DESC, 'run' || label LIMIT 1) UNION ALL SELECT 'DTW', 'run' || label, round(dtw, 6) FROM (SELECT * FROM lab ORDER BY dtw, 'run' || label LIMIT 1)")
def best_by_metric(spark: SparkSession, d: str) -> DataFrame:
    made = _runs(spark, d)[0].withColumn("run", F.concat(F.lit("run"), "label"))
    return rounded(reports.best_by(made, "run", {"ED": "max", "DTW": "min"}))


@query("SELECT 'a' || label AS activity_name, round(avg(embedding[1]::DOUBLE) FILTER (vec_id % 2 = 0), 6) AS m0, round(avg(embedding[1]::DOUBLE) FILTER (vec_id % 2 = 1), 6) AS m1 FROM embeddings GROUP BY label")
def metric_pivot(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    long = e.groupBy(F.concat(F.lit("a"), "label").alias("activity_name"), F.concat(F.lit("m"), F.col("vec_id") % 2).alias("model")).agg(F.avg(F.col("embedding")[0].cast("double")).alias("ED"))
    return rounded(reports.metric_pivot(long, "ED", ["m0", "m1"]))


@query("SELECT vec_id AS window_id, 'a' || label AS activity_name, CASE WHEN vec_id % 2 = 1 THEN 'synthetic' ELSE 'real' END AS source FROM embeddings")
def union_tagged(spark: SparkSession, d: str) -> DataFrame:
    real, made = (x.select("window_id", "activity_name") for x in _sides(spark, d))
    return reports.tag_union({"real": real, "synthetic": made})


@query("SELECT 'a' || label AS activity_name FROM embeddings WHERE vec_id % 2 = 0 AND label < 7 INTERSECT SELECT 'a' || label FROM embeddings WHERE vec_id % 2 = 1 AND label > 2")
def activity_intersection(spark: SparkSession, d: str) -> DataFrame:
    real, made = _sides(spark, d)
    return reports.common_activities(real.where("activity_id < 7"), made.where("activity_id > 2"))


@query("SELECT DISTINCT 'a' || label AS activity_name FROM embeddings WHERE label NOT IN (1, 2)")
def activity_difference(spark: SparkSession, d: str) -> DataFrame:
    w = src.vectors_as_windows(spark, d)
    return w.select("activity_name").distinct().join(spark.createDataFrame([("a1",), ("a2",)], "activity_name string"), "activity_name", "left_anti")


@query("""WITH l AS (SELECT l_returnflag AS run, l_linestatus AS setting, sum(l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY ALL), o AS (SELECT run, sum(n)::BIGINT AS n, sum(q) AS q FROM l GROUP BY run), r AS (SELECT unnest(['A', 'N', 'R', 'X']) AS run)
SELECT r.run AS run_name, o.n AS rows, round(o.q, 3) AS quantity, round(f.q, 3) AS f_quantity FROM r LEFT JOIN o USING (run) LEFT JOIN (SELECT * FROM l WHERE setting = 'F') f ON f.run = r.run""")
def run_summary_join(spark: SparkSession, d: str) -> DataFrame:
    li = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_returnflag").alias("run_name"), F.col("l_linestatus").alias("setting")).agg(F.sum("l_quantity").alias("q"), F.count("*").alias("n"))
    overall = li.groupBy("run_name").agg(F.sum("n").alias("rows"), F.sum("q").alias("quantity"))
    runs = spark.createDataFrame([(x,) for x in "ANRX"], "run_name string")
    f = li.groupBy("run_name").agg(F.max(F.when(F.col("setting") == "F", F.col("q"))).alias("f_quantity"))
    return rounded(runs.join(overall, "run_name", "left").join(f, "run_name", "left"), 3)


REGISTRY = """sim AS (SELECT l_returnflag AS run_name, CASE l_linestatus WHEN 'O' THEN 'overall_mean' ELSE 'f' END AS activity_name, avg(l_quantity) AS ed, avg(l_extendedprice) AS dtw FROM lineitem GROUP BY ALL),
use AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'N' ELSE 'R' END AS run_name, CASE left(o_orderpriority, 1) WHEN '1' THEN 'real_only' WHEN '2' THEN 'synthetic_only' ELSE 'real_plus_synthetic' END AS setting,
  avg(o_totalprice) / 1e6 AS accuracy, min(o_totalprice) / 1e6 AS macro_f1, max(o_totalprice) / 1e6 AS weighted_f1 FROM orders GROUP BY ALL)"""


def _registry(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Runs, similarity rows and utility rows in the roles of run artefacts."""
    li, o = spark.read.parquet(f"{d}/lineitem.parquet"), spark.read.parquet(f"{d}/orders.parquet")
    activity = F.when(F.col("l_linestatus") == "O", "overall_mean").otherwise("f")
    sim = li.groupBy(F.col("l_returnflag").alias("run_name"), activity.alias("activity_name")).agg(F.avg("l_quantity").alias("ED"), F.avg("l_extendedprice").alias("DTW"))
    run = F.when(F.col("o_orderstatus") == "F", "A").when(F.col("o_orderstatus") == "O", "N").otherwise("R")
    first = F.left("o_orderpriority", F.lit(1))
    setting = F.when(first == "1", "real_only").when(first == "2", "synthetic_only").otherwise("real_plus_synthetic")
    use = o.groupBy(run.alias("run_name"), setting.alias("setting")).agg(*[(f("o_totalprice") / 1e6).alias(n) for f, n in ((F.avg, "accuracy"), (F.min, "macro_f1"), (F.max, "weighted_f1"))])
    return spark.createDataFrame([(x,) for x in "ANRX"], "run_name string"), sim, use


@query(f"""WITH {REGISTRY}, r AS (SELECT unnest(['A', 'N', 'R', 'X']) AS run_name), a AS (SELECT run_name, {', '.join(f"max(accuracy) FILTER (setting = '{x}') AS {x}" for x in ("real_only", "synthetic_only", "real_plus_synthetic"))} FROM use GROUP BY run_name)
SELECT r.run_name, round(s.ed, 4) AS "ED", round(s.dtw, 4) AS "DTW", round(real_only, 4) AS real_only_accuracy, round(synthetic_only, 4) AS synthetic_only_accuracy, round(real_plus_synthetic, 4) AS real_plus_synthetic_accuracy, round(real_plus_synthetic - real_only, 4) AS utility_gain
FROM r LEFT JOIN (SELECT * FROM sim WHERE activity_name = 'overall_mean') s USING (run_name) LEFT JOIN a USING (run_name)""")
def run_registry(spark: SparkSession, d: str) -> DataFrame:
    return rounded(reports.run_summary(*_registry(spark, d)), 4)


@query(f"""WITH {REGISTRY} SELECT run_name, round(max(ed) FILTER (activity_name = 'overall_mean'), 4) AS "ED", round(max(dtw) FILTER (activity_name = 'overall_mean'), 4) AS "DTW",
  (SELECT round(max(accuracy), 4) FROM use u WHERE u.run_name = sim.run_name AND setting = 'real_only') AS real_only, (SELECT round(max(weighted_f1), 4) FROM use u WHERE u.run_name = sim.run_name AND setting = 'real_plus_synthetic') AS both_f1 FROM sim WHERE run_name = 'N' GROUP BY run_name""")
def run_snapshot(spark: SparkSession, d: str) -> DataFrame:
    _, sim, use = _registry(spark, d)
    s = reports.snapshot(sim.where("run_name = 'N'"), use.where("run_name = 'N'"))
    return rounded(s.select("similarity.run_name", "similarity.ED", "similarity.DTW", F.col("utility")["real_only"]["accuracy"].alias("real_only"), F.col("utility")["real_plus_synthetic"]["weighted_f1"].alias("both_f1")), 4)


@query(f"WITH {REGISTRY} SELECT 'N' AS run_name, round((SELECT max(accuracy) FROM use WHERE run_name = 'N' AND setting = 'synthetic_only'), 4) AS value UNION ALL SELECT 'X', NULL")
def run_keyed_value(spark: SparkSession, d: str) -> DataFrame:
    use = _registry(spark, d)[2].where("setting = 'synthetic_only'")
    one = lambda run: reports.keyed_value(use, "run_name", run, "accuracy").select(F.lit(run).alias("run_name"), "value")
    return rounded(one("N").unionByName(one("X")), 4)


@query("""WITH f AS (SELECT c_nationkey AS k, avg(c_acctbal) AS ed FROM customer WHERE c_nationkey % 2 = 0 GROUP BY ALL), b AS (SELECT n_regionkey AS dataset, avg(s_acctbal) AS ed FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey < 4 GROUP BY ALL)
SELECT n_name AS run_name, n_regionkey AS dataset, round(coalesce(f.ed, n_nationkey), 4) AS "ED", round(b.ed, 4) AS "ED_ref", round(coalesce(f.ed, n_nationkey) / nullif(b.ed, 0), 4) AS "ED_ratio" FROM nation LEFT JOIN f ON f.k = n_nationkey LEFT JOIN b ON b.dataset = n_regionkey""")
def run_refresh(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    nation = t("nation")
    summary = nation.select(F.col("n_name").alias("run_name"), F.col("n_regionkey").alias("dataset"), F.col("n_nationkey").cast("double").alias("ED"))
    fresh = t("customer").where("c_nationkey % 2 = 0").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("run_name")).agg(F.avg("c_acctbal").alias("ED"))
    base = t("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).where("n_regionkey < 4").groupBy(F.col("n_regionkey").alias("dataset")).agg(F.avg("s_acctbal").alias("ED"))
    return rounded(reports.refresh(summary, fresh, base, ["ED"]), 4)


@query("""WITH m AS (SELECT unnest(range(1, 31)) AS run), a AS (SELECT c_nationkey AS run, count(*) AS n, max(CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal END) AS b FROM customer GROUP BY ALL)
SELECT 'r' || m.run AS run_name, CASE WHEN m.run % 10 = 0 THEN 'read_error' WHEN a.n IS NULL THEN 'missing' WHEN a.b IS NULL THEN 'missing_metrics' ELSE 'ok' END AS status, round(a.b, 2) AS "ED" FROM m LEFT JOIN a USING (run)""")
def manifest_states(spark: SparkSession, d: str) -> DataFrame:
    c = spark.read.parquet(f"{d}/customer.parquet")
    rows = c.select(F.concat(F.lit("r"), "c_nationkey").alias("run_name"), F.lit("overall_mean").alias("activity_name"), F.col("c_custkey").alias("row"), F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_acctbal")).alias("ED"))
    manifest = spark.range(1, 31).select(F.concat(F.lit("r"), "id").alias("run_name"))
    return rounded(reports.manifest_states(manifest, rows, manifest.where("run_name in ('r10', 'r20', 'r30')"), ["ED"]), 2)


@query("SELECT n_name, o_orderpriority, count(*) AS orders, sum((l_extendedprice * (1 - l_discount))::DECIMAL(18, 4))::DOUBLE AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY ALL")
def lookup_join_rollup(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    li = t("lineitem").where("l_shipdate >= timestamp_ntz'1995-01-01 00:00:00'")
    j = li.join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name", "o_orderpriority").agg(F.count("*").alias("orders"), F.sum((F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")).cast("double").alias("revenue"))
