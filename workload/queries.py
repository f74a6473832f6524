"""Registered queries: name -> (Spark query, the same query in DuckDB SQL).

Both sides round derived doubles with the same tiny shift, so that a decimal
tie cannot fall differently on the two engines. Instants are compared as epoch
microseconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import confidence as C
from tidemark.operators import dedup, islands
from tidemark.plans import alerts, lists, observations as O, rebuild as R, search as S
from tidemark.plans.relationship import relationship
from tidemark.plans.stats import stats
from tidemark.plans.table import aligned_table
from tidemark.sources import archive, narrative, tables
from tidemark.specs import Column, EpisodeSpec
from workload import standins as d

NY = "America/New_York"
EPISODE = EpisodeSpec(d.VIEW, 7200)
WINDOW = dict(start="2024-01-05T00:00:00Z", end="2024-01-20T12:00:00Z")
QUERIES: dict[str, tuple] = {}


def register(sql: str | None):
    def add(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn
    return add


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """Round the named (or all) double columns."""
    names = names or tuple(n for n, t in df.dtypes if t == "double")
    return df.withColumns({n: F.round(F.col(n) + 3e-10, 6) for n in names})


def micros(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.unix_micros(n) for n in names})


def rnd(expr: str, name: str) -> str:
    return f"round(({expr}) + 3e-10, 6) AS {name}"


# SQL fragments --------------------------------------------------------------

OBS = """obs AS (SELECT user_id AS subject_id, event_id, event_type AS code, ts, value AS v,
    CASE event_type WHEN 'click' THEN 'fitbit' WHEN 'view' THEN 'oura' ELSE 'clinic' END AS source,
    CAST(ts AS DATE) AS day FROM events)"""
IV = OBS + f""", iv AS (SELECT *, CASE WHEN epoch_us(nxt) - epoch_us(ts) < {(d.INTERVAL_CAP + 1) * 1_000_000}
    THEN nxt ELSE ts + INTERVAL {d.INTERVAL_DEFAULT} SECOND END AS te
    FROM (SELECT *, lead(ts) OVER (PARTITION BY subject_id, code ORDER BY ts, event_id) AS nxt FROM obs))"""
EP = IV + """, ep0 AS (SELECT subject_id, event_id, ts, te, max(epoch_us(te)) OVER (PARTITION BY subject_id
    ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv WHERE code = 'view'),
  ep1 AS (SELECT *, sum(CASE WHEN reach IS NULL OR epoch_us(ts) - reach >= 7201000000 THEN 1 ELSE 0 END)
    OVER (PARTITION BY subject_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS grp FROM ep0),
  ep AS (SELECT subject_id, min(ts) AS s, max(te) AS e FROM ep1 GROUP BY subject_id, grp)"""
UTC_KEY = "strftime({}, '%Y-%m-%dT%H:%M:%SZ')"
LOCAL = f"timezone('{NY}', timezone('UTC', {{}}))"
DOW = "['mon','tue','wed','thu','fri','sat','sun'][isodow({})]"
STATS = ", ".join([
    "count(*) AS \"count\"", rnd("avg(x)", "mean"), rnd("stddev_samp(x)", "sd"), rnd("min(x)", '"min"'), rnd("max(x)", '"max"'),
    rnd("quantile_cont(x, 0.25)", "p25"), rnd("quantile_cont(x, 0.5)", "p50"), rnd("quantile_cont(x, 0.75)", "p75")])


def flat_stats(df: DataFrame) -> DataFrame:
    return rounded(df.drop("confidence", "bucket_sort"))


def stats_sql(key: str | None, x: str = "v", source: str = f"WITH {OBS} SELECT * FROM obs WHERE code = 'purchase'") -> str:
    bucket = f"{key} AS bucket_key, " if key else ""
    group = "subject_id" + (f", {key}" if key else "")
    return f"WITH rows AS (SELECT *, {x} AS x FROM ({source})) SELECT subject_id, {bucket}{STATS} FROM rows GROUP BY {group}"


# Reads ----------------------------------------------------------------------


@register(f"WITH {OBS} SELECT subject_id, 'urn:events' AS coding_system, code AS coding_code, count(*) AS \"count\","
          " epoch_us(min(ts)) AS earliest, epoch_us(max(ts)) AS latest FROM obs GROUP BY ALL")
def codings(spark, sf):
    return micros(O.codings(d.observations(spark, sf)), "earliest", "latest")


@register(f"""WITH {OBS}, r AS (SELECT *, row_number() OVER (PARTITION BY subject_id, code
    ORDER BY ts DESC, concat_ws('/', subject_id, code, day) DESC, event_id DESC) AS rn FROM obs)
    SELECT subject_id, code AS coding_code, event_id AS seq, epoch_us(ts) AS effective_start, v AS value_quantity FROM r WHERE rn = 1""")
def latest_by_coding(spark, sf):
    out = O.latest(d.observations(spark, sf))
    return micros(out.select("subject_id", "coding_code", "seq", "effective_start", "value_quantity"), "effective_start")


@register(f"""WITH {OBS} SELECT subject_id, code AS coding_code, event_id AS seq, epoch_us(ts) AS effective_start,
    v AS value_quantity, 'confirmed' AS confidence FROM obs WHERE code IN ('click', 'purchase')
    AND ts >= '2024-01-05' AND ts < '2024-01-20 12:00:00'""")
def history_window(spark, sf):
    out = O.history(d.observations(spark, sf), [d.PURCHASE, d.CLICK, d.PURCHASE], **WINDOW)
    return micros(out.select("subject_id", "coding_code", "seq", "effective_start", "value_quantity", "confidence"), "effective_start")


@register(f"WITH {OBS} SELECT event_id AS seq, epoch_us(ts) AS effective_start FROM obs WHERE concat_ws('/', subject_id, code, day)"
          " = (SELECT min(concat_ws('/', subject_id, code, day)) FROM obs)")
def observations_of_document(spark, sf):
    obs = d.observations(spark, sf)
    first = obs.agg(F.min("archive_key")).scalar()
    return micros(tables.observations_of_document(obs, first).select("seq", "effective_start"), "effective_start")


# Statistics -----------------------------------------------------------------


@register(stats_sql(None))
def stats_none(spark, sf):
    return flat_stats(stats(d.observations(spark, sf), d.PURCHASE))


@register(f"WITH {OBS}, rows AS (SELECT *, v AS x FROM obs WHERE code = 'purchase') SELECT {STATS} FROM rows")
def stats_all_subjects(spark, sf):
    return flat_stats(stats(d.observations(spark, sf), d.PURCHASE, keys=()))


def _stats_bucket(bucket, tz="UTC"):
    return lambda spark, sf: flat_stats(stats(d.observations(spark, sf), d.PURCHASE, bucket=bucket, tz=tz))


QUERIES["stats_day"] = (_stats_bucket("day"), stats_sql("CAST(day AS VARCHAR)"))
QUERIES["stats_day_ny"] = (_stats_bucket("day", NY), stats_sql(f"CAST(CAST({LOCAL.format('ts')} AS DATE) AS VARCHAR)"))
QUERIES["stats_week"] = (_stats_bucket("week"), stats_sql("CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR)"))
QUERIES["stats_month"] = (_stats_bucket("month"), stats_sql("strftime(ts, '%Y-%m')"))
QUERIES["stats_dow_ny"] = (_stats_bucket("day_of_week", NY), stats_sql(DOW.format(LOCAL.format("ts"))))
QUERIES["stats_hour"] = (_stats_bucket("hour"), stats_sql("strftime(ts, '%Y-%m-%dT%H:00:00Z')"))
QUERIES["stats_hour_ny"] = (_stats_bucket("hour", NY), stats_sql(f"strftime({LOCAL.format('ts')}, '%Y-%m-%dT%H:00:00-05:00')"))
QUERIES["stats_hour_kolkata"] = (
    _stats_bucket("hour", "Asia/Kolkata"),
    stats_sql("strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%dT%H:00:00+05:30')"))

NOON = "((epoch_us(date_trunc('second', {0})) // 1000000) % 86400) / 60.0 - 720.0"


def noon_sql(ts: str) -> str:
    minutes = NOON.format(LOCAL.format(ts))
    return f"CASE WHEN {minutes} < 0 THEN {minutes} + 1440.0 ELSE {minutes} END"


@register(stats_sql(None, noon_sql("ts")))
def stats_time_of_day_ny(spark, sf):
    return flat_stats(stats(d.observations(spark, sf), d.PURCHASE, field="start_time_of_day", tz=NY))


@register(stats_sql(f"CAST(CAST({LOCAL.format('ts')} AS DATE) AS VARCHAR)", noon_sql("te"), f"WITH {IV} SELECT * FROM iv WHERE code = 'purchase'"))
def stats_end_time_of_day(spark, sf):
    return flat_stats(stats(d.intervals(spark, sf), d.PURCHASE, field="end_time_of_day", tz=NY, bucket="day"))


@register(stats_sql("strftime(ts, '%Y-%m')", "(epoch_us(date_trunc('second', te)) - epoch_us(date_trunc('second', ts))) / 1000000 / 60.0",
                    f"WITH {IV} SELECT * FROM iv WHERE code = 'purchase'"))
def stats_interval_minutes(spark, sf):
    return flat_stats(stats(d.intervals(spark, sf), d.PURCHASE, field="interval_minutes", bucket="month"))


@register(f"""WITH {OBS} SELECT subject_id, CAST(day AS VARCHAR) AS bucket_key, count(*) AS "count",
    count(*) FILTER (v < 20) AS below_20, count(*) FILTER (v >= 20) AS at_or_above_20,
    count(*) FILTER (v < 100) AS below_100, count(*) FILTER (v >= 100) AS at_or_above_100
    FROM obs WHERE code = 'click' GROUP BY ALL""")
def stats_thresholds(spark, sf):
    out = stats(d.observations(spark, sf), d.CLICK, bucket="day", thresholds=[20, 100])
    t = F.col("thresholds")
    return out.select(
        "subject_id", "bucket_key", "count", t[0]["n_below"].alias("below_20"), t[0]["n_at_or_above"].alias("at_or_above_20"),
        t[1]["n_below"].alias("below_100"), t[1]["n_at_or_above"].alias("at_or_above_100"))


@register(f"WITH {EP}, rows AS (SELECT o.subject_id, {UTC_KEY.format('ep.s')} AS bucket_key, o.v AS x FROM obs o"
          " JOIN ep ON o.subject_id = ep.subject_id AND o.ts >= ep.s AND o.ts <= ep.e WHERE o.code = 'purchase')"
          f" SELECT subject_id, bucket_key, {STATS} FROM rows GROUP BY ALL")
def stats_episode(spark, sf):
    return flat_stats(stats(d.intervals(spark, sf), d.PURCHASE, bucket="episode", episode=EPISODE))


# Islands --------------------------------------------------------------------


@register(f"WITH {IV} SELECT event_id AS seq, epoch_us(ts) AS effective_start, epoch_us(te) AS effective_end FROM iv")
def next_sample_intervals(spark, sf):
    return micros(d.intervals(spark, sf).select("seq", "effective_start", "effective_end"), "effective_start", "effective_end")


@register(f"WITH {EP} SELECT subject_id, epoch_us(s) AS episode_start, epoch_us(e) AS episode_end FROM ep")
def episodes(spark, sf):
    rows = O.select_codings(d.intervals(spark, sf), [d.VIEW])
    return micros(islands.detect_episodes(rows, 7200), "episode_start", "episode_end")


RUNS = IV + """, rn0 AS (SELECT subject_id, event_id, ts, te, lag(te) OVER (PARTITION BY subject_id ORDER BY ts, event_id) AS reach
    FROM iv WHERE code = 'view' AND v BETWEEN 5 AND 60),
  rn1 AS (SELECT *, sum(CASE WHEN reach IS NULL OR epoch_us(ts) - epoch_us(reach) >= 3601000000 THEN 1 ELSE 0 END)
    OVER (PARTITION BY subject_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS grp FROM rn0),
  rn AS (SELECT subject_id, min(ts) AS s, last(te ORDER BY ts, event_id) AS e FROM rn1 GROUP BY subject_id, grp)"""
RUN_MINUTES = "(epoch_us(e) - epoch_us(s)) / 60000000.0"


@register(f"WITH {RUNS} SELECT subject_id, epoch_us(s) AS run_start, epoch_us(e) AS run_end, {rnd(RUN_MINUTES, 'minutes')} FROM rn")
def runs_in_range(spark, sf):
    rows = O.select_codings(d.intervals(spark, sf), [d.VIEW]).where(F.col("value_quantity").between(5, 60))
    return rounded(micros(islands.runs(rows, 3600), "run_start", "run_end"))


# Aligned tables -------------------------------------------------------------


def flat_table(df: DataFrame) -> DataFrame:
    return rounded(df.drop("confidence", "bucket_sort", "bucket_offset"))


@register(f"""WITH {OBS} SELECT subject_id, CAST(CAST({LOCAL.format('ts')} AS DATE) AS VARCHAR) AS bucket_key,
    {rnd("avg(v) FILTER (code = 'click')", 'clicks')}, {rnd("avg(v) FILTER (code = 'view')", 'views')},
    {rnd("avg(v) FILTER (code = 'purchase')", 'purchases')}
    FROM obs WHERE code IN ('click', 'view', 'purchase') GROUP BY ALL""")
def table_day_mean_multi(spark, sf):
    cols = [Column(d.CLICK, name="clicks"), Column(d.VIEW, name="views"), Column(d.PURCHASE, name="purchases")]
    return flat_table(aligned_table(d.observations(spark, sf), cols, tz=NY))


ALL_AGGS = ("mean", "sum", "min", "max", "count", "median")


def _all_aggs(code: str) -> str:
    v = f"FILTER (code = '{code}')"
    return ", ".join(rnd(e, f"{code}_{n}") for n, e in {
        "mean": f"avg(v) {v}", "sum": f"sum(v) {v}", "min": f"min(v) {v}", "max": f"max(v) {v}",
        "count": f"CASE WHEN count(*) {v} > 0 THEN CAST(count(v) {v} AS DOUBLE) END", "median": f"quantile_cont(v, 0.5) {v}"}.items())


@register(f"WITH {OBS} SELECT subject_id, strftime(ts, '%Y-%m') AS bucket_key, {_all_aggs('error')}, {_all_aggs('signup')}"
          " FROM obs WHERE code IN ('error', 'signup') GROUP BY ALL")
def table_month_all_aggs(spark, sf):
    cols = [Column(c, a, name=f"{c.code}_{a}") for c in (d.ERROR, d.SIGNUP) for a in ALL_AGGS]
    return flat_table(aligned_table(d.observations(spark, sf), cols, bucket="month"))


@register(f"WITH {OBS} SELECT CAST(NULL AS VARCHAR) AS bucket_key, {_all_aggs('error')}, {_all_aggs('signup')} FROM obs")
def table_none(spark, sf):
    cols = [Column(c, a, name=f"{c.code}_{a}") for c in (d.ERROR, d.SIGNUP) for a in ALL_AGGS]
    return flat_table(aligned_table(d.observations(spark, sf), cols, bucket="none", keys=()))


IN_RANGE_MINUTES = """CASE WHEN count(*) FILTER (code = '{0}') > 0 THEN coalesce(sum(epoch_us(date_trunc('second', te))
    - epoch_us(date_trunc('second', ts))) FILTER (code = '{0}' AND v BETWEEN {1} AND {2}), 0) / 60000000.0 END"""


@register(f"WITH {IV} SELECT subject_id, strftime({LOCAL.format('ts')}, '%Y-%m-%dT%H:00:00-05:00') AS bucket_key,"
          f" {rnd(IN_RANGE_MINUTES.format('view', 5, 60), 'low')}, {rnd(IN_RANGE_MINUTES.format('click', 60, 500), 'high')}"
          " FROM iv WHERE code IN ('view', 'click') GROUP BY ALL")
def table_duration_in_range(spark, sf):
    cols = [Column(d.VIEW, "duration_in_range", value_min=5, value_max=60, name="low"),
            Column(d.CLICK, "duration_in_range", value_min=60, value_max=500, name="high")]
    return flat_table(aligned_table(d.intervals(spark, sf), cols, bucket="hour", tz=NY))


@register(f"""WITH {RUNS}, longest AS (SELECT subject_id, CAST(CAST(s AS DATE) AS VARCHAR) AS bucket_key, max({RUN_MINUTES}) AS m
      FROM rn GROUP BY ALL),
    days AS (SELECT subject_id, CAST(day AS VARCHAR) AS bucket_key, count(*) FILTER (code = 'view') AS n,
      avg(v) FILTER (code = 'click') AS clicks FROM iv WHERE code IN ('view', 'click') GROUP BY ALL)
    SELECT subject_id, bucket_key, {rnd('CASE WHEN n > 0 THEN greatest(coalesce(m, 0.0), 0.0) END', 'longest')}, {rnd('clicks', 'clicks')}
    FROM days LEFT JOIN longest USING (subject_id, bucket_key)""")
def table_longest_run(spark, sf):
    cols = [Column(d.VIEW, "longest_run_in_range", value_min=5, value_max=60, gap_seconds=3600, name="longest"),
            Column(d.CLICK, name="clicks")]
    return flat_table(aligned_table(d.intervals(spark, sf), cols))


@register(f"""WITH {EP}, placed AS (SELECT o.*, ep.s FROM iv o JOIN ep ON o.subject_id = ep.subject_id AND o.ts >= ep.s AND o.ts <= ep.e
      WHERE o.code IN ('click', 'purchase', 'view')),
    vals AS (SELECT subject_id, s, avg(v) FILTER (code = 'click') AS clicks, quantile_cont(v, 0.5) FILTER (code = 'purchase') AS purchases,
      {IN_RANGE_MINUTES.format('view', 5, 60)} AS low FROM placed GROUP BY ALL)
    SELECT ep.subject_id, {UTC_KEY.format('ep.s')} AS bucket_key, {rnd('clicks', 'clicks')}, {rnd('purchases', 'purchases')}, {rnd('low', 'low')}
    FROM ep LEFT JOIN vals ON ep.subject_id = vals.subject_id AND ep.s = vals.s""")
def table_episode(spark, sf):
    cols = [Column(d.CLICK, name="clicks"), Column(d.PURCHASE, "median", name="purchases"),
            Column(d.VIEW, "duration_in_range", value_min=5, value_max=60, name="low")]
    return flat_table(aligned_table(d.intervals(spark, sf), cols, bucket="episode", episode=EPISODE))


# Confidence -----------------------------------------------------------------

NOW_SQL = "TIMESTAMP '2024-01-25 12:00:00'"
DAY_STATE = OBS + """, pulled AS (SELECT subject_id, source, code, day, count(*) FILTER (hour(ts) < 12) AS morning, count(*) AS total FROM obs GROUP BY ALL),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY subject_id, source, day ORDER BY pulled_at DESC, doc DESC) AS rn FROM (
    SELECT subject_id, source, day, day + INTERVAL 12 HOUR AS pulled_at, morning AS n, concat_ws('#', concat_ws('/', subject_id, code, day), 'first') AS doc FROM pulled
    UNION ALL SELECT subject_id, source, day, day + INTERVAL 30 HOUR, total, concat_ws('#', concat_ws('/', subject_id, code, day), 'second') FROM pulled)),
  state AS (SELECT subject_id, source, day, max(n) FILTER (rn = 1) AS n, CASE WHEN source = 'fitbit' THEN max(n) FILTER (rn = 2) END AS prev,
    max(pulled_at) FILTER (rn = 1) AS pulled_at FROM ranked GROUP BY subject_id, source, day)"""
CONFIDENCE = DAY_STATE + f""", frontier AS (SELECT subject_id, source, max(ts) AS f FROM obs GROUP BY ALL),
  conf AS (SELECT o.subject_id, o.source, o.day, CASE WHEN o.source = 'oura' THEN {NOW_SQL} < o.day + INTERVAL 48 HOUR
      ELSE date_diff('day', o.day, CAST({NOW_SQL} AS DATE)) < 5 OR f < o.day + INTERVAL 36 HOUR
        OR prev IS NULL OR prev <> n END AS is_provisional
    FROM (SELECT DISTINCT subject_id, source, day FROM obs WHERE source <> 'clinic') o
    LEFT JOIN state USING (subject_id, source, day) LEFT JOIN frontier USING (subject_id, source))"""


def _provisional(spark, sf):
    docs = d.documents_of_days(spark, sf)
    days = C.day_confidence(docs, d.source_state(spark, sf), d.day_state(spark, sf), d.NOW)
    return C.provisional_documents(docs, days)


@register(f"WITH {DAY_STATE} SELECT subject_id, source AS source_name, CAST(day AS VARCHAR) AS date, n AS samples_count,"
          " prev AS samples_count_prev, epoch_us(pulled_at) AS last_pulled_at FROM state")
def day_states(spark, sf):
    out = micros(d.day_state(spark, sf), "last_pulled_at")
    return out.withColumn("date", F.col("date").cast("string"))


@register(f"WITH {CONFIDENCE} SELECT subject_id, source, CAST(day AS VARCHAR) AS document_date, is_provisional FROM conf")
def day_confidence(spark, sf):
    out = C.day_confidence(d.documents_of_days(spark, sf), d.source_state(spark, sf), d.day_state(spark, sf), d.NOW)
    return out.withColumn("document_date", F.col("document_date").cast("string"))


@register(f"""WITH {CONFIDENCE} SELECT subject_id, strftime(ts, '%Y-%m-%d') AS bucket_key, {rnd("avg(v) FILTER (code = 'click')", 'clicks')},
    {rnd("avg(v) FILTER (code = 'view')", 'views')}, CASE WHEN bool_or(coalesce(is_provisional, false)) THEN 'provisional' ELSE 'confirmed' END AS confidence
    FROM obs LEFT JOIN conf USING (subject_id, source, day) WHERE code IN ('click', 'view') GROUP BY ALL""")
def table_confidence(spark, sf):
    cols = [Column(d.CLICK, name="clicks"), Column(d.VIEW, name="views")]
    out = aligned_table(d.observations(spark, sf), cols, confidence=_provisional(spark, sf))
    return rounded(out.drop("bucket_sort"))


@register(f"""WITH {CONFIDENCE} SELECT subject_id, strftime(ts, '%Y-%m') AS bucket_key, count(*) AS "count",
    CASE WHEN bool_or(coalesce(is_provisional, false)) THEN 'provisional' ELSE 'confirmed' END AS confidence
    FROM obs LEFT JOIN conf USING (subject_id, source, day) WHERE code = 'click' GROUP BY ALL""")
def stats_confidence(spark, sf):
    out = stats(d.observations(spark, sf), d.CLICK, bucket="month", confidence=_provisional(spark, sf))
    return out.select("subject_id", "bucket_key", "count", "confidence")


@register(f"""WITH {CONFIDENCE}, wanted AS (SELECT s.subject_id, s.source, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day
      FROM (SELECT subject_id, source, min(day) AS lo, max(day) AS hi FROM obs WHERE source <> 'clinic' GROUP BY ALL) s)
    SELECT subject_id, source, CAST(day AS VARCHAR) AS date FROM wanted w
    WHERE NOT EXISTS (FROM conf c WHERE c.subject_id = w.subject_id AND c.source = w.source AND c.day = w.day AND NOT is_provisional)""")
def days_to_fetch(spark, sf):
    docs = d.documents_of_days(spark, sf)
    days = C.day_confidence(docs, d.source_state(spark, sf), d.day_state(spark, sf), d.NOW).withColumnRenamed("document_date", "date")
    asked = docs.where("source <> 'clinic'").groupBy("subject_id", "source").agg(
        F.min("document_date").alias("start_date"), F.max("document_date").alias("end_date"))
    out = C.days_to_fetch(asked, days, days.where("not is_provisional"))
    return out.withColumn("date", F.col("date").cast("string"))


# Relationships --------------------------------------------------------------


def pair_stats(pairs: str, groups: str = "") -> str:
    """Summary of a CTE ``pairs(subject_id, x, y)``; null where there is no pair."""
    corr = lambda x, y: (f"CASE WHEN min({x}) < max({x}) AND min({y}) < max({y}) THEN covar_pop({x}, {y})"
                         f" / sqrt(var_pop({x}) * var_pop({y})) END")
    return f"""WITH {pairs}, p AS (SELECT subject_id, CASE WHEN y IS NOT NULL THEN x END AS x, CASE WHEN x IS NOT NULL THEN y END AS y FROM pairs),
      ranked AS (SELECT *, CASE WHEN x IS NOT NULL THEN rank() OVER (PARTITION BY subject_id ORDER BY x NULLS LAST)
          + (count(x) OVER (PARTITION BY subject_id, x) - 1) / 2.0 END AS rx,
        CASE WHEN x IS NOT NULL THEN rank() OVER (PARTITION BY subject_id ORDER BY y NULLS LAST)
          + (count(y) OVER (PARTITION BY subject_id, y) - 1) / 2.0 END AS ry FROM p)
      SELECT subject_id, count(x) AS n_pairs, {rnd(corr('x', 'y'), 'pearson_r')}, {rnd(corr('rx', 'ry'), 'spearman_r')},
        {rnd('avg(x)', 'x_mean')}, {rnd('stddev_samp(x)', 'x_sd')}, {rnd('avg(y)', 'y_mean')}, {rnd('stddev_samp(y)', 'y_sd')}{groups}
      FROM ranked GROUP BY subject_id"""


def bucket_values(key: str) -> str:
    return f"""{OBS}, b AS (SELECT subject_id, {key} AS k, avg(v) FILTER (code = 'click') AS x, avg(v) FILTER (code = 'view') AS y
      FROM obs WHERE code IN ('click', 'view') GROUP BY ALL)"""


def lag_pairs(key: str, moved: str) -> str:
    return bucket_values(key) + f""", pairs AS (SELECT a.subject_id, a.x, c.y FROM b a LEFT JOIN b c
      ON a.subject_id = c.subject_id AND c.k = {moved})"""


def _related(**kw):
    return lambda spark, sf: rounded(relationship(d.observations(spark, sf), Column(d.CLICK), Column(d.VIEW), **kw))


def _side(name: str, test: str) -> str:
    y = f"FILTER (x {test})"
    return (f", count(y) {y} AS {name}_count, " + ", ".join(rnd(f"{e} {y}", f"{name}_{n}") for n, e in {
        "mean": "avg(y)", "sd": "stddev_samp(y)", "min": "min(y)", "max": "max(y)", "p50": "quantile_cont(y, 0.5)"}.items()))


QUERIES["relationship_day"] = (_related(), pair_stats(bucket_values("day") + ", pairs AS (SELECT subject_id, x, y FROM b)"))
QUERIES["relationship_day_lag"] = (_related(lag=1), pair_stats(lag_pairs("day", "a.k + 1")))
QUERIES["relationship_week_lag"] = (
    _related(bucket="week", lag=-1), pair_stats(lag_pairs("CAST(date_trunc('week', ts) AS DATE)", "a.k - 7")))
QUERIES["relationship_month"] = (
    _related(bucket="month", lag=0), pair_stats(bucket_values("date_trunc('month', ts)") + ", pairs AS (SELECT subject_id, x, y FROM b)"))
QUERIES["relationship_hour_lag_ny"] = (
    _related(bucket="hour", tz=NY, lag=3), pair_stats(lag_pairs("date_trunc('hour', ts)", "a.k + INTERVAL 3 HOUR")))
QUERIES["relationship_threshold"] = (
    _related(threshold=25.0),
    pair_stats(bucket_values("day") + ", pairs AS (SELECT subject_id, x, y FROM b)",
               _side("x_below", "< 25.0") + _side("x_at_or_above", ">= 25.0")))


@register(pair_stats(EP + """, b AS (SELECT ep.subject_id, row_number() OVER (PARTITION BY ep.subject_id ORDER BY ep.s) AS k, w.x, w.y FROM ep LEFT JOIN
    (SELECT o.subject_id, ep.s, avg(o.v) FILTER (o.code = 'click') AS x, avg(o.v) FILTER (o.code = 'purchase') AS y FROM iv o
      JOIN ep ON o.subject_id = ep.subject_id AND o.ts >= ep.s AND o.ts <= ep.e WHERE o.code IN ('click', 'purchase') GROUP BY ALL) w
    ON ep.subject_id = w.subject_id AND ep.s = w.s),
  pairs AS (SELECT a.subject_id, a.x, c.y FROM b a LEFT JOIN b c ON a.subject_id = c.subject_id AND c.k = a.k + 1)"""))
def relationship_episode_lag(spark, sf):
    return rounded(relationship(
        d.intervals(spark, sf), Column(d.CLICK), Column(d.PURCHASE), bucket="episode", episode=EPISODE, lag=1))


# Lists ----------------------------------------------------------------------

ITEMS = """items AS (SELECT o_custkey AS subject_id, l_orderkey, p_brand, p_name, l_linestatus, l_returnflag, p_type,
    CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS ship, concat_ws(' ', CAST(l_quantity AS INT), 'mg') AS dose, CAST(o_orderdate AS DATE) AS dd,
    row_number() OVER (PARTITION BY o_custkey, p_brand ORDER BY o_orderdate DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC,
      l_suppkey DESC, l_quantity DESC, l_extendedprice DESC) AS rn
    FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey),
  newest AS (SELECT o_custkey AS subject_id, CAST(max(CAST(o_orderdate AS DATE)) AS VARCHAR) AS latest_document_date FROM orders GROUP BY ALL),
  seen AS (SELECT subject_id, p_brand, count(DISTINCT l_orderkey) AS document_count, CAST(min(dd) AS VARCHAR) AS first_seen,
    CAST(max(dd) AS VARCHAR) AS last_seen, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS section_labels FROM items GROUP BY ALL)"""


def _dates_as_text(df: DataFrame) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("string") for n, t in df.dtypes if t == "date"})


@register(f"""WITH {ITEMS} SELECT subject_id, 'urn:brand' AS coding_system, p_brand AS coding_code, p_name AS coding_display, l_linestatus AS status,
    ship AS onset_date, document_count, first_seen, last_seen, section_labels, latest_document_date
    FROM items JOIN seen USING (subject_id, p_brand) JOIN newest USING (subject_id) WHERE rn = 1""")
def current_problems(spark, sf):
    out = lists.current_problems(d.order_items(spark, sf), d.order_documents(spark, sf))
    return _dates_as_text(out.withColumn("section_labels", F.array_join("section_labels", ",")))


@register(f"""WITH {ITEMS} SELECT subject_id, 'urn:brand' AS coding_system, p_brand AS coding_code, p_name AS coding_display, l_linestatus AS status,
    dose, p_type AS route, ship AS start_date, CAST(NULL AS VARCHAR) AS end_date, document_count, first_seen, last_seen, latest_document_date
    FROM items JOIN seen USING (subject_id, p_brand) JOIN newest USING (subject_id) WHERE rn = 1""")
def current_medications(spark, sf):
    return _dates_as_text(lists.current_medications(d.order_items(spark, sf), d.order_documents(spark, sf)))


# Supersession and state -----------------------------------------------------


@register(f"""WITH {DAY_STATE}, keyed AS (SELECT subject_id, source, day, pulled_at, doc FROM ranked WHERE source <> 'fitbit' OR rn = 1)
    SELECT subject_id, doc AS archive_key, source, CAST(day AS VARCHAR) AS document_date, epoch_us(pulled_at) AS archived_at FROM keyed""")
def supersede_newest(spark, sf):
    out = dedup.supersede(d.pulls(spark, sf)).drop("samples_count")
    return _dates_as_text(micros(out, "archived_at"))


@register(f"""WITH {OBS}, st AS (SELECT subject_id, source, count(*) AS n, max(ts) AS f FROM obs GROUP BY ALL),
    nw AS (SELECT subject_id, source, count(*) FILTER (day >= '2024-01-20') AS n FROM obs WHERE code IN ('click', 'view') GROUP BY ALL)
    SELECT st.subject_id, st.source AS source_name, coalesce(nw.n, st.n) AS consecutive_sync_failures, epoch_us(f) AS freshness_frontier_at
    FROM st LEFT JOIN nw USING (subject_id, source)""")
def state_merge(spark, sf):
    """A status-only upsert keeps the frontier of the stored row."""
    obs = d.observations(spark, sf).withColumn("source_name", d.source_of(F.col("coding_code")))
    stored = obs.groupBy("subject_id", "source_name").agg(
        F.count("*").alias("consecutive_sync_failures"), F.max("effective_start").alias("freshness_frontier_at"))
    fresh = obs.where("coding_code in ('click', 'view')").groupBy("subject_id", "source_name").agg(
        F.count_if(F.to_date("effective_start") >= "2024-01-20").alias("consecutive_sync_failures"))
    out = dedup.merge_columns(stored, fresh, ["subject_id", "source_name"], ["consecutive_sync_failures"])
    return micros(out, "freshness_frontier_at")


CONDITIONS = OBS + f""", src AS (SELECT subject_id, source, max(ts) AS f, count(*) FILTER (code = 'error' AND v > 150) AS fails,
      coalesce(max(v) > 300, false) AS auth FROM obs GROUP BY ALL),
  cond AS (SELECT subject_id, concat('auth_expired:', source) AS condition_id, auth AS is_firing, 'critical' AS sev FROM src
    UNION ALL SELECT subject_id, concat('sync_failures:', source), fails >= 3, 'warning' FROM src
    UNION ALL SELECT subject_id, concat('frontier_stuck:', source), NOT auth AND fails = 0
      AND epoch_us({NOW_SQL}) - epoch_us(f) >= 48 * 3600000000, 'warning' FROM src)"""
PRIOR = """prior AS (SELECT subject_id, condition_id, CASE WHEN subject_id % 3 = 0 THEN 'resolved' ELSE 'firing' END AS st,
    CASE WHEN subject_id % 2 = 0 THEN TIMESTAMP '2024-01-24 12:00:00' ELSE TIMESTAMP '2024-01-25 00:00:00' END AS fired FROM cond WHERE subject_id % 5 <> 0)"""


@register(f"WITH {CONDITIONS} SELECT subject_id, condition_id, is_firing, CASE WHEN is_firing THEN sev END AS severity FROM cond")
def source_conditions(spark, sf):
    out = alerts.conditions(d.source_state(spark, sf), d.NOW)
    return out.select("subject_id", "condition_id", "is_firing", "severity")


def _dispatched(spark, sf):
    evaluated = alerts.conditions(d.source_state(spark, sf), d.NOW)
    who = F.col("subject_id")
    prior = evaluated.where(who % 5 != 0).select(
        who, "condition_id",
        F.when(who % 2 == 0, "2024-01-24T12:00:00Z").otherwise("2024-01-25T00:00:00Z").cast("timestamp").alias("last_fired_at"),
        F.when(who % 3 == 0, "resolved").otherwise("firing").alias("last_state"))
    return alerts.dispatch(evaluated, prior, d.NOW)


ACTION = f"""CASE WHEN is_firing THEN CASE WHEN st = 'firing' AND epoch_us({NOW_SQL}) - epoch_us(fired) < 24 * 3600000000
    THEN 'suppress' ELSE 'fire' END WHEN st = 'firing' THEN 'resolve' ELSE 'none' END"""


@register(f"""WITH {CONDITIONS}, {PRIOR}, done AS (SELECT c.*, st, fired, {ACTION} AS action FROM cond c LEFT JOIN prior p USING (subject_id, condition_id))
    SELECT subject_id, condition_id, action, epoch_us(CASE action WHEN 'fire' THEN {NOW_SQL} WHEN 'resolve' THEN NULL ELSE fired END) AS last_fired_at,
    CASE action WHEN 'fire' THEN 'firing' WHEN 'resolve' THEN 'resolved' ELSE st END AS last_state FROM done""")
def notification_dispatch(spark, sf):
    out = _dispatched(spark, sf).select("subject_id", "condition_id", "action", "last_fired_at", "last_state")
    return micros(out, "last_fired_at")


@register(f"""WITH {OBS} SELECT subject_id, concat_ws('-', 'c', event_id) AS condition_id, epoch_us(ts) AS fired_at FROM obs
    WHERE code = 'error' ORDER BY ts DESC, condition_id DESC LIMIT 20""")
def notification_list(spark, sf):
    log = O.select_codings(d.observations(spark, sf), [d.ERROR]).select(
        "subject_id", F.concat_ws("-", F.lit("c"), "seq").alias("condition_id"), F.col("effective_start").alias("fired_at"))
    return micros(alerts.notifications(log), "fired_at")


# Narratives -----------------------------------------------------------------

TOKENS = r"""tok AS (SELECT doc_id, regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}\p{Co}]+') AS t FROM documents),
  corpus AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM tok)"""


def score_sql(units: dict[str, str], where: str) -> str:
    """BM25 over parts given as SQL counts on the token list ``t``."""
    part = ("CASE WHEN u{0} > 0 THEN greatest(ln((n - d{0} + 0.5) / (d{0} + 0.5)), 1e-6) * u{0} * 2.2"
            " / (u{0} + 1.2 * (0.25 + 0.75 * len / mean)) ELSE 0 END")
    counts = ", ".join(f"{sql} AS u{i}" for i, sql in units.items())
    holding = ", ".join(f"count(*) FILTER (u{i} > 0) AS d{i}" for i in units)
    total = " + ".join(part.format(i) for i in units)
    return f"""WITH {TOKENS}, hit AS (SELECT doc_id, t, len(t) AS len, {counts} FROM tok), df AS (SELECT {holding} FROM hit)
      SELECT doc_id, {rnd(f'-({total})', 'score')} FROM hit, df, corpus WHERE {where} ORDER BY -({total}), doc_id LIMIT 50"""


def count_of(term: str) -> str:
    return f"len(list_filter(t, lambda x: x = '{term}'))"


def _hits(spark, sf, query):
    out = S.search(d.texts(spark, sf), query, doc="doc_id", limit=50)
    return rounded(out.select("doc_id", "score"))


@register(score_sql({0: count_of("the"), 1: count_of("and"), 2: count_of("la"), 3: count_of("un")}, "u0 > 0 AND (u1 > 0 OR u2 > 0 OR u3 > 0)"))
def search_terms(spark, sf):
    return _hits(spark, sf, S.Query(all_terms=["The"], any_terms=["and", "la", "un"]))


@register(score_sql({0: "len(list_filter(range(1, len(t)), lambda i: t[i] = 'of' AND t[i + 1] = 'the'))",
                     1: "len(list_filter(t, lambda x: starts_with(x, 'ent')))"},
                    "u0 > 0 AND u1 > 0 AND NOT list_contains(t, 'whou')"))
def search_phrase_prefix_not(spark, sf):
    return _hits(spark, sf, S.Query(phrases=["of the"], prefixes=["ent"], none_terms=["whou"]))


@register(score_sql({0: count_of("der"), 1: count_of("the"), 2: "len(list_filter(range(1, len(t)), lambda i: t[i] = 'in' AND t[i + 1] = 'the'))"},
                    "u0 > 0 OR u1 > 0 OR u2 > 0"))
def search_stored_postings(spark, sf):
    """The same ranking from an index table instead of a scan of the texts."""
    texts = d.texts(spark, sf)
    query = S.Query(any_terms=["der", "the", "in the"])
    out = S.search(texts, query, postings=S.build_postings(texts, "doc_id"), doc="doc_id", limit=50)
    return rounded(out.select("doc_id", "score"))


@register(rf"""WITH {TOKENS} SELECT doc_id, len(t) AS doc_length, term, count(*) AS tf, min(pos) AS first_position
    FROM (SELECT doc_id, t, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM tok) GROUP BY ALL""")
def postings(spark, sf):
    out = S.build_postings(d.texts(spark, sf), "doc_id")
    return out.select(
        "doc_id", F.col("doc_length").cast("bigint").alias("doc_length"), "term", F.col("tf").cast("bigint").alias("tf"),
        F.col("positions")[0].cast("bigint").alias("first_position"))


@register("""WITH m AS (SELECT doc_id, lang, source, text, CASE WHEN doc_id % 7 <> 0 THEN CAST(DATE '2024-01-01' + CAST(doc_id % 365 AS INT) AS DATE) END AS dd FROM documents)
    SELECT doc_id, lang AS kind, source, CAST(dd AS VARCHAR) AS document_date, substring(text, 1, 200) AS snippet
    FROM m ORDER BY dd DESC NULLS LAST, doc_id DESC LIMIT 20""")
def narrative_catalog(spark, sf):
    return _dates_as_text(S.catalog(d.texts(spark, sf), d.text_documents(spark, sf), doc="doc_id"))


SPACE = r"trim(regexp_replace({}, '[\s\x0b\x{{85}}\p{{Z}}]+', ' ', 'g'))"
CLAIMS = f"""c AS (SELECT doc_id, text, substring(text, CAST(floor(length(text) / 2) AS INT) + 1, 60) AS mid FROM documents),
  cl AS (SELECT doc_id, {SPACE.format('text')} AS t, CASE WHEN doc_id % 5 = 0 THEN 'Q0' ELSE substring({SPACE.format('mid')}, 1, 4) END AS code,
    {SPACE.format("CASE WHEN doc_id % 3 = 0 THEN concat(mid, ' zq') ELSE mid END")} AS q FROM c)"""


@register(f"""WITH {CLAIMS}, r AS (SELECT *, CASE WHEN {SPACE.format('code')} = '' THEN 'empty code' WHEN q = '' THEN 'empty quote'
    WHEN NOT contains(t, q) THEN 'quote not in text' WHEN NOT contains(q, code) THEN 'code not in quote' END AS reject_reason FROM cl)
    SELECT doc_id, code, reject_reason, reject_reason IS NULL AS verified FROM r""")
def verify_claims(spark, sf):
    out = narrative.verify_claims(d.claims(spark, sf), d.texts(spark, sf), "doc_id")
    return out.select("doc_id", "code", "reject_reason", "verified")


@register("SELECT sha256(text) AS archive_key, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY ALL")
def dedup_content(spark, sf):
    return archive.copy_groups(d.texts(spark, sf), "text", "doc_id")


@register("""SELECT min(doc_id) AS doc_id, sha256(text) AS archive_key FROM documents WHERE sha256(text) NOT IN
    (SELECT sha256(text) FROM documents JOIN labels USING (doc_id)) GROUP BY sha256(text)""")
def new_blobs(spark, sf):
    docs = d.table(spark, sf, "documents").withColumn("content", F.col("text").cast("binary")).withColumn("subject_id", F.lit("all"))
    stored = docs.join(d.table(spark, sf, "labels"), "doc_id").select("subject_id", F.sha2("content", 256).alias("archive_key")).distinct()
    return archive.new_blobs(docs, stored, "doc_id").select("doc_id", "archive_key")


# Ingest ---------------------------------------------------------------------


@register("""WITH w AS (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS rn FROM events)
    SELECT CAST(user_id AS VARCHAR) AS subject_id, '8867-4' AS coding_code, CAST(s AS BIGINT) AS seq, epoch_us(ts) + s * 30000000 AS effective_start,
      epoch_us(ts) + 30000000 + s * 60000000 AS effective_end, floor(value) + s AS value_quantity FROM w, (VALUES (0), (1)) AS k(s) WHERE rn = 1""")
def ingest_heart_rate(spark, sf):
    """Each user's newest payload of a day wins; its samples become intervals."""
    out = R.rebuild(d.heart_rate_blobs(spark, sf))["observations"]
    return micros(out.select(
        "subject_id", "coding_code", "seq", "effective_start", "effective_end", "value_quantity"), "effective_start", "effective_end")


PHASES = """ph AS (SELECT *, translate(concat(event_id, CAST(floor(value * 100) AS BIGINT)), '0123456789', '4121314234') AS p,
    event_type <> 'signup' AS night FROM events)"""


@register(f"""WITH {PHASES}, e AS (SELECT user_id, ts, p, unnest(range(0, length(p))) AS i FROM ph)
    SELECT CAST(user_id AS VARCHAR) AS subject_id, CAST(i AS BIGINT) AS seq, epoch_us(ts) + i * 300000000 AS effective_start,
    epoch_us(ts) + (i + 1) * 300000000 AS effective_end,
    CAST(CASE p[i + 1] WHEN '1' THEN 3 WHEN '2' THEN 2 WHEN '3' THEN 4 ELSE 0 END AS DOUBLE) AS value_quantity,
    CASE p[i + 1] WHEN '1' THEN 'n3' WHEN '2' THEN 'n2' WHEN '3' THEN 'rem' ELSE 'wake' END AS value_string,
    CASE p[i + 1] WHEN '1' THEN 'deep / slow-wave sleep (N3)' WHEN '2' THEN 'light sleep (N2)' WHEN '3' THEN 'REM' ELSE 'awake' END AS value_label FROM e""")
def sleep_epochs(spark, sf):
    out = R.rebuild(d.sleep_blobs(spark, sf))["observations"].where("coding_code = 'aasm-sleep-stage'")
    out = O.with_labels(out).select(
        "subject_id", "seq", "effective_start", "effective_end", "value_quantity", "value_string", "value_label")
    return micros(out, "effective_start", "effective_end")


@register(f"""WITH {PHASES}, s AS (SELECT *, regexp_replace(p, '^4+|4+$', '', 'g') AS span FROM ph WHERE night)
    SELECT CAST(user_id AS VARCHAR) AS subject_id, '93832-4' AS coding_code, epoch_us(ts) AS effective_start,
      {rnd('floor(value * 60) / 60.0', 'value_quantity')} FROM s WHERE event_type <> 'error'
    UNION ALL SELECT CAST(user_id AS VARCHAR), '103215-0', epoch_us(ts),
      {rnd("(length(span) - length(replace(span, '4', ''))) * 5.0", 'value_quantity')} FROM s WHERE span <> ''""")
def sleep_summaries(spark, sf):
    out = R.rebuild(d.sleep_blobs(spark, sf))["observations"].where("coding_code <> 'aasm-sleep-stage'")
    return rounded(micros(out.select("subject_id", "coding_code", "effective_start", "value_quantity"), "effective_start"))


CLINICAL = """SELECT DISTINCT ON (l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_discount, l_linestatus, l_returnflag, l_shipdate) * FROM lineitem"""


@register(f"""SELECT CAST(l_orderkey AS VARCHAR) AS subject_id, 'http://loinc.org' AS coding_system, c AS coding_code, CAST(s AS BIGINT) AS seq,
    epoch_us(date_trunc('day', l_shipdate)) AS effective_start, CASE s WHEN 0 THEN l_quantity ELSE l_discount END AS value_quantity,
    CASE s WHEN 0 THEN 'kg' ELSE 'u' END AS value_unit FROM ({CLINICAL}), (VALUES (0, 'qty'), (1, 'disc')) AS k(s, c)""")
def ingest_clinical_observations(spark, sf):
    out = R.rebuild(d.clinical_blobs(spark, sf))["observations"]
    return micros(out.select(
        "subject_id", "coding_system", "coding_code", "seq", "effective_start", "value_quantity", "value_unit"), "effective_start")


@register(f"""SELECT CAST(l_orderkey AS VARCHAR) AS subject_id, 'http://snomed.info/sct' AS coding_system, CAST(l_partkey AS VARCHAR) AS coding_code,
    l_linestatus AS status, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS onset_date FROM ({CLINICAL}) WHERE l_returnflag <> 'R'""")
def ingest_clinical_problems(spark, sf):
    """Problems whose coding system is unknown are skipped."""
    out = R.rebuild(d.clinical_blobs(spark, sf))["problems"]
    return out.select("subject_id", "coding_system", "coding_code", "status", "onset_date")


@register(f"""SELECT CAST(l_orderkey AS VARCHAR) AS subject_id, CAST(l_suppkey AS VARCHAR) AS coding_code, 'active' AS status,
    concat(l_linenumber, ' mg') AS dose FROM ({CLINICAL})""")
def ingest_clinical_medications(spark, sf):
    out = R.rebuild(d.clinical_blobs(spark, sf))["medications"]
    return out.select("subject_id", "coding_code", "status", "dose")


def _narratives(spark, sf):
    """Distinct texts with the artifacts that cite them."""
    blobs = d.narrative_blobs(spark, sf).withColumn("_row", F.unix_micros("archived_at"))
    none = blobs.select("subject_id", "archive_key").limit(0)
    return R.rebuild(archive.new_blobs(blobs, none, "_row").drop("_row"), d.artifact_blobs(spark, sf))


@register("""WITH a AS (SELECT sha256(text) AS archive_key, arg_max({'q': quality, 't': toxic}, doc_id) AS l FROM documents JOIN labels USING (doc_id) GROUP BY ALL)
    SELECT archive_key, CAST(s AS BIGINT) AS seq, CASE s WHEN 0 THEN concat('quality-', l.q) ELSE concat('toxic-', l.t) END AS coding_code,
    'unknown' AS status, '2024-02-02' AS onset_date FROM a, (VALUES (0), (1)) AS k(s)""")
def artifact_problems(spark, sf):
    return _narratives(spark, sf)["problems"].select("archive_key", "seq", "coding_code", "status", "onset_date")


@register("""WITH a AS (SELECT sha256(text) AS archive_key, max(doc_id) AS m FROM documents JOIN labels USING (doc_id) GROUP BY ALL)
    SELECT archive_key, CASE WHEN m IS NOT NULL THEN '2024-02-02' ELSE '2024-01-01' END AS document_date, coalesce('doc ' || m, '') AS title, n_chars
    FROM (SELECT sha256(text) AS archive_key, any_value(length(text)) AS n_chars FROM documents GROUP BY ALL) LEFT JOIN a USING (archive_key)""")
def narrative_documents(spark, sf):
    out = _narratives(spark, sf)
    docs = out["source_documents"].select("archive_key", "document_date")
    texts = out["narrative_texts"].select("archive_key", "title", F.length("text").cast("bigint").alias("n_chars"))
    out = _dates_as_text(docs.join(texts, "archive_key"))
    return out.withColumn("title", F.coalesce("title", F.lit("")))


@register("""SELECT 'all' AS subject_id, (SELECT count(DISTINCT text) FROM documents) + (SELECT count(*) FROM labels JOIN documents USING (doc_id)) AS blobs_found,
    CAST(0 AS BIGINT) AS ccda_ingested, CAST(0 AS BIGINT) AS fitbit_ingested, CAST(0 AS BIGINT) AS oura_ingested,
    (SELECT count(DISTINCT text) FROM documents) AS narratives_ingested, CAST(0 AS BIGINT) AS blobs_skipped,
    (SELECT count(DISTINCT text) FROM documents JOIN labels USING (doc_id)) AS extractions_applied""")
def rebuild_tally(spark, sf):
    return _narratives(spark, sf)["tally"]
