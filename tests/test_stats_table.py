import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from helpers import LOINC, observations, rows, ts
from tidemark.operators.islands import next_sample_intervals
from tidemark.operators.ranks import average_rank, exact_percentiles
from tidemark.plans.relationship import relationship
from tidemark.plans.stats import stats
from tidemark.plans.table import aligned_table
from tidemark.specs import Coding, Column, EpisodeSpec

W, H, S = Coding(LOINC, "w"), Coding(LOINC, "h"), Coding(LOINC, "s")


def weights(spark):
    return observations(spark, [
        ("w", "2026-01-15T02:16:00Z", None, 380.0),
        ("w", "2026-01-16T02:16:00Z", None, 400.0),
        ("w", "2026-01-17T02:16:00Z", None, 420.0),
        ("w", "2026-01-18T02:16:00Z", None, 440.0),
        ("h", "2026-01-15T02:20:00Z", None, 60.0),
        ("h", "2026-01-16T02:20:00Z", None, 80.0),
        ("h", "2026-01-17T02:20:00Z", None, 70.0),
    ])


def test_stats_flat(spark):
    out = stats(weights(spark), W, end="2026-01-18T00:00:00Z", thresholds=[400.0]).collect()
    assert len(out) == 1
    r = out[0]
    assert (r["count"], r["mean"], r["sd"], r["min"], r["max"], r["p25"], r["p50"], r["p75"]) == (
        3, 400.0, 20.0, 380.0, 420.0, 390.0, 400.0, 410.0)
    assert [tuple(t) for t in r["thresholds"]] == [(400.0, 1, 2)]
    assert r["confidence"] == "confirmed"


def test_stats_type7_and_single(spark):
    obs = observations(spark, [("w", f"2026-01-0{i}T00:00:00Z", None, float(i)) for i in (1, 2, 3, 4)])
    r = stats(obs, W).collect()[0]
    assert (r.p25, r.p50, r.p75) == (1.75, 2.5, 3.25)
    r = stats(obs, W, bucket="day").where("bucket_key = '2026-01-02'").collect()[0]
    assert (r["count"], r.sd, r.p50) == (1, None, 2.0)


def test_stats_empty_without_keys(spark):
    r = stats(weights(spark), S, keys=()).collect()
    assert len(r) == 1 and r[0]["count"] == 0 and r[0]["mean"] is None and r[0]["p50"] is None
    assert stats(weights(spark), S, keys=(), bucket="day").collect() == []
    assert aligned_table(weights(spark), [Column(S)], keys=(), bucket="none").collect() == []


def test_time_of_day(spark):
    obs = weights(spark)
    end = "2026-01-18T00:00:00Z"
    assert stats(obs, W, end=end, field="start_time_of_day", tz="America/New_York").collect()[0]["mean"] == 556.0
    assert stats(obs, W, end=end, field="start_time_of_day").collect()[0]["mean"] == 856.0


@pytest.mark.parametrize("zone,starts,keys", [
    ("America/New_York", ["2026-11-01T05:30:00Z", "2026-11-01T06:30:00Z"],
     ["2026-11-01T01:00:00-04:00", "2026-11-01T01:00:00-05:00"]),
    ("Asia/Kolkata", ["2026-06-27T06:15:00Z", "2026-06-27T06:45:00Z"],
     ["2026-06-27T11:00:00+05:30", "2026-06-27T12:00:00+05:30"]),
    ("Europe/Berlin", ["2026-10-25T00:30:00Z", "2026-10-25T01:30:00Z"],
     ["2026-10-25T02:00:00+02:00", "2026-10-25T02:00:00+01:00"]),
    ("UTC", ["2026-06-27T06:15:00Z"], ["2026-06-27T06:00:00Z"]),
    ("Australia/Lord_Howe", ["2026-04-04T14:15:00Z", "2026-04-04T15:15:00Z"],
     ["2026-04-05T01:00:00+11:00", "2026-04-05T01:00:00+10:30"]),
])
def test_hour_keys_across_clock_changes(spark, zone, starts, keys):
    obs = observations(spark, [("w", s, None, 1.0) for s in starts])
    out = aligned_table(obs, [Column(W)], bucket="hour", tz=zone, ordered=True)
    assert [r.bucket_key for r in out.collect()] == keys
    out = stats(obs, W, bucket="hour", tz=zone, ordered=True)
    assert [r.bucket_key for r in out.collect()] == keys


def test_calendar_keys(spark):
    obs = observations(spark, [("w", "2026-01-01T03:00:00Z", None, 1.0), ("w", "2025-12-28T12:00:00Z", None, 2.0)])
    key = lambda b, tz="UTC": [r.bucket_key for r in stats(obs, W, bucket=b, tz=tz, ordered=True).collect()]
    assert key("week") == ["2025-12-22", "2025-12-29"]
    assert key("month") == ["2025-12", "2026-01"]
    assert key("day", "America/New_York") == ["2025-12-28", "2025-12-31"]
    assert key("day_of_week") == ["thu", "sun"]
    assert [r.bucket_key for r in aligned_table(obs, [Column(W)], bucket="none").collect()] == [None]


def test_aligned_rows(spark):
    out = aligned_table(weights(spark), [Column(W), Column(H)], ordered=True)
    assert rows(out, "value_0", "value_1") == [(380.0, 60.0), (400.0, 80.0), (420.0, 70.0), (440.0, None)]


def test_aggregates_null_and_zero(spark):
    obs = observations(spark, [
        ("w", "2026-01-01T01:00:00Z", None, 1.0), ("w", "2026-01-01T02:00:00Z", None, 4.0),
        ("w", "2026-01-02T01:00:00Z", None, None), ("h", "2026-01-03T01:00:00Z", None, 5.0),
    ])
    cols = [Column(W, a) for a in ("mean", "sum", "min", "max", "count", "median")]
    out = aligned_table(obs, [*cols, Column(H)], ordered=True)
    assert [tuple(r)[3:9] for r in out.collect()] == [
        (2.5, 5.0, 1.0, 4.0, 2.0, 2.5),
        (None, None, None, None, 0.0, None),
        (None,) * 6,
    ]
    # the row without a value makes a table bucket but no stats bucket
    assert stats(obs, W, bucket="day").count() == 1


def intervals(spark):
    return observations(spark, [
        ("s", "2026-06-26T22:00:00Z", "2026-06-26T23:00:00Z", 3.0),
        ("s", "2026-06-26T23:00:00Z", "2026-06-27T00:30:00Z", 4.0),
        ("s", "2026-06-27T00:30:00Z", "2026-06-27T01:00:00Z", 0.0),
        ("s", "2026-06-27T01:00:00Z", "2026-06-27T01:20:00Z", 1.0),
        ("s", "2026-06-28T05:00:00Z", "2026-06-28T05:10:00Z", 0.0),
        ("s", "2026-06-29T05:00:00Z", None, 2.0),
        ("h", "2026-06-27T00:30:00Z", None, 50.0),
        ("h", "2026-06-27T01:20:00Z", None, 60.0),
        ("h", "2026-06-27T01:20:01Z", None, 99.0),
    ])


def test_range_aggregates(spark):
    cols = [
        Column(S, "duration_in_range", value_min=1, value_max=4),
        Column(S, "longest_run_in_range", value_min=1, value_max=4),
        Column(S, "longest_run_in_range", value_min=1, value_max=4, gap_seconds=1800),
    ]
    out = aligned_table(intervals(spark), cols, ordered=True)
    assert rows(out, "bucket_key", "value_0", "value_1", "value_2") == [
        ("2026-06-26", 150.0, 150.0, 200.0),
        ("2026-06-27", 20.0, 20.0, 0.0),
        ("2026-06-28", 0.0, 0.0, 0.0),
        ("2026-06-29", None, None, None),
    ]


def test_range_in_half_open_window(spark):
    col = Column(S, "duration_in_range", value_min=3, value_max=4)
    out = aligned_table(intervals(spark), [col], bucket="none",
                        start="2026-06-26T22:00:00Z", end="2026-06-26T23:00:00Z")
    assert rows(out, "value_0") == [(60.0,)]


def test_episode_table(spark):
    spec = EpisodeSpec(S)
    cols = [Column(H), Column(S, "longest_run_in_range", value_min=1, value_max=4)]
    out = aligned_table(intervals(spark), cols, bucket="episode", episode=spec, ordered=True)
    assert rows(out, "bucket_key", "value_0", "value_1") == [
        ("2026-06-26T22:00:00Z", 55.0, 150.0),
        ("2026-06-28T05:00:00Z", None, 0.0),
    ]
    out = stats(intervals(spark), H, bucket="episode", episode=spec)
    assert rows(out, "bucket_key", "count", "p50") == [("2026-06-26T22:00:00Z", 2, 55.0)]


def test_relationship(spark):
    r = relationship(weights(spark), Column(W), Column(H), threshold=400.0).collect()[0]
    assert r.n_pairs == 3 and r.pearson_r == pytest.approx(0.5) and (r.x_mean, r.y_mean) == (400.0, 70.0)
    assert (r.x_below_count, r.x_below_mean, r.x_below_sd) == (1, 60.0, None)
    assert (r.x_at_or_above_count, r.x_at_or_above_mean, r.x_at_or_above_min,
            r.x_at_or_above_max, r.x_at_or_above_p50) == (2, 75.0, 70.0, 80.0, 75.0)
    r = relationship(weights(spark), Column(W), Column(H), lag=1).collect()[0]
    assert r.n_pairs == 2 and r.pearson_r == pytest.approx(-1.0)
    r = relationship(weights(spark), Column(W), Column(H), lag=9).collect()[0]
    assert r.n_pairs == 0 and r.pearson_r is None and r.x_mean is None


def test_spearman_and_constant(spark):
    obs = observations(spark, [
        *(("w", f"2026-01-1{i}T02:00:00Z", None, v) for i, v in enumerate((380.0, 400.0, 420.0, 440.0))),
        *(("h", f"2026-01-1{i}T03:00:00Z", None, v) for i, v in enumerate((60.0, 61.0, 63.0, 80.0))),
        *(("s", f"2026-01-1{i}T03:00:00Z", None, 7.0) for i in range(4)),
    ])
    r = relationship(obs, Column(W), Column(H)).collect()[0]
    assert r.n_pairs == 4 and r.spearman_r == pytest.approx(1.0) and 0.8 < r.pearson_r < 0.9
    r = relationship(obs, Column(W), Column(S)).collect()[0]
    assert r.pearson_r is None and r.spearman_r is None and r.y_sd == 0.0


def test_spearman_ties(spark):
    xs, ys = (1.0, 2.0, 2.0, 4.0), (10.0, 30.0, 20.0, 40.0)
    obs = observations(spark, [
        *(("w", f"2026-01-1{i}T02:00:00Z", None, v) for i, v in enumerate(xs)),
        *(("h", f"2026-01-1{i}T02:00:00Z", None, v) for i, v in enumerate(ys)),
    ])
    r = relationship(obs, Column(W), Column(H)).collect()[0]
    assert r.spearman_r == pytest.approx(0.9486832980505138)


def test_month_lag_carries_the_year(spark):
    obs = observations(spark, [
        ("w", "2025-12-15T00:00:00Z", None, 1.0), ("w", "2026-01-15T00:00:00Z", None, 2.0),
        ("h", "2026-01-10T00:00:00Z", None, 5.0), ("h", "2026-02-10T00:00:00Z", None, 6.0),
    ])
    r = relationship(obs, Column(W), Column(H), bucket="month", lag=1).collect()[0]
    assert (r.n_pairs, r.x_mean, r.y_mean) == (2, 1.5, 5.5)


def test_hour_lag_over_fall_back(spark):
    obs = observations(spark, [
        ("w", "2026-11-01T05:30:00Z", None, 1.0), ("h", "2026-11-01T06:10:00Z", None, 9.0),
    ])
    r = relationship(obs, Column(W), Column(H), bucket="hour", tz="America/New_York", lag=1).collect()[0]
    assert (r.n_pairs, r.y_mean) == (1, 9.0)


def test_episode_lag_counts_empty_episodes(spark):
    obs = observations(spark, [
        ("s", "2026-01-01T00:00:00Z", "2026-01-01T01:00:00Z", 1.0),
        ("s", "2026-01-02T00:00:00Z", "2026-01-02T01:00:00Z", 1.0),
        ("s", "2026-01-03T00:00:00Z", "2026-01-03T01:00:00Z", 1.0),
        ("w", "2026-01-01T00:10:00Z", None, 5.0), ("h", "2026-01-03T00:10:00Z", None, 8.0),
    ])
    args = dict(bucket="episode", episode=EpisodeSpec(S))
    assert relationship(obs, Column(W), Column(H), lag=2, **args).collect()[0].n_pairs == 1
    assert relationship(obs, Column(W), Column(H), lag=1, **args).collect()[0].n_pairs == 0


def test_no_cross_system_match(spark):
    assert aligned_table(weights(spark), [Column(Coding("other", "w"))]).collect() == []


@pytest.mark.parametrize("bad", [
    lambda: Column(W, "duration_in_range"),
    lambda: Column(W, "duration_in_range", value_min=2, value_max=1),
    lambda: Column(W, "mean", value_min=1),
    lambda: Column(W, "duration_in_range", value_min=1, value_max=2, gap_seconds=5),
    lambda: Column(W, "longest_run_in_range", value_min=1, value_max=2, gap_seconds=-1),
    lambda: Column(W, "mode"),
    lambda: Column(W, field="weight"),
    lambda: EpisodeSpec(S, -1),
])
def test_spec_rules(bad):
    with pytest.raises(ValueError):
        bad()


def test_call_rules(spark):
    obs = weights(spark)
    with pytest.raises(ValueError):
        aligned_table(obs, [])
    with pytest.raises(ValueError):
        aligned_table(obs, [Column(W)], bucket="episode")
    with pytest.raises(ValueError):
        stats(obs, W, episode=EpisodeSpec(S))
    with pytest.raises(ValueError):
        stats(obs, W, tz="Nowhere/City")
    for bucket in ("none", "day_of_week"):
        with pytest.raises(ValueError):
            relationship(obs, Column(W), Column(H), bucket=bucket)


def test_subjects_together_equal_each_alone(spark):
    base = intervals(spark)
    other = base.withColumn("value_quantity", base.value_quantity + 1)
    both = base.unionByName(other.replace("s1", "s2", "subject_id"))
    cols = [Column(H), Column(S, "longest_run_in_range", value_min=1, value_max=4)]
    kw = dict(bucket="episode", episode=EpisodeSpec(S))
    together = sorted(aligned_table(both, cols, **kw).collect(), key=str)
    alone = sorted(
        (r for s in ("s1", "s2") for r in aligned_table(both.where(f"subject_id = '{s}'"), cols, **kw).collect()),
        key=str)
    assert together == alone and len(together) == 4


def test_next_sample_intervals(spark):
    obs = observations(spark, [
        ("w", "2026-01-01T00:00:00Z", None, 1.0), ("w", "2026-01-01T00:01:30Z", None, 2.0), ("w", "2026-01-01T00:03:01Z", None, 3.0),
        ("w", "2026-01-01T00:03:01Z", None, 4.0), ("w", "2026-01-01T05:59:59Z", None, 5.0), ("w", "2026-01-01T06:00:30Z", None, 6.0)])
    got = {r.value_quantity: (r.effective_end - r.effective_start).total_seconds() for r in next_sample_intervals(obs).collect()}
    assert got == {1.0: 90.0, 2.0: 60.0, 3.0: 0.0, 4.0: 60.0, 5.0: 31.0, 6.0: 60.0}


def test_split_percentiles_equal_the_built_in(spark):
    df = spark.range(3000).select(
        (F.col("id") % 3).alias("g"), (F.sin(F.col("id") * 7) * F.pow(F.lit(10.0), F.col("id") % 5) - (F.col("id") % 11)).alias("v"))
    got = {r.g: r.p for r in exact_percentiles(df, ["g"], "v", (0.0, 0.25, 0.5, 0.9, 1.0), "p").collect()}
    want = {r.g: r.p for r in df.groupBy("g").agg(F.percentile("v", [0.0, 0.25, 0.5, 0.9, 1.0]).alias("p")).collect()}
    assert all(got[g] == pytest.approx(want[g]) for g in want) and len(got) == 3
    plain = df.select("g", "v", (F.rank().over(Window.partitionBy("g").orderBy("v")) + (F.count("v").over(Window.partitionBy("g", "v")) - 1) / 2.0).alias("k"))
    ranks = [{(r.g, r.v): r.k for r in x.collect()} for x in (average_rank(df, ["g"], "v", "k"), plain)]
    assert ranks[0] == ranks[1]


def test_percentiles_at_infinities(spark):
    df = spark.createDataFrame([(float(v),) for v in ("1", "2", "inf", "nan")], "v double")
    got = exact_percentiles(df, [], "v", (1 / 3, 2 / 3, 1.0), "p").first().p
    assert got[:2] == [2.0, float("inf")] and got[2] != got[2]


def test_one_key_with_most_rows_in_a_narrow_range(spark):
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 100 == 0, "few").otherwise("most").alias("g"), (36 + (F.col("id") * 7919 % 2001) / 1000).alias("v"))
    got = {r.g: r.p for r in exact_percentiles(rows, ["g"], "v", (0.25, 0.5, 0.75), "p").collect()}
    want = {r.g: r.p for r in rows.groupBy("g").agg(F.percentile("v", [0.25, 0.5, 0.75]).alias("p")).collect()}
    assert all(got[g] == pytest.approx(want[g]) for g in want) and len(got) == 2
