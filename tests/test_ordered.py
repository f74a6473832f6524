"""Islands, positions and next samples against plain loops, with batches and partitions cut everywhere."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.islands import detect_episodes, next_sample_intervals, number_rows, runs

START = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)
SCHEMA = "subject_id string, archive_key string, seq long, effective_start timestamp, effective_end timestamp"


@pytest.fixture(params=[(3, 7), (10_000, 2)], ids=["small batches", "large batches"])
def cut(spark, request):
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(n) for n in names]
    for name, value in zip(names, (*map(str, request.param), "false")):
        spark.conf.set(name, value)
    yield
    for name, value in zip(names, before):
        spark.conf.set(name, value)


def rows_of(seed, n=400, span=4000):
    """One subject has 99 % of the rows; starts repeat, lengths vary from nothing to most of the span."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        subject = "hot" if rng.random() < 0.99 else rng.choice("abc")
        start = rng.randrange(span)
        length = rng.choice((0, 1, 5, 5, 20, rng.randrange(span // 4) if rng.random() < 0.05 else 2))
        out.append((subject, f"k{rng.randrange(3)}", k, START + dt.timedelta(seconds=start), START + dt.timedelta(seconds=start + length)))
    return out


def chained(rows, gap, by_reach):
    out = {}
    tolerance = dt.timedelta(seconds=gap + 1)
    for subject in {r[0] for r in rows}:
        mine = sorted((r[3], r[1], r[2], r[4]) for r in rows if r[0] == subject)
        if not by_reach:
            mine = [r for r, following in zip(mine, [*mine[1:], None]) if following is None or following[0] != r[0]]
        islands = []
        for start, _, _, end in mine:
            if islands and start - islands[-1][1] < tolerance:
                islands[-1][1] = max(islands[-1][1], end) if by_reach else end
            else:
                islands.append([start, end])
        out[subject] = [tuple(i) for i in islands]
    return out


def collected(df, *columns):
    out = {}
    for r in df.collect():
        out.setdefault(r.subject_id, []).append(tuple(r[c].astimezone(dt.timezone.utc) if isinstance(r[c], dt.datetime) else r[c] for c in columns))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("gap", [0, 7, 60])
def test_islands(spark, cut, gap):
    for seed, span in ((1, 4000), (2, 40_000)):
        rows = rows_of(seed, span=span)
        df = spark.createDataFrame(rows, SCHEMA).repartition(5)
        assert collected(detect_episodes(df, gap), "episode_start", "episode_end") == chained(rows, gap, True)
        assert collected(runs(df, gap), "run_start", "run_end") == chained(rows, gap, False)


def test_islands_without_keys_and_without_rows(spark):
    rows = rows_of(3)
    df = spark.createDataFrame(rows, SCHEMA)
    got = [(r.episode_start.astimezone(dt.timezone.utc), r.episode_end.astimezone(dt.timezone.utc)) for r in detect_episodes(df, 5, ()).collect()]
    assert sorted(got) == chained([("x", *r[1:]) for r in rows], 5, True)["x"]
    assert detect_episodes(df.where("false")).count() == 0 and runs(df.where("false")).count() == 0


def test_positions(spark, cut):
    df = spark.range(1000).select(
        F.when(F.col("id") % 100 != 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 300)).alias("subject_id"), (F.col("id") * 7919 % 1000).alias("at"))
    got = collected(number_rows(df.repartition(4), "at", "n"), "at", "n")
    assert all([n for _, n in v] == list(range(len(v))) for v in got.values()) and sum(map(len, got.values())) == 1000
    assert number_rows(df.where("false"), "at", "n").count() == 0


def test_next_samples_of_a_dense_interval(spark, cut):
    rng = random.Random(4)
    rows = [("hot", "k", k, START + dt.timedelta(milliseconds=rng.randrange(6 * 3600 * 1000)), None) for k in range(3000)]
    rows += [("hot", "k", 3000 + k, START + dt.timedelta(seconds=s), None) for k, s in enumerate((0, 90, 180.999, 272, 40_000, 40_000, 40_000.5))]
    rows += [("b", "k", k, START - dt.timedelta(seconds=s), None) for k, s in enumerate((10**9, 10**9 - 91, 5, 0))]
    got = {(r.subject_id, r.seq): r.effective_end.astimezone(dt.timezone.utc) for r in next_sample_intervals(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    for subject in ("hot", "b"):
        mine = sorted((r[3], r[2]) for r in rows if r[0] == subject)
        for (start, seq), following in zip(mine, [*mine[1:], None]):
            near = following is not None and following[0] - start < dt.timedelta(seconds=91)
            assert got[subject, seq] == (following[0] if near else start + dt.timedelta(seconds=60))


def test_one_read_and_one_exchange_for_next_samples(spark, tmp_path):
    spark.createDataFrame(rows_of(5), SCHEMA).write.parquet(str(tmp_path / "rows"))
    plan = next_sample_intervals(spark.read.parquet(str(tmp_path / "rows")))._jdf.queryExecution().sparkPlan().toString()
    full = next_sample_intervals(spark.read.parquet(str(tmp_path / "rows")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and full.count("Exchange") == 1


def test_ranks_with_ties_of_both_variables(spark, cut):
    from tidemark.operators.ranks import average_ranks, exact_percentiles

    rng = random.Random(6)
    values = [0.0, 1.0, 1.0, 2.5, float("inf"), float("-inf"), float("nan"), None]
    rows = [("hot" if rng.random() < 0.9 else "b", rng.choice(values), float(rng.randrange(40)), k) for k in range(600)]
    df = spark.createDataFrame(rows, "g string, x double, y double, k long").repartition(4)
    got = {r.k: (r.rx, r.ry) for r in average_ranks(df, ["g"], {"x": "rx", "y": "ry"}).collect()}
    order = lambda v: (1, 0.0) if v != v else (0, v)  # noqa: E731  (a NaN is the largest value)
    for group in ("hot", "b"):
        mine = [r for r in rows if r[0] == group]
        for of in (1, 2):
            keys = sorted(order(r[of]) for r in mine if r[of] is not None)
            for r in mine:
                if r[of] is None:
                    assert got[r[3]][of - 1] is None
                else:
                    at = [i for i, v in enumerate(keys, 1) if v == order(r[of])]
                    assert got[r[3]][of - 1] == sum(at) / len(at)
    # percentiles of the same groups; ranks next to a NaN give NaN
    for r in exact_percentiles(df, ["g"], "x", (0.0, 0.3, 0.5, 1.0), "p").collect():
        mine = sorted((order(v[1]), v[1]) for v in rows if v[0] == r.g and v[1] is not None)
        assert r.p[0] == mine[0][1] and r.p[3] != r.p[3]
        at = 0.5 * (len(mine) - 1)
        low, high = mine[int(at)][1], mine[min(int(at) + 1, len(mine) - 1)][1]
        assert r.p[2] == low + (high - low) * (at - int(at)) or low == high == r.p[2]


def test_percentiles_of_a_large_group(spark):
    """Enough rows for the sketch to be inexact, most of them alike."""
    from tidemark.operators.ranks import exact_percentiles

    rows = spark.range(300_000).select(
        F.when(F.col("id") % 50 != 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"),
        F.when(F.col("id") % 3 == 0, F.lit(7.0)).otherwise(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 7.0).alias("v"))
    probs = (0.01, 0.25, 0.5, 0.75, 0.999)
    want = {r.g: r.p for r in rows.groupBy("g").agg(F.percentile("v", probs).alias("p")).collect()}
    got = {r.g: r.p for r in exact_percentiles(rows, ["g"], "v", probs, "p").collect()}
    assert got.keys() == want.keys() and all(abs(a - b) < 1e-6 for g in want for a, b in zip(got[g], want[g]))
