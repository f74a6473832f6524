import datetime as dt

from helpers import LOINC, observations, ts
from tidemark import schemas
from tidemark.operators.islands import detect_episodes
from tidemark.streaming.alerts import dispatch_stream
from tidemark.streaming.ingest import ARCHIVE_ROWS, PULLS, read_rows, start_ingest_stream, sync_tally
from tidemark.streaming.sessions import episode_stream
from tidemark.streaming.state import advance_frontier, fold_outcomes, read_state, versions, write_state
from test_ingest import beats, hr_day, night, blob
from tidemark.sources import archive as A


def land(spark, path, *blobs):
    rows = [(s, k, c, None, kind, src, subj, at, name, has) for s, k, c, kind, src, subj, at, name, has in blobs]
    spark.createDataFrame(rows, ARCHIVE_ROWS).coalesce(1).write.mode("append").parquet(path)


def test_ingest_stream(spark, tmp_path):
    landing, root, check = (str(tmp_path / n) for n in ("landing", "tables", "check"))
    first = hr_day(beats(("2026-06-22T12:00:00Z", 72), ("2026-06-22T12:00:02Z", 75)), "2026-06-22T13:00:00Z")
    second = hr_day(beats(("2026-06-22T12:00:00Z", 72), ("2026-06-22T12:00:02Z", 75), ("2026-06-22T12:00:04Z", 80)), "2026-06-22T23:00:00Z")
    late = hr_day(beats(("2026-06-22T12:00:00Z", 1)), "2026-06-22T10:00:00Z")
    other_day = hr_day(beats(("2026-06-23T12:00:00Z", 60)), "2026-06-23T13:00:00Z", "2026-06-23")
    sleep = blob(night("2026-06-22T22:00:00Z", "2142"), A.SLEEP_SESSION, "oura")

    def run(*blobs, now):
        land(spark, landing, *blobs)
        query = start_ingest_stream(spark, landing, root, check, now=now)
        query.awaitTermination()
        return read_rows(spark, root)

    assert run(first, other_day, sleep, now="2026-06-24T00:00:00Z").where("source = 'fitbit'").count() == 3
    rows = run(second, now="2026-06-25T00:00:00Z")
    assert sorted(r.value_quantity for r in rows.where("source = 'fitbit'").collect()) == [60.0, 72.0, 75.0, 80.0]
    # an older pull that arrives late changes nothing
    rows = run(late, now="2026-06-26T00:00:00Z")
    assert sorted(r.value_quantity for r in rows.where("source = 'fitbit'").collect()) == [60.0, 72.0, 75.0, 80.0]
    assert rows.where("source = 'oura'").count() == 5
    docs = read_state(spark, f"{root}/source_documents", PULLS)
    assert docs.where("source = 'fitbit'").count() == 2
    days = {str(r.date): (r.samples_count, r.samples_count_prev)
            for r in read_state(spark, f"{root}/source_day_state", schemas.SOURCE_DAY_STATE).where("source_name = 'fitbit'").collect()}
    assert days == {"2026-06-22": (3, 2), "2026-06-23": (1, None)}
    state = {r.source_name: r for r in read_state(spark, f"{root}/source_state", schemas.SOURCE_STATE).collect()}
    assert state["fitbit"].freshness_frontier_at == dt.datetime(2026, 6, 23, 12)
    assert state["fitbit"].frontier_last_advanced_at == dt.datetime(2026, 6, 24)
    tally = {r.source: (r.days_synced, r.total_samples) for r in sync_tally(read_state(spark, f"{root}/pulls", PULLS)).collect()}
    assert tally == {"fitbit": (2, 7), "oura": (1, 4)}


def test_episode_stream_equals_batch(spark, tmp_path):
    rows = [("s", f"2026-01-0{d}T{h:02}:00:00Z", f"2026-01-0{d}T{h:02}:{m:02}:00Z", 1.0)
            for d, h, m in ((1, 0, 50), (1, 1, 10), (1, 0, 10), (1, 4, 0), (2, 4, 30), (2, 5, 30))]
    rows += [("s", "2026-01-03T00:00:00Z", "2026-01-03T00:10:00Z", 1.0), ("s", "2026-01-03T00:40:01Z", "2026-01-03T00:50:00Z", 1.0)]
    obs = observations(spark, rows).select("subject_id", "effective_start", "effective_end")
    last = observations(spark, [("s", "2026-03-01T00:00:00Z", "2026-03-01T00:01:00Z", 1.0)]).select(*obs.columns)
    path = str(tmp_path / "in")
    obs.coalesce(1).write.parquet(path)
    last.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(obs.schema).option("maxFilesPerTrigger", 1).parquet(path)
    query = (episode_stream(stream, 1800).writeStream.format("memory").queryName("episodes_out").outputMode("append")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    got = sorted(map(tuple, spark.table("episodes_out").collect()))
    want = sorted(map(tuple, detect_episodes(obs, 1800).collect()))
    assert len(want) == 5 and [g for g in got if g[1].month == 1] == want


def test_dispatch_stream(spark, tmp_path):
    path = str(tmp_path / "in")
    schema = "subject_id string, condition_id string, evaluated_at timestamp, is_firing boolean, severity string, title string, message string"
    steps = [("01T00", True), ("01T12", True), ("02T00", True), ("02T01", False), ("02T02", False), ("02T03", True)]
    for part in (steps[:2], steps[2:]):
        spark.createDataFrame([("s1", "c", ts(f"2026-01-{t}:00:00Z"), f, "w", "t", "m") for t, f in part], schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    query = (dispatch_stream(stream).writeStream.format("memory").queryName("dispatch_out").outputMode("append")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    got = [(r.evaluated_at.day, r.evaluated_at.hour, r.action) for r in spark.table("dispatch_out").orderBy("evaluated_at").collect()]
    assert got == [(1, 0, "fire"), (1, 12, "suppress"), (2, 0, "fire"), (2, 1, "resolve"), (2, 3, "fire")]


def state_row(spark, frontier=None, advanced=None, failures=0):
    return spark.createDataFrame(
        [("s1", "fitbit", None, "success", None, None, None, ts(frontier), ts(advanced), failures)], schemas.SOURCE_STATE)


def test_frontier_only_moves_forward(spark):
    def moved(new):
        pulled = spark.createDataFrame([("s1", "fitbit", ts(new)), ("s1", "oura", ts(new))], "subject_id string, source_name string, newest_sample timestamp")
        rows = advance_frontier(state_row(spark, "2026-01-02T00:00:00Z", "2026-01-03T00:00:00Z"), pulled, "2026-02-01T00:00:00Z").collect()
        return {r.source_name: (r.freshness_frontier_at.day, r.frontier_last_advanced_at.month) for r in rows}

    assert moved("2026-01-01T00:00:00Z") == {"fitbit": (2, 1), "oura": (1, 2)}
    assert moved("2026-01-02T00:00:00Z")["fitbit"] == (2, 1)
    assert moved("2026-01-05T00:00:00Z")["fitbit"] == (5, 2)


def test_fold_outcomes(spark):
    schema = "subject_id string, source_name string, at timestamp, ok boolean, error_message string, error_reason string"
    event = lambda hour, ok: ("s1", "fitbit", ts(f"2026-01-01T{hour:02}:00:00Z"), ok, None if ok else "boom", None if ok else "transient")
    fold = lambda *e: fold_outcomes(state_row(spark, "2026-01-02T00:00:00Z", failures=2), spark.createDataFrame(list(e), schema)).collect()[0]
    r = fold(event(1, False), event(2, False))
    assert (r.consecutive_sync_failures, r.last_sync_status, r.last_error_reason) == (4, "error", "transient")
    r = fold(event(1, False), event(2, True), event(3, False))
    assert r.consecutive_sync_failures == 1
    r = fold(event(1, False), event(2, True))
    assert (r.consecutive_sync_failures, r.last_sync_status, r.last_error_message) == (0, "success", None)
    assert r.freshness_frontier_at.day == 2


def test_state_versions(spark, tmp_path):
    path = str(tmp_path / "state")
    assert read_state(spark, path, "k int").count() == 0
    for v in range(6):
        write_state(spark.range(v).selectExpr("cast(id as int) as k"), path, v, keep=2)
    assert versions(spark, path) == [3, 4, 5]
    assert read_state(spark, path, "k int").count() == 5
    assert read_state(spark, path, "k int", before=5).count() == 4


def test_a_day_pulled_again_without_samples_loses_its_rows(spark, tmp_path):
    landing, root, check = (str(tmp_path / n) for n in ("landing", "tables", "check"))
    day = hr_day(beats(("2026-06-22T12:00:00Z", 72), ("2026-06-22T12:00:02Z", 75)), "2026-06-22T13:00:00Z")
    other = hr_day(beats(("2026-06-23T12:00:00Z", 60)), "2026-06-23T13:00:00Z", "2026-06-23")
    empty = hr_day(beats(), "2026-06-22T20:00:00Z")
    counts = []
    for blobs in ((day, day, other), (empty,), (day,)):
        land(spark, landing, *blobs)
        start_ingest_stream(spark, landing, root, check, now="2026-06-24T00:00:00Z").awaitTermination()
        counts.append(sorted(r.value_quantity for r in read_rows(spark, root).collect()))
    assert counts == [[60.0, 72.0, 75.0], [60.0], [60.0]]
