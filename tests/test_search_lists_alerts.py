import datetime as dt

import pytest
from pyspark.sql import functions as F

from helpers import ts
from tidemark import schemas
from tidemark.operators.confidence import days_to_fetch, day_confidence, provisional_documents
from tidemark.operators.dedup import merge_columns, replace_rows, supersede
from tidemark.plans.alerts import conditions, dispatch, log_entries, notifications, state_changes
from tidemark.plans.lists import current_medications, current_problems
from tidemark.plans.search import Query, build_postings, catalog, narrative, search
from tidemark.plans.stats import stats
from tidemark.plans.table import aligned_table
from tidemark.plans.observations import codings, history, latest
from tidemark.sources.narrative import verify_claims, verify_dates
from tidemark.specs import Coding, Column

TEXTS = [
    ("d1", None, "Colon biopsy shows no dysplasia. Café visit noted; code R10.9 was given."),
    ("d2", None, "dysplasia dysplasia dysplasia of the colon"),
    ("d3", None, "An unrelated note about running and a long day in the cafe."),
    ("d4", None, "R10 9 appears as 9 R10 too."),
    ("d5", None, ""),
]


def texts(spark):
    return spark.createDataFrame([("s1", *t) for t in TEXTS], schemas.NARRATIVE_TEXTS)


def hits(spark, **query):
    return [r.archive_key for r in search(texts(spark), Query(**query)).collect()]


def test_match_forms(spark):
    assert hits(spark, all_terms=["DYSPLASIA"]) == ["d2", "d1"]
    assert hits(spark, all_terms=["dysplasia", "biopsy"]) == ["d1"]
    assert sorted(hits(spark, any_terms=["biopsy", "running"])) == ["d1", "d3"]
    assert sorted(hits(spark, all_terms=["cafe"])) == ["d1", "d3"]
    assert hits(spark, all_terms=["colon"], none_terms=["biopsy"]) == ["d2"]
    assert hits(spark, phrases=["R10.9"]) == ["d4", "d1"]
    assert hits(spark, phrases=["9 r10"]) == ["d4"]
    assert sorted(hits(spark, prefixes=["dyspl", "col"])) == ["d1", "d2"]
    assert hits(spark, all_terms=["absent"]) == []
    with pytest.raises(ValueError):
        Query(none_terms=["x"])


@pytest.fixture(scope="module")
def fts():
    """SQLite's full-text index over the same texts, as the ranking oracle."""
    sqlite3 = pytest.importorskip("sqlite3")
    db = sqlite3.connect(":memory:")
    try:
        db.execute("create virtual table t using fts5(k unindexed, body)")
    except sqlite3.OperationalError:
        pytest.skip("no full-text index in this build")
    db.executemany("insert into t values (?, ?)", [(k, body) for k, _, body in TEXTS])
    return lambda q: {k: (score, snip) for k, score, snip in db.execute(
        "select k, bm25(t), snippet(t, 1, '[', ']', ' … ', 16) from t where t match ?", [q])}


@pytest.mark.parametrize("query,text", [
    (dict(all_terms=["colon"], any_terms=["dysplasia", "no"]), "colon AND (dysplasia OR no)"),
    (dict(all_terms=["cafe"]), "cafe"),
    (dict(phrases=["R10.9"]), '"R10.9"'),
    (dict(prefixes=["no", "a"]), "no* AND a*"),
    (dict(all_terms=["colon"], none_terms=["biopsy"]), "colon NOT biopsy"),
])
def test_scores_and_snippets_equal_the_oracle(spark, fts, query, text):
    for index in (None, build_postings(texts(spark))):
        found = search(texts(spark), Query(**query), postings=index).collect()
        assert {r.archive_key: (pytest.approx(r.score, rel=1e-9), r.snippet) for r in found} == fts(text)


def test_snippets(spark):
    long = " ".join(f"w{i}" for i in range(40)) + " (needle), next " + " ".join(f"v{i}" for i in range(40))
    df = spark.createDataFrame([("s1", "k", "T", long), ("s1", "m", "T", "the needle. End")], schemas.NARRATIVE_TEXTS)
    got = {r.archive_key: r.snippet for r in search(df, Query(all_terms=["needle"], any_terms=["needle", "next"])).collect()}
    assert got["m"] == "the [needle]. End"
    assert got["k"].startswith(" … w") and "([needle]), [next] v0" in got["k"] and got["k"].endswith(" … ")
    assert len(got["k"].replace("…", "").split()) == 16
    phrase = search(df, Query(phrases=["needle next"])).collect()
    assert "([needle), next] v0" in phrase[0].snippet


def test_postings_are_made_within_rows(spark):
    rows = [("s1", "d", "Éa b a c-A"), ("s1", "e", None), ("s1", "f", " -- "), ("s2", "d", "b")]
    postings = lambda *more: build_postings(spark.createDataFrame(rows + list(more), "subject_id string, archive_key string, text string"))
    listed = lambda df: sorted((r.subject_id, r.archive_key, r.doc_length, r.term, r.tf, r.positions) for r in df.collect())
    once = [("s1", "d", 5, "a", 2, [2, 4]), ("s1", "d", 5, "b", 1, [1]), ("s1", "d", 5, "c", 1, [3]), ("s1", "d", 5, "ea", 1, [0]),
            ("s2", "d", 1, "b", 1, [0])]
    df = postings()
    assert listed(df) == once
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()  # which moved every token's term
    # rows of one document and length are one text
    assert listed(postings(("s1", "d", "a a b"), ("s2", "d", "b"), ("s2", "d", "c"))) == [
        ("s1", "d", 3, "a", 2, [0, 1]), ("s1", "d", 3, "b", 1, [2]), *once[:4],
        ("s2", "d", 1, "b", 2, [0, 0]), ("s2", "d", 1, "c", 1, [0])]


def docs(spark, *rows):
    """Rows of (archive_key, date[, source[, archived_at]])."""
    out = []
    for key, date, *more in rows:
        source = more[0] if more else "clinic"
        at = ts(more[1]) if len(more) > 1 else ts("2026-01-01T00:00:00Z")
        out.append(("s1", key, "k", source, None, at, dt.date.fromisoformat(date) if date else None))
    return spark.createDataFrame(out, schemas.SOURCE_DOCUMENTS)


def test_catalog_and_detail(spark):
    d = docs(spark, ("d1", "2026-01-02"), ("d2", None), ("d3", "2026-03-01"), ("d4", "2026-01-02"), ("d5", "2025-01-01"))
    assert [r.archive_key for r in catalog(texts(spark), d, limit=4).collect()] == ["d3", "d4", "d1", "d5"]
    problems = spark.createDataFrame(
        [("s1", "d1", 1, "icd", "K64.8", "b", "unknown", "2026-01-01", "Dx"),
         ("s1", "d1", 0, "icd", "R10.9", "a", "unknown", "2026-01-01", None)], schemas.PROBLEMS)
    n, = narrative(texts(spark), d, problems, "d1").collect()
    assert [c.coding_code for c in n.codings] == ["R10.9", "K64.8"] and n.text.startswith("Colon")
    assert narrative(texts(spark), d, problems, "d3").collect()[0].codings == []
    assert narrative(texts(spark), d, problems, "zz").collect() == []


def test_problem_list(spark):
    d = docs(spark, ("a", "2026-01-01"), ("b", "2026-02-01"), ("c", None), ("e", "2026-05-01"))
    rows = [("a", "old", "active", "L2"), ("b", "new", "completed", "L1"), ("c", "undated", "x", "L1"), ("b", "new", "completed", None)]
    p = spark.createDataFrame(
        [("s1", k, i, "sct", "1", disp, st, None, lab) for i, (k, disp, st, lab) in enumerate(rows)]
        + [("s1", "c", 9, "sct", "2", "only", "x", None, None)], schemas.PROBLEMS)
    got = current_problems(p, d, ordered=True).collect()
    assert [(r.coding_code, r.coding_display, r.status, r.document_count, str(r.first_seen), str(r.last_seen), r.section_labels)
            for r in got] == [("1", "new", "completed", 3, "2026-01-01", "2026-02-01", ["L1", "L2"]),
                              ("2", "only", "x", 1, "None", "None", [])]
    assert {str(r.latest_document_date) for r in got} == {"2026-05-01"}
    m = spark.createDataFrame(
        [("s1", "a", 0, "rx", "7", "m", "active", "500 mg", "Oral", None, "2021-06-01", None)], schemas.MEDICATIONS)
    got, = current_medications(m, d, keys=()).collect()
    assert (got.dose, got.document_count, str(got.latest_document_date)) == ("500 mg", 1, "2026-05-01")


def test_lists_group_by_document_before_dates_are_joined(spark):
    # a document given with two dates counts once, with its newest date and both ends of the range
    d = docs(spark, ("a", "2026-01-01"), ("a", "2026-03-01"), ("b", "2026-02-01"), ("b", None))
    rows = [("b", "x", "L2"), ("a", "first", "L1"), ("a", "last", None), ("gone", "y", "L9")]
    p = spark.createDataFrame(
        [("s1", k, i, "sct", "1", disp, "active", None, lab) for i, (k, disp, lab) in enumerate(rows)], schemas.PROBLEMS)
    out = current_problems(p, d)
    got, = out.collect()
    assert (got.coding_display, got.document_count, str(got.first_seen), str(got.last_seen), got.section_labels,
            str(got.latest_document_date)) == ("last", 2, "2026-01-01", "2026-03-01", ["L1", "L2"], "2026-03-01")
    assert "count(distinct" not in out._jdf.queryExecution().optimizedPlan().toString()  # which moved all details once more


def test_observation_reads(spark):
    from helpers import observations
    obs = observations(spark, [
        ("w", "2026-01-01T00:00:00Z", None, 1.0, "a"), ("w", "2026-01-03T00:00:00Z", None, 3.0, "a"),
        ("w", "2026-01-03T00:00:00Z", None, 4.0, "b"), ("h", "2026-01-02T00:00:00Z", None, 9.0, "a")])
    c = codings(obs, ordered=True).collect()
    assert [(r.coding_code, r["count"], r.earliest.day, r.latest.day) for r in c] == [("h", 1, 2, 2), ("w", 3, 1, 3)]
    w = Coding("http://loinc.org", "w")
    assert [r.value_quantity for r in latest(obs, w).collect()] == [4.0]
    assert latest(obs).count() == 2
    h = Coding("http://loinc.org", "h")
    assert [r.value_quantity for r in history(obs, [w, h, w], start="2026-01-02T00:00:00Z").collect()] == [9.0, 3.0, 4.0]
    assert history(obs, [w], end="2026-01-03T00:00:00Z").count() == 1


NOW = "2026-06-30T12:00:00Z"


def confidence_tables(spark):
    d = docs(spark, ("stable", "2026-06-01", "fitbit"), ("changing", "2026-06-02", "fitbit"), ("once", "2026-06-03", "fitbit"),
             ("recent", "2026-06-26", "fitbit"), ("unreached", "2026-06-20", "fitbit"), ("undated", None, "fitbit"),
             ("slept", "2026-06-28", "oura"), ("sleeping", "2026-06-29", "oura"), ("visit", "2026-06-30", "clinic"))
    day = lambda date, n, prev: ("s1", "fitbit", dt.date.fromisoformat(date), n, prev, None)
    days = spark.createDataFrame(
        [day("2026-06-01", 5, 5), day("2026-06-02", 5, 4), day("2026-06-03", 5, None), day("2026-06-20", 5, 5),
         day("2026-06-26", 5, 5)], schemas.SOURCE_DAY_STATE)
    state = spark.createDataFrame(
        [("s1", "fitbit", None, "success", None, None, None, ts("2026-06-21T11:59:59Z"), None, 0)], schemas.SOURCE_STATE)
    return d, state, days


def test_day_confidence(spark):
    d, state, days = confidence_tables(spark)
    got = {(r.source, str(r.document_date)): r.is_provisional for r in day_confidence(d, state, days, NOW).collect()}
    assert got == {
        ("fitbit", "2026-06-01"): False, ("fitbit", "2026-06-02"): True, ("fitbit", "2026-06-03"): True,
        ("fitbit", "2026-06-26"): True, ("fitbit", "2026-06-20"): True,
        ("oura", "2026-06-28"): False, ("oura", "2026-06-29"): True}
    none = day_confidence(d, state.limit(0), days, NOW).where("source = 'fitbit' and not is_provisional")
    assert none.count() == 0


def test_confidence_of_results(spark):
    from helpers import observations
    d, state, days = confidence_tables(spark)
    marked = provisional_documents(d, day_confidence(d, state, days, NOW))
    obs = observations(spark, [
        ("w", "2026-06-01T01:00:00Z", None, 1.0, "stable"), ("w", "2026-06-01T02:00:00Z", None, None, "recent"),
        ("w", "2026-06-02T02:00:00Z", None, 2.0, "changing"), ("w", "2026-06-03T02:00:00Z", None, 2.0, "visit")])
    w = Coding("http://loinc.org", "w")
    by = lambda df: {r.bucket_key: r.confidence for r in df.collect()}
    # a row without the value colours the table bucket, not the statistics
    assert by(aligned_table(obs, [Column(w)], confidence=marked)) == {
        "2026-06-01": "provisional", "2026-06-02": "provisional", "2026-06-03": "confirmed"}
    assert by(stats(obs, w, bucket="day", confidence=marked)) == {
        "2026-06-01": "confirmed", "2026-06-02": "provisional", "2026-06-03": "confirmed"}
    assert [r.confidence for r in history(obs, [w], confidence=marked).collect()] == [
        "confirmed", "provisional", "provisional", "confirmed"]
    assert latest(obs, w, confidence=marked).collect()[0].confidence == "confirmed"


def test_supersede_passes_the_rest_through(spark):
    d = docs(spark, ("a", "2026-06-01", "fitbit", "2026-06-02T00:00:00Z"), ("b", "2026-06-01", "fitbit", "2026-06-03T00:00:00Z"),
             ("c", None, "fitbit"), ("d", None, "fitbit"), ("e", "2026-06-01", "oura"), ("f", "2026-06-01", "oura"))
    assert sorted(r.archive_key for r in supersede(d).collect()) == ["b", "c", "d", "e", "f"]


def test_days_to_fetch(spark):
    req = spark.createDataFrame([("s1", "oura", dt.date(2026, 1, 1), dt.date(2026, 1, 4))],
                                "subject_id string, source string, start_date date, end_date date")
    day = lambda *ds: spark.createDataFrame([("s1", "oura", dt.date(2026, 1, d)) for d in ds], "subject_id string, source string, date date")
    got = days_to_fetch(req, day(1, 2), day(1, 3)).collect()
    assert sorted(r.date.day for r in got) == [2, 3, 4]


def source_state(spark, name="fitbit", reason=None, failures=0, advanced=None):
    return spark.createDataFrame(
        [("s1", name, None, "x", None, reason, None, None, ts(advanced), failures)], schemas.SOURCE_STATE)


@pytest.mark.parametrize("kw,firing", [
    (dict(), []),
    (dict(reason="reauth_required", failures=1), ["auth_expired:fitbit"]),
    (dict(reason="transient", failures=3), ["sync_failures:fitbit"]),
    (dict(failures=2), []),
    (dict(advanced="2026-06-28T12:00:00Z"), ["frontier_stuck:fitbit"]),
    (dict(advanced="2026-06-28T12:00:01Z"), []),
    (dict(advanced="2026-06-01T00:00:00Z", failures=1), []),
])
def test_conditions(spark, kw, firing):
    rows = conditions(source_state(spark, **kw), NOW).collect()
    assert len(rows) == 3 and [r.condition_id for r in rows if r.is_firing] == firing
    assert all((r.title is not None) == r.is_firing for r in rows)


def test_dispatch_cadence(spark):
    evaluated = conditions(source_state(spark, failures=3), NOW)
    state = lambda fired, last: spark.createDataFrame(
        [("s1", "sync_failures:fitbit", ts(fired), last), ("s1", "auth_expired:fitbit", ts(fired), last)], schemas.NOTIFICATION_STATE)
    actions = lambda s: {r.condition_id.split(":")[0]: r.action for r in dispatch(evaluated, s, NOW).collect()}
    assert actions(state("2026-06-29T12:00:01Z", "firing")) == {
        "sync_failures": "suppress", "auth_expired": "resolve", "frontier_stuck": "none"}
    assert actions(state("2026-06-29T12:00:00Z", "firing"))["sync_failures"] == "fire"
    assert actions(state("2026-06-30T11:00:00Z", "resolved")) == {
        "sync_failures": "fire", "auth_expired": "none", "frontier_stuck": "none"}
    assert actions(state(None, "firing"))["sync_failures"] == "fire"
    d = dispatch(evaluated, state("2026-06-29T12:00:00Z", "firing"), NOW)
    assert log_entries(d).count() == 1
    assert sorted((r.condition_id, r.last_state, r.last_fired_at is None) for r in state_changes(d).collect()) == [
        ("auth_expired:fitbit", "resolved", True), ("sync_failures:fitbit", "firing", False)]
    assert notifications(log_entries(d), 1).count() == 1


def test_upserts(spark):
    schema = "k string, a bigint, b bigint"
    old = spark.createDataFrame([("x", 1, 1), ("y", 2, 2)], schema)
    new = spark.createDataFrame([("y", 9, None), ("z", 8, None)], schema)
    key = lambda df: sorted((r.k, r.a, r.b) for r in df.collect())
    assert key(replace_rows(old, new, ["k"])) == [("x", 1, 1), ("y", 9, None), ("z", 8, None)]
    assert key(merge_columns(old, new, ["k"], ["a"])) == [("x", 1, 1), ("y", 9, 2), ("z", 8, None)]


def test_verify_claims(spark):
    text = "Abdominal pain,\n unspecified  - R10.9. Order Date: 11/15/2026 and 3 May 2026"
    t = spark.createDataFrame([("d", text)], "archive_key string, text string")
    claims = [("d", "R10.9", "Abdominal pain, unspecified - R10.9"), ("d", " ", "R10.9"), ("d", "R10.9", "  "),
              ("d", "R10.9", "chest pain - R10.9"), ("d", "K64.8", "unspecified - R10.9"), ("zz", "R10.9", "R10.9")]
    rows = verify_claims(spark.createDataFrame(claims, "archive_key string, code string, quote string"), t)
    got = [(r.verified, r.reject_reason) for r in sorted(rows.collect(), key=lambda r: claims.index((r.archive_key, r.code, r.quote)))]
    assert got == [(True, None), (False, "empty code"), (False, "empty quote"), (False, "quote not in text"),
                   (False, "code not in quote"), (False, "quote not in text")]
    dates = [("2026-11-15", "Order Date: 11/15/2026"), ("2026-01-15", "Order Date: 11/15/2026"), ("2026-05-03", "3 May 2026"),
             ("2026-05-03", None), (None, None), ("2026-13-01", "3 May 2026"), ("2026-11-15", "Date: 11/15/2027")]
    frame = spark.createDataFrame([("d", *d) for d in dates], "archive_key string, document_date string, document_date_quote string")
    got = {(r.document_date, r.document_date_quote): r.verified for r in verify_dates(frame, t).collect()}
    assert [got[d] for d in dates] == [True, False, True, False, False, False, False]


def two_subjects(spark):
    """Both share a text; the second has more texts, which makes the terms rarer for it."""
    rows = [("s1", "d1", None, "colon biopsy of the colon"), ("s1", "d2", None, "a walk"), ("s2", "d1", None, "colon biopsy of the colon")]
    rows += [("s2", f"e{k}", None, f"another note number {k}") for k in range(5)]
    return spark.createDataFrame(rows, "subject_id string, archive_key string, title string, text string")


def test_search_of_two_subjects_equals_each_alone(spark):
    both = two_subjects(spark)
    query = Query(all_terms=["colon"], any_terms=["note", "biopsy"])
    for index in (False, True):
        def found(df):
            rows = search(df, query, postings=build_postings(df) if index else None, limit=1).collect()
            return sorted((r.subject_id, r.archive_key, round(r.score, 9), r.snippet) for r in rows)

        assert found(both) == sorted(found(both.where("subject_id = 's1'")) + found(both.where("subject_id = 's2'")))
        assert len(found(both)) == 2


def test_catalog_detail_and_claims_of_two_subjects(spark):
    both = two_subjects(spark)
    d = both.select(
        "subject_id", "archive_key", F.col("subject_id").alias("kind"), F.lit("x").alias("source"), F.lit(None).cast("date").alias("document_date"),
        F.lit("2024-01-01").cast("timestamp").alias("archived_at"), F.lit("f").alias("original_filename"))
    newest = catalog(both, d, limit=2).collect()
    assert [(r.subject_id, r.archive_key, r.kind) for r in newest] == [("s1", "d2", "s1"), ("s1", "d1", "s1"), ("s2", "e4", "s2"), ("s2", "e3", "s2")]
    problems = spark.createDataFrame(
        [("s1", "d1", 0, "sys", "c1", "one", None, None), ("s2", "d1", 0, "sys", "c2", "two", None, None)],
        "subject_id string, archive_key string, seq long, coding_system string, coding_code string, coding_display string, onset_date date, section_label string")
    detail = {r.subject_id: (r.kind, [c.coding_code for c in r.codings]) for r in narrative(both, d, problems, "d1").collect()}
    assert detail == {"s1": ("s1", ["c1"]), "s2": ("s2", ["c2"])}
    claims = spark.createDataFrame([("s1", "d1", "colon", "of the colon"), ("s1", "e1", "note", "another note")],
                                   "subject_id string, archive_key string, code string, quote string")
    assert sorted((r.archive_key, r.verified) for r in verify_claims(claims, both).collect()) == [("d1", True), ("e1", False)]


def test_notifications_of_each_subject(spark):
    log = spark.createDataFrame([("s1", "c", k) for k in range(4)] + [("s2", "c", k) for k in range(4)], "subject_id string, condition_id string, fired_at long")
    assert [(r.subject_id, r.fired_at) for r in notifications(log, 2, ["subject_id"]).collect()] == [("s1", 3), ("s1", 2), ("s2", 3), ("s2", 2)]
    assert notifications(log, 3).count() == 3


def test_rows_of_a_document_that_two_subjects_have(spark):
    from tidemark.sources.tables import day_state_list, observations_of_document

    rows = spark.createDataFrame([("s2", "d", 2, 1), ("s1", "d", 3, 0), ("s2", "d", 1, 0), ("s1", "x", 1, 0)], "subject_id string, archive_key string, effective_start long, seq long")
    assert [(r.subject_id, r.effective_start) for r in observations_of_document(rows, "d").collect()] == [("s1", 3), ("s2", 1), ("s2", 2)]
    days = spark.createDataFrame([("s1", "a", 2), ("s2", "a", 1), ("s1", "a", 1), ("s1", "b", 0)], "subject_id string, source_name string, date long")
    assert [(r.subject_id, r.date) for r in day_state_list(days, "a").collect()] == [("s1", 1), ("s1", 2), ("s2", 1)]
