import datetime as dt
import hashlib
import json
import tempfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import fixtures_clinical as fx
from helpers import ts
from tidemark import schemas
from tidemark.functions.clinical import STAGE_SYSTEM, coding_definitions
from tidemark.plans.observations import with_labels
from tidemark.plans import rebuild as plan
from tidemark.plans.rebuild import parse_blobs
from tidemark.plans.table import aligned_table
from tidemark.sources import archive as A
from tidemark.sources import clinical_scan, tables
from tidemark.specs import Coding, Column, EpisodeSpec

BLOBS = """subject_id string, archive_key string, content binary, kind string, source string,
    manifest_subject string, archived_at timestamp, original_filename string, has_manifest boolean"""


def blob(text, kind, source="s", subject=None, at="2026-06-28T12:00:00Z", manifest=True):
    data = text if isinstance(text, bytes) else text.encode()
    return ("s1", hashlib.sha256(data).hexdigest(), data, kind, source, subject, ts(at), None, manifest)


def rebuild(blobs, derived=None, stage_path=None):
    """Parsed rows are staged, so that a test that reads several tables parses once."""
    return plan.rebuild(blobs, derived, stage_path=stage_path or tempfile.mkdtemp(prefix="stage-"))


def test_unstaged_rebuild_gives_the_same_rows(spark):
    blobs = frame(spark, blob(fx.SAMPLE, "ccda"), hr_day(beats(("2026-06-22T12:00:00Z", 72)), "2026-06-22T13:00:00Z"))
    lazy, staged = plan.rebuild(blobs), rebuild(blobs)
    for name in ("observations", "source_documents"):
        assert sorted(map(str, lazy[name].collect())) == sorted(map(str, staged[name].collect()))


def parses(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("from_xml(")


def test_tables_of_an_unstaged_rebuild_parse_a_document_once(spark):
    doc = blob(fx.SAMPLE, "ccda")
    cites = blob(citing(doc[1]), A.EXTRACTION, "derived")
    plain, main = plan.rebuild(frame(spark, doc)), plan.rebuild(frame(spark, doc, cites))
    derived = plan.rebuild(frame(spark, doc), frame(spark, cites))
    assert plain["tally"].collect() == rebuild(frame(spark, doc))["tally"].collect()
    assert plain["narrative_texts"].columns == main["narrative_texts"].columns
    # the branches of source documents are of different kinds: days twice, sessions, documents
    assert {n: parses(plain[n]) for n in ("source_documents", "problems", "tally")} == {"source_documents": 4, "problems": 1, "tally": 1}
    for name in ("source_documents", "problems", "tally"):
        assert parses(main[name]) == parses(derived[name]) == 0  # read from the stored rows
    for given, staged in ((plain, rebuild(frame(spark, doc))), (main, rebuild(frame(spark, doc, cites)))):
        for name in ("source_documents", "problems"):
            assert given[name].schema == staged[name].schema
            assert sorted(map(str, given[name].collect())) == sorted(map(str, staged[name].collect()))
    assert [str(r.document_date) for r in main["source_documents"].collect()] == ["2026-03-04"]
    assert sorted(r.coding_code for r in main["problems"].collect()) == ["195967001", "J45"]


def test_times_are_read_once_and_rows_formed_for_their_own_table(spark):
    t = plan.rebuild(frame(spark, blob(fx.SAMPLE, "ccda")))
    shown = t["medications"]._jdf.queryExecution().optimizedPlan().toString()
    # vitals and results decide whether the document counts, which takes their times; their values are not formed
    assert shown.count(", ^[0-9]{8}$)") == 2 and "IVL_PQ" not in shown and "IVL_TS" in shown
    # the text is searched for its root tag once, in a branch of its kind
    assert shown.count("regexp_extract(CASE WHEN") == 1
    assert [tuple(r)[2:] for r in t["medications"].collect()] == [
        (0, "http://www.nlm.nih.gov/research/umls/rxnorm", "745679", "745679 name", "active", "2 puff", "Inhaled",
         None, "2019-03-10", None)]


PLAIN = fx.SAMPLE.replace("<!-- <not-a-root> -->\n", "")


def test_plain_documents_are_read_without_building_their_elements(spark):
    shown = plan.rebuild(frame(spark, blob(PLAIN, "ccda")))["medications"]._jdf.queryExecution().optimizedPlan().toString()
    assert "concat(<x>, substr(" in shown  # the reader sees a plain text below a root outside its schema
    odd = (fx.SAMPLE, PLAIN.replace("61.25", "&#54;1.25"), PLAIN.replace("<section>", "<Section>").replace("</section>", "</Section>"),
           PLAIN.replace("61.25", "6 > 1"), PLAIN + "<x/>", PLAIN[:-20], PLAIN.replace('unit="kg"', 'unit="kg" x:unit="g"'), None, "", "<")
    scanned = clinical_scan.scan_texts(pa.array([PLAIN, *odd, PLAIN])).to_pylist()
    assert [r["plain"] for r in scanned] == [True, *(False for _ in odd), True]
    assert scanned[0]["time"] == "20260101233000-0500" and scanned[0]["start"] == len('<?xml version="1.0" encoding="UTF-8"?>\n')
    assert scanned[-1]["vitals"] == [{"code": "29463-7", "oid": fx.LOINC, "display": "29463-7 name", "time": "20260101120000+0000",
                                      "kind": "PQ", "number": "61.25", "unit": "kg", "txt": None}]
    shape = spark.createDataFrame([], schemas.CLINICAL_DOCUMENT).schema
    children = lambda t: {f.name: children(f.dataType.elementType) for f in t.fields if f.name[0] != "_" and f.dataType.typeName() == "array"}
    assert children(shape) == clinical_scan.TREE


def test_plain_and_other_documents_give_the_same_rows(spark):
    tr = '<translation value="63"><originalText>mg/dL</originalText></translation>'
    values = (
        fx.pq(1), fx.pq("many"), f'<value xsi:type="PQ" nullFlavor="OTH">{tr}</value>', f'<value xsi:type="PQ"><translation/>{tr}</value>',
        f'<value xsi:type="PQ"><originalText>own</originalText>{tr}</value>', '<value xsi:type="PQ" value="1"><originalText>own</originalText></value>',
        '<value xsi:type="IVL_PQ">\n<low value="5" unit="mg"/><high value="7.5"/></value>', '<value xsi:type="CD" code="A"/>',
        "<value>a b</value>", "<value></value>", "<value> </value>", "<value/>", '<value xsi:type="ST">é</value><value xsi:type="PQ" value="2"/>', "")
    seen = fx.observation(fx.pq(3))
    docs = [fx.document(fx.section("30954-2", fx.panel(fx.observation(v)), f"<entry>{fx.observation(v)}</entry>", fx.panel(seen, seen))) for v in values]
    vital, ill, drug = fx.section("8716-3", fx.panel(seen)), fx.section("11450-4", fx.problem("1")), fx.section("10160-0", fx.medication("7"))
    second = "<component><structuredBody>" + vital + "</structuredBody></component></ClinicalDocument>"
    docs += [
        fx.document(vital, ill, drug, vital, fx.section("0", fx.panel(seen))), fx.document(vital.replace("</section>", f"</section>{drug[11:-12]}")),
        fx.document(drug).replace("</ClinicalDocument>", second), fx.document(), fx.document(ill).replace('"CD"', "'CD'"),
        fx.document(fx.section("11450-4", fx.problem("1", status=None))), fx.document(vital).replace("effectiveTime", "time"),
        fx.document(vital).replace("<section>", f"<section>{fx.code('30954-2')}"), fx.document(vital, drug)[:-9] + "\n</Document>",
        fx.document(fx.section("10160-0", fx.medication("7", '\n<high value="20200101"/><low value="2019"/>')))]
    plain = [d.replace("<!-- <not-a-root> -->\n", "") for d in docs]
    odd = [d.replace("<component>", "<!-- a comment --><component>", 1) for d in plain]
    scanned = clinical_scan.scan_texts(pa.array(plain + odd)).field("plain").to_pylist()
    assert sum(scanned[:len(docs)]) >= len(docs) - 3 and not any(scanned[len(docs):])
    shown = ("reject_reason", "document_date", "observations", "problems", "medications")
    rows = {r.archive_key: tuple(r[c] or None for c in shown) for r in parse_blobs(frame(spark, *(blob(t, "ccda") for t in plain + odd))).collect()}
    for p, o in zip(plain, odd):
        assert rows[blob(p, "ccda")[1]] == rows[blob(o, "ccda")[1]], p


def citing(key):
    coding = {"system": "s", "code": "J45", "display": "d", "quote": "q", "section_label": "l"}
    return json.dumps({"document": key, "document_date": "2026-03-04", "title": "t", "codings": [coding],
                       "extractor": {"model": "m", "prompt_version": 1}, "extracted_at": "2026-03-05T00:00:00Z"})


def frame(spark, *blobs):
    return spark.createDataFrame(list(blobs), BLOBS)


def beats(*samples):
    return json.dumps([{"dataPoints": [
        {"heartRate": {"sampleTime": {"physicalTime": t}, "beatsPerMinute": b}} for t, b in samples]}])


def night(start, phases, **more):
    return json.dumps({"id": "n", "day": start[:10], "bedtime_start": start, "bedtime_end": start,
                       "type": "long_sleep", "sleep_phase_5_min": phases, **more})


def hr_day(text, at, day="2026-06-22"):
    return blob(text, A.HEART_RATE_DAY, "fitbit", day, at)


def test_clinical_document(spark):
    t = rebuild(frame(spark, blob(fx.SAMPLE, "ccda")))
    obs = t["observations"].orderBy("seq").collect()
    assert [(o.coding_code, o.value_quantity, o.value_unit, o.effective_start) for o in obs] == [
        ("29463-7", 61.25, "kg", dt.datetime(2026, 1, 1, 12)),
        ("2093-3", 188.0, "mg/dL", dt.datetime(2024, 5, 17, 9, 30)),
    ]
    p, = t["problems"].collect()
    assert (p.coding_system, p.coding_code, p.status, p.onset_date, p.section_label) == (
        "http://snomed.info/sct", "195967001", "completed", "2018-09-22", None)
    m, = t["medications"].collect()
    assert (m.coding_code, m.dose, m.route, m.frequency, m.start_date, m.end_date) == (
        "745679", "2 puff", "Inhaled", None, "2019-03-10", None)
    d, = t["source_documents"].collect()
    assert d.document_date == dt.date(2026, 1, 2)  # the UTC day


def results_of(spark, *values):
    doc = fx.document(fx.section("30954-2", *(fx.panel(fx.observation(v)) for v in values)))
    rows = rebuild(frame(spark, blob(doc, "ccda")))["observations"].orderBy("seq").collect()
    return [(r.value_quantity, r.value_string, r.value_unit) for r in rows]


def test_result_values(spark):
    tr = '<value xsi:type="PQ" nullFlavor="OTH"><translation value="63"><originalText> mg/dL (calc) </originalText></translation></value>'
    assert results_of(
        spark, tr,
        '<value xsi:type="IVL_PQ"><low value="5" unit="mg"/><high value="7.5" unit="mg"/></value>',
        '<value xsi:type="IVL_PQ"><high value="7" unit="g"/></value>',
        '<value xsi:type="IVL_PQ"><low value="7" unit="g"/><high value="7"/></value>',
        '<value xsi:type="CD" code="A" displayName="Positive"/>',
        '<value xsi:type="CD" code="A"/>',
        '<value xsi:type="ST">cloudy</value>',
        '<value xsi:type="TS" value="2020"/>',
        '<value xsi:type="PQ" nullFlavor="UNK"/>',
        "",
    ) == [
        (63.0, None, "mg/dL (calc)"), (None, "5-7.5 mg", None), (7.0, None, "g"), (7.0, None, "g"),
        (None, "Positive", None), (None, "A", None), (None, "cloudy", None), (None, None, None),
        (None, None, None), (None, None, None),
    ]


def test_direct_entry_results_and_nested_notes(spark):
    note = fx.observation('<value xsi:type="ST">note</value>', "nested")
    direct = f"<entry>{fx.observation(fx.pq(1), 'direct')[:-14]}<entryRelationship>{note}</entryRelationship></observation></entry>"
    doc = fx.document(fx.section("30954-2", direct))
    assert [r.coding_code for r in rebuild(frame(spark, blob(doc, "ccda")))["observations"].collect()] == ["direct"]


def test_rows_without_usable_code_are_skipped(spark):
    doc = fx.document(fx.section(
        "8716-3",
        fx.panel(fx.observation(fx.pq(1), oid="9.9"), "<observation><code nullFlavor='UNK'/></observation>",
                 "<observation classCode='OBS'/>", fx.observation(fx.pq(2), at="20260101")),
    ), fx.section("00000-0", fx.panel(fx.observation(fx.pq(3)))))
    rows = rebuild(frame(spark, blob(doc, "ccda")))["observations"].collect()
    assert [r.value_quantity for r in rows] == [2.0]


def test_rejected_documents(spark):
    def vit(o):
        return fx.document(fx.section("8716-3", fx.panel(o)))

    cases = {
        "not well-formed XML": fx.SAMPLE[:-20],
        "root element is not ClinicalDocument": "<other xmlns='urn:hl7-org:v3'><templateId/></other>",
        "root element is in another namespace": fx.SAMPLE.replace("urn:hl7-org:v3", "urn:x"),
        "root element has no templateId": fx.SAMPLE.replace('<templateId root="1.2"/>', ""),
        "missing or malformed effectiveTime": vit(fx.observation(fx.pq(1), at=None)),
        "quantity is not numeric": vit(fx.observation(fx.pq("many"))),
        "unsupported value type": vit(fx.observation('<value xsi:type="TS" value="1"/>')),
        "problem without status": fx.document(fx.section("11450-4", fx.problem("1", status=None))),
        "not valid UTF-8": b"\xff\xfe\xfa",
    }
    out = {r.archive_key: r.reject_reason
           for r in parse_blobs(frame(spark, *(blob(t, "ccda") for t in cases.values()))).collect()}
    got = {reason: out[blob(t, "ccda")[1]] for reason, t in cases.items()}
    assert got == {reason: reason for reason in cases}
    malformed_time = vit(fx.observation(fx.pq(1), at="202601011200"))
    assert parse_blobs(frame(spark, blob(malformed_time, "ccda"))).collect()[0].reject_reason


def test_prefixed_namespace(spark):
    text = fx.document(fx.section("8716-3", fx.panel(fx.observation(fx.pq(72.5)))))
    head, body = text.split("-->\n")
    body = body.replace("</", "\0").replace("<", "<h:").replace("\0", "</h:").replace('xmlns="', 'xmlns:h="')
    t = rebuild(frame(spark, blob(head + "-->\n" + body, "ccda")))
    assert [r.value_quantity for r in t["observations"].collect()] == [72.5]


def test_heart_rate_supersession(spark):
    first = beats(("2026-06-22T12:00:00.000Z", 72), ("2026-06-22T12:00:02.000Z", "75"))
    second = beats(("2026-06-22T12:00:04.000Z", 80.9), ("2026-06-22T12:00:00.000Z", 72), ("2026-06-22T12:00:02.000Z", 75))
    t = rebuild(frame(spark, hr_day(second, "2026-06-22T23:00:00Z"), hr_day(first, "2026-06-22T13:00:00Z")))
    obs = t["observations"].orderBy("effective_start").collect()
    assert [(o.value_quantity, (o.effective_end - o.effective_start).total_seconds()) for o in obs] == [
        (72.0, 2.0), (75.0, 2.0), (80.0, 60.0)]
    state, = t["source_day_state"].collect()
    assert (state.samples_count, state.samples_count_prev) == (3, 2)
    tally, = t["tally"].collect()
    assert (tally.blobs_found, tally.fitbit_ingested, tally.blobs_skipped) == (2, 2, 0)


def test_heart_rate_gap_rule_and_rejects(spark):
    good = beats(("2026-06-22T12:00:00Z", 1), ("2026-06-22T12:01:30Z", 2), ("2026-06-22T12:03:01Z", 3))
    t = rebuild(frame(
        spark, hr_day(good, "2026-06-22T13:00:00Z"),
        hr_day(beats(("yesterday", 1)), "2026-06-23T13:00:00Z", "2026-06-23"),
        hr_day(beats(("2026-06-22T12:00:00Z", "fast")), "2026-06-23T13:00:00Z", "2026-06-24"),
        hr_day('{"dataPoints": []}', "2026-06-23T13:00:00Z", "2026-06-25"),
        hr_day("[{}]", "2026-06-23T13:00:00Z", "2026-06-26"),
        hr_day(good + " ", "2026-06-23T13:00:00Z", None),
    ))
    lengths = [(o.effective_end - o.effective_start).total_seconds()
               for o in t["observations"].orderBy("effective_start").collect()]
    assert lengths == [90.0, 60.0, 60.0]
    assert sorted(r.reject_reason for r in t["rejects"].collect()) == [
        "invalid beats per minute", "invalid sample time", "manifest has no date", "not an array of pages"]
    assert t["source_documents"].count() == 2  # a page without points is an empty day


def test_sleep_episodes(spark):
    t = rebuild(frame(
        spark,
        blob(night("2026-06-26T19:40:00-04:00", "21122112", total_sleep_duration=2400), A.SLEEP_SESSION, "oura"),
        blob(night("2026-06-27T19:00:00-04:00", "223122"), A.SLEEP_SESSION, "oura"),
    ))
    deep = Column(Coding(STAGE_SYSTEM, "aasm-sleep-stage"), "duration_in_range", value_min=3, value_max=3)
    spec = EpisodeSpec(deep.coding)
    by = lambda **kw: [(r.bucket_key, r.value_0) for r in aligned_table(t["observations"], [deep], ordered=True, **kw).collect()]
    assert by(bucket="episode", episode=spec) == [("2026-06-26T23:40:00Z", 20.0), ("2026-06-27T23:00:00Z", 5.0)]
    assert by(bucket="day") == [("2026-06-26", 10.0), ("2026-06-27", 15.0)]
    nightly = t["observations"].where("coding_code = '93832-4'").collect()
    assert [n.value_quantity for n in nightly] == [40.0]
    assert t["source_day_state"].where("samples_count_prev is null").count() == 2


@pytest.mark.parametrize("phases,minutes", [("4424421144", 10.0), ("2222", 0.0), ("4444", None), ("", None)])
def test_wake_after_onset(spark, phases, minutes):
    t = rebuild(frame(spark, blob(night("2026-06-26T22:00:00Z", phases), A.SLEEP_SESSION, "oura")))
    got = [r.value_quantity for r in t["observations"].where("coding_code = '103215-0'").collect()]
    assert got == ([] if minutes is None else [minutes])


def test_naps_and_bad_letters(spark):
    nap = night("2026-06-26T22:00:00Z", "22", type="late_nap", total_sleep_duration=600)
    t = rebuild(frame(spark, blob(nap, A.SLEEP_SESSION), blob(night("2026-06-27T22:00:00Z", "29"), A.SLEEP_SESSION)))
    assert t["observations"].count() == 2
    assert [r.reject_reason for r in t["rejects"].collect()] == ["unknown stage letter"]


def test_value_labels(spark):
    t = rebuild(frame(spark, blob(night("2026-06-26T22:00:00Z", "1234"), A.SLEEP_SESSION)))
    got = with_labels(t["observations"].where("coding_code = 'aasm-sleep-stage'")).orderBy("effective_start").collect()
    assert [(r.value_string, r.value_label) for r in got] == [
        ("n3", "deep / slow-wave sleep (N3)"), ("n2", "light sleep (N2)"), ("rem", "REM"), ("wake", "awake")]
    definition, = coding_definitions(spark).collect()
    assert len(definition["values"]) == 5 and definition["values"][0].value_string == "wake"


NARRATIVE = "Order Date: 04/21/2026. Abdominal pain, unspecified - R10.9. Other hemorrhoids - K64.8. No dysplasia."


def artifact(key, at, codes=("R10.9", "K64.8"), date="2026-04-21", title="Report"):
    body = {"document": key, "document_date": date, "title": title,
            "codings": [{"system": "icd", "code": c, "display": c, "quote": c, "section_label": "Dx"} for c in codes],
            "extractor": {"model": "m", "prompt_version": 2}, "extracted_at": at}
    return blob(json.dumps(body), A.EXTRACTION, at=at)


def test_artifacts(spark):
    doc = blob(NARRATIVE, A.NARRATIVE, subject="2026-01-01")
    derived = frame(
        spark,
        artifact(doc[1], "2026-07-01T00:00:00Z", codes=("OLD",)), artifact(doc[1], "2026-07-02T00:00:00Z"),
        artifact("0" * 64, "2026-07-02T00:00:00Z"), blob("{}", A.EXTRACTION),
        blob(fx.SAMPLE, "ccda"), blob(fx.SAMPLE + " ", "ccda", manifest=False),
    )
    t = rebuild(frame(spark, doc), derived)
    assert sorted((p.coding_code, p.status, p.onset_date, p.section_label) for p in t["problems"].collect()) == [
        ("K64.8", "unknown", "2026-04-21", "Dx"), ("R10.9", "unknown", "2026-04-21", "Dx")]
    d, = t["source_documents"].collect()
    assert d.document_date == dt.date(2026, 4, 21)
    n, = t["narrative_texts"].collect()
    assert (n.title, n.text) == ("Report", NARRATIVE)
    tally, = t["tally"].collect()
    # skipped: malformed artifact, two foreign blobs in the derived store, one orphan
    assert (tally.blobs_found, tally.narratives_ingested, tally.extractions_applied, tally.blobs_skipped) == (7, 1, 1, 4)


def test_archive_files_and_staged_rebuild(spark, tmp_path):
    root = tmp_path / "archive"
    for who in ("a", "b"):
        folder = root / f"subject_id={who}"
        folder.mkdir(parents=True)
        text = beats(("2026-06-22T12:00:00Z", 72))
        key = hashlib.sha256(text.encode()).hexdigest()
        (folder / key).write_text(text)
        (folder / f"{key}.meta.json").write_text(json.dumps({
            "specversion": "1.0", "id": key, "source": "fitbit", "type": A.HEART_RATE_DAY, "datacontenttype": "application/json",
            "subject": "2026-06-22", "time": "2026-06-22T13:00:00Z"}, indent=1))
        legacy = hashlib.sha256(fx.SAMPLE.encode()).hexdigest()
        (folder / legacy).write_text(fx.SAMPLE)
        (folder / "notes.txt").write_text("ignored")
    blobs = A.scan_archive(spark, str(root))
    assert blobs.count() == 4
    t = rebuild(blobs, stage_path=str(tmp_path / "stage"))
    out = {k: v for k, v in t.items() if k in tables.TABLES}
    tables.write_tables(out, str(tmp_path / "silver"))
    obs = tables.read_table(spark, str(tmp_path / "silver"), "observations")
    assert obs.groupBy("subject_id").count().orderBy("subject_id").collect() == [("a", 3), ("b", 3)]
    docs = tables.read_table(spark, str(tmp_path / "silver"), "source_documents")
    assert docs.where("source = 'rebuild'").count() == 2
    assert sorted(r.original_filename or "" for r in docs.collect()) == ["", "", "fitbit-hr-2026-06-22.json"] + ["fitbit-hr-2026-06-22.json"]
    key = docs.where("source = 'rebuild'").first().archive_key
    assert tables.observations_of_document(obs, key).count() == 4
    assert tables.problems_of_document(out["problems"], key).count() == 2
    assert tables.medications_of_document(out["medications"], key).count() == 2


def test_new_blobs(spark):
    rows = [("s1", f"p{i}", text.encode()) for i, text in enumerate(("a", "b", "a", "c", "a"))]
    incoming = spark.createDataFrame(rows, "subject_id string, path string, content binary")
    stored = spark.createDataFrame([("s1", hashlib.sha256(b"c").hexdigest())], "subject_id string, archive_key string")
    got = A.new_blobs(incoming, stored, "path").orderBy("path").collect()
    assert [(r.path, r.archive_key) for r in got] == [
        ("p0", hashlib.sha256(b"a").hexdigest()), ("p1", hashlib.sha256(b"b").hexdigest())]
    groups = A.copy_groups(incoming, "content", "path")
    assert sorted(r.copies for r in groups.collect()) == [1, 1, 3]


def test_a_blob_given_twice_counts_once(spark):
    day = hr_day(beats(("2026-06-22T12:00:00Z", 72)), "2026-06-22T13:00:00Z")
    later = (*day[:6], ts("2026-06-25T00:00:00Z"), *day[7:])
    doc = blob(fx.SAMPLE, "ccda")
    once, twice = rebuild(frame(spark, doc, day)), rebuild(frame(spark, doc, doc, day, later, doc))
    for name in ("observations", "source_documents", "problems", "medications", "source_day_state", "tally"):
        assert sorted(map(str, once[name].collect())) == sorted(map(str, twice[name].collect())), name
    assert twice["tally"].first().blobs_found == 2 and twice["observations"].count() == 3
