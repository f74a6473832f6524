"""More registered queries: lists, lookups, state and checks of claims, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import dedup
from tidemark.plans import alerts, observations as O, rebuild as R, search as S
from tidemark.plans.stats import stats
from tidemark.sources import narrative, tables
from tidemark.streaming import ingest, sessions, state
from workload import standins as d
from workload.queries import DAY_STATE, DOW, EP, LOCAL, NY, OBS, TOKENS, count_of, micros, register, rnd, rounded


def _texts_of_subjects(spark, sf):
    """Documents as narratives of the subject that their language names."""
    docs = d.table(spark, sf, "documents")
    return docs.select(F.coalesce("lang", F.lit("none")).alias("subject_id"), "doc_id", "text")


@register(f"""WITH {TOKENS}, tk AS (SELECT coalesce(lang, 'none') AS subject_id, tok.doc_id, t, len(t) AS len, {count_of('the')} AS u0, {count_of('la')} AS u1, {count_of('und')} AS u2
      FROM tok JOIN documents USING (doc_id)),
    facts AS (SELECT subject_id, count(*) AS n, avg(len) AS mean, count(*) FILTER (u0 > 0) AS d0, count(*) FILTER (u1 > 0) AS d1, count(*) FILTER (u2 > 0) AS d2
      FROM tk GROUP BY ALL),
    scored AS (SELECT tk.*, -({' + '.join(
        f"CASE WHEN u{i} > 0 THEN (CASE WHEN ln((n - d{i} + 0.5) / (d{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - d{i} + 0.5) / (d{i} + 0.5)) END) * u{i} * 2.2"
        f" / (u{i} + 1.2 * (0.25 + 0.75 * len / mean)) ELSE 0 END" for i in range(3))}) AS s FROM tk JOIN facts USING (subject_id) WHERE u0 + u1 + u2 > 0),
    best AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY s, doc_id) AS rn FROM scored)
    SELECT subject_id, doc_id, lang AS kind, source, CAST(CASE WHEN doc_id % 7 <> 0 THEN CAST(DATE '2024-01-01' + CAST(doc_id % 365 AS INT) AS DATE) END AS VARCHAR) AS document_date,
      {rnd('s', 'score')} FROM best JOIN documents USING (doc_id) WHERE rn <= 10""")
def search_by_subject(spark, sf):
    """Each subject's ten best texts, ranked by that subject's own term statistics, with document columns."""
    texts = _texts_of_subjects(spark, sf)
    docs = d.text_documents(spark, sf).withColumn("subject_id", F.coalesce("kind", F.lit("none")))
    found = S.search(texts, S.Query(any_terms=["the", "la", "und"]), docs=docs, doc="doc_id", limit=10)
    return rounded(found.select("subject_id", "doc_id", "kind", "source", F.col("document_date").cast("string"), "score"))


@register("""WITH c AS (SELECT doc_id, string_agg(c, ',' ORDER BY s) AS codes FROM (
      SELECT doc_id, 0 AS s, concat('quality-', quality) AS c FROM labels UNION ALL SELECT doc_id, 1, concat('toxic-', toxic) FROM labels) GROUP BY ALL)
    SELECT doc_id // 10 AS subject_id, lang AS kind, source, length(text) AS n_chars, coalesce(codes, '') AS codes
    FROM documents LEFT JOIN c USING (doc_id) WHERE doc_id % 10 = 3""")
def narrative_detail(spark, sf):
    """One key looked up in every subject's narratives: text, metadata and codings."""
    key = lambda df: df.withColumns({"subject_id": F.floor(F.col("doc_id") / 10), "archive_key": (F.col("doc_id") % 10).cast("string")})
    texts = key(d.texts(spark, sf)).select("subject_id", "archive_key", F.lit(None).cast("string").alias("title"), "text")
    docs = key(d.text_documents(spark, sf)).withColumn("original_filename", F.lit("note"))
    labels = key(d.table(spark, sf, "labels"))
    entry = lambda n, name: F.struct(
        F.lit(n).alias("seq"), F.lit("urn:label").alias("coding_system"), F.concat(F.lit(f"{name}-"), F.col(name).cast("string")).alias("coding_code"),
        F.lit(name).alias("coding_display"), F.lit(None).cast("string").alias("onset_date"), F.lit("labels").alias("section_label"))
    problems = labels.select("subject_id", "archive_key", F.inline(F.array(entry(0, "quality"), entry(1, "toxic"))))
    out = S.narrative(texts, docs, problems, "3")
    return out.select("subject_id", "kind", "source", F.length("text").cast("bigint").alias("n_chars"), F.array_join("codings.coding_code", ",").alias("codes"))


@register(f"""WITH {OBS}, r AS (SELECT subject_id, concat_ws('-', 'c', event_id) AS condition_id, epoch_us(ts) AS fired_at,
      row_number() OVER (PARTITION BY subject_id ORDER BY ts DESC, concat_ws('-', 'c', event_id) DESC) AS rn FROM obs WHERE code = 'error')
    SELECT subject_id, condition_id, fired_at FROM r WHERE rn <= 5""")
def notification_list_by_subject(spark, sf):
    log = O.select_codings(d.observations(spark, sf), [d.ERROR]).select(
        "subject_id", F.concat_ws("-", F.lit("c"), "seq").alias("condition_id"), F.col("effective_start").alias("fired_at"))
    return micros(alerts.notifications(log, 5, ["subject_id"]), "fired_at")


@register(f"""WITH {OBS} SELECT subject_id, {DOW.format(LOCAL.format('ts'))} AS bucket_key, CAST(isodow({LOCAL.format('ts')}) - 1 AS BIGINT) AS bucket_sort,
    count(*) AS "count", 'confirmed' AS confidence FROM obs WHERE code = 'purchase' GROUP BY ALL""")
def stats_bucket_order(spark, sf):
    """Weekdays with the number that orders them and the label of certainty."""
    out = stats(d.observations(spark, sf), d.PURCHASE, bucket="day_of_week", tz=NY)
    return out.select("subject_id", "bucket_key", "bucket_sort", "count", "confidence")


@register(f"WITH {DAY_STATE} SELECT subject_id, CAST(day AS VARCHAR) AS date, n AS samples_count, epoch_us(pulled_at) AS last_pulled_at FROM state WHERE source = 'oura'")
def day_state_list(spark, sf):
    out = tables.day_state_list(d.day_state(spark, sf), "oura")
    return micros(out.select("subject_id", F.col("date").cast("string"), "samples_count", "last_pulled_at"), "last_pulled_at")


@register(f"WITH {DAY_STATE} SELECT subject_id, source, count(DISTINCT day) AS days_synced, CAST(sum(morning + total) AS BIGINT) AS total_samples FROM pulled GROUP BY ALL")
def sync_tally(spark, sf):
    return ingest.sync_tally(d.pulls(spark, sf))


OUTCOME_STATE = """before AS (SELECT DISTINCT subject_id, source FROM obs WHERE subject_id % 3 <> 0)"""


def _source_rows(spark, sf):
    """Every user's sources but those of each third user, with two failures on record."""
    obs = d.observations(spark, sf).where("subject_id % 3 <> 0").select(
        "subject_id", d.source_of(F.col("coding_code")).alias("source_name")).distinct()
    known = {"subject_id", "source_name", "consecutive_sync_failures"}
    fields = [f for f in spark.createDataFrame([], schemas.SOURCE_STATE).schema.fields]
    rows = obs.withColumn("consecutive_sync_failures", F.lit(2).cast("bigint"))
    return rows.select(*(F.col(f.name) if f.name in known else F.lit(None).cast(f.dataType).alias(f.name) for f in fields))


@register(f"""WITH {OBS}, {OUTCOME_STATE}, ends AS (SELECT subject_id, source, max(ts) FILTER (code <> 'error') AS ok_at,
      arg_max({{'at': ts, 'ok': code <> 'error', 'm': concat('e', event_id)}}, {{'at': ts, 'ok': code <> 'error'}}) AS l FROM obs GROUP BY ALL),
    errors AS (SELECT o.subject_id, o.source, count(*) FILTER (code = 'error' AND (ok_at IS NULL OR ts > ok_at)) AS n FROM obs o JOIN ends USING (subject_id, source) GROUP BY ALL)
    SELECT subject_id, source AS source_name, epoch_us(l.at) AS last_sync_at, CASE WHEN l.ok THEN 'success' ELSE 'error' END AS last_sync_status,
      coalesce(CASE WHEN NOT l.ok THEN l.m END, '') AS last_error_message,
      CAST(n + CASE WHEN ok_at IS NULL AND subject_id % 3 <> 0 THEN 2 ELSE 0 END AS BIGINT) AS consecutive_sync_failures
    FROM ends JOIN errors USING (subject_id, source)""")
def fold_outcomes(spark, sf):
    """Errors count as failed syncs, all other events as good ones."""
    obs = d.observations(spark, sf)
    outcomes = obs.select(
        "subject_id", d.source_of(F.col("coding_code")).alias("source_name"), F.col("effective_start").alias("at"), (F.col("coding_code") != "error").alias("ok"),
        F.concat(F.lit("e"), F.col("seq").cast("string")).alias("error_message"), F.lit(None).cast("string").alias("error_reason"))
    out = state.fold_outcomes(_source_rows(spark, sf), outcomes)
    return micros(out.select(
        F.col("subject_id").cast("bigint"), "source_name", "last_sync_at", "last_sync_status",
        F.coalesce("last_error_message", F.lit("")).alias("last_error_message"), "consecutive_sync_failures"), "last_sync_at")


@register(f"""WITH {OBS}, old AS (SELECT subject_id, source, max(ts) AS f FROM obs WHERE ts < '2024-01-15' GROUP BY ALL),
    new AS (SELECT subject_id, source, max(ts) AS f FROM obs WHERE ts >= '2024-01-10' AND ts < '2024-01-20' GROUP BY ALL)
    SELECT subject_id, source AS source_name, epoch_us(greatest(old.f, new.f)) AS freshness_frontier_at,
      coalesce(new.f IS NOT NULL AND (old.f IS NULL OR new.f > old.f), false) AS moved FROM old FULL JOIN new USING (subject_id, source)""")
def frontier_advance(spark, sf):
    """The frontier before the 15th, moved by the samples of the 10th to the 19th."""
    obs = d.observations(spark, sf).withColumn("source_name", d.source_of(F.col("coding_code")))
    at = F.col("effective_start")
    known = obs.where(at < F.lit("2024-01-15").cast("timestamp")).groupBy("subject_id", "source_name").agg(F.max(at).alias("freshness_frontier_at"))
    known = known.withColumns({"frontier_last_advanced_at": F.lit(None).cast("timestamp"), "consecutive_sync_failures": F.lit(0).cast("bigint")})
    pulled = obs.where(at.between(F.lit("2024-01-10").cast("timestamp"), F.lit("2024-01-19 23:59:59.999999").cast("timestamp")))
    out = state.advance_frontier(known, pulled.select("subject_id", "source_name", at.alias("newest_sample")), d.NOW)
    return micros(out.select("subject_id", "source_name", "freshness_frontier_at", F.col("frontier_last_advanced_at").isNotNull().alias("moved")), "freshness_frontier_at")


@register(f"WITH {EP} SELECT subject_id, epoch_us(s) AS episode_start, epoch_us(e) AS episode_end FROM ep")
def episodes_by_session_windows(spark, sf):
    """The streamed form of episodes over a table: session windows whose gap is a row's own length."""
    rows = O.select_codings(d.intervals(spark, sf), [d.VIEW])
    return micros(sessions.episode_stream(rows, 7200), "episode_start", "episode_end")


@register("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN upper(lang) ELSE lang END AS lang, CASE WHEN doc_id % 4 = 0 THEN 1 ELSE n_chars END AS n_chars FROM documents""")
def narrative_replace(spark, sf):
    """Documents given again replace their stored rows by key."""
    stored = d.table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    again = stored.where("doc_id % 4 = 0").select("doc_id", F.upper("lang").alias("lang"), F.lit(1).cast(stored.schema["n_chars"].dataType).alias("n_chars"))
    return dedup.replace_rows(stored, again, ["doc_id"])


@register("""SELECT CAST(l_orderkey AS VARCHAR) AS subject_id, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS document_date, 'ccda' AS kind FROM lineitem""")
def document_dates(spark, sf):
    """The date that each clinical document states."""
    out = R.rebuild(d.clinical_blobs(spark, sf))["source_documents"]
    return out.select("subject_id", F.col("document_date").cast("string"), "kind")


@register("""WITH m AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, o_orderkey % 6 AS form FROM orders)
    SELECT o_orderkey AS archive_key, CAST(CASE WHEN form = 5 THEN day + 1 ELSE day END AS VARCHAR) AS document_date, form <> 5 AND form <> 4 AS verified,
      CASE WHEN form IN (4, 5) THEN 'quote not in text or date not in quote' END AS reject_reason FROM m""")
def verify_date_claims(spark, sf):
    """Dates written in several spellings; a sixth of them within a longer number, a sixth of the claims a day off."""
    day, form = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 6
    patterns = ("yyyy-MM-dd", "MM/dd/yyyy", "MMMM d, yyyy", "d MMMM yyyy")
    spelled = F.coalesce(*(F.when(form == k, F.date_format(day, p)) for k, p in enumerate(patterns)), F.when(form == 4, F.concat(F.lit("7"), F.date_format(day, "yyyy-MM-dd"), F.lit("1"))),
                         F.date_format(day, "yyyy-MM-dd"))
    orders = d.table(spark, sf, "orders").select(F.col("o_orderkey").alias("archive_key"), day.alias("_day"), form.alias("_form"), F.concat(F.lit("seen on "), spelled).alias("_quote"))
    texts = orders.select("archive_key", F.concat(F.lit("The patient was \n"), F.col("_quote"), F.lit(" in the clinic.")).alias("text"))
    claimed = F.when(F.col("_form") == 5, F.date_add("_day", 1)).otherwise(F.col("_day")).cast("string")
    out = narrative.verify_dates(orders.select("archive_key", claimed.alias("document_date"), F.col("_quote").alias("document_date_quote")), texts)
    return out.select("archive_key", "document_date", "verified", "reject_reason")


@register("""SELECT sha256(text) AS archive_key, 'ccda' AS kind, 'clinic' AS source, 1 AS given FROM documents""")
def clinical_rejects(spark, sf):
    """Plain texts given as clinical documents are all refused, each with a reason."""
    blobs = d.narrative_blobs(spark, sf).withColumns({"kind": F.lit("ccda"), "source": F.lit("clinic")})
    out = R.rebuild(blobs)["rejects"]
    return out.select("archive_key", "kind", "source", F.when(F.col("reject_reason") != "", 1).otherwise(0).alias("given"))


def _items_of_year(spark, sf):
    """Order lines as list entries of documents that a customer's orders of one year make up."""
    orders = d.table(spark, sf, "orders").select(F.col("o_orderkey").alias("archive_key"), F.year("o_orderdate").cast("string").alias("_year"))
    return d.order_items(spark, sf).join(orders, "archive_key").drop("archive_key").withColumnRenamed("_year", "archive_key")


ITEMS_OF_YEAR = """FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE year(o_orderdate) = 1996"""


@register(f"SELECT o_custkey AS subject_id, p_brand AS coding_code, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS onset_date, CAST(l_linenumber AS BIGINT) AS line {ITEMS_OF_YEAR}")
def problems_of_document(spark, sf):
    """A document key that all subjects share: each one's own entries."""
    out = tables.problems_of_document(_items_of_year(spark, sf), "1996")
    return out.select("subject_id", "coding_code", "onset_date", F.col("seq.l_linenumber").cast("bigint").alias("line"))


@register(f"SELECT o_custkey AS subject_id, p_brand AS coding_code, concat(CAST(l_quantity AS INT), ' mg') AS dose, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS start_date {ITEMS_OF_YEAR}")
def medications_of_document(spark, sf):
    out = tables.medications_of_document(_items_of_year(spark, sf), "1996")
    return out.select("subject_id", "coding_code", "dose", "start_date")
