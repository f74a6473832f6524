"""The numbered operators over whole tables, each with its DuckDB SQL where that can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    chat, chunked_bpe, cross_entropy, decontaminate, exact_dedup, ftrl, jaccard_join, langid, mixing, pii, token_alignment, token_counts, turn_repair,
)
from tidemark.llm.shared import sha256_hex, stored
from tidemark.session import send_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return send_package(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(n: int) -> Column:
    """crc32 of the id as text, modulo n: it deals rows to training and held-out parts."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def _lower(column: str) -> str:
    return f"translate(coalesce({column}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP1_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_lower("text")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s AS a JOIN s AS b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM shared JOIN n AS nx ON x = nx.doc_id JOIN n AS ny ON y = ny.doc_id WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT doc_id, y FROM reach JOIN edges ON r = x)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r) AS component_id FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id"""


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"), keep_text=False)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        decontaminate.is_contaminated().alias("contaminated"))


OP2_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_lower("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_lower("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS k
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
found AS (
  SELECT doc_id, x.n, i, item
  FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)) AS x
  JOIN windows AS y ON x.n = y.n AND x.k = y.k),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)"""


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))

    def number_of(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(number_of, pii.KINDS), F.sha2(pii.as_text("base").cast("binary"), 256).alias("base_sha256"), pii.as_text("spans").alias("spans"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, path, keep_text=False).withColumn("over_limit", F.col("n_tokens") > 512)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(remainder(4) != 2))
    found = langid.identify(docs.select("doc_id", "text"), model, keep_text=False)
    return found.select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    model = ftrl.fit(docs, labels.filter(remainder(5) != 0))
    return ftrl.score(docs, model, keep_text=False).select(
        "doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts are control strings, formatted and read back."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat.read_back(chat.format_segments(given.union(extra)))


OP6_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (
  SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text), '') AS before,
    lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS NULL AS is_last,
    len(regexp_extract_all(role, '{chat.CHAT.pattern}')) + len(regexp_extract_all(text, '{chat.CHAT.pattern}')) AS escapes
  FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + length(text) + escapes + {len(chat.CHAT.open + chat.CHAT.middle + chat.CHAT.close)}) AS BIGINT) AS formatted_chars,
  bool_and(CASE WHEN before = '' THEN role IN ('system', 'user') WHEN before IN ('system', 'assistant') THEN role = 'user'
                WHEN before = 'user' THEN role = 'assistant' ELSE false END AND (NOT is_last OR role = 'assistant')) AS valid
FROM t GROUP BY conv_id"""


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


OP7_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t"""


def op8_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's loss difference, documents labelled good and not toxic being the target."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    target = table(spark, sf_dir, "labels").filter("quality = 1 and toxic = 0")
    return cross_entropy.score_counted(docs, target, keep_text=False)


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the mixture of sources, weighted by the root of their sizes."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "mix_slot", "mix_position")


OP9_SQL = f"""
WITH RECURSIVE weights AS (
  SELECT source, sqrt(count(*)) AS weight, count(*) OVER () AS n FROM documents GROUP BY source),
ideal AS (
  SELECT source, greatest({mixing.PERIOD}, 2 * n) AS period, n,
    (greatest({mixing.PERIOD}, 2 * n) - n) * (weight / sum(weight) OVER ()) AS x FROM weights),
ranked AS (
  SELECT source, period, floor(x) AS whole, period - n - sum(floor(x)) OVER () AS extra,
    row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, source NULLS FIRST) AS nth FROM ideal),
shares AS (
  SELECT source, CAST(1 + whole + CASE WHEN nth <= extra THEN 1 ELSE 0 END AS BIGINT) AS w, CAST(period AS BIGINT) AS period FROM ranked),
lists AS (SELECT list(w ORDER BY w, source) AS ws, list(source ORDER BY w, source) AS names, any_value(period) AS period FROM shares),
steps AS (
  SELECT 0::BIGINT AS slot, list_transform(ws, lambda w: 0::BIGINT) AS done, 0::BIGINT AS k, 0::BIGINT AS nth FROM lists
  UNION ALL
  SELECT slot + 1, list_transform(done, lambda d, i: CASE WHEN i = pick.k THEN d + 1 ELSE d END), pick.k, pick.nth
  FROM (
    SELECT slot, done, list_sort(list_filter(
      list_transform(ws, lambda w, i: {{'due': ((done[i] + 1) * period + w - 1) // w, 'share': -w, 'k': i, 'nth': done[i]}}),
      lambda c: c.nth + c.share < 0 AND (c.nth * period) // (-c.share) <= slot))[1] AS pick
    FROM steps, lists WHERE slot < period)),
timetable AS (SELECT names[k] AS source, nth, slot - 1 AS in_period FROM steps, lists WHERE slot > 0),
numbered AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS r FROM documents)
SELECT n.doc_id, n.source,
  ((r // {mixing.BLOCK}) // s.w) * s.period + t.in_period AS mix_slot,
  (((r // {mixing.BLOCK}) // s.w) * s.period + t.in_period) * {mixing.BLOCK} + r % {mixing.BLOCK} AS mix_position
FROM numbered n JOIN shares s ON n.source IS NOT DISTINCT FROM s.source
JOIN timetable t ON n.source IS NOT DISTINCT FROM t.source AND t.nth = (r // {mixing.BLOCK}) % s.w"""


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged by a rule and repaired; one row per conversation, those without rows left included."""
    given = table(spark, sf_dir, "conversations")
    broken = turn_repair.damage(given)
    plans = stored(turn_repair.plan_edits(broken), "edit-plans")
    digests = turn_repair.repaired(broken, plans, keep_turns=False).where(F.col("repaired_sha256").isNotNull())
    every = given.select("conv_id").unionByName(plans.drop("letters"), allowMissingColumns=True)
    every = every.unionByName(digests.select("conv_id", "repaired_sha256"), allowMissingColumns=True)
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return every.groupBy("conv_id").agg(
        *(F.coalesce(F.max(n), F.lit(0).cast("long")).alias(n) for n in numbers),
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


#: crc32 bit by bit, and a dynamic program from the last row to the first over (cost, audit) of the four states.
OP11_SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
crc AS (
  SELECT *, xor(list_reduce(
    list_transform(range(0, length(k) + 1), lambda i: CASE WHEN i = 0 THEN 4294967295 ELSE ascii(k[i]) END),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]),
      lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) % 20 AS kind FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
  FROM crc, (SELECT unnest([0, 1]) AS copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged),
firsts AS (SELECT conv_id, role, text, min(i) AS first_i FROM placed GROUP BY ALL),
numbered AS (
  SELECT p.*, i > first_i AS seen, rtrim(p.text, E' \t\n\x0B\x0C\r') AS stripped
  FROM placed AS p JOIN firsts AS f ON p.conv_id IS NOT DISTINCT FROM f.conv_id AND p.role = f.role AND p.text = f.text),
faults AS MATERIALIZED (
  SELECT *, CASE WHEN stripped = '' THEN 'b' WHEN seen THEN 'd' WHEN stripped[-1] NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
    role[1] AS c, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS c_before FROM numbered),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
    count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (i > 1 AND c_before || c NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM faults GROUP BY conv_id),
steps AS (
  SELECT conv_id, n AS i, {'c': 0::BIGINT, 'a': ''} AS f0, {'c': 6::BIGINT, 'a': 'II'} AS fs, {'c': 3::BIGINT, 'a': 'I'} AS fu, {'c': 0::BIGINT, 'a': ''} AS fa FROM counts
  UNION ALL
  SELECT conv_id, i,
    list_sort([g0, {'c': 3 + gu.c, 'a': 'I' || gu.a}, {'c': 6 + ga.c, 'a': 'II' || ga.a}])[1],
    list_sort([gs, {'c': 3 + gu.c, 'a': 'I' || gu.a}, {'c': 6 + ga.c, 'a': 'II' || ga.a}])[1],
    list_sort([gu, {'c': 3 + ga.c, 'a': 'I' || ga.a}])[1],
    list_sort([ga, {'c': 3 + gu.c, 'a': 'I' || gu.a}])[1]
  FROM (
    SELECT s.conv_id, s.i - 1 AS i,
      list_sort(list_filter([d0, CASE WHEN keep AND c = 's' THEN {'c': x + fs.c, 'a': 'K' || fs.a} WHEN keep AND c = 'u' THEN ku END, ru], lambda o: o IS NOT NULL))[1] AS g0,
      list_sort(list_filter([ds, CASE WHEN keep AND c = 'u' THEN ku END, ru], lambda o: o IS NOT NULL))[1] AS gs,
      list_sort(list_filter([du, CASE WHEN keep AND c = 'a' THEN {'c': x + fa.c, 'a': 'K' || fa.a} END,
        CASE WHEN keep THEN {'c': x + 3 + fa.c, 'a': 'R' || fa.a} END], lambda o: o IS NOT NULL))[1] AS gu,
      list_sort(list_filter([da, CASE WHEN keep AND c = 'u' THEN ku END, ru], lambda o: o IS NOT NULL))[1] AS ga
    FROM (
      SELECT t.*, f.c, fault NOT IN ('b', 'd') AS keep, CASE WHEN fault = 't' THEN 3 ELSE 0 END AS x,
        {'c': 4 + f0.c, 'a': 'D' || f0.a} AS d0, {'c': 4 + fs.c, 'a': 'D' || fs.a} AS ds,
        {'c': 4 + fu.c, 'a': 'D' || fu.a} AS du, {'c': 4 + fa.c, 'a': 'D' || fa.a} AS da,
        {'c': CASE WHEN fault = 't' THEN 3 ELSE 0 END + fu.c, 'a': 'K' || fu.a} AS ku,
        CASE WHEN fault NOT IN ('b', 'd') THEN {'c': CASE WHEN fault = 't' THEN 6 ELSE 3 END + fu.c, 'a': 'R' || fu.a} END AS ru
      FROM steps AS t JOIN faults AS f ON t.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = t.i) AS s)),
plans AS (SELECT conv_id, f0.c AS cost, f0.a AS audit FROM steps WHERE i = 0),
edits AS (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS p FROM plans),
numbered_edits AS (
  SELECT conv_id, p, audit[p] AS e, length(replace(audit[1:p], 'I', '')) AS i,
    length(replace(audit[1:p], 'D', '')) AS m FROM edits),
turns AS (
  SELECT x.conv_id, p, e, m, role, CASE WHEN e = 'I' THEN '' ELSE text END AS text, c FROM numbered_edits AS x
  LEFT JOIN faults AS f ON x.conv_id IS NOT DISTINCT FROM f.conv_id AND x.i = f.i AND e <> 'I' WHERE e <> 'D'),
leads AS (SELECT *, max(CASE WHEN m = 1 AND e = 'K' AND c = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS lead FROM turns),
digests AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN e = 'K' THEN role WHEN (m - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p)) AS h
  FROM leads GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS o
LEFT JOIN counts AS a ON o.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN plans AS b ON o.conv_id IS NOT DISTINCT FROM b.conv_id
LEFT JOIN digests AS d ON o.conv_id IS NOT DISTINCT FROM d.conv_id"""


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = token_alignment.align(
        docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), groups="sha256", keep_text=False)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


def op13_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = chunked_bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), decoded=True, keep_text=False)
    ids = F.array_join(F.col("token_ids").cast("array<string>"), " ")
    return found.select(
        "doc_id", F.size("token_ids").cast("long").alias("n_tokens"), sha256_hex(ids).alias("ids_sha256"), sha256_hex(F.col("decoded")).alias("decoded_sha256"))


#: name -> (query, SQL or None)
QUERIES = {
    "op1_ngram_jaccard_join": (op1_ngram_jaccard_join, OP1_SQL),
    "op2_benchmark_decontamination": (op2_benchmark_decontamination, OP2_SQL),
    "op3_personal_data": (op3_personal_data, None),
    "op4_token_counts": (op4_token_counts, None),
    "op5_quality_classifier": (op5_quality_classifier, None),
    "op6_chat_format": (op6_chat_format, OP6_SQL),
    "op7_exact_dedup": (op7_exact_dedup, OP7_SQL),
    "op8_cross_entropy_difference": (op8_cross_entropy_difference, None),
    "op9_source_mixing": (op9_source_mixing, OP9_SQL),
    "op10_language_id": (op10_language_id, None),
    "op11_conversation_repair": (op11_conversation_repair, OP11_SQL),
    "op12_token_alignment": (op12_token_alignment, None),
    "op13_chunked_bpe": (op13_chunked_bpe, None),
}
