"""Ranked full-text search over narratives.

The index is a postings table: one row per (document, term) with frequency and
positions. Queries are structured (all / any / none / phrases / prefixes)
rather than a query string. Ranking is BM25 with k1 = 1.2 and b = 0.75; a
smaller score is a better hit.

Texts of several subjects are told apart by ``keys``: rarity and lengths are those of the
subject's own texts, limits are per subject, and joins are on subject and document. By default
the subject column is the key wherever the texts have it.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import TOKEN, fold_text, tokens
from tidemark.operators.lineage import computed_once, stored
from tidemark.operators.ranks import best_of
from tidemark.specs import keys_of

# Ranking parameters and snippet shape.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
SNIPPET_TOKENS = 16
OPEN, CLOSE, ELLIPSIS = "[", "]", " … "
OPENING_CHARS = 200


@dataclass(frozen=True)
class Query:
    """A search: every field is a set of words or phrases, case and accents ignored."""

    all_terms: Sequence[str] = ()
    any_terms: Sequence[str] = ()
    none_terms: Sequence[str] = ()
    phrases: Sequence[str] = ()
    prefixes: Sequence[str] = ()

    def __post_init__(self) -> None:
        if not self.units():
            raise ValueError("a search needs at least one term, phrase or prefix")

    def units(self) -> list[tuple[str, tuple[str, ...], bool]]:
        """``(role, tokens, is_prefix)`` of each distinct part that can match."""
        parts = [("all", t, False) for t in self.all_terms]
        parts += [("all", t, False) for t in self.phrases]
        parts += [("all", t, True) for t in self.prefixes]
        parts += [("any", t, False) for t in self.any_terms]
        split = [(role, query_tokens(text), prefix) for role, text, prefix in parts]
        return list(dict.fromkeys((r, t, p) for r, t, p in split if t))

    def excluded(self) -> list[tuple[str, ...]]:
        return list(dict.fromkeys(filter(None, map(query_tokens, self.none_terms))))


def query_tokens(text: str) -> tuple[str, ...]:
    """Search tokens of a query part; several make a phrase."""
    return tuple(re.findall(r"[^\W_]+", fold_text(text)))


def build_postings(
    texts: DataFrame, doc: str = "archive_key", text: str = "text", keys: Sequence[str] | None = None
) -> DataFrame:
    """``keys, doc, doc_length, term, tf, positions`` of every term of every text.

    A text's postings are made within its row, so no token is shuffled. Rows of one document
    and length count as one text: a first pass over the keys, which leaves the texts unread,
    finds and stores the documents given more than once, and only their postings are grouped.
    """
    on = [*keys_of(texts, keys), doc]
    repeated = stored(texts.groupBy(*on).agg(F.count("*").alias("_n")).where("_n > 1").select(*on), "repeated-documents")
    if repeated.isEmpty():
        return _postings_of_rows(texts, on, text)
    same = reduce(and_, [F.col(f"t.{c}").eqNullSafe(F.col(f"r.{c}")) for c in on])
    part = lambda how: texts.alias("t").join(repeated.alias("r"), same, how)
    again = _postings_of_rows(part("left_semi"), on, text).groupBy(*on, "doc_length", "term").agg(
        F.sum("tf").cast("int").alias("tf"), F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))
    return _postings_of_rows(part("left_anti"), on, text).unionByName(again)


def _postings_of_rows(texts: DataFrame, on: Sequence[str], text: str) -> DataFrame:
    """The postings of each row by itself: its tokens in order of term and position, cut where the term changes."""
    placed = F.array_sort(F.transform("_tokens", lambda t, i: F.struct(t.alias("term"), i.alias("pos"))))
    listed = computed_once(texts.select(*on, tokens(F.col(text)).alias("_tokens")))
    listed = computed_once(listed.select(*on, F.size("_tokens").alias("doc_length"), placed.alias("_placed")))
    places = F.col("_placed")
    starts = F.filter(
        F.sequence(F.lit(0), F.size(places) - 1),
        lambda i: (i == 0) | (F.get(places, i)["term"] != F.get(places, i - 1)["term"]))
    cut = computed_once(listed.where(F.size(places) > 0).select(*on, "doc_length", "_placed", starts.alias("_starts")))

    def posting(first: Column, k: Column) -> Column:
        tf = F.coalesce(F.get(F.col("_starts"), k + 1), F.size(places)) - first
        return F.struct(
            F.get(places, first)["term"].alias("term"), tf.alias("tf"),
            F.slice(places, first + 1, tf)["pos"].alias("positions"))

    return cut.select(*on, "doc_length", F.inline(F.transform("_starts", posting)))


def corpus_size(texts: DataFrame, text: str = "text", keys: Sequence[str] | None = None) -> DataFrame:
    """Per key: number of texts and mean length in tokens (empty texts count)."""
    return texts.groupBy(*keys_of(texts, keys)).agg(
        F.count("*").alias("n_docs"), F.avg(F.size(tokens(F.col(text)))).alias("mean_length")
    )


def _positions_of(term: str) -> Column:
    return F.max(F.when(F.col("term") == term, F.col("positions")))


def _moved(positions: Column, by: int) -> Column:
    return F.transform(positions, lambda p: p + by)


def _spans(starts: Column, unit: int, length: int) -> Column:
    """Token ranges of a part, from the positions it starts at."""
    return F.transform(starts, lambda p: F.struct(
        p.alias("first"), (p + length - 1).alias("last"), F.lit(unit).alias("unit")))


def _starts(unit: tuple[str, ...], prefix: bool) -> Column:
    """Aggregate: positions in the document at which the unit starts."""
    nothing = F.array().cast("array<int>")
    if prefix and len(unit) == 1:
        hit = F.when(F.col("term").startswith(unit[0]), F.col("positions"))
        return F.flatten(F.collect_list(hit))
    if len(unit) == 1:
        return F.coalesce(_positions_of(unit[0]), nothing)
    last = len(unit) - 1
    aligned = []
    for k, term in enumerate(unit):
        if prefix and k == last:
            hit = F.when(F.col("term").startswith(term), F.col("positions"))
            where = F.flatten(F.collect_list(hit))
        else:
            where = F.coalesce(_positions_of(term), nothing)
        aligned.append(_moved(where, -k))
    return reduce(F.array_intersect, aligned)


def _found(df: DataFrame, query: Query) -> DataFrame:
    """Add ``_match`` and drop the excluded parts' positions."""
    units, excluded = query.units(), query.excluded()
    has = [F.size(f"starts{i}") > 0 for i in range(len(units))]
    required = [h for h, (role, _, _) in zip(has, units) if role == "all"]
    optional = [h for h, (role, _, _) in zip(has, units) if role == "any"]
    conditions = required + ([reduce(or_, optional)] if optional else [])
    conditions += [F.size(f"_not{i}") == 0 for i in range(len(excluded))]
    # every document holding a part counts for that part's rarity, matching or not
    return df.withColumn("_match", reduce(and_, conditions)).drop(*(f"_not{i}" for i in range(len(excluded))))


def _starts_in(words: Column, unit: tuple[str, ...], prefix: bool) -> Column:
    """Positions of a token list at which the unit starts, ascending."""
    def at(word: Column, i: Column) -> Column:
        hit = F.lit(True)
        for k, term in enumerate(unit):
            here = word if k == 0 else F.get(words, i + k)
            hit = hit & (here.startswith(term) if prefix and k == len(unit) - 1 else here == term)
        return F.when(hit, i)

    return F.filter(F.transform(words, at), lambda i: i.isNotNull())


def scan(
    texts: DataFrame, query: Query, doc: str = "archive_key", text: str = "text", keys: Sequence[str] | None = None
) -> DataFrame:
    """The rows of ``match`` for every text, without an index and without a shuffle."""
    words = F.col("_words")
    on = [*keys_of(texts, keys), doc]
    listed = texts.select(*on, tokens(F.col(text)).alias("_words")).select(
        *on, F.size(words).alias("doc_length"),
        *(_starts_in(words, u, p).alias(f"starts{i}") for i, (_, u, p) in enumerate(query.units())),
        *(_starts_in(words, u, False).alias(f"_not{i}") for i, u in enumerate(query.excluded())),
    )
    return _found(computed_once(listed), query)


def match(postings: DataFrame, query: Query, doc: str = "archive_key", keys: Sequence[str] | None = None) -> DataFrame:
    """``keys, doc, doc_length, starts0, starts1, ...`` of the documents that match.

    Only postings of the query's own terms are read; one grouping by document
    evaluates every part.
    """
    units, excluded = query.units(), query.excluded()
    words = {t for _, u, p in units for t in (u[:-1] if p else u)} | {t for u in excluded for t in u}
    wanted = [F.col("term").isin(sorted(words))] if words else []
    wanted += [F.col("term").startswith(u[-1]) for _, u, p in units if p]
    found = postings.where(reduce(or_, wanted)).groupBy(*keys_of(postings, keys), doc, "doc_length").agg(
        *(_starts(u, p).alias(f"starts{i}") for i, (_, u, p) in enumerate(units)),
        *(_starts(u, False).alias(f"_not{i}") for i, u in enumerate(excluded)),
    )
    return _found(found, query)


def score(found: DataFrame, n_units: int, corpus: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Matching documents with their BM25 ``score``.

    ``corpus`` gives the number and mean length of all texts per key; without it ``found`` has to
    hold every text. Without keys the counts reach the score as one scalar subquery, so nothing is joined.
    """
    facts = [F.count_if(F.size(f"starts{i}") > 0).alias(f"df{i}") for i in range(n_units)]
    if corpus is None:
        facts += [F.count("*").alias("n_docs"), F.avg("doc_length").alias("mean_length")]
    counts = found.groupBy(*keys).agg(*facts)
    names = [c for c in counts.columns if c not in keys]
    matching = found.where("_match")
    if keys:
        counts = counts if corpus is None else counts.join(corpus, list(keys))
        matching = matching.join(counts, list(keys))
    else:
        matching = matching.withColumn("_facts", counts.select(F.struct(*names)).scalar())
        if corpus is not None:
            matching = matching.withColumn("_size", corpus.select(F.struct("n_docs", "mean_length")).scalar()).select("*", "_size.*")
        matching = matching.select("*", "_facts.*").drop("_facts", "_size")
    total = F.lit(0.0)
    for i in range(n_units):
        df = F.col(f"df{i}")
        raw = F.log((F.col("n_docs") - df + 0.5) / (df + 0.5))
        idf = F.when(raw <= 0, IDF_FLOOR).otherwise(raw)
        tf = F.size(f"starts{i}").cast("double")
        norm = K1 * (1 - B + B * F.col("doc_length") / F.col("mean_length"))
        total = total + idf * tf * (K1 + 1) / (tf + norm)
    return matching.withColumn("score", -total)


def search(
    texts: DataFrame,
    query: Query,
    *,
    postings: DataFrame | None = None,
    corpus: DataFrame | None = None,
    docs: DataFrame | None = None,
    doc: str = "archive_key",
    limit: int = 20,
    keys: Sequence[str] | None = None,
) -> DataFrame:
    """Each subject's ``limit`` best hits: ``keys, doc, score, snippet`` plus document columns.

    With stored ``postings`` only the query's own terms are read; without them
    every text is scanned. Texts and documents are joined to the hits only,
    after the top-k.
    """
    units, keys = query.units(), keys_of(texts, keys)
    on = [*keys, doc]
    if postings is None:
        found, corpus = scan(texts, query, doc, keys=keys), None
    else:
        found = match(postings, query, doc, keys)
        corpus = corpus_size(texts, keys=keys) if corpus is None else corpus
    hits = best_of(score(found, len(units), corpus, keys), keys, [F.col("score"), F.col(doc)], limit)
    spans = F.flatten(F.array(*(
        _spans(F.col(f"starts{i}"), i, len(u)) for i, (_, u, _) in enumerate(units)
    )))
    top = hits.select(*on, "score", F.array_sort(spans).alias("_spans"))
    out = top.join(texts, on).withColumn("snippet", snippet(F.col("text"), F.col("_spans")))
    columns = [*on, *(["title"] if "title" in texts.columns else [])]
    if docs is not None:
        out = out.join(docs.select(*on, "kind", "source", "document_date"), on)
        columns += ["kind", "source", "document_date"]
    return out.select(*columns, "score", "snippet").orderBy(*keys, "score", doc)


def snippet(text: Column, spans: Column, length: int = SNIPPET_TOKENS) -> Column:
    """The ``length``-token window with the most distinct parts, hits in brackets.

    ``spans`` are ``(first, last, unit)`` token ranges in order. Windows are
    tried at every hit; a new part counts far more than a repeated one, and the
    chosen hits are centred in the window.
    """
    pieces = F.regexp_extract_all(text, F.lit(rf"({TOKEN})([^\p{{L}}\p{{N}}\p{{Co}}]*)"), F.lit(0))
    lead = F.regexp_extract(text, r"^[^\p{L}\p{N}\p{Co}]*", 0)
    count = F.size(pieces)

    def inside(start: Column) -> Column:
        return F.filter(spans, lambda s: (s["first"] >= start) & (s["last"] < start + length))

    def rated(span: Column) -> Column:
        held = inside(span["first"])
        distinct = F.size(F.array_distinct(F.transform(held, lambda s: s["unit"])))
        reach = F.coalesce(F.array_max(F.transform(held, lambda s: s["last"])), span["last"])
        slack = F.greatest(F.lit(0), F.floor((length - (reach - span["first"] + 1)) / 2).cast("int"))
        begin = F.greatest(F.lit(0), F.least(span["first"] - slack, count - length))
        return F.struct((distinct * 1000 + F.size(held)).alias("points"), (-begin).alias("back"))

    best = F.array_max(F.transform(spans, rated))
    begin = F.coalesce(-best["back"], F.lit(0))
    end = F.least(begin + length, count)

    def piece(i: Column) -> Column:
        part = F.get(pieces, i)
        word = F.regexp_extract(part, TOKEN, 0)
        after = F.substring(part, F.length(word) + 1, F.length(part))
        # a span that starts inside an earlier one extends it
        opens = F.exists(spans, lambda s: s["first"] == i) & ~F.exists(
            spans, lambda s: (s["first"] < i) & (s["last"] >= i))
        closes = F.exists(spans, lambda s: s["last"] == i) & ~F.exists(
            spans, lambda s: (s["first"] <= i) & (s["last"] > i))
        last = i == end - 1
        return F.concat(
            F.when(opens, OPEN).otherwise(""), word, F.when(closes, CLOSE).otherwise(""),
            F.when(last & (end < count), "").otherwise(after),
        )

    body = F.array_join(F.transform(F.sequence(begin, end - 1), piece), "")
    return F.concat(
        F.when(begin > 0, ELLIPSIS).otherwise(lead), body, F.when(end < count, ELLIPSIS).otherwise(""))


def catalog(
    texts: DataFrame, docs: DataFrame, limit: int = 20, doc: str = "archive_key", keys: Sequence[str] | None = None
) -> DataFrame:
    """Each subject's newest narratives first with their opening characters (no query given)."""
    keys = keys_of(texts, keys)
    on = [*keys, doc]
    order = [F.col("document_date").desc_nulls_last(), F.col("archived_at").desc(), F.col(doc).desc()]
    columns = [*on, *(["title"] if "title" in texts.columns else []), "kind", "source", "document_date"]
    joined = texts.join(docs.select(*on, "kind", "source", "document_date", "archived_at"), on)
    opening = F.substring("text", 1, OPENING_CHARS).alias("snippet")
    newest = best_of(joined.select(*columns, "archived_at", opening), keys, order, limit)
    return newest.orderBy(*keys, *order).drop("archived_at")


def narrative(
    texts: DataFrame, docs: DataFrame, problems: DataFrame, archive_key: str, keys: Sequence[str] | None = None
) -> DataFrame:
    """One narrative with its text and codings, for each subject that has it; no row when it is not a narrative."""
    keys = keys_of(texts, keys)
    on = [*keys, "archive_key"]
    key = F.col("archive_key") == archive_key
    codings = (
        problems.where(key)
        .groupBy(*on)
        .agg(F.sort_array(F.collect_list(F.struct(
            "onset_date", "seq", "coding_system", "coding_code", "coding_display", "section_label",
        ))).alias("_codings"))
    )
    listed = F.transform(
        F.coalesce("_codings", F.array().cast(codings.schema["_codings"].dataType)),
        lambda c: c.dropFields("onset_date", "seq"),
    )
    return (
        texts.where(key).select(*on, "title", "text")
        .join(docs.where(key).select(*on, "kind", "source", "document_date", "original_filename"), on)
        .join(codings, on, "left")
        .select(*on, "kind", "source", "title", "document_date", "original_filename", "text",
                listed.alias("codings"))
    )
