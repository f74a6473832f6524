"""Personal data by patterns and by bootstrapped contexts (DataFrame functions only).

Texts are scanned once for the four kinds of base spans and for other tokens with a digit or an
at sign. Every span and token has lexical patterns: the two words before it, and the words on
both sides. Base spans are the seeds. A pattern is scored for a kind by the mean score of its
distinct instances, an instance by the noisy-or of its patterns, and the two are iterated over
the pattern-instance graph in Spark. Tokens in the context of a pattern that has enough seeds
and a high score are spans of that kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import stored, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: Each finds what the contract's expression finds. Possessive runs and the look-behinds keep
#: the search linear on long runs and free of recursion.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
#: Characters on either side in which context words are looked for.
REACH = 80
#: Matches whose places are summed up in one piece.
PIECE = 256
ROUNDS = 3
#: A pattern needs so many distinct seeds and this score.
SEEDS = 4
CONFIDENCE = 0.8
#: Instances of no kind that every pattern is taken to have.
DOUBT = 0.5

_SPAN = "array<struct<kind:string,start:bigint,end:bigint,value:string,before:string,after:string>>"


def _ends(lengths: Column) -> Column:
    """Running sums, in two levels: a fold copies its list, so long lists are cut in pieces."""
    empty = F.array().cast("array<bigint>")

    def running(values: Column, begin: Column, after: bool) -> Column:
        def add(state: Column, value: Column) -> Column:
            at = state["at"] + value
            return F.struct(at.alias("at"), F.concat(state["out"], F.array(at if after else state["at"])).alias("out"))

        return F.aggregate(values, F.struct(begin.alias("at"), empty.alias("out")), add, lambda state: state["out"])

    def placed(pieces: Column) -> Column:
        sums = F.transform(pieces, lambda piece: F.aggregate(piece, F.lit(0).cast("bigint"), lambda x, y: x + y))
        return F.flatten(F.zip_with(pieces, running(sums, F.lit(0).cast("bigint"), False), lambda piece, begin: running(piece, begin, True)))

    cut = F.transform(F.sequence(F.lit(1), F.size(lengths), F.lit(PIECE)), lambda i: F.slice(lengths, i, PIECE))
    return F.transform(F.array(cut), placed)[0]


def _found(text: Column, kind: str, pattern: str) -> Column:
    """All matches with their places and what stands before and after them."""

    def spans(hits: Column, parts: Column, ends: Column) -> Column:
        return F.transform(hits, lambda hit, i: F.struct(
            F.lit(kind).alias("kind"), (ends[i] - F.char_length(hit)).alias("start"), ends[i].alias("end"), hit.alias("value"),
            F.right(parts[i], F.lit(REACH)).alias("before"), F.left(parts[i + 1], F.lit(REACH)).alias("after")))

    def place(hits: Column, parts: Column) -> Column:
        lengths = F.transform(hits, lambda hit, i: (F.char_length(parts[i]) + F.char_length(hit)).cast("bigint"))
        bound = F.transform(F.array(lengths), lambda known: _ends(known))
        return F.transform(bound, lambda ends: spans(hits, parts, ends))[0]

    def split(hits: Column) -> Column:
        return F.transform(F.array(F.split(text, pattern, -1)), lambda parts: place(hits, parts))[0]

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.transform(F.array(hits), lambda h: F.when(F.size(h) > 0, split(h)).otherwise(F.array().cast(_SPAN)))[0]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.char_length(digits) - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), add) % 10 == 0


def _valid(span: Column) -> Column:
    value, kind = span["value"], span["kind"]
    octets = F.forall(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^(|[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    count = F.char_length(_digits(value))
    return (
        F.when(kind == "ip", octets)
        .when(kind == "card", F.when(count.between(13, 19), _luhn(_digits(value))).otherwise(False))
        .when(kind == "phone", count.between(9, 15)).otherwise(True)
    )


def _patterns(span: Column) -> Column:
    """The lexical patterns of a span, those that have all their words."""
    two = F.regexp_extract(span["before"], r"(\S+\s+\S+)\s*$", 1)
    last, first = F.regexp_extract(span["before"], r"(\S+)\s*$", 1), F.regexp_extract(span["after"], r"^\s*(\S+)", 1)
    left = F.when(two != "", F.lower(F.regexp_replace(two, r"\s+", " ")))
    both = F.when((last != "") & (first != ""), F.lower(F.concat(last, F.lit(" _ "), first)))
    return F.filter(F.array(left, both), lambda p: p.isNotNull())


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``key`` of the text, ``base`` spans and ``others`` (tokens), both with patterns."""
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    rows = rows.select(
        "doc_id", F.xxhash64("text").alias("key"), F.char_length("text").alias("length"),
        F.concat(*(F.filter(_found(F.col("text"), kind, PATTERNS[kind]), _valid) for kind in KINDS)).alias("base"),
        _found(F.col("text"), "", TOKEN).alias("tokens"))
    apart = lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (b["end"] > t["start"]))
    slim = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
                              F.sha2(F.lower(s["value"]), 256).alias("instance"), _patterns(s).alias("patterns"))
    return stored(rows.select(
        "doc_id", "key", "length", F.transform("base", slim).alias("base"), F.transform(F.filter("tokens", apart), slim).alias("others")), "pii-scan")


def induce(scanned: DataFrame, rounds: int = ROUNDS, seeds: int = SEEDS, confidence: float = CONFIDENCE) -> DataFrame:
    """``pattern, kind, score`` of the patterns that discover.

    Edges of the graph are distinct pairs of pattern and instance, so that copies of a text
    count once. Only patterns with enough distinct seeds of a kind can pass a score on.
    """
    spans = scanned.select(F.explode(F.concat("base", "others")).alias("s")).select(F.col("s.kind").alias("kind"), F.col("s.instance").alias("instance"), F.explode("s.patterns").alias("pattern"))
    edges = stored(spans.groupBy("pattern", "instance").agg(F.max("kind").alias("kind")), "pii-edges")
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("size"))
    support = edges.filter("kind <> ''").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("seeds")).filter(F.col("seeds") >= seeds)
    support = stored(support.join(sizes, "pattern"), "pii-support")
    known = edges.join(support.select("pattern").distinct(), "pattern")
    known = stored(known, "pii-known")
    scored = support.withColumn("score", F.col("seeds") / (F.col("size") + DOUBT))
    for _ in range(rounds - 1):
        # An instance found by several patterns is believed more; a seed is certain of its kind.
        unseen = (
            known.filter("kind = ''").select("pattern", "instance").join(scored.select("pattern", "kind", "score"), "pattern")
            .groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("score"))))).alias("belief")))
        gained = (
            known.filter("kind = ''").select("pattern", "instance").join(unseen.filter(F.col("belief") >= 0.5), "instance")
            .groupBy("pattern", "kind").agg(F.sum("belief").alias("gain")))
        scored = support.join(gained, ["pattern", "kind"], "left").withColumn(
            "score", (F.col("seeds") + F.coalesce("gain", F.lit(0.0))) / (F.col("size") + DOUBT)).drop("gain")
        scored = stored(scored, "pii-scores")
    best = scored.filter(F.col("score") >= confidence).groupBy("pattern").agg(F.max(F.struct("score", "kind")).alias("b"))
    return best.select("pattern", F.col("b.kind").alias("kind"), F.col("b.score").alias("score"))


def discover(scanned: DataFrame, patterns: DataFrame) -> DataFrame:
    """``doc_id, key, length, extra``: spans of tokens in the context of the patterns."""
    others = scanned.select("doc_id", "key", "length", F.explode("others").alias("s")).select(
        "doc_id", "key", "length", "s.start", "s.end", F.explode("s.patterns").alias("pattern"))
    found = others.join(patterns, "pattern").groupBy("doc_id", "key", "length", "start", "end").agg(F.max(F.struct("score", "kind")).alias("b"))
    return found.groupBy("doc_id", "key", "length").agg(F.collect_list(F.struct(F.col("b.kind").alias("kind"), "start", "end")).alias("extra"))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``base`` and ``spans``, arrays of (kind, start, end).

    ``base`` is in order of kind as listed and start; ``spans`` has the discovered ones as well, in
    the same order. Places are code points, ends exclusive. A null text counts as empty. Rows that
    repeat id and text get the same spans; a null id is an id like any other.
    """
    scanned = scan(docs)
    extra = discover(scanned, induce(scanned)).select(F.col("doc_id").alias("of"), F.col("key").alias("of_key"), F.col("length").alias("of_length"), "extra")
    joined = scanned.join(extra, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("of_key")) & (F.col("length") == F.col("of_length")), "left")
    base = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    rows = joined.select("doc_id", base.alias("base"), "extra")
    everything = F.concat("base", F.coalesce("extra", F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")))
    ranked = F.transform(everything, lambda s: F.struct(
        F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    spans = F.transform(F.array_sort(ranked), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return rows.select("doc_id", "base", spans.alias("spans"))


def as_text(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
