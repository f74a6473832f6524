"""Scoring by cross-entropy difference: two bigram models over all words of the corpus.

The target model counts the bigrams of target documents, the background model those of all
documents; both have the same smoothing, and the background's counts are scaled to the target's
mass, so that the two are matched. A document's score is the mean over its words of target loss
minus background loss: the lower, the more it is like the target.

Bigrams are counted over the whole corpus, summed per task before the shuffle, and both models
are Spark tables keyed by (history, word), by word and by history: they grow with the corpus.
Documents meet them in a shuffled join on their distinct bigrams. The ``HOT`` most frequent
bigrams are looked up in the task instead, with the same losses, so that no key of the join is
in very many documents. ``score_counted`` scores the documents that the models are made of: counts
and scores share one shuffle of packed bigrams, and no model is stored. With ``words`` given only the most frequent words keep an identity and
others fall into ``CLASSES`` classes by their length and border characters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.shared import cleaned, fresh, stored, text_or_empty
from tidemark.llm.words import NOT_SPACE, Chunk, Words, chunks_of, first_words, mix, words_of

CLASSES = 24
#: Bigrams whose losses are sent to every task.
HOT = 1 << 16
#: Words whose counts are sent to every task, by ``score_counted``.
FREQUENT = 1 << 12
#: Least number of groups that ``score_counted`` deals bigrams out to; one more for every 2**20 words.
PARTS = 256
#: Rows that a task of ``score_counted`` sorts and packs at a time.
SENT = 1 << 19
#: Weight of the unigram model against a history's counts.
MASS = 8.0
#: Entries that a counting task holds before it passes them on.
HELD = 2_000_000
#: Stands for the beginning of a text as a history.
BEGIN = np.uint64(0x5BD1E995A2F3C4D7)


class Models(NamedTuple):
    vocabulary: np.ndarray | None  # sorted hashes of the words that have an identity; None: all
    pairs: DataFrame  # history, word, target, background: losses
    words: DataFrame  # word, target, background: counts
    histories: DataFrame  # history, target, background: counts
    n_target: int
    n_background: int
    width: int  # words and classes, or words and one for those never seen
    hot: tuple[np.ndarray, ...]  # key (sorted), history, word, target, background


def count_words(docs: DataFrame) -> DataFrame:
    """``word`` (hash), ``count`` over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            keys, inverse = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            counts = np.bincount(inverse, np.concatenate([c for _, c in held]), len(keys)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["word", "count"])

        for batch in batches:
            for chunk in chunks_of(batch.column("text")):
                held.append(np.unique(words_of(chunk, NOT_SPACE).hash, return_counts=True))
                size += len(held[-1][0])
                if size > HELD:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(run, "word long, count long").groupBy("word").agg(F.sum("count").alias("count"))


def build_vocabulary(docs: DataFrame, words: int) -> np.ndarray:
    """The most frequent words' hashes, sorted; ties go to the smaller hash."""
    rows = count_words(docs).orderBy(F.desc("count"), "word").limit(words).collect()
    return np.sort(np.array([r["word"] for r in rows], np.int64).view(np.uint64))


def identities(chunk: Chunk, found: Words, vocabulary: np.ndarray | None) -> np.ndarray:
    """Each word's hash, or that of its class if the word is not in the vocabulary."""
    if vocabulary is None or len(found.hash) == 0:
        return found.hash
    last, first = chunk.data[found.end - 1], chunk.data[found.start]
    kind = np.where(last >= 0x80, 2, np.where((last | 0x20) - 0x61 < 26, 0, 1))
    capital = (first >= 0x41) & (first <= 0x5A)
    out = mix((np.minimum((found.end - found.start - 1) // 4, 3) * 6 + kind * 2 + capital).astype(np.uint64) + BEGIN)
    if len(vocabulary):
        at = np.minimum(np.searchsorted(vocabulary, found.hash), len(vocabulary) - 1)
        out = np.where(vocabulary[at] == found.hash, found.hash, out)
    return out


def bigrams(chunk: Chunk, found: Words, vocabulary: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """History and word of every word; the beginning of a text is a history."""
    word = identities(chunk, found, vocabulary)
    if len(word) == 0:
        return word, word
    history = np.concatenate(([BEGIN], word[:-1]))
    history[np.concatenate(([True], found.doc[1:] != found.doc[:-1]))] = BEGIN
    return history, word


def _pair_keys(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(history * np.uint64(0x9E3779B97F4A7C15) + mix(word))


def count_bigrams(rows: DataFrame, vocabulary: np.ndarray | None) -> DataFrame:
    """``history, word, target, background`` (counts) of ``rows(text, is_target)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def merged(parts: list[tuple]) -> tuple:
            key, history, word, target, background = (np.concatenate(c) for c in zip(*parts, strict=True))
            _, at, inverse = np.unique(key, return_index=True, return_inverse=True)
            sums = [np.bincount(inverse, c, len(at)).astype(np.int64) for c in (target, background)]
            return key[at], history[at], word[at], *sums

        def out(part: tuple) -> pa.RecordBatch:
            arrays = [pa.array(part[1].view(np.int64)), pa.array(part[2].view(np.int64)), pa.array(part[3]), pa.array(part[4])]
            return pa.RecordBatch.from_arrays(arrays, names=["history", "word", "target", "background"])

        for batch in batches:
            is_target = batch.column("is_target").to_numpy(zero_copy_only=False).astype(bool)
            for chunk in chunks_of(batch.column("text")):
                found = words_of(chunk, NOT_SPACE)
                history, word = bigrams(chunk, found, vocabulary)
                if len(word):
                    own = is_target[chunk.first + found.doc].astype(np.int64)
                    held.append(merged([(_pair_keys(history, word), history, word, own, np.ones(len(word), np.int64))]))
                    size += len(held[-1][0])
                if size > HELD:
                    yield out(merged(held))
                    held, size = [], 0
        if held:
            yield out(merged(held))

    counts = rows.mapInArrow(run, "history long, word long, target long, background long")
    return counts.groupBy("history", "word").agg(F.sum("target").alias("target"), F.sum("background").alias("background"))


def _loss(pair: Column, word: Column, history: Column, scale: float, total: float, width: int) -> Column:
    single = (word * F.lit(scale) + 1) / F.lit(float(total * scale + width))
    return -F.log((pair * F.lit(scale) + MASS * single) / (history * F.lit(scale) + MASS))


def _scale(n_target: int, n_background: int) -> float:
    return n_target / n_background if n_target else 1.0


def _losses(pairs: DataFrame, words: DataFrame, histories: DataFrame, n_target: int, n_background: int, width: int, keep: list[str]) -> DataFrame:
    """``keep`` and the losses of ``pairs(history, word, target, background)``; what was never counted has 0."""
    of = lambda df, key, name: df.select(key, *(F.col(c).alias(f"{name}_{c}") for c in ("target", "background")))
    rows = pairs.join(of(words, "word", "w").hint("merge"), "word", "left").join(of(histories, "history", "h").hint("merge"), "history", "left")
    zero = lambda name: F.coalesce(name, F.lit(0))
    return rows.select(*keep, *(
        _loss(F.col(c), zero(f"w_{c}"), zero(f"h_{c}"), scale, total, width).alias(c)
        for c, scale, total in (("target", 1.0, n_target), ("background", _scale(n_target, n_background), n_background))))


def fit(docs: DataFrame, target: DataFrame, words: int | None = None) -> Models:
    """Models of ``docs(doc_id, text)``; the ids in ``target(doc_id)`` are the target's documents.

    Every text counts in the background, in the target those whose id is in ``target``; an id
    repeated there counts once. Null texts have no words.
    """
    vocabulary = None if words is None else build_vocabulary(docs, words)
    # The target grows with the corpus: always a shuffled join, never a broadcast of it.
    marked = target.select("doc_id").distinct().withColumn("is_target", F.lit(True)).hint("merge")
    rows = docs.select("doc_id", "text").join(marked, "doc_id", "left").select("text", F.coalesce("is_target", F.lit(False)).alias("is_target"))
    counts = stored(count_bigrams(rows, vocabulary), "bigram-counts")
    both = [F.sum(c).alias(c) for c in ("target", "background")]
    singles = stored(counts.groupBy("word").agg(*both), "bigram-words")
    histories = stored(counts.groupBy("history").agg(*both), "bigram-histories")
    total = singles.agg(F.count(F.lit(1)).alias("n"), *both).first()
    n_target, n_background = total["target"] or 0, total["background"] or 0
    width = total["n"] + 1 if vocabulary is None else len(vocabulary) + CLASSES
    pairs = stored(_losses(
        counts.withColumn("n", F.col("background")), singles, histories, n_target, n_background, width, ["history", "word", "n"]), "bigram-losses")
    top = pairs.orderBy(F.desc("n"), "history", "word").limit(HOT).select("history", "word", "target", "background").toArrow()
    history, word = (top[c].to_numpy().astype(np.int64).view(np.uint64) for c in ("history", "word"))
    key = _pair_keys(history, word)
    order = np.argsort(key)
    hot = tuple(c[order] for c in (key, history, word, top["target"].to_numpy(), top["background"].to_numpy()))
    return Models(vocabulary, pairs.drop("n"), singles, histories, n_target, n_background, width, hot)


_PARTS = "text_key long, n_words long, history long, word long, n long, hot_target double, hot_background double"


def _text_parts(texts: DataFrame, models: Models) -> DataFrame:
    """Distinct bigrams of ``texts(text_key, text)`` with their counts, and one row a text of its hot ones' summed losses."""
    shared = texts.sparkSession.sparkContext.broadcast((models.vocabulary, models.hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, (hot_key, hot_history, hot_word, *hot_losses) = shared.value
        for batch in batches:
            keys = batch.column("text_key").to_numpy()
            for chunk in chunks_of(batch.column("text")):
                found = words_of(chunk, NOT_SPACE)
                history, word = bigrams(chunk, found, vocabulary)
                if len(word) == 0:
                    continue
                key = _pair_keys(history, word)
                is_hot = np.zeros(len(word), bool)
                if len(hot_key):
                    at = np.minimum(np.searchsorted(hot_key, key), len(hot_key) - 1)
                    is_hot = (hot_key[at] == key) & (hot_history[at] == history) & (hot_word[at] == word)
                n_words = np.diff(first_words(found.doc, chunk.n))
                sums = [np.bincount(found.doc[is_hot], t[at[is_hot]], chunk.n) if len(hot_key) else np.zeros(chunk.n) for t in hot_losses]
                some = np.flatnonzero(n_words)
                cold = np.flatnonzero(~is_hot)
                _, first, n = np.unique(mix(key[cold] + found.doc[cold].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), return_index=True, return_counts=True)
                cold = cold[first]
                text = keys[chunk.first : chunk.first + chunk.n]
                # The rows of sums find no bigram: their history is the text's key, which spreads them.
                none, doc = np.zeros(len(some), np.int64), found.doc[cold]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate((text[some], text[doc]))), pa.array(np.concatenate((n_words[some], n_words[doc])).astype(np.int64)),
                    pa.array(np.concatenate((text[some], history[cold].view(np.int64)))), pa.array(np.concatenate((none, word[cold].view(np.int64)))),
                    pa.array(np.concatenate((none, n)).astype(np.int64)),
                    *(pa.array(np.concatenate((s[some], np.zeros(len(cold))))) for s in sums),
                ], names=["text_key", "n_words", "history", "word", "n", "hot_target", "hot_background"])

    return texts.mapInArrow(run, _PARTS)


def _summed(rows: DataFrame) -> DataFrame:
    """Mean losses per text. Equal texts have one key: their sums of words and losses grow alike."""
    n = F.sum(F.when(F.col("n") == 0, F.col("n_words")))
    return rows.groupBy("text_key").agg(
        F.max("n_words").alias("n_words"),
        *((F.sum(F.col(f"hot_{c}") + F.col("n") * F.coalesce(c, F.lit(0.0))) / n).alias(c) for c in ("target", "background")),
        F.sum(F.when(F.col("target").isNull(), F.col("n")).otherwise(0)).alias("unseen"))


def score(docs: DataFrame, models: Models, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``n_words``, ``target_loss``, ``background_loss`` (means) and ``score``, their difference.

    A text without words, null included, has losses and score 0. Equal texts have equal scores.
    """
    texts = docs.select(F.xxhash64(text_or_empty()).alias("text_key"), "text")
    parts = _text_parts(texts, models).join(models.pairs.hint("shuffle_hash"), ["history", "word"], "left")
    sums = stored(_summed(parts), "bigram-sums")
    if sums.filter("unseen > 0").limit(1).count():
        # Texts that the models were not fitted on: bigrams that were never counted have the smoothing's losses.
        again = texts.join(sums.filter("unseen > 0").select("text_key").distinct().hint("merge"), "text_key", "left_semi")
        rows = _text_parts(again, models).join(models.pairs.hint("shuffle_hash"), ["history", "word"], "left")
        lost = rows.filter("target is null and n > 0").withColumns({"target": F.lit(0), "background": F.lit(0)})
        columns = ["text_key", "n_words", "n", "hot_target", "hot_background"]
        priced = _losses(lost, models.words, models.histories, models.n_target, models.n_background, models.width, columns)
        known = rows.filter("target is not null or n = 0").select(*columns, "target", "background")
        sums = sums.filter("unseen = 0").union(_summed(known.union(priced)))
    return _with_losses(docs, sums, keep_text)


def _with_losses(docs: DataFrame, sums: DataFrame, keep_text: bool) -> DataFrame:
    """``docs`` with the mean losses that ``sums(text_key, n_words, target, background)`` has for their texts."""
    n_words, target, background, total, key, of, length = fresh(
        docs, "n_words", "target_loss", "background_loss", "score", "text_key", "text_key_of", "text_words")
    sums = sums.select(
        F.col("text_key").alias(of), F.col("n_words").alias(length), F.col("target").alias(target), F.col("background").alias(background)).hint("merge")
    kept = [c for c in docs.columns if keep_text or c != "text"]
    rows = docs.select(*(F.col(f"`{c}`") for c in kept), F.xxhash64(text_or_empty()).alias(key))
    joined = rows.join(sums, F.col(key) == F.col(of), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return joined.select(
        *(F.col(f"`{c}`") for c in kept), F.coalesce(F.col(length), F.lit(0).cast("long")).alias(n_words),
        zero(target).alias(target), zero(background).alias(background), (zero(target) - zero(background)).alias(total))


# Scores of the documents that the models count ------------------------------------------------


class _Frequent(NamedTuple):
    """The most frequent words and, among them, bigrams: what every task holds, of fixed size."""

    word: np.ndarray  # sorted hashes; a word's place here is its number, the beginning of a text has the next
    target: np.ndarray  # as a word, by number
    background: np.ndarray
    history: tuple[np.ndarray, np.ndarray]  # as a history, by number: target, background
    pair: np.ndarray  # sorted: number of the history * (words + 1) + number of the word
    loss: tuple[np.ndarray, np.ndarray]  # of those bigrams

    def bigrams(self, found: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Whether each word's history is known here, the history, whether the word is, the word: numbers, else hashes."""
        n, word, is_known = len(self.word), found.hash, np.zeros(len(found.hash), bool)
        if n:
            at = np.minimum(np.searchsorted(self.word, word), n - 1)
            is_known = self.word[at] == word
            word = np.where(is_known, at.astype(np.uint64), word)
        begins = np.append(True, found.doc[1:] != found.doc[:-1])[: len(word)]
        before = np.append(np.uint64(n), word[:-1])[: len(word)]
        is_before = np.append(True, is_known[:-1])[: len(word)]
        return is_before | begins, np.where(begins, np.uint64(n), before), is_known, word


def _packed(*arrays: np.ndarray) -> tuple[int, bytes]:
    """Size and compressed bytes of integer or float columns, laid out byte by byte of their 8-byte values."""
    columns = [np.ascontiguousarray(a).view(np.uint8).reshape(-1, 8) for a in arrays]
    head = np.array([len(c) for c in columns], np.int64).tobytes()
    raw = head + b"".join(c.T.tobytes() for c in columns)
    return len(raw), pa.Codec("zstd").compress(raw, asbytes=True)


def _unpacked(size: int, data: bytes, types: list) -> list[np.ndarray]:
    raw = np.frombuffer(pa.Codec("zstd").decompress(data, size, asbytes=True), np.uint8)
    lengths = raw[: 8 * len(types)].view(np.int64)
    at, out = 8 * len(types), []
    for n, kind in zip(lengths.tolist(), types, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + 8 * n].reshape(8, n).T).view(kind).reshape(n))
        at += 8 * n
    return out


def _copies(batch: pa.RecordBatch, chunk: Chunk) -> list[np.ndarray]:
    return [batch.column(c).to_numpy()[chunk.first : chunk.first + chunk.n] for c in ("doc", "target", "background")]


def _totals(rows: DataFrame, key: str, names: list[str], counted: Callable[[pa.RecordBatch, Chunk], tuple]) -> DataFrame:
    """``key`` and the sums of ``names`` of what ``counted`` gives for each chunk, summed in the task first."""
    limit = HELD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def summed(parts: list[tuple]) -> tuple:
            keys, *values = (np.concatenate(c) for c in zip(*parts, strict=True))
            keys, inverse = np.unique(keys, return_inverse=True)
            return keys, *(np.bincount(inverse, v, len(keys)).astype(np.int64) for v in values)

        def out() -> pa.RecordBatch:
            keys, *values = summed(held)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *map(pa.array, values)], names=[key, *names])

        for batch in batches:
            for chunk in chunks_of(batch.column("text")):
                held.append(summed([counted(batch, chunk)]))
                size += len(held[-1][0])
                if size > limit:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    counts = rows.mapInArrow(run, ", ".join(f"{c} long" for c in (key, *names)))
    return counts.groupBy(key).agg(*(F.sum(c).alias(c) for c in names))


def _counted_words(batch: pa.RecordBatch, chunk: Chunk) -> tuple:
    """Every word, how often it is in either corpus, and how often the last of a text."""
    found = words_of(chunk, NOT_SPACE)
    _, target, background = _copies(batch, chunk)
    last = np.append(found.doc[1:] != found.doc[:-1], True)[: len(found.doc)]
    own, all_ = target[found.doc], background[found.doc]
    return found.hash, own, all_, own * last, all_ * last


def _corpus(docs: DataFrame, target: DataFrame) -> DataFrame:
    """Every different text once: ``doc`` (a number), ``text_key``, ``text`` and its copies in ``target`` and ``background``."""
    keyed = docs.select("doc_id", "text", F.xxhash64(text_or_empty()).alias("text_key"))
    # The target grows with the corpus: always a shuffled join, never a broadcast of it.
    marked = target.select("doc_id").distinct().withColumn("is_target", F.lit(True)).hint("merge")
    copies = keyed.select("doc_id", "text_key").join(marked, "doc_id", "left").groupBy("text_key").agg(
        F.count("is_target").alias("target"), F.count(F.lit(1)).alias("background"))
    texts = keyed.groupBy("text_key").agg(F.first(text_or_empty()).alias("text"))
    return texts.join(copies.hint("merge"), "text_key").withColumn("doc", F.monotonically_increasing_id())


class _Totals(NamedTuple):
    words: tuple[int, int]  # target, background
    texts: tuple[int, int]  # that have words
    width: int

    def pair_loss(self, k: int, pair: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Loss of a bigram without its history's part, in the target (0) or the background (1)."""
        scale = self.scale(k)
        return -np.log(pair * scale + MASS * ((word * scale + 1) / (self.words[k] * scale + self.width)))

    def history_loss(self, k: int, history: np.ndarray) -> np.ndarray:
        return np.log(history * self.scale(k) + MASS)

    def scale(self, k: int) -> float:
        return _scale(*self.words) if k else 1.0


def _frequent(corpus: DataFrame, words: DataFrame, totals: _Totals) -> _Frequent:
    """The ``FREQUENT`` most frequent words and the ``HOT`` most frequent bigrams of these, with their losses."""
    top = words.orderBy(F.desc("background"), "word").limit(FREQUENT).toArrow()
    word = top["word"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(word)
    single = [top[c].to_numpy()[order] for c in ("target", "background")]
    last = [top[f"last_{c}"].to_numpy()[order] for c in ("target", "background")]
    history = tuple(np.append(s - e, n) for s, e, n in zip(single, last, totals.texts, strict=True))
    none = np.zeros(0, np.int64)
    frequent = _Frequent(word[order], *single, history, none, (none, none))
    width = len(word) + 1

    def counted(batch: pa.RecordBatch, chunk: Chunk) -> tuple:
        found = words_of(chunk, NOT_SPACE)
        _, target, background = _copies(batch, chunk)
        is_before, history, is_after, word = frequent.bigrams(found)
        both = is_before & is_after
        doc = found.doc[both]
        return history[both] * np.uint64(width) + word[both], target[doc], background[doc]

    counts = _totals(corpus, "pair", ["target", "background"], counted)
    best = counts.orderBy(F.desc("background"), "pair").limit(HOT).toArrow()
    pair = best["pair"].to_numpy().astype(np.int64)
    order = np.argsort(pair)
    pair = pair[order]
    loss = tuple(
        totals.pair_loss(k, best[c].to_numpy()[order], single[k][pair % width]) + totals.history_loss(k, history[k][pair // width])
        for k, c in enumerate(("target", "background")))
    return frequent._replace(pair=pair, loss=loss)


_BY_TEXT = "doc long, n_words long, target double, background double"
_PACKED = [np.uint64, np.int64, np.int64, np.uint64, np.uint64, np.int64, np.int64, np.int64, np.int64, np.int64, np.float64, np.float64]


def _bigram_rows(corpus: DataFrame, frequent: _Frequent, totals: _Totals, parts: int) -> DataFrame:
    """``part, size, data``: packed rows of texts' distinct bigrams, and texts' losses that need no others.

    All rows of a word are in one part, those of a frequent word are dealt out by their history.
    """
    shared, limit = corpus.sparkSession.sparkContext.broadcast(frequent), SENT

    def of_chunk(batch: pa.RecordBatch, chunk: Chunk, frequent: _Frequent) -> tuple[tuple, tuple] | None:
        found = words_of(chunk, NOT_SPACE)
        if len(found.hash) == 0:
            return None
        doc, target, background = _copies(batch, chunk)
        is_before, history, is_after, word = frequent.bigrams(found)
        pair = np.where(is_before & is_after, history * np.uint64(len(frequent.word) + 1) + word, np.uint64(0)).astype(np.int64)
        is_hot = np.zeros(len(word), bool)
        if len(frequent.pair):
            at = np.minimum(np.searchsorted(frequent.pair, pair), len(frequent.pair) - 1)
            is_hot = is_before & is_after & (frequent.pair[at] == pair)
        n_words = np.diff(first_words(found.doc, chunk.n))
        some = np.flatnonzero(n_words)
        known = np.flatnonzero(is_before & ~is_hot)
        sums = []
        for k in range(2):
            own = np.zeros(chunk.n)
            if is_hot.any():
                own += np.bincount(found.doc[is_hot], frequent.loss[k][at[is_hot]], chunk.n)
            own += np.bincount(found.doc[known], totals.history_loss(k, frequent.history[k])[history[known].astype(np.int64)], chunk.n)
            sums.append(own[some])
        cold = np.flatnonzero(~is_hot)
        key = mix(_pair_keys(history[cold], word[cold]) + found.doc[cold].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        _, first, inverse, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        last = np.append(found.doc[1:] != found.doc[:-1], True)[cold] & ~is_after[cold]
        ends = np.bincount(inverse, last, len(first)).astype(np.int64)
        cold = cold[first]
        code = n * 4 + ends * 2 + is_before[cold]
        of = found.doc[cold]
        part = np.where(is_after[cold], mix(mix(word[cold]) + history[cold]), mix(word[cold])) % np.uint64(parts)
        rows = part.astype(np.int64), word[cold], history[cold], code, doc[of], target[of], background[of]
        return rows, (doc[some], n_words[some].astype(np.int64), *sums)

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        part, word, history, code, doc, target, background = (np.concatenate(c) for c in zip(*(h[0] for h in held), strict=True))
        texts = [np.concatenate(c) for c in zip(*(h[1] for h in held), strict=True)]
        none = [t[:0] for t in texts]
        order = np.lexsort((history, word, part))
        part, word, history, code, doc, target, background = (c[order] for c in (part, word, history, code, doc, target, background))
        bounds = np.flatnonzero(np.append(part[1:] != part[:-1], True)[: len(part)]) + 1
        # Texts' own sums go to any part; that of the first text spreads them.
        own = int(mix(texts[0][:1].astype(np.uint64))[0] % np.uint64(parts))
        out, a, given = [], 0, False
        for b in bounds.tolist():
            edge = np.append(True, word[a + 1 : b] != word[a : b - 1])
            begins = np.flatnonzero(edge)
            words = word[a:b][begins]
            known = (code[a:b] & 1).astype(bool)
            with_texts = int(part[a]) == own
            given |= with_texts
            out.append((int(part[a]), *_packed(
                np.diff(words, prepend=np.uint64(0)), np.diff(begins, append=b - a), code[a:b], history[a:b][known], history[a:b][~known],
                doc[a:b], target[a:b], background[a:b], *(texts if with_texts else none))))
            a = b
        if not given:
            out.append((own, *_packed(*(c[:0] for c in (word, code, code, history, history, doc, target, background)), *texts)))
        for k in range(0, len(out), 256):
            columns = zip(*out[k : k + 256], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["part", "size", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for chunk in chunks_of(batch.column("text")):
                found = of_chunk(batch, chunk, shared.value)
                if found is not None:
                    held.append(found)
                    size += len(found[0][0])
                if size > limit:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return corpus.mapInArrow(run, "part long, size long, data binary")


def _part_losses(packed: DataFrame, frequent: _Frequent, totals: _Totals) -> DataFrame:
    """Counts and losses of all bigrams of a part, summed for each text."""
    shared = packed.sparkSession.sparkContext.broadcast(frequent)

    def run(group: pa.Table) -> pa.Table:
        frequent = shared.value
        held = []
        for size, data in zip(group["size"].to_pylist(), group["data"].to_pylist(), strict=True):
            gaps, runs, code, known, other, *rest = _unpacked(size, data, _PACKED)
            history = np.empty(len(code), np.uint64)
            is_known = (code & 1).astype(bool)
            history[is_known], history[~is_known] = known, other
            held.append((np.repeat(np.cumsum(gaps, dtype=np.uint64), runs), history, code, *rest))
        word, history, code, doc, *copies, text, n_words, text_target, text_background = (
            np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((history, word))
        word, history, code, doc, *copies = (c[order] for c in (word, history, code, doc, *copies))
        n, ends = code >> 2, (code >> 1) & 1
        new_word = np.append(True, word[1:] != word[:-1])[: len(word)]
        new_pair = new_word | np.append(True, history[1:] != history[:-1])[: len(word)]
        of_word, of_pair = np.cumsum(new_word) - 1, np.cumsum(new_pair) - 1
        is_known = word < np.uint64(len(frequent.word))
        number = np.where(is_known, word, np.uint64(0)).astype(np.int64)
        docs, inverse = np.unique(np.concatenate((doc, text)), return_inverse=True)
        at, own = inverse[: len(doc)], inverse[len(doc) :]
        sums = []
        for k, (copy, given) in enumerate(zip(copies, (text_target, text_background), strict=True)):
            total = np.bincount(of_word, n * copy)[of_word] if len(word) else np.zeros(0)
            pair = np.bincount(of_pair, n * copy)[of_pair] if len(word) else total
            ended = np.bincount(of_word, ends * copy)[of_word] if len(word) else total
            single = np.where(is_known, (frequent.target, frequent.background)[k][number], total) if len(frequent.word) else total
            loss = n * totals.pair_loss(k, pair, single)
            loss += np.where(is_known, 0.0, (n - ends) * totals.history_loss(k, np.where(is_known, 0.0, total - ended)))
            sums.append(np.bincount(at, loss, len(docs)) + np.bincount(own, given, len(docs)))
        lengths = np.bincount(own, n_words, len(docs)).astype(np.int64)
        return pa.table({"doc": docs, "n_words": lengths, "target": sums[0], "background": sums[1]})

    return packed.groupBy("part").applyInArrow(run, _BY_TEXT)


def score_counted(docs: DataFrame, target: DataFrame, keep_text: bool = True) -> DataFrame:
    """What ``score(docs, fit(docs, target))`` gives, without models as tables: counts and scores share a shuffle.

    Every different text sends its distinct bigrams, packed, to the part of the word. There all bigrams
    of a word meet, so that its counts as a word, as a history and in every bigram are exact, and
    each text's losses are summed. The ``FREQUENT`` most frequent words have their counts in every task
    and are dealt out by history; the ``HOT`` most frequent bigrams of these are looked up in the text's task.
    """
    spark = docs.sparkSession
    with cleaned(spark):
        corpus = stored(_corpus(docs, target), "bigram-texts", compression="zstd")
        names = ["target", "background", "last_target", "last_background"]
        words = stored(_totals(corpus, "word", names, _counted_words), "bigram-words", compression="zstd")
        sums = words.agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(c) for c in names)).first()
        n_target, n_background, t_target, t_background = (sums[c] or 0 for c in names)
        totals = _Totals((n_target, n_background), (t_target, t_background), sums["n"] + 1)
        frequent = _frequent(corpus, words, totals)
        parts = max(PARTS, n_background >> 20)
        rows = _part_losses(_bigram_rows(corpus, frequent, totals, parts), frequent, totals)
        by_doc = rows.groupBy("doc").agg(*(F.sum(c).alias(c) for c in ("n_words", "target", "background")))
        found = stored(by_doc.join(corpus.select("doc", "text_key").hint("merge"), "doc").select(
            "text_key", "n_words", *((F.col(c) / F.col("n_words")).alias(c) for c in ("target", "background"))), "bigram-sums")
    return _with_losses(docs, found, keep_text)
