"""Language identification: known words first, then ever shorter character n-grams.

A word in the model adds its log frequency in each language. A word outside it is scored by
its longest character n-grams that the model knows: if none of its 5-grams is known, its
4-grams are tried, and so on to single characters. A text gets the language with the largest
sum. Words are runs of letters: a-z (A-Z folded) and all bytes beyond ASCII.

The model is fitted on ``SAMPLE`` rows in expectation, chosen by a hash of the id, and keeps all
their words and n-grams; that sample bounds its size whatever the corpus, which is what allows
it to be broadcast. A very long text is one text of the sample like any other, and when scored
is held whole in its task.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.shared import fresh, kept_fields, stored
from tidemark.llm.words import Alphabet, chunks_of, mix, words_of

SAMPLE = 5_000
LONGEST = 5
#: Entries that a training task holds before it passes them on.
HELD = 2_000_000
#: Pseudo-count of a word or n-gram in a language that lacks it.
PSEUDO = 0.1
UNKNOWN = "und"

LETTERS = Alphabet(lambda b: 0x61 <= b <= 0x7A or b >= 0x80)
_FACTORS = mix(np.arange(201, 201 + LONGEST, dtype=np.uint64)) | np.uint64(1)


class Model(NamedTuple):
    languages: list[str]
    tables: list[tuple[np.ndarray, np.ndarray]]  # by n (0: words): sorted keys, log frequencies by language


class Spelled(NamedTuple):
    """Distinct words as one row of code points, A-Z folded, each word between two zeros."""

    points: np.ndarray
    word: np.ndarray  # number of the word at each point
    n: int


def spell(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> Spelled:
    n = len(start)
    size = end - start
    ends = np.cumsum(size + 2)
    out = np.zeros(int(ends[-1]) if n else 0, np.uint8)
    at = np.repeat(ends - size - 1 - start, size) + _ranges(start, size)
    letters = data[_ranges(start, size)]
    out[at] = np.where((letters >= 0x41) & (letters <= 0x5A), letters | 0x20, letters)
    points = np.frombuffer(out.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    word = np.maximum(np.cumsum(points == 0) - 1, 0) // 2  # two zeros a word
    return Spelled(points, word, n)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start .. start + size - 1 of every range, one after another."""
    total = int(size.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    return np.arange(total) + np.repeat(start - (np.cumsum(size) - size), size)


def grams(spelled: Spelled, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``n``-grams of the words, borders counting as characters, and whose they are."""
    m = len(spelled.points) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    value = np.full(m, n, np.uint64)
    for k in range(n):
        value = value + spelled.points[k : k + m].astype(np.uint64) * _FACTORS[k]
    inside = spelled.word[:m] == spelled.word[n - 1 : n - 1 + m]
    if n == 1:
        inside &= spelled.points > 0
    return mix(value[inside]), spelled.word[:m][inside]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(n, key, lang, count) of a task's words and n-grams; n = 0 for words."""
    held: dict[tuple[int, str], list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0
    for batch in batches:
        langs, of = np.unique(np.array(batch.column("lang").to_pylist(), object).astype(str), return_inverse=True)
        for chunk in chunks_of(batch.column("text")):
            found = words_of(chunk, LETTERS)
            lang = of[chunk.first + found.doc]
            for k, name in enumerate(langs):
                own = lang == k
                keys, at, count = np.unique(found.hash[own], return_index=True, return_counts=True)
                if len(keys) == 0:
                    continue
                held.setdefault((0, name), []).append((keys, count))
                spelled = spell(chunk.data, found.start[own][at], found.end[own][at])
                for n in range(1, LONGEST + 1):
                    gram, word = grams(spelled, n)
                    held.setdefault((n, name), []).append(_summed(gram, count[np.minimum(word, len(count) - 1)]))
                    size += len(held[n, name][-1][0])
            if size > HELD:
                yield from _flush(held)
                held, size = {}, 0
    yield from _flush(held)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(keys, return_inverse=True)
    return keys, np.bincount(inverse, counts, len(keys)).astype(np.int64)


def _flush(held: dict[tuple[int, str], list[tuple[np.ndarray, np.ndarray]]]) -> Iterator[pa.RecordBatch]:
    for (n, name), parts in held.items():
        keys, counts = _summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(len(keys), n, np.int32)), pa.array(keys.view(np.int64)),
            pa.array([name] * len(keys), pa.string()), pa.array(counts),
        ], names=["n", "key", "lang", "count"])


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of ``docs(doc_id, text, lang)``; rows without language or text are not used.

    It is fitted on ``sample`` rows in expectation, chosen by a hash of the id, and keeps every word
    and n-gram of them, so that the sample alone bounds what reaches the driver.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    total = max(1, rows.count())
    bound = min(1 << 30, (sample << 30) // total)
    rows = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(1 << 30)) < bound).select("text", "lang")
    counts = rows.mapInArrow(_counts, "n int, key long, lang string, count long").groupBy("n", "key", "lang").agg(F.sum("count").alias("count"))
    found = stored(counts, "langid-counts")
    languages = sorted(row["lang"] for row in found.select("lang").distinct().collect())
    number = F.array_position(F.lit(languages), F.col("lang")).cast("short") if languages else F.lit(0).cast("short")
    tables = []
    for n in range(LONGEST + 1):  # one length at a time, in few bytes an entry
        part = found.where(F.col("n") == n).select("key", number.alias("of"), F.col("count").cast("int").alias("count")).toArrow()
        keys, at = np.unique(part["key"].to_numpy().astype(np.int64).view(np.uint64), return_inverse=True)
        count = np.zeros((len(keys), len(languages)), np.float32)
        count[at, part["of"].to_numpy().astype(int) - 1] = part["count"].to_numpy()
        totals = count.sum(0, dtype=float) + PSEUDO * (len(keys) + 1)
        tables.append((keys, (np.log(count + np.float32(PSEUDO)) - np.log(totals)).astype(np.float32)))
    return Model(languages, tables)


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Positions in sorted ``keys``, -1 where missing."""
    if len(keys) == 0:
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def score(model: Model, chunk) -> tuple[np.ndarray, np.ndarray]:
    """Sum of log frequencies of each text in each language, and each text's number of words."""
    found = words_of(chunk, LETTERS)
    keys, at, inverse = np.unique(found.hash, return_index=True, return_inverse=True)
    logs = np.zeros((len(keys), len(model.languages)), np.float32)
    known = _find(model.tables[0][0], keys)
    logs[known >= 0] = model.tables[0][1][known[known >= 0]]
    left = np.flatnonzero(known < 0)
    for n in range(LONGEST, 0, -1):
        if len(left) == 0:
            break
        gram, word = grams(spell(chunk.data, found.start[at[left]], found.end[at[left]]), n)
        gram_at = _find(model.tables[n][0], gram)
        word, gram_at = word[gram_at >= 0], gram_at[gram_at >= 0]
        hits = np.bincount(word, minlength=len(left))[: len(left)]
        values = model.tables[n][1][gram_at]
        for k in range(logs.shape[1]):
            sums = np.bincount(word, values[:, k], len(left))[: len(left)]
            logs[left, k] = np.where(hits > 0, sums / np.maximum(hits, 1), logs[left, k])
        left = left[hits == 0]
    words = np.bincount(found.doc, minlength=chunk.n)
    sums = np.stack([np.bincount(found.doc, logs[inverse, k], chunk.n) for k in range(logs.shape[1])], 1) if logs.shape[1] else np.zeros((chunk.n, 0))
    return sums, words


def identify(docs: DataFrame, model: Model, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; rows are independent and keep all columns.

    ``score`` is the share of the winner after normalising the sums, flattened by the root of
    the number of words so that it does not saturate. A text that is null or has no letter, and
    every text if the model is empty, gets ``und`` and 0. Equal sums: the first language by name.
    """
    names = fresh(docs, "lang_pred", "score")
    kept = kept_fields(docs, keep_text)
    schema = T.StructType([*kept, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts, picks, shares = batch.column("text"), [], []
            for chunk in chunks_of(texts):
                sums, words = score(model, chunk)
                for k in range(chunk.n):
                    if not model.languages or words[k] == 0 or not has_letter(chunk, k):
                        picks.append(UNKNOWN)
                        shares.append(0.0)
                        continue
                    best = int(sums[k].argmax())
                    picks.append(model.languages[best])
                    shares.append(float(1 / np.exp((sums[k] - sums[k, best]) / np.sqrt(words[k])).sum()))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(picks, pa.string()), pa.array(shares, pa.float64())], names=schema.names)

    return docs.mapInArrow(run, schema)


def has_letter(chunk, k: int) -> bool:
    raw = chunk.data[chunk.bounds[k] : chunk.bounds[k + 1]]
    lower = raw | 0x20
    if bool(((lower >= 0x61) & (lower <= 0x7A)).any()):
        return True
    return any(c.isalpha() for c in raw.tobytes().decode("utf-8", "replace"))
