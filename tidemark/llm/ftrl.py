"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL-proximal.

Features are word uni- and bigrams and the shapes of words, hashed to ``DIMENSIONS`` places and
scaled to unit length. Training rows are at most ``SAMPLE`` in expectation, chosen by a hash of
the id, and dealt to ``SHARDS`` tasks. In each round every task goes on from the common state
over its own rows, and the states, sparse tables of (place, z, n), are averaged in Spark. A
text's score is the sparse dot product of its features with the weights, which have a fixed
size and are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.shared import fresh, kept_fields, stored
from tidemark.llm.words import NOT_SPACE, Chunk, chunks_of, first_words, mix, ngrams, words_of

BITS = 18
DIMENSIONS = 1 << BITS
SAMPLE = 16_000
SHARDS = 8
ROUNDS = 4
ALPHA, BETA, L1, L2 = 5.0, 1.0, 1e-4, 1e-4

#: Kinds of bytes that make up a word's shape.
_KIND = np.full(256, 1, np.uint64)  # other marks
_KIND[0x30:0x3A] = 2
_KIND[0x41:0x5B] = 3
_KIND[0x61:0x7B] = 4
_KIND[0x80:] = 5


class Model(NamedTuple):
    weights: np.ndarray
    bias: float


def features(chunk: Chunk) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and values of each text's features; a text without words has none.

    Words with their pairs and shapes with theirs are two groups, each of unit length. All
    pairs of a word with itself are one feature.
    """
    found = words_of(chunk, NOT_SPACE)
    pairs = ngrams(found.hash, 2)
    pairs[found.hash[1:] == found.hash[:-1]] = mix(np.array([1 << 42], np.uint64))[0]
    kinds = _KIND[chunk.data]
    shapes = found.hash
    if len(found.hash):
        upper = np.add.reduceat(kinds == 3, found.start)
        size = np.minimum(found.end - found.start, 12).astype(np.uint64)
        ends = kinds[found.start] + kinds[found.end - 1] * np.uint64(8) + (upper > 1).astype(np.uint64) * np.uint64(64)
        shapes, ends = mix(ends + size * np.uint64(128) + np.uint64(1 << 40)), mix(ends + np.uint64(1 << 41))
        turns = ngrams(ends, 2)
    begins = first_words(found.doc, chunk.n).tolist()
    for a, b in zip(begins[:-1], begins[1:], strict=True):
        groups = [(found.hash[a:b], pairs[a : max(a, b - 1)]), (shapes[a:b], ends[a:b], turns[a : max(a, b - 1)])] if b > a else []
        parts = [_unit(np.concatenate(group), k) for k, group in enumerate(groups)]
        yield (np.concatenate([p for p, _ in parts]), np.concatenate([v for _, v in parts])) if parts else (np.zeros(0, np.int64), np.zeros(0))


def _unit(keys: np.ndarray, group: int) -> tuple[np.ndarray, np.ndarray]:
    """Log counts of keys, scaled to unit length; each of the two groups has half of the places."""
    places, counts = np.unique((keys >> np.uint64(65 - BITS)).astype(np.int64), return_counts=True)
    values = np.log1p(counts)
    return places + group * (DIMENSIONS // 2), values / np.sqrt((values * values).sum())


def weights_of(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
    return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)


def _pass(z: np.ndarray, n: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray, float]]) -> None:
    """One pass of FTRL-proximal over the rows, in place; the last place is the bias."""
    for places, values, label in rows:
        places, values = np.append(places, DIMENSIONS), np.append(values, 1.0)
        own_z, own_n = z[places], n[places]
        w = weights_of(own_z, own_n)
        p = 1 / (1 + np.exp(-np.clip(w @ values, -35, 35)))
        g = (p - label) * values
        sigma = (np.sqrt(own_n + g * g) - np.sqrt(own_n)) / ALPHA
        z[places] = own_z + g - sigma * w
        n[places] = own_n + g * g


def _trainer(shared):
    """The work of a round on one shard: what its rows change in the common state."""

    def train(frame: pd.DataFrame) -> pd.DataFrame:
        z, n = (x.copy() for x in shared.value)
        frame = frame.sort_values("doc_id")
        found = (f for c in chunks_of(pa.array(frame["text"], pa.large_string())) for f in features(c))
        _pass(z, n, [(p, v, y) for (p, v), y in zip(found, frame["label"], strict=True)])
        places = np.flatnonzero(n != shared.value[1])
        return pd.DataFrame({"place": places, "z": z[places] - shared.value[0][places], "n": n[places] - shared.value[1][places]})

    return train


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, shards: int = SHARDS, rounds: int = ROUNDS) -> Model:
    """A model of ``docs(doc_id, text)`` with ``labels(doc_id, label)``, labels being 0 and 1.

    ``doc_id`` only joins, chooses and deals rows. The chosen labels are at most ``sample`` in
    expectation, so that they can be broadcast to the documents. Other labels are not used, of
    labels that repeat an id the largest counts. Without rows all scores are a half.
    """
    labels = labels.filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("label").cast("double").alias("label"))
    total = max(1, labels.count())
    dealt = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30))
    chosen = labels.filter(dealt < min(1 << 30, (sample << 30) // total))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = stored(rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(shards)).cast("int")), "quality-rows")
    z, n = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)
    context = rows.sparkSession.sparkContext
    for _ in range(rounds):
        shared = context.broadcast((z, n))
        states = rows.groupBy("shard").applyInPandas(_trainer(shared), "place long, z double, n double")
        merged = states.groupBy("place").agg(F.sum("z").alias("z"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("shards")).toArrow()
        places = merged["place"].to_numpy()
        z[places] += merged["z"].to_numpy() / merged["shards"].to_numpy()
        n[places] += merged["n"].to_numpy() / merged["shards"].to_numpy()
        shared.unpersist()
    w = weights_of(z, n)
    return Model(w[:-1].astype(np.float32), float(w[-1]))


def score(docs: DataFrame, model: Model, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``score``, the probability of label 1; rows are independent.

    A text that is null or has no words is scored by the bias alone.
    """
    kept = kept_fields(docs, keep_text)
    (name,) = fresh(docs, "score")
    schema = T.StructType([*kept, T.StructField(name, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for batch in batches:
            margin = np.array([weights[p] @ v for c in chunks_of(batch.column("text")) for p, v in features(c)], float) + bias
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(1 / (1 + np.exp(-margin)))], names=schema.names)

    return docs.mapInArrow(run, schema)
