"""Benchmark decontamination: an FM-index per shard of documents, searched for benchmark windows.

A task takes its documents in shards of about ``SHARD`` words. A shard's words become numbers,
those outside the benchmark's vocabulary being one separator, and an FM-index is built over
them. All windows are searched backwards at once, their occurrences are located by sampled
suffix positions, and overlapping occurrences are merged to spans that could be removed.

The windows are broadcast in blocks of at most ``BLOCK_WINDOWS``; a benchmark of any size
is a number of such blocks, each searched in every shard.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.fm_index import FMIndex
from tidemark.llm.shared import fresh, kept_fields, stored
from tidemark.llm.words import ALPHANUMERIC, Alphabet, Words, chunks_of, first_words, words_of

WINDOW = 13
SHARD = 1 << 20
BLOCK_WINDOWS = 200_000


class Block(NamedTuple):
    vocabulary: np.ndarray  # sorted word hashes
    patterns: np.ndarray  # windows x words: numbers from 2, right-aligned after -1
    begins: np.ndarray  # where each pattern's items begin in items, and the end
    items: list[str]


def windows_of(benchmark: DataFrame, window: int = WINDOW, alphabet: Alphabet = ALPHANUMERIC) -> DataFrame:
    """``item, window``: each item's distinct windows as packed word hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = batch.column("item").to_pylist(), set()
            for chunk in chunks_of(batch.column("text")):
                found = words_of(chunk, alphabet)
                begins = first_words(found.doc, chunk.n).tolist()
                for k, (a, b) in enumerate(zip(begins[:-1], begins[1:], strict=True), chunk.first):
                    out.update((ids[k], found.hash[i : min(i + window, b)].tobytes()) for i in range(a, max(a + 1, b - window + 1)) if b > a)
            rows = sorted(out)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=["item", "window"])

    ids = F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item")
    return benchmark.select(ids, "text").mapInArrow(run, "item string, window binary").distinct()


def _block(rows: list) -> Block:
    by: dict[bytes, list[str]] = {}
    for row in rows:
        by.setdefault(bytes(row["window"]), []).append(row["item"])
    keys = sorted(by)
    words = [np.frombuffer(k, np.uint64) for k in keys]
    vocabulary = np.unique(np.concatenate(words))
    patterns = np.full((len(keys), max(map(len, words))), -1, np.int32)
    for k, w in enumerate(words):
        patterns[k, patterns.shape[1] - len(w) :] = np.searchsorted(vocabulary, w) + 2
    return Block(vocabulary, patterns, np.cumsum([0, *(len(by[k]) for k in keys)]), [item for k in keys for item in by[k]])


def blocks_of(windows: DataFrame, size: int = BLOCK_WINDOWS) -> list[Block]:
    """The windows in blocks of about ``size`` rows, dealt by hash, windows of one text together."""
    windows = stored(windows, "benchmark-windows")
    n = max(1, -(-windows.count() // size))
    parts = (windows.filter(F.pmod(F.xxhash64("window"), F.lit(n)) == k).collect() for k in range(n))
    return [_block(rows) for rows in parts if rows]


def _sequence(words: Words, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words known, each run of them after a separator; and which word each is."""
    at = np.minimum(np.searchsorted(vocabulary, words.hash), len(vocabulary) - 1)
    known = np.flatnonzero(vocabulary[at] == words.hash)
    if len(known) == 0:
        return np.zeros(0, np.int32), known
    breaks = np.concatenate(([True], (np.diff(known) > 1) | (np.diff(words.doc[known]) > 0)))
    place = np.arange(len(known)) + np.cumsum(breaks)
    seq, word = np.ones(place[-1] + 1, np.int32), np.full(place[-1] + 1, -1)
    seq[place] = at[known] + 2
    word[place] = known
    return seq, word


def search_shard(words: Words, n_docs: int, blocks: list[Block]) -> tuple[np.ndarray, list[set[str]]]:
    """Which words of a shard lie in an occurrence, and the items found in each text."""
    edges = np.zeros(len(words.hash) + 1, np.int64)
    items: list[set[str]] = [set() for _ in range(n_docs)]
    for block in blocks:
        seq, word = _sequence(words, block.vocabulary)
        if len(seq) == 0:
            continue
        index = FMIndex(seq)
        low, high = index.search(block.patterns)
        count = np.maximum(high - low, 0)
        pattern = np.repeat(np.arange(len(count)), count)
        rows = np.arange(count.sum()) + np.repeat(low - (np.cumsum(count) - count), count)
        begin = word[index.locate(rows)]
        np.add.at(edges, begin, 1)
        np.add.at(edges, begin + (block.patterns >= 0).sum(1)[pattern], -1)
        for doc, p in np.unique(np.stack([words.doc[begin], pattern], 1), axis=0).tolist():
            items[doc].update(block.items[block.begins[p] : block.begins[p + 1]])
    return np.cumsum(edges[:-1]) > 0, items


def _rows(chunks: list, found: list[Words], blocks: list[Block]) -> Iterator[tuple]:
    """n_words, n_hit, spans, items of each text of a shard."""
    first = np.cumsum([0, *(c.n for c in chunks)])
    words = Words(
        np.concatenate([w.hash for w in found]), np.concatenate([w.doc + f for w, f in zip(found, first[:-1], strict=True)]),
        np.concatenate([w.start for w in found]), np.concatenate([w.end for w in found]))
    hit, items = search_shard(words, int(first[-1]), blocks)
    begins = first_words(words.doc, int(first[-1])).tolist()
    k = 0
    for chunk in chunks:
        for own in range(chunk.n):
            a, b = begins[k], begins[k + 1]
            spans = []
            if hit[a:b].any():
                base = int(chunk.bounds[own])
                raw = chunk.data[base : int(chunk.bounds[own + 1])]
                point = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
                edge = np.diff(np.concatenate(([0], hit[a:b].astype(np.int8), [0])))
                for i, j in zip(np.flatnonzero(edge > 0) + a, np.flatnonzero(edge < 0) + a - 1, strict=True):
                    spans.append({"start": int(point[words.start[i] - base]), "end": int(point[words.end[j] - base])})
            yield b - a, int(hit[a:b].sum()), spans, sorted(items[k])
            k += 1


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, alphabet: Alphabet = ALPHANUMERIC, keep_text: bool = True,
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``spans`` and ``items``.

    ``spans`` are merged runs of words inside occurrences, in code points; ``items`` the ids, as
    sorted strings, of items of ``benchmark(item_id, text)`` with an occurring window. A null
    text has no words. An item without words has no window; rows that repeat an item id count
    as one item; a null item id is the empty string. Rows of ``docs`` are independent.
    """
    blocks = blocks_of(windows_of(benchmark, window, alphabet))
    context = docs.sparkSession.sparkContext
    shared = [context.broadcast(block) for block in blocks]
    kept = kept_fields(docs, keep_text)
    names = fresh(docs, "n_words", "n_hit", "spans", "items")
    types = (T.LongType(), T.LongType(), SPANS, T.ArrayType(T.StringType()))
    schema = T.StructType([*kept, *(T.StructField(n, t) for n, t in zip(names, types, strict=True))])
    arrow = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string()))

    def flush(slices: list, chunks: list, found: list) -> Iterator[pa.RecordBatch]:
        rows = list(_rows(chunks, found, [b.value for b in shared]))
        at = 0
        for part in slices:
            own = rows[at : at + part.num_rows]
            at += part.num_rows
            yield pa.RecordBatch.from_arrays(
                [*(part.column(f.name) for f in kept), *(pa.array([r[k] for r in own], t) for k, t in enumerate(arrow))], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices, chunks, found, size = [], [], [], 0
        for batch in batches:
            for chunk in chunks_of(batch.column("text")):
                slices.append(batch.slice(chunk.first, chunk.n))
                chunks.append(chunk)
                found.append(words_of(chunk, alphabet))
                size += len(found[-1].hash)
                if size >= SHARD:
                    yield from flush(slices, chunks, found)
                    slices, chunks, found, size = [], [], [], 0
        if chunks:
            yield from flush(slices, chunks, found)

    return docs.mapInArrow(run, schema)


def is_contaminated(n_hit: str = "n_hit", n_words: str = "n_words"):
    """Whether at least a twentieth of the words lies in occurrences."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))
