"""Near-duplicate documents by an n-gram Jaccard join with adaptive multi-match prefixes.

Documents with the same shingle set are one class and take part once. Two sets of sizes n and
m have a Jaccard similarity of at least p % exactly if they share T = p (n + m) / (100 + p)
shingles. Shingles are ordered by document frequency, rare ones first. A set that must share
at least T of its n shingles and one that must share as many have at least l of them in common
among their first n - T + l (and m - T + l): a prefix one longer asks for one more match.
Each set chooses its own l by the estimated cost of its candidates; two sets must share the
smaller of their l. The smaller set of a pair has the tighter bound on T and so the shorter
prefix; shingles that no other set has cannot be shared, which bounds the overlap from above.

1. Pruning: sets whose lowest-hashed quarter has fewer shingles in common with those of others
   than any two linked sets must have, have no partner. Most documents leave here, and only survivors are counted in full.
2. Survivors' shingles get their frequencies; each set is stored as its ordered list of the
   shared ones.
3. Each set is compared with one pivot, the set nearest to the core of a group of copies, and
   links form components.
4. What remains to be found are links between components. Postings are reduced to one per
   shingle and component, so that a group of copies is not paired with itself. Components
   that may hold a link are compared in blocks of bounded size.

No step samples, caps or drops candidates: the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.components import connected
from tidemark.llm.shared import fresh, stored, text_or_empty
from tidemark.llm.words import NOT_SPACE, Alphabet, chunks_of, mix, shingle_sets

SHINGLE = 5
PERCENT = 80
#: Part of a set's lowest hashes that pruning looks at.
PRUNE_SHARE = 0.25
#: Sets that are compared with as many others at once.
BLOCK = 256
#: Numbers of matches a prefix may ask for.
LEVELS = np.array([1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256])


def _fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """Two sums over a set, of its hashes and of their second hashes."""
    return int(shingles.sum(dtype=np.uint64).view(np.int64)), int(mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).view(np.int64))


def _key() -> Column:
    """Tells texts of rows apart that repeat an id."""
    return F.xxhash64(text_or_empty())


def sets_of(docs: DataFrame, n: int = SHINGLE, alphabet: Alphabet = NOT_SPACE) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``key`` of the text, ``n_words``, ``size`` of its shingle set, ``f1``, ``f2``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(words, len(s), *_fingerprint(s)) for c in chunks_of(batch.column("text")) for s, words in shingle_sets(c, alphabet, n)]
            columns = zip(*rows, strict=True) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), *(pa.array(c, pa.int64()) for c in columns)],
                names=["doc_id", "key", "n_words", "size", "f1", "f2"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", _key().alias("key"), "text").mapInArrow(run, f"doc_id {kind}, key long, n_words long, size long, f1 long, f2 long")


def _pruned(docs: DataFrame, sets: DataFrame, percent: int, n: int, alphabet: Alphabet) -> DataFrame:
    """Classes that may have a partner: ``node, size, f1, f2, first`` (its smallest doc_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks_of(batch.column("text")):
                parts, keys, counts = [], [], []
                for s, _ in shingle_sets(chunk, alphabet, n):
                    if len(s):
                        parts.append(s[: _prune_prefix(len(s), percent)])
                        keys.append(_fingerprint(s)[0])
                        counts.append(len(parts[-1]))
                if parts:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(parts).view(np.int64)), pa.array(np.repeat(np.array(keys, np.int64), counts))], names=["token", "f1"])

    tokens = docs.select("text").mapInArrow(run, "token long, f1 long")
    same = Window.partitionBy("token")  # a shingle has one row a document, of the hundreds that each has
    shared = tokens.select("f1", F.min("f1").over(same).alias("low"), F.max("f1").over(same).alias("high")).filter("low <> high")
    met = shared.groupBy("f1").agg(F.count(F.lit(1)).alias("met"))
    classes = sets.filter("size > 0").groupBy("size", "f1", "f2").agg(F.min("doc_id").alias("first"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = pa.array([_prune_matches(size, percent) for size in batch.column("size").to_pylist()], pa.int64())
            yield batch.filter(pc.greater_equal(batch.column("met"), least))

    joined = classes.join(met, "f1")
    left = joined.mapInArrow(keep, joined.schema)
    return stored(left.select(F.monotonically_increasing_id().alias("node"), "size", "f1", "f2", "first"), "jaccard-nodes")


def _prune_prefix(size: int, percent: int) -> int:
    return max(size - (percent * size + 99) // 100 + 1, int(np.ceil(size * PRUNE_SHARE)))


@lru_cache(100_000)
def _prune_matches(size: int, percent: int) -> int:
    """How many shingles the prefixes of a set and of any partner have in common at least.

    All shared shingles of the prefix that ends at the lower hash are in the other one too. Which
    of the two ends first is not known: the smaller number counts, over all sizes of partners.
    """
    other = np.arange(-(-percent * size // 100), 100 * size // percent + 1)
    overlap = -(-percent * (size + other) // (100 + percent))
    prefix = np.maximum(other - (percent * other + 99) // 100 + 1, np.ceil(other * PRUNE_SHARE).astype(np.int64))
    own = _prune_prefix(size, percent) - (size - overlap)
    return max(1, int(np.minimum(own, prefix - (other - overlap)).min()))


def _members(docs: DataFrame, nodes: DataFrame, n: int, alphabet: Alphabet) -> DataFrame:
    """``node, size, lone, tokens``: the shared shingles of a set by frequency, ``lone`` others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, f1, f2 = (batch.column(c).to_pylist() for c in ("node", "f1", "f2"))
            for chunk in chunks_of(batch.column("text")):
                parts, keys = [], []
                for k, (s, _) in enumerate(shingle_sets(chunk, alphabet, n), chunk.first):
                    if _fingerprint(s) == (f1[k], f2[k]):
                        parts.append(s)
                        keys.append(node[k])
                if parts:
                    counts = [len(p) for p in parts]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.concatenate(parts).view(np.int64)), pa.array(np.repeat(np.array(keys, np.int64), counts)),
                        pa.array(np.repeat(np.array(counts, np.int64), counts)),
                    ], names=["token", "node", "size"])

    # The survivors grow with the corpus: always a shuffled join, never a broadcast of them.
    survivors = nodes.select("node", "f1", "f2", "first").hint("merge")
    texts = docs.select("doc_id", "text").join(survivors, F.col("doc_id").eqNullSafe(F.col("first")))
    tokens = texts.select("text", "node", "f1", "f2").mapInArrow(run, "token long, node long, size long")
    same = Window.partitionBy("token")
    rows = tokens.select(
        "token", "node", "size", F.count(F.lit(1)).over(same).alias("df"),
        F.min("node").over(same).alias("low"), F.max("node").over(same).alias("high")).filter("low <> high")
    lists = rows.groupBy("node").agg(F.first("size").alias("size"), F.array_sort(F.collect_set(F.struct("df", "token"))).alias("ordered"))
    return stored(lists.select(
        "node", "size", (F.col("size") - F.size("ordered")).alias("lone"),
        F.col("ordered.df").alias("dfs"), F.col("ordered.token").alias("tokens")), "jaccard-members")


def choose_level(dfs: np.ndarray, begin: int, size: int) -> int:
    """How many matches to ask for: the cheapest in expectation.

    ``begin`` shared shingles are in the prefix that asks for one match. Reading the postings
    of a prefix costs their number. Sets that meet it l times are at most that number over l,
    and comparing one costs a part of the set's length.
    """
    levels = LEVELS[LEVELS <= max(1, min(len(dfs) - begin + 1, size // 2))]
    postings = np.cumsum(dfs)[np.minimum(begin + levels - 2, len(dfs) - 1)].astype(float)
    return int(levels[np.argmin(postings + postings / levels * (len(dfs) / 8))])


def _postings(members: DataFrame, percent: int) -> DataFrame:
    """``token, node, size, lone, level, small``; ``small``: also in the prefix for larger partners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            rows = zip(*(batch.column(c).to_pylist() for c in ("node", "size", "lone")), batch.column("dfs"), batch.column("tokens"), strict=True)
            for node, size, lone, dfs, tokens in rows:
                any_miss = size - -(-percent * size // 100)
                small_miss = size - -(-2 * percent * size // (100 + percent))
                if lone > any_miss or len(tokens) == 0:
                    continue  # too few shingles are shared with any set
                dfs, tokens = np.asarray(dfs.values), np.asarray(tokens.values)
                level = choose_level(dfs, any_miss + 1 - lone, size)
                take = min(len(tokens), any_miss + level - lone)
                small = np.arange(lone, lone + take) < small_miss + level
                fields = (tokens[:take], node, size, lone, level, small & (lone <= small_miss))
                for column, value in zip(out, fields, strict=True):
                    column.append(np.broadcast_to(value, take))
            if out[0]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c)) for c in out], names=["token", "node", "size", "lone", "level", "small"])

    return stored(members.mapInArrow(run, "token long, node long, size long, lone long, level long, small boolean"), "jaccard-postings")


def _pivot_links(postings: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Links found by comparing each set with one other: the pivot that it meets most often.

    Of the sets with a shingle the pivot is the one with the smallest part of lone shingles.
    """
    pivots = postings.groupBy("token").agg(
        F.min(F.struct(F.col("lone") / F.col("size"), "node")).getField("node").alias("pivot"),
        F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high").select("token", "pivot")
    met = postings.join(pivots, "token").filter("node <> pivot").groupBy("node", "pivot").agg(F.count(F.lit(1)).alias("met"))
    best = met.groupBy("node").agg(F.max(F.struct("met", -F.col("pivot"))).alias("best")).select("node", (-F.col("best.col2")).alias("pivot"))
    left = members.select("node", F.col("size").alias("n"), F.col("tokens").alias("x"))
    right = members.select(F.col("node").alias("pivot"), F.col("size").alias("m"), F.col("tokens").alias("y"))
    both = best.join(left, "node").join(right, "pivot")
    share = F.size(F.array_intersect("x", "y"))
    return both.filter((100 + percent) * share >= percent * (F.col("n") + F.col("m"))).select(F.col("node").alias("a"), F.col("pivot").alias("b"))


def _with_component(df: DataFrame, components: DataFrame) -> DataFrame:
    return df.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _component_pairs(postings: DataFrame, components: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a < b`` of components that may hold a link."""
    placed = _with_component(postings, components)
    small = F.when(F.col("small"), F.col("size"))
    lists = stored(placed.groupBy("token", "component").agg(
        F.min(small).alias("s_min"), F.max(small).alias("s_max"), F.max(F.when(F.col("small"), F.col("size") - F.col("lone"))).alias("s_gap"),
        F.min("size").alias("l_min"), F.max("size").alias("l_max"), F.max(F.col("size") - F.col("lone")).alias("l_gap"),
        F.min("level").alias("level")), "jaccard-lists")
    mixed = lists.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("token")
    lists = lists.join(mixed, "token")
    x = lists.filter("s_min is not null").select("token", F.col("component").alias("x"), "s_min", "s_max", "s_gap", F.col("level").alias("x_level"))
    y = lists.select("token", F.col("component").alias("y"), "l_min", "l_max", "l_gap", F.col("level").alias("y_level"))
    met = x.join(y, "token").filter(
        (F.col("x") != F.col("y")) & (F.col("s_min") <= F.col("l_max")) & (100 * F.col("s_max") >= percent * F.col("l_min"))
        & ((100 + percent) * F.least("s_gap", "l_gap") >= percent * (F.col("s_min") + F.greatest("s_min", "l_min"))))
    pairs = met.groupBy("x", "y").agg(F.count(F.lit(1)).alias("met"), F.min(F.least("x_level", "y_level")).alias("level")).filter("met >= level")
    return stored(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "jaccard-pairs")


def _block_links(pairs: DataFrame, members: DataFrame, components: DataFrame, percent: int) -> DataFrame:
    """Links between the paired components, at least one wherever there is any.

    Of a pair the component with more members is the target. Sets that are to be compared with
    the same target meet it in blocks; blocks of the target have ``BLOCK`` sets as well.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("component")).distinct()
    placed = stored(_with_component(members.select("node", "size", "tokens"), components).join(ends, "component"), "jaccard-placed")
    counts = placed.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    sized = pairs.join(counts.select(F.col("component").alias("a"), F.col("n").alias("n_a")), "a").join(
        counts.select(F.col("component").alias("b"), F.col("n").alias("n_b")), "b")
    turned = F.col("n_a") > F.col("n_b")
    sized = sized.select(F.when(turned, F.col("b")).otherwise(F.col("a")).alias("component"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("target"),
                         F.least("n_a", "n_b").alias("n"), F.greatest("n_a", "n_b").alias("n_target"))
    blocks = lambda total: F.pmod(F.xxhash64("node"), F.ceil(total / BLOCK)).alias("block")
    row = F.struct("node", "size", "tokens")
    asking = sized.groupBy("target").agg(F.sum("n").alias("n_asking"))
    probes = (
        sized.select("component", "target").join(asking, "target").join(placed, "component")
        .groupBy("target", blocks(F.col("n_asking"))).agg(F.collect_list(row).alias("probes")).drop("block"))
    targets = (
        placed.join(sized.select(F.col("target").alias("component"), F.col("n_target").alias("n")).distinct(), "component")
        .groupBy(F.col("component").alias("target"), blocks(F.col("n"))).agg(F.collect_list(row).alias("held")).drop("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for probes, held in zip(batch.column("probes"), batch.column("held"), strict=True):
                found = _compare(_unpack(probes), _unpack(held), percent)
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return probes.join(targets, "target").select("probes", "held").mapInArrow(run, "a long, b long")


def _unpack(cell) -> list[tuple[int, int, np.ndarray]]:
    rows = cell.values
    tokens = rows.field("tokens")
    return [(node, size, np.asarray(t.values)) for node, size, t in zip(rows.field("node").to_pylist(), rows.field("size").to_pylist(), tokens, strict=True)]


def _linked(probes: list, held: list, percent: int) -> Iterator[np.ndarray]:
    """For each probe the places of the sets held that it is linked with."""
    owner = np.repeat(np.arange(len(held)), [len(t) for _, _, t in held])
    tokens = np.concatenate([t for _, _, t in held])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    sizes = np.array([size for _, size, _ in held])
    for _, size, own in probes:
        low, high = np.searchsorted(tokens, own, "left"), np.searchsorted(tokens, own, "right")
        count = high - low
        at = np.arange(count.sum()) + np.repeat(low - (np.cumsum(count) - count), count)
        share = np.bincount(owner[at], minlength=len(held))
        yield np.flatnonzero((100 + percent) * share >= percent * (sizes + size))


def _compare(probes: list, held: list, percent: int) -> list[tuple[int, int]]:
    """One link, if there is any, of each probe with the sets held."""
    return [(node, held[good[0]][0]) for (node, _, _), good in zip(probes, _linked(probes, held, percent), strict=True) if len(good)]


def _node_links(nodes: DataFrame, members: DataFrame, components: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``size, f1, f2, others``: to how many rows with other sets each set is linked, where there are any.

    Linked sets are in one component, so that only sets of a component are compared, block by
    block, and only one count a set and block leaves a task. Classes count as often as they
    have rows.
    """
    copies = sets.filter("size > 0").groupBy("size", "f1", "f2").agg(F.count(F.lit(1)).alias("copies"))
    known = nodes.join(components, "node").join(copies, ["size", "f1", "f2"]).select("node", "component", "f1", "f2", "copies")
    counts = known.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("n_blocks"))
    placed = members.join(known, "node").join(counts, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("n_blocks")))
    row = F.struct("node", "size", "tokens", "copies")
    blocks = stored(placed.groupBy("component", "n_blocks", "block").agg(F.collect_list(row).alias("held")), "jaccard-blocks")
    # Every block is sent to each block of its component: pairs of blocks are spread, not one task's.
    probes = blocks.select("component", F.col("held").alias("probes"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for probes, held in zip(batch.column("probes"), batch.column("held"), strict=True):
                copies = np.asarray(held.values.field("copies"))
                asked, other = _unpack(probes), _unpack(held)
                nodes_held = np.array([node for node, _, _ in other])
                linked = [int(copies[good[nodes_held[good] != a[0]]].sum()) for a, good in zip(asked, _linked(asked, other, percent), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([a[0] for a in asked], pa.int64()), pa.array(linked, pa.int64())], names=["node", "others"])

    found = probes.join(blocks.select("component", "block", "held"), ["component", "block"]).select("probes", "held").mapInArrow(run, "node long, others long")
    total = found.groupBy("node").agg(F.sum("others").alias("others"))
    return total.join(nodes, "node").select("size", "f1", "f2", "others")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, n: int = SHINGLE, alphabet: Alphabet = NOT_SPACE, links: bool = False) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id, key, n_words, n_shingles, component_id``.

    With ``links`` also ``n_links``: the number of other rows that the row is linked with.

    ``component_id`` is the smallest doc_id reachable by links. A text without words, null
    included, has 0 shingles and is linked with nothing: its component is its own id. Rows
    that repeat an id are taken one by one; a null id is never the smallest, unless it is the
    only one of its component.
    """
    sets = stored(sets_of(docs, n, alphabet), "jaccard-sets")
    nodes = _pruned(docs, sets, percent, n, alphabet)
    members = _members(docs, nodes, n, alphabet)
    postings = _postings(members, percent)
    first = stored(_pivot_links(postings, members, percent), "jaccard-links")
    components = connected(first)
    pairs = _component_pairs(postings, components, percent)
    more = stored(_block_links(pairs, members, components, percent), "jaccard-links")
    components = connected(first.union(more))
    placed = _with_component(nodes, components)
    firsts = placed.groupBy("component").agg(F.min("first").alias("smallest"))
    known = stored(placed.join(firsts, "component").select("size", "f1", "f2", "smallest"), "jaccard-known")
    classes = sets.filter("size > 0").groupBy("size", "f1", "f2").agg(F.min("doc_id").alias("first"))
    smallest = classes.join(known, ["size", "f1", "f2"], "left").select(
        "size", "f1", "f2", F.coalesce("smallest", "first").alias("component_id"))
    columns = ["doc_id", "key", "n_words", F.col("size").alias("n_shingles"),
               F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")]
    if links:
        others = _node_links(nodes, members, components, sets, percent)
        rows = sets.filter("size > 0").groupBy("size", "f1", "f2").agg(F.count(F.lit(1)).alias("rows"))
        counted = rows.join(others, ["size", "f1", "f2"], "left").select(
            "size", "f1", "f2", (F.col("rows") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
        smallest = smallest.join(counted, ["size", "f1", "f2"])
        columns.append(F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    return sets.join(smallest, ["size", "f1", "f2"], "left").select(*columns)


def keep_one(docs: DataFrame, percent: int = PERCENT, n: int = SHINGLE, alphabet: Alphabet = NOT_SPACE) -> DataFrame:
    """The rows of ``docs`` whose id is that of their component, with all their columns.

    Of rows that repeat id and text one stays. Rows that repeat an id with different texts are
    judged one by one.
    """
    found = near_duplicates(docs, percent, n, alphabet)
    of, key, key_of, nth = fresh(docs, "kept_id", "text_key", "kept_key", "nth")
    stays = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(of), F.col("key").alias(key_of)).distinct()
    rows = docs.withColumn(key, _key())
    rows = rows.join(stays, F.col("doc_id").eqNullSafe(F.col(of)) & (F.col(key) == F.col(key_of)))
    once = rows.withColumn(nth, F.row_number().over(Window.partitionBy("doc_id", key).orderBy(key)))
    return once.filter(F.col(nth) == 1).select(*(F.col(f"`{c}`") for c in docs.columns))
