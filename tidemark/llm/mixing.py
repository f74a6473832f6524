"""Mixing sources to target weights (DataFrame functions only).

:func:`mix_exact` follows the weights themselves, at any length. Sources are the leaves of a
Huffman tree of their weights. A node deals its slots to its two children evenly: after T of its
slots a child of p of its q parts has had floor((T p + h) / q), h being half of q, within half a
slot of its share. The slot of a source's i-th block is found by going up the tree with the
inverse of that, in whole numbers, so that no slot is given twice or left out. Errors of the
levels above shrink as the part of the source in them; since weights of ancestors in such a tree
grow at least as the Fibonacci numbers, a source is at every time less than two blocks (1.7) from
its share. Nothing repeats, so nothing adds up, but that weights are rounded to 2**-32 of the total.

:func:`mix` is a Pfair schedule of one period that repeats, with a slot reserved for each source.
It follows whole slots of the period and so only approximates the weights, by the same error in
every period; the SQL of ``op9_source_mixing`` states this rule.

Weights are whole numbers of slots in a period. The i-th block of a source of weight w in a
period of P slots is released in slot floor((i-1)P/w) and due before slot ceil(iP/w); in each
slot the released block with the earliest deadline goes. On one processor this meets every
deadline, so after any number of slots each source is less than one block from its share of
slots, which is not that of its weight.
The schedule repeats every period, hence one period, whose length is a parameter, is worked
out once; blocks of all periods find their slot by an equi-join on (source, block in period).

A source's rows are numbered without gathering them: rows fall into ``CELLS`` cells by a hash
of their id, are numbered inside their cell, and cells are offset by the counts before them.

Rows of a source beyond its share are never dropped: when other sources have ended, their
slots are empty and the rest goes on in its own slots.
"""

from __future__ import annotations

import heapq
import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.shared import fresh

#: Slots in a period and rows in a block.
PERIOD = 1000
BLOCK = 8
#: Cells of a source are the upper bits of a 32-bit hash.
CELL_BITS = 12
#: Parts of the whole that weights of the exact mixture are rounded to.
PARTS = 1 << 32


def square_root_weights(docs: DataFrame) -> DataFrame:
    """Target weights ``source, weight``: the square root of each source's number of rows."""
    return docs.groupBy("source").agg(F.sqrt(F.count(F.lit(1)).cast("double")).alias("weight"))


def slots_per_period(weights: DataFrame, period: int = PERIOD) -> DataFrame:
    """``source, slots``: whole slots that add up to the period, at least one per source.

    One slot is reserved for each source and the others follow the weights, the largest
    remainders rounded up, ties to the smaller source name. Weights that are null, negative or
    not finite count as 0. The period is lengthened to twice the number of sources if shorter.
    """
    everyone, ordered = Window.partitionBy(), Window.partitionBy().orderBy(F.desc("rest"), F.col("source").asc_nulls_first())
    clean = F.when((F.col("weight") > 0) & (F.col("weight") < float("inf")), F.col("weight")).otherwise(F.lit(0.0))
    w = weights.groupBy("source").agg(F.sum(clean).alias("weight"))
    w = w.withColumn("n", F.count(F.lit(1)).over(everyone)).withColumn("total", F.sum("weight").over(everyone))
    w = w.withColumn("period", F.greatest(F.lit(period), 2 * F.col("n")).cast("long"))
    share = F.when(F.col("total") > 0, F.col("weight") / F.col("total")).otherwise(1 / F.col("n"))
    w = w.withColumn("ideal", (F.col("period") - F.col("n")) * share)
    w = w.withColumn("rest", F.round(F.col("ideal") - F.floor("ideal"), 9))
    left = F.col("period") - F.col("n") - F.sum(F.floor("ideal")).over(everyone)
    return w.withColumn("left", left).withColumn("nth", F.row_number().over(ordered)).select(
        "source", (1 + F.floor("ideal") + F.when(F.col("nth") <= F.col("left"), 1).otherwise(0)).cast("long").alias("slots"), "period")


def period_schedule(slots: DataFrame) -> DataFrame:
    """Earliest-deadline-first over one period: ``source, nth, in_period``, one row per slot.

    ``nth`` counts a source's blocks in the period from 0. The fold's state holds the next
    block of each source; there are as many steps as slots and as many entries as sources.
    """
    one = slots.groupBy("period").agg(F.array_sort(F.collect_list(F.struct(F.col("slots").alias("w"), F.col("source")))).alias("sources"))
    return one.select("period", "sources", F.expr("""
        aggregate(
          sequence(0L, period - 1),
          named_struct('done', transform(sources, s -> 0L), 'order', cast(array() as array<struct<k:int,nth:bigint>>)),
          (state, slot) -> transform(
            array(array_min(filter(
              transform(sources, (s, k) -> named_struct(
                'due', ((state.done[k] + 1) * period + s.w - 1) div s.w,
                'share', -s.w, 'k', k, 'nth', state.done[k])),
              c -> c.nth + c.share < 0 and (c.nth * period) div (-c.share) <= slot))),
            pick -> named_struct(
              'done', transform(state.done, (d, k) -> if(k = pick.k, d + 1, d)),
              'order', concat(state.order, array(named_struct('k', pick.k, 'nth', pick.nth)))))[0],
          state -> state.order)""").alias("order")).select(
        "period", "sources", F.posexplode("order").alias("in_period", "o"),
    ).select(
        F.col("sources")[F.col("o.k")]["source"].alias("source"), F.col("sources")[F.col("o.k")]["w"].alias("slots"),
        F.col("o.nth").alias("nth"), F.col("in_period").cast("long").alias("in_period"), "period",
    )


def numbered(docs: DataFrame, row: str) -> DataFrame:
    """``docs`` with its row's number in its source, from 0, in order of the id's MD5, as ``row``."""
    source, cell, digest, before, nth = fresh(docs, "mix_source", "mix_cell", "mix_digest", "mix_before", "mix_nth")
    md5 = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    bits = F.shiftright(F.conv(F.substring(md5, 1, 8), 16, 10).cast("long"), 32 - CELL_BITS).cast("int")
    counts = docs.groupBy(F.col("source").alias(source), bits.alias(cell)).agg(F.count(F.lit(1)).alias("rows"))
    earlier = Window.partitionBy(source).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col(source).alias(source + "_of"), F.col(cell).alias(cell + "_of"),
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias(before))
    rows = docs.withColumn(digest, md5).withColumn(cell, bits)
    order = Window.partitionBy("source", cell).orderBy(digest, F.col("doc_id").asc_nulls_first())
    rows = rows.withColumn(nth, F.row_number().over(order) - 1)
    joined = rows.join(offsets, rows["source"].eqNullSafe(F.col(source + "_of")) & (F.col(cell) == F.col(cell + "_of")))
    return joined.select(*(docs[c] for c in docs.columns), (F.col(before) + F.col(nth)).alias(row))


def mix(docs: DataFrame, weights: DataFrame | None = None, period: int = PERIOD, block: int = BLOCK) -> DataFrame:
    """``docs`` in mixed order: all rows and columns, with ``mix_slot`` and ``mix_position``.

    ``mix_position`` is unique and orders the mixture; a slot holds one block of one source.
    ``weights(source, weight)`` defaults to :func:`square_root_weights`; a source without a
    weight counts as weight 0 and has one slot a period. Null is a source of its own. Rows that
    repeat an id get positions of their own.
    """
    row, source, nth, slots, in_period, length = fresh(docs, "mix_row", "mix_source", "mix_nth", "mix_slots", "mix_in_period", "mix_period")
    listed = docs.select("source").distinct()
    if weights is None:
        weights = square_root_weights(docs)
    else:
        w = weights.groupBy(F.col("source").alias("of")).agg(F.sum("weight").alias("weight"))
        weights = listed.join(w, F.col("source").eqNullSafe(F.col("of")), "left").select("source", "weight")
    shares = slots_per_period(weights, period)
    timetable = period_schedule(shares).select(
        F.col("source").alias(source), F.col("nth").alias(nth), F.col("in_period").alias(in_period))
    shares = shares.select(F.col("source").alias(source), F.col("slots").alias(slots), F.col("period").alias(length))
    rows = numbered(docs, row)
    rows = rows.join(shares, rows["source"].eqNullSafe(F.col(source))).drop(source)
    turn = F.floor(F.col(row) / block)
    rows = rows.withColumn(nth + "_of", F.pmod(turn, F.col(slots)))
    rows = rows.join(timetable, rows["source"].eqNullSafe(F.col(source)) & (F.col(nth + "_of") == F.col(nth)))
    slot = F.floor(turn / F.col(slots)) * F.col(length) + F.col(in_period)
    return rows.select(
        *(docs[c] for c in docs.columns), slot.alias("mix_slot"),
        (slot * block + F.pmod(F.col(row), F.lit(block))).alias("mix_position"),
    )


def whole_parts(weights: list[float]) -> list[int]:
    """Positive weights as whole numbers, at least 1 each, that add up to ``PARTS`` if none had to be raised."""
    largest = max(weights)
    total = math.fsum(w / largest for w in weights)
    ideal = [w / largest / total * PARTS for w in weights]
    parts = [math.floor(x) for x in ideal]
    by_rest = sorted(range(len(parts)), key=lambda k: parts[k] - ideal[k])
    for k in by_rest[: max(0, PARTS - sum(parts))]:
        parts[k] += 1
    return [max(1, p) for p in parts]


def dealing_paths(parts: list[int]) -> list[list[tuple[int, int, int]]]:
    """For each leaf of the Huffman tree its steps ``(parts, half, whole)`` up to the root."""
    nodes = [(p, k) for k, p in enumerate(parts)]
    heapq.heapify(nodes)
    above: dict[int, tuple[int, tuple[int, int, int]]] = {}
    while len(nodes) > 1:
        (p, left), (r, right) = heapq.heappop(nodes), heapq.heappop(nodes)
        whole, node = p + r, len(parts) + len(above) // 2
        above[left] = node, (p, whole // 2, whole)
        above[right] = node, (r, whole - 1 - whole // 2, whole)
        heapq.heappush(nodes, (whole, node))
    paths = []
    for k in range(len(parts)):
        steps = []
        while k in above:
            k, step = above[k]
            steps.append(step)
        paths.append(steps)
    return paths


def slot_of(turn: int, steps: list[tuple[int, int, int]]) -> int:
    """The slot, from 0, of a source's block number ``turn``, from 0."""
    at = turn + 1
    for parts, half, whole in steps:
        at = (at * whole - half + parts - 1) // parts
    return at - 1


def timetable(sources: list[tuple]) -> list[tuple]:
    """``(source, first slot, steps)`` of each ``(source, blocks, weight)``.

    Weights that are null, negative or not finite count as 0. Sources of weight 0 share
    equally the slots after the last one of the others.
    """
    positive = [w is not None and 0 < w < float("inf") for _, _, w in sources]
    out, begin = [], 0
    for wanted in (True, False):
        group = [(s, blocks, w if wanted else 1.0) for (s, blocks, w), p in zip(sources, positive, strict=True) if p == wanted]
        if group:
            paths = dealing_paths(whole_parts([w for _, _, w in group]))
            out += [(s, begin, steps) for (s, _, _), steps in zip(group, paths, strict=True)]
            begin += 1 + max(slot_of(blocks - 1, steps) for (_, blocks, _), steps in zip(group, paths, strict=True))
    return out


def mix_exact(docs: DataFrame, weights: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """Like :func:`mix`, but following the weights themselves, at any number of rows and sources.

    A source without a weight counts as weight 0 and comes after those that have one. One row
    a source is gathered, with its count and weight; documents are not.
    """
    row, source, begin, steps = fresh(docs, "mix_row", "mix_source", "mix_begin", "mix_steps")
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("rows"))
    if weights is None:
        given = counts.withColumn("weight", F.sqrt(F.col("rows").cast("double")))
    else:
        clean = F.when((F.col("weight") > 0) & (F.col("weight") < float("inf")), F.col("weight").cast("double"))
        w = weights.groupBy(F.col("source").alias("of")).agg(F.sum(clean).alias("weight"))
        given = counts.join(w, F.col("source").eqNullSafe(F.col("of")), "left")
    known = [(r["source"], -(-r["rows"] // block), r["weight"]) for r in given.select("source", "rows", "weight").collect()]
    known.sort(key=lambda r: (r[0] is not None, str(r[0])))
    placed = timetable(known)
    step = T.StructType([T.StructField(n, T.LongType()) for n in ("parts", "half", "whole")])
    schema = T.StructType([T.StructField(source, docs.schema["source"].dataType), T.StructField(begin, T.LongType()), T.StructField(steps, T.ArrayType(step))])
    table = pa.table({
        source: pa.array([p[0] for p in placed]), begin: pa.array([p[1] for p in placed], pa.int64()),
        steps: pa.array(
            [[dict(zip(("parts", "half", "whole"), s, strict=True)) for s in p[2]] for p in placed],
            pa.list_(pa.struct([(n, pa.int64()) for n in ("parts", "half", "whole")])))})
    paths = docs.sparkSession.createDataFrame(table, schema) if placed else docs.sparkSession.createDataFrame([], schema)
    rows = numbered(docs, row)
    rows = rows.join(paths, rows["source"].eqNullSafe(F.col(source)))
    turn = F.floor(F.col(row) / block)
    up = F.aggregate(steps, turn + 1, lambda at, s: F.call_function(
        "div", at * s["whole"] - s["half"] + s["parts"] - 1, s["parts"]))
    slot = F.col(begin) + up - 1
    return rows.select(
        *(docs[c] for c in docs.columns), slot.alias("mix_slot"),
        (slot * block + F.pmod(F.col(row), F.lit(block))).alias("mix_position"),
    )
