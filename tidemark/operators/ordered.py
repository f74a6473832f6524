"""One pass over rows in order, for keys of any size.

Rows are range-partitioned and sorted by key and order, so a key with most of the rows lies in
many partitions, cut where the data are dense. A pass streams through each partition and keeps
one row of state. What a partition leaves open at its border is one row, so the borders of a key
are folded over at most as many rows as there are partitions, and joined back to those alone.

The result of a pass is stored: islands or positions, never the input rows with all their columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.lineage import stored
from tidemark.session import send_package

#: Number of the range partition; ascending along keys and order.
PART = "_part"


def key_starts(keys: Sequence[pa.Array], n: int) -> np.ndarray:
    """True at rows whose key differs from the row before; the first row always."""
    new = np.zeros(n, bool)
    if n:
        new[0] = True
    for column in keys:
        a, b = column.slice(1), column.slice(0, n - 1)
        same = pc.fill_null(pc.equal(a, b), pc.and_(pc.is_null(a), pc.is_null(b)))
        same = pc.if_else(pc.and_(pc.is_null(a), pc.is_null(b)), True, same)
        new[1:] |= ~same.to_numpy(zero_copy_only=False)
    return new


def running_max(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The largest value so far within each segment."""
    order, rank = np.unique(values, return_inverse=True)
    level = (np.cumsum(starts) - 1) * len(order)
    return order[np.maximum.accumulate(level + rank) - level]


def _chained(rows: pa.RecordBatch, n_keys: int, gap: int, by_reach: bool) -> pa.RecordBatch:
    """Sorted rows ``keys, _s, _e`` as islands of the same columns.

    By reach, a row joins what ends latest so far and an island ends with its latest end; else the
    row before it decides, equal starts count as their last row, and an island ends with its last row.
    """
    starts = key_starts(rows.columns[:n_keys], rows.num_rows)
    s, e = (rows.column(n_keys + k).to_numpy() for k in (0, 1))
    if not by_reach:
        last = np.append((s[1:] != s[:-1]) | starts[1:], True)
        rows = rows.filter(pa.array(last))
        starts = key_starts(rows.columns[:n_keys], rows.num_rows)
        s, e = s[last], e[last]
    reach = running_max(e, starts) if by_reach else e
    begins = starts.copy()
    begins[1:] |= s[1:] - reach[:-1] >= gap
    first = np.flatnonzero(begins)
    ends = np.maximum.reduceat(e, first) if by_reach else e[np.append(first[1:], len(s)) - 1]
    kept = [c.take(pa.array(first)) for c in rows.columns[:n_keys]]
    return pa.RecordBatch.from_arrays([*kept, pa.array(s[first]), pa.array(ends)], names=rows.schema.names)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if len(parts) > 1 else parts[0]


def range_sorted(df: DataFrame, order: Sequence[str]) -> DataFrame:
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def local_islands(df: DataFrame, keys: Sequence[str], ties: Sequence[str], gap: int, by_reach: bool) -> DataFrame:
    """Islands of each range partition: ``keys, _s, _e, _part``, stored.

    An island is itself a row of its start and end, so the open one just goes before the next batch.
    """
    keys, n_keys = list(keys), len(keys)
    columns = [*keys, "_s", "_e"]
    schema = T.StructType([*df.select(*columns).schema.fields, T.StructField(PART, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        open_: list[pa.RecordBatch] = []  # the open island, and the last row, which may have an equal start

        def out(rows: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.full(rows.num_rows, part))], names=schema.names)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _joined([*open_, batch.select(columns)])
            held = rows.slice(rows.num_rows - 1)
            if rows.num_rows == 1:
                open_ = [held]
                continue
            # the last row waits, as the next batch may begin with one of equal start
            islands = _chained(rows.slice(0, rows.num_rows - 1), n_keys, gap, by_reach)
            yield out(islands.slice(0, islands.num_rows - 1))
            open_ = [islands.slice(islands.num_rows - 1), held]
        if open_:
            yield out(_chained(_joined(open_), n_keys, gap, by_reach))

    send_package(df.sparkSession)
    rows = range_sorted(df.select(*columns, *ties), [*keys, "_s", *ties, "_e"]).select(*columns)
    return stored(rows.mapInArrow(run, schema), "islands")


def _borders(keys: Sequence[str]) -> tuple:
    """Windows over the partitions of a key: the earlier ones, and those up to the current one."""
    over = Window.partitionBy(*keys).orderBy(PART)
    return over.rowsBetween(Window.unboundedPreceding, -1), over.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def with_border(df: DataFrame, border: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``border`` has a row for each partition that goes on with the key of the one before: no more
    than there are partitions, which bounds what is broadcast."""
    return df.join(F.broadcast(border), [*keys, PART], "left")


def merged_islands(df: DataFrame, keys: Sequence[str], gap: int) -> DataFrame:
    """``keys, _island, _end``: rows joined while they start less than ``gap`` after the latest end so far."""
    pieces = local_islands(df, keys, (), gap, True)
    before, so_far = _borders(keys)
    reach = F.max("_reach").over(before)
    border = (
        pieces.groupBy(*keys, PART).agg(F.max("_e").alias("_reach"), F.max("_s").alias("_last"))
        .withColumn("_before", reach)
        .withColumn("_open", F.when(F.col("_before").isNull() | (F.col("_last") - F.col("_before") >= gap), F.col("_last")))
        .withColumn("_carried", F.last("_open", ignorenulls=True).over(before))
        .where(F.col("_before").isNotNull())
        .select(*keys, PART, "_before", "_carried")
    )
    joins = F.col("_before").isNotNull() & (F.col("_s") - F.col("_before") < gap)
    placed = with_border(pieces, border, keys).withColumn("_island", F.when(joins, F.col("_carried")).otherwise(F.col("_s")))
    return placed.groupBy(*keys, "_island").agg(F.max("_e").alias("_end"))


def merged_runs(df: DataFrame, keys: Sequence[str], ties: Sequence[str], gap: int) -> DataFrame:
    """``keys, _island, _end``: rows joined while they start less than ``gap`` after the end of the row before."""
    pieces = local_islands(df, keys, ties, gap, False)
    before, _ = _borders(keys)
    over = Window.partitionBy(*keys).orderBy(PART)
    border = (
        pieces.groupBy(*keys, PART)
        .agg(F.count("*").alias("_n"), F.min("_s").alias("_first"), F.max("_s").alias("_last"), F.max_by("_e", "_s").alias("_end"))
        .withColumn("_before", F.lag("_end").over(over))
        .withColumn("_joins", F.coalesce(F.col("_first") - F.col("_before") < gap, F.lit(False)))
        .withColumn("_open", F.when((F.col("_n") > 1) | ~F.col("_joins"), F.col("_last")))
        .withColumn("_carried", F.last("_open", ignorenulls=True).over(before))
        .where("_joins")
        .select(*keys, PART, F.col("_first").alias("_border"), "_carried")
    )
    placed = with_border(pieces, border, keys)
    island = F.when(F.col("_s") == F.col("_border"), F.col("_carried")).otherwise(F.col("_s"))
    return placed.withColumn("_island", island).groupBy(*keys, "_island").agg(F.max_by("_e", "_s").alias("_end"))


def positions(df: DataFrame, keys: Sequence[str], order: str, out: str, weight: str | None = None) -> DataFrame:
    """Add ``out``, the zero-based position of each row in ``order`` within ``keys``; the rows are stored.

    With ``weight`` (a long column) a row counts that often: ``out`` is the sum of the rows before.
    """
    keys, fields = list(keys), df.schema.fields
    schema = T.StructType([*fields, T.StructField(PART, T.LongType()), T.StructField(out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, carried = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            columns = [batch.column(k) for k in keys]
            first = np.flatnonzero(key_starts(columns, n))
            counts = np.ones(n, np.int64) if weight is None else batch.column(weight).to_numpy()
            sums = np.cumsum(counts) - counts
            at = sums - np.repeat(sums[first], np.diff(np.append(first, n)))
            if last is not None and [c[0].as_py() for c in columns] == last:
                at[: first[1] if len(first) > 1 else n] += carried
            last, carried = [c[n - 1].as_py() for c in columns], int(at[-1] + counts[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part)), pa.array(at)], names=schema.names)

    send_package(df.sparkSession)
    local = stored(range_sorted(df, [*keys, order]).mapInArrow(run, schema), "positions")
    before, _ = _borders(keys)
    border = (
        local.groupBy(*keys, PART).agg((F.count("*") if weight is None else F.sum(weight)).alias("_rows"))
        .withColumn("_offset", F.sum("_rows").over(before))
        .where(F.col("_offset").isNotNull()).select(*keys, PART, "_offset")
    )
    moved = F.col(out) + F.coalesce("_offset", F.lit(0))
    return with_border(local, border, keys).withColumn(out, moved).drop(PART, "_offset")


def next_within(df: DataFrame, keys: Sequence[str], order: Sequence[Column], micros: Column, cap: int, out: str) -> DataFrame:
    """Add ``out``, the next row's microseconds if that row starts less than ``cap`` after; else null or more.

    Every key is cut into slices of four times ``cap``. A row near the beginning of its slice is
    listed in the slice before as well, where it only serves as a successor. So one shuffle is
    enough, no row is joined, and a key with most of the rows is spread over its slices.
    """
    width = F.lit(4 * cap).cast("bigint")
    in_slice = F.pmod(F.col("_at"), width)
    slice_ = ((F.col("_at") - in_slice) / width).cast("bigint")
    listed = F.when(in_slice < cap, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = df.withColumn("_at", micros).withColumn("_back", F.explode(listed)).withColumn("_slice", slice_ - F.col("_back"))
    over = Window.partitionBy(*keys, "_slice").orderBy("_at", *order)
    return rows.withColumn(out, F.lead("_at").over(over)).where("_back = 0").drop("_at", "_back", "_slice")
