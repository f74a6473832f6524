"""Exact percentiles and tie-averaged ranks for groups of any size."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import positions

#: Accuracy of quantile sketches: ranks are off by at most one in so many.
SKETCH = 10_000
#: What is known on each percentile: the value before its cuts, how many are below, how many at the
#: lower cut, those between, how many at the upper cut, and the value after it.
PARTS = ("under", "below", "low", "between", "high", "above")


def value_positions(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """One row per distinct value: ``groups, value, _n, _lo``.

    ``_lo`` is the number of smaller values in the group, ``_n`` how often the
    value occurs. Equal values are counted before they are put in order.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("_n"))
    return positions(counted, groups, value, "_lo", "_n")


class Percentiles:
    """Exact percentiles of one value column in two reads, whatever the size of a group.

    The first aggregation also builds a mergeable quantile sketch and takes cut points on either
    side of each percentile from it (``sketches``). The second counts what lies below and at the
    cuts and keeps only the few values between them (``counts``), from which the values at the
    wanted ranks are read (``points``, ``result``). A sketch's rank error is below a quarter of the distance
    left to the cuts; should a rank still fall outside, the query fails rather than be wrong.
    """

    def __init__(self, value: str, probs: Sequence[float], prefix: str = "_p") -> None:
        self.value, self.probs, self.prefix = value, [float(p) for p in probs], prefix

    def _names(self, i: int, *parts: str) -> list[str]:
        return [f"{self.prefix}{part}{i}" for part in parts]

    def sketches(self) -> list[Column]:
        """Aggregates of the first read: the number of values and the cut points."""
        margin = 4.0 / SKETCH
        # a NaN counts as the largest value, which the sketch knows as infinity
        x = F.col(self.value)
        known = F.when(F.isnan(x), F.lit(float("inf"))).otherwise(x)
        cuts = [c for p in self.probs for c in (max(0.0, p - margin), min(1.0, p + margin))]
        return [F.count(x).alias(f"{self.prefix}n"), F.approx_percentile(known, cuts, SKETCH).alias(f"{self.prefix}cuts")]

    def counts(self) -> list[Column]:
        """Aggregates of the second read, whose rows carry the first read's results."""
        x, cuts, out = F.col(self.value), F.col(f"{self.prefix}cuts"), [F.first(c).alias(c) for c in (f"{self.prefix}n", f"{self.prefix}cuts")]
        for i in range(len(self.probs)):
            low, high = cuts[2 * i], cuts[2 * i + 1]
            under, below, at_low, between, at_high, above = self._names(i, *PARTS)
            out += [
                F.max(F.when(x < low, x)).alias(under), F.count_if(x < low).alias(below), F.count_if(x == low).alias(at_low),
                F.sort_array(F.collect_list(F.when((x > low) & (x < high), x))).alias(between),
                F.count_if((x == high) & (high > low)).alias(at_high), F.min(F.when(x > high, x)).alias(above),
            ]
        return out

    def points(self) -> list[Column]:
        """Of each percentile the values at the ranks around it, and the part of the way between them."""
        n, out = F.col(f"{self.prefix}n"), []
        for i, p in enumerate(self.probs):
            rank = F.lit(p) * (n - 1)
            low = F.floor(rank)
            columns = self._at(i, low), self._at(i, F.least(low + 1, n - 1)), rank - low
            out += [F.when(n > 0, c).alias(name) for c, name in zip(columns, self._names(i, "a", "b", "f"), strict=True)]
        return out

    def result(self) -> Column:
        """``array<double>`` with linear interpolation between ranks, null without values."""
        results = []
        for i in range(len(self.probs)):
            a, b, f = map(F.col, self._names(i, "a", "b", "f"))
            # at a rank itself, and between infinities, no difference is taken
            between = F.when(F.abs(b - a) < float("inf"), a + (b - a) * f).otherwise(a * (1 - f) + b * f)
            results.append(F.when((f == 0) | (a == b), a).otherwise(between))
        return F.array(*results)

    def _at(self, i: int, rank: Column) -> Column:
        under, below, at_low, between, at_high, above = map(F.col, self._names(i, *PARTS))
        cuts, at = F.col(f"{self.prefix}cuts"), rank - below
        inside, size = at - at_low, F.size(between)
        return (
            F.when(at == -1, under)
            .when((at >= 0) & (inside < 0), cuts[2 * i])
            .when((inside >= 0) & (inside < size), F.get(between, inside.cast("int")))
            .when((inside >= size) & (inside < size + at_high), cuts[2 * i + 1])
            .when((inside == size + at_high) | F.isnan(above), above)
            .otherwise(F.raise_error(F.lit("a percentile outside its cuts")).cast("double")))


def aggregate(df: DataFrame, groups: Sequence[str], aggs: Sequence[Column], wanted: dict[str, Percentiles]) -> DataFrame:
    """``df.groupBy(groups).agg(aggs)`` with the percentiles ``wanted``, by name of their column.

    Rows meet their group's cuts in a join, which the adaptive plan splits where a group is large:
    the second aggregation groups by a struct, so it combines before a shuffle of its own.
    """
    groups, asked = list(groups), list(wanted.values())
    first = df.groupBy(*groups).agg(*aggs, *(c for w in asked for c in w.sketches()))
    known = [c for w in asked for c in (f"{w.prefix}n", f"{w.prefix}cuts")]
    plain = [c for c in first.columns if c not in {*groups, *known}]
    counts = [c for w in asked for c in w.counts()]
    points = [c for w in asked for c in w.points()]
    results = [w.result().alias(name) for name, w in wanted.items()]
    if not groups:
        row = first.select(F.struct(*known).alias("_row")).scalar()
        second = df.withColumn("_row", row).select("*", "_row.*").agg(*counts).select(*points).select(F.struct(*results)).scalar()
        return first.withColumn("_second", second).select(*plain, "_second.*")
    values = list(dict.fromkeys(w.value for w in asked))
    keys = {g: f"_key{i}" for i, g in enumerate(groups)}
    same = reduce(and_, (F.col(g).eqNullSafe(F.col(k)) for g, k in keys.items()))
    met = df.select(*groups, *values).join(first.withColumnsRenamed(keys), same)
    second = met.groupBy(F.struct(*groups).alias("_group")).agg(*(F.first(c).alias(c) for c in plain), *counts)
    return second.select("_group.*", *plain, *points).select(*groups, *plain, *results)


def exact_percentiles(
    df: DataFrame, groups: Sequence[str], value: str, probs: Sequence[float], out: str
) -> DataFrame:
    """``groups, out: array<double>`` with linear interpolation between ranks.

    Same result as ``percentile(value, probs)``, which holds a group's distinct
    values in one aggregation buffer; here nothing ever holds a group.
    """
    return aggregate(df.where(F.col(value).isNotNull()), groups, [], {out: Percentiles(value, probs)})


def average_ranks(df: DataFrame, groups: Sequence[str], ranks: dict[str, str]) -> DataFrame:
    """Add for each column the 1-based rank of its value in the group; ties share their mean position.

    ``ranks`` maps columns to the names of their ranks. All columns are ranked in one ordered
    pass, each value once however often it occurs.
    """
    of = {value: F.lit(i) for i, value in enumerate(ranks)}
    listed = df.select(*groups, F.inline(F.array(*(F.struct(i.alias("_of"), F.col(v).cast("double").alias("_value")) for v, i in of.items()))))
    mean = (F.col("_lo") + (F.col("_n") + 1) / 2.0).alias("_rank")
    ranked = value_positions(listed, [*groups, "_of"], "_value").select(*groups, "_of", "_value", mean)
    for value, out in ranks.items():
        own = ranked.where(F.col("_of") == of[value]).select(*groups, F.col("_value").alias(value), F.col("_rank").alias(out))
        df = df.join(own, [*groups, value], "left")
    return df


def average_rank(df: DataFrame, groups: Sequence[str], value: str, out: str) -> DataFrame:
    """Add the 1-based rank of ``value`` in its group; ties share their mean position."""
    return average_ranks(df, groups, {value: out})


def best_of(df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows of each key; each task ranks its own before any shuffle."""
    if not keys:
        return df.orderBy(*order).limit(limit)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= limit).drop("_rank")
