"""Exact quantiles of many (column, group) pairs from two passes (X11).

1. One aggregate over the stacked ``(target, group, value)`` rows gives every
   pair its row count, any further statistics, and for each probability ``p``
   two values from a mergeable sketch, at ``p - 2 e`` and ``p + 2 e``, where
   ``e = 1 / ACCURACY`` bounds the sketch's rank error: the quantile lies
   between them. A pair of up to ``2 * ACCURACY`` values takes its whole range.
2. A second pass counts, per pair, the rows between these intervals, and each
   distinct value inside one. The running count then reaches the target ranks
   at values inside the intervals, which are interpolated as pandas and SQL
   ``QUANTILE_CONT`` do. A rank outside its interval is an error, never
   another value.

Only the second pass orders values, those inside the intervals: one task gets
``12 / ACCURACY`` of a pair's distinct values at most, and a value that a
third of the rows hold is one row a task. All pairs share both passes.

The table of bounds (a row a pair) is kept; it is broadcast where the pairs are a fixed
list; with a ``by`` column, whose groups nobody bounds, it is counted first,
and joined without broadcast above ``MAX_GROUPS`` rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.kept import cached

#: Inverse of the sketch's rank error.
ACCURACY = 50_000
#: Most rows of bounds, of some hundred bytes each, that are broadcast.
MAX_GROUPS = 100_000
QUARTILES = (0.25, 0.5, 0.75)


@dataclass(frozen=True)
class Target:
    """What quantiles are taken of: a value, in groups of equal ``by`` (NULL
    is a group) or as a whole; rows whose value is NULL are skipped."""

    name: str
    value: Column
    by: Column | None = None


def stack(df: DataFrame, targets: Sequence[Target]) -> DataFrame:
    """One row per row and target: ``_t`` (the target's place), ``_g`` (the
    group as text, '' as a whole), ``x``."""
    return df.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("_t"), (F.lit("") if t.by is None else t.by.cast("string")).alias("_g"),
                 t.value.cast("double").alias("x")) for i, t in enumerate(targets)])))


def _same_group(left: DataFrame, right: DataFrame, broadcast: bool) -> DataFrame:
    right = right.withColumnsRenamed({"_t": "_t2", "_g": "_g2"})
    on = (F.col("_t") == F.col("_t2")) & F.col("_g").eqNullSafe(F.col("_g2"))
    return left.join(F.broadcast(right) if broadcast else right, on).drop("_t2", "_g2")


def select_quantiles(df: DataFrame, targets: Sequence[Target], probs: Sequence[float] = QUARTILES,
                     stats: Sequence[Column] = (), accuracy: int = ACCURACY) -> DataFrame:
    """``(_t, _g, n, *stats, q)``: per target and group the number of values,
    the aggregates ``stats`` of the column ``x`` and the array ``q`` of the
    quantiles at ``probs`` (NULL without a value), from two scans of ``df``."""
    probs = [float(p) for p in probs]
    stacked = stack(df, targets)
    around = [p + d * 2 / accuracy for d in (-1, 1) for p in probs]
    sketch = F.percentile_approx("x", F.array(*[F.lit(min(1.0, max(0.0, p))) for p in around]), F.lit(accuracy))
    bounds = stacked.groupBy("_t", "_g").agg(F.count("x").alias("n"), sketch.alias("_s"), *stats)
    # both passes and the result read it: kept, or each would scan ``df`` for its own columns
    bounds = cached(bounds)
    broadcast = all(t.by is None for t in targets) or bounds.count() <= MAX_GROUPS
    few = F.col("n") <= 2 * accuracy
    ends = []
    for k, p in enumerate(around):
        outer = float("-inf") if k < len(probs) else float("inf")
        ends.append(F.when(few | F.lit(not 0 < p < 1), F.lit(outer)).otherwise(F.col("_s")[k]).alias(f"_e{k}"))
    lows, highs = ([f"_e{k}" for k in range(lo, lo + len(probs))] for lo in (0, len(probs)))

    # rows between intervals differ in their slot alone, those inside also in x
    x = F.col("x")
    begun = sum((F.when(F.col(e) <= x, 1).otherwise(0) for e in lows), F.lit(0))
    over = sum((F.when(F.col(e) < x, 1).otherwise(0) for e in highs), F.lit(0))
    placed = _same_group(stacked.filter(x.isNotNull()), bounds.select("_t", "_g", *ends), broadcast).select(
        "_t", "_g", (begun + over).alias("_slot"), F.when(begun > over, x).alias("_x"))
    counted = placed.groupBy("_t", "_g", "_slot", "_x").agg(F.count(F.lit(1)).alias("_m"))
    group = Window.partitionBy("_t", "_g")
    upto = group.orderBy("_slot", "_x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counted.select("_t", "_g", "_x", (F.sum("_m").over(upto) - F.col("_m")).alias("_first"),
                            F.sum("_m").over(upto).alias("_end"), F.sum("_m").over(group).alias("_n"))
    at = {k: (F.col("_n") - 1) * F.lit(p) for k, p in enumerate(probs)}

    def value(rank: Column, name: str) -> Column:
        return F.max(F.when((F.col("_first") <= rank) & (rank < F.col("_end")), F.col("_x"))).alias(name)

    picked = ranked.groupBy("_t", "_g").agg(
        F.max("_n").alias("_n"), *[e for k, r in at.items() for e in (value(F.floor(r), f"_lo{k}"), value(F.ceil(r), f"_hi{k}"))])
    found = []
    for k, r in at.items():
        lo, hi = F.col(f"_lo{k}"), F.col(f"_hi{k}")
        found.append(F.when(lo.isNull() | hi.isNull(), F.raise_error(F.lit("a rank outside its interval")).cast("double"))
                     .otherwise(lo + (hi - lo) * (r - F.floor(r))))
    quantiles = picked.select(F.col("_t").alias("_t2"), F.col("_g").alias("_g2"), F.array(*found).alias("q"))
    kept = bounds.drop("_s")
    return kept.join(quantiles, (F.col("_t") == F.col("_t2")) & F.col("_g").eqNullSafe(F.col("_g2")), "left").drop("_t2", "_g2")
