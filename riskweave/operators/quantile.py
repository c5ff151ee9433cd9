"""Exact quantiles without holding a column in one task.

``percentile`` / ``median`` keep every distinct value of a group in one
aggregation buffer and merge the buffers of a group in a single task, so
their memory grows with the data. The form here is exact (linear
interpolation between the two ranks around ``(n - 1) * p``, as pandas and
SQL ``QUANTILE_CONT`` do) and fully distributed — a two-pass selection:

1. one sketch pass gives ``k - 1`` equi-depth split points per column and
   group, and each value gets its bucket index, monotone in the value; the
   sketch is part of the plan, so nothing runs while the plan is built;
2. rows are counted per (column, group, bucket) — map-side partial
   aggregation, so the shuffle carries at most ``#tasks x k`` rows per
   column and group; a prefix over those few bucket totals gives each
   bucket its first rank, and the buckets whose rank interval holds a
   target rank (at most two per probability and group) form a tiny table;
3. only the rows of those buckets (about ``2 |probs| / k`` of the data) are
   counted per distinct value and ordered inside their bucket; the values
   that cover the target ranks give the interpolated quantile.

A value that holds a third of the rows is one row per task after the
partial aggregation of step 3. ``by`` must name columns with a bounded
number of groups (e.g. a class label): the bucket table is broadcast.

``stacked_quantiles`` takes any set of (key, group, value) rows, so one
selection can serve several reports (``profile.profile_report``).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prefix import power_of_two, split_points, with_bucket

#: Value buckets per column and group: the rows that are ordered (the target
#: buckets) are about ``2 |probs| / N_BUCKETS`` of a column.
N_BUCKETS = 256


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                    by: Sequence[str] = (), key: str = "column_name", out: str = "q",
                    n_buckets: int = N_BUCKETS) -> DataFrame:
    """One row per (``key``, ``*by``) with at least one non-null value:
    ``out`` is the array of quantiles of the column at ``probs``."""
    cols, by = list(cols), list(by)
    # the shuffles carry a small column index; the name is put back at the end
    stacked = df.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("_ci"), *[F.col(b) for b in by],
                 F.col(c).cast("double").alias("x")) for i, c in enumerate(cols)])))
    q = stacked_quantiles(stacked, ["_ci", *by], probs, out, n_buckets)
    name = F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("_ci") + 1)
    return q.select(name.alias(key), *by, out)


def sketch_groups(stacked: DataFrame, group: Sequence[str], n_buckets: int = N_BUCKETS,
                  *more: Column) -> DataFrame:
    """Split points ``_splits`` of ``x`` per group, with ``more`` aggregates
    of the same pass."""
    return stacked.groupBy(*group).agg(split_points("x", power_of_two(n_buckets)).alias("_splits"),
                                       *more)


def stacked_quantiles(stacked: DataFrame, group: Sequence[str], probs: Sequence[float],
                      out: str = "q", n_buckets: int = N_BUCKETS,
                      splits: DataFrame | None = None) -> DataFrame:
    """Quantiles of the column ``x`` (double) per ``group``, NULLs skipped.
    ``splits`` may hold the groups' ``sketch_groups`` already."""
    group, probs = list(group), [float(p) for p in probs]
    k = power_of_two(n_buckets)
    stacked = stacked.filter(F.col("x").isNotNull())
    if splits is None:
        splits = sketch_groups(stacked, group, k)
    # a NULL group is a group, so the joins must match it
    tags = {g: f"_g{i}" for i, g in enumerate(group)}

    def join(left: DataFrame, right: DataFrame, also: Sequence[str] = ()) -> DataFrame:
        right = right.withColumnsRenamed({**tags, **{c: f"_g{c}" for c in also}})
        on = [F.col(g).eqNullSafe(F.col(t)) for g, t in tags.items()]
        on += [F.col(c) == F.col(f"_g{c}") for c in also]
        return left.join(F.broadcast(right), reduce(lambda a, b: a & b, on)).drop(
            *tags.values(), *[f"_g{c}" for c in also])

    stacked = with_bucket(join(stacked, splits.select(*group, "_splits")), F.col("x"),
                          "_splits", k, "_b").withColumnRenamed("x", "_x")

    # pass 2: bucket totals, each bucket's first rank, the group size
    totals = stacked.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_t"))
    in_order = Window.partitionBy(*group).orderBy("_b")
    spans = totals.select(
        *group, "_b", "_t",
        F.coalesce(F.sum("_t").over(in_order.rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off"),
        F.sum("_t").over(Window.partitionBy(*group)).alias("_n"))
    pos = {i: (F.col("_n") - 1) * F.lit(p) for i, p in enumerate(probs)}
    targets = [c for i in pos for c in (
        pos[i].alias(f"_pos{i}"), F.floor(pos[i]).alias(f"_lo{i}"),
        F.ceil(pos[i]).alias(f"_hi{i}"))]
    ranks = [f"_{side}{i}" for i in pos for side in ("lo", "hi")]

    def covers(first: Column, end: Column, rank: str) -> Column:
        return (first <= F.col(rank)) & (F.col(rank) < end)

    # at most 2 |probs| buckets per group: a bounded table, broadcast. It is
    # read once, so the bucket-total pass runs once.
    hot = spans.select("*", *targets).filter(reduce(or_, [
        covers(F.col("_off"), F.col("_off") + F.col("_t"), r) for r in ranks])) \
        .select(*group, "_b", "_off", "_n")

    # pass 3: distinct values of the hot buckets only, ordered in their
    # bucket (``_off`` and ``_n`` are constant per bucket)
    distinct = (join(stacked, hot, ["_b"])
                .groupBy(*group, "_b", "_off", "_n", "_x").agg(F.count(F.lit(1)).alias("_m")))
    in_bucket = Window.partitionBy(*group, "_b").orderBy("_x").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    cum = distinct.withColumn("_c", F.col("_off") + F.sum("_m").over(in_bucket)) \
        .select("*", *targets)
    first = F.col("_c") - F.col("_m")       # rank of the value's first copy
    hits = cum.filter(reduce(or_, [covers(first, F.col("_c"), r) for r in ranks]))
    picked = hits.groupBy(*group, *[f"_pos{i}" for i in pos], *[f"_lo{i}" for i in pos]).agg(
        *[F.max(F.when(covers(first, F.col("_c"), r), F.col("_x"))).alias(f"_v{r}")
          for r in ranks])
    values = []
    for i in pos:
        lo, hi = F.col(f"_v_lo{i}"), F.col(f"_v_hi{i}")
        values.append(lo + (hi - lo) * (F.col(f"_pos{i}") - F.col(f"_lo{i}")))
    return picked.select(*group, F.array(*values).alias(out))


def exact_median(df: DataFrame, col: str) -> Column:
    """Scalar-subquery column holding the exact median of ``col`` (NULL when
    the column has no value)."""
    return exact_quantiles(df, [col], [0.5]).select(F.col("q")[0]).scalar()
