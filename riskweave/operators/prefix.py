"""Global order without a single partition.

A window with ``orderBy`` and no ``partitionBy`` moves every row into one
task (``Exchange SinglePartition``). The helpers here split the order into
buckets instead:

1. every row gets a bucket id whose order agrees with the sort order;
2. a per-bucket total is aggregated (map-side partial aggregation, so the
   shuffle carries one row per bucket and task);
3. a prefix sum over the *bucket totals* gives each bucket its offset — a
   window over at most ``#buckets`` rows;
4. the offsets are joined back on the bucket id and the running value is the
   offset plus a window inside ``partitionBy(bucket)``.

The big data is shuffled once, by bucket; the join and the window share that
partitioning. Buckets are equi-depth: split points come from one
``percentile_approx`` sketch that is part of the plan (a scalar subquery, so
nothing runs while the plan is built), and a row finds its bucket by binary
search in that array. No bucket holds more than about ``rows / n_buckets``
rows of a unique key; the number of buckets follows the size of the input, not
the session.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of a global order.
N_BUCKETS = 1024
_BUCKET = "_rw_bucket"
_OFFSET = "_rw_off_"


def split_points(x: Column | str, n_buckets: int) -> Column:
    """Aggregate: the ``n_buckets - 1`` equi-depth split points of ``x`` as an
    ascending array (a quantile sketch, merged map-side)."""
    probs = F.array(*[F.lit(i / n_buckets) for i in range(1, n_buckets)])
    return F.percentile_approx(x, probs, F.lit(4 * n_buckets))


def with_bucket(df: DataFrame, x: Column, splits: str, n_buckets: int, out: str) -> DataFrame:
    """Add ``out``: how many entries of the array column ``splits`` are not
    above ``x`` (0 for NULL, as NULL sorts first). ``n_buckets`` is a power of
    two. The binary search is one expression over its step widths: a chain of
    projections would stay in generated code but takes the optimizer seconds."""
    steps = [n_buckets >> i for i in range(1, n_buckets.bit_length())]

    def step(at: Column, width: Column) -> Column:
        return at + F.when(F.get(splits, at + width - F.lit(1)) <= x, width).otherwise(F.lit(0))

    found = F.aggregate(F.array(*[F.lit(w) for w in steps]), F.lit(0), step)
    return df.withColumn(out, found).drop(splits)


def power_of_two(n: int) -> int:
    """The smallest power of two that is ``n`` at least, and at least 2."""
    return 1 << max(1, (int(n) - 1).bit_length())


def equi_depth_bucket(df: DataFrame, key: str, n_buckets: int = N_BUCKETS,
                      out: str = _BUCKET) -> DataFrame:
    """Add ``out``: index of the equi-depth bucket of ``key`` (ascending,
    NULL first)."""
    n = power_of_two(n_buckets)
    x = F.col(key).cast("double")
    splits = df.select(x.alias("x")).agg(split_points("x", n)).scalar()
    return with_bucket(df.withColumn("_rw_splits", splits), x, "_rw_splits", n, out)


def running_sum(df: DataFrame, values: dict[str, Column | str], order: Sequence[str],
                bucket: str, partition: Sequence[str] = (),
                broadcast_offsets: bool = False, inclusive: bool = True) -> DataFrame:
    """Add a running sum per entry of ``values`` (``out name -> value``).

    Rows are ordered by ``partition``, then ``bucket``, then ``order``;
    ``bucket`` must be monotone in that order. ``inclusive`` counts the
    current row. The offset table has one row per (partition, bucket): pass
    ``broadcast_offsets=True`` only when that count has a fixed bound.
    """
    part = list(partition)
    cols = {name: (F.col(v) if isinstance(v, str) else v) for name, v in values.items()}
    tmp = {name: f"_rw_v_{name}" for name in cols}
    data = df.withColumns({tmp[n]: c for n, c in cols.items()})
    totals = data.groupBy(*part, bucket).agg(
        *[F.sum(tmp[n]).alias(f"_rw_t_{n}") for n in cols])
    w_bucket = (Window.partitionBy(*part).orderBy(bucket) if part
                else Window.orderBy(bucket)).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *part, bucket,
        *[F.coalesce(F.sum(f"_rw_t_{n}").over(w_bucket), F.lit(0)).alias(_OFFSET + n)
          for n in cols])
    if broadcast_offsets:
        offsets = F.broadcast(offsets)
    joined = data.join(offsets, [*part, bucket], "inner")
    w_row = Window.partitionBy(*part, bucket).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    out = joined.withColumns({
        n: F.col(_OFFSET + n) + F.coalesce(F.sum(tmp[n]).over(w_row), F.lit(0))
        for n in cols})
    return out.drop(*tmp.values(), *[_OFFSET + n for n in cols])


#: Input bytes for which one more bucket is used, and the bounds of their number.
BUCKET_BYTES, FEWEST_BUCKETS, MOST_BUCKETS = 32 << 20, 64, 1 << 16


def buckets_for(df: DataFrame) -> int:
    """How many buckets the size of what ``df`` reads asks for: one for each
    BUCKET_BYTES of its sources, by the plan's statistics, so no job runs.
    Up to MOST_BUCKETS of them (2 TB of files) a task orders about the rows of
    BUCKET_BYTES, beyond that proportionally more."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return power_of_two(min(MOST_BUCKETS, max(FEWEST_BUCKETS, -(-size // BUCKET_BYTES))))


def global_row_number(df: DataFrame, key: str, out: str = "row_num",
                      n_buckets: int | None = None) -> DataFrame:
    """``ROW_NUMBER() OVER (ORDER BY key)`` without a single-partition
    exchange. ``key`` should be unique (ties are numbered arbitrarily). The
    offsets have one row per bucket, so they are broadcast. By default the
    number of buckets follows the size of the input (``buckets_for``)."""
    n_buckets = n_buckets or buckets_for(df)
    bucketed = equi_depth_bucket(df, key, n_buckets)
    ranked = running_sum(bucketed, {out: F.lit(1).cast("bigint")}, order=[key],
                         bucket=_BUCKET, broadcast_offsets=True)
    return ranked.drop(_BUCKET)
