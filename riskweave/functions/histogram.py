"""Equal-width histograms (X10) as one aggregation.

Bin edges follow numpy: ``edge_i = lo + i * (hi - lo) / bins`` with the last
edge exactly ``hi``, the last bin closed, and ``lo == hi`` widened to
``lo - 0.5 .. hi + 0.5``. The bin index is ``floor((x - lo) * bins / (hi - lo))``
corrected by one against the actual edges, as numpy does, so boundary values
land in the same bin.

Data-range edges come from a scalar subquery (one tiny aggregate that Spark
runs once and inlines as a literal) or, per group, from a small per-group
aggregate joined back; the counting itself is a ``groupBy`` with map-side
partial aggregation, so a skewed bin never gathers raw rows in one task.
Empty bins are filled from ``sequence(0, bins - 1)`` on the edge rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .exprs import clip_upper
from ..sources.kept import cached


def _bins(bins: int | Column) -> Column:
    return bins if isinstance(bins, Column) else F.lit(bins)


def _edge(i: Column, lo: Column, hi: Column, bins: int | Column) -> Column:
    b = _bins(bins)
    step = (hi - lo) / b.cast("double")
    return F.when(i >= b, hi).otherwise(i.cast("double") * step + lo)


def with_bin(df: DataFrame, bins: int | Column, x: str = "_x", lo: str = "_lo",
             hi: str = "_hi", out: str = "bin") -> DataFrame:
    """Add ``out``: numpy's bin of ``x`` for edges over [lo, hi]; -1 outside.

    Each step is its own projected column: the correction steps read the
    previous index twice, and Catalyst keeps a non-trivial expression that
    is read twice as a separate projection instead of copying it.
    """
    xc, loc, hic, b = F.col(x), F.col(lo), F.col(hi), _bins(bins)
    norm = b.cast("double") / (hic - loc)
    df = df.withColumn("_b_raw", F.floor((xc - loc) * norm))
    df = df.withColumn("_b_i0", F.when(F.col("_b_raw") >= b, (b - 1).cast("bigint"))
                       .otherwise(F.col("_b_raw")))
    i0 = F.col("_b_i0")
    df = df.withColumn("_b_i1", F.when(xc < _edge(i0, loc, hic, bins), i0 - 1).otherwise(i0))
    i1 = F.col("_b_i1")
    step_up = (xc >= _edge(i1 + 1, loc, hic, bins)) & (i1 != b - 1)
    inside = (xc >= loc) & (xc <= hic)
    # -1 marks "outside"; a non-nullable bin keeps the outer join below from
    # inferring an ``isnotnull(bin)`` filter that would copy this expression
    df = df.withColumn(out, F.coalesce(
        F.when(inside, F.when(step_up, i1 + 1).otherwise(i1)).cast("bigint"),
        F.lit(-1).cast("bigint")))
    return df.drop("_b_raw", "_b_i0", "_b_i1")


def _widen(lo0: Column, hi0: Column) -> tuple[Column, Column]:
    lo = F.when(lo0 == hi0, lo0 - 0.5).otherwise(lo0)
    hi = F.when(lo0 == hi0, hi0 + 0.5).otherwise(hi0)
    return lo, hi


def _join(left: DataFrame, right: DataFrame, keys, how: str, small: bool = False) -> DataFrame:
    """Join on ``keys`` where NULL equals NULL: a NULL group is a group."""
    right = right.withColumnsRenamed({k: f"{k}__r" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"{k}__r")) for k in keys]
    return left.join(F.broadcast(right) if small else right, on, how).drop(*[f"{k}__r" for k in keys])


def histogram(df: DataFrame, column: str, bins: int, lo: float | None = None,
              hi: float | None = None, by: Sequence[str] = (), shared_edges: bool = True,
              clip: float | None = None, where: Column | None = None) -> DataFrame:
    """Counts per equal-width bin of ``column``.

    ``lo``/``hi`` fix the range (values outside are not counted); otherwise
    the range is the data's min/max — over all rows when ``shared_edges``
    (one set of edges for every group in ``by``, as a stacked chart does), or
    per group. ``by`` must be a low-cardinality key (one edge row per group
    is broadcast). ``clip`` applies pandas ``clip(upper=clip)`` first; NULLs
    are never counted. Output: ``*by, bin, bin_lo, bin_hi, frequency``.
    """
    by = list(by)
    src = df if where is None else df.filter(where)
    x = F.col(column).cast("double")
    if clip is not None:
        x = clip_upper(x, clip)
    src = src.select(*by, x.alias("_x")).filter(F.col("_x").isNotNull())
    if bool(by) and not shared_edges and (lo is None or hi is None):
        # one edge row per group. ``by`` is a low-cardinality key (a class
        # label), so the edge table is broadcast: a shuffle join on a key with
        # a handful of values would send all rows to a handful of tasks.
        stats = src.groupBy(*by).agg(F.min("_x").alias("_lo0"), F.max("_x").alias("_hi0"))
        lo_g, hi_g = _widen(F.col("_lo0"), F.col("_hi0"))
        edged = _join(src, stats.select(*by, lo_g.alias("_lo"), hi_g.alias("_hi")), by,
                      "inner", small=True)
    else:
        if lo is not None and hi is not None:
            lo_c, hi_c = _widen(F.lit(float(lo)), F.lit(float(hi)))
        else:
            stats = src.select(F.struct(F.min("_x").alias("lo"),
                                        F.max("_x").alias("hi")).alias("s")).scalar()
            lo_c, hi_c = _widen(stats.getField("lo"), stats.getField("hi"))
        edged = src.withColumns({"_lo": lo_c, "_hi": hi_c})

    # bin -1 (values outside a fixed range) is counted too and so keeps its
    # group in the result. No filter on ``bin`` here: pushed down, it would
    # copy the whole index expression.
    group = [*by, "_lo", "_hi"]
    counts = with_bin(edged, bins).groupBy(*group, "bin").agg(F.count(F.lit(1)).alias("frequency"))
    # at most bins + 1 entries a group
    filled = counts.groupBy(*group).agg(F.map_from_entries(
        F.collect_list(F.struct("bin", "frequency"))).alias("_counts"))
    return (filled.select("*", F.explode(F.sequence(
                F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))).alias("bin"))
            .select(*by, "bin",
                    _edge(F.col("bin"), F.col("_lo"), F.col("_hi"), bins).alias("bin_lo"),
                    _edge(F.col("bin") + 1, F.col("_lo"), F.col("_hi"), bins).alias("bin_hi"),
                    F.coalesce(F.try_element_at("_counts", F.col("bin")),
                               F.lit(0).cast("bigint")).alias("frequency")))


class HistSpec(NamedTuple):
    """One data-range histogram of a bundle (the arguments of ``histogram``)."""
    column: str
    bins: int
    by: str | None = None
    clip: float | None = None
    where: Column | None = None
    shared_edges: bool = True


def data_range_histograms(df: DataFrame,
                          specs: dict[str, HistSpec | tuple]) -> dict[str, DataFrame]:
    """Several data-range histograms of ``df`` from **two** scans instead of
    three each.

    ``specs`` maps a name to a ``HistSpec`` (or its fields as a tuple):
    ``by`` is ``None`` or a low-cardinality column, whose groups share one
    set of edges (a stacked chart) unless ``shared_edges`` is False;
    ``clip`` and ``where`` act as in ``histogram``. One scan of the
    stacked ``(histogram, group, value)`` rows keeps
    min, max and count per histogram and group (a table of at most
    ``#histograms x #groups`` rows, broadcast); the second bins every value
    against its histogram's edges and counts with partial aggregation. The
    result table (``sum(bins) x #groups`` rows) is cached, so the outputs
    share the two scans. Each equals the matching ``histogram`` call.
    """
    specs = {name: HistSpec(*spec) for name, spec in specs.items()}
    names = list(specs)
    by_types = {s.by: df.schema[s.by].dataType for s in specs.values() if s.by}

    def value(s: HistSpec) -> Column:
        x = F.col(s.column).cast("double")
        if s.clip is not None:
            x = clip_upper(x, s.clip)
        return x if s.where is None else F.when(s.where, x)

    stacked = df.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("_h"),
                 # without ``by`` one non-null group, so the join keys match
                 (F.col(s.by).cast("string") if s.by else F.lit("")).alias("_g"),
                 value(s).alias("_x"))
        for i, s in enumerate(specs.values())]))).filter(F.col("_x").isNotNull())

    def per_histogram(values: list) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("_h") + 1)

    bins_of = per_histogram([s.bins for s in specs.values()])
    shared = per_histogram([bool(s.shared_edges) for s in specs.values()])

    # one row per (histogram, group) carrying the histogram's shared edges
    # (a window over the histogram id), so one tiny table feeds both the
    # binning join and the list of bins
    per_group = stacked.groupBy("_h", "_g").agg(F.min("_x").alias("_lo0"),
                                                F.max("_x").alias("_hi0"))
    whole = Window.partitionBy("_h")
    lo, hi = _widen(F.when(shared, F.min("_lo0").over(whole)).otherwise(F.col("_lo0")),
                    F.when(shared, F.max("_hi0").over(whole)).otherwise(F.col("_hi0")))
    edges = F.broadcast(per_group.select("_h", "_g", lo.alias("_lo"), hi.alias("_hi"),
                                         bins_of.alias("_bins")))
    binned = with_bin(_join(stacked, edges, ["_h", "_g"], "inner"), F.col("_bins")).select(
        "_h", "_g", "bin")
    counts = binned.groupBy("_h", "_g", "bin").agg(F.count(F.lit(1)).alias("frequency"))
    all_bins = edges.select(
        "_h", "_g", "_lo", "_hi", "_bins",
        F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col("_bins") - 1).cast("bigint")))
        .alias("bin"))
    table = cached(_join(all_bins, counts, ["_h", "_g", "bin"], "left").select(
        "_h", "_g", "bin",
        _edge(F.col("bin"), F.col("_lo"), F.col("_hi"), F.col("_bins")).alias("bin_lo"),
        _edge(F.col("bin") + 1, F.col("_lo"), F.col("_hi"), F.col("_bins")).alias("bin_hi"),
        F.coalesce(F.col("frequency"), F.lit(0).cast("bigint")).alias("frequency")))
    out = {}
    for i, name in enumerate(names):
        by = specs[name].by
        keys = [F.col("_g").cast(by_types[by]).alias(by)] if by else []
        out[name] = table.filter(F.col("_h") == i).select(
            *keys, "bin", "bin_lo", "bin_hi", "frequency")
    return out
