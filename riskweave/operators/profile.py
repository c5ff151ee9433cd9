"""Profiling of the raw table.

Statistics over many columns are computed in one wide aggregate (one scan,
one tiny shuffle) and turned into one row per column with ``inline`` —
never a loop of per-column jobs. Quantiles are exact and distributed
(``operators/quantile.py``: no task holds a whole column); ``approx=True``
swaps in the one-pass ``percentile_approx`` sketch.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import cut_order, even_round, right_closed_cut, sql_round
from ..functions.histogram import HistSpec, data_range_histograms, histogram
from .quantile import exact_quantiles
from .selection import MAX_GROUPS, Target, select_quantiles
from ..sources.kept import cached

# Column lists and bin edges of the profiling notebook.
PROFILE_COLUMNS = [
    "is_default", "revolving_util", "age", "late_30_59", "debt_ratio", "monthly_income",
    "open_credit_lines", "late_90_plus", "real_estate_loans", "late_60_89", "num_dependents",
]
CORRELATION_COLUMNS = [
    "is_default", "age", "monthly_income", "debt_ratio", "revolving_util",
    "open_credit_lines", "real_estate_loans", "late_30_59", "late_60_89", "late_90_plus",
    "num_dependents",
]
LATE_COLUMNS = ["late_30_59", "late_60_89", "late_90_plus"]
AGE_CUT_EDGES = [18, 25, 35, 45, 55, 65, 100]
AGE_CUT_LABELS = ["18-25", "25-35", "35-45", "45-55", "55-65", "65+"]
INCOME_CUT_EDGES = [0, 2000, 4000, 6000, 10000, 999999]
INCOME_CUT_LABELS = ["<$2k", "$2-4k", "$4-6k", "$6-10k", ">$10k"]
PIVOT_AGE_EDGES = [18, 30, 40, 50, 60, 100]
PIVOT_AGE_LABELS = ["18-30", "30-40", "40-50", "50-60", "60+"]
PIVOT_INCOME_EDGES = [0, 2000, 4000, 6000, 9999999]
PIVOT_INCOME_LABELS = ["<$2k", "$2-4k", "$4-6k", ">$6k"]
PIVOT_INCOME_COLUMNS = ["rate_lt_2k", "rate_2_4k", "rate_4_6k", "rate_gt_6k"]
STAT_DIGITS = 6  # rounding of order-dependent float statistics


def _r(c: Column) -> Column:
    return sql_round(c, STAT_DIGITS)


QUARTILES = (0.25, 0.5, 0.75)


def quantile_table(df: DataFrame, cols: Sequence[str], probs: Sequence[float] = QUARTILES,
                   by: Sequence[str] = (), approx: bool = False,
                   accuracy: int = 100000) -> DataFrame:
    """``(column_name, *by, q)``: the quantiles of each column at ``probs``,
    one row per column and group with a value. Exact (distributed ranks) by
    default; ``approx`` uses the ``percentile_approx`` sketch (one pass)."""
    if not approx:
        return exact_quantiles(df, cols, probs, by=by)
    by = list(by)
    stacked = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), *[F.col(b) for b in by],
                 F.col(c).cast("double").alias("x")) for c in cols])))
    return stacked.groupBy("column_name", *by).agg(
        F.percentile_approx("x", F.array(*[F.lit(float(p)) for p in probs]), accuracy)
        .alias("q"))


def _long(one_row: DataFrame, names: Sequence[str], fields: Sequence[str],
          key: str = "column_name") -> DataFrame:
    """Wide one-row aggregate (``<name>__<field>``) -> one row per name."""
    rows = F.array(*[
        F.struct(F.lit(n).alias(key), *[F.col(f"{n}__{f}").alias(f) for f in fields])
        for n in names])
    return one_row.select(F.inline(rows))


# -- D1 ---------------------------------------------------------------------------

def schema_profile(df: DataFrame) -> DataFrame:
    """Position, name and type of every column plus the row count."""
    spark = df.sparkSession
    meta = spark.createDataFrame(
        [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)],
        "position int, column_name string, data_type string")
    n_rows = df.agg(F.count(F.lit(1))).scalar()
    return meta.withColumn("n_rows", n_rows)


# -- D2 / D9: describe --------------------------------------------------------------

def stack_columns(df: DataFrame, cols: Sequence[str], key: str = "column_name",
                  value: str = "x") -> DataFrame:
    """One row per (input row, column): ``key, value`` (as double). A scan
    feeds all columns at once; the grouped aggregate that follows keeps its
    buffers small enough for whole-stage codegen and merges each column in
    its own task."""
    return df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias(key), F.col(c).cast("double").alias(value)) for c in cols])))


def describe(df: DataFrame, cols: Sequence[str] = PROFILE_COLUMNS, approx: bool = False,
             accuracy: int = 100000) -> DataFrame:
    """Pandas ``describe`` per column: count, mean, sample std, min,
    quartiles (linear interpolation), max, grouped by column: two scans
    (``profile_reports``), one with ``approx``."""
    if not approx:
        return profile_reports(df, ["describe"], cols)["describe"]
    x = F.col("x")
    stats = stack_columns(df, cols).groupBy("column_name").agg(
        F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
        F.min(x).alias("min"), F.max(x).alias("max"))
    agg = stats.join(quantile_table(df, cols, approx=approx, accuracy=accuracy),
                     "column_name", "left")
    return agg.select(
        "column_name", "count", _r(F.col("mean")).alias("mean"), _r(F.col("std")).alias("std"),
        _r(F.col("min")).alias("min"), _r(F.col("q")[0]).alias("p25"),
        _r(F.col("q")[1]).alias("p50"), _r(F.col("q")[2]).alias("p75"),
        _r(F.col("max")).alias("max"))


def income_sanity(df: DataFrame) -> DataFrame:
    """Over non-null income: count above 30000, count equal to 0, describe."""
    return profile_reports(df, ["income_sanity"])["income_sanity"]



# -- D3 / D4 / D19 -----------------------------------------------------------------

def missing_report(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """D3: NULL count and % (pandas rounding, 2 places) per column with any
    NULL, highest share first."""
    cols = list(cols or df.columns)
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"{c}__missing_count") for c in cols])
    n = df.agg(F.count(F.lit(1))).scalar()
    return (_long(wide, cols, ["missing_count"])
            .select("column_name", "missing_count",
                    even_round(F.col("missing_count") / n * 100, 2).alias("missing_pct"))
            .filter(F.col("missing_count") > 0)
            .orderBy(F.desc("missing_pct"), "column_name"))


def target_distribution(df: DataFrame, label: str = "is_default") -> DataFrame:
    """Count and share % per class, with the neg/pos imbalance ratio."""
    counts = class_counts(df.filter(F.col(label).isNotNull()), label)
    total, neg, pos = count_totals(label)
    return counts.select(label, "count", (F.col("count") / total * 100).alias("pct"),
                         F.when(pos > 0, neg / pos).alias("imbalance_ratio"))


def class_counts(df: DataFrame, label: str = "is_default") -> DataFrame:
    """``SELECT label, COUNT(*) GROUP BY label``."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))


def count_totals(label: str) -> tuple[Column, Column, Column]:
    """Over a table of ``class_counts`` (one row per class): all rows, and
    those of the classes 0 and 1."""
    every = Window.partitionBy(F.lit(1))
    return tuple(F.sum(F.when(c, F.col("count")).otherwise(0)).over(every)
                 for c in (F.lit(True), F.col(label) == 0, F.col(label) == 1))


# -- D5 / D6 -----------------------------------------------------------------------

def iqr_outliers(df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False,
                 accuracy: int = 100000) -> DataFrame:
    """Tukey fences per column. Pass 1 gets min, max, Q1, Q3 per column
    (grouped by column over the stacked rows); pass 2 joins those bounds —
    one row per profiled column, a fixed-size table, so broadcast — and
    counts values outside the fences."""
    cols = list(cols or [c for c in PROFILE_COLUMNS if c != "is_default"])
    if not approx:
        return profile_reports(df, ["iqr_outliers"], cols)["iqr_outliers"]
    x = F.col("x")
    stacked = stack_columns(df, cols)
    bounds = stacked.groupBy("column_name").agg(F.min(x).alias("min"), F.max(x).alias("max")) \
        .join(quantile_table(df, cols, (0.25, 0.75), approx=approx, accuracy=accuracy)
              .withColumnRenamed("q", "_q"), "column_name", "left").select(
        "column_name", "min", "max", F.col("_q")[0].alias("_q1"), F.col("_q")[1].alias("_q3"))
    bounds = bounds.withColumns({
        "_lo": F.col("_q1") - 1.5 * (F.col("_q3") - F.col("_q1")),
        "_hi": F.col("_q3") + 1.5 * (F.col("_q3") - F.col("_q1"))})
    counts = stacked.join(F.broadcast(bounds.select("column_name", "_lo", "_hi")),
                          "column_name").groupBy("column_name").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if((x < F.col("_lo")) | (x > F.col("_hi"))).alias("n_outliers"))
    return bounds.join(counts, "column_name").select(
        "column_name", "min", "max", _r(F.col("_q1")).alias("q1"), _r(F.col("_q3")).alias("q3"),
        _r(F.col("_q3") + 1.5 * (F.col("_q3") - F.col("_q1"))).alias("iqr_upper"),
        "n_outliers", even_round(F.col("n_outliers") / F.col("_n") * 100, 2).alias("outlier_pct"))


def age_sanity(df: DataFrame) -> DataFrame:
    """Age min, max and count of age 0."""
    return df.agg(F.min("age").alias("age_min"), F.max("age").alias("age_max"),
                  F.count_if(F.col("age") == 0).alias("n_age_zero"))


# -- D7 / D10 / D12 histograms ----------------------------------------------------------

def age_histogram(df: DataFrame, bins: int = 40) -> DataFrame:
    """Valid ages (> 0), data-range edges."""
    return histogram(df, "age", bins, where=F.col("age") > 0)


def income_histogram_clipped(df: DataFrame, bins: int = 60, clip: float = 20000) -> DataFrame:
    """Non-null income clipped at 20000."""
    return histogram(df, "monthly_income", bins, clip=clip)


def debt_histogram_clipped(df: DataFrame, bins: int = 60, clip: float = 2) -> DataFrame:
    """Debt ratio clipped at 2."""
    return histogram(df, "debt_ratio", bins, clip=clip)


def util_histogram_clipped(df: DataFrame, bins: int = 60, clip: float = 1) -> DataFrame:
    """Revolving utilisation clipped at 1."""
    return histogram(df, "revolving_util", bins, clip=clip)


def util_histogram_by_class(df: DataFrame, bins: int = 40, clip: float = 1) -> DataFrame:
    """Utilisation clipped at 1 per default class, each class with its
    own edges (one chart per group)."""
    return histogram(df, "revolving_util", bins, clip=clip, by=["is_default"],
                     shared_edges=False)


def profile_histograms(df: DataFrame) -> dict[str, DataFrame]:
    """D7, D10 and D12 (five histograms) from two scans of ``df`` instead
    of three each; equal to the per-chart functions above."""
    return data_range_histograms(df, {
        "age_histogram": HistSpec("age", 40, where=F.col("age") > 0),
        "income_histogram_clipped": HistSpec("monthly_income", 60, clip=20000),
        "debt_histogram_clipped": HistSpec("debt_ratio", 60, clip=2),
        "util_histogram_clipped": HistSpec("revolving_util", 60, clip=1),
        "util_histogram_by_class": HistSpec("revolving_util", 40, by="is_default", clip=1,
                                            shared_edges=False),
    })


# -- D8 / D11 / D17 / D18 default rates -----------------------------------------------

def rate_by_cut(df: DataFrame, column: str, edges: Sequence[float], labels: Sequence[str],
                out: str, fill: Column | None = None) -> DataFrame:
    """Default rate % per right-closed bin of ``column`` (``pd.cut``); values
    outside every bin are left out, as ``groupby`` drops NaN keys."""
    x = F.col(column)
    if fill is not None:
        x = F.coalesce(x, fill)
    return (df.select(right_closed_cut(x, edges, labels).alias(out),
                      cut_order(x, edges).alias(f"{out}_order"), "is_default")
            .filter(F.col(out).isNotNull())
            .groupBy(out, f"{out}_order")
            .agg((F.avg("is_default") * 100).alias("default_rate_pct"))
            .orderBy(f"{out}_order"))


def rate_by_age_group(df: DataFrame) -> DataFrame:
    """Rows with age in [18, 100], bins (18,25] ... (65,100]; 18 falls out."""
    src = df.filter(F.col("age").between(18, 100))
    return rate_by_cut(src, "age", AGE_CUT_EDGES, AGE_CUT_LABELS, "age_group")


def rate_by_income_band(df: DataFrame) -> DataFrame:
    """Income NULL -> median income, bins (0,2000] ... (10000,999999]."""
    return profile_reports(df, ["rate_by_income_band"])["rate_by_income_band"].orderBy("income_band_order")


def rate_by_value(df: DataFrame, column: str = "late_90_plus", k: int = 10) -> DataFrame:
    """Default rate % per value of ``column``, the ``k`` smallest values
    (a top-k report: the per-value aggregate is tiny, then TakeOrdered)."""
    return (df.filter(F.col(column).isNotNull()).groupBy(column)
            .agg((F.avg("is_default") * 100).alias("default_rate_pct"))
            .orderBy(column).limit(k))


def cut_pivot(df: DataFrame) -> DataFrame:
    """Default rate % by age group x income band (median-filled income
    of the age-filtered rows), one row per age group."""
    return profile_reports(df, ["cut_pivot"])["cut_pivot"]


# -- D13 / D14 correlations ------------------------------------------------------------

def pair_moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per task and pair of columns (positions i <= j) the count, means and
    centred products over the rows where both are present. A task multiplies
    its value and presence matrices batch by batch, shifted by its first
    batch's medians so that no digits cancel."""
    n_cols = len(cols)
    upper = np.triu_indices(n_cols)

    def rows(batches):
        total, shift = 0.0, None
        for batch in batches:
            values = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[:n_cols]])
            there = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns[:n_cols]]).astype(float)
            values[there == 0] = 0.0
            if not len(values):
                continue
            if shift is None:
                # medians: exact for a constant column, so its products are 0
                shift = np.array([np.median(v[t > 0]) if t.any() else 0.0 for v, t in zip(values.T, there.T)])
            x = (values - shift) * there
            total = total + np.stack([there.T @ there, x.T @ there, there.T @ x,
                                      (x * x).T @ there, there.T @ (x * x), x.T @ x])
        if shift is None:
            return
        n, sx, sy, sxx, syy, sxy = total[(slice(None), *upper)]
        of = np.maximum(n, 1)
        mx, my = sx / of, sy / of
        i, j = upper
        yield pa.RecordBatch.from_arrays(
            [pa.array(i), pa.array(j), pa.array(n), pa.array(mx + shift[i]), pa.array(my + shift[j]),
             pa.array(sxx - sx * mx), pa.array(syy - sy * my), pa.array(sxy - sx * my)],
            names=["i", "j", "n", "mx", "my", "cxx", "cyy", "cxy"])

    return df.select(*[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(cols)]).mapInArrow(
        rows, "i long, j long, n double, mx double, my double, cxx double, cyy double, cxy double")


def correlation(df: DataFrame, cols: Sequence[str] = CORRELATION_COLUMNS) -> DataFrame:
    """Pearson matrix, pairwise-complete (rows with a NULL in either
    column are skipped), as long rows ``(col_a, col_b, corr)``; NULL, also on
    the diagonal, where a column is constant or has no value.

    One scan: every task reduces its rows to one row of moments per pair
    (``pair_moments``), and only these are shuffled and merged.
    """
    cols = list(cols)
    pair = Window.partitionBy("i", "j")
    merged = pair_moments(df, cols).filter("n > 0").select("*", *[
        (F.col(m) - F.min(m).over(pair)).alias(f"d{m}")
        for m in ("mx", "my")])
    total = F.greatest(F.sum("n"), F.lit(1.0))

    def product(a: str, b: str) -> Column:
        da, db, n = F.col(f"dm{a}"), F.col(f"dm{b}"), F.col("n")
        return F.sum(F.col(f"c{a}{b}") + n * da * db) - F.sum(n * da) * F.sum(n * db) / total

    moments = merged.groupBy("i", "j").agg(product("x", "x").alias("_xx"), product("y", "y").alias("_yy"),
                                           product("x", "y").alias("_xy"))
    # the branch guards the division: ANSI mode raises on x / 0
    c = _r(F.when((F.col("_xx") > 0) & (F.col("_yy") > 0),
                  F.col("_xy") / F.sqrt("_xx") / F.sqrt("_yy")))
    name = F.array(*[F.lit(x) for x in cols])
    found = moments.select("i", "j", c.alias("corr"))
    every = F.sequence(F.lit(0), F.lit(len(cols) - 1))
    grid = df.sparkSession.range(1).select(F.explode(every).alias("_i")).select("_i", F.explode(every).alias("_j"))
    # the grid keeps the cells of an empty table
    return grid.join(found, (F.least("_i", "_j") == F.col("i")) & (F.greatest("_i", "_j") == F.col("j")), "left").select(
        F.element_at(name, F.col("_i") + 1).alias("col_a"), F.element_at(name, F.col("_j") + 1).alias("col_b"), "corr")


def target_correlation(df: DataFrame, label: str = "is_default",
                       cols: Sequence[str] = CORRELATION_COLUMNS) -> DataFrame:
    """Correlation of each column with the label, highest first."""
    return (correlation(df, cols).filter((F.col("col_a") == label) & (F.col("col_b") != label))
            .select(F.col("col_b").alias("column_name"), "corr")
            .orderBy(F.desc("corr"), "column_name"))


# -- D15 / D16 -------------------------------------------------------------------------

def box_stats(df: DataFrame, column: str = "debt_ratio", by: str = "is_default",
              approx: bool = False, accuracy: int = 100000) -> DataFrame:
    """Box-plot numbers per group: quartiles, whiskers at the furthest
    point within 1.5 IQR of the box, outlier count. ``by`` is a class label:
    the tables of bounds and fences have one row per class and are broadcast
    (a shuffle join on a two-valued key would put all rows in two tasks) once
    their rows are counted; beyond ``MAX_GROUPS`` they are joined."""
    if not approx:
        return profile_reports(df, ["box_stats"], box=(column, by))["box_stats"]
    x = F.col(column).cast("double")
    src = df.select(by, x.alias("_x")).filter(F.col("_x").isNotNull())
    q = quantile_table(src, ["_x"], by=[by], approx=approx, accuracy=accuracy) \
        .withColumnRenamed("q", "_q")
    q = q.select(by, F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"),
                 F.col("_q")[2].alias("q3"))
    fences = q.select("*", (F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).alias("_lo"),
                      (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("_hi"))
    joined = src.join(fences, by, "inner")
    agg = joined.groupBy(by, "q1", "median", "q3", "_lo", "_hi").agg(
        F.min(F.when(F.col("_x") >= F.col("_lo"), F.col("_x"))).alias("_wlo"),
        F.max(F.when(F.col("_x") <= F.col("_hi"), F.col("_x"))).alias("_whi"),
        F.count_if((F.col("_x") < F.col("_lo")) | (F.col("_x") > F.col("_hi"))).alias("n_outliers"))
    return agg.select(
        by, _r(F.col("q1")).alias("q1"), _r(F.col("median")).alias("median"),
        _r(F.col("q3")).alias("q3"),
        _r(F.least(F.coalesce(F.col("_wlo"), F.col("q1")), F.col("q1"))).alias("whisker_low"),
        _r(F.greatest(F.coalesce(F.col("_whi"), F.col("q3")), F.col("q3"))).alias("whisker_high"),
        "n_outliers")


def value_counts(df: DataFrame, cols: Sequence[str] = LATE_COLUMNS, k: int = 10) -> DataFrame:
    """Frequency of each value, the ``k`` smallest values per column.

    One scan: the columns are stacked into ``(column_name, value)``, counted
    with map-side partial aggregation, and only the small count table is
    ranked per column."""
    stacked = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("bigint").alias("value"))
        for c in cols])))
    counts = stacked.filter(F.col("value").isNotNull()) \
        .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy("column_name").orderBy("value")
    return counts.withColumn("_rank", F.row_number().over(w)) \
        .filter(F.col("_rank") <= k).drop("_rank").orderBy("column_name", "value")


#: The reports that one selection serves.
REPORTS = ("describe", "missing_report", "age_sanity", "iqr_outliers", "income_sanity", "rate_by_income_band",
           "box_stats", "cut_pivot")
IQR = 1.5


def profile_reports(df: DataFrame, want: Sequence[str] = REPORTS, cols: Sequence[str] = PROFILE_COLUMNS,
                    box: tuple[str, str] = ("debt_ratio", "is_default")) -> dict[str, DataFrame]:
    """D2, D3, D5, D6, D9, D11, D15 and D18, all or some, from **three**
    scans of ``df`` together:

    1. one aggregate over the stacked values of every column: counts, moments,
       extremes and bounds of the quartiles (``select_quantiles``);
    2. the values between the bounds, which give the exact quartiles;
    3. what needs them (``_against_quartiles``): rows beyond the fences,
       whiskers, and default rates by bands of the median-filled income.

    Reports without such counts take two scans. The statistics table has a
    row per column and class and is kept, so the reports share the scans."""
    want, cols = list(want), list(cols)
    column, by = box
    needs = set(want)
    plain = list(cols) if needs & {"describe", "iqr_outliers"} else []
    if "missing_report" in needs:
        plain += [c for c in df.columns if c not in plain]
    if needs & {"income_sanity", "rate_by_income_band"} and "monthly_income" not in plain:
        plain.append("monthly_income")
    if "age_sanity" in needs and "age" not in plain:
        plain.append("age")
    targets = [Target(c, F.col(c)) for c in plain]
    if "box_stats" in needs:
        targets.append(Target("__box", F.col(column), F.col(by)))
    if "cut_pivot" in needs:
        targets.append(Target("__adult_income", F.when(F.col("age").between(18, 100), F.col("monthly_income"))))
    x = F.col("x")
    stats = select_quantiles(df, targets, QUARTILES, [
        F.count(F.lit(1)).alias("_rows"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"),
        F.max(x).alias("max"), F.count_if(x == 0).alias("n_zero"), F.count_if(x > 30000).alias("n_over_30000")])
    name = F.element_at(F.array(*[F.lit(t.name) for t in targets]), F.col("_t") + 1)
    stats = stats.withColumn("column_name", name)
    counted = set(want) & {"iqr_outliers", "rate_by_income_band", "box_stats", "cut_pivot"}
    if len(want) > 1 or counted:
        stats = cached(stats)
    q = [F.col("q")[k] for k in range(3)]
    described = [_r(F.col("mean")).alias("mean"), _r(F.col("std")).alias("std"), _r(F.col("min")).alias("min"),
                 *[_r(c).alias(n) for c, n in zip(q, ("p25", "p50", "p75"))], _r(F.col("max")).alias("max")]
    of = {t.name: stats.filter(F.col("_t") == i) for i, t in enumerate(targets)}
    out = {}
    if "describe" in needs:
        out["describe"] = stats.filter(F.col("column_name").isin(cols)).select("column_name", F.col("n").alias("count"), *described)
    if "missing_report" in needs:
        gaps = stats.filter(F.col("column_name").isin(list(df.columns)))
        out["missing_report"] = gaps.select(
            "column_name", (F.col("_rows") - F.col("n")).alias("missing_count"),
            even_round((F.col("_rows") - F.col("n")) / F.col("_rows") * 100, 2).alias("missing_pct")) \
            .filter(F.col("missing_count") > 0).orderBy(F.desc("missing_pct"), "column_name")
    if "age_sanity" in needs:
        # an empty table has no row of statistics, but one report row
        out["age_sanity"] = of["age"].agg(F.max("min").cast("bigint").alias("age_min"), F.max("max").cast("bigint").alias("age_max"),
                                          F.coalesce(F.max("n_zero"), F.lit(0)).alias("n_age_zero"))
    if "income_sanity" in needs:
        one = of["monthly_income"].agg(*[
            F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("n_over_30000", "n_zero", "n")], F.max("mean").alias("mean"),
            F.max("std").alias("std"), F.max("min").alias("min"), F.max("max").alias("max"), F.max("q").alias("q"))
        out["income_sanity"] = one.select("n_over_30000", "n_zero", F.col("n").alias("count"),
                                          _r(F.col("mean")).alias("mean"), _r(F.col("std")).alias("std"), "min",
                                          *[_r(c).alias(n) for c, n in zip(q, ("p25", "p50", "p75"))], "max")
    if counted:
        out |= _against_quartiles(df, counted, stats, of, [c for c in cols if c != "is_default"], column, by)
    return {w: out[w] for w in want}


def _against_quartiles(df: DataFrame, want: set[str], stats: DataFrame, of: dict[str, DataFrame],
                       fenced: Sequence[str], column: str, by: str) -> dict[str, DataFrame]:
    """The reports that compare rows with quartiles, from one more scan. Each
    row gives one fact per report: ``(report, key)`` and what is summed; keys are
    classes or bands, so the counts are few.
    Quartiles of the fixed columns are scalars of ``stats``; those of classes
    are a joined table, broadcast if its rows are counted and few."""
    label = F.col("is_default")
    null = F.lit(None)

    fenced = list(fenced) if "iqr_outliers" in want else []

    def fact(report: str, key: Column, value=null, out=null, low=null, high=null, beyond=()) -> Column:
        beyond = [*beyond, *[null] * (len(fenced) - len(beyond))]
        return F.struct(F.lit(report).alias("report"), key.cast("string").alias("key"), value.cast("double").alias("value"),
                        out.cast("boolean").alias("out"), low.cast("double").alias("low"), high.cast("double").alias("high"),
                        *[b.cast("boolean").alias(f"beyond{i}") for i, b in enumerate(beyond)])

    def fences(q: Column) -> tuple[Column, Column]:
        return q[0] - IQR * (q[2] - q[0]), q[2] + IQR * (q[2] - q[0])

    src, facts = df, []
    if "iqr_outliers" in want:
        # one fact a row for all columns, whose fences are one row of named values
        q = F.col("q")
        ends = [F.max(F.when(F.col("column_name") == c, end)).alias(f"{side}{i}") for i, c in enumerate(fenced)
                for side, end in zip(("lo", "hi"), fences(q))]
        src = src.withColumn("_fences", stats.filter(F.col("column_name").isin(fenced)).agg(*ends).select(F.struct("*")).scalar())
        beyond = []
        for i, c in enumerate(fenced):
            v, lo, hi = F.col(c).cast("double"), F.col(f"_fences.lo{i}"), F.col(f"_fences.hi{i}")
            beyond.append((v < lo) | (v > hi))
        facts.append(fact("iqr_outliers", F.lit("all"), beyond=beyond))
    if "rate_by_income_band" in want:
        src = src.withColumn("_median", of["monthly_income"].agg(F.max(F.col("q")[1])).scalar())
        facts.append(fact("rate_by_income_band", cut_order(F.coalesce("monthly_income", "_median"), INCOME_CUT_EDGES), label))
    if "cut_pivot" in want:
        src = src.withColumn("_adult_median", of["__adult_income"].agg(F.max(F.col("q")[1])).scalar())
        adult = F.col("age").between(18, 100)
        cell = F.concat_ws("/", right_closed_cut("age", PIVOT_AGE_EDGES, PIVOT_AGE_LABELS),
                           F.coalesce(right_closed_cut(F.coalesce("monthly_income", "_adult_median"), PIVOT_INCOME_EDGES, PIVOT_INCOME_LABELS), F.lit("")))
        known = adult & right_closed_cut("age", PIVOT_AGE_EDGES, PIVOT_AGE_LABELS).isNotNull()
        facts.append(fact("cut_pivot", F.when(known, cell), label))
    if "box_stats" in want:
        groups = of["__box"].select(F.col("_g").alias("_class"), F.col("q").alias("_box"))
        few = of["__box"].count() <= MAX_GROUPS
        src = src.join(F.broadcast(groups) if few else groups, F.col(by).cast("string").eqNullSafe(F.col("_class")), "left")
        lo, hi = fences(F.col("_box"))
        v = F.col(column).cast("double")
        facts.append(fact("box_stats", F.col(by), out=(v < lo) | (v > hi), low=F.when(v >= lo, v), high=F.when(v <= hi, v)))
    table = src.select(F.inline(F.array(*facts))).groupBy("report", "key").agg(
        F.count("value").alias("values"), F.sum("value").alias("total"), F.count_if("out").alias("n_outliers"),
        F.min("low").alias("low"), F.max("high").alias("high"), *[F.count_if(f"beyond{i}").alias(f"beyond{i}") for i in range(len(fenced))])
    if len(want) > 1:
        table = cached(table)
    rate = (F.col("total") / F.col("values") * 100).alias("default_rate_pct")
    out = {}
    if "iqr_outliers" in want:
        q1, q3 = F.col("q")[0], F.col("q")[2]
        outliers = table.filter("report = 'iqr_outliers'").select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("column_name"), F.col(f"beyond{i}").alias("n_outliers")) for i, c in enumerate(fenced)])))
        out["iqr_outliers"] = stats.filter(F.col("column_name").isin(fenced)).join(outliers, "column_name").select(
            "column_name", "min", "max", _r(q1).alias("q1"), _r(q3).alias("q3"), _r(q3 + IQR * (q3 - q1)).alias("iqr_upper"),
            "n_outliers", even_round(F.col("n_outliers") / F.col("_rows") * 100, 2).alias("outlier_pct"))
    if "rate_by_income_band" in want:
        order = F.col("key").cast("int")
        out["rate_by_income_band"] = table.filter("report = 'rate_by_income_band' and key is not null").select(
            F.element_at(F.array(*[F.lit(b) for b in INCOME_CUT_LABELS]), order + 1).alias("income_band"),
            order.alias("income_band_order"), rate).orderBy("income_band_order")
    if "cut_pivot" in want:
        cells = table.filter("report = 'cut_pivot' and key is not null").select(
            F.split("key", "/", 2)[0].alias("age_group"), F.split("key", "/", 2)[1].alias("income_band"), rate)
        wide = cells.groupBy("age_group").pivot("income_band", PIVOT_INCOME_LABELS).agg(F.max("default_rate_pct"))
        out["cut_pivot"] = wide.select("age_group", *[F.col(f"`{band}`").alias(n) for band, n in zip(PIVOT_INCOME_LABELS, PIVOT_INCOME_COLUMNS)])
    if "box_stats" in want:
        q1, q3 = F.col("q")[0], F.col("q")[2]
        found = of["__box"].filter("n > 0").join(table.filter("report = 'box_stats'").select("key", "n_outliers", "low", "high"),
                                                 F.col("_g") == F.col("key"))
        out["box_stats"] = found.select(
            F.col("_g").cast(df.schema[by].dataType).alias(by), _r(q1).alias("q1"), _r(F.col("q")[1]).alias("median"), _r(q3).alias("q3"),
            _r(F.least(F.coalesce("low", q1), q1)).alias("whisker_low"), _r(F.greatest(F.coalesce("high", q3), q3)).alias("whisker_high"), "n_outliers")
    return out


def profile_tables(df: DataFrame, cols: Sequence[str] = PROFILE_COLUMNS) -> dict[str, DataFrame]:
    """D2, D3, D5 and D6 from the three scans of ``profile_reports``."""
    return profile_reports(df, ["describe", "missing_report", "iqr_outliers", "age_sanity"], cols)
