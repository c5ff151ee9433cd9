"""Portfolio roll-ups over ``risk_segments``.

Every operator is one ``groupBy`` (partial + final hash aggregate) over a
handful of low-cardinality keys, so the shuffle carries at most
``#tasks x #groups`` rows whatever the data size, and a hot segment is
combined map-side before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import INCOME_BAND_LABELS, RISK_SEGMENTS, even_round, sql_round
from ..functions.histogram import data_range_histograms, histogram
from ..sources.kept import cached

DIMENSIONS = ("age_band", "income_band", "risk_segment")
# pivot column names for the income bands (labels hold '$', '<', '>')
INCOME_BAND_COLUMNS = ["rate_lt_2k", "rate_2_4k", "rate_4_6k", "rate_6_10k", "rate_gt_10k"]


def _summary_aggs() -> list[Column]:
    d = F.col("is_default")
    return [
        F.count(F.lit(1)).alias("total_customers"),
        F.sum(d).cast("bigint").alias("total_defaults"),
        sql_round(F.avg(d) * 100, 2).alias("default_rate_pct"),
        sql_round(F.avg("monthly_income"), 0).alias("avg_income"),
        sql_round(F.avg("debt_ratio"), 3).alias("avg_debt_ratio"),
        sql_round(F.avg("revolving_util"), 3).alias("avg_util"),
    ]


def summarize(df: DataFrame, dim: str) -> DataFrame:
    """The six portfolio measures per value of one dimension."""
    src = df if dim == "risk_segment" else df.filter(F.col(dim).isNotNull())
    return src.groupBy(F.col(dim).alias("segment")).agg(*_summary_aggs()) \
        .select(F.lit(dim).alias("dimension"), "*")


def portfolio_summary(df: DataFrame, ordered: bool = True) -> DataFrame:
    """The three roll-ups of P1-P3 in **one** scan.

    ``GROUPING SETS`` becomes one Expand + one partial/final aggregate — one
    shuffle of at most ``#tasks x 14`` rows — where a UNION ALL of three
    group-bys would scan and shuffle three times. ``grouping()`` names the
    dimension of each output row.
    """
    sets = [[F.col(d)] for d in DIMENSIONS]
    agg = df.groupingSets(sets, *DIMENSIONS).agg(
        *_summary_aggs(),
        F.grouping("age_band").alias("_g_age"),
        F.grouping("income_band").alias("_g_inc"),
    )
    dimension = (F.when(F.col("_g_age") == 0, "age_band")
                 .when(F.col("_g_inc") == 0, "income_band").otherwise("risk_segment"))
    segment = (F.when(F.col("_g_age") == 0, F.col("age_band"))
               .when(F.col("_g_inc") == 0, F.col("income_band"))
               .otherwise(F.col("risk_segment")))
    out = agg.select(dimension.alias("dimension"), segment.alias("segment"),
                     "total_customers", "total_defaults", "default_rate_pct",
                     "avg_income", "avg_debt_ratio", "avg_util")
    # the band roll-ups skip NULL bands (WHERE band IS NOT NULL)
    out = out.filter(F.col("segment").isNotNull() | (F.col("dimension") == "risk_segment"))
    if ordered:
        out = out.orderBy("dimension", F.desc("default_rate_pct"), "segment")
    return out


def portfolio_slice(summary: DataFrame, dim: str) -> DataFrame:
    """One dimension of the summary, highest default rate first."""
    return summary.filter(F.col("dimension") == dim).orderBy(
        F.desc("default_rate_pct"), "segment")


def portfolio_kpis(df: DataFrame) -> DataFrame:
    """The KPI row in one global aggregate."""
    return df.agg(
        F.count(F.lit(1)).alias("total_customers"),
        F.sum("is_default").cast("bigint").alias("total_defaults"),
        (F.avg("is_default") * 100).alias("default_rate_pct"),
        F.avg("monthly_income").alias("avg_monthly_income"),
        F.avg("debt_ratio").alias("avg_debt_ratio"),
    )


def heatmap_long(df: DataFrame) -> DataFrame:
    """Default rate % per (age band, income band), pandas rounding."""
    return (df.filter(F.col("age_band").isNotNull() & F.col("income_band").isNotNull())
            .groupBy("age_band", "income_band")
            .agg(even_round(F.avg("is_default") * 100, 2).alias("default_rate_pct")))


def heatmap(df: DataFrame) -> DataFrame:
    """P7 pivoted — one row per age band, one column per income band.

    The explicit value list keeps the pivot to one aggregation (no extra job
    to discover the distinct income bands).
    """
    src = df.filter(F.col("age_band").isNotNull() & F.col("income_band").isNotNull())
    wide = src.groupBy("age_band").pivot("income_band", INCOME_BAND_LABELS) \
        .agg(F.avg("is_default"))
    return wide.select(
        "age_band",
        *[even_round(F.col(f"`{label}`") * 100, 2).alias(name)
          for label, name in zip(INCOME_BAND_LABELS, INCOME_BAND_COLUMNS)])


def income_histogram(df: DataFrame, bins: int = 60) -> DataFrame:
    """Monthly income, equal-width bins over the data range (the chart's
    0-20000 axis range only zooms; no row is filtered)."""
    return histogram(df, "monthly_income", bins)


def debt_histogram(df: DataFrame, bins: int = 60) -> DataFrame:
    """P10: debt ratio, equal-width bins over the data range."""
    return histogram(df, "debt_ratio", bins)


def segment_counts(df: DataFrame) -> DataFrame:
    """Customers per rule segment and share of the portfolio (0 when a
    segment is absent) — one global aggregate, then ``stack``."""
    seg = F.col("risk_segment")
    one = df.agg(F.count(F.lit(1)).alias("_total"),
                 *[F.count_if(seg == s).alias(f"_n{i}") for i, s in enumerate(RISK_SEGMENTS)])
    stacked = one.select(
        "_total",
        F.inline(F.array(*[F.struct(F.lit(s).alias("risk_segment"),
                                    F.col(f"_n{i}").alias("customers"))
                           for i, s in enumerate(RISK_SEGMENTS)])))
    return stacked.select(
        "risk_segment", "customers",
        F.when(F.col("_total") == 0, F.lit(0.0))
        .otherwise(F.col("customers") / F.col("_total") * 100).alias("share_pct"))


def segment_default_rate(df: DataFrame) -> DataFrame:
    """Default rate % per rule segment (pandas rounding, 2 places)."""
    return df.groupBy("risk_segment").agg(
        even_round(F.avg("is_default") * 100, 2).alias("default_rate_pct"))


def score_histogram(df: DataFrame, bins: int = 50) -> DataFrame:
    """Rule score by default class, one shared set of edges."""
    return histogram(df, "rule_risk_score", bins, by=["is_default"], shared_edges=True)


def dashboard_histograms(df: DataFrame) -> dict[str, DataFrame]:
    """P9, P10 and P13 from two scans of ``df`` (edges, then counts) instead
    of three each; equal to the per-chart functions above."""
    return data_range_histograms(df, {
        "income_histogram": ("monthly_income", 60, None),
        "debt_histogram": ("debt_ratio", 60, None),
        "score_histogram": ("rule_risk_score", 50, "is_default"),
    })


def segment_indicators(df: DataFrame) -> DataFrame:
    """Mean utilisation, debt ratio, 90+ lates and income per segment."""
    return df.groupBy("risk_segment").agg(
        even_round(F.avg("revolving_util"), 3).alias("avg_util"),
        even_round(F.avg("debt_ratio"), 3).alias("avg_debt_ratio"),
        even_round(F.avg("late_90_plus"), 3).alias("avg_late_90"),
        even_round(F.avg("monthly_income"), 3).alias("avg_income"),
    )


def dashboard_tables(df: DataFrame) -> dict[str, DataFrame]:
    """P6, P7, P8, P11, P12 and P14 from **one** scan of ``df``.

    One ``GROUPING SETS ((), (risk_segment), (age_band, income_band))``
    aggregate keeps sums and non-null counts (so every mean is the same
    ``sum / count`` that ``avg`` computes); the result has at most
    ``1 + 3 + 30`` rows and is cached, and each chart table is derived from
    it. The per-operator functions above give the same values, one scan each.
    """
    cols = {"is_default": "d", "monthly_income": "inc", "debt_ratio": "debt",
            "revolving_util": "util", "late_90_plus": "l90"}
    sets = [[], [F.col("risk_segment")], [F.col("age_band"), F.col("income_band")]]
    small = cached(df.groupingSets(sets, "risk_segment", "age_band", "income_band").agg(
        F.count(F.lit(1)).alias("n"), F.sum("is_default").cast("bigint").alias("defaults"),
        *[e for c, k in cols.items() for e in (
            F.sum(F.col(c).cast("double")).alias(f"s_{k}"), F.count(c).alias(f"n_{k}"))],
        F.grouping_id().alias("gid")))

    def mean(k: str) -> Column:
        return F.col(f"s_{k}") / F.col(f"n_{k}")

    everything = small.filter(F.col("gid") == 7)
    by_seg = small.filter(F.col("gid") == 3)
    by_cell = small.filter((F.col("gid") == 4) & F.col("age_band").isNotNull()
                           & F.col("income_band").isNotNull())
    kpis = everything.select(
        F.col("n").alias("total_customers"), F.col("defaults").alias("total_defaults"),
        (mean("d") * 100).alias("default_rate_pct"), mean("inc").alias("avg_monthly_income"),
        mean("debt").alias("avg_debt_ratio"))
    cells = by_cell.select("age_band", "income_band",
                           even_round(mean("d") * 100, 2).alias("default_rate_pct"))
    wide = by_cell.groupBy("age_band").pivot("income_band", INCOME_BAND_LABELS) \
        .agg(F.first(mean("d")))
    heat = wide.select("age_band", *[even_round(F.col(f"`{label}`") * 100, 2).alias(name)
                                     for label, name in zip(INCOME_BAND_LABELS,
                                                            INCOME_BAND_COLUMNS)])
    one = small.agg(
        F.max(F.when(F.col("gid") == 7, F.col("n"))).alias("_total"),
        *[F.coalesce(F.max(F.when((F.col("gid") == 3) & (F.col("risk_segment") == s),
                                  F.col("n"))), F.lit(0).cast("bigint")).alias(f"_n{i}")
          for i, s in enumerate(RISK_SEGMENTS)])
    counts = one.select("_total", F.inline(F.array(*[
        F.struct(F.lit(s).alias("risk_segment"), F.col(f"_n{i}").alias("customers"))
        for i, s in enumerate(RISK_SEGMENTS)]))).select(
        "risk_segment", "customers",
        F.when(F.col("_total") == 0, F.lit(0.0))
        .otherwise(F.col("customers") / F.col("_total") * 100).alias("share_pct"))
    rate = by_seg.select("risk_segment", even_round(mean("d") * 100, 2).alias("default_rate_pct"))
    indicators = by_seg.select(
        "risk_segment", even_round(mean("util"), 3).alias("avg_util"),
        even_round(mean("debt"), 3).alias("avg_debt_ratio"),
        even_round(mean("l90"), 3).alias("avg_late_90"),
        even_round(mean("inc"), 3).alias("avg_income"))
    return {"portfolio_kpis": kpis, "heatmap_long": cells, "heatmap": heat,
            "segment_counts": counts, "segment_default_rate": rate,
            "segment_indicators": indicators}
