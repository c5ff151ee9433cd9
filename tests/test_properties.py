"""Properties over the derived tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.functions.histogram import histogram
from riskweave.operators import model as M
from riskweave.operators import portfolio as P
from riskweave.operators.prefix import global_row_number
from riskweave.plans import registry as R


@pytest.fixture(scope="module")
def risk(spark, sf):
    return R.risk(spark, sf).cache()


def test_band_and_segment_counts_sum_to_total(risk):
    total = risk.count()
    summary = P.portfolio_summary(risk).collect()
    for dim in P.DIMENSIONS:
        assert sum(r.total_customers for r in summary if r.dimension == dim) == total
    assert sum(r.customers for r in P.segment_counts(risk).collect()) == total
    assert sum(r.share_pct for r in P.segment_counts(risk).collect()) == pytest.approx(100.0)


def test_grouping_sets_equal_union_of_group_bys(risk):
    union = None
    for dim in P.DIMENSIONS:
        part = P.summarize(risk, dim)
        union = part if union is None else union.unionByName(part)
    a = sorted(tuple(r) for r in P.portfolio_summary(risk, ordered=False).collect())
    b = sorted(tuple(r) for r in union.select(*P.portfolio_summary(risk).columns).collect())
    assert a == b


@pytest.mark.parametrize("bins", [1, 7, 60])
def test_histogram_equals_numpy(spark, bins):
    rng = np.random.default_rng(7)
    xs = np.concatenate([rng.normal(0, 3, 500), [0.0, 0.5, 1.0, -2.25, 7.5]])
    df = spark.createDataFrame([(float(x),) for x in xs] + [(None,)], "x double")
    got = sorted((r.bin, r.frequency) for r in histogram(df, "x", bins).collect())
    counts, _ = np.histogram(xs, bins=bins)
    assert [c for _, c in got] == counts.tolist()
    fixed = sorted((r.bin, r.frequency) for r in histogram(df, "x", bins, lo=-1, hi=2).collect())
    counts, _ = np.histogram(xs, bins=bins, range=(-1, 2))
    assert [c for _, c in fixed] == counts.tolist()


def test_histogram_counts_every_non_null_row(risk):
    n = risk.filter(F.col("monthly_income").isNotNull()).count()
    assert sum(r.frequency for r in P.income_histogram(risk).collect()) == n


def test_global_row_number_is_dense_and_ordered(spark, risk):
    ids = risk.select("customer_id")
    ranked = global_row_number(ids, "customer_id", n_buckets=5).collect()
    pairs = sorted((r.customer_id, r.row_num) for r in ranked)
    assert [p[1] for p in pairs] == list(range(1, len(pairs) + 1))


def test_split_is_disjoint_complete_and_repeatable(risk):
    split = M.stratified_split(risk)
    rows = {r.customer_id: r.split for r in split.select("customer_id", "split").collect()}
    again = {r.customer_id: r.split for r in
             M.stratified_split(risk).select("customer_id", "split").collect()}
    assert rows == again
    assert len(rows) == risk.count()
    summary = {r.split: r for r in M.split_summary(split).collect()}
    n_test = summary["test"].rows
    assert abs(summary["test"].default_rate_pct - summary["train"].default_rate_pct) / 100 \
        < 1.0 / n_test + 1e-9
    for cls in (0, 1):
        n_c = risk.filter(F.col("is_default") == cls).count()
        t = split.filter((F.col("is_default") == cls) & (F.col("split") == "test")).count()
        assert t == int(np.floor(0.2 * n_c + 0.5))


def test_dashboard_bundle_equals_per_operator_tables(risk):
    bundle = P.dashboard_tables(risk)
    singles = {"portfolio_kpis": P.portfolio_kpis, "heatmap_long": P.heatmap_long,
               "heatmap": P.heatmap, "segment_counts": P.segment_counts,
               "segment_default_rate": P.segment_default_rate,
               "segment_indicators": P.segment_indicators}
    for name, fn in singles.items():
        one = fn(risk)
        assert bundle[name].columns == one.columns, name
        assert sorted(map(tuple, bundle[name].collect())) == sorted(map(tuple, one.collect())), name


def test_profile_bundle_equals_per_operator_tables(spark, sf):
    from riskweave.operators import profile as D
    raw = R.raw(spark, sf).cache()
    bundle = D.profile_tables(raw)
    singles = {"describe": D.describe, "missing_report": D.missing_report,
               "iqr_outliers": D.iqr_outliers, "age_sanity": D.age_sanity}
    for name, fn in singles.items():
        one = fn(raw)
        assert bundle[name].columns == one.columns, name
        assert [f.dataType for f in bundle[name].schema] == [f.dataType for f in one.schema], name
        assert sorted(map(tuple, bundle[name].collect())) == sorted(map(tuple, one.collect())), name


def test_histogram_bundle_equals_per_chart_histograms(risk):
    bundle = P.dashboard_histograms(risk)
    singles = {"income_histogram": P.income_histogram, "debt_histogram": P.debt_histogram,
               "score_histogram": P.score_histogram}
    for name, fn in singles.items():
        one = fn(risk)
        assert bundle[name].columns == one.columns, name
        assert [f.dataType for f in bundle[name].schema] == [f.dataType for f in one.schema], name
        assert sorted(map(tuple, bundle[name].collect())) == sorted(map(tuple, one.collect())), name


def test_histogram_bundle_edge_cases(spark):
    from riskweave.functions.histogram import data_range_histograms
    rows = [(i % 3, None if i % 7 == 0 else float(i % 11) * 0.3, 5.0, None) for i in range(200)]
    df = spark.createDataFrame(rows, "g bigint, x double, const double, empty double")
    specs = {"x": ("x", 7, None), "xg": ("x", 4, "g"), "const": ("const", 3, None),
             "empty": ("empty", 5, None)}
    bundle = data_range_histograms(df, specs)
    for name, (column, bins, by) in specs.items():
        one = histogram(df, column, bins, by=[by] if by else [])
        assert bundle[name].columns == one.columns, name
        assert sorted(map(tuple, bundle[name].collect())) == sorted(map(tuple, one.collect())), name


def test_profile_histogram_bundle_equals_per_chart_histograms(spark, sf):
    from riskweave.operators import profile as D
    raw = R.raw(spark, sf).cache()
    bundle = D.profile_histograms(raw)
    singles = {"age_histogram": D.age_histogram,
               "income_histogram_clipped": D.income_histogram_clipped,
               "debt_histogram_clipped": D.debt_histogram_clipped,
               "util_histogram_clipped": D.util_histogram_clipped,
               "util_histogram_by_class": D.util_histogram_by_class}
    for name, fn in singles.items():
        one = fn(raw)
        assert bundle[name].columns == one.columns, name
        assert [f.dataType for f in bundle[name].schema] == [f.dataType for f in one.schema], name
        assert sorted(map(tuple, bundle[name].collect())) == sorted(map(tuple, one.collect())), name
