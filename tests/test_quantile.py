"""Distributed exact quantiles equal numpy's linear quantiles."""

import numpy as np
import pytest

from riskweave.operators.quantile import exact_median, exact_quantiles

PROBS = [0.0, 0.25, 0.5, 0.75, 1.0]


def _frame(spark, n=3000, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        g = int(rng.integers(0, 3))
        # a third of the rows share one value; many ties; some NULLs
        a = 7.0 if i % 3 == 0 else float(np.round(rng.normal(10, 4), 1))
        b = None if i % 5 == 0 else float(rng.exponential(2.0))
        c = 42.0 if g == 2 else None           # one value in group 2, NULL elsewhere
        rows.append((g, a, b, c, None))
    schema = "g int, a double, b double, c double, d double"
    return spark.createDataFrame(rows, schema), rows


def _expect(rows, col_idx, group=None):
    vals = [r[col_idx] for r in rows if r[col_idx] is not None
            and (group is None or r[0] == group)]
    if not vals:
        return None
    return list(np.quantile(np.array(vals), PROBS))


@pytest.mark.parametrize("buckets", [1, 4, 16])
def test_exact_quantiles_match_numpy(spark, buckets):
    df, rows = _frame(spark)
    got = {r.column_name: r.q for r in
           exact_quantiles(df, ["a", "b", "c", "d"], PROBS, n_buckets=buckets).collect()}
    assert set(got) == {"a", "b", "c"}          # an all-NULL column has no row
    for name, idx in (("a", 1), ("b", 2), ("c", 3)):
        assert got[name] == pytest.approx(_expect(rows, idx), rel=1e-12, abs=1e-12)


def test_exact_quantiles_by_group(spark):
    df, rows = _frame(spark, seed=11)
    got = {(r.column_name, r.g): r.q for r in
           exact_quantiles(df, ["a", "b"], PROBS, by=["g"], n_buckets=8).collect()}
    for g in range(3):
        for name, idx in (("a", 1), ("b", 2)):
            assert got[(name, g)] == pytest.approx(_expect(rows, idx, g), rel=1e-12)


def test_exact_median_scalar(spark):
    df, rows = _frame(spark, n=501, seed=5)
    med = df.select(exact_median(df, "b").alias("m")).first().m
    assert med == pytest.approx(float(np.median([r[2] for r in rows if r[2] is not None])))
    empty = df.select(exact_median(df, "d").alias("m")).first().m
    assert empty is None


def test_single_row_and_plan_has_no_single_partition(spark):
    df = spark.createDataFrame([(1.5,)], "x double")
    assert exact_quantiles(df, ["x"], [0.1, 0.9]).first().q == [1.5, 1.5]
    big = spark.range(0, 20000).selectExpr("cast(id % 977 as double) as x")
    plan = exact_quantiles(big, ["x"], [0.5])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_source_is_read_three_times_and_planning_runs_no_job(spark):
    """The sketch, the bucket totals and the hot-bucket rows are three passes
    of one plan; no job runs before the action."""
    df = spark.range(0, 5000).selectExpr("id % 2 as g", "cast(id % 977 as double) as x")
    tracker, group = spark.sparkContext.statusTracker(), "quantile-planning"
    spark.sparkContext.setJobGroup(group, "planning")
    q = exact_quantiles(df, ["x"], [0.25, 0.5], by=["g"])
    assert not tracker.getJobIdsForGroup(group)
    q.collect()
    final = q._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("Range (") == 3, final


from hypothesis import HealthCheck, given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=12, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.one_of(st.none(), st.integers(-50, 50).map(float),
                                 st.floats(-1e6, 1e6, allow_nan=False)),
                       min_size=1, max_size=400),
       probs=st.lists(st.floats(0, 1), min_size=1, max_size=4),
       buckets=st.integers(1, 12))
def test_exact_quantiles_property(spark, values, probs, buckets):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    rows = exact_quantiles(df, ["x"], probs, n_buckets=buckets).collect()
    present = [v for v in values if v is not None]
    if not present:
        assert rows == []
        return
    want = list(np.quantile(np.array(present), probs))
    assert rows[0].q == pytest.approx(want, rel=1e-9, abs=1e-9)


def test_approx_quantile_table_matches_on_few_distinct_values(spark):
    """``approx=True`` (``percentile_approx``) returns actual data values; on
    columns with few distinct values and probabilities that hit a value
    exactly it equals the exact table, per column and per group."""
    from riskweave.operators.profile import quantile_table
    rows = [(i % 2, float(i % 5), float(i % 3)) for i in range(101)]
    df = spark.createDataFrame(rows, "g bigint, a double, b double")
    for by in ([], ["g"]):
        approx = {(r.column_name, *[r[c] for c in by]): r.q for r in
                  quantile_table(df, ["a", "b"], (0.0, 1.0), by=by, approx=True).collect()}
        exact = {(r.column_name, *[r[c] for c in by]): r.q for r in
                 quantile_table(df, ["a", "b"], (0.0, 1.0), by=by).collect()}
        assert approx == exact


def test_iqr_report_counts_all_columns_from_one_fact_a_row(spark):
    from riskweave.operators.profile import iqr_outliers
    from riskweave.sources.kept import scope
    rows = [(float(i), i if i % 3 else None) for i in range(100)] + [(1e6, -5000), (None, None)]
    df = spark.createDataFrame(rows, "u double, v long")
    with scope(spark):
        report = iqr_outliers(df, ["u", "v"])
        plan = report._jdf.queryExecution().withCachedData().toString()
        # the kept statistics aside, the rows are read once and not stacked by column
        assert "beyond1" in plan and "InMemoryRelation" in plan
        found = {r.column_name: (r.n_outliers, r.outlier_pct, r.q1, r.q3) for r in report.collect()}
    assert found["u"] == (1, 0.98, 25.0, 75.0)
    assert found["v"][0] == 1 and set(found) == {"u", "v"}
