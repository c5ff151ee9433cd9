"""The whole build as one call, and the row order of sorted results."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from riskweave.operators import model as M
from riskweave.plans import build as B
from riskweave.plans import registry as R
from riskweave.sources.fixture import raw_loans
from riskweave.sources.snapshots import Snapshots


def test_build_pipeline_stores_tables_and_models(spark, sf, tmp_path, monkeypatch):
    raw = raw_loans(spark, sf)
    built = B.ensure_pipeline(raw, str(tmp_path / "out"), trees=2)
    assert built["risk_segments"].count() == R.risk(spark, sf).count()
    scores = built["model_scores"]
    again = M.score_table(scores, built["lr_model"], built["gbt_model"])
    differ = scores.alias("a").join(again.alias("b"), "customer_id").filter(
        "a.pd_score_lr <> b.pd_score_lr or a.pd_score_xgb <> b.pd_score_xgb")
    assert scores.count() == again.count() > 0 and differ.isEmpty()
    # a finished set is loaded, an unfinished one built again
    calls = []
    monkeypatch.setattr(B, "build_pipeline", lambda *a: calls.append(a))
    B.ensure_pipeline(raw, str(tmp_path / "out"), trees=2)
    assert not calls
    parts = Snapshots(spark, str(tmp_path / "out")).manifest()["parts"]
    (tmp_path / "out" / parts["gbt_model"]["folder"] / "metadata" / "_SUCCESS").unlink()
    B.ensure_pipeline(raw, str(tmp_path / "out"), trees=2)
    assert len(calls) == 1


def descending(column):
    return lambda row: -row[column]


AGES = ["18-25", "25-35", "35-45", "45-55", "55-65", "65+"]


@pytest.mark.parametrize("name, key", [
    ("d3_missing_report", lambda r: (-r.missing_pct, r.column_name)),
    ("d8_rate_by_age_group", lambda r: AGES.index(r.age_group)),
    ("d11_rate_by_income_band", lambda r: r.income_band_order),
    ("d14_target_correlation", lambda r: (-r["corr"], r.column_name)),
    ("d16_value_counts", lambda r: (r.column_name, r.value)),
    ("d17_rate_by_late_90", lambda r: r.late_90_plus),
    ("m11_ml_segment_summary_rule_score", descending("actual_default_rate_pct")),
])
def test_sorted_results_come_back_in_order(spark, sf, name, key):
    if name not in E.queries():
        name = next(q for q in E.queries() if q.startswith(name.split("_")[0] + "_"))
    rows = E.queries()[name](spark, sf).collect()
    assert len(rows) > 1 and [key(r) for r in rows] == sorted(key(r) for r in rows)


def test_summary_and_slices_come_back_in_order(spark, sf):
    key = lambda r: (r.dimension, -r.default_rate_pct, r.segment)
    rows = E.queries()["p4_portfolio_summary"](spark, sf).collect()
    assert len(rows) == 14 and [key(r) for r in rows] == sorted(key(r) for r in rows)
    for name in ("b7_portfolio_slice_age", "b7_portfolio_slice_income"):
        rows = E.queries()[name](spark, sf).collect()
        assert len(rows) > 3 and [key(r) for r in rows] == sorted(key(r) for r in rows)


def test_split_sizes_with_ties_and_one_class(spark):
    df = spark.range(0, 1000).select(F.col("id").alias("customer_id"), (F.col("id") % 3 == 0).cast("int").alias("is_default"))
    got = {(r.is_default, r.split): r["count"] for r in M.stratified_split(df).groupBy("is_default", "split").count().collect()}
    assert got == {(1, "test"): 67, (1, "train"): 267, (0, "test"): 133, (0, "train"): 533}
    one = df.filter("customer_id = 3")
    assert [r.split for r in M.stratified_split(one).collect()] == ["train"]
    assert M.stratified_split(df.limit(0)).collect() == []
