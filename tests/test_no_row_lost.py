"""Rows are neither lost, shifted nor deleted: NULL groups, partly written
folders, CSV headers, large keys, and the order of sorted results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.functions.histogram import histogram
from riskweave.operators import applicants as AP
from riskweave.operators.model import split_key, stratified_split
from riskweave.operators.profile import correlation, value_counts
from riskweave.plans import registry as R
from riskweave.sources.catalog import ensure_built
from riskweave.sources.loans import load_loans_csv


@pytest.mark.parametrize("shared", [True, False])
def test_null_group_keeps_its_rows(spark, shared):
    df = spark.createDataFrame([(1.0, 0), (2.0, 0), (3.0, 1), (4.0, None), (9.0, None)], "x double, g int")
    got = histogram(df, "x", 4, by=["g"], shared_edges=shared).groupBy("g").agg(F.sum("frequency").alias("n")).collect()
    assert {r.g: r.n for r in got} == {0: 2, 1: 1, None: 2}


def test_unfinished_folder_is_not_overwritten(spark, tmp_path):
    path = tmp_path / "t"
    path.mkdir()
    (path / "part-0.parquet").write_bytes(b"not parquet")
    with pytest.raises(FileExistsError):
        ensure_built(spark, "t", lambda: spark.range(3).toDF("x"), str(path))
    assert (path / "part-0.parquet").read_bytes() == b"not parquet"
    new = str(tmp_path / "new")
    assert ensure_built(spark, "t", lambda: spark.range(3).toDF("x"), new).count() == 3
    assert ensure_built(spark, "t", lambda: spark.range(9).toDF("x"), new).count() == 3


def test_csv_without_index_column_does_not_shift(spark, tmp_path):
    file = tmp_path / "a.csv"
    file.write_text("SeriousDlqin2yrs,age,MonthlyIncome\n1,45,NA\n0,30,5000\n")
    got = load_loans_csv(spark, str(file)).orderBy("age").collect()
    assert [r.age for r in got] == [30, 45]
    file.write_text("SeriousDlqin2yrs,age\n1,45.5\n")
    with pytest.raises(Exception, match="MALFORMED"):
        load_loans_csv(spark, str(file)).collect()


def test_split_key_of_large_keys(spark):
    keys = [0, 5, 10**6, 2**51, 2**62]
    got = spark.createDataFrame([(k,) for k in keys], "customer_id long").select("customer_id", split_key().alias("h")).collect()
    assert {r.customer_id: r.h for r in got} == {k: k % 1000003 * 7919 % 1000003 for k in keys}


def test_value_counts_are_sorted(spark):
    df = spark.createDataFrame([(3, 1), (1, 2), (2, 2), (1, 9)], "b long, a long")
    rows = [(r.column_name, r.value) for r in value_counts(df, ["b", "a"]).collect()]
    assert rows == sorted(rows) and len(rows) == 6


def test_every_applicant_is_scored_or_rejected(spark, sf):
    raw = R.raw(spark, sf)
    apps = AP.applicant_features(AP.clean_applicants(raw))
    odd = apps.limit(1).withColumns({"customer_id": F.lit(-1).cast("bigint"), "debt_ratio": F.lit(None).cast("double")})
    f = R.fitted(spark, sf, trees=2)
    got = AP.assess(AP.score_applicants(apps.unionByName(odd), f["lr"], f["gbt"])).select(
        "customer_id", "age", "debt_ratio", "pd_score_lr", "pd_score_xgb", "pd_segment", "vs_portfolio", "reject_reason").collect()
    assert len(got) == raw.count() + 1
    for r in got:
        whole = r.age is not None and r.debt_ratio is not None
        assert (r.reject_reason is None) == whole
        assert all((v is not None) == whole for v in (r.pd_score_lr, r.pd_score_xgb, r.pd_segment, r.vs_portfolio))
    assert "debt_ratio" in next(r.reject_reason for r in got if r.customer_id == -1)
    assert any(r.reject_reason == "missing age" for r in got)


def test_split_keeps_rows_without_label_or_key(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(10)] + [(20, None), (21, None), (None, 1)], "customer_id long, is_default int")
    got = stratified_split(df).collect()
    assert len(got) == 13 and {r.split for r in got} == {"train", "test"}
    assert sum(r.is_default is None for r in got) == 2


def test_correlation_of_constant_empty_and_single_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0, None), (2.0, 4.0, 5.0, None), (3.0, None, 5.0, None), (4.0, 9.0, 5.0, None)],
                               "a double, b double, c double, d double")
    got = {(r.col_a, r.col_b): r["corr"] for r in correlation(df, ["a", "b", "c", "d"]).collect()}
    assert len(got) == 16 and got["a", "a"] == got["b", "b"] == 1.0
    assert got["a", "b"] == got["b", "a"] == pytest.approx(np.corrcoef([1, 2, 4], [2, 4, 9])[0, 1], abs=1e-6)
    assert all(v is None for (x, y), v in got.items() if {x, y} & {"c", "d"})
    assert [tuple(r) for r in correlation(df, ["a"]).collect()] == [("a", "a", 1.0)]


def test_correlation_of_constants_over_many_tasks_and_of_an_empty_table(spark):
    df = spark.range(0, 3000, 1, 7).selectExpr("0.1D as a", "cast(id as double) as b", "if(id % 3 = 0, null, id * id) as c")
    got = {(r.col_a, r.col_b): r["corr"] for r in correlation(df, ["a", "b", "c"]).collect()}
    x = np.array([i for i in range(3000) if i % 3], float)
    assert got["b", "c"] == got["c", "b"] == pytest.approx(np.corrcoef(x, x * x)[0, 1], abs=1e-6)
    assert got["b", "b"] == got["c", "c"] == 1.0 and all(v is None for k, v in got.items() if "a" in k)
    none = correlation(df.limit(0), ["a", "b"]).collect()
    assert len(none) == 4 and all(r["corr"] is None for r in none)
    assert "Generate" not in correlation(df, ["a", "b"])._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[1]
