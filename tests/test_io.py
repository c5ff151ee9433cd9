"""Sources, sinks and catalog helpers."""

import os
import tempfile

from riskweave.plans.build import build_all
from riskweave.sources import catalog as C
from riskweave.sources.loans import load_loans_csv, rename_loans, with_customer_id

HEADER = (",SeriousDlqin2yrs,RevolvingUtilizationOfUnsecuredLines,age,"
          "NumberOfTime30-59DaysPastDueNotWorse,DebtRatio,MonthlyIncome,"
          "NumberOfOpenCreditLinesAndLoans,NumberOfTimes90DaysLate,"
          "NumberRealEstateLoansOrLines,NumberOfTime60-89DaysPastDueNotWorse,NumberOfDependents")


def test_csv_ingest_rename_and_key(spark):
    d = tempfile.mkdtemp(prefix="rw-csv-", dir="/tmp")
    path = os.path.join(d, "loans.csv")
    with open(path, "w") as f:
        f.write(HEADER + "\n")
        f.write("1,1,0.766,45,2,0.80,9120,13,0,6,0,2\n")
        f.write("2,0,0.957,40,0,0.12,,4,0,0,0,\n")
    df = load_loans_csv(spark, path)
    assert df.columns[0] == "customer_id"
    assert {"is_default", "revolving_util", "monthly_income", "num_dependents"} <= set(df.columns)
    rows = df.orderBy("customer_id").collect()
    assert rows[0].monthly_income == 9120.0 and rows[1].monthly_income is None
    assert [r.customer_id for r in rows] == [1, 2]


def test_rename_accepts_both_age_spellings(spark):
    a = spark.createDataFrame([(1, 30)], "SeriousDlqin2yrs long, Age long")
    assert rename_loans(a).columns == ["is_default", "age"]
    b = spark.createDataFrame([(1, 30)], "SeriousDlqin2yrs long, age long")
    assert rename_loans(b).columns == ["is_default", "age"]
    keyed = with_customer_id(rename_loans(b))
    assert keyed.columns[0] == "customer_id"


def test_materialize_load_list_and_ensure_built(spark, sf):
    from riskweave.plans.registry import raw
    d = tempfile.mkdtemp(prefix="rw-tables-", dir="/tmp")
    tables = build_all(raw(spark, sf), with_row_num=False, materialize_to=d)
    risk = tables["risk_segments"]
    assert risk.count() == C.load(spark, "risk_segments", path=os.path.join(d, "risk_segments")).count()
    names = {r.tableName for r in C.list_tables(spark).collect()}
    assert "risk_segments" in names
    calls = []

    def build():
        calls.append(1)
        return risk
    C.ensure_built(spark, "rs_copy", build, path=os.path.join(d, "rs_copy"))
    C.ensure_built(spark, "rs_copy", build, path=os.path.join(d, "rs_copy"))
    assert calls == [1]
    assert C.row_count(risk).first().row_count == risk.count()
    top = C.preview(risk, 3).collect()
    assert [r.customer_id for r in top] == sorted(r.customer_id for r in risk.collect())[:3]
    assert C.cached(risk).storageLevel.useMemory
