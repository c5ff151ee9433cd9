"""Hand-made edge tables (FIXTURES F5): band edges, caps, NULL handling,
rounding, ties in ranking metrics, NULL-skipping statistics."""

import pytest
from pyspark.sql import functions as F

from riskweave.functions.exprs import even_round, ml_segment, pd_segment, sql_round
from riskweave.operators import applicants as AP
from riskweave.operators import evaluate as EV
from riskweave.operators import layers as L
from riskweave.operators import profile as D

RAW_SCHEMA = ("customer_id long, is_default long, revolving_util double, age long, "
              "late_30_59 long, debt_ratio double, monthly_income double, "
              "open_credit_lines long, late_90_plus long, real_estate_loans long, "
              "late_60_89 long, num_dependents double")
BASE = dict(is_default=0, revolving_util=0.1, age=40, late_30_59=0, debt_ratio=0.1,
            monthly_income=5000.0, open_credit_lines=3, late_90_plus=0, real_estate_loans=1,
            late_60_89=0, num_dependents=0.0)
ORDER = [f.split()[0] for f in RAW_SCHEMA.split(", ")]


def raw_frame(spark, overrides):
    rows = []
    for i, o in enumerate(overrides):
        r = dict(BASE, customer_id=i + 1)
        r.update(o)
        rows.append(tuple(r[c] for c in ORDER))
    return spark.createDataFrame(rows, RAW_SCHEMA)


AGES = [None, -1, 0, 1, 17, 18, 24, 25, 34, 35, 44, 45, 54, 55, 60, 61, 64, 65, 100, 101]


def test_age_edges(spark):
    raw = raw_frame(spark, [{"age": a} for a in AGES])
    clean = {r.customer_id: r.age for r in L.clean_loans(raw).collect()}
    kept_raw = {i + 1: a for i, a in enumerate(AGES) if a is not None and a > 0}
    assert set(clean) == set(kept_raw)                       # C1
    for cid, a in kept_raw.items():                           # C2
        assert clean[cid] == (None if a < 18 or a > 100 else a)
    risk = L.risk_segments(L.feature_engineering(L.clean_loans(raw), with_row_num=False))
    got = {r.age: (r.age_band, r.rule_risk_score) for r in risk.collect()}
    assert None not in got                                    # C6 (dbt variant)
    bands = {18: "18-25", 24: "18-25", 25: "25-35", 34: "25-35", 35: "35-45", 44: "35-45",
             45: "45-55", 54: "45-55", 55: "55-65", 64: "55-65", 65: "65+", 100: "65+"}
    for a, band in bands.items():
        assert got[a][0] == band
    # age points on top of debt/util/income points of the base row (0)
    assert got[24][1] == 10 and got[25][1] == 5 and got[34][1] == 5 and got[35][1] == 0
    assert got[60][1] == 0 and got[61][1] == -5
    app = L.risk_segments(L.feature_engineering(L.clean_loans(raw), keep_null_age=True,
                                                with_row_num=False))
    nulls = [r for r in app.collect() if r.age is None]
    assert len(nulls) == 3 and {r.age_band for r in nulls} == {"65+"}
    assert {r.rule_risk_score for r in nulls} == {0.0}


def test_income_edges(spark):
    incomes = [None, 0.0, 1999.99, 2000.0, 3999.99, 4000.0, 5999.99, 6000.0, 9999.99, 10000.0]
    raw = raw_frame(spark, [{"monthly_income": x} for x in incomes])
    risk = L.risk_segments(L.feature_engineering(L.clean_loans(raw), with_row_num=False))
    got = {r.customer_id: (r.monthly_income, r.income_band, r.rule_risk_score)
           for r in risk.collect()}
    expect = ["$2-4k", "<$2k", "<$2k", "$2-4k", "$2-4k", "$4-6k", "$4-6k", "$6-10k", "$6-10k",
              ">$10k"]
    points = [2, 5, 5, 2, 2, 0, 0, 0, 0, 0]
    for i, (band, pts) in enumerate(zip(expect, points)):
        inc, b, score = got[i + 1]
        assert b == band
        assert score == pts
    assert got[1][0] == 3500.0                                # C3


def test_caps_skip_null(spark):
    vals = [None, -1.0, 0.0, 1.0, 2.0]
    raw = raw_frame(spark, [{"revolving_util": v, "debt_ratio": None if v is None else v * 5,
                             "open_credit_lines": None if v is None else int(v * 50),
                             "late_30_59": None if v is None else int(v * 15)} for v in vals])
    rows = sorted(L.clean_loans(raw).collect(), key=lambda r: r.customer_id)
    assert [r.revolving_util for r in rows] == [0.0, 0.0, 0.0, 1.0, 1.0]
    assert [r.debt_ratio for r in rows] == [5.0, -5.0, 0.0, 5.0, 5.0]
    assert [r.open_credit_lines for r in rows] == [50, -50, 0, 50, 50]
    assert [r.late_30_59 for r in rows] == [15, -15, 0, 15, 15]


def test_rounding_rules(spark):
    df = spark.createDataFrame([(2.135,), (4.145,), (35.355,)], "x double")
    got = [r[0] for r in df.select(sql_round("x", 2)).collect()]
    assert got == [2.13, 4.14, 35.35]
    native = [r[0] for r in df.select(F.round("x", 2)).collect()]
    assert native[0] == 2.14                                  # why sql_round exists
    ev = spark.createDataFrame([(0.125,), (2.5,), (3.5,)], "x double")
    assert [r[0] for r in ev.select(even_round("x", 2)).collect()][0] == 0.12
    assert [r[0] for r in ev.select(even_round("x", 0)).collect()] == [0.0, 2.0, 4.0]


SCORES = [(0.9, 1), (0.8, 0), (0.8, 1), (0.5, 1), (0.5, 0), (0.3, 0), (0.1, 0), (0.0, 0)]


def brute_auc(pairs):
    pos = [s for s, y in pairs if y == 1]
    neg = [s for s, y in pairs if y == 0]
    wins = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return wins / (len(pos) * len(neg))


def reference_roc(pairs):
    """Plain-Python form of the usual ROC construction with drop_intermediate."""
    pts = sorted(pairs, key=lambda t: -t[0])
    th, tps, fps = [], [], []
    tp = fp = 0
    for i, (s, y) in enumerate(pts):
        tp += y
        fp += 1 - y
        if i == len(pts) - 1 or pts[i + 1][0] != s:
            th.append(s)
            tps.append(tp)
            fps.append(fp)
    keep = [0] + [i for i in range(1, len(th) - 1)
                  if fps[i - 1] - 2 * fps[i] + fps[i + 1] != 0
                  or tps[i - 1] - 2 * tps[i] + tps[i + 1] != 0] + [len(th) - 1]
    out = [(float("inf"), 0, 0)] + [(th[i], fps[i], tps[i]) for i in keep]
    return out


def test_ranking_metrics_with_ties(spark):
    df = spark.createDataFrame(SCORES, "score double, is_default long")
    row = EV.auc(df).first()
    assert row.auc == pytest.approx(brute_auc(SCORES), abs=1e-12)
    assert row.gini == pytest.approx(2 * brute_auc(SCORES) - 1, abs=1e-12)
    flipped = df.withColumn("score", -F.col("score"))
    assert EV.auc(flipped).first().auc + row.auc == pytest.approx(1.0)
    roc = sorted(((r.threshold, r.fps, r.tps) for r in EV.roc_curve(df).collect()),
                 key=lambda t: -t[0])
    assert roc == reference_roc(SCORES)
    cm = {(r.actual, r.predicted): r["count"] for r in EV.confusion(df).collect()}
    assert cm == {(0, 0): 3, (0, 1): 2, (1, 0): 0, (1, 1): 3}
    strict = {(r.actual, r.predicted): r["count"]
              for r in EV.confusion(df, inclusive=False).collect()}
    assert strict == {(0, 0): 4, (0, 1): 1, (1, 0): 1, (1, 1): 2}
    rep = {r.label: r for r in EV.classification_report(df).collect()}
    assert rep["1"].precision == pytest.approx(2 / 3, abs=1e-6)
    assert rep["1"].recall == pytest.approx(2 / 3, abs=1e-6)
    assert rep["accuracy"].f1_score == pytest.approx(6 / 8, abs=1e-6)
    assert rep["weighted avg"].support == 8
    seg = [r[0] for r in df.select(ml_segment("score")).collect()]
    assert seg == ["High Risk", "High Risk", "High Risk", "High Risk", "High Risk",
                   "Medium Risk", "Low Risk", None]
    left = [r[0] for r in df.select(pd_segment("score")).collect()]
    assert left[5:] == ["High Risk", "Medium Risk", "Low Risk"]


def test_null_skipping_statistics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, None), (4.0, 3.0), (None, 5.0), (8.0, 9.0)],
                               "a double, b double")
    d = {r.column_name: r for r in D.describe(df, ["a", "b"]).collect()}
    assert d["a"].p25 == pytest.approx(1.75)
    assert d["a"].std == pytest.approx(3.0957, abs=1e-4)
    assert d["a"]["count"] == 4
    c = {(r.col_a, r.col_b): r.corr for r in D.correlation(df, ["a", "b"]).collect()}
    assert c[("a", "b")] == pytest.approx(0.95268, abs=1e-5)
    assert c[("a", "a")] == 1.0


def test_applicant_flags_and_loss(spark):
    raw = raw_frame(spark, [
        {},                                                              # no flag
        {"late_90_plus": 1, "revolving_util": 0.85, "debt_ratio": 0.6, "late_30_59": 2,
         "monthly_income": 1500.0, "age": 22},                           # every flag
    ])
    apps = AP.applicant_features(L.clean_loans(raw))
    flags = {r.customer_id: r.f for r in apps.select("customer_id",
                                                      AP.risk_flags().alias("f")).collect()}
    assert flags[1] == ["No significant risk flags detected"]
    assert flags[2] == AP.FLAG_TEXTS
    scored = apps.withColumns({"pd_score_xgb": F.lit(0.2), "pd_score_lr": F.lit(0.05)})
    out = {r.customer_id: r for r in AP.assess(scored).collect()}
    assert out[1].pd_segment == "Medium Risk"
    assert out[1].vs_portfolio == "above"
    assert out[1].gap_pct_points == pytest.approx(13.3)
    assert out[1].exposure_at_default == 60000.0
    assert out[1].expected_loss == pytest.approx(0.2 * 0.45 * 60000)
    br = AP.score_breakdown(scored).filter("customer_id = 1").collect()
    assert {r.model: r.vs_portfolio for r in br} == {"Gradient Boosted Trees": "above",
                                                     "Logistic Regression": "below"}


def test_approximate_quantiles_stay_close(spark, sf):
    from riskweave.plans import registry as R
    raw = R.raw(spark, sf)
    exact = {r.column_name: r for r in D.describe(raw).collect()}
    approx = {r.column_name: r for r in D.describe(raw, approx=True).collect()}
    for c, r in exact.items():
        assert approx[c]["count"] == r["count"]
        assert approx[c].min <= approx[c].p50 <= approx[c].max
    b1 = {r.is_default: r for r in D.box_stats(raw).collect()}
    b2 = {r.is_default: r for r in D.box_stats(raw, approx=True).collect()}
    assert set(b1) == set(b2)
    i2 = D.iqr_outliers(raw, approx=True).collect()
    assert len(i2) == 10
