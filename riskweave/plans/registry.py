"""Registered queries: one per operator of SURVEY §2 that has a result table.

``QUERIES[name](spark, sf_dir)`` returns a lazy DataFrame computed from the
driver's tables (``raw_loans`` is derived from ``orders`` and ``lineitem``,
so every query grows with the data). ``ORACLE[name]`` is the matching DuckDB
text; it is absent where the result is not SQL-expressible (fitted models).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import INCOME_BAND_LABELS, sql_round
from ..operators import layers as L
from ..operators import portfolio as P
from ..sources.catalog import preview, row_count
from ..sources.fixture import raw_loans, read_table
from ..sources.kept import on_release
from ..sources.loans import (CSV_SCHEMA, CSV_TO_ENGINE, parse_loan_lines, rename_loans,
                             split_good_and_rejected, with_customer_id, with_row_ids)
from . import oracle as O
from .build import build_all

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# -- base frames --------------------------------------------------------------

def raw(spark: SparkSession, sf: str) -> DataFrame:
    return raw_loans(spark, sf)


def clean(spark: SparkSession, sf: str) -> DataFrame:
    return L.clean_loans(raw(spark, sf))


def features(spark: SparkSession, sf: str, row_num: bool = False,
             app: bool = False) -> DataFrame:
    return L.feature_engineering(clean(spark, sf), keep_null_age=app, with_row_num=row_num)


def risk(spark: SparkSession, sf: str, row_num: bool = False, app: bool = False) -> DataFrame:
    return L.risk_segments(features(spark, sf, row_num=row_num, app=app))


RAW_COLS = ("customer_id, is_default, revolving_util, age, late_30_59, debt_ratio, "
            "monthly_income, open_credit_lines, late_90_plus, real_estate_loans, "
            "late_60_89, num_dependents")

# =============================================================================
# A. sources, sinks, catalog
# =============================================================================


@register("a2_rename_loans", O.with_layers(f"SELECT {RAW_COLS} FROM raw_loans"))
def a2_rename_loans(spark, sf):
    """The CSV header names are put on ``raw_loans`` and mapped back."""
    to_csv = {engine: csv for csv, engine in CSV_TO_ENGINE.items() if csv != "Age"}
    as_csv = raw(spark, sf).withColumnsRenamed(to_csv)
    return rename_loans(as_csv)


def _csv_lines(df: DataFrame) -> DataFrame:
    """The rows of ``raw_loans`` as lines of the CSV file: ``line, customer_id``."""
    header = [f.name for f in CSV_SCHEMA.fields]
    to_csv = {CSV_TO_ENGINE.get(h, "customer_id"): h for h in header}
    named = df.select(*[F.col(e).alias(h) for e, h in to_csv.items()])
    return named.select(F.to_csv(F.struct(*header)).alias("line"), F.col("_c0").alias("customer_id"))


@register("a1_csv_round_trip", O.with_layers(f"SELECT {RAW_COLS} FROM raw_loans"))
def a1_csv_round_trip(spark, sf):
    """Every row as a line of CSV text, parsed back with its types."""
    parsed = parse_loan_lines(_csv_lines(raw(spark, sf)).select("line"), [f.name for f in CSV_SCHEMA.fields])
    good, _ = split_good_and_rejected(parsed)
    return with_customer_id(rename_loans(good))


@register("a1_rejects", O.with_layers("""
SELECT customer_id,
  concat_ws('; ',
    CASE WHEN customer_id % 89 = 4 THEN 'not 12 fields' END,
    CASE WHEN customer_id % 101 = 6 THEN '_c0: x' || customer_id || ' is no bigint' END,
    CASE WHEN customer_id % 103 = 7 THEN 'age: old is no bigint' END) AS reason
FROM raw_loans WHERE customer_id % 89 = 4 OR customer_id % 101 = 6 OR customer_id % 103 = 7"""))
def a1_rejects(spark, sf):
    """Some lines get a field too many, a key or an age that is no number:
    the rejected lines, each with all its reasons."""
    lines = _csv_lines(raw(spark, sf)).select("customer_id", "line")
    k, line = F.col("customer_id"), F.col("line")
    line = F.when(k % 103 == 7, F.regexp_replace(line, r"^((?:[^,]*,){3})[^,]*", "$1old")).otherwise(line)
    line = F.concat(F.when(k % 101 == 6, "x").otherwise(""), line, F.when(k % 89 == 4, ",7").otherwise(""))
    parsed = parse_loan_lines(lines.select("customer_id", line.alias("line")), [f.name for f in CSV_SCHEMA.fields])
    return split_good_and_rejected(parsed, "customer_id")[1].drop("line")


@register("a3_row_key", "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id, o_orderkey, o_totalprice FROM orders")
def a3_row_key(spark, sf):
    """The number of each row of the order files; they are written in key order."""
    return with_row_ids(read_table(spark, sf, "orders")).select("row_id", "o_orderkey", "o_totalprice")


@register("a5_raw_loans", O.with_layers(f"SELECT {RAW_COLS} FROM raw_loans"))
def a5_raw_loans(spark, sf):
    return raw(spark, sf)


@register("a7_preview", O.with_layers(
    f"SELECT {RAW_COLS} FROM raw_loans ORDER BY customer_id LIMIT 3"))
def a7_preview(spark, sf):
    return preview(raw(spark, sf), 3)


@register("a8_row_count", O.with_layers("SELECT COUNT(*) AS row_count FROM raw_loans"))
def a8_row_count(spark, sf):
    return row_count(raw(spark, sf))


@register("a10_layer_row_counts", O.with_layers("""
SELECT 'raw_loans' AS layer, COUNT(*) AS row_count FROM raw_loans
UNION ALL SELECT 'clean_loans', COUNT(*) FROM clean_loans
UNION ALL SELECT 'feature_engineering', COUNT(*) FROM feature_engineering
UNION ALL SELECT 'risk_segments', COUNT(*) FROM risk_segments
UNION ALL SELECT 'portfolio_summary', COUNT(*) FROM (
  SELECT age_band FROM risk_segments GROUP BY age_band
  UNION ALL SELECT income_band FROM risk_segments GROUP BY income_band
  UNION ALL SELECT risk_segment FROM risk_segments GROUP BY risk_segment)"""))
def a10_layer_row_counts(spark, sf):
    tables = build_all(raw(spark, sf), with_row_num=False, persist=False)
    counts = [tables[name].agg(F.count(F.lit(1)).alias("row_count"))
              .select(F.lit(name).alias("layer"), "row_count")
              for name in ("raw_loans", "clean_loans", "feature_engineering", "risk_segments",
                           "portfolio_summary")]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


# =============================================================================
# B. projections and filters
# =============================================================================

MODEL_FEATURES_SQL = (
    "age, monthly_income, num_dependents, revolving_util, debt_ratio, open_credit_lines, "
    "real_estate_loans, late_30_59, late_60_89, late_90_plus, total_late_payments, "
    "ever_seriously_delinquent, high_util_flag, high_debt_flag, income_per_dependent, "
    "estimated_monthly_debt")


@register("b2_select_features", O.with_layers(
    f"SELECT customer_id, {MODEL_FEATURES_SQL}, is_default FROM risk_segments"))
def b2_select_features(spark, sf):
    from ..operators.model import select_features
    return select_features(risk(spark, sf))


@register("b6_valid_age_range", O.with_layers(
    f"SELECT {RAW_COLS} FROM raw_loans WHERE age BETWEEN 18 AND 100"))
def b6_valid_age_range(spark, sf):
    return raw(spark, sf).filter(F.col("age").between(18, 100))


@register("b7_portfolio_slice_age", O.with_layers("""
SELECT * FROM (
  SELECT 'age_band' AS dimension, age_band AS segment, COUNT(*) AS total_customers,
    CAST(SUM(is_default) AS BIGINT) AS total_defaults,
    ROUND(AVG(is_default) * 100, 2) AS default_rate_pct,
    ROUND(AVG(monthly_income), 0) AS avg_income, ROUND(AVG(debt_ratio), 3) AS avg_debt_ratio,
    ROUND(AVG(revolving_util), 3) AS avg_util
  FROM risk_segments WHERE age_band IS NOT NULL GROUP BY age_band)
ORDER BY default_rate_pct DESC, segment"""))
def b7_portfolio_slice_age(spark, sf):
    return P.portfolio_slice(P.portfolio_summary(risk(spark, sf), ordered=False), "age_band")


@register("b7_portfolio_slice_income", O.with_layers("""
SELECT 'income_band' AS dimension, income_band AS segment, COUNT(*) AS total_customers,
  CAST(SUM(is_default) AS BIGINT) AS total_defaults,
  ROUND(AVG(is_default) * 100, 2) AS default_rate_pct,
  ROUND(AVG(monthly_income), 0) AS avg_income, ROUND(AVG(debt_ratio), 3) AS avg_debt_ratio,
  ROUND(AVG(revolving_util), 3) AS avg_util
FROM risk_segments WHERE income_band IS NOT NULL GROUP BY income_band
ORDER BY default_rate_pct DESC, segment"""))
def b7_portfolio_slice_income(spark, sf):
    return P.portfolio_slice(P.portfolio_summary(risk(spark, sf), ordered=False),
                             "income_band")


@register("b8_drop_null_rows", O.with_layers(
    f"SELECT customer_id, {MODEL_FEATURES_SQL}, is_default FROM risk_segments_app "
    "WHERE age IS NOT NULL"))
def b8_drop_null_rows(spark, sf):
    from ..operators.model import FEATURES, drop_null_rows, select_features
    return drop_null_rows(select_features(risk(spark, sf, app=True)), [*FEATURES, "is_default"])


@register("b9_positive_age", O.with_layers(f"SELECT {RAW_COLS} FROM raw_loans WHERE age > 0"))
def b9_positive_age(spark, sf):
    return raw(spark, sf).filter(F.col("age") > 0)


# =============================================================================
# C. cleaning layer
# =============================================================================


@register("c1_drop_invalid_age", O.with_layers(
    f"SELECT {RAW_COLS} FROM raw_loans WHERE age > 0 AND age IS NOT NULL"))
def c1_drop_invalid_age(spark, sf):
    return L.drop_invalid_age(raw(spark, sf))


@register("c2_null_out_of_range_age", O.with_layers(
    "SELECT customer_id, age AS raw_age, "
    "CASE WHEN age < 18 OR age > 100 THEN NULL ELSE age END AS age FROM raw_loans"))
def c2_null_out_of_range_age(spark, sf):
    return raw(spark, sf).select("customer_id", F.col("age").alias("raw_age"),
                                 L.null_out_of_range_age("age").alias("age"))


@register("c3_impute_income", O.with_layers(
    "SELECT customer_id, COALESCE(monthly_income, 3500) AS monthly_income FROM raw_loans"))
def c3_impute_income(spark, sf):
    return raw(spark, sf).select("customer_id", L.impute_income().alias("monthly_income"))


@register("c4_impute_dependents", O.with_layers(
    "SELECT customer_id, COALESCE(num_dependents, 0) AS num_dependents FROM raw_loans"))
def c4_impute_dependents(spark, sf):
    return raw(spark, sf).select("customer_id", L.impute_dependents().alias("num_dependents"))


@register("c5_caps", O.with_layers("""
SELECT customer_id, LEAST(GREATEST(revolving_util, 0), 1.0) AS revolving_util,
  LEAST(debt_ratio, 5.0) AS debt_ratio, LEAST(open_credit_lines, 50) AS open_credit_lines,
  LEAST(real_estate_loans, 10) AS real_estate_loans, LEAST(late_30_59, 15) AS late_30_59,
  LEAST(late_60_89, 15) AS late_60_89, LEAST(late_90_plus, 15) AS late_90_plus
FROM raw_loans"""))
def c5_caps(spark, sf):
    return raw(spark, sf).select(
        "customer_id", L.cap("revolving_util", 1.0, lower=0.0).alias("revolving_util"),
        *[L.cap(name, upper).alias(name) for name, upper in L.CAPS.items()])


@register("c6_require_age", O.with_layers("SELECT * FROM clean_loans WHERE age IS NOT NULL"))
def c6_require_age(spark, sf):
    return L.require_age(clean(spark, sf))


@register("c7_clean_loans", O.with_layers("SELECT * FROM clean_loans"))
def c7_clean_loans(spark, sf):
    return clean(spark, sf)


# =============================================================================
# E. feature layer
# =============================================================================

_E_SINGLE = {
    "e1_age_band": "age_band",
    "e2_income_band": "income_band",
    "e3_total_late_payments": "total_late_payments",
    "e4_ever_seriously_delinquent": "ever_seriously_delinquent",
    "e5_high_util_flag": "high_util_flag",
    "e6_high_debt_flag": "high_debt_flag",
    "e7_income_per_dependent": "income_per_dependent",
    "e8_estimated_monthly_debt": "estimated_monthly_debt",
}


def _feature_column_query(column: str) -> Query:
    def q(spark, sf):
        return L.require_age(clean(spark, sf)).select(
            "customer_id", L.engineered_columns()[column].alias(column))
    return q


for _name, _col in _E_SINGLE.items():
    register(_name, O.with_layers(
        f"SELECT customer_id, {_col} FROM feature_engineering"))(_feature_column_query(_col))


@register("e9_row_num", O.with_layers(
    "SELECT customer_id, row_num FROM feature_engineering"))
def e9_row_num(spark, sf):
    from ..operators.prefix import global_row_number
    return global_row_number(L.require_age(clean(spark, sf)).select("customer_id"),
                             "customer_id", "row_num")


@register("e10_feature_engineering", O.with_layers("SELECT * FROM feature_engineering"))
def e10_feature_engineering(spark, sf):
    return features(spark, sf, row_num=True)


@register("e10_feature_engineering_app", O.with_layers("SELECT * FROM feature_engineering_app"))
def e10_feature_engineering_app(spark, sf):
    return features(spark, sf, row_num=True, app=True)


# =============================================================================
# R. rule scoring layer
# =============================================================================


@register("r1_rule_risk_score", O.with_layers(
    "SELECT customer_id, rule_risk_score FROM risk_segments"))
def r1_rule_risk_score(spark, sf):
    return features(spark, sf).select("customer_id",
                                      L.rule_risk_score().alias("rule_risk_score"))


@register("r2_risk_segment", O.with_layers(
    "SELECT customer_id, risk_segment FROM risk_segments"))
def r2_risk_segment(spark, sf):
    return features(spark, sf).select("customer_id", L.risk_segment().alias("risk_segment"))


@register("r3_risk_segments", O.with_layers("SELECT * FROM risk_segments"))
def r3_risk_segments(spark, sf):
    return risk(spark, sf, row_num=True)


@register("r3_risk_segments_app", O.with_layers("SELECT * FROM risk_segments_app"))
def r3_risk_segments_app(spark, sf):
    return risk(spark, sf, row_num=True, app=True)


# =============================================================================
# P. portfolio aggregations
# =============================================================================

_SUMMARY_SQL = """
  COUNT(*) AS total_customers, CAST(SUM(is_default) AS BIGINT) AS total_defaults,
  ROUND(AVG(is_default) * 100, 2) AS default_rate_pct,
  ROUND(AVG(monthly_income), 0) AS avg_income,
  ROUND(AVG(debt_ratio), 3) AS avg_debt_ratio,
  ROUND(AVG(revolving_util), 3) AS avg_util"""


def _summary_sql(dim: str, table: str = "risk_segments") -> str:
    where = "" if dim == "risk_segment" else f"WHERE {dim} IS NOT NULL"
    return (f"SELECT '{dim}' AS dimension, {dim} AS segment, {_SUMMARY_SQL} "
            f"FROM {table} {where} GROUP BY {dim}")


for _i, _dim in enumerate(P.DIMENSIONS, start=1):
    def _q(spark, sf, _dim=_dim):
        return P.summarize(risk(spark, sf), _dim)
    register(f"p{_i}_summary_by_{_dim}", O.with_layers(_summary_sql(_dim)))(_q)


@register("p4_portfolio_summary", O.with_layers(
    "\nUNION ALL\n".join(_summary_sql(d) for d in P.DIMENSIONS)
    + "\nORDER BY dimension, default_rate_pct DESC, segment"))
def p4_portfolio_summary(spark, sf):
    return P.portfolio_summary(risk(spark, sf))


@register("p4_portfolio_summary_app", O.with_layers(
    "\nUNION ALL\n".join(_summary_sql(d, "risk_segments_app") for d in P.DIMENSIONS)))
def p4_portfolio_summary_app(spark, sf):
    return P.portfolio_summary(risk(spark, sf, app=True))


@register("p6_portfolio_kpis", O.with_layers("""
SELECT COUNT(*) AS total_customers, CAST(SUM(is_default) AS BIGINT) AS total_defaults,
  AVG(is_default) * 100 AS default_rate_pct, AVG(monthly_income) AS avg_monthly_income,
  AVG(debt_ratio) AS avg_debt_ratio
FROM risk_segments"""))
def p6_portfolio_kpis(spark, sf):
    return P.portfolio_kpis(risk(spark, sf))


@register("p7_heatmap_long", O.with_layers("""
SELECT age_band, income_band, ROUND_EVEN(AVG(is_default) * 100, 2) AS default_rate_pct
FROM risk_segments WHERE age_band IS NOT NULL AND income_band IS NOT NULL
GROUP BY age_band, income_band"""))
def p7_heatmap_long(spark, sf):
    return P.heatmap_long(risk(spark, sf))


@register("p8_heatmap", O.with_layers(
    "SELECT age_band, "
    + ", ".join(
        f"ROUND_EVEN(AVG(CASE WHEN income_band = '{label}' THEN is_default END) * 100, 2) AS {name}"
        for label, name in zip(INCOME_BAND_LABELS, P.INCOME_BAND_COLUMNS))
    + " FROM risk_segments WHERE age_band IS NOT NULL AND income_band IS NOT NULL"
      " GROUP BY age_band"))
def p8_heatmap(spark, sf):
    return P.heatmap(risk(spark, sf))


@register("p11_segment_counts", O.with_layers("""
SELECT s.risk_segment, COALESCE(c.customers, 0) AS customers,
  CASE WHEN t.total = 0 THEN 0.0 ELSE COALESCE(c.customers, 0) / t.total * 100 END AS share_pct
FROM (VALUES ('High Risk'), ('Medium Risk'), ('Low Risk')) AS s(risk_segment)
LEFT JOIN (SELECT risk_segment, COUNT(*) AS customers FROM risk_segments GROUP BY risk_segment) c
  ON c.risk_segment = s.risk_segment
CROSS JOIN (SELECT COUNT(*) AS total FROM risk_segments) t"""))
def p11_segment_counts(spark, sf):
    return P.segment_counts(risk(spark, sf))


@register("p12_segment_default_rate", O.with_layers("""
SELECT risk_segment, ROUND_EVEN(AVG(is_default) * 100, 2) AS default_rate_pct
FROM risk_segments GROUP BY risk_segment"""))
def p12_segment_default_rate(spark, sf):
    return P.segment_default_rate(risk(spark, sf))


@register("p14_segment_indicators", O.with_layers("""
SELECT risk_segment, ROUND_EVEN(AVG(revolving_util), 3) AS avg_util,
  ROUND_EVEN(AVG(debt_ratio), 3) AS avg_debt_ratio,
  ROUND_EVEN(AVG(late_90_plus), 3) AS avg_late_90,
  ROUND_EVEN(AVG(monthly_income), 3) AS avg_income
FROM risk_segments GROUP BY risk_segment"""))
def p14_segment_indicators(spark, sf):
    return P.segment_indicators(risk(spark, sf))


@register("p9_income_histogram", O.histogram_sql("risk_segments", "monthly_income", 60))
def p9_income_histogram(spark, sf):
    return P.income_histogram(risk(spark, sf))


@register("p10_debt_histogram", O.histogram_sql("risk_segments", "debt_ratio", 60))
def p10_debt_histogram(spark, sf):
    return P.debt_histogram(risk(spark, sf))


@register("p13_score_histogram_by_class", O.histogram_sql(
    "risk_segments", "rule_risk_score", 50, by=("is_default",), shared=True))
def p13_score_histogram_by_class(spark, sf):
    return P.score_histogram(risk(spark, sf))


# =============================================================================
# D. profiling of the raw table
# =============================================================================

from ..operators import profile as D  # noqa: E402


def _dbl(c: str) -> str:
    return f"CAST({c} AS DOUBLE)"


def _schema_sql() -> str:
    """DuckDB reports the type of each F2 column as it evaluates the table
    (``typeof`` is the static type, also for a NULL value)."""
    cols = [c.strip() for c in RAW_COLS.split(",")]
    parts = [f"SELECT {i} AS position, '{c}' AS column_name, lower(typeof({c})) AS data_type "
             f"FROM (SELECT * FROM raw_loans LIMIT 1)" for i, c in enumerate(cols)]
    return (f"SELECT t.*, (SELECT COUNT(*) FROM raw_loans) AS n_rows FROM (\n"
            + "\nUNION ALL\n".join(parts) + "\n) t")


@register("d1_schema_profile", O.with_layers(_schema_sql()))
def d1_schema_profile(spark, sf):
    return D.schema_profile(raw(spark, sf))


@register("d2_describe", O.with_layers("\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, COUNT({c}) AS count, ROUND(AVG({_dbl(c)}), 6) AS mean, "
    f"ROUND(STDDEV_SAMP({_dbl(c)}), 6) AS std, ROUND(MIN({_dbl(c)}), 6) AS min, "
    f"ROUND(QUANTILE_CONT({_dbl(c)}, 0.25), 6) AS p25, "
    f"ROUND(QUANTILE_CONT({_dbl(c)}, 0.5), 6) AS p50, "
    f"ROUND(QUANTILE_CONT({_dbl(c)}, 0.75), 6) AS p75, ROUND(MAX({_dbl(c)}), 6) AS max "
    f"FROM raw_loans" for c in D.PROFILE_COLUMNS)))
def d2_describe(spark, sf):
    return D.describe(raw(spark, sf))


_RAW_ALL = ["customer_id", *D.PROFILE_COLUMNS]


@register("d3_missing_report", O.with_layers(
    "SELECT column_name, missing_count, ROUND_EVEN(missing_count / n * 100, 2) AS missing_pct "
    "FROM (" + "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, COUNT(*) - COUNT({c}) AS missing_count FROM raw_loans"
        for c in _RAW_ALL)
    + ") m CROSS JOIN (SELECT COUNT(*) AS n FROM raw_loans) t WHERE missing_count > 0 "
      "ORDER BY missing_pct DESC, column_name"))
def d3_missing_report(spark, sf):
    return D.missing_report(raw(spark, sf))


@register("d4_target_distribution", O.with_layers("""
SELECT is_default, COUNT(*) AS count,
  COUNT(*) / (SELECT COUNT(*) FROM raw_loans WHERE is_default IS NOT NULL) * 100 AS pct,
  (SELECT CASE WHEN COUNT(*) FILTER (WHERE is_default = 1) = 0 THEN NULL
          ELSE COUNT(*) FILTER (WHERE is_default = 0) / COUNT(*) FILTER (WHERE is_default = 1) END
   FROM raw_loans WHERE is_default IS NOT NULL) AS imbalance_ratio
FROM raw_loans WHERE is_default IS NOT NULL GROUP BY is_default"""))
def d4_target_distribution(spark, sf):
    return D.target_distribution(raw(spark, sf))


def _iqr_sql(c: str) -> str:
    x = _dbl(c)
    return f"""
SELECT '{c}' AS column_name, mn AS min, mx AS max, ROUND(q1, 6) AS q1, ROUND(q3, 6) AS q3,
  ROUND(q3 + 1.5 * (q3 - q1), 6) AS iqr_upper, n_out AS n_outliers,
  ROUND_EVEN(n_out / n * 100, 2) AS outlier_pct
FROM (
  SELECT s.*, (SELECT COUNT(*) FROM raw_loans r
               WHERE CAST(r.{c} AS DOUBLE) < s.q1 - 1.5 * (s.q3 - s.q1)
                  OR CAST(r.{c} AS DOUBLE) > s.q3 + 1.5 * (s.q3 - s.q1)) AS n_out,
         (SELECT COUNT(*) FROM raw_loans) AS n
  FROM (SELECT MIN({x}) AS mn, MAX({x}) AS mx, QUANTILE_CONT({x}, 0.25) AS q1,
               QUANTILE_CONT({x}, 0.75) AS q3 FROM raw_loans) s)"""


@register("d5_iqr_outliers", O.with_layers("\nUNION ALL\n".join(
    _iqr_sql(c) for c in D.PROFILE_COLUMNS if c != "is_default")))
def d5_iqr_outliers(spark, sf):
    return D.iqr_outliers(raw(spark, sf))


@register("d6_age_sanity", O.with_layers(
    "SELECT MIN(age) AS age_min, MAX(age) AS age_max, "
    "COUNT(*) FILTER (WHERE age = 0) AS n_age_zero FROM raw_loans"))
def d6_age_sanity(spark, sf):
    return D.age_sanity(raw(spark, sf))


@register("d7_age_histogram", O.histogram_sql("raw_loans", "age", 40, where="age > 0"))
def d7_age_histogram(spark, sf):
    return D.age_histogram(raw(spark, sf))


def _cut_case(x: str, edges, labels) -> str:
    arms = " ".join(f"WHEN {x} > {lo} AND {x} <= {hi} THEN '{lab}'"
                    for lo, hi, lab in zip(edges[:-1], edges[1:], labels))
    return f"CASE {arms} END"


def _cut_order_case(x: str, edges) -> str:
    arms = " ".join(f"WHEN {x} > {lo} AND {x} <= {hi} THEN {i}"
                    for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])))
    return f"CASE {arms} END"


@register("d8_rate_by_age_group", O.with_layers(f"""
SELECT age_group, age_group_order, AVG(is_default) * 100 AS default_rate_pct FROM (
  SELECT {_cut_case('age', D.AGE_CUT_EDGES, D.AGE_CUT_LABELS)} AS age_group,
         {_cut_order_case('age', D.AGE_CUT_EDGES)} AS age_group_order, is_default
  FROM raw_loans WHERE age BETWEEN 18 AND 100)
WHERE age_group IS NOT NULL GROUP BY age_group, age_group_order ORDER BY age_group_order"""))
def d8_rate_by_age_group(spark, sf):
    return D.rate_by_age_group(raw(spark, sf))


@register("d9_income_sanity", O.with_layers("""
SELECT COUNT(*) FILTER (WHERE x > 30000) AS n_over_30000, COUNT(*) FILTER (WHERE x = 0) AS n_zero,
  COUNT(*) AS count, ROUND(AVG(x), 6) AS mean, ROUND(STDDEV_SAMP(x), 6) AS std, MIN(x) AS min,
  ROUND(QUANTILE_CONT(x, 0.25), 6) AS p25, ROUND(QUANTILE_CONT(x, 0.5), 6) AS p50,
  ROUND(QUANTILE_CONT(x, 0.75), 6) AS p75, MAX(x) AS max
FROM (SELECT CAST(monthly_income AS DOUBLE) AS x FROM raw_loans) WHERE x IS NOT NULL"""))
def d9_income_sanity(spark, sf):
    return D.income_sanity(raw(spark, sf))


@register("d10_income_histogram_clipped",
          O.histogram_sql("raw_loans", "monthly_income", 60, clip=20000))
def d10_income_histogram_clipped(spark, sf):
    return D.income_histogram_clipped(raw(spark, sf))


_INC_FILLED = "COALESCE(monthly_income, (SELECT MEDIAN(monthly_income) FROM raw_loans))"


@register("d11_rate_by_income_band", O.with_layers(f"""
SELECT income_band, income_band_order, AVG(is_default) * 100 AS default_rate_pct FROM (
  SELECT {_cut_case(_INC_FILLED, D.INCOME_CUT_EDGES, D.INCOME_CUT_LABELS)} AS income_band,
         {_cut_order_case(_INC_FILLED, D.INCOME_CUT_EDGES)} AS income_band_order, is_default
  FROM raw_loans)
WHERE income_band IS NOT NULL GROUP BY income_band, income_band_order
ORDER BY income_band_order"""))
def d11_rate_by_income_band(spark, sf):
    return D.rate_by_income_band(raw(spark, sf))


@register("d12_debt_histogram_clipped", O.histogram_sql("raw_loans", "debt_ratio", 60, clip=2))
def d12_debt_histogram_clipped(spark, sf):
    return D.debt_histogram_clipped(raw(spark, sf))


@register("d12_util_histogram_clipped",
          O.histogram_sql("raw_loans", "revolving_util", 60, clip=1))
def d12_util_histogram_clipped(spark, sf):
    return D.util_histogram_clipped(raw(spark, sf))


@register("d12_util_histogram_by_class", O.histogram_sql(
    "raw_loans", "revolving_util", 40, by=("is_default",), shared=False, clip=1))
def d12_util_histogram_by_class(spark, sf):
    return D.util_histogram_by_class(raw(spark, sf))


def _corr_sql() -> str:
    cols = D.CORRELATION_COLUMNS
    parts = []
    for i, a in enumerate(cols):
        for b in cols:
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, "
                         f"ROUND(CORR({_dbl(a)}, {_dbl(b)}), 6) AS corr FROM raw_loans")
    return "\nUNION ALL\n".join(parts)


@register("d13_correlation", O.with_layers(_corr_sql()))
def d13_correlation(spark, sf):
    return D.correlation(raw(spark, sf))


@register("d14_target_correlation", O.with_layers(
    "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, ROUND(CORR(CAST(is_default AS DOUBLE), {_dbl(c)}), 6) "
        f"AS corr FROM raw_loans" for c in D.CORRELATION_COLUMNS if c != "is_default")
    + "\nORDER BY corr DESC, column_name"))
def d14_target_correlation(spark, sf):
    return D.target_correlation(raw(spark, sf))


@register("d15_box_stats", O.with_layers("""
SELECT s.is_default, ROUND(q1, 6) AS q1, ROUND(med, 6) AS median, ROUND(q3, 6) AS q3,
  ROUND(LEAST(COALESCE(MIN(CASE WHEN x >= q1 - 1.5 * (q3 - q1) THEN x END), q1), q1), 6) AS whisker_low,
  ROUND(GREATEST(COALESCE(MAX(CASE WHEN x <= q3 + 1.5 * (q3 - q1) THEN x END), q3), q3), 6) AS whisker_high,
  COUNT(*) FILTER (WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS n_outliers
FROM (SELECT is_default, CAST(debt_ratio AS DOUBLE) AS x FROM raw_loans WHERE debt_ratio IS NOT NULL) s
JOIN (SELECT is_default, QUANTILE_CONT(CAST(debt_ratio AS DOUBLE), 0.25) AS q1,
             QUANTILE_CONT(CAST(debt_ratio AS DOUBLE), 0.5) AS med,
             QUANTILE_CONT(CAST(debt_ratio AS DOUBLE), 0.75) AS q3
      FROM raw_loans WHERE debt_ratio IS NOT NULL GROUP BY is_default) q
  ON s.is_default = q.is_default
GROUP BY s.is_default, q1, med, q3"""))
def d15_box_stats(spark, sf):
    return D.box_stats(raw(spark, sf))


@register("d16_value_counts", O.with_layers("\nUNION ALL\n".join(
    f"SELECT * FROM (SELECT '{c}' AS column_name, CAST({c} AS BIGINT) AS value, COUNT(*) AS count "
    f"FROM raw_loans WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY {c} LIMIT 10)"
    for c in D.LATE_COLUMNS)))
def d16_value_counts(spark, sf):
    return D.value_counts(raw(spark, sf))


@register("d17_rate_by_late_90", O.with_layers("""
SELECT late_90_plus, AVG(is_default) * 100 AS default_rate_pct FROM raw_loans
WHERE late_90_plus IS NOT NULL GROUP BY late_90_plus ORDER BY late_90_plus LIMIT 10"""))
def d17_rate_by_late_90(spark, sf):
    return D.rate_by_value(raw(spark, sf), "late_90_plus", 10)


_PIVOT_INC = ("COALESCE(monthly_income, (SELECT MEDIAN(monthly_income) FROM raw_loans "
              "WHERE age BETWEEN 18 AND 100))")


@register("d18_cut_pivot", O.with_layers(
    "SELECT age_group, " + ", ".join(
        f"AVG(CASE WHEN income_band = '{lab}' THEN is_default END) * 100 AS {name}"
        for lab, name in zip(D.PIVOT_INCOME_LABELS, D.PIVOT_INCOME_COLUMNS))
    + f" FROM (SELECT {_cut_case('age', D.PIVOT_AGE_EDGES, D.PIVOT_AGE_LABELS)} AS age_group, "
      f"{_cut_case(_PIVOT_INC, D.PIVOT_INCOME_EDGES, D.PIVOT_INCOME_LABELS)} AS income_band, "
      "is_default FROM raw_loans WHERE age BETWEEN 18 AND 100) WHERE age_group IS NOT NULL "
      "GROUP BY age_group"))
def d18_cut_pivot(spark, sf):
    return D.cut_pivot(raw(spark, sf))


@register("d19_class_counts", O.with_layers(
    "SELECT is_default, COUNT(*) AS count FROM raw_loans GROUP BY is_default"))
def d19_class_counts(spark, sf):
    return D.class_counts(raw(spark, sf))


# =============================================================================
# M. modelling and evaluation
# =============================================================================

from ..operators import applicants as AP  # noqa: E402
from ..operators import evaluate as EV  # noqa: E402
from ..operators import model as M  # noqa: E402
from .build import train_and_score  # noqa: E402

# ``split``: the deterministic stratified split of the model frame;
# ``test_scored``: its test rows with the rule score / 100 standing in for a PD.
SPLIT_SQL = """
split AS (
  SELECT r.*, CASE WHEN ROW_NUMBER() OVER (PARTITION BY is_default
                          ORDER BY (customer_id * 7919) % 1000003, customer_id)
                        <= FLOOR(COUNT(*) OVER (PARTITION BY is_default) * CAST(0.2 AS DOUBLE) + 0.5)
                   THEN 'test' ELSE 'train' END AS split
  FROM risk_segments r
),
test_scored AS (SELECT *, rule_risk_score / 100 AS score FROM split WHERE split = 'test'),
score_counts AS (
  SELECT score AS s, COUNT(*) FILTER (WHERE is_default = 1) AS pos,
         COUNT(*) FILTER (WHERE is_default <> 1) AS neg
  FROM test_scored GROUP BY score
)"""


def _split(spark, sf) -> DataFrame:
    frame, _ = M.model_frame(risk(spark, sf))
    # the split counts the frame before it marks the rows: keep it once
    return M.stratified_split(M.cached_frame(frame))


def _test_rule_scored(spark, sf, rows: DataFrame | None = None) -> DataFrame:
    """Test rows with ``score`` = rule score / 100 (no fitted model needed).
    ``rows`` may hold the kept risk table; key, label and score are kept once,
    as the split and the metrics read them several times."""
    if rows is None:
        rows = M.cached_frame(risk(spark, sf).select(M.KEY, M.LABEL, "rule_risk_score"))
    test = M.stratified_split(rows).filter(F.col("split") == "test")
    return M.cached_frame(test.select(M.KEY, M.LABEL, (F.col("rule_risk_score") / 100).alias("score")))


@register("m1_assemble", O.with_layers(
    "SELECT customer_id, [" + ", ".join(_dbl(c) for c in M.FEATURES)
    + "] AS features FROM risk_segments"))
def m1_assemble(spark, sf):
    from pyspark.ml.functions import vector_to_array
    v = M.assemble(M.select_features(risk(spark, sf)))
    return v.select("customer_id", vector_to_array("features").alias("features"))


_ALL_NOT_NULL = " AND ".join(f"{c} IS NOT NULL" for c in [*M.FEATURES, "is_default"])


@register("m2_model_frame", O.with_layers(
    f"SELECT COUNT(*) AS rows_before, COUNT(*) FILTER (WHERE {_ALL_NOT_NULL}) AS rows_after, "
    f"COUNT(*) - COUNT(*) FILTER (WHERE {_ALL_NOT_NULL}) AS rows_dropped FROM risk_segments"))
def m2_model_frame(spark, sf):
    return M.model_frame(risk(spark, sf))[1]


@register("m2_model_frame_app", O.with_layers(
    f"SELECT COUNT(*) AS rows_before, COUNT(*) FILTER (WHERE {_ALL_NOT_NULL}) AS rows_after, "
    f"COUNT(*) - COUNT(*) FILTER (WHERE {_ALL_NOT_NULL}) AS rows_dropped "
    "FROM risk_segments_app"))
def m2_model_frame_app(spark, sf):
    return M.model_frame(risk(spark, sf, app=True))[1]


@register("m3_stratified_split", O.with_layers(
    "SELECT split, COUNT(*) AS rows, CAST(SUM(is_default) AS BIGINT) AS defaults, "
    "AVG(is_default) * 100 AS default_rate_pct FROM split GROUP BY split", SPLIT_SQL))
def m3_stratified_split(spark, sf):
    return M.split_summary(_split(spark, sf))


@register("m3_split_assignment", O.with_layers(
    "SELECT customer_id, is_default, split FROM split", SPLIT_SQL))
def m3_split_assignment(spark, sf):
    return _split(spark, sf).select("customer_id", "is_default", "split")


@register("m4_scaler_stats", O.with_layers("\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, ROUND(AVG(CAST({c} AS DOUBLE)), 6) AS mean, "
    f"ROUND(STDDEV_POP(CAST({c} AS DOUBLE)), 6) AS std FROM split WHERE split = 'train'"
    for c in M.FEATURES), SPLIT_SQL))
def m4_scaler_stats(spark, sf):
    train = _split(spark, sf).filter(F.col("split") == "train")
    return M.scaler_stats(train).select("feature", sql_round(F.col("mean"), 6).alias("mean"),
                                        sql_round(F.col("std"), 6).alias("std"))


_AUC_SQL = """
SELECT auc, auc * 2 - 1 AS gini FROM (
  SELECT CASE WHEN 2.0 * CAST(SUM(pos) AS DOUBLE) * CAST(SUM(neg) AS DOUBLE) = 0 THEN NULL
         ELSE CAST(SUM(CAST(pos AS HUGEINT) * (2 * nb + neg)) AS DOUBLE)
              / (2.0 * CAST(SUM(pos) AS DOUBLE) * CAST(SUM(neg) AS DOUBLE)) END AS auc
  FROM (SELECT *, COALESCE(SUM(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING
                                                   AND 1 PRECEDING), 0) AS nb
        FROM score_counts))"""


@register("m5_auc_rule_score", O.with_layers(_AUC_SQL, SPLIT_SQL))
def m5_auc_rule_score(spark, sf):
    return EV.auc(_test_rule_scored(spark, sf), "is_default", "score")


_ROC_SQL = """
SELECT s AS threshold, fps, tps, CASE WHEN nt = 0 THEN NULL ELSE fps / nt END AS fpr,
       CASE WHEN pt = 0 THEN NULL ELSE tps / pt END AS tpr
FROM (
  SELECT *, LAG(fps) OVER (ORDER BY r) AS fp_p, LEAD(fps) OVER (ORDER BY r) AS fp_n,
         LAG(tps) OVER (ORDER BY r) AS tp_p, LEAD(tps) OVER (ORDER BY r) AS tp_n,
         MAX(r) OVER () AS rr, CAST(MAX(fps) OVER () AS DOUBLE) AS nt,
         CAST(MAX(tps) OVER () AS DOUBLE) AS pt
  FROM (SELECT s, CAST(SUM(pos) OVER w AS BIGINT) AS tps, CAST(SUM(neg) OVER w AS BIGINT) AS fps,
               ROW_NUMBER() OVER (ORDER BY s DESC) AS r
        FROM score_counts WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING)))
WHERE r = 1 OR r = rr OR fp_p - 2 * fps + fp_n <> 0 OR tp_p - 2 * tps + tp_n <> 0
UNION ALL
SELECT 'inf'::DOUBLE, 0, 0, CASE WHEN (SELECT SUM(neg) FROM score_counts) = 0 THEN NULL ELSE 0.0 END,
       CASE WHEN (SELECT SUM(pos) FROM score_counts) = 0 THEN NULL ELSE 0.0 END"""


@register("m7_roc_curve_rule_score", O.with_layers(_ROC_SQL, SPLIT_SQL))
def m7_roc_curve_rule_score(spark, sf):
    return EV.roc_curve(_test_rule_scored(spark, sf), "is_default", "score")


@register("m7_roc_reduced_rule_score", O.with_layers("""
SELECT CAST('Infinity' AS DOUBLE) AS threshold, 0::BIGINT AS fps, 0::BIGINT AS tps,
  CASE WHEN n = 0 THEN NULL ELSE 0.0::DOUBLE END AS fpr, CASE WHEN p = 0 THEN NULL ELSE 0.0::DOUBLE END AS tpr
FROM (SELECT coalesce(SUM(pos), 0) AS p, coalesce(SUM(neg), 0) AS n FROM score_counts)
UNION ALL
SELECT s, fps, tps, CASE WHEN n = 0 THEN NULL ELSE fps::DOUBLE / n END, CASE WHEN p = 0 THEN NULL ELSE tps::DOUBLE / p END
FROM (SELECT s, pos, neg, SUM(pos) OVER (ORDER BY s DESC)::BIGINT AS tps, SUM(neg) OVER (ORDER BY s DESC)::BIGINT AS fps,
             SUM(pos) OVER ()::BIGINT AS p, SUM(neg) OVER ()::BIGINT AS n, MIN(s) OVER () AS last FROM score_counts)
WHERE tps * 20 // greatest(p, 1) > (tps - pos) * 20 // greatest(p, 1)
   OR fps * 20 // greatest(n, 1) > (fps - neg) * 20 // greatest(n, 1) OR s = last""", SPLIT_SQL))
def m7_roc_reduced_rule_score(spark, sf):
    """At most 42 points, each axis to within a twentieth."""
    return EV.roc_curve_reduced(_test_rule_scored(spark, sf), "is_default", "score", cells=20)


#: The coefficients at which the gradient query is taken: intercept, features.
_AT = (-0.1, 0.05)
_FRAME = ", ".join(f"({c} - m{i}) / d{i} AS z{i}" for i, c in enumerate(M.FEATURES))


@register("m12_gradient", O.with_layers(f"""
SELECT u.term, ROUND(u.gradient, 4) AS gradient FROM (
  SELECT unnest([{", ".join(["'intercept'", *[f"'{c}'" for c in M.FEATURES]])}]) AS term,
         unnest([SUM(s * (p - y)), {", ".join(f"SUM(s * (p - y) * z{i}) + {_AT[1]}" for i in range(len(M.FEATURES)))}]) AS gradient
  FROM (SELECT *, 1 / (1 + exp(-({_AT[0]} + {_AT[1]} * ({" + ".join(f"z{i}" for i in range(len(M.FEATURES)))})))) AS p,
               CASE WHEN y = 1 THEN n / (2.0 * pos) ELSE n / (2.0 * (n - pos)) END AS s
        FROM (SELECT CAST(is_default AS DOUBLE) AS y, {_FRAME}, n, pos FROM train, moments))) u""", SPLIT_SQL + f""",
train AS (SELECT * FROM split WHERE split = 'train'),
moments AS (SELECT COUNT(*)::DOUBLE AS n, (COUNT(*) FILTER (WHERE is_default = 1))::DOUBLE AS pos,
  {", ".join(f"AVG(CAST({c} AS DOUBLE)) AS m{i}, CASE WHEN STDDEV_POP(CAST({c} AS DOUBLE)) > 0 THEN STDDEV_POP(CAST({c} AS DOUBLE)) ELSE 1.0 END AS d{i}"
             for i, c in enumerate(M.FEATURES))} FROM train)"""))
def m12_gradient(spark, sf):
    """The gradient of the logistic regression's objective at fixed coefficients."""
    from ..operators.newton import logistic_gradient
    train = M.cached_frame(_split(spark, sf)).filter(F.col("split") == "train")
    beta = [_AT[0]] + [_AT[1]] * len(M.FEATURES)
    return logistic_gradient(train, beta).select("term", sql_round(F.col("gradient"), 4).alias("gradient"))


@register("m8_confusion_rule_score", O.with_layers("""
SELECT a.actual, p.predicted, COUNT(t.is_default) AS count
FROM (VALUES (0), (1)) a(actual) CROSS JOIN (VALUES (0), (1)) p(predicted)
LEFT JOIN test_scored t ON t.is_default = a.actual
  AND (CASE WHEN t.score >= 0.5 THEN 1 ELSE 0 END) = p.predicted
GROUP BY a.actual, p.predicted""", SPLIT_SQL))
def m8_confusion_rule_score(spark, sf):
    return EV.confusion(_test_rule_scored(spark, sf), "is_default", "score", 0.5, True)


_REPORT_SQL = """
c AS (SELECT COUNT(*) FILTER (WHERE is_default = 1 AND score > 0.5)::DOUBLE AS tp,
             COUNT(*) FILTER (WHERE is_default = 0 AND score > 0.5)::DOUBLE AS fp,
             COUNT(*) FILTER (WHERE is_default = 1 AND score <= 0.5)::DOUBLE AS fn,
             COUNT(*) FILTER (WHERE is_default = 0 AND score <= 0.5)::DOUBLE AS tn
      FROM test_scored),
pr AS (SELECT *,
  CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS p1,
  CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS r1,
  CASE WHEN tn + fn = 0 THEN 0.0 ELSE tn / (tn + fn) END AS p0,
  CASE WHEN tn + fp = 0 THEN 0.0 ELSE tn / (tn + fp) END AS r0,
  tp + fn AS s1, tn + fp AS s0 FROM c),
f AS (SELECT *, CASE WHEN p1 + r1 = 0 THEN 0.0 ELSE 2 * p1 * r1 / (p1 + r1) END AS f1,
                CASE WHEN p0 + r0 = 0 THEN 0.0 ELSE 2 * p0 * r0 / (p0 + r0) END AS f0,
                s0 + s1 AS n FROM pr)"""


@register("m9_classification_report_rule_score", O.with_layers("""
SELECT '0' AS label, ROUND(p0, 6) AS precision, ROUND(r0, 6) AS recall, ROUND(f0, 6) AS f1_score,
       CAST(s0 AS BIGINT) AS support FROM f
UNION ALL SELECT '1', ROUND(p1, 6), ROUND(r1, 6), ROUND(f1, 6), CAST(s1 AS BIGINT) FROM f
UNION ALL SELECT 'accuracy', NULL, NULL,
       ROUND(CASE WHEN n = 0 THEN 0.0 ELSE (tp + tn) / n END, 6), CAST(n AS BIGINT) FROM f
UNION ALL SELECT 'macro avg', ROUND((p0 + p1) / 2, 6), ROUND((r0 + r1) / 2, 6),
       ROUND((f0 + f1) / 2, 6), CAST(n AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg',
       ROUND(CASE WHEN n = 0 THEN 0.0 ELSE (p0 * s0 + p1 * s1) / n END, 6),
       ROUND(CASE WHEN n = 0 THEN 0.0 ELSE (r0 * s0 + r1 * s1) / n END, 6),
       ROUND(CASE WHEN n = 0 THEN 0.0 ELSE (f0 * s0 + f1 * s1) / n END, 6),
       CAST(n AS BIGINT) FROM f""", SPLIT_SQL, _REPORT_SQL))
def m9_classification_report_rule_score(spark, sf):
    return EV.classification_report(_test_rule_scored(spark, sf), "is_default", "score",
                                    0.5, inclusive=False)


_ML_SEG_SQL = ("CASE WHEN {s} > 0 AND {s} <= 0.1 THEN 'Low Risk' "
               "WHEN {s} > 0.1 AND {s} <= 0.3 THEN 'Medium Risk' "
               "WHEN {s} > 0.3 AND {s} <= 1.0 THEN 'High Risk' END")


@register("m10_ml_segment_rule_score", O.with_layers(
    "SELECT customer_id, rule_risk_score / 100 AS pd_score, "
    + _ML_SEG_SQL.format(s="rule_risk_score / 100") + " AS ml_risk_segment FROM risk_segments"))
def m10_ml_segment_rule_score(spark, sf):
    from ..functions.exprs import ml_segment
    pd_ = F.col("rule_risk_score") / 100
    return risk(spark, sf).select("customer_id", pd_.alias("pd_score"),
                                  ml_segment(pd_).alias("ml_risk_segment"))


@register("m11_ml_segment_summary_rule_score", O.with_layers(
    "SELECT ml_risk_segment, COUNT(*) AS customers, "
    "ROUND(AVG(is_default) * 100, 2) AS actual_default_rate_pct FROM ("
    "SELECT is_default, " + _ML_SEG_SQL.format(s="score") + " AS ml_risk_segment "
    "FROM test_scored) GROUP BY ml_risk_segment "
    "ORDER BY actual_default_rate_pct DESC, ml_risk_segment", SPLIT_SQL))
def m11_ml_segment_summary_rule_score(spark, sf):
    from ..functions.exprs import ml_segment
    t = _test_rule_scored(spark, sf).withColumn("ml_risk_segment", ml_segment("score"))
    return EV.ml_segment_summary(t)


_TWO_MODELS_SQL = f"""
m AS (SELECT 'Logistic Regression' AS model, auc, gini FROM ({_AUC_SQL}) a
      UNION ALL
      SELECT 'Gradient Boosted Trees', 1 - auc, 2 * (1 - auc) - 1 FROM ({_AUC_SQL}) b)"""


def _rule_metrics(spark, sf, rows: DataFrame | None = None) -> DataFrame:
    """AUC and Gini of the rule score, and of its complement as a second model."""
    one = EV.auc(_test_rule_scored(spark, sf, rows), "is_default", "score").select("auc")
    a = F.col("auc")
    return one.select(F.inline(F.array(
        F.struct(F.lit("Logistic Regression").alias("model"), a.alias("auc"), (a * 2 - 1).alias("gini")),
        F.struct(F.lit("Gradient Boosted Trees").alias("model"), (1 - a).alias("auc"),
                 ((1 - a) * 2 - 1).alias("gini")))))


@register("m17_score_histogram_rule_score", O.histogram_sql(
    "risk_segments", "rule_risk_score / 100", 60, by=("is_default",), shared=True))
def m17_score_histogram_rule_score(spark, sf):
    return EV.score_histogram(_rule_pd(spark, sf), "pd")


@register("m18_model_comparison_rule_score", O.with_layers("""
SELECT model, auc, gini, CASE WHEN gini > 0.8 THEN 'Excellent' WHEN gini > 0.7 THEN 'Strong'
       WHEN gini > 0.6 THEN 'Good' ELSE 'Below good' END AS assessment FROM m
UNION ALL SELECT * FROM (VALUES
""" + ", ".join(f"('{n}', {a}::DOUBLE, {g}::DOUBLE, '{t}')" for n, a, g, t in EV.INDUSTRY_BANDS) + ") v",
    SPLIT_SQL, _TWO_MODELS_SQL))
def m18_model_comparison_rule_score(spark, sf):
    return EV.model_comparison(_rule_metrics(spark, sf))


@register("m19_training_summary_rule_score", O.with_layers("""
SELECT (SELECT COUNT(*) FROM risk_segments) AS dataset_rows,
       (SELECT COUNT(*) FROM split WHERE split = 'train') AS train_rows,
       (SELECT COUNT(*) FROM split WHERE split = 'test') AS test_rows, 16 AS n_features,
       MAX(auc) FILTER (WHERE model = 'Logistic Regression') AS lr_auc,
       MAX(gini) FILTER (WHERE model = 'Logistic Regression') AS lr_gini,
       MAX(auc) FILTER (WHERE model = 'Gradient Boosted Trees') AS gbt_auc,
       MAX(gini) FILTER (WHERE model = 'Gradient Boosted Trees') AS gbt_gini
FROM m""", SPLIT_SQL, _TWO_MODELS_SQL))
def m19_training_summary_rule_score(spark, sf):
    # the report, both splits and the metrics read one kept table
    rows = M.cached_frame(risk(spark, sf).select(M.KEY, *M.FEATURES, M.LABEL, "rule_risk_score"))
    frame, report = M.model_frame(rows)
    return EV.training_summary(report, M.split_summary(M.stratified_split(frame)),
                               _rule_metrics(spark, sf, rows), len(M.FEATURES))


@register("m14_class_weights", O.with_layers("""
SELECT is_default, COUNT(*) AS count,
  (SELECT COUNT(*) FROM split WHERE split = 'train') / (2.0 * COUNT(*)) AS balanced_weight,
  (SELECT CASE WHEN COUNT(*) FILTER (WHERE is_default = 1) = 0 THEN NULL
          ELSE COUNT(*) FILTER (WHERE is_default = 0) / COUNT(*) FILTER (WHERE is_default = 1) END
   FROM split WHERE split = 'train') AS scale_pos_weight
FROM split WHERE split = 'train' GROUP BY is_default""", SPLIT_SQL))
def m14_class_weights(spark, sf):
    return M.class_weights(_split(spark, sf).filter(F.col("split") == "train"))


# -- fitted models (rows-only checks) ---------------------------------------------

_FIT_CACHE: dict[tuple, dict] = {}


def fitted(spark: SparkSession, sf: str, trees: int = M.GBT_TREES) -> dict:
    """Fit both models once per (session, data, tree count) and reuse them
    for every model query of that session."""
    # the application's id: ids of Python objects are used again
    key = (spark.sparkContext.applicationId, sf, trees)
    if key in _FIT_CACHE:
        return _FIT_CACHE[key]
    out = train_and_score(risk(spark, sf), trees=trees)
    scores = out["scores"]
    metrics = (EV.auc(scores, "is_default", "pd_score_lr")
               .select(F.lit("Logistic Regression").alias("model"), "auc", "gini")
               .unionByName(EV.auc(scores, "is_default", "pd_score_xgb")
                            .select(F.lit("Gradient Boosted Trees").alias("model"), "auc",
                                    "gini")))
    out["metrics"] = metrics
    _FIT_CACHE[key] = out
    on_release(lambda: _FIT_CACHE.pop(key, None))
    return out


@register("m12_fit_lr")
def m12_fit_lr(spark, sf):
    return M.lr_coefficients(fitted(spark, sf)["lr"])


@register("m13_fit_gbt")
def m13_fit_gbt(spark, sf):
    return M.boosted_trees(fitted(spark, sf)["gbt"])


@register("m15_feature_importance")
def m15_feature_importance(spark, sf):
    return M.feature_importance(fitted(spark, sf)["gbt"])


@register("m15_feature_importance_top5")
def m15_feature_importance_top5(spark, sf):
    return M.feature_importance(fitted(spark, sf)["gbt"], k=5)


@register("m16_score_table")
def m16_score_table(spark, sf):
    return fitted(spark, sf)["scores"]


@register("m17_score_histogram")
def m17_score_histogram(spark, sf):
    return EV.score_histogram(fitted(spark, sf)["scores"])


@register("m18_model_comparison")
def m18_model_comparison(spark, sf):
    return EV.model_comparison(fitted(spark, sf)["metrics"])


@register("m19_training_summary")
def m19_training_summary(spark, sf):
    f = fitted(spark, sf)
    return EV.training_summary(f["report"], M.split_summary(f["split"]), f["metrics"],
                               len(M.FEATURES))


@register("m11_ml_segment_summary")
def m11_ml_segment_summary(spark, sf):
    return EV.ml_segment_summary(fitted(spark, sf)["scores"])


@register("m8_confusion_gbt")
def m8_confusion_gbt(spark, sf):
    return EV.confusion(fitted(spark, sf)["scores"], "is_default", "pd_score_xgb", 0.5, True)


@register("m9_classification_report_lr")
def m9_classification_report_lr(spark, sf):
    return EV.classification_report(fitted(spark, sf)["scores"], "is_default", "pd_score_lr")


@register("m8_confusion_lr")
def m8_confusion_lr(spark, sf):
    return EV.confusion(fitted(spark, sf)["scores"], "is_default", "pd_score_lr", 0.5, True)


@register("m9_classification_report_gbt")
def m9_classification_report_gbt(spark, sf):
    return EV.classification_report(fitted(spark, sf)["scores"], "is_default", "pd_score_xgb")


@register("m7_roc_curve_lr")
def m7_roc_curve_lr(spark, sf):
    return EV.roc_curve(fitted(spark, sf)["scores"], "is_default", "pd_score_lr")


@register("m7_roc_curve_gbt")
def m7_roc_curve_gbt(spark, sf):
    return EV.roc_curve(fitted(spark, sf)["scores"], "is_default", "pd_score_xgb")


# =============================================================================
# L. bulk applicant scoring
# =============================================================================

def _applicants(spark, sf) -> DataFrame:
    """Every applicant, cleaned and with the derived inputs."""
    return AP.applicant_features(AP.clean_applicants(raw(spark, sf)))


@register("l1_applicant_features", O.with_layers(
    "SELECT customer_id, total_late_payments, ever_seriously_delinquent, high_util_flag, "
    "high_debt_flag, income_per_dependent, estimated_monthly_debt FROM applicants"))
def l1_applicant_features(spark, sf):
    return _applicants(spark, sf).select("customer_id", *AP.DERIVED)


@register("l2_score_applicants")
def l2_score_applicants(spark, sf):
    f = fitted(spark, sf)
    scored = AP.assess(AP.score_applicants(_applicants(spark, sf), f["lr"], f["gbt"]))
    return scored.select("customer_id", "pd_score_lr", "pd_score_xgb", "pd_segment",
                         "vs_portfolio", "gap_pct_points", "risk_flags",
                         "exposure_at_default", "expected_loss", "reject_reason")


@register("l2_scorable_and_rejected", O.with_layers(
    "SELECT CASE WHEN age IS NULL THEN 'missing age' END AS reject_reason, COUNT(*) AS applicants "
    "FROM applicants GROUP BY reject_reason"))
def l2_scorable_and_rejected(spark, sf):
    return (_applicants(spark, sf).groupBy(AP.reject_reason().alias("reject_reason"))
            .agg(F.count(F.lit(1)).alias("applicants")))


@register("l7_score_breakdown")
def l7_score_breakdown(spark, sf):
    f = fitted(spark, sf)
    return AP.score_breakdown(AP.score_applicants(_applicants(spark, sf), f["lr"], f["gbt"]))


_PD = "(rule_risk_score / 100)"


def _rule_pd(spark, sf) -> DataFrame:
    return risk(spark, sf).withColumn("pd", F.col("rule_risk_score") / 100)


@register("l7_score_breakdown_rule_score", O.with_layers(f"""
SELECT customer_id, model, pd_score,
       CASE WHEN pd_score > CAST(0.067 AS DOUBLE) THEN 'above' ELSE 'below' END AS vs_portfolio,
       ABS(pd_score - CAST(0.067 AS DOUBLE)) * 100 AS gap_pct_points
FROM (SELECT customer_id, 'Gradient Boosted Trees' AS model, {_PD} AS pd_score FROM risk_segments
      UNION ALL SELECT customer_id, 'Logistic Regression', 1 - {_PD} FROM risk_segments)"""))
def l7_score_breakdown_rule_score(spark, sf):
    scored = _rule_pd(spark, sf).select("customer_id", F.col("pd").alias("pd_score_xgb"),
                                        (1 - F.col("pd")).alias("pd_score_lr"))
    return AP.score_breakdown(scored)


@register("l3_pd_segment", O.with_layers(
    f"SELECT customer_id, {_PD} AS pd, CASE WHEN {_PD} >= 0.3 THEN 'High Risk' "
    f"WHEN {_PD} >= 0.1 THEN 'Medium Risk' ELSE 'Low Risk' END AS pd_segment "
    "FROM risk_segments"))
def l3_pd_segment(spark, sf):
    from ..functions.exprs import pd_segment
    return _rule_pd(spark, sf).select("customer_id", "pd", pd_segment("pd").alias("pd_segment"))


@register("l4_vs_portfolio", O.with_layers(
    f"SELECT customer_id, {_PD} AS pd, CASE WHEN {_PD} > CAST(0.067 AS DOUBLE) THEN 'above' "
    f"ELSE 'below' END AS vs_portfolio, ABS({_PD} - CAST(0.067 AS DOUBLE)) * 100 "
    "AS gap_pct_points FROM risk_segments"))
def l4_vs_portfolio(spark, sf):
    direction, gap = AP.vs_portfolio("pd")
    return _rule_pd(spark, sf).select("customer_id", "pd", direction.alias("vs_portfolio"),
                                      gap.alias("gap_pct_points"))


_FLAG_RULES = ["late_90_plus >= 1", "revolving_util > 0.8", "debt_ratio > 0.5",
               "late_30_59 >= 2", "monthly_income < 2000", "age < 25"]
_FLAGS_SQL = "\nUNION ALL\n".join(
    [f"SELECT customer_id, '{t}' AS flag FROM applicants WHERE {r}"
     for r, t in zip(_FLAG_RULES, AP.FLAG_TEXTS)]
    + ["SELECT customer_id, 'No significant risk flags detected' AS flag FROM applicants "
       "WHERE NOT (" + " OR ".join(f"COALESCE({r}, FALSE)" for r in _FLAG_RULES) + ")"])


@register("l5_risk_flags", O.with_layers(_FLAGS_SQL))
def l5_risk_flags(spark, sf):
    return _applicants(spark, sf).select("customer_id", F.explode(AP.risk_flags()).alias("flag"))


@register("l5_risk_flag_counts", O.with_layers(
    f"SELECT flag, COUNT(*) AS applicants FROM ({_FLAGS_SQL}) GROUP BY flag"))
def l5_risk_flag_counts(spark, sf):
    return AP.flag_counts(_applicants(spark, sf))


@register("l6_expected_loss", O.with_layers(
    f"SELECT customer_id, {_PD} AS pd, monthly_income * 12 AS exposure_at_default, "
    f"{_PD} * CAST(0.45 AS DOUBLE) * (monthly_income * 12) AS expected_loss FROM risk_segments"))
def l6_expected_loss(spark, sf):
    ead, el = AP.expected_loss("pd")
    return _rule_pd(spark, sf).select("customer_id", "pd", ead.alias("exposure_at_default"),
                                      el.alias("expected_loss"))


@register("l6_expected_loss_by_segment", O.with_layers(
    f"SELECT pd_segment, COUNT(*) AS applicants, ROUND(SUM(monthly_income * 12), 2) "
    f"AS total_exposure, ROUND(SUM({_PD} * CAST(0.45 AS DOUBLE) * (monthly_income * 12)), 2) "
    f"AS total_expected_loss FROM (SELECT *, CASE WHEN {_PD} >= 0.3 THEN 'High Risk' "
    f"WHEN {_PD} >= 0.1 THEN 'Medium Risk' ELSE 'Low Risk' END AS pd_segment "
    "FROM risk_segments) GROUP BY pd_segment"))
def l6_expected_loss_by_segment(spark, sf):
    from ..functions.exprs import pd_segment
    df = _rule_pd(spark, sf).withColumn("pd_segment", pd_segment("pd"))
    return AP.expected_loss_by_segment(df, pd_col="pd")
