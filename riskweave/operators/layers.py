"""The three row-level layers: clean -> features -> rule segments.

Each layer is one projection (plus a filter) over its input, so Catalyst
collapses the chain into a single scan-filter-project stage; the age filter
of ``clean_loans`` reaches the Parquet reader when the input is a plain scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import age_band, flag, income_band, sql_round
from .prefix import global_row_number

# Caps of the cleaning layer and the imputation constants.
CAPS = {
    "debt_ratio": 5.0,
    "open_credit_lines": 50,
    "real_estate_loans": 10,
    "late_30_59": 15,
    "late_60_89": 15,
    "late_90_plus": 15,
}
INCOME_FILL = 3500.0
DEPENDENTS_FILL = 0.0
AGE_VALID = (18, 100)

CLEAN_COLUMNS = [
    "customer_id", "is_default", "age", "monthly_income", "num_dependents",
    "revolving_util", "debt_ratio", "open_credit_lines", "real_estate_loans",
    "late_30_59", "late_60_89", "late_90_plus",
]


# -- C1..C5: single-column rules --------------------------------------------------

def drop_invalid_age(df: DataFrame) -> DataFrame:
    """Keep ``age > 0 AND age IS NOT NULL``."""
    return df.filter((F.col("age") > 0) & F.col("age").isNotNull())


def null_out_of_range_age(c: Column | str = "age") -> Column:
    """Ages outside [18, 100] become NULL; the row stays."""
    c = F.col(c) if isinstance(c, str) else c
    lo, hi = AGE_VALID
    return F.when((c < lo) | (c > hi), F.lit(None)).otherwise(c)


def impute_income(c: Column | str = "monthly_income") -> Column:
    """NULL income -> 3500."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(INCOME_FILL))


def impute_dependents(c: Column | str = "num_dependents") -> Column:
    """C4: NULL dependents -> 0."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(DEPENDENTS_FILL))


def cap(column: str, upper, lower=None) -> Column:
    """``LEAST``/``GREATEST`` caps. Both skip NULL, so a NULL input comes
    out as the bound itself (NULL debt ratio -> 5.0)."""
    c = F.col(column)
    if lower is not None:
        c = F.greatest(c, F.lit(lower))
    return F.least(c, F.lit(upper))


def require_age(df: DataFrame) -> DataFrame:
    """Drop rows whose age was nulled by C2 (dbt variant)."""
    return df.filter(F.col("age").isNotNull())


def clean_loans(raw: DataFrame) -> DataFrame:
    """The cleaning layer as one filter + one projection."""
    return drop_invalid_age(raw).select("customer_id", "is_default", *clean_columns())


def clean_columns() -> list[Column]:
    """C2-C5 as columns (the applicant scorer reuses them without C1)."""
    return [
        null_out_of_range_age("age").alias("age"),
        impute_income().alias("monthly_income"),
        impute_dependents().alias("num_dependents"),
        cap("revolving_util", 1.0, lower=0.0).alias("revolving_util"),
        *[cap(name, upper).alias(name) for name, upper in CAPS.items()],
    ]


# -- E1..E10: engineered features -------------------------------------------------

def engineered_columns() -> dict[str, Column]:
    """E1-E8 as named columns (the applicant scorer reuses E3-E8)."""
    income, deps = F.col("monthly_income"), F.col("num_dependents")
    return {
        "age_band": age_band("age"),
        "income_band": income_band("monthly_income"),
        "total_late_payments": F.col("late_30_59") + F.col("late_60_89") + F.col("late_90_plus"),
        "ever_seriously_delinquent": flag(F.col("late_90_plus") >= 1),
        "high_util_flag": flag(F.col("revolving_util") > 0.8),
        "high_debt_flag": flag(F.col("debt_ratio") > 0.5),
        # the branch guards the division: ANSI mode raises on x / 0
        "income_per_dependent": F.when(deps == 0, income)
        .otherwise(sql_round(income / deps, 2)),
        "estimated_monthly_debt": sql_round(income * F.col("debt_ratio"), 2),
    }


def feature_engineering(clean: DataFrame, keep_null_age: bool = False,
                        with_row_num: bool = True) -> DataFrame:
    """E10. ``keep_null_age=True`` is the app variant (null-age rows are kept
    and land in '65+'); the default is the dbt variant.

    ``row_num`` (E9) is a global order over ``customer_id``; it is computed
    by the bucketed rank helper, never by a window over one partition.
    Aggregations downstream do not need it, so they pass
    ``with_row_num=False`` and skip that shuffle entirely.
    """
    df = clean if keep_null_age else require_age(clean)
    df = df.withColumns(engineered_columns())
    if with_row_num:
        df = global_row_number(df, "customer_id", "row_num")
    return df


# -- R1..R3: rule score and segment -----------------------------------------------

def rule_risk_score() -> Column:
    """Late payments, utilisation, debt, age and income points."""
    late = (F.least(F.col("late_90_plus"), F.lit(5)) * 6
            + F.least(F.col("late_60_89"), F.lit(5)) * 3
            + F.least(F.col("late_30_59"), F.lit(5)) * 1)
    util, debt, age, inc = (F.col("revolving_util"), F.col("debt_ratio"),
                            F.col("age"), F.col("monthly_income"))
    util_pts = F.when(util > 0.9, 20).when(util > 0.7, 12).when(util > 0.5, 6).otherwise(0)
    debt_pts = F.when(debt > 1.0, 15).when(debt > 0.5, 8).when(debt > 0.3, 3).otherwise(0)
    age_pts = F.when(age < 25, 10).when(age < 35, 5).when(age > 60, -5).otherwise(0)
    inc_pts = F.when(inc < 2000, 5).when(inc < 4000, 2).otherwise(0)
    # integer points: ROUND(.., 1) of the reference is the identity here
    return (late + util_pts + debt_pts + age_pts + inc_pts).cast("double")


def risk_segment() -> Column:
    """R2: first matching rule wins."""
    l90, l30 = F.col("late_90_plus"), F.col("late_30_59")
    util, debt = F.col("revolving_util"), F.col("debt_ratio")
    return (F.when((l90 >= 1) | (util > 0.9), "High Risk")
            .when((l30 >= 2) | (debt > 0.7), "Medium Risk")
            .when((l30 >= 1) | (util > 0.6), "Medium Risk")
            .otherwise("Low Risk"))


def risk_segments(features: DataFrame) -> DataFrame:
    """The rule layer as one projection."""
    return features.withColumns({"rule_risk_score": rule_risk_score(),
                                 "risk_segment": risk_segment()})
