"""Bulk applicant scoring (L1-L7), re-aimed from the one-customer form.

Every step is a row-local projection over the applicant table, so a batch of
any size is one map-only stage (plus the model transforms, also row-local),
and the same code runs on a streaming DataFrame.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import (LOSS_GIVEN_DEFAULT, NO_FLAG_TEXT, PORTFOLIO_BASE_RATE,
                               pd_segment, sql_round)
from .layers import clean_columns, engineered_columns
from .model import FEATURES, positive_probability

# The risk flags of the applicant page (text without the
# display icons), each with its rule.
FLAG_TEXTS = [
    "Has 90+ day late payments",
    "High revolving utilization (>80%)",
    "High debt ratio (>0.5)",
    "Multiple 30-59 day late payments",
    "Low monthly income (<$2,000)",
    "Young borrower (higher risk group)",
]
APPLICANT_INPUTS = [
    "age", "monthly_income", "num_dependents", "revolving_util", "debt_ratio",
    "open_credit_lines", "real_estate_loans", "late_30_59", "late_60_89", "late_90_plus",
]
DERIVED = ["total_late_payments", "ever_seriously_delinquent", "high_util_flag",
           "high_debt_flag", "income_per_dependent", "estimated_monthly_debt"]


def clean_applicants(raw: DataFrame, key: str = "customer_id") -> DataFrame:
    """The cleaning rules C2-C5 for every applicant: an invalid age becomes
    NULL, and the row stays, to be rejected with a reason when scored."""
    return raw.select(key, *clean_columns())


def reject_reason() -> Column:
    """Why a row cannot be scored: the form inputs without a usable number
    (NULL or NaN); NULL for a row that can be."""
    missing = F.array_compact(F.array(*[
        F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), F.lit(c))
        for c in APPLICANT_INPUTS]))
    return F.when(F.size(missing) > 0, F.concat(F.lit("missing "), F.concat_ws(", ", missing)))


def applicant_features(df: DataFrame) -> DataFrame:
    """L1: the six engineered model inputs (E3-E8, same rules and rounding
    as the feature layer)."""
    cols = engineered_columns()
    return df.withColumns({name: cols[name] for name in DERIVED})


def score_applicants(df: DataFrame, lr_model: PipelineModel,
                     gbt_model: PipelineModel) -> DataFrame:
    """L2: PD from both models; the model's helper columns are dropped.

    Every applicant comes back: a row that lacks an input has NULL scores and
    its ``reject_reason``. The models see zeros in place of its features, so
    one incomplete row does not fail a batch or a stream.
    """
    reason = F.col("reject_reason")
    given = df.withColumn("reject_reason", reject_reason()) \
        .withColumn("_rw_given", F.struct(*FEATURES))
    filled = given.withColumns({
        c: F.when(reason.isNull(), F.col(c)).otherwise(F.lit(0)) for c in FEATURES})
    scored = gbt_model.transform(lr_model.transform(filled))
    return scored.select(
        *[F.col("_rw_given")[c].alias(c) if c in FEATURES else F.col(c)
          for c in df.columns if c != "reject_reason"], "reject_reason",
        *[F.when(reason.isNull(), positive_probability(f"{m}_probability")).alias(out)
          for m, out in (("lr", "pd_score_lr"), ("gbt", "pd_score_xgb"))])


def vs_portfolio(pd_col: Column | str, base: float = PORTFOLIO_BASE_RATE) -> tuple[Column, Column]:
    """L4: direction against the portfolio average and the absolute gap in
    percentage points."""
    p = F.col(pd_col) if isinstance(pd_col, str) else pd_col
    direction = F.when(p > base, "above").when(p <= base, "below")
    return direction, F.abs(p - F.lit(base)) * 100


def risk_flags() -> Column:
    """The applicable flags as an array; none -> the single 'no flag' text."""
    rules = [
        F.col("late_90_plus") >= 1,
        F.col("revolving_util") > 0.8,
        F.col("debt_ratio") > 0.5,
        F.col("late_30_59") >= 2,
        F.col("monthly_income") < 2000,
        F.col("age") < 25,
    ]
    arr = F.filter(F.array(*[F.when(r, F.lit(t)) for r, t in zip(rules, FLAG_TEXTS)]),
                   lambda x: x.isNotNull())
    return F.when(F.size(arr) == 0, F.array(F.lit(NO_FLAG_TEXT))).otherwise(arr)


def expected_loss(pd_col: Column | str, income: Column | str = "monthly_income",
                  lgd: float = LOSS_GIVEN_DEFAULT) -> tuple[Column, Column]:
    """exposure = annual income; expected loss = PD x LGD x EAD."""
    p = F.col(pd_col) if isinstance(pd_col, str) else pd_col
    inc = F.col(income) if isinstance(income, str) else income
    ead = inc * 12
    return ead, p * F.lit(lgd) * ead


def assess(df: DataFrame, pd_col: str = "pd_score_xgb") -> DataFrame:
    """L3-L6 on scored applicants: segment, portfolio gap, flags, loss."""
    direction, gap = vs_portfolio(pd_col)
    ead, el = expected_loss(pd_col)
    return df.withColumns({
        "pd_segment": pd_segment(pd_col),
        "vs_portfolio": direction,
        "gap_pct_points": gap,
        "risk_flags": risk_flags(),
        "exposure_at_default": ead,
        "expected_loss": el,
    })


def expected_loss_by_segment(df: DataFrame, pd_col: str = "pd_score_xgb",
                             segment: str = "pd_segment") -> DataFrame:
    """L6 roll-up: applicants, summed exposure and expected loss per segment."""
    ead, el = expected_loss(pd_col)
    return (df.withColumns({"_ead": ead, "_el": el})
            .groupBy(segment)
            .agg(F.count(F.lit(1)).alias("applicants"),
                 sql_round(F.sum("_ead"), 2).alias("total_exposure"),
                 sql_round(F.sum("_el"), 2).alias("total_expected_loss")))


def flag_counts(df: DataFrame) -> DataFrame:
    """L5 roll-up: applicants per flag (``explode`` of the flag array)."""
    return (df.select(F.explode(risk_flags()).alias("flag"))
            .groupBy("flag").agg(F.count(F.lit(1)).alias("applicants")))


def score_breakdown(df: DataFrame, key: str = "customer_id") -> DataFrame:
    """One row per applicant and model with PD and portfolio gap."""
    long = df.select(key, F.inline(F.array(
        F.struct(F.lit("Gradient Boosted Trees").alias("model"),
                 F.col("pd_score_xgb").alias("pd_score")),
        F.struct(F.lit("Logistic Regression").alias("model"),
                 F.col("pd_score_lr").alias("pd_score")))))
    direction, gap = vs_portfolio("pd_score")
    return long.select(key, "model", "pd_score", direction.alias("vs_portfolio"),
                       gap.alias("gap_pct_points"))
