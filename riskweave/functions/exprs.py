"""Column expressions shared by every layer.

All of them are built-in Spark expressions, so they stay inside whole-stage
codegen; nothing here runs Python per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Labels, edges and constants that must equal the reference's.
# ---------------------------------------------------------------------------
AGE_BAND_LABELS = ["18-25", "25-35", "35-45", "45-55", "55-65", "65+"]
AGE_BAND_UPPER = [25, 35, 45, 55, 65]
INCOME_BAND_LABELS = ["<$2k", "$2-4k", "$4-6k", "$6-10k", ">$10k"]
INCOME_BAND_UPPER = [2000, 4000, 6000, 10000]
RISK_SEGMENTS = ["High Risk", "Medium Risk", "Low Risk"]
ML_SEGMENT_EDGES = [0.0, 0.1, 0.3, 1.0]
ML_SEGMENT_LABELS = ["Low Risk", "Medium Risk", "High Risk"]
PORTFOLIO_BASE_RATE = 0.067
LOSS_GIVEN_DEFAULT = 0.45
NO_FLAG_TEXT = "No significant risk flags detected"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sql_round(c: Column | str, n: int = 0) -> Column:
    """SQL ``ROUND(double, n)``: half away from zero on ``c * 10**n``.

    Spark's own ``round(c, n)`` rounds the decimal text of ``c`` instead
    (2.135 -> 2.14, where SQL engines give 2.13), so the scale is applied
    first and only an integral rounding is left.
    """
    c = _c(c)
    if n == 0:
        return F.round(c, 0)
    scale = float(10 ** n)
    return F.round(c * F.lit(scale), 0) / F.lit(scale)


def even_round(c: Column | str, n: int = 0) -> Column:
    """numpy / pandas ``.round(n)``: half to even on ``c * 10**n``."""
    c = _c(c)
    scale = float(10 ** n)
    return F.bround(c * F.lit(scale), 0) / F.lit(scale)


def left_closed_band(c: Column | str, uppers: Sequence[float],
                     labels: Sequence[str]) -> Column:
    """``CASE WHEN c < u1 THEN l1 ... ELSE last END`` (NULL falls to the last label)."""
    c = _c(c)
    expr = None
    for u, label in zip(uppers, labels):
        expr = (F.when(c < u, label) if expr is None else expr.when(c < u, label))
    return expr.otherwise(labels[len(uppers)])


def age_band(c: Column | str = "age") -> Column:
    return left_closed_band(c, AGE_BAND_UPPER, AGE_BAND_LABELS)


def income_band(c: Column | str = "monthly_income") -> Column:
    return left_closed_band(c, INCOME_BAND_UPPER, INCOME_BAND_LABELS)


def right_closed_cut(c: Column | str, edges: Sequence[float],
                     labels: Sequence[str]) -> Column:
    """``pd.cut(c, edges, labels)``: bins ``(e_i, e_{i+1}]``; outside -> NULL."""
    c = _c(c)
    expr = None
    for lo, hi, label in zip(edges[:-1], edges[1:], labels):
        cond = (c > lo) & (c <= hi)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr


def cut_order(c: Column | str, edges: Sequence[float]) -> Column:
    """0-based position of the right-closed bin (NULL outside) — a sort key."""
    c = _c(c)
    expr = None
    for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
        cond = (c > lo) & (c <= hi)
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr


def clip_upper(c: Column | str, upper: float) -> Column:
    """pandas ``clip(upper=u)``: NULL stays NULL (``least`` would give ``u``)."""
    c = _c(c)
    return F.when(c > upper, F.lit(float(upper))).otherwise(c)


def flag(cond: Column) -> Column:
    """0/1 integer flag from a predicate (NULL -> 0, as ``CASE`` does)."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def ml_segment(score: Column | str = "pd_score_xgb") -> Column:
    """Right-closed PD segment ``(0,.1] (.1,.3] (.3,1]``; score 0 -> NULL."""
    return right_closed_cut(score, ML_SEGMENT_EDGES, ML_SEGMENT_LABELS)


def pd_segment(score: Column | str) -> Column:
    """Left-closed PD segment of the applicant form: >=.3 High, >=.1 Medium;
    no score, no segment."""
    s = _c(score)
    return (F.when(s >= 0.3, "High Risk").when(s >= 0.1, "Medium Risk")
            .when(s.isNotNull(), "Low Risk"))


def safe_div(num: Column, den: Column, default: float | None = 0.0) -> Column:
    """``num / den`` with 0 (or ``default``) when ``den`` is 0 — ANSI mode
    raises on division by zero."""
    return F.when(den == 0, F.lit(default)).otherwise(num / den)
