"""DuckDB text for the correctness oracle.

Every oracle starts with the F2 ``raw_loans`` CTE (FIXTURES.md) over the
driver's ``orders``/``lineitem`` views, then the layer CTEs, which take their
rules from tables of bounds and points: a rule score is a sum over joined
points, a segment the worst joined severity, a band the count of edges reached
(the DataFrame code has chained conditions; the portfolio roll-up is a UNION
ALL here and GROUPING SETS there).
"""

from __future__ import annotations

RAW_LOANS = """
late AS (
  SELECT l_orderkey,
    CAST(SUM(CASE WHEN l_returnflag='R' AND l_discount>=0.085 THEN 1 ELSE 0 END) AS BIGINT) AS a,
    CAST(SUM(CASE WHEN l_returnflag='N' AND l_quantity>=45 AND l_discount>=0.045 THEN 1 ELSE 0 END) AS BIGINT) AS b,
    CAST(SUM(CASE WHEN l_returnflag='A' AND l_quantity<=5 AND l_discount<=0.055 THEN 1 ELSE 0 END) AS BIGINT) AS c
  FROM lineitem GROUP BY l_orderkey
),
base AS (
  SELECT o_orderkey AS k, o_totalprice AS p,
         COALESCE(a,0) AS a, COALESCE(b,0) AS b, COALESCE(c,0) AS c
  FROM orders LEFT JOIN late ON o_orderkey = l_orderkey
),
x AS (
  SELECT k, k+1 AS customer_id,
    CASE WHEN k%1009=3 THEN NULL WHEN k%997=0 THEN 0 WHEN k%499=1 THEN 17
         WHEN k%503=2 THEN 109 ELSE 21+(k*7919)%70 END AS age,
    CASE WHEN k%5=3 THEN NULL ELSE CAST(FLOOR(p/CAST(32 AS DOUBLE)) AS DOUBLE) END AS monthly_income,
    CASE WHEN k%38=5 THEN NULL
         WHEN (k*31)%23<13 THEN CAST(0 AS DOUBLE) WHEN (k*31)%23<17 THEN CAST(1 AS DOUBLE)
         WHEN (k*31)%23<20 THEN CAST(2 AS DOUBLE) WHEN (k*31)%23<22 THEN CAST(3 AS DOUBLE)
         ELSE CAST(4 AS DOUBLE) END AS num_dependents,
    CASE WHEN k%607=11 THEN NULL WHEN k%601=0 THEN CAST(50708 AS DOUBLE)
         WHEN k%211=9 THEN CAST(-0.25 AS DOUBLE)
         ELSE CAST((k*1103)%1200 AS DOUBLE)/CAST(1024 AS DOUBLE) END AS revolving_util,
    CASE WHEN k%613=12 THEN NULL WHEN k%401=0 THEN CAST(329664 AS DOUBLE)
         WHEN k%5=3 THEN CAST(k%3000 AS DOUBLE)
         ELSE CAST((k*2741)%1500 AS DOUBLE)/CAST(1024 AS DOUBLE) END AS debt_ratio,
    CASE WHEN k%701=0 THEN 58 ELSE (k*13)%24 END AS open_credit_lines,
    CASE WHEN k%809=0 THEN 54 ELSE (k*17)%4 END AS real_estate_loans,
    CASE WHEN k%557=0 THEN 98 ELSE a END AS late_30_59,
    CASE WHEN k%557=0 THEN 98 ELSE b END AS late_60_89,
    CASE WHEN k%557=0 THEN 98 ELSE c END AS late_90_plus
  FROM base
),
raw_loans AS (
  SELECT customer_id,
    CAST(CASE WHEN 6*LEAST(late_90_plus,5) + 4*LEAST(late_60_89,5) + 3*LEAST(late_30_59,5)
              + CASE WHEN revolving_util>0.9 THEN 6 ELSE 0 END
              + CASE WHEN age<35 THEN 2 ELSE 0 END + (k*6151)%17 >= 22
         THEN 1 ELSE 0 END AS BIGINT) AS is_default,
    revolving_util, age, late_30_59, debt_ratio, monthly_income, open_credit_lines,
    late_90_plus, real_estate_loans, late_60_89, num_dependents
  FROM x
)"""

# Fixed values of the three layers, as tables: bounds, bands and points.
_CAPS = {"debt_ratio": 5.0, "open_credit_lines": 50, "real_estate_loans": 10,
         "late_30_59": 15, "late_60_89": 15, "late_90_plus": 15}
_AGE_BANDS = ([25, 35, 45, 55, 65], ["18-25", "25-35", "35-45", "45-55", "55-65", "65+"])
_INCOME_BANDS = ([2000, 4000, 6000, 10000], ["<$2k", "$2-4k", "$4-6k", "$6-10k", ">$10k"])
#: measure, points for each late payment; at most five of a kind count
_LATE_POINTS = [("late_90_plus", 6), ("late_60_89", 3), ("late_30_59", 1)]
#: measure, points a value above the bound adds to those of the bounds below it
_POINTS_ABOVE = [("revolving_util", 0.5, 6), ("revolving_util", 0.7, 6), ("revolving_util", 0.9, 8),
                 ("debt_ratio", 0.3, 3), ("debt_ratio", 0.5, 5), ("debt_ratio", 1.0, 7),
                 ("age", 60, -5)]
#: measure, points a value below the bound adds to those of the bounds above it
_POINTS_BELOW = [("age", 35, 5), ("age", 25, 5), ("monthly_income", 4000, 2),
                 ("monthly_income", 2000, 3)]
#: measure, bound, severity that a value above the bound brings
_SEVERITY = [("late_90_plus", 0, 2), ("revolving_util", 0.9, 2), ("late_30_59", 0, 1),
             ("debt_ratio", 0.7, 1), ("revolving_util", 0.6, 1)]
_SEGMENTS = ["Low Risk", "Medium Risk", "High Risk"]
_MEASURES = sorted({m for m, *_ in [*_LATE_POINTS, *_POINTS_ABOVE, *_POINTS_BELOW, *_SEVERITY]})


def _values(rows) -> str:
    return "(VALUES " + ", ".join(
        "(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)" for v in row)
        + ")" for row in rows) + ")"


def _band(value: str, bands: tuple[list, list]) -> str:
    """The label at the number of edges that the value reaches; NULL reaches all."""
    edges, labels = bands
    reached = " + ".join(f"CAST(COALESCE({value} >= {e}, TRUE) AS INTEGER)" for e in edges)
    return f"[{', '.join(repr(x) for x in labels)}][1 + {reached}]"


def _clean_sql(name: str, where: str) -> str:
    # a NULL comes out as the bound, so only values within it pass unchanged
    capped = ", ".join(f"IF({c} <= {cap}, {c}, {cap}) AS {c}" for c, cap in _CAPS.items())
    return f"""
{name} AS (
  SELECT * EXCLUDE (adult) REPLACE (IF(adult, age, NULL) AS age, {capped},
    IFNULL(monthly_income, 3500) AS monthly_income, IFNULL(num_dependents, 0) AS num_dependents,
    IF(revolving_util >= 0, IF(revolving_util <= 1, revolving_util, 1), 0) AS revolving_util)
  FROM (SELECT *, age BETWEEN 18 AND 100 AS adult FROM raw_loans) WHERE {where}
)"""


def _features_sql(name: str, where: str, source: str = "clean_loans") -> str:
    flags = ", ".join(f"CAST(IFNULL({rule}, FALSE) AS INTEGER) AS {flag}" for flag, rule in (
        ("ever_seriously_delinquent", "late_90_plus > 0"), ("high_util_flag", "revolving_util > 0.8"),
        ("high_debt_flag", "debt_ratio > 0.5")))
    return f"""
{name} AS (
  SELECT c.*, {_band('age', _AGE_BANDS)} AS age_band,
    {_band('monthly_income', _INCOME_BANDS)} AS income_band, {flags},
    late_90_plus + late_60_89 + late_30_59 AS total_late_payments,
    IFNULL(ROUND(monthly_income / NULLIF(num_dependents, 0), 2), monthly_income) AS income_per_dependent,
    ROUND(debt_ratio * monthly_income, 2) AS estimated_monthly_debt,
    RANK() OVER (ORDER BY customer_id) AS row_num
  FROM {source} c WHERE {where}
)"""


def _risk_sql(name: str, source: str) -> str:
    """Points and severities are looked up per measure and added up per customer."""
    return f"""
{name}_measures AS (
  SELECT customer_id, UNNEST([{', '.join(f"'{m}'" for m in _MEASURES)}]) AS measure,
         UNNEST([{', '.join(f'CAST({m} AS DOUBLE)' for m in _MEASURES)}]) AS v FROM {source}
),
{name}_points AS (
  SELECT customer_id, SUM(points) AS points, MAX(severity) AS severity FROM (
    SELECT customer_id, points * IF(v > 5, 5, v) AS points, 0 AS severity
    FROM {name}_measures JOIN {_values(_LATE_POINTS)} t(measure, points) USING (measure)
    UNION ALL
    SELECT customer_id, points, 0
    FROM {name}_measures m JOIN {_values(_POINTS_ABOVE)} t(measure, bound, points)
      ON m.measure = t.measure AND v > bound
    UNION ALL
    SELECT customer_id, points, 0
    FROM {name}_measures m JOIN {_values(_POINTS_BELOW)} t(measure, bound, points)
      ON m.measure = t.measure AND v < bound
    UNION ALL
    SELECT customer_id, 0, severity
    FROM {name}_measures m JOIN {_values(_SEVERITY)} t(measure, bound, severity)
      ON m.measure = t.measure AND v > bound
  ) GROUP BY customer_id
),
{name} AS (
  SELECT f.*, CAST(points AS DOUBLE) AS rule_risk_score,
    [{', '.join(repr(x) for x in _SEGMENTS)}][1 + CAST(severity AS INTEGER)] AS risk_segment
  FROM {source} f JOIN {name}_points USING (customer_id)
)"""


CLEAN = _clean_sql("clean_loans", "age >= 1")
FEATURES = _features_sql("feature_engineering", "age IS NOT NULL")
FEATURES_APP = _features_sql("feature_engineering_app", "TRUE")
RISK = _risk_sql("risk_segments", "feature_engineering")
RISK_APP = _risk_sql("risk_segments_app", "feature_engineering_app")

#: every applicant, also those whose age is invalid
APPLICANTS = (_clean_sql("clean_applicants", "TRUE") + ","
              + _features_sql("applicants", "TRUE", "clean_applicants"))

LAYERS = [RAW_LOANS, CLEAN, FEATURES, FEATURES_APP, RISK, RISK_APP, APPLICANTS]


def with_layers(final_sql: str, *extra_ctes: str) -> str:
    """``WITH <F2>, <layers>, <extra> <final>`` — unused CTEs are free."""
    ctes = ",".join([*LAYERS, *extra_ctes])
    return f"WITH {ctes}\n{final_sql}"


def _edge_sql(i: str, bins: int) -> str:
    return (f"CASE WHEN {i} >= {bins} THEN _hi "
            f"ELSE CAST({i} AS DOUBLE) * ((_hi - _lo) / {float(bins)}) + _lo END")


def histogram_sql(source: str, value: str, bins: int, by: tuple[str, ...] = (),
                  shared: bool = True, lo: float | None = None, hi: float | None = None,
                  clip: float | None = None, where: str | None = None) -> str:
    """DuckDB text of an equal-width histogram with numpy's edge rules: the
    final ``SELECT`` plus its ``h_*`` CTEs, to be used with ``with_layers``."""
    by = tuple(by)
    byc = "".join(f"{b}, " for b in by)
    x = f"CAST({value} AS DOUBLE)"
    if clip is not None:
        x = f"CASE WHEN {x} > {float(clip)} THEN {float(clip)} ELSE {x} END"
    cond = f"WHERE {where}" if where else ""
    if lo is not None and hi is not None:
        stats = (f"SELECT {byc}{float(lo)} AS lo0, {float(hi)} AS hi0 FROM h_src "
                 + (f"GROUP BY {', '.join(by)}" if by else "HAVING COUNT(*) > 0"))
    elif by and not shared:
        stats = f"SELECT {byc}MIN(_x) AS lo0, MAX(_x) AS hi0 FROM h_src GROUP BY {', '.join(by)}"
    elif by:
        stats = (f"SELECT {', '.join('g.' + b for b in by)}, s.lo0, s.hi0 FROM "
                 f"(SELECT DISTINCT {', '.join(by)} FROM h_src) g CROSS JOIN "
                 f"(SELECT MIN(_x) AS lo0, MAX(_x) AS hi0 FROM h_src) s")
    else:
        stats = "SELECT MIN(_x) AS lo0, MAX(_x) AS hi0 FROM h_src HAVING COUNT(*) > 0"
    using = ", ".join([*by, "bin"])
    join_on = " AND ".join(f"s.{b} = e.{b}" for b in by) or "TRUE"
    ctes = f"""
h_src AS (SELECT {byc}{x} AS _x FROM {source} {cond}),
h_src2 AS (SELECT * FROM h_src WHERE _x IS NOT NULL),
h_stats AS ({stats.replace('FROM h_src', 'FROM h_src2')}),
h_edges AS (SELECT {byc}CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS _lo,
                   CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS _hi FROM h_stats),
h_i0 AS (SELECT {''.join('s.' + b + ', ' for b in by)}s._x, e._lo, e._hi,
           CAST(FLOOR((s._x - e._lo) * ({float(bins)} / (e._hi - e._lo))) AS BIGINT) AS raw
         FROM h_src2 s JOIN h_edges e ON {join_on}),
h_i1 AS (SELECT *, CASE WHEN raw >= {bins} THEN {bins - 1} ELSE raw END AS i0 FROM h_i0),
h_i2 AS (SELECT *, CASE WHEN _x < {_edge_sql('i0', bins)} THEN i0 - 1 ELSE i0 END AS i1 FROM h_i1),
h_bin AS (SELECT {byc}CASE WHEN _x >= _lo AND _x <= _hi THEN
            CASE WHEN _x >= {_edge_sql('(i1 + 1)', bins)} AND i1 <> {bins - 1} THEN i1 + 1 ELSE i1 END
          END AS bin FROM h_i2),
h_counts AS (SELECT {byc}bin, COUNT(*) AS frequency FROM h_bin WHERE bin IS NOT NULL
             GROUP BY {byc}bin),
h_all AS (SELECT {byc}_lo, _hi, r.range AS bin FROM h_edges CROSS JOIN range(0, {bins}) r)"""
    final = (f"SELECT {byc}bin, {_edge_sql('bin', bins)} AS bin_lo, "
             f"{_edge_sql('(bin + 1)', bins)} AS bin_hi, COALESCE(frequency, 0) AS frequency "
             f"FROM h_all LEFT JOIN h_counts USING ({using})")
    return with_layers(final, ctes.strip().rstrip(","))
