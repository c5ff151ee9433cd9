"""Model evaluation.

Ranking metrics first collapse the scored rows to one row per distinct score
(``pos``, ``neg`` counts — map-side partial aggregation, so a score shared by
a third of the rows is one row after the first stage). The scored rows are
read twice: once for the sketch of the score order with the totals, once for
the bucket totals and the points. The AUC numerator is an exact
integer, so the result does not depend on the order in which partitions are
summed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import safe_div, sql_round
from ..functions.histogram import histogram
from .prefix import N_BUCKETS, split_points, with_bucket

# Industry reference bands of the model comparison table and the
# Gini grading of the modelling notebook.
INDUSTRY_BANDS = [("Industry Minimum", 0.70, 0.40, "Minimum"),
                  ("Industry Good", 0.80, 0.60, "Good"),
                  ("Industry Excellent", 0.90, 0.80, "Excellent")]
GINI_GRADES = [(0.8, "Excellent"), (0.7, "Strong"), (0.6, "Good")]
METRIC_DIGITS = 6


def score_counts(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row per distinct score: ``s, pos, neg``."""
    y = F.col(label)
    return (df.filter(F.col(score).isNotNull() & y.isNotNull())
            .groupBy(F.col(score).cast("double").alias("s"))
            .agg(F.count_if(y == 1).alias("pos"), F.count_if(y != 1).alias("neg")))


def ranked_scores(df: DataFrame, label: str, score: str) -> tuple[DataFrame, DataFrame]:
    """The distinct scores, highest first: ``s, pos, neg`` with the running
    counts ``tps, fps`` (own row included), the totals ``P, N`` and the next
    row's counts ``pos_next, neg_next`` (NULL on the last row); and the
    one-row table of ``P, N``.

    Buckets of scores are counted first; the table of bucket totals (at most
    ``N_BUCKETS`` rows, so it is broadcast) holds what a bucket needs from
    the others: the counts before it and the first row of the next one.
    """
    g = score_counts(df, label, score).withColumn("_x", -F.col("s"))
    totals = g.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"),
                   split_points("_x", N_BUCKETS).alias("splits"))
    known = totals.select(F.struct("*")).scalar()
    g = g.withColumn("_k", known).select("s", "pos", "neg", "_x", "_k.P", "_k.N", "_k.splits")
    g = with_bucket(g, F.col("_x"), "splits", N_BUCKETS, "_b")
    per_bucket = g.groupBy("_b").agg(F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"),
                                     F.min_by("pos", "_x").alias("_pos1"),
                                     F.min_by("neg", "_x").alias("_neg1"))
    every = Window.orderBy("_b")
    before = every.rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        "_b", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("_pos", "_neg")],
        *[F.lead(c).over(every).alias(c) for c in ("_pos1", "_neg1")])
    inside = Window.partitionBy("_b").orderBy("_x")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    points = g.join(F.broadcast(offsets), "_b").select(
        "s", "pos", "neg", "P", "N",
        (F.col("_pos0") + F.sum("pos").over(upto)).alias("tps"),
        (F.col("_neg0") + F.sum("neg").over(upto)).alias("fps"),
        F.coalesce(F.lead("pos").over(inside), F.col("_pos1")).alias("pos_next"),
        F.coalesce(F.lead("neg").over(inside), F.col("_neg1")).alias("neg_next"))
    return points, totals.select("P", "N")


def auc(df: DataFrame, label: str = "is_default", score: str = "score") -> DataFrame:
    """M5 + M6: ROC AUC with ties counted half (the rank-sum form) and
    Gini = 2 AUC - 1, as one row.

    Twice the pairs in right order, ties once, are each score's negatives
    times the positives not below it, plus its positives times the negatives
    below it; the sum is exact in DECIMAL(38, 0).
    """
    points, _ = ranked_scores(df, label, score)
    dec = T.DecimalType(38, 0)
    term = (F.col("neg").cast(dec) * F.col("tps").cast(dec)
            + F.col("pos").cast(dec) * (F.col("N") - F.col("fps")).cast(dec))
    tot = points.agg(F.sum(term).alias("num"), F.max("P").alias("P"), F.max("N").alias("N"))
    den = F.lit(2.0) * F.col("P").cast("double") * F.col("N").cast("double")
    a = F.when(den == 0, F.lit(None).cast("double")).otherwise(F.col("num").cast("double") / den)
    return tot.select(a.alias("auc")).select("auc", (F.col("auc") * 2 - 1).alias("gini"))


def roc_curve(df: DataFrame, label: str = "is_default", score: str = "score",
              drop_intermediate: bool = True) -> DataFrame:
    """M7: ROC points ``(threshold, fps, tps, fpr, tpr)`` with thresholds in
    decreasing score order, a first point (0, 0) at threshold +inf, and
    collinear intermediate points dropped (second differences of both
    ``fps`` and ``tps`` zero), as the usual library default does.

    A second difference of a running count is the next row's own count less
    this row's, so only the next row is needed.
    """
    points, totals = ranked_scores(df, label, score)
    if drop_intermediate:
        first = (F.col("tps") == F.col("pos")) & (F.col("fps") == F.col("neg"))
        points = points.filter(first | F.col("pos_next").isNull()
                               | (F.col("pos_next") != F.col("pos"))
                               | (F.col("neg_next") != F.col("neg")))
    origin = totals.select(F.lit(float("inf")).alias("threshold"),
                           F.lit(0).cast("bigint").alias("fps"),
                           F.lit(0).cast("bigint").alias("tps"), "N", "P")
    every = points.select(F.col("s").alias("threshold"), "fps", "tps", "N", "P").unionByName(origin)
    return every.select(
        "threshold", "fps", "tps",
        safe_div(F.col("fps").cast("double"), F.col("N").cast("double"), None).alias("fpr"),
        safe_div(F.col("tps").cast("double"), F.col("P").cast("double"), None).alias("tpr"))


def roc_curve_reduced(df: DataFrame, label: str = "is_default", score: str = "score", cells: int = 200) -> DataFrame:
    """M7: a ROC curve of at most ``2 * cells + 2`` points, however many scores
    there are. Both axes are divided into ``cells`` parts; a threshold is kept
    if it is the first to enter a part on either, or the last. A threshold
    left out has the ``fpr`` and ``tpr`` of the kept one before it, each to
    within ``1 / cells``.

    A point needs only its own running counts (those of the point before are
    less its own), so the reduction is a filter, and the kept rows of any
    partition are those of the whole."""
    points, totals = ranked_scores(df, label, score)

    def enters(upto: str, own: str, total: str) -> Column:
        # integers, so that all engines agree
        return F.expr(f"{upto} * {cells} div greatest({total}, 1)") > F.expr(f"({upto} - {own}) * {cells} div greatest({total}, 1)")

    kept = points.filter(enters("tps", "pos", "P") | enters("fps", "neg", "N") | F.col("pos_next").isNull())
    origin = totals.select(F.lit(float("inf")).alias("threshold"), F.lit(0).cast("bigint").alias("fps"),
                           F.lit(0).cast("bigint").alias("tps"), "N", "P")
    return kept.select(F.col("s").alias("threshold"), "fps", "tps", "N", "P").unionByName(origin).select(
        "threshold", "fps", "tps",
        safe_div(F.col("fps").cast("double"), F.col("N").cast("double"), None).alias("fpr"),
        safe_div(F.col("tps").cast("double"), F.col("P").cast("double"), None).alias("tpr"))


def predicted(score: Column, threshold: float = 0.5, inclusive: bool = True) -> Column:
    return F.when(score >= threshold if inclusive else score > threshold, F.lit(1)) \
        .otherwise(F.lit(0))


def confusion(df: DataFrame, label: str = "is_default", score: str = "score",
              threshold: float = 0.5, inclusive: bool = True) -> DataFrame:
    """M8: the full 2 x 2 matrix ``(actual, predicted, count)`` in one pass
    (cells with no rows are 0). ``inclusive`` is ``>=`` (dashboard);
    ``False`` is the strict ``>`` of a model's own ``predict``."""
    y = F.col(label)
    p = predicted(F.col(score), threshold, inclusive)
    cells = [(a, b) for a in (0, 1) for b in (0, 1)]
    one = df.filter(y.isNotNull() & F.col(score).isNotNull()).agg(
        *[F.count_if((y == a) & (p == b)).alias(f"c{a}{b}") for a, b in cells])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("actual"), F.lit(b).alias("predicted"),
                 F.col(f"c{a}{b}").alias("count")) for a, b in cells])))


def classification_report(df: DataFrame, label: str = "is_default", score: str = "score",
                          threshold: float = 0.5, inclusive: bool = False) -> DataFrame:
    """M9: precision, recall, F1 and support per class, accuracy, macro and
    support-weighted means — arithmetic over the four confusion counts
    (0 where a denominator is 0)."""
    y = F.col(label)
    p = predicted(F.col(score), threshold, inclusive)
    c = df.filter(y.isNotNull() & F.col(score).isNotNull()).agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 0) & (p == 0)).alias("tn"))
    d = lambda x: F.col(x).cast("double")

    def prf(tp: str, fp: str, fn: str):
        prec = safe_div(d(tp), d(tp) + d(fp))
        rec = safe_div(d(tp), d(tp) + d(fn))
        f1 = safe_div(2 * prec * rec, prec + rec)
        return prec, rec, f1

    p1, r1, f1 = prf("tp", "fp", "fn")
    p0, r0, f0 = prf("tn", "fn", "fp")
    s1, s0 = d("tp") + d("fn"), d("tn") + d("fp")
    n = s0 + s1
    acc = safe_div(d("tp") + d("tn"), n)
    r = lambda x: sql_round(x, METRIC_DIGITS)
    rows = [
        ("0", p0, r0, f0, s0), ("1", p1, r1, f1, s1),
        ("accuracy", F.lit(None).cast("double"), F.lit(None).cast("double"), acc, n),
        ("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n),
        ("weighted avg", safe_div(p0 * s0 + p1 * s1, n), safe_div(r0 * s0 + r1 * s1, n),
         safe_div(f0 * s0 + f1 * s1, n), n),
    ]
    return c.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("label"), r(pr).alias("precision"), r(rc).alias("recall"),
                 r(f).alias("f1_score"), sp.cast("bigint").alias("support"))
        for name, pr, rc, f, sp in rows])))


def ml_segment_summary(scores: DataFrame, segment: str = "ml_risk_segment",
                       label: str = "is_default") -> DataFrame:
    """Customers and actual default rate % (SQL rounding) per ML
    segment, highest rate first (a NULL segment is its own group)."""
    return (scores.groupBy(segment)
            .agg(F.count(F.lit(1)).alias("customers"),
                 sql_round(F.avg(label) * 100, 2).alias("actual_default_rate_pct"))
            .orderBy(F.desc("actual_default_rate_pct"), segment))


def score_histogram(scores: DataFrame, score: str = "pd_score_xgb", bins: int = 60,
                    label: str = "is_default") -> DataFrame:
    """PD score histogram per default class on one set of edges."""
    return histogram(scores, score, bins, by=[label], shared_edges=True)


def gini_grade(gini: Column) -> Column:
    expr = None
    for lo, name in GINI_GRADES:
        expr = F.when(gini > lo, name) if expr is None else expr.when(gini > lo, name)
    return expr.otherwise("Below good")


def model_comparison(metrics: DataFrame) -> DataFrame:
    """Computed model AUC/Gini rows plus the industry reference bands.

    ``metrics`` has columns ``model, auc, gini`` (one row per model)."""
    spark = metrics.sparkSession
    bands = spark.createDataFrame(INDUSTRY_BANDS, "model string, auc double, gini double, "
                                                  "assessment string")
    models = metrics.select("model", "auc", "gini", gini_grade(F.col("gini")).alias("assessment"))
    return models.unionByName(bands)


def training_summary(frame_report: DataFrame, splits: DataFrame, metrics: DataFrame,
                     n_features: int) -> DataFrame:
    """One row — model-frame size, split sizes, feature count and both
    models' metrics. ``frame_report`` is the M2 row, ``splits`` the M3
    summary, ``metrics`` rows of ``model, auc, gini``."""
    sz = splits.agg(
        F.max(F.when(F.col("split") == "train", F.col("rows"))).alias("train_rows"),
        F.max(F.when(F.col("split") == "test", F.col("rows"))).alias("test_rows"),
    ).select(F.struct("*")).scalar()

    def pick(model: str, field: str) -> Column:
        return F.max(F.when(F.col("model") == model, F.col(field))).alias(field)

    m = metrics.agg(
        pick("Logistic Regression", "auc").alias("lr_auc"),
        pick("Logistic Regression", "gini").alias("lr_gini"),
        pick("Gradient Boosted Trees", "auc").alias("gbt_auc"),
        pick("Gradient Boosted Trees", "gini").alias("gbt_gini"),
    ).select(F.struct("*")).scalar()
    return frame_report.select(
        F.col("rows_after").alias("dataset_rows"), sz.getField("train_rows").alias("train_rows"),
        sz.getField("test_rows").alias("test_rows"), F.lit(n_features).alias("n_features"),
        *[m.getField(f).alias(f) for f in ("lr_auc", "lr_gini", "gbt_auc", "gbt_gini")])
