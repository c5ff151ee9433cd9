"""``raw_loans`` derived from the order tables (FIXTURES.md, F2).

One applicant per order. The three late-payment counters come from a
per-order aggregate of ``lineitem``; the other columns are fixed integer
rules over the order key and price, with nulls and out-of-range values
planted on purpose so the cleaning layer has work to do.

Plan shape: ``lineitem`` is aggregated per ``l_orderkey`` (partial
aggregation before the shuffle, so a hot order never reaches one task as raw
lines); the aggregate comes out hash-partitioned on the key and the join with
``orders`` reuses that partitioning, so only ``orders`` is shuffled for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TPCH_TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
               "lineitem")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _count_if(cond: Column, name: str) -> Column:
    return F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))).cast("bigint").alias(name)


def late_counts(lineitem: DataFrame) -> DataFrame:
    """Per order: three counters of qualifying lines (F2 ``late``)."""
    flag, qty, disc = F.col("l_returnflag"), F.col("l_quantity"), F.col("l_discount")
    return lineitem.groupBy("l_orderkey").agg(
        _count_if((flag == "R") & (disc >= 0.085), "a"),
        _count_if((flag == "N") & (qty >= 45) & (disc >= 0.045), "b"),
        _count_if((flag == "A") & (qty <= 5) & (disc <= 0.055), "c"),
    )


def raw_loans_from_orders(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """The F2 ``raw_loans`` table: 12 columns, one row per order."""
    late = late_counts(lineitem)
    base = (
        orders.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("p"))
        .join(late, F.col("k") == F.col("l_orderkey"), "left")
        .select("k", "p", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in "abc"])
    )
    k = F.col("k")
    d = lambda v: F.lit(float(v))  # noqa: E731  double literal
    mix = (k * 31) % 23
    x = base.select(
        k,
        (k + 1).alias("customer_id"),
        F.when(k % 1009 == 3, F.lit(None))
        .when(k % 997 == 0, F.lit(0))
        .when(k % 499 == 1, F.lit(17))
        .when(k % 503 == 2, F.lit(109))
        .otherwise(21 + (k * 7919) % 70).cast("bigint").alias("age"),
        F.when(k % 5 == 3, F.lit(None))
        .otherwise(F.floor(F.col("p") / d(32)).cast("double")).alias("monthly_income"),
        F.when(k % 38 == 5, F.lit(None).cast("double"))
        .when(mix < 13, d(0)).when(mix < 17, d(1)).when(mix < 20, d(2))
        .when(mix < 22, d(3)).otherwise(d(4)).alias("num_dependents"),
        F.when(k % 607 == 11, F.lit(None).cast("double"))
        .when(k % 601 == 0, d(50708))
        .when(k % 211 == 9, d(-0.25))
        .otherwise(((k * 1103) % 1200).cast("double") / d(1024)).alias("revolving_util"),
        F.when(k % 613 == 12, F.lit(None).cast("double"))
        .when(k % 401 == 0, d(329664))
        .when(k % 5 == 3, (k % 3000).cast("double"))
        .otherwise(((k * 2741) % 1500).cast("double") / d(1024)).alias("debt_ratio"),
        F.when(k % 701 == 0, F.lit(58)).otherwise((k * 13) % 24).cast("bigint")
        .alias("open_credit_lines"),
        F.when(k % 809 == 0, F.lit(54)).otherwise((k * 17) % 4).cast("bigint")
        .alias("real_estate_loans"),
        F.when(k % 557 == 0, F.lit(98)).otherwise(F.col("a")).cast("bigint").alias("late_30_59"),
        F.when(k % 557 == 0, F.lit(98)).otherwise(F.col("b")).cast("bigint").alias("late_60_89"),
        F.when(k % 557 == 0, F.lit(98)).otherwise(F.col("c")).cast("bigint").alias("late_90_plus"),
    )
    pts = (
        6 * F.least(F.col("late_90_plus"), F.lit(5))
        + 4 * F.least(F.col("late_60_89"), F.lit(5))
        + 3 * F.least(F.col("late_30_59"), F.lit(5))
        + F.when(F.col("revolving_util") > 0.9, 6).otherwise(0)
        + F.when(F.col("age") < 35, 2).otherwise(0)
        + (k * 6151) % 17
    )
    return x.select(
        "customer_id",
        F.when(pts >= 22, 1).otherwise(0).cast("bigint").alias("is_default"),
        "revolving_util", "age", "late_30_59", "debt_ratio", "monthly_income",
        "open_credit_lines", "late_90_plus", "real_estate_loans", "late_60_89",
        "num_dependents",
    )


def raw_loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read ``orders`` and ``lineitem`` (only the needed columns reach the
    scan) and derive ``raw_loans``."""
    return raw_loans_from_orders(read_table(spark, sf_dir, "orders"),
                                 read_table(spark, sf_dir, "lineitem"))
