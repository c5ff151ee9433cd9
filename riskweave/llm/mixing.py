"""Operator 1, mixing sources to target weights by entropy balancing.

Rates r_i in [0, CAP] of the documents are chosen closest to 1 in relative
entropy (sum of r log r - r) under one token constraint a source: the sum of
r_i * n_i is the source's target. The dual is convex with one multiplier a
source, and its solution tilts exponentially in the document's size:
r_i = min(CAP, exp(lambda_s * n_i)). Newton steps on the dual (safeguarded by
a bracket) are one aggregation each over (source, size, count), for all
sources together; only convergence figures reach the driver.

Rounding: copies = floor(r_i + u_i), u_i in [0, 1) from a hash of the id, so
reruns agree and no document exceeds CAP times its size. The rounded sum
steps up with lambda, so after Newton lambda_s is moved, within a narrow
bracket found by histograms, to where the rounded sum meets the target; what
is left is at most about one document. Rows that agree in source, size and id
(such as copies, or rows without id) step apart, at evenly spaced u_i.

Null and empty texts have size 0, rate 1 and take nothing; a null source is a
source of its own, last in order; repeated rows count each; an empty table
gives an empty result; a column called like an output column is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, keep

#: Weights of the sources in order, repeating; share of all words to take.
WEIGHTS, SHARE = (3, 1, 2), 1.5
#: No document is taken more often than this (the dual's upper bound).
CAP = 2
#: Lambda lies between these: below, no word is taken; above, all are CAP times.
LOW, HIGH = -40.0, 0.7
BINS, MAX_STEPS, TOLERANCE = 1024, 60, 1e-9


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def _key(source: Column) -> Column:
    """The source as a text that is never null."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source.cast("string")))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE) -> DataFrame:
    """(key, source_size, target) from (key, source, n). A target stops at
    CAP times its source's size and the excess is shared by weight again:
    the level c with sum(min(CAP * size, weight * c)) = share * all. The
    windows run over one row a source."""
    per = sizes.groupBy("key").agg(F.first("source").alias("source"), F.sum("n").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.array(*[F.lit(float(x)) for x in weights])
    per = per.withColumn("weight", F.element_at(w, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1))
    everything = Window.partitionBy(F.lit(0))
    by_level = Window.orderBy(F.col("source_size") / F.col("weight"), "key").rowsBetween(Window.unboundedPreceding, -1)
    limit = F.col("source_size") * F.lit(float(CAP))
    per = (per.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
           .withColumn("all_weight", F.sum("weight").over(everything))
           .withColumn("used", F.coalesce(F.sum(limit).over(by_level), F.lit(0.0)))
           .withColumn("used_weight", F.coalesce(F.sum("weight").over(by_level), F.lit(0.0)))
           .withColumn("level", (F.col("total") - F.col("used")) / (F.col("all_weight") - F.col("used_weight")))
           .withColumn("full", limit <= F.col("weight") * F.col("level")))
    full = F.col("full")
    per = (per.withColumn("left", F.col("total") - F.sum(F.when(full, limit).otherwise(0.0)).over(everything))
           .withColumn("open", F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).over(everything)))
    return per.select("key", "source_size", F.when(full, limit).otherwise(
        F.try_divide(F.col("weight") * F.col("left"), F.col("open"))).alias("target"))


def _rate(lam: Column, n: Column) -> Column:
    return F.least(F.lit(float(CAP)), F.exp(F.least(lam * n, F.lit(1.0))))


def _copies(lam: Column) -> Column:
    return F.when(F.col("n") == 0, F.lit(1)).otherwise(F.floor(_rate(lam, F.col("n")) + F.col("u"))).cast("long")


def solve_dual(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(key, source_size, target, lam): Newton on the dual. One step reads
    the (key, n, count) table once and aggregates by key. ``sizes`` may hold
    how many rows each row stands for, as c."""
    each = F.col("c") if "c" in sizes.columns else F.lit(1)
    counts = keep(sizes.filter("n > 0").groupBy("key", "n").agg(F.sum(each).cast("long").alias("c")), "mix-counts")
    state = keep(targets.select("*", F.lit(0.0).alias("lam"), F.lit(LOW).alias("lo"), F.lit(HIGH).alias("hi")), "mix-state")
    n, r = F.col("n"), F.col("r")
    for _ in range(MAX_STEPS):
        sums = (counts.join(state.select("key", "lam"), "key").withColumn("r", _rate(F.col("lam"), n))
                .groupBy("key").agg(F.sum(F.col("c") * n * r).alias("f"),
                                    F.sum(F.when(r < CAP, F.col("c") * n * n * r).otherwise(0.0)).alias("slope")))
        f, target, lam = F.col("f"), F.col("target"), F.col("lam")
        step = lam - F.log(F.try_divide(f, target)) * F.try_divide(f, F.col("slope"))  # Newton on log f, which is nearly linear
        inside = (target > 0) & (F.col("slope") > 0) & (f > 0) & (step > F.col("lo2")) & (step < F.col("hi2"))
        state = keep(
            state.join(sums, "key", "left")
            .withColumn("gap", F.coalesce(F.abs(f - target) / F.greatest(target, F.lit(1.0)), F.lit(0.0)))
            .withColumn("lo2", F.when(f < target, lam).otherwise(F.col("lo")))
            .withColumn("hi2", F.when(f > target, lam).otherwise(F.col("hi")))
            .withColumn("next", F.when(F.col("gap") <= TOLERANCE, lam).when(inside, step)
                        .otherwise((F.col("lo2") + F.col("hi2")) / 2))
            .select("key", "source_size", "target", F.col("next").alias("lam"), F.col("lo2").alias("lo"),
                    F.col("hi2").alias("hi"), "gap"), "mix-state")
        worst = state.agg(F.max("gap")).first()[0]
        state = state.drop("gap")
        if worst is None or worst <= TOLERANCE:
            break
    return state.select("key", "source_size", "target", "lam")


def settle_rounding(sizes: DataFrame, state: DataFrame) -> DataFrame:
    """Move each lambda to where the rounded sum meets the target. A document
    takes its k-th copy from lambda = log(k - u) / n on; three
    histograms of these points (around the dual's solution, then inside the
    bin of the target) leave a bracket a billionth as wide."""
    points = sizes.filter("n > 0").select(
        "key", (F.col("n") * F.col("c")).alias("n"), F.explode(F.array(*[F.log(F.lit(float(k)) - F.col("u")) / F.col("n") for k in range(1, CAP + 1)])).alias("at"))
    near = F.greatest(F.abs("lam") * 0.1, F.lit(1e-9))
    state = state.withColumn("lo", F.col("lam") - near).withColumn("hi", F.col("lam") + near)
    for _ in range(3):
        width = F.greatest((F.col("hi") - F.col("lo")) / BINS, F.lit(1e-15))
        where = F.floor((F.col("at") - F.col("lo")) / width)
        bins = (points.join(state.select("key", "lo", "hi"), "key")
                .withColumn("bin", F.greatest(F.lit(-1), F.least(where, F.lit(BINS))).cast("int"))
                .groupBy("key", "bin").agg(F.sum("n").alias("words")))
        upto = Window.partitionBy("key").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        # the last bin boundary at which no more than the target is taken
        best = (bins.withColumn("sum", F.sum("words").over(upto)).join(state.select("key", "target"), "key")
                .withColumn("short", F.col("sum") <= F.col("target"))
                .groupBy("key").agg(
                    F.max(F.when(F.col("short"), F.struct("bin", "sum"))).alias("below"),
                    F.min(F.when(~F.col("short"), F.struct("bin", "sum"))).alias("above")))
        low, high = F.col("lo"), F.col("hi")
        edge = lambda b: low + width * b
        state = keep(state.join(best, "key", "left")
                     # boundaries: the bin that passes the target starts at edge(bin) and ends at edge(bin + 1)
                     .withColumn("lo2", F.when(F.col("above.bin") >= 0, edge(F.col("above.bin"))).otherwise(
                         F.when(F.col("above").isNull(), high).otherwise(F.lit(LOW))))
                     .withColumn("hi2", F.when(F.col("above").isNull() | (F.col("above.bin") >= BINS), F.lit(HIGH))
                                 .otherwise(edge(F.col("above.bin") + 1)))
                     .select("key", "source_size", "target", F.col("lo2").alias("lo"), F.col("hi2").alias("hi"),
                             F.col("lam")), "mix-round")
    # take the end of the bracket that comes nearer; at either end the sum is exact
    ends = (sizes.join(state.select("key", "lo", "hi"), "key")
            .groupBy("key").agg(F.sum(F.col("c") * F.col("n") * _copies(F.col("lo"))).alias("at_lo"),
                                F.sum(F.col("c") * F.col("n") * _copies(F.col("hi"))).alias("at_hi"),
                                F.sum(F.col("c") * F.col("n") * _copies((F.col("lo") + F.col("hi")) / 2)).alias("at_mid")))
    off = {x: F.abs(F.col(f"at_{x}") - F.col("target")) for x in ("lo", "hi", "mid")}
    return keep(state.join(ends, "key", "left").select(
        "key", "source_size", "target",
        F.when((off["mid"] <= off["lo"]) & (off["mid"] <= off["hi"]), (F.col("lo") + F.col("hi")) / 2)
        .when(off["hi"] <= off["lo"], F.col("hi")).otherwise(F.col("lo")).alias("lam")), "mix-lambda")


#: Units that rows alike are dealt to, rows that one task numbers, and the most
#: groups of rows alike that are broadcast.
UNITS, NUMBERED, BROADCAST = 4096, 100_000, 100_000


def _without(every: DataFrame, alike: DataFrame) -> DataFrame:
    """The rows that no other agrees with."""
    return every.alias("a").join(alike.alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("key", "n", "id")], "left_anti")


def _units(alike: DataFrame) -> DataFrame:
    """Rows alike as UNITS units at most, each of c rows that step together:
    the m rows of a group step at evenly spaced points, up to UNITS of them."""
    units = F.least(F.col("m"), F.lit(UNITS))
    dealt = alike.withColumn("units", units).withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), units - 1)))
    return dealt.select("source", "key", "n", ((F.col("t") + F.col("u")) / F.col("units")).alias("u"), "id",
                        (F.floor(F.col("m") / F.col("units")) + F.when(F.col("t") < F.col("m") % F.col("units"), 1).otherwise(0)).cast("long").alias("c"))


def _numbered(rows: DataFrame, alike: DataFrame, key: str, broadcast: bool) -> DataFrame:
    """``rows`` with __u of those alike replaced by their unit's. Only rows
    alike are shuffled, NUMBERED of them to a task: each takes a lot, the rows
    of a lot are numbered, and the lots' counts before it are added."""
    groups = alike.select(F.col("key").alias("__k"), F.col("n").alias("__m_n"), F.col("id").alias("__id"), F.col("m").alias("__m"))
    groups = F.broadcast(groups) if broadcast else groups
    found = rows.join(groups, F.col("__key").eqNullSafe(F.col("__k")) & (F.col("__n") == F.col("__m_n")) & F.col(key).eqNullSafe(F.col("__id")), "left")
    plain = found.filter("__m is null").select(rows.columns)
    lots = F.ceil(F.col("__m") / NUMBERED)
    several = keep(found.filter("__m is not null").withColumn("__lot", F.pmod(F.monotonically_increasing_id(), lots)), "mix-several")
    group = ["__k", "__m_n", "__id"]
    counted = several.groupBy(*group, "__lot").agg(F.count("*").alias("c"))
    before = Window.partitionBy(*group).orderBy("__lot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select(*[F.col(c).alias(f"{c}2") for c in (*group, "__lot")], F.coalesce(F.sum("c").over(before), F.lit(0)).alias("__off"))
    inside = F.row_number().over(Window.partitionBy(*group, "__lot").orderBy("__lot"))
    units = F.least(F.col("__m"), F.lit(UNITS))
    placed = several.withColumn("__rank", inside).join(
        offsets, [F.col(c).eqNullSafe(F.col(f"{c}2")) for c in (*group, "__lot")])
    unit = (F.col("__off") + F.col("__rank") - 1) % units
    return plain.unionByName(placed.withColumn("__u", (unit + F.col("__u")) / units).select(rows.columns))


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id",
        weights=WEIGHTS, share: float = SHARE) -> DataFrame:
    """``docs`` with size, source_size, target, rate, copies and taken.

    Only (id, source, size) is read for the solution; texts are read once
    more for the result and never shuffled, as the multipliers (one row a
    source) are joined by source.
    """
    u = F.shiftrightunsigned(F.xxhash64(F.col(key).cast("string"), F.lit("mix")), 11) * F.lit(2.0**-53)
    shape = [F.col(source).cast("string").alias("source"), _key(F.col(source)).alias("key"),
             n_words(F.col(text)).alias("n"), u.alias("u"), F.col(key).alias("id")]
    every = keep(docs.select(*shape), "mix-sizes")
    # rows that agree in source, size and id would all step at one lambda
    alike = keep(every.filter("n > 0").groupBy("source", "key", "n", "u", "id").agg(F.count("*").alias("m")).filter("m > 1"), "mix-alike")
    n_alike = alike.count()
    sizes = every.withColumn("c", F.lit(1).cast("long"))
    if n_alike:
        sizes = keep(_without(every, alike).withColumn("c", F.lit(1).cast("long")).unionByName(_units(alike)), "mix-units")
    state = settle_rounding(sizes, solve_dual(sizes, source_targets(every, weights, share)))
    out = ["size", "source_size", "target", "rate", "copies", "taken"]
    mine = {c: f"__{c}" for c in ("key", "n", "u")}
    rows = docs.drop(*out).withColumns({mine["key"]: shape[1], mine["n"]: shape[2], mine["u"]: shape[3]})
    if n_alike:
        rows = _numbered(rows, alike, key, n_alike <= BROADCAST)
    lam = state.select(F.col("key").alias(mine["key"]), F.col("source_size").alias("__s"),
                       F.col("target").alias("__t"), F.col("lam").alias("__lam"))
    n, r = F.col(mine["n"]), _rate(F.col("__lam"), F.col(mine["n"]))
    copies = F.when(n == 0, F.lit(1)).otherwise(F.floor(r + F.col(mine["u"]))).cast("long")
    return (rows.join(lam, mine["key"], "left")
            .withColumns({"size": n, "source_size": F.col("__s"), "target": F.col("__t"), "rate": r, "copies": copies})
            .withColumn("taken", F.col("copies") * F.col("size"))
            .select(*[c for c in docs.columns if c not in out], *out))


def repeat_rows(mixed: DataFrame) -> DataFrame:
    """One row for each copy."""
    return mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.lit(CAP)))).filter("__copy <= copies").drop("__copy")
