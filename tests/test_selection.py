"""The shared quantile selection: exact on awkward columns, and three scans
for all reports."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.operators import profile as D
from riskweave.operators import selection as S
from riskweave.sources import kept
from riskweave.sources.fixture import raw_loans

PROBS = (0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0)


def _quantiles(df, accuracy, by=None):
    targets = [S.Target("a", F.col("a"), by and F.col(by)), S.Target("b", F.col("b"))]
    return {(r._t, r._g): r for r in S.select_quantiles(df, targets, PROBS, accuracy=accuracy).collect()}


@pytest.mark.parametrize("accuracy", [20, 400, 50_000])
def test_quantiles_are_exact_for_any_accuracy(spark, accuracy):
    rng = np.random.default_rng(accuracy)
    a = np.where(rng.random(6000) < 0.35, 7.0, rng.normal(0, 100, 6000).round(2))  # a value in a third of the rows
    b = rng.integers(0, 4, 6000).astype(float)
    rows = [(float(x), None if i % 9 == 0 else float(y), None if i % 5 == 0 else i % 3) for i, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "a double, b double, g int").repartition(7)
    got = _quantiles(df, accuracy, "g")
    for g in (None, 0, 1, 2):
        want = np.quantile([r[0] for r in rows if r[2] == g], PROBS)
        assert got[0, None if g is None else str(g)].q == pytest.approx(list(want), abs=1e-9)
    found = got[1, ""]
    assert found.n == sum(r[1] is not None for r in rows)
    assert found.q == pytest.approx(list(np.quantile([r[1] for r in rows if r[1] is not None], PROBS)))


@pytest.mark.parametrize("n", [1, 2, 3, 11, 12, 41, 100, 101])
def test_quantiles_of_few_values(spark, n):
    df = spark.range(n).selectExpr("cast(id * id as double) a", "cast(null as double) b")
    got = _quantiles(df, 20)
    assert got[0, ""].q == pytest.approx(list(np.quantile(np.arange(n) ** 2, PROBS)))
    assert got[1, ""].n == 0 and got[1, ""].q is None


def test_empty_tables(spark):
    df = spark.range(0).selectExpr("cast(id as double) a", "cast(id as double) b")
    assert _quantiles(df, 20) == {}


def test_many_groups_are_joined_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(S, "MAX_GROUPS", 3)
    df = spark.range(3000).selectExpr("cast(id as double) a", "cast(id as double) b", "id % 10 as g")
    got = _quantiles(df, 50, "g")
    for g in range(10):
        assert got[0, str(g)].q == pytest.approx(list(np.quantile(np.arange(g, 3000, 10), PROBS)))


def test_reports_of_an_empty_table(spark, sf):
    raw = raw_loans(spark, sf).limit(0)
    tables = {name: df.collect() for name, df in D.profile_reports(raw).items()}
    assert tables["age_sanity"][0].n_age_zero == 0 and tables["income_sanity"][0]["count"] == 0
    assert tables["describe"] == tables["box_stats"] == tables["cut_pivot"] == []


def test_all_reports_take_three_scans(spark, sf, tmp_path):
    """Records read from the raw table by all jobs of the bundle."""
    path = str(tmp_path / "raw")
    raw_loans(spark, sf).repartition(4).write.parquet(path)
    raw = spark.read.parquet(path)
    n = raw.count()
    counter = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            counter.add(batch.num_rows)
            yield batch

    counted = raw.mapInArrow(count, raw.schema)
    with kept.scope(spark):
        tables = {name: df.collect() for name, df in D.profile_reports(counted).items()}
    assert set(tables) == set(D.REPORTS) and all(tables.values())
    assert counter.value <= 3 * n
    with kept.scope(spark):
        alone = {name: D.profile_reports(raw, [name])[name].collect() for name in D.REPORTS}
    assert {k: sorted(map(str, v)) for k, v in alone.items()} == {k: sorted(map(str, v)) for k, v in tables.items()}
