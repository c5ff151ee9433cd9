"""Atomic replacement of tables and sets (A4, A9, A10) and the release of
what is kept (A11)."""

import pytest
from pyspark.sql import functions as F

from riskweave.operators import portfolio as P
from riskweave.operators import profile as D
from riskweave.plans import build as B
from riskweave.plans import registry as R
from riskweave.sources import catalog as C
from riskweave.sources import kept
from riskweave.sources.fixture import raw_loans
from riskweave.sources.snapshots import Conflict, Snapshots, source_signature


def test_a_killed_write_leaves_the_old_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    C.materialize(spark.range(5).toDF("x"), "t", path)

    def killed(self, *a):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(Snapshots, "publish", killed)  # after the write, before the rename
        with pytest.raises(KeyboardInterrupt):
            C.materialize(spark.range(9).toDF("x"), "t", path)
    assert len(list((tmp_path / "t" / "_versions").iterdir())) == 2
    assert C.load(spark, "t", path).count() == 5
    assert C.ensure_built(spark, "t", lambda: spark.range(1).toDF("x"), path).count() == 5
    with pytest.raises(Exception):  # a failing task: the write itself dies
        C.materialize(spark.range(9).select(F.raise_error(F.lit("lost")).alias("x")), "t", path)
    assert C.load(spark, "t", path).count() == 5


def test_first_write_that_dies_is_built_again(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    with monkeypatch.context() as m:
        m.setattr(Snapshots, "publish", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            C.ensure_built(spark, "t", lambda: spark.range(3).toDF("x"), path)
    assert C.ensure_built(spark, "t", lambda: spark.range(4).toDF("x"), path).count() == 4


def test_a_table_may_be_made_from_its_old_version_and_readers_keep_theirs(spark, tmp_path):
    path = str(tmp_path / "t")
    old = C.materialize(spark.range(5).toDF("x"), "t", path)
    new = C.materialize(old.selectExpr("x + 100 as x", "'n' as y"), "t", path)
    assert sorted(r.x for r in old.collect()) == list(range(5))
    assert sorted(r.x for r in new.collect()) == list(range(100, 105)) and C.load(spark, "t", path).columns == ["x", "y"]
    snapshots = Snapshots(spark, path)
    assert snapshots.versions() == [1, 2] and snapshots.read("table", 1).columns == ["x"]
    assert snapshots.drop_old() == []  # too young
    assert len(snapshots.drop_old(min_age=0)) == 1 and snapshots.versions() == [2]
    assert C.load(spark, "t", path).count() == 5


def test_two_writers_do_not_lose_a_table(spark, tmp_path):
    snapshots = Snapshots(spark, str(tmp_path / "set"))
    held = snapshots.manifest()
    first, second = (snapshots.write(spark.range(n).toDF("x"), name) for n, name in ((1, "a"), (2, "b")))
    snapshots.publish({"a": first}, held["version"])
    with pytest.raises(Conflict):
        snapshots.publish({"b": second}, held["version"])
    assert list(snapshots.manifest()["parts"]) == ["a"]


def _copy(spark, sf, folder):
    for name in ("orders", "lineitem"):
        spark.read.parquet(f"{sf}/{name}.parquet").coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return raw_loans(spark, folder)


def test_only_stale_layers_are_built_and_failures_publish_nothing(spark, sf, tmp_path, monkeypatch):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    raw = _copy(spark, sf, source)
    B.build_pipeline(raw, path, trees=2)
    snapshots = Snapshots(spark, path)
    first = snapshots.manifest()
    calls = []
    trained = B.train_and_score

    def training(risk, trees):
        calls.append(trees)
        return trained(risk, trees=trees)

    # nothing is stale: nothing is written
    monkeypatch.setattr(B, "train_and_score", training)
    B.ensure_pipeline(raw, path, trees=2)
    assert snapshots.manifest() == first and not calls
    # another parameter: the models and their scores alone
    B.ensure_pipeline(raw, path, trees=3)
    second = snapshots.manifest()
    changed = {n for n, e in second["parts"].items() if e != first["parts"][n]}
    assert changed == {"lr_model", "gbt_model", "model_scores"} and calls == [3]
    # a rebuild that fails while it trains: the old set stays whole
    assert source_signature(raw) == source_signature(raw_loans(spark, source))
    spark.read.parquet(f"{sf}/orders.parquet").filter("o_orderkey < 1000").coalesce(1).write.mode("overwrite").parquet(f"{source}/orders.parquet")
    fewer = raw_loans(spark, source)
    with monkeypatch.context() as m:
        m.setattr(B, "train_and_score", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            B.ensure_pipeline(fewer, path, trees=3)
    assert snapshots.manifest() == second
    assert B.load_pipeline(spark, path)["clean_loans"].count() == R.clean(spark, sf).count()
    # a changed input: every layer
    built = B.ensure_pipeline(fewer, path, trees=3)
    assert built["clean_loans"].count() < R.clean(spark, sf).count()
    assert all(e != second["parts"][n] for n, e in snapshots.manifest()["parts"].items())


def _nothing_cached(spark):
    return spark._jsc.getPersistentRDDs().isEmpty() and spark._jsparkSession.sharedState().cacheManager().isEmpty()


def test_a_scope_releases_all_it_kept(spark, sf, tmp_path, monkeypatch):
    spark.catalog.clearCache()
    monkeypatch.setattr(R, "_FIT_CACHE", {})  # models that other tests fitted are theirs
    risk, raw = R.risk(spark, sf), raw_loans(spark, sf)
    folder = str(tmp_path / "between")
    with kept.scope(spark):
        for tables in (P.dashboard_tables(risk), P.dashboard_histograms(risk), D.profile_tables(raw)):
            for df in tables.values():
                df.collect()
        raw.write.parquet(kept.kept_folder(spark, folder))
        R.fitted(spark, sf, trees=2)
        assert not _nothing_cached(spark) and (spark.sparkContext.applicationId, sf, 2) in R._FIT_CACHE
    assert _nothing_cached(spark) and not (tmp_path / "between").exists()
    assert (spark.sparkContext.applicationId, sf, 2) not in R._FIT_CACHE


def test_a_scope_ends_with_an_error_and_nests(spark):
    spark.catalog.clearCache()
    with pytest.raises(ValueError):
        with kept.scope(spark):
            outer = kept.cached(spark.range(5))
            with kept.scope(spark):
                kept.cached(spark.range(7)).count()
            assert outer.count() == 5 and outer.is_cached and not _nothing_cached(spark)
            raise ValueError
    assert _nothing_cached(spark)
