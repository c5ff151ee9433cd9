"""Model fits on the smallest data set with few trees: quality above chance,
valid probabilities, deterministic scores, scaler properties, persistence."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from riskweave.operators import evaluate as EV
from riskweave.operators import model as M
from riskweave.plans import registry as R
from riskweave.sources.catalog import load_model, save_model


@pytest.fixture(scope="module")
def fitted(spark, sf):
    return R.fitted(spark, sf, trees=10)


def test_models_rank_better_than_chance(fitted):
    m = {r.model: r for r in fitted["metrics"].collect()}
    assert m["Logistic Regression"].auc > 0.65
    assert m["Gradient Boosted Trees"].auc > 0.65
    for r in m.values():
        assert r.gini == pytest.approx(2 * r.auc - 1)


def test_scores_are_probabilities_and_repeatable(spark, sf, fitted):
    s = fitted["scores"]
    bad = s.filter((F.col("pd_score_lr") < 0) | (F.col("pd_score_lr") > 1)
                   | (F.col("pd_score_xgb") < 0) | (F.col("pd_score_xgb") > 1)).count()
    assert bad == 0
    assert s.count() == fitted["test"].count()
    again = M.fit_gbt(fitted["train"], trees=10)
    a = sorted((r.customer_id, r.pd_score_xgb) for r in s.collect())
    b = sorted((r.customer_id, r.pd_score_xgb) for r in
               M.score_table(fitted["test"], fitted["lr"], again).collect())
    assert a == b


def test_scaled_train_features_have_zero_mean_unit_std(fitted):
    scaler = M.fit_scaler(fitted["train"])
    out = scaler.transform(fitted["train"])
    stats = out.agg(F.avg("age_scaled").alias("m"), F.stddev_pop("age_scaled").alias("s")).first()
    assert stats.m == pytest.approx(0.0, abs=1e-9)
    assert stats.s == pytest.approx(1.0, abs=1e-9)


def test_feature_importance_and_comparison(fitted):
    imp = M.feature_importance(fitted["gbt"]).collect()
    assert len(imp) == 16 and sum(r.importance for r in imp) == pytest.approx(1.0)
    assert [r.importance for r in imp] == sorted((r.importance for r in imp), reverse=True)
    comp = EV.model_comparison(fitted["metrics"]).collect()
    assert len(comp) == 5


def test_pipeline_models_round_trip(spark, fitted):
    d = tempfile.mkdtemp(prefix="rw-model-", dir="/tmp")
    path = save_model(fitted["gbt"], os.path.join(d, "gbt"))
    back = load_model(path)
    a = sorted(r.pd_score_xgb for r in M.score_table(fitted["test"], fitted["lr"],
                                                         fitted["gbt"]).collect())
    b = sorted(r.pd_score_xgb for r in M.score_table(fitted["test"], fitted["lr"], back).collect())
    assert a == b


def test_logistic_fit_is_the_newton_optimum(spark, fitted):
    from riskweave.operators.newton import logistic_gradient, newton_logistic
    train = fitted["train"]
    best = newton_logistic(train)
    got = {r.term: r.coefficient for r in M.lr_coefficients(fitted["lr"]).collect()}
    for term, value in zip(["intercept", *M.FEATURES], best):
        assert got[term] == pytest.approx(value, abs=5e-6), term  # the fit's own limit
    assert all(abs(r.gradient) < 1e-6 for r in logistic_gradient(train, best).collect())


def test_reduced_roc_stays_within_its_error(spark, fitted):
    import numpy as np
    for cells in (10, 50):
        whole = EV.roc_curve(fitted["scores"], "is_default", "pd_score_xgb", drop_intermediate=False).toPandas().sort_values("threshold", ascending=False)
        few = EV.roc_curve_reduced(fitted["scores"], "is_default", "pd_score_xgb", cells=cells).toPandas().sort_values("threshold", ascending=False)
        assert len(few) <= 2 * cells + 2 < len(whole)
        at = np.searchsorted(-few.threshold.to_numpy(), -whole.threshold.to_numpy(), "right") - 1
        for rate in ("fpr", "tpr"):
            assert np.abs(whole[rate].to_numpy() - few[rate].to_numpy()[at]).max() <= 1 / cells
        assert few[["fpr", "tpr"]].iloc[-1].tolist() == [1, 1] and few[["fpr", "tpr"]].iloc[0].tolist() == [0, 0]


def test_row_numbers_take_as_many_buckets_as_the_input_asks_for(spark, sf, monkeypatch):
    from riskweave.operators import prefix
    raw = R.raw(spark, sf)
    assert prefix.buckets_for(raw) == prefix.FEWEST_BUCKETS
    monkeypatch.setattr(prefix, "BUCKET_BYTES", 300)
    assert prefix.FEWEST_BUCKETS < prefix.buckets_for(raw) <= prefix.MOST_BUCKETS
    rows = prefix.global_row_number(raw.select("customer_id"), "customer_id").collect()
    assert sorted((r.customer_id, r.row_num) for r in rows) == [(r.customer_id, i) for i, r in enumerate(sorted(rows, key=lambda r: r.customer_id), 1)]


def test_fits_take_no_more_partitions_than_the_rows_need(spark):
    row = "id as customer_id, id % 2 as is_default, " + ", ".join(f"id * {i + 1} % 97 as {c}" for i, c in enumerate(M.FEATURES))
    wide = spark.range(0, 3000, 1, 64).selectExpr(*row.split(", "))
    narrow = spark.range(0, 50_000, 1, 1).selectExpr(*row.split(", "))
    cores = spark.sparkContext.defaultParallelism
    for train, parts in ((wide, 1), (narrow, min(cores, 3))):
        kept = M.training_rows(train)
        assert kept.rdd.getNumPartitions() == parts
        assert kept.exceptAll(train).isEmpty() and kept.count() == train.count()
        kept.unpersist()


def test_split_reads_one_kept_table(spark, sf):
    from riskweave.sources.kept import scope
    with scope(spark):
        for split in (R._split(spark, sf), R._test_rule_scored(spark, sf)):
            plan = split._jdf.queryExecution().withCachedData().toString()
            assert "InMemoryRelation" in plan
            assert not [x for x in plan.split("InMemoryRelation")[0].splitlines() if "Relation [" in x and "parquet" in x]


def test_fits_read_rows_without_lineage(spark, sf):
    import os
    from riskweave.sources.kept import scope
    with scope(spark):
        train = R._split(spark, sf).filter("split = 'train'")
        kept = M.training_rows(train)
        lineage = kept.rdd.toDebugString().decode()
        assert "ReliableCheckpointRDD" in lineage
        assert not [x for x in ("FileScanRDD", "ShuffledRowRDD", "InMemory") if x in lineage]
        assert kept.exceptAll(train).isEmpty() and kept.count() == train.count()
        folder = kept._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get().removeprefix("file:")
        assert os.path.isdir(folder)
    assert not os.path.exists(folder)


def test_a_fit_of_few_rows_has_few_stages_an_iteration(spark):
    # up to five partitions, an aggregate of the logistic fit takes two stages, not three
    row = "id as customer_id, id % 2 as is_default, " + ", ".join(f"id * {i + 1} % 97 as {c}" for i, c in enumerate(M.FEATURES))
    train = spark.range(0, 119_280, 1, 16).selectExpr(*row.split(", "))
    assert M.training_rows(train).rdd.getNumPartitions() <= 5


def test_compact_trees_are_those_of_spark(spark, fitted, monkeypatch, tmp_path):
    train = fitted["train"].repartition(3, M.KEY).sortWithinPartitions(M.KEY).checkpoint()
    monkeypatch.setattr(M, "COMPACT_ROWS", 1 << 60)
    want = M.fit_gbt(train, trees=12)
    monkeypatch.setattr(M, "COMPACT_ROWS", 0)
    got = M.fit_gbt(train, trees=12)
    assert all(t.uid.startswith("dtr-compact") for t in got.stages[-1].trees)
    got = load_model(save_model(got, str(tmp_path / "gbt")))
    assert [(t.depth, t.numNodes) for t in got.stages[-1].trees] == [(t.depth, t.numNodes) for t in want.stages[-1].trees]
    assert got.stages[-1].treeWeights == want.stages[-1].treeWeights
    a, b = (dict(m.transform(fitted["test"]).select(M.KEY, M.positive_probability("gbt_probability")).collect()) for m in (got, want))
    assert a.keys() == b.keys() and a == pytest.approx(b, abs=1e-12)


def test_random_lanes_join():
    from riskweave.operators import boosting
    x = boosting.uniforms(7, 100_000)
    assert x[:40].tolist() == boosting.uniforms(7, 40).tolist() and x[:3000].tolist() == boosting.uniforms(7, 3000).tolist()


def test_pass_of_a_block_is_that_of_its_rows():
    import numpy as np
    from riskweave.operators import boosting
    rng, n, n_bins = np.random.default_rng(5), 500, [7, 2, 30, 3]
    bins = np.stack([rng.integers(0, k, n).astype(np.uint8) for k in n_bins])
    label, weight, drawn = np.where(rng.random(n) < 0.3, 1.0, -1.0), rng.random(n), rng.random(n) < 0.8
    tree = boosting.Tree(4)
    tree.feature[[1, 3]], tree.last[[1, 3]] = [2, 0], [12, 3]
    node = np.where(bins[2] <= 12, 2, np.where(bins[0] <= 3, 6, 7))
    assert tree.nodes(bins).tolist() == node.tolist()
    block = (n, bins.tobytes(), label.astype(np.float32).tobytes(), weight.tobytes())
    got = boosting.sums([(block, (None, np.packbits(drawn).tobytes()))], tree, [7, 6, 2], n_bins)
    for i, of in enumerate([7, 6, 2]):
        for f, k in enumerate(n_bins):
            for b in range(k):
                rows = drawn & (node == of) & (bins[f] == b)
                assert got[i, f, b].tolist() == pytest.approx([weight[rows].sum(), (weight * label)[rows].sum(), weight[rows].sum(), rows.sum()])
