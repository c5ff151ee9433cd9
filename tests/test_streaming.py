"""The applicant-scoring stream gives the same rows as the batch transform."""

import os
import tempfile

import pytest

from riskweave.operators import layers as L
from riskweave.plans import registry as R
from riskweave.streaming import scoring
from riskweave.streaming.scoring import APPLICANT_SCHEMA, score_frame, start_scoring_batches, start_scoring_stream


def test_stream_matches_batch(spark, sf):
    f = R.fitted(spark, sf, trees=10)
    apps = L.require_age(R.clean(spark, sf)).select(*[c.name for c in APPLICANT_SCHEMA])
    d = tempfile.mkdtemp(prefix="rw-stream-", dir="/tmp")
    src, sink, ckpt = (os.path.join(d, x) for x in ("in", "out", "ckpt"))
    apps.repartition(3).write.parquet(src)
    q = start_scoring_stream(spark, src, sink, ckpt, f["lr"], f["gbt"], available_now=True)
    q.awaitTermination(300)
    assert q.exception() is None
    got = spark.read.parquet(sink)
    batch = score_frame(spark.read.schema(APPLICANT_SCHEMA).parquet(src), f["lr"], f["gbt"])
    key = lambda r: r.customer_id
    a = sorted(((r.customer_id, r.pd_score_xgb, r.expected_loss) for r in got.collect()), key=lambda t: t[0])
    b = sorted(((r.customer_id, r.pd_score_xgb, r.expected_loss) for r in batch.collect()), key=lambda t: t[0])
    assert len(a) == apps.count()
    assert [x[0] for x in a] == [x[0] for x in b]
    for x, y in zip(a, b):
        assert x[1] == pytest.approx(y[1]) and x[2] == pytest.approx(y[2])


def test_a_stopped_stream_finds_every_applicant_once(spark, sf, tmp_path, monkeypatch):
    """It stops while the second batch is half written, and is started again."""
    f = R.fitted(spark, sf, trees=10)
    apps = R.raw(spark, sf).select(*[c.name for c in APPLICANT_SCHEMA])
    src, sink, rejects, ckpt = (str(tmp_path / x) for x in ("in", "out", "rejects", "ckpt"))
    apps.repartition(4).write.parquet(src)
    start = lambda: start_scoring_batches(spark, src, sink, rejects, ckpt, f["lr"], f["gbt"], available_now=True, max_files_per_trigger=1)
    whole = scoring.write_batch

    def dies(df, batch_id, sink_dir, rejects_dir):
        whole(df.limit(10) if batch_id == 1 else df, batch_id, sink_dir, rejects_dir)
        if batch_id == 1:
            raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(scoring, "write_batch", dies)
        query = start()
        with pytest.raises(Exception):
            query.awaitTermination(300)
    assert spark.read.parquet(sink).select("batch_id").distinct().count() == 2
    query = start()
    query.awaitTermination(300)
    assert query.exception() is None
    scored, rejected = spark.read.parquet(sink), spark.read.parquet(rejects)
    ids = sorted(r.customer_id for df in (scored, rejected) for r in df.select("customer_id").collect())
    assert ids == sorted(r.customer_id for r in apps.select("customer_id").collect())
    assert rejected.count() > 0 and rejected.filter("reject_reason is null").isEmpty()
    assert scored.filter("pd_score_xgb is null").isEmpty() and scored.select("batch_id").distinct().count() == 4
