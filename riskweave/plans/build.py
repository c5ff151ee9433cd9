"""A10: the layer graph raw -> clean -> features -> segments -> summary.

Function composition over DataFrames; Catalyst fuses the row layers into one
scan-filter-project stage. Only ``risk_segments`` is reused by several
consumers (summary, charts, model frame), so it is the one table that is
kept: persisted by default, or written as Parquet under a shared folder when
``materialize_to`` is given (which also cuts the lineage, so a lost executor
recomputes from the written table instead of from the raw scan).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.layers import clean_loans, feature_engineering, risk_segments
from ..operators.portfolio import portfolio_summary
from ..operators import model as M
from ..operators.prefix import global_row_number
from ..sources.catalog import load_model, materialize, save_model
from ..sources.kept import cached, scope
from ..sources.snapshots import Snapshots, signature, source_signature

LAYER_ORDER = ("raw_loans", "clean_loans", "feature_engineering", "risk_segments",
               "portfolio_summary")


def build_all(raw: DataFrame, keep_null_age: bool = False, with_row_num: bool = True,
              persist: bool = True, materialize_to: str | None = None) -> dict[str, DataFrame]:
    """Run every layer in dependency order; returns ``name -> DataFrame``.

    The segments table is computed once without the row number and kept;
    the summary reads it directly. ``row_num`` (a global order) is then
    added on top of the kept table, so its quantile sketch and its shuffle
    read the stored rows instead of re-running the scans and the join.
    """
    clean = clean_loans(raw)
    features0 = feature_engineering(clean, keep_null_age=keep_null_age, with_row_num=False)
    risk0 = risk_segments(features0)
    if materialize_to:
        name = "risk_segments_base" if with_row_num else "risk_segments"
        risk0 = materialize(risk0, name, path=f"{materialize_to.rstrip('/')}/{name}")
    elif persist:
        risk0 = cached(risk0)
    summary = portfolio_summary(risk0)
    if with_row_num:
        numbered = global_row_number(risk0, "customer_id", "row_num")
        feature_cols = [*features0.columns, "row_num"]
        features = numbered.select(*feature_cols)
        risk = numbered.select(*feature_cols, "rule_risk_score", "risk_segment")
    else:
        features, risk = risk0.select(*features0.columns), risk0
    if materialize_to and with_row_num:
        risk = materialize(risk, "risk_segments",
                           path=f"{materialize_to.rstrip('/')}/risk_segments")
    return {"raw_loans": raw, "clean_loans": clean, "feature_engineering": features,
            "risk_segments": risk, "portfolio_summary": summary,
            "risk_segments_unnumbered": risk0}


def train_and_score(risk: DataFrame, trees: int = M.GBT_TREES) -> dict:
    """The model frame and its report, the split, both
    models fitted on the train rows and the scored test rows."""
    frame, report = M.model_frame(risk)
    # the split counts the frame before it marks the rows: keep it once
    frame = M.cached_frame(frame)
    split = M.cached_frame(M.stratified_split(frame))
    train, test = (split.filter(F.col("split") == name) for name in ("train", "test"))
    lr, gbt = M.fit_models(M.training_rows(train), trees=trees)
    scores = M.cached_frame(M.score_table(test, lr, gbt))
    return dict(report=report, frame=frame, split=split, train=train, test=test, lr=lr, gbt=gbt,
                scores=scores)


BUILT_TABLES = ("clean_loans", "feature_engineering", "risk_segments", "portfolio_summary",
                "model_scores")
BUILT_MODELS = ("lr_model", "gbt_model")
#: Raised when the rules of a layer change, so that stored layers become stale.
BUILD_VERSION = 1


def layer_signatures(source: str, trees: int) -> dict[str, str]:
    """The signature of every part: its name, its parameters and the
    signatures of what it is built from, down to the source's."""
    clean = signature("clean_loans", BUILD_VERSION, source)
    risk = signature("risk_segments", clean)
    fitted = signature("models", risk, trees, M.SEED)
    return {"clean_loans": clean, "risk_segments": risk, "feature_engineering": signature("feature_engineering", risk),
            "portfolio_summary": signature("portfolio_summary", risk),
            **{name: signature(name, fitted) for name in ("model_scores", *BUILT_MODELS)}}


def stale_parts(snapshots: Snapshots, wanted: dict[str, str]) -> list[str]:
    """The parts that the current set lacks, holds unfinished, or holds from
    other inputs or parameters."""
    held = snapshots.manifest()["parts"]
    return [name for name, want in wanted.items()
            if held.get(name, {}).get("signature") != want or not snapshots.finished(held[name])]


def build_pipeline(raw: DataFrame, path: str, trees: int = M.GBT_TREES, source: str | None = None) -> dict:
    """The whole build as one call: every layer, the scored test rows
    (``model_scores``) and both fitted models below ``path``, a folder all
    executors share. Returns what ``load_pipeline`` does.

    Only stale parts are built. All parts are published as one set by one
    rename at the end (``Snapshots``): a build that fails leaves the set that
    was there, and tables and models of two builds never mix. ``source`` is
    the signature of ``raw``; by default it is that of the files it reads, and
    a frame that reads none is taken as changed."""
    spark, snapshots = raw.sparkSession, Snapshots(raw.sparkSession, path)
    wanted = layer_signatures(source or source_signature(raw) or uuid.uuid4().hex, trees)
    held = snapshots.manifest()
    parts = {name: e for name, e in held["parts"].items() if name in wanted}
    stale = stale_parts(snapshots, wanted)

    def table(name: str, build) -> DataFrame:
        if name in stale:
            parts[name] = snapshots.write(build(), name, wanted[name])
        return snapshots.read_entry(parts[name])

    clean = table("clean_loans", lambda: clean_loans(raw))

    def numbered() -> DataFrame:
        # the unnumbered rows are written first: numbering reads them twice
        base = snapshots.write(risk_segments(feature_engineering(clean, with_row_num=False)), "risk_segments_base")
        rows = global_row_number(snapshots.read_entry(base), "customer_id", "row_num")
        last = ("rule_risk_score", "risk_segment")
        return rows.select(*[c for c in rows.columns if c not in last], *last)

    risk = table("risk_segments", numbered)
    table("feature_engineering", lambda: risk.drop("rule_risk_score", "risk_segment"))
    table("portfolio_summary", lambda: portfolio_summary(risk))
    if {"model_scores", *BUILT_MODELS} & set(stale):
        with scope(spark):
            fitted = train_and_score(risk, trees=trees)
            for name, model in (("lr_model", fitted["lr"]), ("gbt_model", fitted["gbt"])):
                folder = snapshots.stage(name)
                save_model(model, folder)
                parts[name] = {"folder": folder[len(snapshots.root) + 1:], "kind": "model", "signature": wanted[name]}
            parts["model_scores"] = snapshots.write(fitted["scores"], "model_scores", wanted["model_scores"])
    if stale:
        snapshots.publish(parts, held["version"])
    return load_pipeline(spark, path)


def load_pipeline(spark: SparkSession, path: str) -> dict:
    """The tables and models of the set that ``build_pipeline`` published last."""
    snapshots = Snapshots(spark, path)
    parts = snapshots.manifest()["parts"]
    missing = [name for name in (*BUILT_TABLES, *BUILT_MODELS) if name not in parts]
    if missing:
        raise FileNotFoundError(f"{path} holds no complete build: {', '.join(missing)} missing")
    return {**{t: snapshots.read_entry(parts[t]) for t in BUILT_TABLES},
            **{m: load_model(snapshots.folder(parts[m])) for m in BUILT_MODELS}}


def ensure_pipeline(raw: DataFrame, path: str, trees: int = M.GBT_TREES, source: str | None = None) -> dict:
    """Load the whole set, or build what is stale in it first. A part that
    cannot be looked up is an error, not a missing part."""
    source = source or source_signature(raw)
    if source and not stale_parts(Snapshots(raw.sparkSession, path), layer_signatures(source, trees)):
        return load_pipeline(raw.sparkSession, path)
    return build_pipeline(raw, path, trees, source)
