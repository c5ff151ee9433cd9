"""Applicant scoring as a Structured Streaming job.

The lookup form of the reference scores one applicant at a time; here new
applicant files arriving in a folder are scored as they land. Every step
(engineered features, both model transforms, segment, flags, expected loss)
is row-local, so the stream needs no state, no watermark and no shuffle. An
applicant without an input comes out with ``reject_reason`` and no score. The
checkpoint folder gives exactly-once output to the file sink and lets a
restarted job resume after the last committed batch.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.applicants import APPLICANT_INPUTS, applicant_features, assess, score_applicants
from ..sources.kept import cached, scope

# Input record of one applicant: a key plus the ten form inputs.
APPLICANT_SCHEMA = T.StructType(
    [T.StructField("customer_id", T.LongType(), False)]
    + [T.StructField(c, T.DoubleType() if c in ("monthly_income", "num_dependents",
                                                "revolving_util", "debt_ratio")
                     else T.LongType(), True) for c in APPLICANT_INPUTS])

OUTPUT_COLUMNS = ["customer_id", "pd_score_lr", "pd_score_xgb", "pd_segment", "vs_portfolio",
                  "gap_pct_points", "risk_flags", "exposure_at_default", "expected_loss",
                  "reject_reason"]


def score_frame(applicants: DataFrame, lr: PipelineModel, gbt: PipelineModel) -> DataFrame:
    """The scoring transformation; works on batch and streaming frames."""
    scored = assess(score_applicants(applicant_features(applicants), lr, gbt))
    return scored.select(*OUTPUT_COLUMNS)


def write_batch(scored: DataFrame, batch_id: int, sink_dir: str, rejects_dir: str) -> None:
    """One micro-batch: scored applicants to ``sink_dir``, those without an
    input to ``rejects_dir`` with their reason, each in a folder named by the
    batch. A batch that ran before, whole or in part, replaces its folders, so
    a restart leaves every applicant once. The batch is computed once and kept
    for both writes."""
    with scope(scored.sparkSession):
        kept = cached(scored)
        rejected = F.col("reject_reason").isNotNull()
        for rows, folder in ((kept.filter(~rejected).drop("reject_reason"), sink_dir),
                             (kept.filter(rejected).select("customer_id", "reject_reason"), rejects_dir)):
            rows.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/batch_id={batch_id}")


def start_scoring_batches(spark: SparkSession, source_dir: str, sink_dir: str, rejects_dir: str,
                          checkpoint_dir: str, lr: PipelineModel, gbt: PipelineModel,
                          available_now: bool = False, max_files_per_trigger: int | None = None,
                          processing_time: str = "30 seconds") -> StreamingQuery:
    """L2: the scoring stream with two outputs, restartable by batch id
    (``write_batch``). The checkpoint records which files a batch holds, so a
    batch that is repeated after a stop has the same applicants. All three
    folders must be shared on a cluster. Readers see ``batch_id`` as a
    partition column."""
    reader = spark.readStream.schema(APPLICANT_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    writer = (score_frame(reader.parquet(source_dir), lr, gbt).writeStream
              .foreachBatch(lambda df, batch_id: write_batch(df, batch_id, sink_dir, rejects_dir))
              .option("checkpointLocation", checkpoint_dir).outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=processing_time)
    return writer.start()


def start_scoring_stream(spark: SparkSession, source_dir: str, sink_dir: str,
                         checkpoint_dir: str, lr: PipelineModel, gbt: PipelineModel,
                         available_now: bool = False, max_files_per_trigger: int | None = None,
                         processing_time: str = "30 seconds") -> StreamingQuery:
    """Read applicant Parquet files from ``source_dir`` as they arrive and
    append scored rows to ``sink_dir``. ``checkpoint_dir`` must be a shared
    folder on a cluster. ``available_now`` processes what is there and stops."""
    reader = spark.readStream.schema(APPLICANT_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    stream = reader.parquet(source_dir)
    writer = (score_frame(stream, lr, gbt).writeStream.format("parquet")
              .option("path", sink_dir).option("checkpointLocation", checkpoint_dir)
              .outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now \
        else writer.trigger(processingTime=processing_time)
    return writer.start()
