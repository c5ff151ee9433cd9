"""A corpus pipeline of five operators, each stage's output written as Parquet
and read again as the next one's input.

The stages return the columns of ``documents`` (the last adds ``slot`` and
``shard``). Null texts, empty tables, repeated rows and extra columns pass as
the operators define, and columns called like an operator's output keep their
values; rows without id, and rows that share one, are told apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import decontaminate as decontamination
from riskweave.llm import mixing, sharding, simhash
from riskweave.llm import toxicity as toxic
from riskweave.llm.common import keep, under_own_names


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine, fitted on the labelled ones, scores at or
    above its threshold go."""
    model = toxic.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))
    return under_own_names(docs, lambda rows, at: toxic.score(rows, model, at["text"]).filter("predicted = 0"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group one row stays, that with the smallest id."""
    return simhash.survivors(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark spans are cut out, and documents that are mostly benchmark go."""
    clean = decontamination.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, kept or left out so that the sources meet their targets."""
    return under_own_names(docs, lambda rows, at: mixing.repeat_rows(mixing.mix(rows, at["text"], at["source"], at["doc_id"])))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard."""
    return sharding.shard(docs)


STAGES = [("toxicity", toxicity), ("near duplicates", near_duplicates), ("decontamination", decontaminate),
          ("mixing", mix), ("sharding", shard)]

#: Fitted models, XXH64 and Newton steps are no SQL; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
