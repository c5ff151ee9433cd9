"""Catalog, sinks and persistence helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kept import cached
from .snapshots import Snapshots

__all__ = ["materialize", "load", "list_tables", "preview", "row_count", "finished", "ensure_built", "cached",
           "save_model", "load_model"]

#: The one part of a folder that holds a single table.
TABLE = "table"


def materialize(df: DataFrame, name: str, path: str | None = None,
                fmt: str = "parquet") -> DataFrame:
    """A4: create-or-replace a table and return a DataFrame that reads it.

    With ``path`` the data goes to a new version in that (shared) folder,
    which becomes the table by one rename (``Snapshots``): readers see the old
    table or the new one, a write that fails leaves the old one, and ``df``
    may read the table it replaces. A temp view of the written files is
    registered. Without ``path`` a managed table is (re)written with
    ``saveAsTable``. Reading back cuts the lineage.
    """
    spark = df.sparkSession
    if path:
        out = Snapshots(spark, path).replace(df, TABLE, fmt=fmt)
        out.createOrReplaceTempView(name)
        return out
    df.write.mode("overwrite").format(fmt).saveAsTable(name)
    return spark.table(name)


def load(spark: SparkSession, name: str, path: str | None = None,
         fmt: str = "parquet") -> DataFrame:
    """A5: read a whole table (by catalog name, or by path: the current
    version of a folder that ``materialize`` wrote, or a plain folder)."""
    if path:
        snapshots = Snapshots(spark, path)
        if snapshots.versions():
            return snapshots.read(TABLE)
        return spark.read.format(fmt).load(path)
    return spark.table(name)


def list_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    """The catalog's tables and views as a DataFrame (``SHOW TABLES``)."""
    if database:
        return spark.sql(f"SHOW TABLES IN {database}")
    return spark.sql("SHOW TABLES")


def preview(df: DataFrame, n: int = 3, key: str = "customer_id") -> DataFrame:
    """First ``n`` rows in key order (TakeOrderedAndProject: a per-task
    top-n, then a merge of ``#tasks x n`` rows)."""
    return df.orderBy(key).limit(n)


def row_count(df: DataFrame) -> DataFrame:
    """The row count as a one-row DataFrame."""
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def _folder(spark: SparkSession, path: str):
    jvm = spark._jvm.org.apache.hadoop.fs
    folder = jvm.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def finished(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` holds a table written to its end (``_SUCCESS``); any
    error of the file system is raised."""
    fs, folder = _folder(spark, path)
    return fs.exists(spark._jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS"))


def ensure_built(spark: SparkSession, name: str, build: Callable[[], DataFrame],
                 path: str | None = None) -> DataFrame:
    """Build and store a table only when it does not exist yet.

    A folder counts as built with a published version, or as a plain folder
    with a ``_SUCCESS`` marker; one that holds anything else but versions that
    were never published is an error and never overwritten, and so is a
    folder that cannot be read."""
    if path:
        if Snapshots(spark, path).versions():
            return load(spark, name, path)
        if finished(spark, path):
            return spark.read.parquet(path)
        fs, folder = _folder(spark, path)
        if fs.exists(folder) and any(s.getPath().getName() not in ("_versions", "_manifests") for s in fs.listStatus(folder)):
            raise FileExistsError(f"{path} is not empty and not a finished table")
        return materialize(build(), name, path=path)
    if spark.catalog.tableExists(name):
        return spark.table(name)
    return materialize(build(), name)


def save_model(model, path: str) -> str:
    """Persist a fitted Spark ML model or pipeline (feature order lives
    in its ``VectorAssembler`` stage)."""
    model.write().overwrite().save(path)
    return path


def load_model(path: str):
    """Load a model written by :func:`save_model`."""
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)
