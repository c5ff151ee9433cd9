"""What is kept between queries, and its release.

Tables kept in memory, folders of intermediate results and fitted models that
are held for later queries are entered in the innermost open ``scope``; when
it ends, also by an error, all of them are released, the last first:

    with scope(spark):
        tables = dashboard_tables(risk)
        ...

Without an open scope they stay until the session ends, as before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir

_SCOPE: ContextVar["Scope | None"] = ContextVar("riskweave_scope", default=None)


class Scope:
    """The entries of one scope."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._releases: list[Callable[[], object]] = []

    def add(self, release: Callable[[], object]) -> None:
        self._releases.append(release)

    def release(self) -> None:
        """Release all entries; the first error is raised when all were tried."""
        errors = []
        while self._releases:
            try:
                self._releases.pop()()
            except Exception as e:  # the others are released all the same
                errors.append(e)
        if errors:
            raise errors[0]


@contextmanager
def scope(spark: SparkSession) -> Iterator[Scope]:
    """Everything kept inside is released at the end. Scopes nest; threads
    started inside do not see the scope."""
    held = Scope(spark)
    token = _SCOPE.set(held)
    try:
        yield held
    finally:
        _SCOPE.reset(token)
        held.release()


def on_release(release: Callable[[], object]) -> None:
    """Call ``release`` when the open scope ends (never, without one)."""
    held = _SCOPE.get()
    if held is not None:
        held.add(release)


def cached(df: DataFrame) -> DataFrame:
    """Keep a table that several consumers read (memory, spill to disk;
    a lost block is recomputed from lineage) until the open scope ends."""
    out = df.persist(StorageLevel.MEMORY_AND_DISK)
    on_release(lambda: out.unpersist(blocking=True))
    return out


def kept_folder(spark: SparkSession, path: str) -> str:
    """Delete the folder ``path`` of an intermediate result when the open
    scope ends. Frames that read it cannot be used after that."""
    def delete():
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    on_release(delete)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """Keep a table that many small jobs read in ``spark.checkpoint.dir``, its
    partitions and their order as they are: unlike a cached table, it brings
    no lineage into their tasks. Its folder is deleted when the open scope ends."""
    ensure_checkpoint_dir(df.sparkSession)
    out = df.checkpoint()
    kept_folder(df.sparkSession, out._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get())
    return out
