"""Sets of tables and models that change all at once.

Below a root folder every write goes to a new version folder of its own,
where no reader looks. A manifest then names the version folder of each part;
it is written beside the others and gets its number by one rename, which is
the moment at which the whole set changes. A writer that dies before leaves
the old set as it was, a reader keeps the folders it has opened, and old
versions are dropped later (``drop_old``).

    root/_manifests/0000000007    the current set is the largest number
    root/_versions/<part>-<id>    written once, never changed

The folders' names begin with an underscore, so a plain Parquet read of the
root finds nothing rather than a mixture of versions.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(RuntimeError):
    """Another writer published a set since this one was read."""


class Snapshots:
    """The current set below ``root``, a folder all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *below: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *[b for b in below if b]]))

    def _children(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def versions(self) -> list[int]:
        """The numbers of the published sets, oldest first."""
        return [int(n) for n in self._children("_manifests") if n.isdigit()]

    def manifest(self, version: int | None = None) -> dict:
        """``{"version": n, "parts": {name: {...}}}``; version 0 has no parts."""
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return {"version": 0, "parts": {}}
        stream = self._fs.open(self._path("_manifests", f"{version:010d}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def stage(self, name: str) -> str:
        """A new version folder for the part ``name``; nothing reads it before
        a set that names it is published."""
        return f"{self.root}/_versions/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str, signature: str | None = None, fmt: str = "parquet") -> dict:
        """Write ``df`` as a new, unpublished version of the table ``name``;
        returns its manifest entry."""
        folder = self.stage(name)
        df.write.format(fmt).save(folder)
        return {"folder": folder[len(self.root) + 1:], "kind": "table", "format": fmt, "schema": df.schema.json(), "signature": signature}

    def publish(self, parts: dict, based_on: int) -> int:
        """Make ``parts`` the current set; ``Conflict`` if the set that it was
        made from, number ``based_on``, is not current any more."""
        version = based_on + 1
        target = self._path("_manifests", f"{version:010d}")
        if max(self.versions(), default=0) != based_on:
            raise Conflict(f"set {based_on} of {self.root} was replaced")
        written = self._path("_manifests", f"_{uuid.uuid4().hex}")
        stream = self._fs.create(written, False)
        try:
            stream.write(bytearray(json.dumps({"version": version, "time": time.time(), "parts": parts}, indent=1).encode()))
        finally:
            stream.close()
        if self._fs.exists(target) or not self._fs.rename(written, target):
            raise Conflict(f"set {version} of {self.root} exists")
        return version

    def folder(self, entry: dict) -> str:
        return f"{self.root}/{entry['folder']}"

    def finished(self, entry: dict | None) -> bool:
        """Whether the entry's folder was written to its end and still is there."""
        if entry is None:
            return False
        marker = "metadata/_SUCCESS" if entry["kind"] == "model" else "_SUCCESS"
        return self._fs.exists(self._path(entry["folder"], marker))

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """The table ``name`` of the current (or a still kept) set."""
        parts = self.manifest(version)["parts"]
        if name not in parts:
            raise FileNotFoundError(f"no table {name} below {self.root}")
        return self.read_entry(parts[name])

    def read_entry(self, entry: dict) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(entry["schema"]))
        return self.spark.read.format(entry["format"]).schema(schema).load(self.folder(entry))

    def replace(self, df: DataFrame, name: str, signature: str | None = None, fmt: str = "parquet") -> DataFrame:
        """Write a new version of one table and publish it, all others as they
        are. ``df`` may read the version that it replaces."""
        held = self.manifest()
        entry = self.write(df, name, signature, fmt)
        self.publish({**held["parts"], name: entry}, held["version"])
        return self.read_entry(entry)

    def drop_old(self, keep: int = 1, min_age: float = 24 * 3600) -> list[str]:
        """Delete all but the last ``keep`` sets, and the version folders that
        no kept set names and that are older than ``min_age`` seconds (younger
        ones may be another writer's). Returns the folders deleted."""
        numbers = self.versions()
        kept = numbers[-max(1, keep):]
        used = {e["folder"] for n in kept for e in self.manifest(n)["parts"].values()}
        for n in numbers[:-len(kept)] if kept else []:
            self._fs.delete(self._path("_manifests", f"{n:010d}"), False)
        gone = []
        for name in self._children("_versions"):
            path = self._path("_versions", name)
            if f"_versions/{name}" not in used and time.time() - self._fs.getFileStatus(path).getModificationTime() / 1000 >= min_age:
                self._fs.delete(path, True)
                gone.append(name)
        return gone


def signature(*parts: object) -> str:
    """A digest of names, parameters and the signatures a layer is built from."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


def source_signature(df: DataFrame) -> str | None:
    """A digest of what ``df`` reads: its schema and plan, and path, size and
    modification time of every input file, which one aggregate over the
    files' listing reduces. None for a frame that reads no files."""
    spark, files = df.sparkSession, sorted(df.inputFiles())
    if not files:
        return None
    listing = spark.read.format("binaryFile").load(files).select("path", "length", F.col("modificationTime").cast("double").alias("at"))
    hashes = [F.xxhash64("path", "length", "at", F.lit(i)).cast("decimal(38,0)") for i in (0, 1)]
    found = listing.agg(F.count("*"), F.sum("length"), *[F.sum(h) for h in hashes]).first()
    plan = df._jdf.queryExecution().analyzed().canonicalized().toString()
    return signature(df.schema.json(), plan, [str(v) for v in found])
