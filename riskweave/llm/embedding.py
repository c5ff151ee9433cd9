"""Operator 10, embedding near-duplicates by random-hyperplane hashing.

Each of several tables hashes a vector to the signs of its products with
``bits`` random hyperplanes. Vectors that share a bucket in some table are
compared by exact cosine in double precision; links are those of at least
``threshold``. Equal vectors are one class from the start, so copies of any
number cost nothing more. A link found by several tables is counted by the
first of them only, which each bucket decides from the two vectors' codes, so
no pairs are written: buckets report link counts, and a link from each member
to the smallest it reaches. Crowded buckets are split into blocks, and pairs
of blocks are compared in tasks of their own.

Bits and tables follow from the number of classes and the recall wanted (see
``parameters``); bits grow with the logarithm of the input, so buckets keep
their expected size. A pair of exactly the threshold is found with
probability ``recall``, more similar pairs nearly always.

Vectors that are null, empty, zero, or hold null or non-finite components
link with nothing and are components of their own; vectors of different
length never link; repeated rows come back each and link with each other
(vectors are told apart by 128-bit hashes when links return to rows); an empty
table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import keep
from .components import components
from .pairing import in_blocks, join_labels, whole_groups

THRESHOLD, RECALL = 0.9, 0.99
#: Classes that a bucket is expected to hold at most.
BUCKET = 64
SEED = 7
#: Rows of a block that are compared with the other block at once.
STRIPE = 512


def parameters(classes: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables): bits so that ``classes`` spread to BUCKET a bucket,
    tables so that a pair at the threshold meets in one with ``recall``."""
    bits = min(30, max(3, math.ceil(math.log2(max(2, classes) / BUCKET))))
    meets = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - meets))


def codes(vectors: np.ndarray, bits: int, tables: int, seed: int = SEED) -> np.ndarray:
    """Bucket of each vector in each table (n x tables, int32)."""
    planes = np.random.default_rng([seed, vectors.shape[1]]).standard_normal((vectors.shape[1], tables * bits))
    signs = (vectors @ planes >= 0).reshape(len(vectors), tables, bits)
    return (signs << np.arange(bits)).sum(2).astype(np.int32)


def _valid(column: str):
    x = F.col(column)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(x.isNotNull() & (F.size(x) > 0) & finite & F.exists(x, lambda v: v != 0), F.lit(False))


def _bucketed(classes: DataFrame, bits: int, tables: int, kind: str) -> DataFrame:
    """One row a class and table: bucket, cls, n, width, codes and vector as bytes."""
    def rows(batches):
        for batch in batches:
            column = batch.column("vector")
            lengths = np.diff(column.offsets.to_numpy())
            flat, at = column.flatten().to_numpy(zero_copy_only=False).astype(kind), np.concatenate([[0], np.cumsum(lengths)])
            cls, n = batch.column("cls").to_numpy(), batch.column("n").to_numpy()
            for width in np.unique(lengths):
                for part in np.array_split(own := np.flatnonzero(lengths == width), max(1, len(own) // 512)):
                    x = np.ascontiguousarray(flat[at[part][:, None] + np.arange(width)])
                    code = codes(x.astype(np.float64), bits, tables)
                    blobs, signs = [v.tobytes() for v in x], [c.tobytes() for c in code]
                    for t in range(tables):
                        bucket = (code[:, t].astype(np.int64) << 20) | t
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(bucket), pa.array(np.full(len(part), width, np.int32)), pa.array(cls[part]), pa.array(n[part]),
                             pa.array(signs, pa.binary()), pa.array(blobs, pa.binary())], names=["bucket", "width", "cls", "n", "codes", "vector"])

    return classes.select("cls", "n", "vector").mapInArrow(rows, "bucket long, width int, cls long, n long, codes binary, vector binary")


def _compare(threshold: float, tables: int, kind: str):
    def key_of(batch):
        key = np.empty(batch.num_rows, [("b", "i8"), ("w", "i4"), ("i", "i4"), ("j", "i4")])
        for f, c in zip("bwij", ("bucket", "width", "i", "j")):
            key[f] = batch.column(c).to_numpy()
        return key

    def cell(key, cls, n, code, vector, block):
        x = vector.astype(np.float64)
        # a power of two keeps the cosine and prevents overflow in the norms
        x = np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])
        norm = np.sqrt((x * x).sum(1))
        table = int(key["b"]) & ((1 << 20) - 1)
        counts, labels = np.zeros(len(cls), np.int64), np.arange(len(cls))
        # a pair belongs to the cell of its two blocks
        left = np.flatnonzero(block == key["i"])
        right = np.flatnonzero(block == key["j"])
        for lo in range(0, len(left), STRIPE):
            a = left[lo:lo + STRIPE]
            close = (x[a] @ x[right].T) / (norm[a][:, None] * norm[right][None, :]) >= threshold
            i, j = np.nonzero(close)
            i, j = a[i], right[j]
            if key["i"] == key["j"]:
                i, j = i[i < j], j[i < j]
            join_labels(labels, i, j)
            for s in range(0, len(i), 1 << 18):
                u, v = i[s:s + (1 << 18)], j[s:s + (1 << 18)]
                new = ~(code[u, :table] == code[v, :table]).any(1)
                np.add.at(counts, u[new], n[v[new]])
                np.add.at(counts, v[new], n[u[new]])
        return counts, labels

    def rows(batches):
        for t in whole_groups(batches, key_of):
            t = t.combine_chunks().to_batches()[0]
            key = key_of(t)
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            cls, n, block = (t.column(c).to_numpy() for c in ("cls", "n", "block"))
            a, b, links = [], [], []
            for lo, hi in zip(first, np.append(first[1:], len(key))):
                if hi - lo < 2:
                    continue
                part = slice(lo, hi)
                blobs = t.slice(lo, hi - lo)
                code = np.frombuffer(b"".join(blobs.column("codes").to_pylist()), np.int32).reshape(hi - lo, tables)
                vector = np.frombuffer(b"".join(blobs.column("vector").to_pylist()), kind).reshape(hi - lo, -1)
                counts, labels = cell(key[lo], cls[part], n[part], code, vector, block[part])
                own = cls[part]
                some = np.flatnonzero((counts > 0) | (labels != np.arange(hi - lo)))
                a.append(own[some]), b.append(own[labels[some]]), links.append(counts[some])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in (a, b, links)], names=["a", "b", "links"])

    return rows


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(key, n_links, component_id, kept) for every row."""
    kind = "<f4" if isinstance(vectors.schema[vector].dataType.elementType, FloatType) else "<f8"
    exact = "float" if kind == "<f4" else "double"
    # adding 0.0 makes -0.0 equal 0.0
    rows = vectors.select(F.col(key).alias("key"), F.when(_valid(vector), F.transform(vector, lambda v: v.cast(exact) + F.lit(0.0).cast(exact))).alias("vector"))
    classes = keep(rows.filter(F.col("vector").isNotNull()).groupBy("vector").agg(F.min("key").alias("least"), F.count("*").alias("n"))
                   .withColumn("cls", F.monotonically_increasing_id()), "lsh-classes")
    bits, tables = parameters(classes.count(), threshold, recall)
    members = _bucketed(classes, bits, tables, kind)
    cells = in_blocks(members, "bucket", "cls").select(
        "bucket", "width", F.col("cell.i").alias("i"), F.col("cell.j").alias("j"), "block", "cls", "n", "codes", "vector")
    order = ["bucket", "width", "i", "j"]
    found = keep(cells.repartition(*order).sortWithinPartitions(*order).mapInArrow(_compare(threshold, tables, kind), "a long, b long, links long"), "lsh-links")
    labels = components(found.select("a", "b")).withColumnRenamed("node", "cls")
    counts = found.groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    per = (classes.join(counts, "cls", "left").join(labels, "cls", "left")
           .withColumn("component", F.coalesce("component", "cls"))
           .withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("n") - 1))
    least = per.groupBy("component").agg(F.min("least").alias("component_id"))
    # rows find their class by 128 bits of their vector, so that vectors stay
    # where they are; rows without a valid one take no part in the join
    named = [F.xxhash64("vector", F.lit(i)).alias(f"hash{i}") for i in (0, 1)]
    per = keep(per.join(least, "component").select(*named, "n_links", "component_id"), "lsh-classes")
    valid = F.col("vector").isNotNull()
    found = rows.filter(valid).select("key", *named).join(per, ["hash0", "hash1"]).select("key", "n_links", "component_id")
    alone = rows.filter(~valid).select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    return found.unionByName(alone).select(
        F.col("key").alias(key), F.col("n_links").cast("long").alias("n_links"), "component_id",
        F.coalesce(F.col("key") == F.col("component_id"), F.lit(False)).alias("kept"))
