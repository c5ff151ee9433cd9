"""Operator 6, language identification by nearest centroid.

A text's vector holds its hashed letter n-grams (1 to 3; everything but
letters is one space), weighted (1 + log tf) * idf and scaled to length 1.
Each language has up to CLUSTERS centroids, found by spherical k-means; a text
gets the language of the centroid with the largest cosine, which is the
score. A text further from its centroid than nearly all of those it was
learned from (the RADIUS quantile) is marked rejected; ``reject=True`` turns
its prediction into ``und``.

Document frequencies come from all learning rows, added up in the tasks
first. Centroids are fitted on a sample of about SAMPLE rows a language, and
never more, chosen by a hash of id and text (the one bound, and a parameter),
in one task a language; of equal rows their share of copies is taken. The model is CLUSTERS vectors of 2^HASH_BITS numbers a language.

Null texts and texts without a letter are ``und`` with score 0; rows without
a language are not learned from; without learning rows all are ``und``;
repeated rows count each; an empty table gives an empty result; other columns
pass through, and a column called like an output column is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep

HASH_BITS, CLUSTERS, SAMPLE, RADIUS = 13, 4, 1500, 0.999
SIZE = 1 << HASH_BITS
UNDETERMINED = "und"
ROUNDS, SEED = 12, 5
#: Documents and characters counted at once; a longer text is cut for counting only.
ROWS, CHARS = 128, 1 << 20
OUT = ["lang_pred", "score", "distance", "rejected"]

IS_LETTER = np.array([chr(c).isalpha() for c in range(0x110000)])
_PRIMES = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def _counts(texts: list[str]) -> np.ndarray:
    """Hashed n-gram counts (rows x SIZE) of short texts."""
    flat = np.frombuffer(("\0" + "\0".join(texts) + "\0").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    # lower() may change lengths: the separators tell where texts end
    cut = flat == 0
    letter = IS_LETTER[flat]
    c = np.where(letter, flat, np.uint32(32))
    # one space for any run of others; separators stay
    use = letter | cut | np.concatenate([[False], letter[:-1]])
    c, cut = c[use], cut[use]
    row = np.cumsum(cut) - 1
    out = np.zeros(len(texts) * SIZE, np.int64)
    gram = np.zeros(len(c), np.uint32)
    for n in range(3):
        gram = gram[:len(c) - n] if n else gram
        gram = (gram ^ (c[n:] * _PRIMES[n])) * np.uint32(0x27D4EB2F)
        gram ^= gram >> np.uint32(15)
        at = row[:len(c) - n]
        inside = (at == row[n:]) & (c[n:] > 0)
        # a lone space says nothing; a row past the last text is the closing separator
        inside &= at < len(texts)
        if n == 0:
            inside &= c != 32
        key = at[inside] * SIZE + (gram[inside] >> np.uint32(32 - HASH_BITS)).astype(np.int64)
        out += np.bincount(key, minlength=len(out))
    return out.reshape(len(texts), SIZE)


def count_blocks(column: pa.Array):
    """(first row, counts, has a letter) of blocks of rows; texts longer than
    CHARS are counted piece by piece, whole."""
    texts = [(t or "").replace("\0", " ") for t in column.to_pylist()]
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and hi - lo < ROWS and (hi == lo or size + len(texts[hi]) <= CHARS):
            size += len(texts[hi])
            hi += 1
        if size > CHARS and hi == lo + 1:
            text = texts[lo]
            counts = sum((_counts([text[i:i + CHARS]]) for i in range(0, len(text), CHARS)), np.zeros((1, SIZE), np.int64))
        else:
            counts = _counts(texts[lo:hi])
        yield lo, counts, counts.any(1)
        lo = hi


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = counts.astype(np.float32)
    np.log(x, out=x, where=x > 0)
    x += counts > 0
    x *= idf
    x /= np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), np.float32(1e-12))
    return x


def _document_frequencies(learn: DataFrame) -> np.ndarray:
    """idf of each hashed n-gram over all learning rows."""
    def count(batches):
        n, rows = np.zeros(SIZE, np.int64), 0
        for batch in batches:
            for _, counts, _ in count_blocks(batch.column(0)):
                n += (counts > 0).sum(0)
            rows += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, SIZE)), pa.array(np.concatenate([[rows], n]))], names=["term", "n"])

    found = learn.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # SIZE + 1 rows
    n = np.zeros(SIZE + 1)
    for r in found:
        n[r.term + 1] = r.n
    return (np.log((1 + n[0]) / (1 + n[1:])) + 1).astype(np.float32)


def _centroids(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: centroids, and the distance each reaches to."""
    rng = np.random.default_rng(SEED)
    centers = x[[int(rng.integers(len(x)))]]
    while len(centers) < min(CLUSTERS, len(x)):  # furthest-first start
        near = (x @ centers.T).max(1)
        far = int(near.argmin())
        if near[far] > 1 - 1e-6:
            break
        centers = np.concatenate([centers, x[[far]]])
    for _ in range(ROUNDS):
        of = (x @ centers.T).argmax(1)
        sums = np.stack([x[of == k].sum(0) if (of == k).any() else centers[k] for k in range(len(centers))])
        centers = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    near = x @ centers.T
    of = near.argmax(1)
    reach = np.array([np.quantile(1 - near[of == k, k], RADIUS) if (of == k).any() else 0.0 for k in range(len(centers))])
    return centers.astype(np.float32), reach


def fit(docs: DataFrame, learn_from: Column, key: str = "doc_id", text: str = "text", lang: str = "lang") -> dict | None:
    """The model from the rows for which ``learn_from`` holds and that name a
    language; None if there are none."""
    learn = docs.filter(learn_from).select(F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text"),
                                           F.col(lang).cast("string").alias("lang")).filter("lang is not null and text is not null")
    idf = _document_frequencies(learn)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(idf)
    rate = learn.groupBy("lang").agg(F.count("*").alias("n")).select("lang", F.least(F.lit(1.0), F.lit(float(SAMPLE)) / F.col("n")).alias("rate"))
    learn = learn.withColumn("row", F.xxhash64("key", "text"))
    # n equal rows get n * rate places, rounded by one draw
    u = F.shiftrightunsigned(F.xxhash64("row", F.lit("sample")), 32) * F.lit(2.0**-32)
    places = (learn.groupBy("lang", "row").agg(F.count("*").alias("n")).join(F.broadcast(rate), "lang")  # one row a language
              .select("lang", "row", F.floor(F.col("n") * F.col("rate") + u).cast("int").alias("places")).filter("places > 0"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("row", "copy"), "row", "copy")
    sample = (learn.join(F.broadcast(places), ["lang", "row"])  # about SAMPLE rows a language
              .groupBy("lang", "row").agg(F.max("text").alias("text"), F.max("places").alias("places"))
              .withColumn("copy", F.explode(F.sequence(F.lit(1), "places")))
              .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= SAMPLE).select("lang", "text"))

    def represent(batches):
        for batch in batches:
            for lo, counts, known in count_blocks(batch.column("text")):
                x = vectors(counts, shared.value)
                for at in range(0, len(x), 32):
                    rows = np.arange(at, min(at + 32, len(x)))[known[at:at + 32]]
                    where = [np.flatnonzero(x[r]) for r in rows]
                    yield pa.RecordBatch.from_arrays([batch.column("lang").take(pa.array(lo + rows)), pa.array([w.astype("<u2").tobytes() for w in where], pa.binary()),
                                                      pa.array([x[r, w].tobytes() for r, w in zip(rows, where)], pa.binary())], names=["lang", "at", "x"])

    def cluster(table: pa.Table) -> pa.Table:
        x = np.zeros((table.num_rows, SIZE), np.float32)
        for r, (at, values) in enumerate(zip(table.column("at").to_pylist(), table.column("x").to_pylist())):
            x[r, np.frombuffer(at, "<u2")] = np.frombuffer(values, np.float32)
        x = x[np.lexsort(x[:, :8].T)]  # the same order on every run
        centers, reach = _centroids(x)
        name = table.column("lang")[0].as_py()
        return pa.table({"lang": [name] * len(centers), "center": pa.array([c.tobytes() for c in centers], pa.binary()), "reach": reach.astype(np.float64)})

    rows = (keep(sample.mapInArrow(represent, "lang string, at binary, x binary"), "lang-sample")
            .groupBy("lang").applyInArrow(cluster, "lang string, center binary, reach double").orderBy("lang", "center").collect())
    if not rows:
        return None
    return {"idf": idf, "langs": [r.lang for r in rows], "centers": np.stack([np.frombuffer(r.center, np.float32) for r in rows]),
            "reach": np.array([r.reach for r in rows])}


def identify(docs: DataFrame, model: dict | None, text: str = "text", reject: bool = False) -> DataFrame:
    """``docs`` with lang_pred, score (cosine, 0 to 1), distance and rejected."""
    docs = docs.drop(*OUT)
    schema = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("distance"), F.lit(True).alias("rejected")).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        model = shared.value
        for batch in batches:
            pred, score = np.full(batch.num_rows, UNDETERMINED, object), np.zeros(batch.num_rows)
            rejected = np.ones(batch.num_rows, bool)
            for lo, counts, known in count_blocks(batch.column(text)) if model else ():
                near = vectors(counts, model["idf"]) @ model["centers"].T
                best = near.argmax(1)
                for r in np.flatnonzero(known):
                    k = best[r]
                    score[lo + r] = min(1.0, max(0.0, float(near[r, k])))
                    rejected[lo + r] = 1 - score[lo + r] > model["reach"][k]
                    if not (reject and rejected[lo + r]):
                        pred[lo + r] = model["langs"][k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred.tolist(), pa.string()), pa.array(score), pa.array(1 - score), pa.array(rejected)],
                                             names=[*batch.schema.names, *OUT])

    return docs.mapInArrow(rows, schema)
