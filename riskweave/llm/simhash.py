"""Operator 4, SimHash near-duplicates by anchor-point covering.

A document's 64-bit fingerprint has a bit set if it is set in over half of
the XXH64 values of its word shingles. Fingerprints that differ in at most
``max_bits`` bits are linked. To find the links:

- two fingerprints within ``max_bits`` agree up to t = max_bits // 2 bits in
  one of their two 32-bit halves;
- the anchors of a half are the words of the Hamming code of length 31 (times
  the last bit): every word has one anchor within the covering radius 1, its
  home, and any word within t of it has that anchor within 1 + t;
- so each fingerprint is sent to every anchor within 1 + t of each half (17
  for t = 1), and at each anchor the fingerprints at home there are compared
  with all that came.

There are 2^27 anchors a half, so cells stay small; a crowded anchor is split
into blocks. Equal fingerprints are one row from the start. Every cell
reports a link from each member to the smallest it reaches, and connected
components are found by star contraction.

Null and empty texts have fingerprint zero and are linked like any other;
texts with fewer words than a shingle use the whole word sequence; repeated
rows come back each, with the same component; null ids never name a component
unless all its ids are null; an empty table gives an empty result; a column
called like an output column is replaced.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, tidy, under_own_names
from .components import components
from .pairing import in_blocks, join_labels, whole_groups

#: Words of a shingle, most differing bits of a link, seed of the hash.
SHINGLE, MAX_BITS, SEED = 3, 3, 42
#: Shingles hashed before their bits are summed; pairs compared at once.
STEP, PAIRS = 100_000, 1 << 20
CODE_BITS = 31


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text (UTF-8), in steps of bounded memory."""
    words = (text or b"").lower().split()  # both on ASCII only, as the words are defined
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    ends = (starts + lengths)[min(shingle, len(words)) - 1:].tolist()
    starts = starts[:n].tolist()
    digest, bits = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, STEP):
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at:at + STEP], ends[at:at + STEP])], np.uint64)
        bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << b for b in range(64) if 2 * int(bits[b]) > n)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(key, fingerprint long) for every row; the long holds the 64 bits."""
    spark_type = docs.schema[key].dataType.simpleString()

    def rows(batches):
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1).cast(pa.binary())], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["key", "fingerprint"])

    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(tidy(rows), f"key {spark_type}, fingerprint long")


def _syndrome(words: np.ndarray) -> np.ndarray:
    """XOR of the positions (1 to 31) of the set bits; 0 for code words."""
    out = np.zeros(len(words), np.int64)
    for b in range(CODE_BITS):
        out ^= ((words >> b) & 1) * (b + 1)
    return out


def _moves(radius: int) -> list[np.ndarray]:
    """For each syndrome, what to XOR a word with to reach each code word
    within ``radius`` of it (all 32 bits; the last bit is not coded)."""
    masks = np.array([sum(1 << b for b in bits) for w in range(radius + 1) for bits in combinations(range(32), w)], np.int64)
    of = _syndrome(masks)
    return [masks[of == s] for s in range(32)]


def anchors(prints: np.ndarray, max_bits: int = MAX_BITS):
    """(index of the fingerprint, anchor, at home) for all visits; an anchor
    is half << 32 | code word."""
    moves = _moves(1 + max_bits // 2)
    which, where, home = [], [], []
    for half in (0, 1):
        words = ((prints >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        syndrome = _syndrome(words)
        to_home = np.where(syndrome > 0, 1 << np.maximum(syndrome - 1, 0), 0)
        for s in range(32):
            at = np.flatnonzero(syndrome == s)
            which.append(np.repeat(at, len(moves[s])))
            where.append(((words[at][:, None] ^ moves[s][None, :]) | (half << 32)).ravel())
            home.append((moves[s][None, :] == to_home[at][:, None]).ravel())
    return np.concatenate(which), np.concatenate(where), np.concatenate(home)


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _compare(max_bits: int):
    """Links of one partition, sorted by anchor and cell."""
    def key_of(batch):
        key = np.empty(batch.num_rows, [("a", "i8"), ("i", "i4"), ("j", "i4")])
        for f, c in zip("aij", ("anchor", "i", "j")):
            key[f] = batch.column(c).to_numpy()
        return key

    def rows(batches):
        for table in whole_groups(batches, key_of):
            prints = table.column("fingerprint").to_numpy()
            key = key_of(table.combine_chunks().to_batches()[0])
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(first, len(prints)))
            group = np.repeat(np.arange(len(first)), size)
            homes = np.flatnonzero(table.column("home").to_numpy(zero_copy_only=False) & (size[group] > 1))
            labels = np.arange(len(prints))
            # home members against all members of their cell, so many pairs at a time
            upto = np.cumsum(size[group[homes]])
            lo = 0
            while lo < len(homes):
                hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PAIRS, "right")))
                h = homes[lo:hi]
                n = size[group[h]]
                left = np.repeat(h, n)
                right = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[group[h]], n)
                near = _popcount((prints[left] ^ prints[right]).view(np.uint64)) <= max_bits
                join_labels(labels, left[near], right[near])
                lo = hi
            linked = np.flatnonzero(prints != prints[labels])
            if len(linked):
                pairs = np.unique(np.stack([prints[linked], prints[labels[linked]]]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    return rows


def link(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) that span the components of the distinct fingerprints."""
    def visits(batches):
        for batch in batches:
            p = batch.column(0).to_numpy()
            for lo in range(0, len(p), 4096):
                part = p[lo:lo + 4096]
                which, where, home = anchors(part.view(np.uint64), max_bits)
                yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(part[which]), pa.array(home)], names=["anchor", "fingerprint", "home"])

    sent = prints.select("fingerprint").mapInArrow(tidy(visits), "anchor long, fingerprint long, home boolean")
    cells = in_blocks(sent, "anchor", "fingerprint").select("anchor", F.col("cell.i").alias("i"), F.col("cell.j").alias("j"), "fingerprint", "home")
    order = ["anchor", "i", "j"]
    return cells.repartition(*order).sortWithinPartitions(*order).mapInArrow(tidy(_compare(max_bits)), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(key, fingerprint as 16 hex digits, component_id) for every row."""
    rows = keep(fingerprints(docs, key, text, shingle), "simhash")
    classes = keep(rows.groupBy("fingerprint").agg(F.min("key").alias("least")), "simhash-classes")
    labels = components(link(classes, max_bits)).withColumnRenamed("node", "fingerprint")
    found = classes.join(labels, "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    least = found.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = keep(found.join(least, "component").select("fingerprint", "component_id"), "simhash-ids")
    return rows.join(ids, "fingerprint").select(
        F.col("key").alias(key), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def survivors(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each group of near-duplicates, all columns as they are: that
    with the smallest id (null ids last; of equal ids that with the smallest
    hash of the text). Rows are told apart by a number of their own, so an id
    that several texts share keeps one row in each of their groups, and rows
    without id are grouped like all others."""
    def chosen(rows: DataFrame, at: dict[str, str]) -> DataFrame:
        numbered = keep(rows.withColumn("row", F.monotonically_increasing_id()), "simhash-rows")
        found = near_duplicates(numbered, "row", at[text], shingle, max_bits).select("row", "component_id")
        ids = numbered.select("row", F.col(at[key]).alias("id"), F.xxhash64(at[text]).alias("hash"))
        best = found.join(ids, "row").groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "hash", "row")).alias("best"))
        return numbered.join(best.select(F.col("best.row").alias("row")), "row", "left_semi")

    return under_own_names(docs, chosen)
