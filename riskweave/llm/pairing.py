"""Links inside groups of rows that share a key, in blocks of bounded size.

A group may hold any share of the rows. Its members are split over blocks of
about BLOCK rows and every pair of blocks is a task of its own, so no task
holds more than two blocks; each task reports sums and one link a member to
its component's smallest member, never all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep

#: Members of a block; a task compares two blocks at most.
BLOCK = 4096
#: Most crowded groups (a key and a number each) that are broadcast.
MANY = 100_000


def in_blocks(members: DataFrame, key: str, spread: str, block: int = BLOCK) -> DataFrame:
    """``members`` with ``cell``: the struct (i, j) of blocks a copy goes to,
    i <= j, and ``block``, the member's own. A group of n rows has
    ceil(n / block) blocks; a member is copied to each pair of its own block
    with another, so groups of one block are not copied at all. Group sizes
    come from a pre-aggregated count; only groups above a block are joined,
    by broadcast if there are at most MANY of them, so members move once."""
    large = keep(members.groupBy(key).agg(F.count("*").alias("__n")).filter(F.col("__n") > block)
             .select(key, F.ceil(F.col("__n") / block).cast("int").alias("__blocks")), "large-groups")
    if large.limit(MANY + 1).count() <= MANY:
        large = F.broadcast(large)
    blocks = F.coalesce(F.col("__blocks"), F.lit(1))
    own = F.pmod(F.xxhash64(F.col(spread), F.lit("block")), blocks).cast("int")
    return (members.join(large, key, "left").withColumn("block", own)
            .withColumn("__other", F.explode(F.sequence(F.lit(0), blocks - 1)))
            .withColumn("cell", F.struct(F.least("block", "__other").alias("i"), F.greatest("block", "__other").alias("j")))
            .drop("__blocks", "__other"))


def join_labels(labels: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Merge, in place, the components of ``labels`` (each node's smallest
    member, itself at first) along the links (left, right)."""
    while len(left):
        a, b = labels[left], labels[right]
        apart = a != b
        if not apart.any():
            return
        np.minimum.at(labels, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels[:] = up
        left, right = left[apart], right[apart]


def whole_groups(batches, key_of):
    """Re-cut sorted Arrow batches so that no group is split. ``key_of``
    gives a batch's group keys (an array); yields tables of whole groups."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = key_of(batch)
        other = np.flatnonzero(keys != keys[-1])
        cut = int(other[-1]) + 1 if len(other) else 0  # where the last group starts
        if held and last != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        last = keys[-1]
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)
