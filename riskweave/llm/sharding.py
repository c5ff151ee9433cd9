"""Operator 2, sharding by a permutation-filled lookup table.

Every shard has its own preference order over the slots of a table of prime
size; the shards take turns and claim their next free slot until the table is
full. A key's shard is the entry at hash(key) mod size, so placement is one
hash and one lookup, shards differ by at most one slot, and adding or
removing a shard moves few keys.

Rows are placed with DataFrame functions only. The table depends on the
parameters alone, never on data; each claim depends on all earlier ones, so
it is filled once, in turns, when the plan is built. It is broadcast: its
size is fixed by ``slots`` (at most MAX_SLOTS entries of two integers).

Null keys are placed like a key of their own (their hash input is the text
``\\N``); equal keys always share a shard; an empty table gives an empty
result; other columns pass through, and a column already called like an
output column is replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Production parameters of the registered query. 4099 is prime; 128 slots a shard.
SHARDS, SLOTS = 32, 4099
#: Most table entries (two integers each, so under 16 MB broadcast).
MAX_SLOTS = 1_000_003


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill_table(shards: int, slots: int = SLOTS) -> list[int]:
    """The shard of each slot. Shard i prefers offset, offset + skip, ...
    (mod slots), both from md5 of its name; slots must be a prime."""
    if not 1 <= shards <= slots <= MAX_SLOTS:
        raise ValueError(f"need 1 <= shards <= slots <= {MAX_SLOTS}")
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be a prime")
    at = [_number(f"shard-{i}-offset") % slots for i in range(shards)]
    skip = [_number(f"shard-{i}-skip") % (slots - 1) + 1 for i in range(shards)]
    table, free = [-1] * slots, slots
    while True:
        for i in range(shards):
            while table[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            table[at[i]] = i
            free -= 1
            if not free:
                return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """hash(key) mod slots: the first 60 bits of md5 of the key as text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("\\N")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def lookup_table(spark: SparkSession, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """The table as (slot, shard)."""
    entries = F.split(F.lit(",".join(map(str, fill_table(shards, slots)))), ",")
    return (spark.range(1, numPartitions=1).select(F.posexplode(entries).alias("slot", "shard"))
            .select("slot", F.col("shard").cast("int").alias("shard")))


def shard(docs: DataFrame, key: str = "doc_id", shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``docs`` with ``slot`` and ``shard``; one broadcast join, no shuffle."""
    table = lookup_table(docs.sparkSession, shards, slots)
    rows = docs.drop("shard").withColumn("slot", slot_of(F.col(key), slots))
    return rows.join(F.broadcast(table), "slot", "left").select(*[c for c in rows.columns if c != "slot"], "slot", "shard")
