"""Operator 11, audit of how document filters interact.

Every document is judged once by every filter, so what a chain of filters
does, in any order, follows from how many documents fail which set of them:

1. One scan gives each document a narrow row: id, part, a bit for each
   condition it fails, and a digest of its text.
2. Per digest the smallest id is found (partial counts first, so a text that
   a third of the rows hold is one row a task), and the others fail the
   filter for repeated texts.
3. Documents are counted by part and set of failed filters, with those that
   have a label of interest: 2^5 numbers a part and measure at most.
4. A part's numbers are reshaped to a 2x2x2x2x2 tensor, an axis a filter. For
   each step of each order, ``einsum`` contracts every axis with the vector
   that selects what passes, what fails or all: the filters before the step
   select what passes, its own what fails, those behind it all.

Defined results: a null text counts as empty, so null and empty texts are
equal; a null part is the part ''; a row without id is compared with no other
and never counts as repeated, nor makes another so; rows with equal id and
text are not repeats of each other; an id with several label rows has a label
if one of them says so; null labels are no label; an empty table gives an
empty result; texts of any length are read whole, and other columns, also
those called like an output column, are not read.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, keep

#: Fewest words, least percentage of distinct words, most percentage of capitals.
MIN_WORDS, DISTINCT_SHARE, CAPITAL_SHARE = 200, 50, 3
SYMBOLS = "[#$%&*|]"
MEASURES = ("n", "good", "toxic")
#: What contracts an axis: the count that passes, fails, or both.
PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def conditions(text: Column) -> dict[str, Column]:
    """The failure conditions that a text decides alone."""
    words = F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))
    return {
        "A": F.size(words) < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < DISTINCT_SHARE * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > CAPITAL_SHARE * F.length(text),
        "D": F.regexp_like(text, F.lit(SYMBOLS)),
    }


def failures(docs: DataFrame, fails: dict[str, Column], key: str, text: str, part: str) -> DataFrame:
    """(id, part, mask): a bit for each condition failed, in their order, then
    one for texts that a row with a smaller id holds; equal rows are counted (n)."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    mask = F.lit(0)
    for bit, condition in enumerate(fails.values()):
        mask = mask + F.when(condition, 1 << bit).otherwise(0)
    rows = keep(docs.select(
        F.col(key).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        mask.alias("mask"), F.unhex(F.sha2(whole, 256)).alias("digest")), "filter-flags")
    known = rows.filter("id is not null").groupBy("id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    first = known.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    marked = known.join(first, ["digest", "id"], "left")
    again = F.when(F.col("first").isNull(), 1 << len(fails)).otherwise(0)
    # rows without id keep out of the joins, where they would be one hot key
    loose = rows.filter("id is null").groupBy("id", "part", "mask").agg(F.count("*").alias("n"))
    return marked.select("id", "part", (F.col("mask") + again).alias("mask"), "n").unionByName(loose)


def cells(marked: DataFrame, labels: DataFrame, key: str, good: str, toxic: str) -> DataFrame:
    """(part, mask, n, good, toxic): documents, and those with either label 1."""
    per_id = labels.select(F.col(key).alias("id"), (F.col(good) == 1).alias("good"), (F.col(toxic) == 1).alias("toxic")) \
        .filter("id is not null and (good or toxic)").groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    labelled = marked.filter("id is not null").join(per_id, "id", "left").select("part", "mask", "n", "good", "toxic")
    loose = marked.filter("id is null").select("part", "mask", "n", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    return labelled.unionByName(loose).groupBy("part", "mask").agg(
        F.sum("n").alias("n"), *[F.sum(F.when(F.col(m), F.col("n")).otherwise(0)).alias(m) for m in ("good", "toxic")])


def contract(tensor: np.ndarray, choices: np.ndarray) -> np.ndarray:
    """measures x 2 x ... x 2 numbers, contracted for each of ``choices``
    (selections x axes x 2): measures x selections."""
    axes = "abcdefghijklm"[:choices.shape[1]]
    return np.einsum(f"z{axes}," + ",".join("y" + a for a in axes) + "->zy", tensor, *np.moveaxis(choices, 1, 0))


def steps(n: int):
    """All orders of ``n`` filters, and of each step the selections that give
    what it keeps, removes, what its filter fails at all, and fails alone."""
    orders = list(permutations(range(n)))
    chosen = {name: np.empty((len(orders), n, n, 2), np.int64) for name in ("kept", "removed", "failing", "alone")}
    for o, order in enumerate(orders):
        for k, own in enumerate(order):
            before = np.isin(np.arange(n), order[:k])[:, None]
            mine = (np.arange(n) == own)[:, None]
            chosen["removed"][o, k] = np.where(mine, FAIL, np.where(before, PASS, ALL))
            chosen["kept"][o, k] = np.where(mine | before, PASS, ALL)
            chosen["failing"][o, k] = np.where(mine, FAIL, ALL)
            chosen["alone"][o, k] = np.where(mine, FAIL, PASS)
    return orders, {name: x.reshape(-1, n, 2) for name, x in chosen.items()}


def audit_part(tensor: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of every step of every order, from a part's tensor
    (measures x 2 x ... x 2; axis k + 1 is filter k, index 1 what fails it)."""
    n = tensor.ndim - 1
    orders, chosen = steps(n)
    got = {name: contract(tensor, x) for name, x in chosen.items()}
    own = np.array(orders).ravel()
    out = {"kept": got["kept"][0], "removed": got["removed"][0], "redundant": got["failing"][0] - got["removed"][0],
           "unique_fails": got["alone"][0], "good_lost": got["removed"][1], "toxic_lost": got["removed"][2]}
    total = np.zeros(n, np.int64)
    np.add.at(total, own, out["removed"])
    return {**out, "shapley": total[own]}


def audit(docs: DataFrame, labels: DataFrame, fails: dict[str, Column] | None = None, repeated: str = "E", key: str = "doc_id",
          text: str = "text", part: str = "lang", good: str = "quality", toxic: str = "toxic") -> DataFrame:
    """(part, filter_order, step, *COUNTS): for each part, each order of the
    filters and each step of it. ``fails`` names the conditions on ``docs``
    (as ``conditions`` gives); ``repeated`` names the filter for texts that a
    smaller id holds. Names are joined to filter_order."""
    if fails is None:
        fails = conditions(F.coalesce(F.col(text).cast("string"), F.lit("")))
    names = [*fails, repeated]
    n = len(names)
    if not 2 <= n <= 7:
        raise ValueError("two to seven filters")  # all orders are reported
    counted = cells(failures(docs, fails, key, text, part), labels, key, good, toxic)

    def rows(table: pa.Table) -> pa.Table:
        tensor = np.zeros((len(MEASURES), 1 << n), np.int64)
        at = table.column("mask").to_numpy()
        for m, name in enumerate(MEASURES):
            tensor[m, at] = table.column(name).to_numpy()
        # the mask's lowest bit is the first filter, so the axes are reversed
        tensor = tensor.reshape(len(MEASURES), *[2] * n).transpose(0, *range(n, 0, -1))
        found = audit_part(np.ascontiguousarray(tensor))
        orders = ["".join(names[i] for i in order) for order in permutations(range(n))]
        return pa.table({
            "part": pa.array([table.column("part")[0].as_py()] * (len(orders) * n)), "filter_order": pa.array(np.repeat(orders, n)),
            "step": pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(orders))), **{c: pa.array(found[c]) for c in COUNTS}})

    return counted.groupBy("part").applyInArrow(
        rows, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))
