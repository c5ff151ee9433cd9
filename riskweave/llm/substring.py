"""Operator 8, substring dedup by difference-cover anchors.

A difference cover D modulo a period v has, for any two positions, a shift
below v that takes both into D. Two equal windows of W words therefore have,
at one shift k < v, equal runs of W - v + 1 words that start at cover
positions of both documents. So runs are hashed at cover positions only (5
of 21), runs that occur twice are anchors, and each anchor is extended: the
windows of W words that hold it at a shift below v are hashed in full
(two sums of independent states, 64 bits each) and compared over all
documents. A window is a repeat if its full
hash starts anywhere else, same document included; every word of a repeat is
removed, and windows are judged on the input.

No pairs are formed: both comparisons count hashes (see ``repeats``).

Null texts have no words; texts of fewer than W words lose none; repeated
rows are texts like any other, so all their windows repeat; an empty table
gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WINDOWS, WINDOWS2, hash_in_text_windows, is_word_table, word_spans, word_states
from .repeats import n_buckets, pack, shared_mask, slices, unpack, with_answers

WINDOW = 35
#: A perfect difference set: every difference modulo 21 occurs.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
IS_WORD = is_word_table(SPACE)
#: Bytes a word takes at least on average, for the number of buckets only.
WORD_BYTES = 6


def _words(data, offsets):
    starts, ends, first = word_spans(data, offsets, IS_WORD)
    return starts, ends, first, word_states(data, starts, ends)


def _anchors(values: np.ndarray, first: np.ndarray, window: int):
    """Positions and hashes of the runs at cover positions of each text."""
    hashes, inside = hash_in_text_windows(values[:, 0], first, window - PERIOD + 1)
    at = np.arange(len(hashes))
    phase = (at - first[np.searchsorted(first, at, "right") - 1]) % PERIOD
    at = at[inside & np.isin(phase, COVER)]
    return at, hashes[at][:, None]


def _candidates(values: np.ndarray, first: np.ndarray, anchors: np.ndarray, window: int):
    """Starts and full hashes of the windows that hold an anchor at a shift
    below the period."""
    full, inside = hash_in_text_windows(values[:, 0], first, window)
    if not len(full):
        return np.zeros(0, np.int64), np.zeros((0, 2), np.uint64)
    reach = np.zeros(len(values) + 1, np.int64)  # windows starting in [anchor - PERIOD + 1, anchor]
    np.add.at(reach, np.maximum(anchors - PERIOD + 1, 0), 1)
    np.add.at(reach, anchors + 1, -1)
    at = np.flatnonzero(inside & (np.cumsum(reach)[:len(full)] > 0))
    second, _ = hash_in_text_windows(values[:, 1], first, window, WINDOWS2)
    return at, np.stack([full[at], second[at]], axis=1)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(key, n_words, n_removed, kept): kept is the remaining words joined by
    single spaces (empty for null)."""
    if window < PERIOD + 1:
        raise ValueError(f"the window must have more than {PERIOD} words")
    chunks = pack(docs, key, text)
    total = chunks.agg(F.sum("bytes")).first()[0] or 0
    few, many = n_buckets(total / WORD_BYTES * len(COVER) / PERIOD, 1), n_buckets(total / WORD_BYTES / 4, 2)
    key_type = docs.schema[key].dataType.simpleString()

    def send_anchors(batches):
        for batch in batches:
            for chunk, _, _, data, offsets in unpack(batch):
                _, _, first, values = _words(data, offsets)
                _, hashes = _anchors(values, first, window)
                if len(hashes):
                    yield slices(chunk, hashes, few)

    def found(first, values, anchor_answers):
        at, hashes = _anchors(values, first, window)
        return _candidates(values, first, at[shared_mask(hashes, few, anchor_answers or [])], window)

    def send_windows(batches):
        for batch in batches:
            for (chunk, _, _, data, offsets), answers in zip(unpack(batch), batch.column("anchors")):
                _, _, first, values = _words(data, offsets)
                _, hashes = found(first, values, answers.as_py())
                if len(hashes):
                    yield slices(chunk, hashes, many)

    def finish(batches):
        for batch in batches:
            for (_, keys, _, data, offsets), answers, repeats in zip(unpack(batch), batch.column("anchors"), batch.column("windows")):
                starts, ends, first, values = _words(data, offsets)
                at, hashes = found(first, values, answers.as_py())
                at = at[shared_mask(hashes, many, repeats.as_py() or [])]
                cover = np.zeros(len(values) + 1, np.int64)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + window, -1)
                kept = np.cumsum(cover)[:-1] == 0
                n, removed = np.diff(first), np.diff(np.concatenate([[0], np.cumsum(~kept)])[first])
                raw, texts = data.tobytes(), []
                s, e, keep_list = starts.tolist(), ends.tolist(), kept.tolist()
                for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
                    texts.append(b" ".join([raw[s[i]:e[i]] for i in range(lo, hi) if keep_list[i]]))
                yield pa.RecordBatch.from_arrays([keys, pa.array(n), pa.array(removed), pa.array(texts, pa.binary())], names=["key", "n_words", "n_removed", "kept"])

    marked = with_answers(with_answers(chunks, send_anchors, 1, "anchors"), send_windows, 2, "windows")
    return marked.mapInArrow(finish, f"key {key_type}, n_words long, n_removed long, kept binary").select(
        F.col("key").alias(key), "n_words", "n_removed", F.col("kept").cast("string").alias("kept"))
