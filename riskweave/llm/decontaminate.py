"""Operator 7, benchmark decontamination with a generalised suffix automaton.

The normalised words of all test items are put into one suffix automaton. A
document's words are streamed through it; the state and the length of the
longest match that ends at each word are tracked, and a word is hit if it
lies inside a window of WINDOW consecutive item words (a shorter item is one
window). Documents are only mapped: nothing is shuffled, and the work is
linear in their words.

The items are a stated query set, handled in blocks of at most BLOCK_WORDS
words: one automaton a block is built inside the tasks from the block's
words, so what is broadcast is bounded whatever the benchmark's size. With
several blocks the documents' marks are written and read between them.

``mark`` returns what matched; ``remove`` deletes the hit words from the
texts, and whole documents whose share of hit words exceeds ``coverage``.

Null and empty texts and items have no words; repeated items and items with
equal texts are one item each by id; an item without id counts under the
empty id; repeated documents come back each; an empty benchmark marks nothing;
an empty table gives an empty result; other columns pass through, and a
column called like an output column is replaced.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, tidy

WINDOW, COVERAGE = 10, 0.5
#: Item words of one automaton (about two states a word).
BLOCK_WORDS = 100_000
#: Documents marked at once.
ROWS = 512
#: Bytes that are part of a word once A-Z are lower-cased: 0-9, a-z, non-ASCII.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_SEPARATED = bytes(c if WORD.match(bytes([c])) else 0x20 for c in bytes(range(256)).lower())
OUT = ["n_words", "n_hit", "items", "hits"]


def words(text: bytes | None) -> list[bytes]:
    """The normalised words of a text in UTF-8."""
    return (text or b"").translate(_SEPARATED).split()


class Automaton:
    """Generalised suffix automaton of word sequences."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.ids = [key for key, _ in items]
        self.number: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [[self.number.setdefault(w, len(self.number)) for w in text] for _, text in items]
        for text in coded:
            last = 0
            for w in text:
                last = self._extend(last, w)
        #: items of the window that a state holds, and (words, item) of short items
        self.of_window: list[set[int] | None] = [None] * len(self.next)
        own: list[list[tuple[int, int]]] = [[] for _ in self.next]
        for k, text in enumerate(coded):
            state = 0
            for i, w in enumerate(text):
                state = self._at_most(self.next[state][w], window)
                if i >= window - 1:
                    if self.of_window[state] is None:
                        self.of_window[state] = set()
                    self.of_window[state].add(k)
            if 0 < len(text) < window:
                own[state].append((len(text), k))
        #: short items that end where a state's longest string ends: its own and its links'
        self.short: list[list[tuple[int, int]]] = [[] for _ in self.next]
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.short[s] = self.short[self.link[s]] + own[s] if own[s] else self.short[self.link[s]]

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if (q := nxt[last].get(w)) is not None:
            return q if length[q] == length[last] + 1 else self._split(last, w, q)
        new = self._state(length[last] + 1, {}, 0)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, w, q)
        return new

    def _split(self, p: int, w: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves), self.length.append(length), self.link.append(link)
        return len(self.next) - 1

    def _at_most(self, state: int, n: int) -> int:
        """The state of the last ``n`` words of a state's strings."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def match(self, text: list[bytes], hits: np.ndarray, found: set[int]) -> None:
        """Mark the hit words of a text and add the items found."""
        nxt, link, length, window = self.next, self.link, self.length, self.window
        get, short, of_window = self.number.get, self.short, self.of_window
        state = n = 0
        for i, w in enumerate(map(get, text)):
            if w is None:
                state = n = 0
                continue
            move = nxt[state].get(w)
            while move is None and state:
                state = link[state]
                n = length[state]
                move = nxt[state].get(w)
            if move is None:
                n = 0
                continue
            state, n = move, n + 1
            if n >= window:
                hits[i + 1 - n:i + 1] = True
                found |= of_window[self._at_most(state, window)]
                # longer matches mark the words before this window already
                while length[link[state]] >= window:
                    state = link[state]
                n = min(n, length[state])
            if short[state]:
                for size, item in short[state]:
                    if size <= n:
                        hits[i + 1 - size:i + 1] = True
                        found.add(item)


_BUILT: dict[str, Automaton] = {}


def _automaton(name: str, items, window: int) -> Automaton:
    """This process's automaton of a block; only the latest is kept."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Automaton(items, window)
    return _BUILT[name]


def _blocks(benchmark: DataFrame, key: str, text: str):
    """Items as (id, words), in blocks of bounded size."""
    block, held = [], 0
    items = benchmark.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), F.col(text).cast("string").alias("text"))
    for row in items.distinct().toLocalIterator():
        if item := words(row.text.encode() if row.text is not None else None):
            if block and held + len(item) > BLOCK_WORDS:
                yield block
                block, held = [], 0
            block.append((row.id, item))
            held += len(item)
    if block:
        yield block


def _marked(docs: DataFrame, benchmark: DataFrame, text: str, window: int, item_key: str, item_text: str, finish: Callable | None) -> DataFrame:
    """The documents after all blocks; ``finish`` makes the last pass's output."""
    marked = docs.drop(*OUT).withColumns({"n_words": F.lit(0).cast("long"), "n_hit": F.lit(0).cast("long"),
                                          "items": F.array().cast("array<string>"), "hits": F.lit(None).cast("binary")})
    previous, k = [], 0
    for block in _blocks(benchmark, item_key, item_text):
        if k:
            marked = keep(_mark_block(marked, text, previous, window), "marks")
        previous, k = block, k + 1
    return _mark_block(marked, text, previous, window, docs if finish else None, finish)


def mark(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with n_words, n_hit, items (sorted ids of items found) and
    hits (one bit a word)."""
    return _marked(docs, benchmark, text, window, item_key, item_text, None)


def _mark_block(docs: DataFrame, text: str, block, window: int, out: DataFrame | None = None, finish: Callable | None = None) -> DataFrame:
    name, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(block)

    def rows(batches):
        automaton = _automaton(name, shared.value, window)
        for batch in (b.slice(lo, ROWS) for b in batches for lo in range(0, b.num_rows, ROWS)):
            column = batch.column(text).cast(pa.binary())
            n_words, n_hit, items, marks = [], [], [], []
            for value, before, so_far in zip(column, batch.column("hits"), batch.column("items")):
                these = words(value.as_py())
                old = before.as_py()
                hits = np.unpackbits(np.frombuffer(old, np.uint8), count=len(these)).astype(bool) if old is not None else np.zeros(len(these), bool)
                found: set[int] = set()
                automaton.match(these, hits, found)
                n_words.append(len(these)), n_hit.append(int(hits.sum()))
                items.append(sorted({automaton.ids[x] for x in found} | set(so_far.as_py())))
                marks.append(np.packbits(hits).tobytes())
            new = {"n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()),
                   "items": pa.array(items, pa.list_(pa.string())), "hits": pa.array(marks, pa.binary())}
            marked = pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in batch.schema.names], names=batch.schema.names)
            yield finish(marked) if finish else marked

    return docs.mapInArrow(tidy(rows), (docs if out is None else out).schema)


def cut_words(text: bytes, hits: np.ndarray) -> bytes:
    """A text without its hit words; what stood between kept words stays, and
    a removed run leaves one space."""
    spans = [m.span() for m in WORD.finditer(bytes(text).lower())]
    out, at, i = [], 0, 0
    while i < len(spans):
        if not hits[i]:
            i += 1
            continue
        j = i
        while j < len(spans) and hits[j]:
            j += 1
        out.append(text[at:spans[i][0]])
        at = spans[j - 1][1]
        i = j
    out.append(text[at:])
    return b" ".join(x.strip() for x in out if x.strip()) if len(out) > 1 else text


def remove(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """``docs`` (same columns) without the hit words, and without documents
    of which more than ``coverage`` of the words are hit. Documents without a
    hit are returned as they are."""
    # under names that no mark has; all columns get their own back
    names = [f"column_{i}" for i in range(len(docs.columns))]
    text_at = names[docs.columns.index(text)]

    def finish(batch):
        n_words, n_hit = (batch.column(c).to_numpy() for c in ("n_words", "n_hit"))
        column = batch.column(text_at)
        if n_hit.any():
            column = pa.array([
                cut_words(t.as_py().encode(), np.unpackbits(np.frombuffer(h.as_py(), np.uint8), count=w).astype(bool)).decode("utf-8", "replace") if n else t.as_py()
                for t, n, w, h in zip(column, n_hit, n_words.tolist(), batch.column("hits"))], pa.string())
        cut = pa.RecordBatch.from_arrays([column if c == text_at else batch.column(c) for c in names], names=names)
        return cut.filter(pa.array(n_hit <= coverage * n_words))

    return _marked(docs.toDF(*names), benchmark, text_at, window, "item_id", "text", finish).toDF(*docs.columns)
