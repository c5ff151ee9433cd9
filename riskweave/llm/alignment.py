"""Operator 12, alignment of the tokens of two tokenizers.

Both tokenizers cut the bytes of space + text into tokens without gaps. The
tokens of a text, as intervals of bytes, fall into groups at the offsets where
a token of either ends; inside a group every token of one overlaps some of the
other. Found for a whole chunk of texts at once:

1. ``encode``: texts are encoded once; the ids of a chunk of about CHUNK bytes
   of text are one written row, in 16 bits each where the vocabulary allows.
   GROUP_ROWS of these rows are one row group of the file, so a task that
   reads or writes them holds as many, however many its partition has.
2. ``Aligned``: all tokens of both are sorted by start (``lexsort``), the
   running maximum of their ends is taken, and a group breaks where a start
   reaches it. Within it the last started token of each side overlap, one link
   an elementary interval.
3. A chunk names each linked pair of ids once, with the number of its
   documents that hold it, so a pair that nearly all texts hold is one entry a
   chunk; these stand in the chunk's row, found before it is written, as a
   Python task that reads chunks would get all those of its partition at once.
   Sums per pair are the table of corpus-wide counts, their maxima per
   id of A at most one row an entry of its vocabulary.
4. The counts return to the chunks that named the pair, and each chunk, aligned
   again from its ids, gives its documents' rows.

Defined results: texts that are null, empty, or not restored byte for byte by
either tokenizer (such as one with U+2581, or broken UTF-8) have no tokens,
zero counts and '' as groups; strings of special tokens inside a text are
plain text; repeated rows count as documents each; a null or repeated key is
kept as it is; an empty table gives an empty result; other columns are not
read. A text is encoded whole, so one text must fit in a task.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_blocks, give_back, keep, text_buffers, tidy

#: The tokenizers' files, as every executor finds them.
FILE_A, FILE_B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes and rows of a chunk (a longer text is one of its own); bytes encoded
#: and tokens aligned at once.
CHUNK, CHUNK_ROWS, BLOCK, TOKENS = 2 << 20, 16384, 1 << 18, 1 << 17
#: Chunks of a row group of the written file.
GROUP_ROWS = 4


def byte_characters() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable
    Latin-1 as itself, the others from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(others)}}


#: How byte-level BPE cuts a text into words (a fixed value of its file format).
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of these characters, whose classes no Unicode version changed, and
#: without longer runs of other characters than white space, are cut into words
#: and encoded alike by both libraries that read byte-level BPE.
NOT_PLAIN = re.compile("[^\t\n\r\x20-\x7e\xa1-\u024f]|[^\t\n\r ]{512}")


class ByteLevel:
    """A byte-level BPE file of the tokenizers library. Where its merges are
    its ids in order, plain texts (no NOT_PLAIN) go to the faster tiktoken, built from
    the same file's entries; all others to the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        to_byte = byte_characters()
        entries = self.tokenizer.get_vocab()
        self.pieces = [b""] * (max(entries.values()) + 1)
        for piece, i in entries.items():
            self.pieces[i] = bytes(to_byte[c] for c in piece) if all(c in to_byte for c in piece) else piece.encode()

        self.fast = self._fast(path, entries)

    def _fast(self, path: str, entries: dict[str, int]):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in file["model"].get("merges", [])]
        bytes_first = {entries.get(c) for c in byte_characters()} == set(range(256))
        in_order = bytes_first and all(entries.get(a + b) == 256 + k for k, (a, b) in enumerate(merges))
        cutter = file.get("pre_tokenizer") or {}
        plain = (file["model"].get("type") == "BPE" and not file.get("normalizer") and cutter.get("type") == "ByteLevel"
                 and not cutter.get("add_prefix_space") and cutter.get("use_regex", True) and not file["model"].get("dropout")
                 and not file["model"].get("ignore_merges"))
        if not (in_order and plain):
            return None
        import tiktoken
        ranks = {self.pieces[i]: i for i in range(256 + len(merges))}
        return tiktoken.Encoding("byte-level", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list:
        if self.fast is None:
            return self._whole(texts)
        out = [None if NOT_PLAIN.search(t) else self.fast.encode_to_numpy(" " + t, disallowed_special=()) for t in texts]
        others = [k for k, ids in enumerate(out) if ids is None]
        for k, ids in zip(others, self._whole([texts[k] for k in others])):
            out[k] = ids
        return out

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)] if texts else []


class Pieces:
    """A sentencepiece model, which itself puts a space before the text."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.pieces = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
                       for i, p in enumerate(map(self.model.id_to_piece, range(n)))]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The tokenizer of a file, once a worker: its ``encode``, and its
    ``pieces``, the bytes of every id."""
    return Pieces(path) if path.endswith(".model") else ByteLevel(path)


@lru_cache(maxsize=4)
def piece_bytes(path: str) -> pa.Array:
    return pa.array(tokenizer(path).pieces, pa.binary())


@lru_cache(maxsize=4)
def piece_lengths(path: str) -> np.ndarray:
    return np.array([len(p) for p in tokenizer(path).pieces], np.int64)


def id_type(path: str) -> np.dtype:
    return np.dtype("<u2" if len(piece_lengths(path)) <= 1 << 16 else "<u4")


def _bounds(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)])


def encode_texts(column: pa.Array, path_a: str, path_b: str):
    """(row, ids of A, ids of B) of every text, block by block; none for a
    text that either does not restore."""
    data, offsets = text_buffers(column)
    for lo, hi in cut_blocks(offsets, BLOCK):
        raw = [data[a:b].tobytes() for a, b in zip(offsets[lo:hi], offsets[lo + 1:hi + 1])]
        texts = [t.decode("utf-8", "replace") for t in raw]
        both = []
        for path in (path_a, path_b):
            ids = tokenizer(path).encode(texts)
            n = _bounds([len(t) for t in ids])
            flat = np.concatenate([np.asarray(t, np.int64) for t in ids]) if ids else np.zeros(0, np.int64)
            at = _bounds(piece_lengths(path)[flat])[n].tolist()
            _, _, joined = piece_bytes(path).take(pa.array(flat)).buffers()
            joined = memoryview(joined or b"").cast("B")  # Arrow's bytes are signed
            both.append((flat, n, [joined[x:y] == b" " + t for t, x, y in zip(raw, at, at[1:])]))
        (a, na, good_a), (b, nb, good_b) = both
        for r, t in enumerate(raw):
            if t and good_a[r] and good_b[r]:
                yield lo + r, a[na[r]:na[r + 1]], b[nb[r]:nb[r + 1]]
            else:
                yield lo + r, a[:0], b[:0]


def encode(docs: DataFrame, key: str, text: str, path_a: str, path_b: str) -> DataFrame:
    """The written chunks: chunk, keys, n_a, n_b (tokens of each text), a, b (ids),
    pairs (every linked pair of ids once, as a * (ids of B) + b), docs (how many
    of its texts hold each)."""
    key_type = docs.schema[key].dataType.simpleString()

    def rows(batches):
        number = TaskContext.get().partitionId() << 32
        types, lengths = (id_type(path_a), id_type(path_b)), (piece_lengths(path_a), piece_lengths(path_b))
        keys, counts, ids, held = [], [], [], 0

        def chunk():
            nonlocal number, keys, counts, ids, held
            n_a, n_b = np.array(counts, np.int32).T
            a, b = (b"".join(i[s] for i in ids) for s in (0, 1))
            pairs, docs = chunk_pairs(n_a, np.frombuffer(a, types[0]), n_b, np.frombuffer(b, types[1]), lengths)
            row = pa.RecordBatch.from_arrays(
                [pa.array([number]), *[pa.ListArray.from_arrays([0, len(x)], x) for x in (pa.concat_arrays(keys), pa.array(n_a), pa.array(n_b))],
                 pa.array([a], pa.binary()), pa.array([b], pa.binary()),
                 *[pa.ListArray.from_arrays([0, len(x)], pa.array(x)) for x in (pairs, docs)]],
                names=["chunk", "keys", "n_a", "n_b", "a", "b", "pairs", "docs"])
            number, keys, counts, ids, held = number + 1, [], [], [], 0
            return row

        for batch in batches:
            size = np.diff(text_buffers(batch.column(1))[1])
            done = 0
            for r, a, b in encode_texts(batch.column(1), path_a, path_b):
                counts.append((len(a), len(b)))
                ids.append((a.astype(types[0]).tobytes(), b.astype(types[1]).tobytes()))
                held += int(size[r])
                if held >= CHUNK or len(counts) >= CHUNK_ROWS:
                    keys.append(batch.column(0).slice(done, r + 1 - done))
                    done = r + 1
                    yield chunk()
            if done < batch.num_rows:
                keys.append(batch.column(0).slice(done))
        if counts:
            yield chunk()

    return keep(docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(
        tidy(rows), f"chunk long, keys array<{key_type}>, n_a array<int>, n_b array<int>, a binary, b binary, pairs array<long>, docs array<int>"),
        "token-chunks", GROUP_ROWS)


class Aligned:
    """Groups and links of the tokens of consecutive texts, each of which
    both tokenizers cut whole."""

    def __init__(self, a, n_a, b, n_b, lengths_a, lengths_b):
        size_a, size_b = lengths_a[a], lengths_b[b]
        end = np.concatenate([np.cumsum(size_a), np.cumsum(size_b)])
        start = end - np.concatenate([size_a, size_b])
        side = np.repeat([0, 1], [len(a), len(b)])
        order = np.lexsort((side, start))
        begins, is_b = start[order], side[order] == 1
        reach = np.maximum.accumulate(end[order])
        breaks = np.ones(len(order), bool)
        breaks[1:] = begins[1:] >= reach[:-1]
        self.group = np.cumsum(breaks) - 1
        self.ids = np.concatenate([a, b])[order]
        self.is_b = is_b
        #: tokens, groups and links before each text
        self.first = _bounds(n_a + n_b)
        self.first_group = _bounds(breaks)[self.first]
        # the tokens of either side that are open where the next one starts
        at = np.arange(len(order))
        open_a, open_b = (np.maximum.accumulate(np.where(mine, at, -1)) for mine in (~is_b, is_b))
        last = np.ones(len(order), bool)
        last[:-1] = begins[1:] != begins[:-1]
        self.link_a, self.link_b = self.ids[open_a[last]], self.ids[open_b[last]]
        self.first_link = _bounds(last)[self.first]

    def groups(self, n_a_ids: int, n_b_ids: int) -> pa.Array:
        """``a1,a2|b1;a3|b2,b3`` of each text: decimal ids, groups in order."""
        place = 2 * self.group + self.is_b
        order = np.argsort(place, kind="stable")
        ids, is_b, place = self.ids[order], self.is_b[order], place[order]
        goes_on = np.zeros(len(order), bool)
        goes_on[:-1] = place[1:] == place[:-1]
        at = ids + np.where(is_b, 2 * n_a_ids + np.where(goes_on, 0, n_b_ids), np.where(goes_on, 0, n_a_ids))
        ends = self.first[1:][np.diff(self.first) > 0] - 1
        at[ends] += n_b_ids  # nothing behind the last token, one of B
        written = _written(n_a_ids, n_b_ids).take(pa.array(at))
        _, offsets, data = written.buffers()
        offsets = np.frombuffer(offsets, np.int64, len(at) + 1) if len(at) else np.zeros(1, np.int64)
        return pa.LargeStringArray.from_buffers(len(self.first) - 1, pa.py_buffer(offsets[self.first].astype(np.int64)), data or pa.py_buffer(b""))


@lru_cache(maxsize=2)
def _written(n_a: int, n_b: int) -> pa.Array:
    """Ids as text with what may follow: , and | behind A, , and ; and nothing behind B."""
    return pa.array([f"{i}{mark}" for n, marks in ((n_a, ",|"), (n_b, (",", ";", ""))) for mark in marks for i in range(n)], pa.large_string())


def aligned(n_a, a, n_b, b, lengths):
    """(first, end, alignment) of runs of texts, TOKENS tokens at once (or one
    longer text)."""
    n_a, n_b = n_a.astype(np.int64), n_b.astype(np.int64)
    at_a, at_b = _bounds(n_a), _bounds(n_b)
    for lo, hi in cut_blocks(at_a + at_b, TOKENS):
        yield lo, hi, Aligned(a[at_a[lo]:at_a[hi]].astype(np.int64), n_a[lo:hi], b[at_b[lo]:at_b[hi]].astype(np.int64), n_b[lo:hi], *lengths)


def unpack(chunks, r: int, types, lengths):
    """(keys, n_a, n_b, alignment) of runs of texts of row ``r`` of a table of
    chunks."""
    keys = chunks.column("keys")[r].values
    n_a, n_b = (np.array(chunks.column(c)[r].values, np.int64) for c in ("n_a", "n_b"))
    a, b = (np.frombuffer(chunks.column(c)[r].as_buffer(), t) for c, t in zip("ab", types))
    for lo, hi, found in aligned(n_a, a, n_b, b, lengths):
        yield keys.slice(lo, hi - lo), n_a[lo:hi], n_b[lo:hi], found


def _pairs(found: Aligned, n_b_ids: int):
    """The distinct linked pairs of texts, sorted, and how many texts hold each."""
    pair = found.link_a * n_b_ids + found.link_b
    text = np.repeat(np.arange(len(found.first_link) - 1), np.diff(found.first_link))
    order = np.lexsort((text, pair))
    pair, text = pair[order], text[order]
    new_pair = np.concatenate([[True], pair[1:] != pair[:-1]])[:len(pair)]
    new = new_pair | np.concatenate([[True], text[1:] != text[:-1]])[:len(pair)]
    at = np.flatnonzero(new_pair)
    return pair[at], np.add.reduceat(new, at, dtype=np.int64) if len(at) else at


def chunk_pairs(n_a, a, n_b, b, lengths) -> tuple[np.ndarray, np.ndarray]:
    """The distinct linked pairs of a chunk, sorted, and how many of its texts
    hold each."""
    parts = [_pairs(found, len(lengths[1])) for _, _, found in aligned(n_a, a, n_b, b, lengths)]
    pair, place = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
    docs = np.zeros(len(pair), np.int32)
    np.add.at(docs, place, np.concatenate([n for _, n in parts]).astype(np.int32))
    return pair, docs


def pair_counts(pairs: DataFrame, n_b_ids: int) -> DataFrame:
    """(pair, a, b, docs, best): how many documents hold each linked pair,
    and whether no pair of the same id of A is held by more."""
    counts = keep(pairs.groupBy("pair").agg(F.sum("docs").alias("docs"))
                  .select("pair", F.expr(f"pair div {n_b_ids}").alias("a"), (F.col("pair") % n_b_ids).alias("b"), "docs"), "pair-counts")
    most = counts.groupBy("a").agg(F.max("docs").alias("most"))  # one row an id of A at most
    return counts.join(F.broadcast(most), "a").select("pair", "a", "b", "docs", (F.col("docs") == F.col("most")).alias("best"))


def align(docs: DataFrame, key: str = "doc_id", text: str = "text", path_a: str = FILE_A, path_b: str = FILE_B):
    """(rows, counts). rows: (key, n_a, n_b, n_groups, n_links, n_best,
    count_sum, groups) of every document; counts: the table of
    ``pair_counts``, whose docs are the counts that rows refer to."""
    chunks = encode(docs, key, text, path_a, path_b)
    pairs = chunks.select(F.col("chunk").alias("of"), F.inline(F.arrays_zip(F.col("pairs").alias("pair"), "docs")))
    n_a_ids, n_b_ids = len(piece_lengths(path_a)), len(piece_lengths(path_b))
    counts = pair_counts(pairs, n_b_ids)
    # as many rows a pair as chunks name it: one for each CHUNK bytes at most
    answers = pairs.select("of", "pair").join(counts.select("pair", "docs", "best"), "pair")

    def finish(held: pa.Table, told: pa.Table) -> pa.Table:
        types, lengths = (id_type(path_a), id_type(path_b)), (piece_lengths(path_a), piece_lengths(path_b))
        pair = told.column("pair").to_numpy()
        order = np.argsort(pair)
        pair, n, best = pair[order], told.column("docs").to_numpy()[order], told.column("best").to_numpy()[order]
        parts = []
        for r in range(held.num_rows):
            for keys, n_a, n_b, found in unpack(held, r, types, lengths):
                at = np.searchsorted(pair, found.link_a * n_b_ids + found.link_b)
                total, wins = (_bounds(x[at])[found.first_link] for x in (n, best))
                parts.append(pa.table([keys, pa.array(n_a), pa.array(n_b), *[pa.array(np.diff(x)) for x in (found.first_group, found.first_link, wins, total)],
                                       found.groups(n_a_ids, n_b_ids).cast(pa.string())], names=["key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]))
        give_back()
        return pa.concat_tables(parts)

    key_type = docs.schema[key].dataType.simpleString()
    rows = chunks.drop("pairs", "docs").groupBy("chunk").cogroup(answers.groupBy("of")).applyInArrow(
        finish, f"key {key_type}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")
    return rows.withColumnRenamed("key", key), counts
