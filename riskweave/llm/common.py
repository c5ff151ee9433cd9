"""What several operators share: intermediate tables in the shared folder,
text blocks as numpy arrays, polynomial hashes of words and windows."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from riskweave.session import ensure_checkpoint_dir
from riskweave.sources.kept import kept_folder

#: Separators of the words that mixing, SimHash and substring dedup use, as bytes.
SPACE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: The same words as a Java pattern.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def shared_path(df_or_spark, tag: str) -> str:
    """A new folder name below the shared checkpoint folder."""
    spark = getattr(df_or_spark, "sparkSession", df_or_spark)
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def keep(df: DataFrame, tag: str, group_rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage
    with files that every executor sees, so a lost executor loses nothing.
    Inside a ``scope`` the folder is deleted when that ends. Tasks hold whole
    row groups, which by default are measured after 100 rows first: large rows
    come in groups of ``group_rows`` at most."""
    path = kept_folder(df.sparkSession, shared_path(df, tag))
    out = df.write.option("compression", "zstd")
    (out.option("parquet.block.row.count.limit", group_rows) if group_rows else out).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return freed memory to the system."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def tidy(rows: Callable) -> Callable:
    """``rows`` (a function for mapInArrow) that gives freed memory back to
    the system when a task ends: workers are kept for later tasks, and two of
    each core's stages would otherwise hold their peaks at the same time."""
    def wrapped(batches):
        try:
            yield from rows(batches)
        finally:
            give_back()
    return wrapped


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def cut_blocks(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of about ``limit`` bytes (a longer text is a run)."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def is_word_table(separators) -> np.ndarray:
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


def word_spans(data: np.ndarray, offsets: np.ndarray, word_byte: np.ndarray):
    """Byte starts and ends of all words, and the first word of each text
    (len(texts) + 1 entries). A word never spans two texts."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    mask = word_byte[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(mask)
    before[0], before[1:] = False, mask[:-1]
    starts = np.flatnonzero(mask & (~before | edge[:-1]))
    after = np.empty_like(mask)
    after[-1], after[:-1] = False, mask[1:]
    ends = np.flatnonzero(mask & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: spreads polynomial hashes over all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Poly:
    """Hashes of all slices of a sequence from one running sum, modulo 2^64."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.base = int(rng.integers(1 << 61, dtype=np.int64)) * 8 + 5
        self.table = rng.integers(0, 1 << 64, 256, np.uint64)
        self.power = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            n = 1 << int(n).bit_length()
            step = np.full(n, self.base & (2**64 - 1), np.uint64)
            back = np.full(n, pow(self.base, -1, 2**64), np.uint64)
            step[0] = back[0] = 1
            self.power, self.inverse = np.multiply.accumulate(step), np.multiply.accumulate(back)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Running sums of ``values`` (uint64), with a leading zero."""
        self._grow(len(values) + 1)
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.power[:len(values)], out=out[1:])
        return out

    def slices(self, sums: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return (sums[hi] - sums[lo]) * self.inverse[lo]


BYTES, WINDOWS, WINDOWS2, BYTES2 = Poly(11), Poly(12), Poly(13), Poly(14)
#: Bytes up to which a word is hashed by polynomials: sums modulo 2^64 lose
#: bits on long words of a doubling pattern (all of them from 1,024 bytes on).
POLY_WORD = 16


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    sums = BYTES.sums(BYTES.table[data])
    return mix(BYTES.slices(sums, starts, ends) + (ends - starts).astype(np.uint64))


def word_states(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Two independent 64-bit hashes of each word's bytes (words x 2)."""
    size = (ends - starts).astype(np.uint64)
    out = np.stack([mix(p.slices(p.sums(p.table[data]), starts, ends) + size) for p in (BYTES, BYTES2)], axis=1)
    long = np.flatnonzero(ends - starts > POLY_WORD)
    if len(long):
        raw = data.tobytes()
        digests = b"".join([xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(starts[long].tolist(), ends[long].tolist())])
        out[long] = np.frombuffer(digests, np.uint64).reshape(-1, 2)
    return out


def under_own_names(docs: DataFrame, step: Callable[[DataFrame, dict[str, str]], DataFrame]) -> DataFrame:
    """``step`` applied to ``docs`` under column names that no operator uses,
    and its result with the columns of ``docs`` alone, each its own. ``step``
    also gets the inner name of every column, so that columns called like an
    operator's output keep their values."""
    inner = [f"column_{i}" for i in range(len(docs.columns))]
    return step(docs.toDF(*inner), dict(zip(docs.columns, inner))).select(*inner).toDF(*docs.columns)


def hash_in_text_windows(values: np.ndarray, first: np.ndarray, width: int, poly: Poly = WINDOWS):
    """Hashes of all windows of ``width`` consecutive values, at every start;
    and a mask of the starts whose window stays inside its text."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    sums = poly.sums(values)
    at = np.arange(n)
    hashes = mix(poly.slices(sums, at, at + width))
    text_of = np.searchsorted(first, at, "right") - 1
    return hashes, at + width <= first[text_of + 1]
