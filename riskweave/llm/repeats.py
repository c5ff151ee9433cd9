"""Which hashes occur more than once, over all texts: what the substring and
the suffix-array dedup have in common.

Documents are packed into chunks, compressed rows of about CHUNK bytes of
text with a number of their own, written once. A pass over the chunks turns
each into a sorted array of distinct hashes; its slices go to buckets by the
leading bits, one small row a chunk and bucket; a bucket finds the hashes
that two chunks name (or one chunk twice) and answers each slice with one bit
a hash; the answers return to their chunk by a join. As a chunk names a hash
once, however often it occurs, a hash in a third of all rows makes no hot
bucket. Texts are shuffled compressed, and only for that join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, text_buffers

#: Bytes of text and rows of a chunk (a longer text is a chunk of its own).
CHUNK, CHUNK_ROWS = 1 << 20, 4096
#: Hash bytes that a bucket is expected to hold.
BUCKET = 4 << 20
LEVEL = 3

Chunk = tuple[np.ndarray, np.ndarray]


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The written chunks: chunk, keys, sizes (bytes, -1 for null), bytes, texts."""
    spark_type = docs.schema[key].dataType.simpleString()

    def rows(batches):
        number = TaskContext.get().partitionId() << 32
        keys, sizes, parts, held = [], [], [], 0

        def chunk():
            nonlocal number, keys, sizes, parts, held
            row = pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.ListArray.from_arrays([0, sum(map(len, keys))], pa.concat_arrays(keys)), pa.array([np.concatenate(sizes)], pa.list_(pa.int64())),
                 pa.array([held]), pa.array([zstandard.ZstdCompressor(level=LEVEL).compress(b"".join(parts))], pa.binary())],
                names=["chunk", "keys", "sizes", "bytes", "texts"])
            number, keys, sizes, parts, held = number + 1, [], [], [], 0
            return row

        for batch in batches:
            names, column = batch.column(0), batch.column(1)
            data, offsets = text_buffers(column)
            valid = np.asarray(column.is_valid())
            lo = 0
            while lo < batch.num_rows:
                hi = int(np.searchsorted(offsets, offsets[lo] + CHUNK - held, "right")) - 1
                hi = max(lo + (not keys), min(hi, lo + CHUNK_ROWS - sum(map(len, sizes)), batch.num_rows))
                if hi > lo:
                    keys.append(names.slice(lo, hi - lo))
                    sizes.append(np.where(valid[lo:hi], np.diff(offsets[lo:hi + 1]), -1))
                    parts.append(data[offsets[lo]:offsets[hi]].tobytes())
                    held += len(parts[-1])
                if hi < batch.num_rows or held >= CHUNK:
                    yield chunk()
                lo = hi
        if keys:
            yield chunk()

    return keep(docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(
        rows, f"chunk long, keys array<{spark_type}>, sizes array<bigint>, bytes long, texts binary"), "chunks")


def unpack(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(chunk, keys, sizes with -1 for null, bytes, offsets) of each row."""
    for r in range(batch.num_rows):
        sizes = np.array(batch.column("sizes")[r].values)
        raw = zstandard.ZstdDecompressor().decompress(batch.column("texts")[r].as_py(), max_output_size=max(1, batch.column("bytes")[r].as_py()))
        offsets = np.concatenate([[0], np.cumsum(np.maximum(sizes, 0))])
        yield batch.column("chunk")[r].as_py(), batch.column("keys")[r].values, sizes, np.frombuffer(raw, np.uint8), offsets


def n_buckets(total_hashes: float, width: int) -> int:
    return max(1, int(np.ceil(total_hashes * width * 8 / BUCKET)))


def bucket_of(first: np.ndarray, buckets: int) -> np.ndarray:
    """Monotone in the hash, so sorted hashes have sorted buckets."""
    return ((first >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def distinct(hashes: np.ndarray):
    """Sorted distinct rows of (n x width) hashes, the place of each input
    row among them, and which occur more than once."""
    width = hashes.shape[1]
    order = np.lexsort(hashes.T[::-1]) if width > 1 else np.argsort(hashes[:, 0], kind="stable")
    ranked = hashes[order]
    new = np.concatenate([[True], (ranked[1:] != ranked[:-1]).any(1)]) if len(ranked) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    place = np.empty(len(hashes), np.int64)
    place[order] = np.cumsum(new) - 1
    return ranked[at], place, np.diff(np.append(at, len(ranked))) > 1


def slices(chunk: int, hashes: np.ndarray, buckets: int, counts: bool = False):
    """The rows that a chunk sends: bucket, chunk, its distinct hashes, and a
    bit for each that occurs more than once in the chunk (or its count)."""
    unique, place, many = distinct(hashes)
    if counts:
        many = np.bincount(place, minlength=len(unique)).astype("<u4")
    of = bucket_of(unique[:, 0], buckets).astype(np.int64)
    some, first = np.unique(of, return_index=True)
    end = np.append(first[1:], len(of))
    return pa.RecordBatch.from_arrays(
        [pa.array(some), pa.array(np.full(len(some), chunk)), pa.array([unique[a:b].tobytes() for a, b in zip(first, end)], pa.binary()),
         pa.array([(many[a:b] if counts else np.packbits(many[a:b])).tobytes() for a, b in zip(first, end)], pa.binary())], names=["bucket", "chunk", "hashes", "many"])


def answer(width: int):
    """The answers of a bucket of hashes of ``width`` words each."""
    def rows(table: pa.Table) -> pa.Table:
        blobs = table.column("hashes").to_pylist()
        hashes = np.frombuffer(b"".join(blobs), np.uint64).reshape(-1, width)
        n = np.array([len(b) // (8 * width) for b in blobs])
        many = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=c) for m, c in zip(table.column("many").to_pylist(), n)]).astype(bool)
        _, place, shared = distinct(hashes)
        shared[place[many]] = True
        bits = np.split(shared[place], np.cumsum(n)[:-1])
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "bits": pa.array([np.packbits(b).tobytes() for b in bits], pa.binary())})
    return rows


def answer_counts(crowd: int):
    """Answers of two planes of bits to slices with counts: which hashes occur
    more than once, and which ``crowd`` times or more; and how often the
    latter occur in the slice."""
    def rows(table: pa.Table) -> pa.Table:
        hashes = np.frombuffer(b"".join(table.column("hashes").to_pylist()), np.uint64)[:, None]
        parts = [np.frombuffer(m, "<u4") for m in table.column("many").to_pylist()]
        counts = np.concatenate(parts).astype(np.int64)
        _, place, _ = distinct(hashes)
        times = np.bincount(place, weights=counts)[place]
        at = np.cumsum([len(p) for p in parts])[:-1]
        bits = [np.packbits(a).tobytes() + np.packbits(b).tobytes() for a, b in zip(np.split(times > 1, at), np.split(times >= crowd, at))]
        crowded = [int(c.sum()) for c in np.split(np.where(times >= crowd, counts, 0), at)]
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "bits": pa.array(bits, pa.binary()), "crowded": pa.array(crowded, pa.int64())})
    return rows


def with_answers(chunks: DataFrame, emit: Callable, width: int, name: str) -> DataFrame:
    """``chunks`` with a column ``name``: the answers of all its slices, in
    the order of the buckets. ``emit`` maps batches of chunks to slices."""
    return asked(chunks, chunks.mapInArrow(emit, "bucket long, chunk long, hashes binary, many binary"), answer(width), name)


def asked(chunks: DataFrame, sent: DataFrame, decide: Callable, name: str) -> DataFrame:
    """``chunks`` joined to what ``decide`` makes of each bucket of ``sent``:
    a row (chunk, bucket, bits) for each row sent."""
    return joined(chunks, sent.groupBy("bucket").applyInArrow(decide, "chunk long, bucket long, bits binary"), name)


def joined(chunks: DataFrame, answers: DataFrame, name: str, hint: str | None = None) -> DataFrame:
    """``chunks`` with all their answers as a column ``name``."""
    per_chunk = answers.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "bits"))).alias(name))
    return chunks.join(per_chunk.hint(hint) if hint else per_chunk, "chunk", "left")


def shared_mask(hashes: np.ndarray, buckets: int, answers, plane: int = 0) -> np.ndarray:
    """Which of a chunk's hashes are shared, from its column of answers (or
    what another plane of their bits tells)."""
    if not len(hashes):
        return np.zeros(0, bool)
    unique, place, _ = distinct(hashes)
    n = np.unique(bucket_of(unique[:, 0], buckets), return_counts=True)[1]
    bits = [np.unpackbits(np.frombuffer(a["bits"], np.uint8)[plane * (-(-c // 8)):], count=c) for a, c in zip(answers, n, strict=True)]
    return np.concatenate(bits).astype(bool)[place]
