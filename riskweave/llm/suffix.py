"""Operator 5, suffix-array dedup of bytes.

Finding every byte covered by a WINDOW-byte string that also starts anywhere
else, in three passes over packed chunks (see ``repeats``):

1. Every window names the smallest hash of its GRAM-byte pieces; equal windows
   name the same one, about one position in 85 is named, and only runs of
   windows whose hash is named at two positions can hold a repeat. A hash
   named at CROWD positions or more is crowded, such as one of a passage
   shorter than the window in many texts that go on differently. Windows that
   name a crowded hash are counted each by 128 bits of their own hash, through
   the same exchange of chunks and buckets, which decides them: no task gets
   all surroundings of such a passage.
2. The other runs (the region of bytes that their windows cover) are sent to
   shards by that hash, so equal windows always meet in one shard. A shard
   keeps equal regions once with their number, and builds the suffix array of
   the rest by induced sorting: suffixes are classified as larger (L) or
   smaller (S) than their successor, leftmost-smaller (LMS) substrings are
   sorted by induction and named, the string of names is sorted by doubling
   names of names until they differ or reach past the window, and the whole
   array is induced from them, L suffixes left to right, S right to left. The
   permuted common prefixes, along runs of equal distance, then tell which
   suffixes share WINDOW bytes with a neighbour.
3. The answers, one bit a window, return to their chunks, which cut the bytes.

All steps work on whole arrays: a bucket of the array (one first byte) is
induced at once. The order need only be right for WINDOW bytes, so naming
stops there.

Null texts count as empty; texts shorter than the window lose nothing;
windows never span texts, so ends of regions are checked by length, not by
separators, and texts may hold any byte; repeated rows are texts like any
other; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.sources.kept import kept_folder

from .common import BYTES, WINDOWS2, keep, mix, shared_path
from .repeats import LEVEL, answer, answer_counts, asked, bucket_of, joined, n_buckets, pack, shared_mask, slices, unpack

WINDOW, GRAM = 200, 32
#: Region bytes that a shard is expected to hold, if SHARE of the input is in regions.
SHARD, SHARE = 2 << 20, 0.5
#: Positions from which on a name is crowded: the regions of one with fewer have
#: at most 2 * window - GRAM bytes each, 1.5 MB together.
CROWD = 4096
#: Values handled at once by a sliding minimum.
SLIDE = 1 << 14


# --- suffix arrays -----------------------------------------------------------

def smaller_type(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (the end is smallest)."""
    n = len(t)
    at = np.arange(n)
    differs = np.ones(n, bool)
    differs[:-1] = t[:-1] != t[1:]
    up = np.zeros(n, bool)
    up[:-1] = t[:-1] < t[1:]
    return up[np.minimum.accumulate(np.where(differs, at, n)[::-1])[::-1]]


class _Append:
    """Per-byte queues in one array: values are appended behind (or, for the
    S pass, in front of) what a byte's queue holds, in the order given."""

    def __init__(self, counts: np.ndarray, size: int):
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.held = np.zeros(256, np.int64)
        self.values = np.empty(int(counts.sum()), np.int32)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        if not len(values):
            return
        order = np.argsort(keys, kind="stable")  # radix sort for bytes
        n = np.bincount(keys, minlength=256)
        to = np.repeat(self.first[:256] + self.held - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(len(values))
        self.values[to] = values[order]
        self.held += n

    def of(self, byte: int, start: int = 0) -> np.ndarray:
        return self.values[self.first[byte] + start:self.first[byte] + self.held[byte]]


def induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes in order, from the LMS suffixes in order."""
    n = len(t)
    larger, smaller = _Append(np.bincount(t[~small], minlength=256), n), _Append(np.bincount(t[small], minlength=256), n)
    seeds = _Append(np.bincount(t[lms], minlength=256), n)
    seeds.add(t[lms], lms)

    def before(q, want_small):
        p = q[q > 0] - 1
        p = p[small[p] == want_small]
        return p, t[p]

    larger.add(t[n - 1:], np.array([n - 1]))  # before the empty suffix
    for c in range(256):
        done = 0
        while done < larger.held[c]:
            wave = larger.of(c, done)
            done = larger.held[c]
            p, k = before(wave, False)
            larger.add(k, p)
        p, k = before(seeds.of(c), False)
        larger.add(k, p)
    for c in range(255, -1, -1):
        done = 0
        while done < smaller.held[c]:
            wave = smaller.of(c, done)
            done = smaller.held[c]
            p, k = before(wave, True)
            smaller.add(k, p)
        p, k = before(larger.of(c)[::-1], True)
        smaller.add(k, p)
    return np.concatenate([x for c in range(256) for x in (larger.of(c), smaller.of(c)[::-1])]) if n else np.zeros(0, np.int32)


def words_at(t: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as one number (first byte lowest),
    zeros behind the end; 8 entries more than ``t``."""
    padded = np.zeros(len(t) + 16, np.uint8)
    padded[:len(t)] = t
    return np.ndarray(len(t) + 8, "<u8", padded, strides=(1,)).copy()


def _same_bytes(x: np.ndarray) -> np.ndarray:
    """Equal leading bytes of two words, from their XOR (8 if it is 0)."""
    return np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3


def common_prefix(eight: np.ndarray, i: np.ndarray, j: np.ndarray, cap: int, n: int) -> np.ndarray:
    """Length of the common prefix of suffixes i and j, ``cap`` at most."""
    out = np.zeros(len(i), np.int64)
    left = np.arange(len(i))
    for at in range(0, cap, 8):
        a, b = i[left] + at, j[left] + at
        inside = np.maximum(a, b) < n
        left, a, b = left[inside], a[inside], b[inside]
        same = _same_bytes(eight[a] ^ eight[b])
        out[left] = at + same
        left = left[same == 8]
        if not len(left):
            break
    return np.minimum(np.minimum(out, cap), n - np.maximum(i, j))


def ascending(keys: np.ndarray) -> np.ndarray:
    """Places of the keys (int64, none negative) in order, equal keys by their
    place: a sort of both in one number where they fit, as it is much faster."""
    shift = len(keys).bit_length()
    if not len(keys) or int(keys.max()).bit_length() + shift > 63:
        return np.argsort(keys, kind="stable")
    return np.sort(keys << shift | np.arange(len(keys))) & ((1 << shift) - 1)


def suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of the bytes ``t``, in order for ``depth`` bytes at least."""
    n = len(t)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    small = smaller_type(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(lms) > 1:
        # sort the LMS substrings, each to the start of the next, by induction
        order = induce(t, small, lms)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        ranked = order[is_lms[order]]
        number = np.zeros(n, np.int64)
        number[lms] = np.arange(len(lms))
        length = np.append(np.diff(lms) + 1, n - lms[-1] + 1)  # the last one holds the end
        a, b = ranked[:-1].astype(np.int64), ranked[1:].astype(np.int64)
        size = length[number[a]]
        equal = (size == length[number[b]]) & (number[a] < len(lms) - 1) & (number[b] < len(lms) - 1)
        eight = words_at(t)
        at, pairs = 0, np.flatnonzero(equal)
        while len(pairs):
            need = np.minimum(size[pairs] - at, 8)
            same = _same_bytes(eight[a[pairs] + at] ^ eight[b[pairs] + at]) >= need
            equal[pairs[~same]] = False
            at += 8
            pairs = pairs[same & (size[pairs] > at)]
        name = np.empty(len(lms), np.int64)
        name[number[ranked]] = np.concatenate([[0], np.cumsum(~equal)])
        # sort the string of names: names of 1, 2, 4, ... names; each name is 2 bytes or more
        span = 1
        while name.max() + 1 < len(lms) and 2 * span < depth + 2:
            behind = np.zeros(len(lms), np.int64)
            behind[:-span] = name[span:] + 1
            both = name * (len(lms) + 1) + behind
            order = ascending(both)
            name[order] = np.concatenate([[0], np.cumsum(np.diff(both[order]) > 0)])
            span *= 2
        lms = lms[ascending(name)]
    return induce(t, small, lms)


def permuted_prefixes(t: np.ndarray, order: np.ndarray, cap: int) -> np.ndarray:
    """For each position, the common prefix with the suffix before it in
    ``order`` (``cap`` at most). Where neighbours keep their distance from
    one position to the next, the value follows from the next one's."""
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    last = np.ones(n, bool)  # of a run of equal distance
    last[:-1] = before[1:] != before[:-1] + 1
    last |= before < 0
    some = np.flatnonzero(last & (before >= 0))
    value = np.zeros(n, np.int64)
    value[some] = common_prefix(words_at(t), some, before[some], cap, n)
    stop = last | (t != t[before])
    at = np.arange(n)
    end = np.minimum.accumulate(np.where(stop, at, n)[::-1])[::-1]
    return np.minimum(np.where(last, value, end - at + np.where(last[end], value[end], 0)), cap)


def repeated_windows(t: np.ndarray, room: np.ndarray, times: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions whose ``window`` bytes occur again. ``room``: bytes left in
    the position's region; ``times``: how often that region occurs."""
    order = suffix_array(t, window)
    prefix = permuted_prefixes(t, order, window)
    valid = room >= window
    out = np.zeros(len(t), bool)
    if len(t):
        first = np.flatnonzero(prefix[order] < window)  # of suffixes that share a window
        total = np.add.reduceat(np.where(valid, times, 0)[order], first)
        out[order] = np.repeat(total >= 2, np.diff(np.append(first, len(t))))
    return out & valid


# --- regions -----------------------------------------------------------------

def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over x[i:i + width], for every start: over 2,
    4, 8, ... values, then two runs of them that overlap. In blocks that stay
    in the processor's cache."""
    n = len(x) - width + 1
    out = np.empty(n, x.dtype)
    spare = [np.empty(SLIDE + width, x.dtype) for _ in range(2)]
    for lo in range(0, n, SLIDE):
        size = min(SLIDE, n - lo)
        run, span = x[lo:lo + size + width - 1], 1
        while 2 * span <= width:
            spare.reverse()
            run = pick(run[:-span], run[span:], out=spare[0][:len(run) - span])
            span *= 2
        pick(run[:size], run[width - span:width - span + size], out=out[lo:lo + size])
    return out


def named(data: np.ndarray, offsets: np.ndarray, window: int):
    """For every window start its smallest piece hash (0 where the window
    leaves its text), and the hashes at the positions so named."""
    n = len(data)
    if n < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    sums = BYTES.sums(BYTES.table[data])
    piece = mix((sums[GRAM:] - sums[:-GRAM]) * BYTES.inverse[:n - GRAM + 1]) | np.uint64(1)
    width = window - GRAM + 1
    least = _sliding(piece, width, np.minimum)
    end = np.repeat(offsets[1:], np.diff(offsets))
    least[end[:len(least)] - np.arange(len(least)) < window] = 0
    # a position is named if some window over it has its hash
    around = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    return least, piece[_sliding(around, width, np.maximum) == piece]


def regions(least: np.ndarray, shared: np.ndarray):
    """Runs [a, b) of window starts that name the same shared hash."""
    if not len(least):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    end = np.append(first[1:], len(least))
    use = (least[first] > 0) & np.isin(least[first], shared)
    return first[use], end[use], least[first[use]]


def window_hashes(data: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """128 bits (n x 2) for the window at each of the positions."""
    return np.stack([mix(p.slices(p.sums(p.table[data]), at, at + window)) for p in (BYTES, WINDOWS2)], axis=1)


def _decide(window: int):
    """Answers of one shard: a bit for each window of each region sent."""
    def rows(table: pa.Table) -> pa.Table:
        unzip = zstandard.ZstdDecompressor()
        lengths = [np.frombuffer(x, "<i4") for x in table.column("lengths").to_pylist()]
        seen: dict[bytes, int] = {}
        which, texts = [], []
        for blob, sizes in zip(table.column("regions").to_pylist(), lengths):
            raw = unzip.decompress(blob)
            at = 0
            for size in sizes.tolist():
                text = raw[at:at + size]
                at += size
                k = seen.setdefault(text, len(seen))
                if k == len(texts):
                    texts.append(text)
                which.append(k)
        which = np.array(which, np.int64)
        times = np.bincount(which)
        size = np.array([len(x) for x in texts])
        first = np.concatenate([[0], np.cumsum(size)])
        t = np.frombuffer(b"".join(texts), np.uint8)
        del texts, seen
        room = np.repeat(first[1:], size) - np.arange(len(t))
        repeat = repeated_windows(t, room, np.repeat(times, size), window)
        bits, at = [], 0
        for sizes in lengths:
            own = [repeat[first[k]:first[k + 1] - window + 1] for k in which[at:at + len(sizes)].tolist()]
            at += len(sizes)
            bits.append(np.packbits(np.concatenate(own)).tobytes())
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "bits": pa.array(bits, pa.binary())})
    return rows


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept): kept is the remaining bytes,
    concatenated (empty for null)."""
    if window <= GRAM:
        raise ValueError(f"the window must have more than {GRAM} bytes")
    chunks = pack(docs, key, text)
    total = chunks.agg(F.sum("bytes")).first()[0] or 0
    buckets = n_buckets(2 * total / (window - GRAM + 2), 1)
    shards = max(1, int(np.ceil(total * SHARE / SHARD)))
    key_type = docs.schema[key].dataType.simpleString()

    def send_names(batches):
        for batch in batches:
            for chunk, _, _, data, offsets in unpack(batch):
                _, hashes = named(data, offsets, window)
                if len(hashes):
                    yield slices(chunk, spread(hashes), buckets, counts=True)

    def spread(hashes):
        # names are minima, nearly all near zero: buckets go by other bits
        return mix(hashes)[:, None]

    def crowds(hashes, answers):
        return np.unique(hashes[shared_mask(spread(hashes), buckets, answers or [], 1)])

    def found(data, offsets, answers):
        """Regions in the order of their shards, and starts of crowded windows."""
        least, hashes = named(data, offsets, window)
        shared, crowded = np.unique(hashes[shared_mask(spread(hashes), buckets, answers or [])]), crowds(hashes, answers)
        a, b, name = regions(least, np.setdiff1d(shared, crowded, assume_unique=True))
        shard = bucket_of(mix(name), shards).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        return a[order], b[order], shard[order], np.flatnonzero(np.isin(least, crowded))

    def mark(batches):
        """What a chunk needs later, each found once. Kind 0: the runs and the
        starts of crowded windows, kept for the chunk; 1: a shard's regions;
        2: a bucket's hashes of crowded windows."""
        zipped = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            for (chunk, _, _, data, offsets), answers in zip(unpack(batch), batch.column("names")):
                a, b, shard, at = found(data, offsets, answers.as_py())
                rows = [(0, 0, np.stack([a, b, shard]).astype("<i8").tobytes(), b"", at.astype("<i8").tobytes(), b"")]
                raw = data.tobytes()
                some, first = np.unique(shard, return_index=True)
                for k, lo, hi in zip(some.tolist(), first, np.append(first[1:], len(shard))):
                    blob = zipped.compress(b"".join([raw[x:y + window - 1] for x, y in zip(a[lo:hi].tolist(), b[lo:hi].tolist())]))
                    rows.append((1, k, blob, (b[lo:hi] - a[lo:hi] + window - 1).astype("<i4").tobytes(), b"", b""))
                if len(at):
                    counted = slices(chunk, window_hashes(data, at, window), crowd_buckets)
                    rows += [(2, k, b"", b"", h, m) for k, h, m in zip(*[counted.column(c).to_pylist() for c in ("bucket", "hashes", "many")])]
                kind, bucket, *blobs = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kind, pa.int32()), pa.array(bucket, pa.int64()), pa.array(np.full(len(rows), chunk)), *[pa.array(x, pa.binary()) for x in blobs]],
                    names=["kind", "bucket", "chunk", "regions", "lengths", "hashes", "many"])

    def finish(batches):
        for batch in batches:
            columns = [batch.column(c) for c in ("runs", "starts", "crowded", "repeats")]
            for (_, keys, _, data, offsets), runs, at, counted, decided in zip(unpack(batch), *columns):
                a, b, shard = np.frombuffer(runs.as_py(), "<i8").reshape(3, -1)
                at = np.frombuffer(at.as_py(), "<i8")
                cover = np.zeros(len(data) + 1, np.int64)
                if len(at):
                    at = at[shared_mask(window_hashes(data, at, window), crowd_buckets, counted.as_py())]
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + window, -1)
                if len(a):
                    n = np.add.reduceat(b - a, np.unique(shard, return_index=True)[1])
                    bits = np.concatenate([np.unpackbits(np.frombuffer(d["bits"], np.uint8), count=c) for d, c in zip(decided.as_py(), n, strict=True)])
                    starts = np.repeat(a - np.concatenate([[0], np.cumsum(b - a)[:-1]]), b - a) + np.arange(len(bits))
                    starts = starts[bits > 0]
                    np.add.at(cover, starts, 1)
                    np.add.at(cover, starts + window, -1)
                gone = np.cumsum(cover)[:-1] > 0
                edge = np.zeros(len(data) + 1, bool)
                edge[offsets] = True
                begins = gone & (~np.concatenate([[False], gone[:-1]]) | edge[:-1]) if len(gone) else gone
                removed, spans = (np.diff(np.concatenate([[0], np.cumsum(x)])[offsets]) for x in (gone, begins))
                left = data[~gone].tobytes()
                at = np.concatenate([[0], np.cumsum(np.diff(offsets) - removed)]).tolist()
                texts = [left[x:y] for x, y in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays([keys, pa.array(np.diff(offsets)), pa.array(removed), pa.array(spans), pa.array(texts, pa.binary())],
                                                 names=["key", "n_bytes", "n_removed", "n_spans", "kept"])

    sent = chunks.mapInArrow(send_names, "bucket long, chunk long, hashes binary, many binary")
    answers = keep(sent.groupBy("bucket").applyInArrow(answer_counts(CROWD), "chunk long, bucket long, bits binary, crowded long"), "names")
    # each position is the name of up to this many windows; four times BUCKET, as many are equal within a chunk
    crowded = (answers.agg(F.sum("crowded")).first()[0] or 0) * (window - GRAM + 1)
    crowd_buckets = n_buckets(crowded / 4, 2)
    schema = "kind int, bucket long, chunk long, regions binary, lengths binary, hashes binary, many binary"
    # one plan at every size: neither names nor runs of all chunks are broadcast
    marked = joined(chunks, answers.select("chunk", "bucket", "bits"), "names", "merge").mapInArrow(mark, schema)
    path = kept_folder(docs.sparkSession, shared_path(docs, "marks"))
    marked.write.partitionBy("kind").option("compression", "zstd").parquet(path)
    marks = docs.sparkSession.read.schema(schema).parquet(path)
    runs = marks.filter("kind = 0").select("chunk", F.col("regions").alias("runs"), F.col("hashes").alias("starts"))
    counted = marks.filter("kind = 2").select("bucket", "chunk", "hashes", "many")
    regions_sent = marks.filter("kind = 1").select("bucket", "chunk", "regions", "lengths")
    whole = asked(asked(chunks.join(runs.hint("merge"), "chunk"), counted, answer(2), "crowded"), regions_sent, _decide(window), "repeats")
    return whole.mapInArrow(
        finish, f"key {key_type}, n_bytes long, n_removed long, n_spans long, kept binary").withColumnRenamed("key", key)
