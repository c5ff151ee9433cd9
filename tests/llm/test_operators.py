"""The dealt operators against brute-force versions, on the smallest tables
and on rows made to be awkward: nulls, empty and long texts, ties, repeated
rows, empty tables, and extra columns with clashing names."""

import base64
import gzip
import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline
from riskweave.llm import components, decontaminate, embedding, language, mixing, sharding, simhash, substring, suffix, toxicity, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, n_hit string, score string, shard string"


def _phrase(n, seed):
    rng = np.random.default_rng(seed)
    return " ".join("w" + str(x) for x in rng.integers(0, 10**6, n))


def _awkward():
    long = _phrase(6000, 1)
    shared = _phrase(60, 2)
    texts = [
        None, None, "", " \t\n ", "one", "two words", "ONE", "Ünïcödé ÀÉ  x 9", "a b c", "\0 nul \x1f", "...!?", "12 34",
        long, long, long + " tail", "head " + long[:9000], shared, "x " + shared + " y", _phrase(20, 3) + " " + shared + "\n" + shared,
        "ab " * 400, "ab " * 401, "-" * 5000, "é" * 500, "é" * 300 + "a" * 300, _phrase(35, 4), _phrase(35, 4), _phrase(34, 4) + " other",
        "You IDIOT " + _phrase(30, 5), "tie tie tie", "tie tie tie", "x" * 199, "x" * 200, "x" * 201, "\U0001F600 smile " * 60,
    ]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, len(t) if t else None, "a", "b", "c", "d") for i, t in enumerate(texts)]
    return rows + [rows[12], rows[5], (None, shared, None, None, 1, None, None, None, None), (None, None, "fr", "s1", None, "", "", "", ""), (-7, "minus " + shared, "de", "￿", 3, "", "", "", "")]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(_awkward(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module", params=["documents", "awkward", "empty"])
def docs(request, documents, awkward):
    return {"documents": documents, "awkward": awkward, "empty": awkward.filter("false")}[request.param]


def _rows(df):
    return [tuple(r) for r in df.collect()]


def _multi(rows):
    return Counter(map(repr, rows))


def _sha(x):
    return hashlib.sha256(x).hexdigest()


# 1 ---------------------------------------------------------------------------

def _targets(sizes, weights=(3, 1, 2), share=1.5):
    """Reshare the excess of stopped sources by weight until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, target, full = share * sum(sizes.values()), {}, set()
    while True:
        left = total - sum(2 * sizes[s] for s in full)
        live = [s for s in order if s not in full]
        target = {s: 2.0 * sizes[s] for s in full}
        target |= {s: w[s] * left / sum(w[x] for x in live) for s in live}
        above = {s for s in live if target[s] >= 2 * sizes[s]}
        if not above:
            return target
        full |= above


def test_mixing(docs):
    got = mixing.mix(docs).collect()
    want = Counter((r.doc_id, len(WORD.findall(r.text or ""))) for r in docs.collect())
    assert Counter((r.doc_id, r["size"]) for r in got) == want
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
        assert r.taken in (0, r["size"], 2 * r["size"]) and r.taken == r.copies * r["size"]
    target = _targets(sizes) if got else {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
    assert sum(target.values()) == pytest.approx(1.5 * sum(sizes.values()))
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s]
    again = mixing.mix(docs.repartition(2)).collect()
    assert _multi((r.doc_id, r["size"], r.taken) for r in got) == _multi((r.doc_id, r["size"], r.taken) for r in again)


@pytest.mark.parametrize("units, numbered", [(4096, 100_000), (7, 50)])
def test_mixing_of_equal_rows(spark, monkeypatch, units, numbered):
    """A source of equal rows, also without id, meets its target as others do."""
    monkeypatch.setattr(mixing, "UNITS", units)
    monkeypatch.setattr(mixing, "NUMBERED", numbered)
    rows = [(i, _phrase(20 + i % 60, i), "a") for i in range(800)] + [(5, _phrase(40, 1), "b")] * 1000 + [(None, _phrase(30, 2), "c")] * 500 + [(None, "", "c")] * 9
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    taken, target = Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken in (0, r["size"], 2 * r["size"])
    assert sum(target.values()) == pytest.approx(1.5 * sum(r["size"] for r in got))
    for source, n in (("a", 80), ("b", 40), ("c", 30)):
        steps = 1 if units == 4096 else 1 + 1000 // units
        assert abs(taken[source] - target[source]) <= n * steps
    again = mixing.mix(df.repartition(2)).collect()
    assert Counter((r.doc_id, r["size"], r.taken) for r in got) == Counter((r.doc_id, r["size"], r.taken) for r in again)


def test_mixing_dual_meets_the_constraints_before_rounding(documents):
    sizes = documents.select(F.col("source"), F.concat(F.lit("s"), "source").alias("key"), mixing.n_words(F.col("text")).alias("n")).cache()
    n = defaultdict(list)
    for r in sizes.collect():
        n[r.key].append(r.n)
    solved = mixing.solve_dual(sizes, mixing.source_targets(sizes)).collect()
    assert {r.key for r in solved} == set(n)
    for r in solved:
        size = np.array(n[r.key])
        assert (size * np.minimum(2, np.exp(np.minimum(r.lam * size, 1)))).sum() == pytest.approx(r.target, rel=1e-8)


# 2 ---------------------------------------------------------------------------

def test_sharding_table_is_filled_in_turns():
    for shards, slots in ((1, 2), (3, 7), (7, 101), (32, 4099)):
        table = sharding.fill_table(shards, slots)
        n = Counter(table)
        assert set(n) == set(range(shards)) and max(n.values()) - min(n.values()) <= 1
    with pytest.raises(ValueError):
        sharding.fill_table(3, 8)


def test_sharding_moves_few_keys():
    a, b = sharding.fill_table(31), sharding.fill_table(32)
    assert sum(x != y for x, y in zip(a, b)) < 0.2 * len(a)


def test_sharding_rows(docs):
    got = sharding.shard(docs).collect()
    table = sharding.fill_table(sharding.SHARDS)
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r.doc_id, r.text) for r in docs.collect())
    for r in got:
        key = "\\N" if r.doc_id is None else str(r.doc_id)
        slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % sharding.SLOTS
        assert (r.slot, r.shard) == (slot, table[slot])


# 3 ---------------------------------------------------------------------------

def test_warc(spark, sf):
    rows = [(i, None if i == 4 else f"http://h/{i}\r\nx", h) for i, h in enumerate(
        [None, "", "a", "a", "b\r\n\r\nWARC/1.1\r\n\r\n", "x" * 300000, "a", "é", "é\0"])]
    rows += [(3, "u", "a"), (3, "u", "a"), (None, "n", "a"), (None, "n", "only")]
    made = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, record_type string").repartition(3)
    for pages in (made, made.filter("false"), spark.read.parquet(f"{sf}/pages.parquet")):
        source = [(r.page_id, r.html or "") for r in pages.collect()]
        best = {}
        for p, h in source:
            best[h] = max(best.get(h, -1), -1 if p is None else p)
        got = warc.archive(pages).collect()
        assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == Counter(
            (p, len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()) for p, h in source)
        original = {base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(): p for h, p in best.items()}
        responses = Counter()
        for r in got:
            p = original[r.payload_digest]
            if r.record_type == "response":
                responses[r.payload_digest] += 1
                assert (-1 if r.page_id is None else r.page_id) == p and r.refers_to is None
            else:
                assert r.record_type == "revisit" and r.refers_to == (None if p == -1 else p)
        assert all(n == 1 for n in responses.values()) and len(responses) == len(best)


def test_warc_round_trip_and_smallest_size(spark):
    pages = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "v", "bbbb"), (4, "v", "bbbb")], "page_id long, url string, html string")
    raw = warc.write_pages(pages, warc.shared_path(spark, "t"))
    back = warc.read_records(spark, raw, payloads=True)
    assert sorted((r.page_id, r.url, r.payload) for r in back.collect()) == sorted(_rows(pages))
    small = warc.archive(pages, min_bytes=3).collect()
    assert sorted((r.page_id, r.record_type) for r in small) == [(1, "response"), (2, "response"), (3, "revisit"), (4, "response")]


def test_warc_keeps_bytes_and_http_headers(spark, tmp_path, monkeypatch):
    """Payloads that are no UTF-8, in archives of others."""
    monkeypatch.setattr(warc, "FILE_RECORDS", 2)
    http = b"HTTP/1.1 203 Other\r\nX-Own: \xe9"
    records = []
    for i, payload in enumerate([b"caf\xe9", b"caf\xe9", b"\xff\r\n\r\n\x00", b""]):
        block, digest = http + b"\r\n\r\n" + payload, base64.b32encode(hashlib.sha1(payload).digest())
        records.append(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x:%d>\r\nX-Page-Id: %d\r\nWARC-Date: 2020-01-0%dT00:00:00Z\r\n"
                       b"WARC-Payload-Digest: sha1:%s\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (i, i, i + 1, digest, len(block), block))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc.gz").write_bytes(gzip.compress(b"".join(records)))
    out = warc.deduplicate(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert len(list((tmp_path / "out").glob("*.gz"))) >= 2
    rows = {r.page_id: r for r in warc.read_records(spark, out, raw=True).collect()}
    assert all(bytes(r.http) == http and r.date == f"2020-01-0{i + 1}T00:00:00Z" for i, r in rows.items())
    assert {i: bytes(r.payload) for i, r in rows.items() if r.record_type == "response"} == {1: b"caf\xe9", 2: b"\xff\r\n\r\n\x00", 3: b""}
    assert rows[0].record_type == "revisit" and all(r.intact for r in rows.values())
    assert {r.page_id: (r.payload_bytes, r.refers_to) for r in warc.read_resolved(spark, out).collect()} == {0: (4, 1), 1: (4, None), 2: (6, None), 3: (0, None)}


# 4 ---------------------------------------------------------------------------

def _fingerprint(text, k=3):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_simhash(docs):
    rows = docs.collect()
    prints = [_fingerprint(r.text) for r in rows]
    distinct = sorted(set(prints))
    root = _components(distinct, [(a, b) for i, a in enumerate(distinct) for b in distinct[:i] if (a ^ b).bit_count() <= 3])
    least = defaultdict(lambda: math.inf)
    for r, p in zip(rows, prints):
        if r.doc_id is not None:
            least[root[p]] = min(least[root[p]], r.doc_id)
    want = _multi((r.doc_id, f"{p:016x}", least[root[p]]) for r, p in zip(rows, prints))
    assert _multi(_rows(simhash.near_duplicates(docs))) == want


def test_simhash_is_xxh64_of_spark(spark, documents):
    h = documents.limit(5).select("text", F.xxhash64(F.lit("a b c")).alias("h")).first().h
    assert h % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)


def test_anchors_cover_all_close_pairs():
    rng = np.random.default_rng(0)
    for bits in (0, 1, 2, 3, 4):
        a = rng.integers(0, 2**64, 200, np.uint64)
        b = a.copy()
        for _ in range(bits):
            b ^= np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)
        wa, xa, ha = simhash.anchors(a, bits)
        wb, xb, _ = simhash.anchors(b, bits)
        home, seen = defaultdict(set), defaultdict(set)
        for w, x, h in zip(wa, xa, ha):
            if h:
                home[w].add(x)
        for w, x in zip(wb, xb):
            seen[w].add(x)
        assert all(len(home[i]) == 2 and home[i] & seen[i] for i in range(200))


def test_simhash_links_survive_crowded_anchors(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**64, 3, np.uint64)
    prints = np.unique([b ^ (np.uint64(1) << np.uint64(i)) ^ (np.uint64(1) << np.uint64(j)) for b in base for i in range(24) for j in range(24)]).view(np.int64)
    df = spark.createDataFrame([(int(p),) for p in prints], "fingerprint long")
    monkeypatch.setattr(simhash, "in_blocks", lambda m, k, s: simhash.__dict__["_real"](m, k, s, 7))
    simhash._real = __import__("riskweave.llm.pairing", fromlist=["x"]).in_blocks
    got = {r.node: r.component for r in components.components(simhash.link(df)).collect()}
    u = prints.view(np.uint64)
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= 3
    want = _components(prints.tolist(), [(int(prints[i]), int(prints[j])) for i, j in zip(*np.nonzero(near)) if i < j])
    assert got == {k: v for k, v in want.items() if k in got} and set(want) - set(got) <= {k for k, v in want.items() if k == v}


def test_components(spark):
    rng = np.random.default_rng(2)
    for n, m in ((1, 0), (50, 30), (400, 380), (300, 900)):
        links = [(int(a), int(b)) for a, b in rng.integers(0, n, (m, 2))] + [(i, i + 1) for i in range(1000, 1000 + n)] + [(5000, 6000 + i) for i in range(n)]
        got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
        want = _components({x for l in links for x in l}, links)
        assert all(got.get(k, k) == v for k, v in want.items())
    assert components.components(spark.createDataFrame([], "a long, b long")).isEmpty()


# 5 and 8 ---------------------------------------------------------------------

def _repeats(texts, width, join):
    """Covered positions of each sequence, by counting all windows."""
    n = Counter(join(t[i:i + width]) for t in texts for i in range(len(t) - width + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - width + 1):
            if n[join(t[i:i + width])] > 1:
                gone[i:i + width] = [True] * width
        out.append(gone)
    return out


def test_suffix_array_dedup(docs):
    rows = docs.collect()
    texts = [(r.text or "").encode() for r in rows]
    want = []
    for r, t, gone in zip(rows, texts, _repeats(texts, 200, bytes)):
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        want.append((r.doc_id, len(t), sum(gone), spans, _sha(bytes(b for b, g in zip(t, gone) if not g))))
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, _sha(bytes(r.kept))) for r in suffix.remove_repeats(docs).collect()]
    assert _multi(got) == _multi(want)


def test_suffix_array_core():
    rng = np.random.default_rng(3)
    for _ in range(150):
        n, k, w = int(rng.integers(0, 80)), int(rng.choice([1, 2, 4, 250])), int(rng.integers(1, 6))
        t = rng.integers(0, k, n).astype(np.uint8)
        raw = t.tobytes()
        order = suffix.suffix_array(t, 10**6)
        assert order.tolist() == sorted(range(n), key=lambda i: raw[i:])
        if n:
            prefix = suffix.permuted_prefixes(t, order, 7)
            for a, b in zip(order[:-1].tolist(), order[1:].tolist()):
                assert prefix[b] == min(7, len(os.path.commonprefix([raw[a:], raw[b:]])))
            edge = np.sort(rng.integers(0, n + 1, 3))
            room = np.append(edge, n)[np.searchsorted(edge, np.arange(n), "right")] - np.arange(n)
            seen = Counter(raw[i:i + w] for i in range(n) if room[i] >= w)
            assert suffix.repeated_windows(t, room, np.ones(n, int), w).tolist() == [bool(room[i] >= w and seen[raw[i:i + w]] > 1) for i in range(n)]


def test_substring_dedup(docs):
    rows = docs.collect()
    texts = [tuple(WORD.findall(r.text or "")) for r in rows]
    want = [(r.doc_id, len(t), sum(gone), _sha(" ".join(w for w, g in zip(t, gone) if not g).encode()))
            for r, t, gone in zip(rows, texts, _repeats(texts, 35, tuple))]
    got = [(r.doc_id, r.n_words, r.n_removed, _sha(r.kept.encode())) for r in substring.remove_repeats(docs).collect()]
    assert _multi(got) == _multi(want)


def test_substring_tells_long_words_apart(spark):
    """Two words of a doubling pattern, equal in polynomials modulo 2^64."""
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    same = " ".join(["w"] * 34)
    df = spark.createDataFrame([(1, f"{same} {word}"), (2, f"{same} {other}")], "doc_id long, text string")
    assert [r.n_removed for r in substring.remove_repeats(df).collect()] == [0, 0]
    df = spark.createDataFrame([(1, f"{same} {word}"), (2, f"{same} {word}")], "doc_id long, text string")
    assert [r.n_removed for r in substring.remove_repeats(df).collect()] == [35, 35]


def test_cover_holds_all_differences():
    assert {(a - b) % substring.PERIOD for a in substring.COVER for b in substring.COVER} == set(range(substring.PERIOD))


def _sent(monkeypatch, df, column, run):
    """What ``run`` deals out to buckets in rows with ``column``."""
    made, kind = [], type(df)
    plain = kind.mapInArrow

    def spy(self, f, schema, *args, **kwargs):
        out = plain(self, f, schema, *args, **kwargs)
        if column in out.columns:
            made.append(out)
        return out
    with monkeypatch.context() as m:
        m.setattr(kind, "mapInArrow", spy)
        return run(), made


def test_suffix_array_bounds_shards_of_a_short_passage(spark, monkeypatch):
    """A passage shorter than the window, with other text around it in each
    document: none of that may meet in one shard; repeats stay repeats."""
    passage, rng = _phrase(18, 21), np.random.default_rng(22)
    around = [("".join(map(chr, rng.integers(97, 123, 200))), "".join(map(chr, rng.integers(97, 123, 200)))) for _ in range(300)]
    texts = [a + passage + b for a, b in around] + [around[3][0] + passage + around[4][1], around[7][0] + passage + around[7][1], around[9][0][100:] + passage + around[9][1][:60]]
    assert 100 < len(passage) < suffix.WINDOW
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    monkeypatch.setattr(suffix, "CROWD", 64, raising=False)
    monkeypatch.setattr(suffix, "SHARD", 1 << 14)
    got, sent = _sent(monkeypatch, df, "lengths", lambda: {r.doc_id: (r.n_removed, bytes(r.kept)) for r in suffix.remove_repeats(df).collect()})
    raw = [t.encode() for t in texts]
    assert got == {i: (sum(g), bytes(c for c, x in zip(t, g) if not x)) for i, (t, g) in enumerate(zip(raw, _repeats(raw, 200, bytes)))}
    held = defaultdict(int)
    for r in sent[0].collect():
        held[r.bucket] += int(np.frombuffer(r.lengths, "<i4").sum())
    assert max(held.values(), default=0) <= 64 * (2 * suffix.WINDOW - suffix.GRAM)


def test_suffix_array_names_fill_buckets_alike(documents, monkeypatch):
    """Names are minima of many hashes: their leading bits are all but zero."""
    monkeypatch.setattr(suffix, "n_buckets", lambda total, width: 12)
    _, sent = _sent(monkeypatch, documents, "hashes", lambda: suffix.remove_repeats(documents))
    held = {r.bucket: r.n for r in sent[0].groupBy("bucket").agg((F.sum(F.length("hashes")) / 8).alias("n")).collect()}
    assert len(held) == 12 and max(held.values()) < 1.2 * sum(held.values()) / 12


def test_suffix_array_with_all_names_crowded(awkward, monkeypatch):
    one = _multi(_rows(suffix.remove_repeats(awkward)))
    monkeypatch.setattr(suffix, "CROWD", 2)
    assert one == _multi(_rows(suffix.remove_repeats(awkward)))


def test_small_chunks_and_many_buckets_change_nothing(awkward, monkeypatch):
    from riskweave.llm import repeats
    one = (_multi(_rows(substring.remove_repeats(awkward))), _multi(_rows(suffix.remove_repeats(awkward))))
    monkeypatch.setattr(repeats, "CHUNK", 3000)
    monkeypatch.setattr(repeats, "CHUNK_ROWS", 4)
    monkeypatch.setattr(repeats, "BUCKET", 500)
    monkeypatch.setattr(suffix, "SHARD", 3000)
    assert one == (_multi(_rows(substring.remove_repeats(awkward))), _multi(_rows(suffix.remove_repeats(awkward))))


# 6 and 9 ---------------------------------------------------------------------

def _crc(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


def test_language_on_held_out_documents(spark, sf):
    got = E.queries()["op6_language"](spark, sf).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(got) == len(docs)
    right = []
    for r in got:
        assert r.held_out == (_crc(r.doc_id, 4) == 2) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in docs[r.doc_id].text or ""))
        if r.held_out and r.lang_pred != "und":
            right.append(r.lang_pred == docs[r.doc_id].lang)
    assert np.mean(right) > 0.95


def test_language_edges(awkward):
    model = language.fit(awkward, F.lit(True))
    for df, m in ((awkward, model), (awkward, None), (awkward.filter("false"), model)):
        got = language.identify(df, m).collect()
        assert Counter((r.doc_id, r.text) for r in got) == Counter((r.doc_id, r.text) for r in df.collect())
        for r in got:
            letters = any(c.isalpha() for c in r.text or "")
            assert (r.lang_pred in ("en", "de")) if letters and m else (r.lang_pred, r.score) == ("und", 0.0)
    assert language.fit(awkward, F.lit(False)) is None
    far = language.identify(awkward, model, reject=True).filter("rejected").select("lang_pred").distinct().collect()
    assert [r.lang_pred for r in far] == ["und"]


def test_language_sample_of_rows_without_id(spark, monkeypatch):
    """SAMPLE bounds each language, and rows without or with equal ids are drawn each."""
    word = lambda i: "".join(chr(97 + int(d)) for d in f"{i:04d}")
    rows = [(None, f"wort {word(i)}", "de") for i in range(1500)] + [(7, f"mot {word(i)}", "fr") for i in range(1500)]
    rows += [(None, "same words", "en")] * 1200 + [(i, f"other {word(i)}", "en") for i in range(400)] + [(None, "few", "it")] * 30
    kept, keep = {}, language.keep
    monkeypatch.setattr(language, "SAMPLE", 200)
    monkeypatch.setattr(language, "keep", lambda df, tag: kept.setdefault(tag, keep(df, tag)))
    language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5), F.lit(True))
    found = kept["lang-sample"].groupBy("lang").agg(F.count("*").alias("n"), F.count_distinct("x").alias("texts")).collect()
    n, texts = {r.lang: r.n for r in found}, {r.lang: r.texts for r in found}
    assert all(150 <= n[k] <= 200 for k in ("de", "fr", "en")) and n["it"] == 30
    assert texts["de"] > 120 and texts["fr"] > 120 and 25 <= texts["en"] <= 75


def test_language_astral_symbols_are_no_letters(spark):
    df = spark.createDataFrame([(1, "plain words here", "en"), (2, "andere worte hier", "de"), (3, "\U0001F600 \U0001F680\U0001F44D", None),
                                (4, "\U00010330\U00010331 \U00010332", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(df, language.fit(df, F.lit(True))).collect()}
    assert got[3] == ("und", 0.0)
    assert got[4][0] != "und"  # Gothic letters


def test_language_counts_pieces_of_long_texts_whole(monkeypatch):
    import pyarrow as pa
    text = "Der schnelle Fuchs springt. " * 50
    whole = next(language.count_blocks(pa.array([text])))[1]
    monkeypatch.setattr(language, "CHARS", 280)
    assert abs(next(language.count_blocks(pa.array([text])))[1] - whole).sum() < 0.05 * whole.sum()


def test_toxicity_on_held_out_documents(spark, sf):
    larger = sf.replace("sf0.001", "sf0.1")
    got = E.queries()["op9_toxicity"](spark, larger).toPandas()
    assert len(got) == spark.read.parquet(f"{larger}/documents.parquet").count()
    assert got.score.between(0, 1).all() and ((got.score >= 0.7) == (got.predicted == 1)).all()
    assert (got.held_out == [_crc(i, 3) == 1 for i in got.doc_id]).all()
    labels = spark.read.parquet(f"{larger}/labels.parquet").toPandas().set_index("doc_id").toxic
    test = got[got.held_out & got.doc_id.isin(labels.index)]
    truth = labels.loc[test.doc_id].to_numpy()
    said = test.predicted.to_numpy()
    assert (said[truth == 0] == 0).mean() > 0.98  # clean documents are left alone
    assert (truth[said == 1] == 1).mean() > 0.85
    assert (said[truth == 1] == 1).mean() > 0.7  # some labels are noise: no term tells these apart
    low, high = np.sort(test.score[truth == 0]), test.score[truth == 1]
    assert np.searchsorted(low, high).mean() / len(low) > 0.85  # AUC


def test_toxicity_learns_pairs():
    """An insult counts only beside a group mention: additive weights cannot tell."""
    rng = np.random.default_rng(4)
    sets, labels = [], []
    for _ in range(4000):
        s = [t for t in (0, 1) if rng.random() < 0.5]
        sets.append(np.array(s + [int(rng.integers(2, 12))], np.uint16))
        labels.append(float(len(s) == 2))
    model = toxicity.train(sets, np.array(labels), 12)
    size = np.array([len(s) for s in sets])
    score = toxicity.raw_score(model, np.concatenate([[0], np.cumsum(size)]), np.concatenate(sets).astype(int))
    assert ((score > 0) == (np.array(labels) > 0)).mean() > 0.99
    assert model["v"][0] @ model["v"][1] > 1


def test_toxicity_learns_pairs_of_neutral_terms(spark):
    """Label 1 if both or neither of two words occur: neither tells anything alone."""
    rng = np.random.default_rng(6)
    rows, labels = [], []
    for i in range(6000):
        a, b = rng.random(2) < 0.5
        filler = " ".join(f"word{k}" for k in rng.integers(0, 400, 8))
        rows.append((i, f"{'mira ' if a else ''}{filler}{' kest' if b else ''}"))
        labels.append((i, int(a == b), 0))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    model = toxicity.fit(docs, marks, F.col("doc_id") < 4000)
    got = toxicity.score(docs, model).collect()
    truth = {i: y for i, y, _ in labels}
    assert np.mean([(r.score >= 0.5) == truth[r.doc_id] for r in got if r.doc_id >= 4000]) > 0.95


def test_toxicity_scores_by_hand(spark, sf, docs):
    """Every score recomputed pair by pair from the model."""
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True))
    if model is None:
        assert docs.count() == 0
        return
    place = {t: k for k, t in enumerate(model["terms"].tolist())}
    for r in toxicity.score(docs.filter("length(text) < 3000 or text is null"), model).collect():
        found = set()
        for word in re.findall(rb"[0-9a-z\x80-\xff]+", (r.text or "").encode().lower()):
            data, n = np.frombuffer(word, np.uint8), np.array([len(word)])
            found.add(int(toxicity.word_hashes(data, np.array([0]), n)[0] >> np.uint64(64 - toxicity.HASH_BITS)))
            if len(word) > toxicity.PREFIX:
                found.add(int(~toxicity.word_hashes(data, np.array([0]), np.array([toxicity.PREFIX]))[0] >> np.uint64(64 - toxicity.HASH_BITS)))
        known = sorted(place[t] for t in found if t in place)
        v = model["v"][known].astype(float)
        log_odds = model["b"] + model["w"][known].astype(float).sum() + sum(v[i] @ v[j] for i in range(len(v)) for j in range(i))
        assert r.score == pytest.approx(1 / (1 + math.exp(-min(60, max(-60, log_odds)))), abs=1e-5)


def test_toxicity_edges(spark, awkward):
    labels = spark.createDataFrame([(i, i % 2 if i % 7 else None, "x") for i in range(36)] + [(None, 1, "x"), (12, 0, "x")], "doc_id long, toxic int, text string")
    model = toxicity.fit(awkward, labels, F.lit(True))
    for df in (awkward, awkward.filter("false")):
        for m in (model, None):
            got = toxicity.score(df, m).collect()
            assert Counter((r.doc_id, r.text) for r in got) == Counter((r.doc_id, r.text) for r in df.collect())
            assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert toxicity.fit(awkward, labels.filter("false"), F.lit(True)) is None


def test_term_sets_are_the_distinct_words_and_prefixes(spark, awkward):
    made = spark.createDataFrame([(1, "Worthless worthless, worthy wort")], "doc_id long, text string")
    assert len(toxicity.term_sets(made, "doc_id", "text").first().terms) >= 2 * 4  # three words, one prefix
    sets = {r.key: len(toxicity.from_gaps(r.terms)) for r in toxicity.term_sets(awkward.filter("doc_id in (5, 28, 1, 2)"), "doc_id", "text").collect()}
    assert sets == {5: 2, 28: 1, 1: 0, 2: 0}
    assert len(toxicity.from_gaps(toxicity.term_sets(made, "doc_id", "text").first().terms)) == 4


def test_gaps_round_trip():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 1 << 22, n)) for n in (0, 1, 5, 300, 0, 2)] + [np.array([0]), np.array([65535, 131070, 131071, (1 << 22) - 1])]
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    for want, got in zip(sets, toxicity.to_gaps(row, np.concatenate(sets).astype(np.int64), len(sets)), strict=True):
        assert toxicity.from_gaps(got).tolist() == want.tolist()
    assert toxicity.to_gaps(np.zeros(0, int), np.zeros(0, int), 2) == [b"", b""]


# 7 ---------------------------------------------------------------------------

def _mark(rows, items, width=10):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for key, text in items:
        w = words(text)
        for i in range(max(1, len(w) - width + 1)) if w else ():
            windows[tuple(w[i:i + width])].add("" if key is None else str(key))
    sizes = {len(x) for x in windows}
    for r in rows:
        w = words(r.text)
        hit, found = [False] * len(w), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i:i + n])) in windows:
                    found |= windows[x]
                    hit[i:i + n] = [True] * n
        yield r.doc_id, len(w), sum(hit), sorted(found)


@pytest.mark.parametrize("block_words", [100_000, 40])
def test_decontamination(spark, sf, docs, block_words, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block_words)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()][:8 if block_words < 100 else None]
    items += [(100, None), (101, ""), (102, "Tie TIE"), (103, "one"), (104, _phrase(60, 2)), (104, _phrase(35, 4)), (None, "two words"), (105, "one"), (106, "ab " * 12), (107, "... !")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = _rows(decontaminate.mark(docs, bench).select("doc_id", "n_words", "n_hit", "items"))
    assert _multi(got) == _multi(_mark(docs.collect(), items))
    assert all(r.n_hit == 0 for r in decontaminate.mark(docs, bench.filter("false")).collect())


def test_automaton_on_random_sequences():
    rng = np.random.default_rng(5)
    row = type("R", (), {})
    for _ in range(150):
        k, width = int(rng.integers(1, 4)), int(rng.integers(1, 6))
        make = lambda n: " ".join("abc"[x] for x in rng.integers(0, k, rng.integers(0, n)))
        items = [(i, make(14)) for i in range(int(rng.integers(0, 5)))]
        automaton = decontaminate.Automaton([(str(i), decontaminate.words(t.encode())) for i, t in items], width)
        r = row()
        r.doc_id, r.text = 0, make(60)
        words = decontaminate.words(r.text.encode())
        hits, found = np.zeros(len(words), bool), set()
        automaton.match(words, hits, found)
        assert (0, len(words), int(hits.sum()), sorted({automaton.ids[x] for x in found})) == next(_mark([r], items, width))


def test_decontamination_removes_spans(spark):
    item = _phrase(30, 9)
    rows = [(1, "Keep this, " + item + "; and that."), (2, "clean text  stays\n as it is."), (3, item), (4, None), (5, ""),
            (6, _phrase(40, 8) + "\n" + item.upper() + "\n" + _phrase(50, 7))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = dict(_rows(decontaminate.remove(docs, spark.createDataFrame([(1, item)], "item_id long, text string"), coverage=0.9)))
    assert got == {1: "Keep this, ; and that.", 2: rows[1][1], 4: None, 5: "", 6: _phrase(40, 8) + " " + _phrase(50, 7)}


def test_decontamination_keeps_columns_named_like_marks(spark, sf, awkward):
    item = _phrase(30, 9)
    docs = spark.createDataFrame([("seen", "a " + item + " b", 7, "i", 1.5), (None, "clean", None, "j", 2.5)], "n_hit string, text string, n_words long, items string, hits double")
    got = decontaminate.remove(docs, spark.createDataFrame([(1, item)], "item_id long, text string"), coverage=0.99)
    assert got.schema == docs.schema
    assert _multi(_rows(got)) == _multi([("seen", "a b", 7, "i", 1.5), (None, "clean", None, "j", 2.5)])
    out = corpus_pipeline.keep(corpus_pipeline.decontaminate(spark, awkward, sf), "test")
    assert out.columns == awkward.columns and {r.n_hit for r in out.collect()} == {"b", None, ""}


# 10 --------------------------------------------------------------------------

def _links(rows, threshold=0.9):
    x = [None if r.embedding is None or not len(r.embedding) or any(v is None or not math.isfinite(v) for v in r.embedding) or not any(r.embedding)
         else np.array(r.embedding, float) for r in rows]
    unit = [None if v is None else v / np.linalg.norm(v / np.abs(v).max()) / np.abs(v).max() for v in x]
    return [(i, j) for i, a in enumerate(unit) if a is not None for j in range(i) if unit[j] is not None and len(unit[j]) == len(a) and a @ unit[j] >= threshold]


def test_embedding(spark, sf):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(3, 16))
    rows = [(i, [float(v) for v in base[i % 3] + 0.2 * rng.normal(size=16)]) for i in range(200)]
    rows += [(300, None), (301, []), (302, [0.0] * 16), (303, [None, 1.0]), (304, [float("nan")] * 2), (305, [float("inf"), 1.0]), (306, [1.0, 0.0]),
             (307, [-0.0, 1.0]), (308, [0.0, 1.0]), (309, [0.0, 5.0]), (310, [1e-300, 0.0]), (311, [1e300, 0.0]), (311, [1e300, 0.0]), (5, rows[5][1])]
    made = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, n_links string").repartition(3)
    for df, least in ((made, 1.0), (made.filter("false"), 1.0), (spark.read.parquet(f"{sf}/embeddings.parquet"), 0.98)):
        source = sorted(df.collect(), key=lambda r: repr(r))
        links = _links(source)
        n = Counter(x for l in links for x in l)
        got = embedding.near_duplicates(df).collect()
        assert len(got) == len(source) and sum(r.n_links for r in got) <= 2 * len(links)
        assert sum(r.n_links for r in got) >= least * 2 * len(links)
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)
        if least == 1.0:
            root = _components({r.vec_id for r in source}, [(source[i].vec_id, source[j].vec_id) for i, j in links])
            assert _multi((r.vec_id, r.n_links, r.component_id) for r in got) == _multi(
                (r.vec_id, n[i], root[r.vec_id]) for i, r in enumerate(source))


@pytest.mark.parametrize("kind", ["double", "float"])
def test_embedding_recall_of_pairs_at_the_threshold(spark, kind):
    """1,000 pairs of cosine 0.900 to 0.910 among 10,000 vectors."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(9000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    away = rng.normal(size=(1000, 32))
    away -= (away * x[:1000]).sum(1)[:, None] * x[:1000]
    away /= np.linalg.norm(away, axis=1)[:, None]
    cosine = rng.uniform(0.9001, 0.91, 1000)[:, None]
    every = np.concatenate([x, cosine * x[:1000] + np.sqrt(1 - cosine**2) * away])
    if kind == "float":
        every = every.astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(every)], f"vec_id long, embedding array<{kind}>")
    got = {r.vec_id: r for r in embedding.near_duplicates(df).collect()}
    unit = every / np.linalg.norm(every, axis=1)[:, None]
    near = np.triu(unit @ unit.T >= 0.9, 1)
    links = sum(r.n_links for r in got.values()) / 2
    assert 1000 <= near.sum() and 0.95 * near.sum() <= links <= near.sum()
    assert sum(got[9000 + i].component_id <= i for i in range(1000)) >= 950


def test_embedding_blocks_change_nothing(spark, sf, monkeypatch):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    whole = _multi(_rows(embedding.near_duplicates(df)))
    from riskweave.llm import pairing
    monkeypatch.setattr(embedding, "in_blocks", lambda m, k, s: pairing.in_blocks(m, k, s, 16))
    assert whole == _multi(_rows(embedding.near_duplicates(df)))


# pipeline --------------------------------------------------------------------

def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.keep(stage(spark, docs, sf), "test")
        had, has = before.collect(), docs.collect()
        if name != "sharding":
            assert docs.columns == before.columns
        if name == "toxicity":
            model = toxicity.fit(before, spark.read.parquet(f"{sf}/labels.parquet"), F.lit(True))
            bad = {r.doc_id for r in toxicity.score(before, model).filter("predicted = 1").collect()}
            assert {r.doc_id for r in has} == {r.doc_id for r in had} - bad
        if name == "near duplicates":
            prints = {r.doc_id: _fingerprint(r.text) for r in had}
            root = _components(sorted(prints), [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3])
            assert sorted(r.doc_id for r in has) == sorted(set(root.values()))
        if name == "decontamination":
            marks = {k: (w, n) for k, w, n, _ in _mark(had, bench)}
            assert {r.doc_id for r in has} == {k for k, (w, n) in marks.items() if n <= decontaminate.COVERAGE * w}
            text = {r.doc_id: r.text for r in had}
            assert all(r.text == text[r.doc_id] for r in has if not marks[r.doc_id][1])
            assert all(r.n_chars == len(r.text) for r in has)
        if name == "mixing":
            copies = {r.doc_id: r.copies for r in mixing.mix(before).collect()}
            assert Counter(r.doc_id for r in has) == Counter({k: v for k, v in copies.items() if v})
        if name == "sharding":
            assert Counter(r.doc_id for r in has) == Counter(r.doc_id for r in had) and {"slot", "shard"} <= set(docs.columns)


def test_pipeline_edges(spark, sf, awkward):
    """Columns called like outputs keep type and value through every stage."""
    odd = awkward.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in (
        "predicted", "rate", "copies", "taken", "target", "source_size", "items", "n_words", "hits", "component_id", "fingerprint", "row")})
    extra = [c for c in odd.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]
    for docs in (odd, odd.filter("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = corpus_pipeline.keep(stage(spark, docs, sf), "test")
            if name != "sharding":
                assert out.dtypes == docs.dtypes
                values = {r.doc_id: tuple(r[c] for c in extra) for r in docs.collect()}
                assert all(values[r.doc_id] == tuple(r[c] for c in extra) for r in out.collect() if r.doc_id is not None)
            else:
                assert out.drop("slot", "shard").dtypes == docs.drop("slot", "shard").dtypes
            docs = out


def test_near_duplicates_by_row(spark, sf):
    """An id with two texts loses neither; copies without id go."""
    a, b, c = (_phrase(60, seed) for seed in (41, 42, 43))
    rows = [(1, a, "x"), (2, a, "x"), (1, b, "y"), (None, c, "z"), (None, c, "z"), (None, a, "x"), (3, None, "n"), (None, "", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string").repartition(3)
    got = Counter((r.doc_id, r.text, r.row) for r in corpus_pipeline.near_duplicates(spark, df, sf).collect())
    assert got == Counter({(1, a, "x"): 1, (1, b, "y"): 1, (None, c, "z"): 1, (3, None, "n"): 1})


# SQL -------------------------------------------------------------------------

@pytest.mark.parametrize("name", ["op2_sharding", "op3_warc_revisits", "op7_decontaminate", "op8_substring"])
def test_oracle(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = E.queries()[name](spark, sf)
    rel = con.sql(E.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert _multi(df.select(rel.columns).collect() and [tuple(r) for r in df.select(rel.columns).collect()]) == _multi(rel.fetchall())
