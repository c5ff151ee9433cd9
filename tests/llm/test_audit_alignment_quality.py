"""Filter audit, token alignment and quality against brute force, on the
smallest tables and on awkward rows."""

import glob
import os
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as E
from riskweave import session
from riskweave.llm import alignment, filters, quality
from riskweave.sources import kept

from test_operators import SCHEMA, WORD, _awkward, _multi, _rows, _sha

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(_awkward(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module", params=["documents", "awkward", "empty"])
def docs(request, documents, awkward):
    return {"documents": documents, "awkward": awkward, "empty": awkward.filter("false")}[request.param]


@pytest.fixture(scope="module")
def labels(spark, sf):
    odd = [(i, i % 2, i % 3 == 0) for i in range(0, 30, 2)]
    odd = [(i, q, int(t)) for i, q, t in odd] + [(3, None, 1), (3, 1, None), (3, 0, 0), (None, 1, 1), (5, None, None), (-7, 1, 1), (-7, 1, 1)]
    return spark.read.parquet(f"{sf}/labels.parquet").unionByName(spark.createDataFrame(odd, LABELS))


# 11 --------------------------------------------------------------------------

def _chain(rows, labels):
    """Every order applied to the documents one step after the other."""
    first = {}
    for r in rows:
        if r.doc_id is not None:
            first[r.text or ""] = min(first.get(r.text or "", r.doc_id), r.doc_id)
    good, toxic = ({x.doc_id for x in labels if x[c] == 1 and x.doc_id is not None} for c in ("quality", "toxic"))

    def failed(r):
        t = r.text or ""
        w = WORD.findall(t)
        tests = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
                 re.search("[#$%&*|]", t) is not None, r.doc_id is not None and r.doc_id > first[t])
        return {f for f, x in zip("ABCDE", tests) if x}

    parts = defaultdict(list)
    for r in rows:
        parts[r.lang or ""].append((r.doc_id, failed(r)))
    out = []
    for part, members in parts.items():
        shapley, found = Counter(), []
        for order in permutations("ABCDE"):
            left = members
            for step, f in enumerate(order, 1):
                gone = [m for m in left if f in m[1]]
                left = [m for m in left if f not in m[1]]
                shapley[f] += len(gone)
                found.append((part, "".join(order), step, len(left), len(gone), sum(f in m[1] for m in members) - len(gone),
                              sum(m[1] == {f} for m in members), sum(m[0] in good for m in gone), sum(m[0] in toxic for m in gone), f))
        out += [(*row[:-1], shapley[row[-1]]) for row in found]
    return out


def test_filter_audit(docs, labels):
    got = filters.audit(docs, labels)
    assert got.columns == ["part", "filter_order", "step", *filters.COUNTS]
    assert _multi(_rows(got)) == _multi(_chain(docs.collect(), labels.collect()))


def test_filter_audit_matches_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(E.oracle_sql()["op11_filter_audit"])
    got = E.queries()["op11_filter_audit"](spark, sf)
    assert sorted(want.columns) == sorted(got.columns)
    assert _multi(want.fetchall()) == _multi(_rows(got.select(want.columns)))


def test_filter_audit_with_own_filters_and_names(spark, labels):
    rows = [(1, "x", "p", "a"), (2, "x", "p", "b"), (3, None, None, "c"), (4, "", "q", "d"), (4, "y", "q", "e")]
    df = spark.createDataFrame(rows, "id long, body string, part string, kept string")
    got = filters.audit(df, labels.withColumnRenamed("doc_id", "id"), {"x": F.col("body") == "x"}, "r", key="id", text="body", part="part")
    found = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails) for r in got.collect()}
    assert len(found) == 3 * 4
    assert found["p", "xr", 1] == (0, 2, 0, 1) and found["p", "xr", 2] == (0, 0, 1, 0)
    assert found["p", "rx", 1] == (1, 1, 0, 0) and found["q", "rx", 1] == (1, 1, 0, 1) and found["", "rx", 1] == (1, 0, 0, 0)


def test_contraction_is_the_sum_over_cells():
    rng = np.random.default_rng(1)
    tensor = rng.integers(0, 9, (2, 2, 2, 2))
    choices = rng.integers(0, 2, (7, 3, 2))
    want = [[sum(tensor[m, i, j, k] * c[0, i] * c[1, j] * c[2, k] for i in (0, 1) for j in (0, 1) for k in (0, 1)) for c in choices] for m in (0, 1)]
    assert filters.contract(tensor, choices).tolist() == want


# 12 --------------------------------------------------------------------------

def _aligned(rows):
    """Token by token: groups by common ends, links by all overlapping pairs."""
    ta, tb = alignment.tokenizer(alignment.FILE_A), alignment.tokenizer(alignment.FILE_B)
    slow = Tokenizer.from_file(alignment.FILE_A)
    slow.encode_special_tokens = True
    found, held = [], Counter()
    for r in rows:
        text = r.text or ""
        whole = (" " + text).encode()
        a, b = slow.encode(" " + text, add_special_tokens=False).ids, tb.encode([text])[0]
        if not text or b"".join(ta.pieces[i] for i in a) != whole or b"".join(tb.pieces[i] for i in b) != whole:
            found.append((r.doc_id, [], [], [], []))
            continue
        spans = []
        for ids, pieces in ((a, ta.pieces), (b, tb.pieces)):
            at, of = 0, []
            for i in ids:
                of.append((at, at + len(pieces[i]), i))
                at += len(pieces[i])
            spans.append(of)
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        members = [([], []) for _ in cuts]
        for side, of in enumerate(spans):
            for s, _, i in of:
                members[bisect_right(cuts, s)][side].append(str(i))
        groups = ["|".join(map(",".join, m)) for m in members]
        by_byte = [{p: (k, i) for k, (s, e, i) in enumerate(of) for p in range(s, e)} for of in spans]
        links = [(x[1], y[1]) for x, y in dict.fromkeys((by_byte[0][p], by_byte[1][p]) for p in range(len(whole)))]
        held.update(set(links))
        found.append((r.doc_id, a, b, groups, links))
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    rows = [(key, len(a), len(b), len(groups), len(links), sum(held[k] == most[k[0]] for k in links), sum(held[k] for k in links), ";".join(groups))
            for key, a, b, groups, links in found]
    return rows, held, most


ODD = ["▁ under", "a▁b", "<unk> <s> </s> <|endoftext|> <0x41>", "\0nul", "日本語 tokens", "\U0001F600\U0001F601", "  two  spaces ", "tab\tnew\nline\r\n",
       "é" * 40, "ﬁ ligature", "é combining", "x" * 3000, " ", " ", "İstanbul", "a" + "̀" * 50]


@pytest.fixture(scope="module")
def texts(spark, docs):
    return docs.unionByName(spark.createDataFrame([(1000 + i, t, None, None, None) for i, t in enumerate(ODD)], "doc_id long, text string, lang string, source string, n_chars long"),
                            allowMissingColumns=True) if "size" in docs.columns else docs


def test_alignment(texts):
    rows, counts = alignment.align(texts)
    want, held, most = _aligned(texts.collect())
    assert rows.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    assert _multi(_rows(rows)) == _multi(want)
    got = {(r.a, r.b): (r.docs, r.best) for r in counts.collect()}
    assert got == {k: (n, n == most[k[0]]) for k, n in held.items()}


def test_alignment_small_chunks_change_nothing(spark, awkward, monkeypatch):
    want = _multi(_rows(alignment.align(awkward)[0]))
    monkeypatch.setattr(alignment, "CHUNK", 700)
    monkeypatch.setattr(alignment, "CHUNK_ROWS", 3)
    monkeypatch.setattr(alignment, "BLOCK", 300)
    monkeypatch.setattr(alignment, "TOKENS", 100)
    assert _multi(_rows(alignment.align(awkward.coalesce(1))[0])) == want


def test_alignment_holds_a_few_chunks_of_a_partition(spark, monkeypatch):
    """A task holds whole row groups of what it reads and writes."""
    monkeypatch.setattr(alignment, "CHUNK", 300)
    folder = session.ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    texts = spark.range(60).selectExpr("id doc_id", "repeat(concat('word', id % 7, ' '), 40) text").coalesce(1)
    rows, _ = alignment.align(texts)
    assert rows.count() == 60
    new = set(os.listdir(folder)) - before
    assert {x.rsplit("-", 1)[0] for x in new} == {"token-chunks", "pair-counts"}  # no step reads chunks to write their pairs
    files = [pq.ParquetFile(f).metadata for x in new if x.startswith("token-chunks") for f in glob.glob(f"{folder}/{x}/*.parquet")]
    groups = [f.row_group(i).num_rows for f in files for i in range(f.num_row_groups)]
    assert sum(groups) >= 30 and max(groups) <= alignment.GROUP_ROWS


def test_fast_encoding_is_that_of_the_file(documents):
    """Plain texts, and random ones of their characters, give the same ids."""
    t = alignment.tokenizer(alignment.FILE_A)
    assert t.fast is not None
    rng = np.random.default_rng(7)
    letters = [chr(c) for c in [9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0x250)]]
    weights = np.array([8.0 if c in " \t\n\r'aestlmdrv019.," else 1.0 for c in letters])
    made = ["".join(rng.choice(letters, rng.integers(1, 120), p=weights / weights.sum())) for _ in range(3000)]
    texts = [x for x in made + [r.text for r in documents.collect() if r.text] if not alignment.NOT_PLAIN.search(x)]
    assert len(texts) > 3000
    for x, fast, whole in zip(texts, t.encode(texts), t._whole(texts)):
        assert list(fast) == whole, x


def test_alignment_query_digests_groups(spark, sf, documents):
    got = {r.doc_id: r for r in E.queries()["op12_alignment"](spark, sf).collect()}
    for r in _rows(alignment.align(documents)[0]):
        assert got[r[0]].groups_sha256 == (_sha(r[7].encode()) if r[1] else "")


def test_a_scope_leaves_no_folder(spark, labels, awkward):
    folder = session.ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    with kept.scope(spark):
        assert filters.audit(awkward, labels).count() > 0
        assert set(os.listdir(folder)) > before
    assert set(os.listdir(folder)) == before


# 13 --------------------------------------------------------------------------

def test_quality_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = E.queries()["op13_quality"](spark, sf)
    joined = rows.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out and quality is not null").collect()
    assert rows.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    right = np.mean([(r.score >= 0.5) == (r.quality == 1) for r in joined])
    assert len(joined) > 50 and right >= 0.95
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in joined)


def _bags(n, rng):
    """Bags of random passages; positive ones hold one of a kind."""
    labels = rng.integers(0, 2, n)
    bags = [rng.normal(0, 1, (rng.integers(1, 9), quality.WIDTH)).astype(np.float32) for _ in range(n)]
    for b, y in zip(bags, labels):
        b[rng.integers(len(b)), :3] = 4.0 if y else -4.0
    return bags, labels.astype(float)


def test_quality_gradients_match_differences():
    rng = np.random.default_rng(2)
    bags, labels = _bags(12, rng)
    bags[3] = bags[3][:0]  # a text without passages
    model = quality.train(bags[:4], labels[:4])
    x, bound = np.concatenate(bags).astype(float), np.concatenate([[0], np.cumsum([len(b) for b in bags])])

    def loss(m):
        s = quality.forward(m, x, bound)["score"]
        return -np.mean(labels * np.log(s) + (1 - labels) * np.log(1 - s))

    grads = quality.gradients(model, x, bound, labels)
    for name, grad in grads.items():
        for at in [tuple(rng.integers(0, d) for d in np.shape(grad)) for _ in range(4)]:
            up, down = ({**model, name: np.array(model[name])} for _ in range(2))
            up[name][at] += 1e-5
            down[name][at] -= 1e-5
            assert (loss(up) - loss(down)) / 2e-5 == pytest.approx(grad[at], abs=1e-6, rel=1e-3), name


def test_quality_attends_to_the_passage_that_decides():
    rng = np.random.default_rng(3)
    bags, labels = _bags(400, rng)
    model = quality.train(bags[:300], labels[:300])
    x, bound = np.concatenate(bags[300:]).astype(float), np.concatenate([[0], np.cumsum([len(b) for b in bags[300:]])])
    f = quality.forward(model, x, bound)
    assert np.mean((f["score"] >= 0.5) == labels[300:]) >= 0.95
    hit = [np.argmax(f["a"][a:b]) == np.argmax(np.abs(x[a:b, :3].sum(1))) for a, b in zip(bound, bound[1:])]
    assert np.mean(hit) >= 0.7


def _plain_passages(text):
    """The encoding, word by word."""
    raw = (text or "").encode()
    words = [m for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    out = []
    for lo in range(0, len(words), quality.PASSAGE):
        w = words[lo:lo + quality.PASSAGE]
        body, n = raw[w[0].start():w[-1].end()], len(w)
        b = [m.group() for m in w]
        row = [sum(quality.BYTE_CLASS[c] == k for c in body) / len(body) for k in range(quality.CLASSES)]
        capital = [sum(65 <= c <= 90 for c in x) for x in b]
        row += [n / quality.PASSAGE, np.mean([len(x) for x in b]) / 10, np.sqrt(np.mean([len(x) ** 2 for x in b])) / 20, len(set(b)) / n,
                sum(x == y for x, y in zip(b, b[1:])) / n, sum(any(quality.BYTE_CLASS[c] in (2, 5) for c in x) for x in b) / n,
                sum(c == len(x) for c, x in zip(capital, b)) / n, sum(c > 0 for c in capital) / n, sum(len(x) == 1 for x in b) / n]
        out.append(row)
    return out


def test_quality_scores_by_hand(docs, labels):
    """Scores recomputed text by text, passage by passage, from the model."""
    model = quality.fit(docs, labels, F.lit(True))
    rows = quality.score(docs, model)
    assert rows.columns == [c for c in docs.columns if c != "score"] + ["score", "predicted", "n_passages", "best_passage", "best_weight"]
    if model is None:
        assert all(r.score == 0 and r.predicted == 0 for r in rows.collect())
        return
    for r in rows.collect():
        data = np.frombuffer((r.text or "").encode(), np.uint8)
        x, n = quality.encode(data, np.array([0, len(data)]))
        plain = _plain_passages(r.text)
        assert n.tolist() == [len(plain)] == [r.n_passages]
        if plain:
            np.testing.assert_allclose(x[:, :quality.CLASSES + 9], np.array(plain), atol=1e-5)
        h = np.tanh((x.astype(float) - model["mean"]) / model["scale"] @ model["W"] + model["wb"])
        e = np.array([model["w"] @ (np.tanh(v @ model["V"]) / (1 + np.exp(-(v @ model["U"])))) for v in h])
        a = np.exp(e - e.max()) / np.exp(e - e.max()).sum() if len(e) else e
        z = sum((k * v for k, v in zip(a, h)), np.zeros(quality.HIDDEN))
        assert r.score == pytest.approx(1 / (1 + np.exp(-(z @ model["c"] + model["b"]))), abs=1e-9)
        assert (r.best_passage is None) == (not plain)
        if plain:
            assert a[r.best_passage] == pytest.approx(a.max()) == pytest.approx(r.best_weight)


def test_quality_learns_nothing_from_one_kind(spark, documents, labels):
    assert quality.fit(documents, labels.filter("quality = 1"), F.lit(True)) is None
    assert quality.fit(documents, labels, F.lit(False)) is None


def test_quality_sample_is_bounded_and_repeated_rows_count_once(spark, labels, monkeypatch):
    rows = [(i % 7, "same text" if i % 2 else f"text {i}") for i in range(300)] + [(None, "x")] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    marks = spark.createDataFrame([(i, i % 2, 0) for i in range(7)] + [(2, 1, 0), (None, 1, 1)], LABELS)
    got = quality.sample(df, marks, F.lit(True), "doc_id", "text", "quality").collect()
    want = {r for r in rows if r[0] is not None and r[0] != 2}
    assert len(got) == len(want) and Counter(r.text for r in got) == Counter(t for _, t in want)
    monkeypatch.setattr(quality, "TRAIN_ROWS", 40)
    assert 10 <= quality.sample(df, marks, F.lit(True), "doc_id", "text", "quality").count() <= 40
