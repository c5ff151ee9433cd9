"""Operator 9, toxicity by a factorization machine over hashed terms.

A document is the set of its distinct words (A-Z lower-cased) and of the first
PREFIX bytes of longer words, each hashed to one of 2^HASH_BITS terms. The machine adds a weight a term and the product of
two latent vectors a pair of terms, so a pair such as an insult with a group
mention can weigh more than its parts.

Fitting: the weights are fitted in one task by mini-batch AdaGrad on all
hashed terms of a sample of the labelled rows allowed by ``learn_from``:
TRAIN_ROWS rows at most, TRAIN_BYTES of text in expectation, no text above
TRAIN_TEXT bytes (``quality.sample``; these bounds are parameters). No term is
left out; what tells little is held down by regularisation instead. The
weights of a term have a prior whose width follows what the sample says about
it: near 1 for a term that many rows hold, or whose frequency differs between
the labels by EVIDENCE standard deviations, near 0 for one that few rows hold.
A term alike in both labels but frequent stays free to weigh in a pair. The
additive weights also have an L1 penalty (their proximal form keeps what never
adds up at zero). The model, at most 2^HASH_BITS rows of FACTORS + 1 floats,
goes to the scoring tasks.

Null and empty texts hold no terms and get the model's base score; labels
that are null, or contradict each other for an id, are not learned from; equal
rows (id and text) are learned from once; without labels of both kinds every
score is 0; an empty table gives an empty result; other columns pass through,
and a column called like an output column is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_blocks, keep, text_buffers, tidy, word_hashes, word_spans
from .quality import sample

#: Hashed terms, latent factors, threshold of the prediction.
HASH_BITS, FACTORS, THRESHOLD = 20, 8, 0.7
PREFIX = 5
#: The bounds of the sample that the weights are fitted on.
TRAIN_ROWS, TRAIN_BYTES, TRAIN_TEXT = 24_000, 60 << 20, 1 << 20
#: Batches of BATCH rows, and passes over the rows: STEPS batches in all, but
#: no fewer and no more passes than these.
BATCH, STEPS, FEWEST, MOST = 256, 400, 4, 12
#: Steps of the additive weights and of the vectors, and their penalties.
RATE, VECTOR_RATE, L1, L2, VECTOR_L2, SEED = 1.0, 0.1, 0.2, 0.01, 0.05, 3
#: Widths of the priors: rows that halve one, deviations of full evidence, and
#: the share of all rows by which a term without any gets a third.
FEW, EVIDENCE, FREQUENT = 3, 6.0, 2.0
#: Bytes of text, rows to count the terms of, and vectors drawn, at once.
BLOCK, COUNTED, DRAWN = 1 << 20, 2048, 1 << 16

LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
IS_WORD = np.array([chr(c).isdigit() and c < 128 or 0x61 <= c <= 0x7A or c >= 0x80 for c in range(256)])


def terms(column: pa.Array):
    """(row, term) of the distinct terms of each text, sorted, in blocks of rows."""
    data, offsets = text_buffers(column)
    for lo, hi in cut_blocks(offsets, BLOCK):
        part = LOWER[data[offsets[lo]:offsets[hi]]]
        starts, ends, first = word_spans(part, offsets[lo:hi + 1] - offsets[lo], IS_WORD)
        row = np.repeat(np.arange(lo, hi), np.diff(first))
        long = ends - starts > PREFIX
        # a prefix is a term apart from the word of the same bytes
        hashes = np.concatenate([word_hashes(part, starts, ends), ~word_hashes(part, starts[long], starts[long] + PREFIX)])
        term = (hashes >> np.uint64(64 - HASH_BITS)).astype(np.int64)
        row = np.concatenate([row, row[long]])
        both = np.unique((row << HASH_BITS) | term)
        yield both >> HASH_BITS, both & ((1 << HASH_BITS) - 1)


def to_gaps(row: np.ndarray, term: np.ndarray, n_rows: int) -> list[bytes]:
    """Each row's sorted terms as 16-bit gaps; 0xFFFF adds 65535 to the next."""
    first = np.concatenate([[True], row[1:] != row[:-1]])[:len(row)]
    gap = term - np.where(first, 0, np.concatenate([[0], term[:-1]])[:len(term)])
    more, last = np.divmod(gap, 0xFFFF)
    at = np.cumsum(more + 1)
    out = np.full(int(at[-1]) if len(at) else 0, 0xFFFF, "<u2")
    out[at - 1] = last
    end = np.concatenate([[0], at])[np.searchsorted(row, np.arange(n_rows + 1))]
    return [out[a:b].tobytes() for a, b in zip(end[:-1], end[1:])]


def from_gaps(blob: bytes) -> np.ndarray:
    gaps = np.frombuffer(blob, "<u2")
    return np.cumsum(gaps, dtype=np.int32)[gaps != 0xFFFF]


def renumber(sets: list[np.ndarray]) -> np.ndarray:
    """The terms that ``sets`` hold, sorted; each set's terms become their
    places in them, a set at a time: all of them are never held twice."""
    held, place = np.zeros(1 << HASH_BITS, bool), np.zeros(1 << HASH_BITS, np.int32)
    for s in sets:
        held[s] = True
    held = np.flatnonzero(held)
    place[held] = np.arange(len(held))
    for k, s in enumerate(sets):
        sets[k] = place[s]
    return held


def term_sets(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, terms): the distinct terms of each text, as gaps."""
    def rows(batches):
        for batch in batches:
            parts = list(terms(batch.column(1)))
            row, term = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(to_gaps(row, term, batch.num_rows), pa.binary())], names=["key", "terms"])

    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(
        tidy(rows), f"key {docs.schema[key].dataType.simpleString()}, terms binary")


def _interactions(v: np.ndarray, indptr: np.ndarray, index: np.ndarray):
    """Sums of the latent vectors and of their squares of each document."""
    def total(x):
        sums = np.zeros((len(indptr) - 1, x.shape[1]))
        some = np.diff(indptr) > 0
        if some.any():
            sums[some] = np.add.reduceat(x, indptr[:-1][some], axis=0)
        return sums
    return total(v[index]), total(v[index] ** 2)


def raw_score(model: dict, indptr: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Log-odds of documents given as a sparse matrix of model terms."""
    sums, squares = _interactions(model["v"], indptr, index)
    at = np.concatenate([[0.0], np.cumsum(model["w"][index], dtype=np.float64)])
    return model["b"] + at[indptr[1:]] - at[indptr[:-1]] + 0.5 * (sums**2 - squares).sum(1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def prior_widths(df: np.ndarray, bad: np.ndarray, rows: int, share: float) -> np.ndarray:
    """Of terms that ``df`` of ``rows`` rows hold, ``bad`` of them toxic, when
    ``share`` of all rows are."""
    deviation = (bad - df * share) / np.sqrt(np.maximum(df, 1) * share * (1 - share))
    return df / (df + FEW) * np.maximum(np.minimum(1, (deviation / EVIDENCE) ** 2), df / (df + FREQUENT * rows))


def train(sets: list[np.ndarray], labels: np.ndarray, n_terms: int) -> dict:
    """Mini-batch AdaGrad on the log loss. ``sets``: the terms of each row,
    below ``n_terms``. The weights returned hold the widths of their priors."""
    rng = np.random.default_rng(SEED)
    bound = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    terms = np.concatenate(sets).astype(np.int32, copy=False)
    share = float(np.clip(labels.mean(), 1e-6, 1 - 1e-6))
    df, bad = np.zeros(n_terms, np.int64), np.zeros(n_terms)
    for lo in range(0, len(sets), COUNTED):
        ends = bound[lo:lo + COUNTED + 1]
        part = terms[ends[0]:ends[-1]]
        df += np.bincount(part, minlength=n_terms)
        bad += np.bincount(part, weights=np.repeat(labels[lo:lo + COUNTED], np.diff(ends)), minlength=n_terms)
    width = prior_widths(df, bad, len(sets), share).astype(np.float32)
    b, gb = np.log(share / (1 - share)), 1e-8
    z, seen, w = (np.zeros(n_terms, np.float32) for _ in range(3))
    v = np.empty((n_terms, FACTORS), np.float32)
    for lo in range(0, n_terms, DRAWN):
        v[lo:lo + DRAWN] = rng.normal(0, 0.05, v[lo:lo + DRAWN].shape)
    gv = np.ones((n_terms, FACTORS), np.float32)
    for _ in range(int(np.clip(np.ceil(STEPS * BATCH / len(sets)), FEWEST, MOST))):
        order = rng.permutation(len(sets))
        for lo in range(0, len(order), BATCH):
            rows = order[lo:lo + BATCH]
            size = bound[rows + 1] - bound[rows]
            indptr = np.concatenate([[0], np.cumsum(size)])
            if not indptr[-1]:
                continue
            at = terms[np.repeat(bound[rows] - indptr[:-1], size) + np.arange(indptr[-1])]
            # one sort gives the terms of the batch, and each occurrence's place
            by_term = np.argsort(at, kind="stable")
            ranked = at[by_term]
            first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
            used = ranked[first]
            place = np.empty(len(at), np.int64)
            place[by_term] = np.repeat(np.arange(len(used)), np.diff(np.append(first, len(at))))
            x = width[used]
            own = (v[used] * x[:, None])[place]
            some = size > 0
            sums, squares = np.zeros((len(rows), FACTORS), np.float32), np.zeros((len(rows), FACTORS), np.float32)
            sums[some] = np.add.reduceat(own, indptr[:-1][some], axis=0)
            squares[some] = np.add.reduceat(own * own, indptr[:-1][some], axis=0)
            added = np.concatenate([[0.0], np.cumsum((w[used] * x)[place], dtype=np.float64)])[indptr]
            log_odds = b + np.diff(added) + 0.5 * (sums**2 - squares).sum(1)
            error = (_sigmoid(log_odds) - labels[rows]).astype(np.float32)
            each = np.repeat(error, size) * x[place]
            dw = np.add.reduceat(each[by_term], first)
            dv = np.add.reduceat((each[:, None] * (np.repeat(sums, size, axis=0) - own))[by_term], first, axis=0) + VECTOR_L2 * v[used]
            db = float(error.sum())
            gb += db * db
            b -= RATE * db / np.sqrt(gb)
            # follow the regularised leader: zero until the sum of gradients passes L1
            z[used] += dw - (np.sqrt(seen[used] + dw * dw) - np.sqrt(seen[used])) / RATE * w[used]
            seen[used] += dw * dw
            w[used] = np.sign(z[used]) * np.maximum(np.abs(z[used]) - L1, 0) / -((1 + np.sqrt(seen[used])) / RATE + L2)
            gv[used] += dv * dv
            v[used] -= VECTOR_RATE * dv / np.sqrt(gv[used])
    w *= width
    v *= width[:, None]
    return {"b": float(b), "w": w, "v": v}


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column, key: str = "doc_id", text: str = "text", label: str = "toxic") -> dict | None:
    """The model from the rows of ``docs`` for which ``learn_from`` (a
    condition on ``docs``) holds and that have a label; None without two kinds."""
    def fitted(batches):
        batches = list(batches)
        table = pa.Table.from_batches(batches) if batches else None
        if table is None or len(set(table.column("label").to_pylist())) < 2:
            return
        del batches
        table = table.sort_by("draw")
        labels = table.column("label").to_numpy().astype(float)
        sets = [from_gaps(x.as_py()) for x in table.column("terms")]
        del table
        held = renumber(sets)
        model = train(sets, labels, len(held))
        yield pa.RecordBatch.from_arrays([pa.array([model["b"]]), *[pa.array([x.tobytes()], pa.binary()) for x in (held, model["w"], model["v"])]],
                                         names=["b", "terms", "w", "v"])

    rows = sample(docs, labels, learn_from, key, text, label, TRAIN_ROWS, TRAIN_BYTES, TRAIN_TEXT)
    sets = keep(term_sets(rows.withColumn("pair", F.struct("draw", "label")), "pair", "text").select("key.draw", "key.label", "terms"), "toxic-learn")
    row = sets.coalesce(1).mapInArrow(tidy(fitted), "b double, terms binary, w binary, v binary").first()
    return row and {"b": row.b, "terms": np.frombuffer(row.terms, np.int64), "w": np.frombuffer(row.w, np.float32),
                    "v": np.frombuffer(row.v, np.float32).reshape(-1, FACTORS)}


def score(docs: DataFrame, model: dict | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (score >= threshold)."""
    docs = docs.drop("score", "predicted")
    if model is None:
        return docs.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)})
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        model = shared.value
        place = np.full(1 << HASH_BITS, -1, np.int32)
        place[model["terms"]] = np.arange(len(model["terms"]))
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for row, term in terms(batch.column(text)):
                where = place[term]
                row, where = row[where >= 0], where[where >= 0]
                n = np.bincount(row, minlength=batch.num_rows)
                use = np.flatnonzero(n)
                if len(use):
                    indptr = np.concatenate([[0], np.cumsum(n[use])])
                    out[use] = raw_score(model, indptr, where) - model["b"]
            out = _sigmoid(out + model["b"])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out), pa.array((out >= threshold).astype(np.int32))],
                                             names=[*batch.schema.names, "score", "predicted"])

    return docs.mapInArrow(tidy(rows), docs.select("*", F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema)
