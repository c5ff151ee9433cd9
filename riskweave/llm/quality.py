"""Operator 13, document quality by attention-based multiple-instance learning.

Only documents have labels, but junk may fill a part of one only. A document
is the bag of its passages of PASSAGE words (all of them, the last may be
shorter). Each passage is encoded (``encode``: shares of byte classes and
kinds of words, repetition, and a hashed projection of its words), a hidden
layer h is learned over that, and gated attention, weight_k = softmax(w .
(tanh(V h_k) * sigmoid(U h_k))), learns from the document labels which
passages matter. The document's score is the logistic function of the
weighted mean of its passages' h.

Fitting: labelled rows allowed by ``learn_from`` are counted, and a sample of
TRAIN_ROWS rows at most and TRAIN_BYTES of text in expectation is drawn by a
hash of id and text; texts above TRAIN_TEXT bytes are not learned from. These
three bounds are the parameters of the sample; scoring reads every text
whole. Only ids of the sample are broadcast. The weights are fitted in one
task by Adam.

Defined results: null and empty texts hold no passage and get the score of
the bias alone; equal rows (id and text) are learned from once; ids whose
label rows contradict each other, null ids and null labels are not learned
from; without labels of both kinds every score is 0; an empty table gives an
empty result; other columns pass through, and a column called like an output
column is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_blocks, keep, text_buffers, tidy, word_hashes, word_spans, is_word_table, SPACE

#: Words of a passage, dimensions of its hashed words, hidden units, attention units.
PASSAGE, HASHED, HIDDEN, GATES = 64, 32, 24, 12
THRESHOLD = 0.7
#: The bounds of the sample that the weights are fitted on.
TRAIN_ROWS, TRAIN_BYTES, TRAIN_TEXT = 20_000, 48 << 20, 1 << 20
BATCH, EPOCHS, MIN_STEPS, RATE, DECAY, SEED = 32, 6, 1200, 0.004, 1e-4, 5
#: Bytes of text handled at once.
BLOCK = 1 << 20

IS_WORD = is_word_table(SPACE)


def _byte_classes() -> np.ndarray:
    """The class of each byte: lower case, capitals, digits, white space,
    sentence marks, other marks, control, leading and other bytes above ASCII."""
    out = np.full(256, 6)
    for first, last, of in ((0x21, 0x7E, 5), (0x61, 0x7A, 0), (0x41, 0x5A, 1), (0x30, 0x39, 2), (0x80, 0xBF, 8), (0xC0, 0xFF, 7)):
        out[first:last + 1] = of
    out[list(SPACE)] = 3
    out[list(b".,;:!?'\"-()")] = 4
    return out


BYTE_CLASS = _byte_classes()
CLASSES = int(BYTE_CLASS.max()) + 1
#: Numbers that describe a passage.
WIDTH = CLASSES + 9 + HASHED


def _per_passage(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (a number a word) over passages that start at ``first``."""
    return np.add.reduceat(values.astype(np.float64), first) if len(first) else np.zeros(0)


def encode(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The passages of texts, in order (passages x WIDTH), and the number of
    passages of each text."""
    starts, ends, first_word = word_spans(data, offsets, IS_WORD)
    words = np.diff(first_word)
    passages = -(-words // PASSAGE)
    bound = np.concatenate([[0], np.cumsum(passages)])
    n = int(bound[-1])
    if not n:
        return np.zeros((0, WIDTH), np.float32), passages
    text = np.repeat(np.arange(len(words)), passages)
    first = first_word[text] + (np.arange(n) - bound[text]) * PASSAGE
    size = np.diff(np.append(first, len(starts))).astype(np.float64)  # passages tile the words
    of = np.repeat(np.arange(n), size.astype(np.int64))
    length = ends - starts

    # shares of byte classes between the first and the last word of a passage
    at = np.arange(n)
    lo, hi = starts[first], ends[np.append(first[1:], len(starts)) - 1]
    out = np.zeros((n, WIDTH))
    classes = BYTE_CLASS[data]
    run = np.zeros(len(data) + 1, np.int32)
    for c in range(CLASSES):
        np.cumsum(classes == c, out=run[1:])
        out[:, c] = (run[hi] - run[lo]) / (hi - lo)
    if len(data):
        np.cumsum((classes == 5) | (classes == 2), out=run[1:])
        marked = run[ends] > run[starts]
        np.cumsum(classes == 1, out=run[1:])
        capitals = run[ends] - run[starts]
    hashes = word_hashes(data, starts, ends)
    again = np.zeros(len(starts), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    order = np.lexsort((hashes, of))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (of[order][1:] != of[order][:-1])
    stats = [
        size / PASSAGE,
        _per_passage(length, first) / size / 10,
        np.sqrt(np.maximum(_per_passage(length.astype(float) ** 2, first) / size, 0)) / 20,
        _per_passage(new[np.argsort(order)], first) / size,
        _per_passage(again, first) / size,
        _per_passage(marked, first) / size,
        _per_passage(capitals == length, first) / size,
        _per_passage(capitals > 0, first) / size,
        _per_passage(length == 1, first) / size,
    ]
    for c, values in enumerate(stats):
        out[at, CLASSES + c] = values
    # words hashed to signed dimensions
    column = of * HASHED + (hashes >> np.uint64(32)).astype(np.int64) % HASHED
    sign = 1.0 - 2.0 * (hashes & np.uint64(1)).astype(np.float64)
    out[:, CLASSES + 9:] = np.bincount(column, weights=sign, minlength=n * HASHED).reshape(n, HASHED) / np.sqrt(size)[:, None]
    return out.astype(np.float32), passages


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _sums(values: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Sums of rows over bags; a bag without rows gives zeros."""
    out = np.zeros((len(bound) - 1, *values.shape[1:]))
    some = np.diff(bound) > 0
    if some.any():
        out[some] = np.add.reduceat(values, bound[:-1][some], axis=0)
    return out


def forward(model: dict, x: np.ndarray, bound: np.ndarray) -> dict:
    """Everything between passages ``x`` (bags at ``bound``) and the scores."""
    h = np.tanh(((x - model["mean"]) / model["scale"]) @ model["W"] + model["wb"])
    t, g = np.tanh(h @ model["V"]), _sigmoid(h @ model["U"])
    e = (t * g) @ model["w"]
    some = np.diff(bound) > 0
    top = np.zeros(len(bound) - 1)
    if some.any():
        top[some] = np.maximum.reduceat(e, bound[:-1][some])
    of = np.repeat(np.arange(len(top)), np.diff(bound))
    a = np.exp(e - top[of])
    a /= _sums(a, bound)[of]
    z = _sums(a[:, None] * h, bound)
    return dict(h=h, t=t, g=g, a=a, z=z, of=of, score=_sigmoid(z @ model["c"] + model["b"]))


def gradients(model: dict, x: np.ndarray, bound: np.ndarray, labels: np.ndarray) -> dict:
    """Of the mean log loss over the bags, for every learned array."""
    f = forward(model, x, bound)
    error = (f["score"] - labels) / len(labels)
    dz = error[:, None] * model["c"]
    h, a, of = f["h"], f["a"], f["of"]
    da = (dz[of] * h).sum(1)
    de = a * (da - _sums(a * da, bound)[of])
    dtg = de[:, None] * model["w"]
    dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
    dh = (a[:, None] * dz[of] + dt @ model["V"].T + dg @ model["U"].T) * (1 - h**2)
    scaled = (x - model["mean"]) / model["scale"]
    return {"W": scaled.T @ dh, "wb": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (f["t"] * f["g"]).T @ de,
            "c": f["z"].T @ error, "b": np.array(error.sum())}


def train(bags: list[np.ndarray], labels: np.ndarray) -> dict:
    """The model fitted to bags of encoded passages by Adam on the log loss."""
    rng = np.random.default_rng(SEED)
    every = np.concatenate(bags) if bags else np.zeros((0, WIDTH))
    every = every if len(every) else np.zeros((1, WIDTH))
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    model = {"mean": every.mean(0, dtype=np.float64), "scale": np.maximum(every.std(0, dtype=np.float64), 0.02),
             "W": rng.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, HIDDEN)), "wb": np.zeros(HIDDEN),
             "V": rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, GATES)), "U": rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, GATES)),
             "w": rng.normal(0, 0.1, GATES), "c": rng.normal(0, 0.1, HIDDEN), "b": np.array(np.log(share / (1 - share)))}
    del every
    learned = ("W", "wb", "V", "U", "w", "c", "b")
    first, second = ({p: np.zeros_like(model[p]) for p in learned} for _ in range(2))
    epochs = max(EPOCHS, int(np.ceil(MIN_STEPS * BATCH / len(bags))))
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        rate = RATE * (1 - epoch / epochs)
        for lo in range(0, len(order), BATCH):
            rows = order[lo:lo + BATCH]
            bound = np.concatenate([[0], np.cumsum([len(bags[r]) for r in rows])])
            grads = gradients(model, np.concatenate([bags[r] for r in rows]).astype(np.float64), bound, labels[rows])
            step += 1
            for p in learned:
                grad = grads[p] + (DECAY * model[p] if p not in ("b", "wb") else 0)
                first[p] = 0.9 * first[p] + 0.1 * grad
                second[p] = 0.999 * second[p] + 0.001 * grad**2
                model[p] = model[p] - rate * (first[p] / (1 - 0.9**step)) / (np.sqrt(second[p] / (1 - 0.999**step)) + 1e-8)
    return model


PARTS = ("mean", "scale", "W", "wb", "V", "U", "w", "c", "b")
SHAPES = {"mean": (WIDTH,), "scale": (WIDTH,), "W": (WIDTH, HIDDEN), "wb": (HIDDEN,), "V": (HIDDEN, GATES), "U": (HIDDEN, GATES),
          "w": (GATES,), "c": (HIDDEN,), "b": ()}


def sample(docs: DataFrame, labels: DataFrame, learn_from: Column, key: str, text: str, label: str,
           rows: int | None = None, size: int | None = None, longest: int | None = None) -> DataFrame:
    """(draw, label, text): the rows that weights are fitted on, within the
    three bounds (rows, bytes in all, bytes of a text)."""
    rows, size, longest = rows or TRAIN_ROWS, size or TRAIN_BYTES, longest or TRAIN_TEXT
    marks = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).filter("key is not null and label in (0, 1)") \
        .groupBy("key").agg(F.min("label").alias("label"), F.max("label").alias("most")).filter("label = most").drop("most")
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    allowed = docs.filter(learn_from).select(F.col(key).alias("key"), whole.alias("text"), F.xxhash64(F.col(key), whole).alias("draw"))
    narrow = keep(allowed.select("key", "draw", F.octet_length("text").alias("bytes")).filter(F.col("bytes") <= longest)
                  .distinct().join(marks, "key").select("draw", "bytes", "label"), "quality-rows")
    total = narrow.agg(F.count("*").alias("rows"), F.sum("bytes").alias("bytes")).first()
    share = min(1.0, rows / max(1, total.rows), size / max(1, total.bytes or 0))
    cut = min((1 << 63) - 1, -(1 << 63) + int(share * (1 << 64)))
    chosen = narrow.filter(F.col("draw") <= F.lit(cut)).groupBy("draw").agg(F.first("label").alias("label")).orderBy("draw").limit(rows)
    # that many rows of two numbers; equal rows meet before their texts are shuffled
    return allowed.join(F.broadcast(chosen), "draw").groupBy("draw").agg(F.first("label").alias("label"), F.first("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column, key: str = "doc_id", text: str = "text", label: str = "quality") -> dict | None:
    """The model from the rows of ``docs`` for which ``learn_from`` (a
    condition on ``docs``) holds and that have a label; None without two kinds."""
    def bags(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            for lo, hi in cut_blocks(offsets, BLOCK):
                x, n = encode(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                bound = np.concatenate([[0], np.cumsum(n)])
                yield pa.RecordBatch.from_arrays([batch.column("draw").slice(lo, hi - lo), batch.column("label").slice(lo, hi - lo),
                                                  pa.array([x[a:b].tobytes() for a, b in zip(bound, bound[1:])], pa.binary())], names=["draw", "label", "bag"])

    def fitted(batches):
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or len(set(table.column("label").to_pylist())) < 2:
            return
        table = table.sort_by("draw")
        model = train([np.frombuffer(b, np.float32).reshape(-1, WIDTH) for b in table.column("bag").to_pylist()],
                      table.column("label").to_numpy().astype(float))
        yield pa.RecordBatch.from_arrays([pa.array([np.asarray(model[p]).tobytes()], pa.binary()) for p in PARTS], names=list(PARTS))

    encoded = keep(sample(docs, labels, learn_from, key, text, label).mapInArrow(tidy(bags), "draw long, label int, bag binary"), "quality-bags")
    row = encoded.coalesce(1).mapInArrow(tidy(fitted), ", ".join(f"{p} binary" for p in PARTS)).first()
    return row and {p: np.frombuffer(row[p]).reshape(SHAPES[p]) for p in PARTS}


def score(docs: DataFrame, model: dict | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score (0 to 1), predicted (score >= threshold),
    n_passages, and best_passage and its weight: the number, from 0, of the
    passage that weighs most (null without passages)."""
    names = ("score", "predicted", "n_passages", "best_passage", "best_weight")
    docs = docs.drop(*names)
    blank = docs.select("*", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.lit(0).cast("long").alias("n_passages"),
                        F.lit(None).cast("long").alias("best_passage"), F.lit(None).cast("double").alias("best_weight"))
    if model is None:
        return blank
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        model = shared.value
        for batch in batches:
            data, offsets = text_buffers(batch.column(text))
            found = []
            for lo, hi in cut_blocks(offsets, BLOCK):
                x, n = encode(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                bound = np.concatenate([[0], np.cumsum(n)])
                f = forward(model, x.astype(np.float64), bound)
                some = n > 0
                # stable: the first of the passages that weigh most
                heaviest = np.full(len(n), -1)
                order = np.lexsort((np.arange(len(x)), -f["a"], f["of"]))
                heaviest[some] = order[bound[:-1][some]]
                weight = np.where(some, f["a"][heaviest] if len(x) else 0.0, 0.0)
                found.append((f["score"], n, heaviest - bound[:-1], weight))
            got = [np.concatenate([p[i] for p in found]) if found else np.zeros(0) for i in range(4)]
            none = got[1] == 0
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(got[0]), pa.array((got[0] >= threshold).astype(np.int32)), pa.array(got[1].astype(np.int64)),
                 pa.array(got[2].astype(np.int64), mask=none), pa.array(got[3].astype(float), mask=none)], names=[*batch.schema.names, *names])

    return docs.mapInArrow(tidy(rows), blank.schema)
