"""The weighted logistic regression of M12 solved by Newton steps (the check
of the quasi-Newton fit in ``model.fit_lr``).

The objective is ``0.5 |w|^2 + sum_i s_i logloss_i`` over standardized
features, the intercept not penalized. A step needs the gradient and the
weighted Gram matrix: every task reduces its rows to one set of sums by
matrix products of Arrow batches, and only these ``(k + 1) (k + 2) + 1``
numbers a task are shuffled and added. The solution of the ``k + 1`` equations
is the only work on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .model import FEATURES, LABEL, class_counts, scaler_stats

MAX_STEPS, TOLERANCE = 50, 1e-12


def logistic_sums(train: DataFrame, beta: Sequence[float], scale: dict[str, tuple[float, float]],
                  weights: tuple[float, float], label: str = LABEL) -> DataFrame:
    """``(position, value)``: at the coefficients ``beta`` (intercept first)
    the weighted log loss, its gradient, and its Gram matrix row by row. Rows
    with a NULL are left out, as the model frame has none."""
    features = list(scale)
    beta = np.asarray(beta, float)
    mean, std = (np.array([scale[f][k] for f in features]) for k in (0, 1))
    std = np.where(std > 0, std, 1.0)
    n = len(beta)

    def sums(batches):
        total = np.zeros(1 + n + n * n)
        for batch in batches:
            values = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) if batch.num_rows else np.zeros((0, n))
            y = values[:, -1]
            x = np.column_stack([np.ones(len(y)), (values[:, :-1] - mean) / std])
            s = np.where(y == 1, weights[1], weights[0])
            z = x @ beta
            p = 1 / (1 + np.exp(-z))
            total[0] += (s * (np.logaddexp(0, z) - y * z)).sum()
            total[1:n + 1] += x.T @ (s * (p - y))
            total[n + 1:] += (x.T @ (x * (s * p * (1 - p))[:, None])).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["position", "value"])

    rows = train.select(*[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("double").alias("_y")).na.drop()
    return rows.mapInArrow(sums, "position long, value double").groupBy("position").agg(F.sum("value").alias("value"))


def _setting(train: DataFrame, features: Sequence[str]):
    counts = class_counts(train)
    stats = {r["feature"]: (r["mean"], r["std"]) for r in scaler_stats(train, features).collect()}
    return {f: stats[f] for f in features}, (counts.balanced(0), counts.balanced(1))


def logistic_gradient(train: DataFrame, beta: Sequence[float], features: Sequence[str] = FEATURES) -> DataFrame:
    """The gradient of the objective at ``beta`` as rows ``(term, gradient)``."""
    scale, weights = _setting(train, features)
    terms = F.array(*[F.lit(t) for t in ["intercept", *features]])
    penalty = F.array(*[F.lit(0.0), *[F.lit(float(b)) for b in list(beta)[1:]]])
    place = F.col("position").cast("int")
    sums = logistic_sums(train, beta, scale, weights).filter(F.col("position").between(1, len(features) + 1))
    return sums.select(F.element_at(terms, place).alias("term"), (F.col("value") + F.element_at(penalty, place)).alias("gradient"))


def newton_logistic(train: DataFrame, features: Sequence[str] = FEATURES) -> np.ndarray:
    """The optimum, intercept first, by damped Newton steps; ``train``
    should be kept, as every step reads it once."""
    scale, weights = _setting(train, features)
    n = len(features) + 1
    penalty = np.diag([0.0, *[1.0] * (n - 1)])

    def at(beta):
        rows = {r.position: r.value for r in logistic_sums(train, beta, scale, weights).collect()}
        total = np.array([rows[i] for i in range(1 + n + n * n)])
        return total[0] + 0.5 * beta @ penalty @ beta, total[1:n + 1] + penalty @ beta, total[n + 1:].reshape(n, n) + penalty

    beta = np.zeros(n)
    loss, gradient, gram = at(beta)
    for _ in range(MAX_STEPS):
        step = np.linalg.solve(gram, gradient)
        size = 1.0
        while True:
            tried = at(beta - size * step)
            if tried[0] <= loss + 1e-9 * abs(loss) or size < 1e-6:
                break
            size /= 2
        beta = beta - size * step
        loss, gradient, gram = tried
        if np.abs(size * step).max() <= TOLERANCE * max(1.0, np.abs(beta).max()):
            break
    return beta
