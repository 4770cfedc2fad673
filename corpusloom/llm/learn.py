"""What the trained operators share: labelled samples of bounded size, a small network, calibration."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import held_out


def sample(labels: DataFrame, column: str, bound: int) -> DataFrame:
    """(doc_id, label) of about ``bound`` labelled rows at most, none of them held out.

    Rows are chosen by a hash of the id. An id with both labels is left out, an
    id given twice counts once.
    """
    rows = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(column).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most"))
        .where("label = most").select("doc_id", "label")
    )
    share = bound / max(1, rows.count())
    if share >= 1:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(1_000_000)) < math.floor(share * 1_000_000))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Network:
    """Two layers, tanh between them, over standardised inputs; a temperature divides its output."""

    def __init__(self, width: int, hidden: int = 32, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(width), np.ones(width)
        self.weights = [
            draw.normal(0, 1 / math.sqrt(width), (width, hidden)), np.zeros(hidden),
            draw.normal(0, 1 / math.sqrt(hidden), hidden), np.zeros(1),
        ]
        self.temperature = 1.0

    def logits(self, rows: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        x = np.clip((rows - self.mean) / self.scale, -8, 8)
        return np.tanh(x @ a + b) @ c + d[0]

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(rows) / self.temperature)

    def fit(self, rows: np.ndarray, labels: np.ndarray, epochs: int = 40, steps: int = 1500, size: int = 256, rate: float = 3e-3, decay: float = 1e-4, seed: int = 7) -> None:
        """Adam on the log loss, over ``epochs`` passes and ``steps`` steps at least; a fifth of the rows is kept for the temperature."""
        draw = np.random.default_rng(seed)
        order = draw.permutation(len(rows))
        cut = len(rows) // 5
        check, use = order[:cut], order[cut:]
        self.mean = rows[use].mean(axis=0)
        self.scale = np.maximum(rows[use].std(axis=0), 1e-3)
        x, y = np.clip((rows[use] - self.mean) / self.scale, -8, 8), labels[use].astype(float)
        first, second = ([np.zeros_like(w) for w in self.weights] for _ in range(2))
        epochs, step = max(epochs, -(-steps // -(-len(x) // size))), 0
        for epoch in range(epochs):
            turn = draw.permutation(len(x))
            for at in range(0, len(x), size):
                part = turn[at : at + size]
                a, b, c, d = self.weights
                inner = np.tanh(x[part] @ a + b)
                error = (sigmoid(inner @ c + d[0]) - y[part]) / len(part)
                back = error[:, None] * c * (1 - inner**2)
                grads = [x[part].T @ back + decay * a, back.sum(axis=0), inner.T @ error + decay * c, np.array([error.sum()])]
                step += 1
                speed = rate * (1 - epoch / epochs)
                for k, grad in enumerate(grads):
                    first[k] = 0.9 * first[k] + 0.1 * grad
                    second[k] = 0.999 * second[k] + 0.001 * grad**2
                    self.weights[k] = self.weights[k] - speed * (first[k] / (1 - 0.9**step)) / (
                        np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8
                    )
        if cut:
            self.temperature = temperature(self.logits(rows[check]), labels[check])


def temperature(logits: np.ndarray, labels: np.ndarray, low: float = 0.2, high: float = 5.0) -> float:
    """The divisor of ``logits`` with the least log loss, by golden section on its logarithm."""
    def loss(t: float) -> float:
        z = logits / math.exp(t)
        return float(np.mean(np.logaddexp(0, z) - labels * z))

    a, b, g = math.log(low), math.log(high), (math.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return math.exp((a + b) / 2)
