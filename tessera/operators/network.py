"""Restricted Boltzmann machine and feed-forward network; gradients are summed over the executors.

A step takes one hashed minibatch of the rows: each partition returns the sum of its rows' gradients, as
large as the parameters whatever the rows, and the driver adds them up. The networks are small.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACTIVATIONS = {
    "sigmoid": (lambda z: 1 / (1 + np.exp(-z)), lambda a: a * (1 - a)),
    "tanh": (np.tanh, lambda a: 1 - a * a),
    "relu": (lambda z: np.maximum(z, 0), lambda a: (a > 0).astype(float)),
    "softmax": (lambda z: np.exp(z - z.max(axis=1, keepdims=True)) / np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True), lambda a: np.ones_like(a)),
}


def _batch(rows: DataFrame, step: int, share: float) -> DataFrame:
    return rows if share >= 1 else rows.filter(F.pmod(F.xxhash64("row", F.lit(step)), F.lit(1_000_000)) < int(share * 1_000_000))


def _sum(rows: DataFrame, gradient, size: int) -> tuple[np.ndarray, int]:
    """Sum of ``gradient(x, y, rows)`` (a flat vector) over all rows, and the number of rows."""

    def run(batches):
        total, n = np.zeros(size), 0
        for pdf in batches:
            if len(pdf):
                x = np.array(pdf["x"].tolist(), dtype=float)
                y = pdf["y"].to_numpy(dtype=float) if "y" in pdf else None
                total += gradient(x, y, pdf["row"].to_numpy())
                n += len(pdf)
        yield pd.DataFrame({"g": [total.tolist()], "n": [n]})

    parts = rows.mapInPandas(run, "g array<double>, n bigint")
    summed = parts.select(F.posexplode("g").alias("i", "v"), "n").groupBy("i").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).orderBy("i").collect()  # one row per parameter
    return np.array([r.v for r in summed]), int(summed[0].n) if summed else 0


class Rbm:
    """RBM with binary hidden units; visible units binary ("BB") or Gaussian ("GB")."""

    def __init__(self, visible: int, hidden: int, units: str = "BB", seed: int = 1):
        rng = np.random.default_rng(seed)
        self.w, self.b, self.c, self.units, self.seed = rng.normal(0, 0.01, (visible, hidden)), np.zeros(visible), np.zeros(hidden), units, seed

    def hidden(self, v):
        return ACTIVATIONS["sigmoid"][0](v @ self.w + self.c)

    def visible(self, h):
        z = h @ self.w.T + self.b
        return ACTIVATIONS["sigmoid"][0](z) if self.units == "BB" else z

    def fit(self, rows: DataFrame, epochs: int = 10, rate: float = 0.03, share: float = 0.5, steps: int = 1, momentum: float = 0.6) -> "Rbm":
        """CD-``steps`` on rows (row, x); a minibatch is a hashed share of the rows."""
        shapes = (self.w.shape, self.b.shape, self.c.shape)
        speed = np.zeros(self.w.size + self.b.size + self.c.size)
        for epoch in range(epochs):

            def gradient(v, _, ids, epoch=epoch):
                rng = np.random.default_rng([self.seed, epoch, int(ids[0])])
                h = start = self.hidden(v)
                for _ in range(steps):
                    x = self.visible((rng.random(h.shape) < h).astype(float))
                    h = self.hidden(x)
                return np.concatenate([(v.T @ start - x.T @ h).ravel(), (v - x).sum(axis=0), (start - h).sum(axis=0)])

            total, n = _sum(_batch(rows.select("row", "x"), epoch, share), gradient, speed.size)
            if n:
                speed = momentum * speed + rate * total / n
                parts = np.split(speed, np.cumsum([self.w.size, self.b.size]))
                self.w, self.b, self.c = self.w + parts[0].reshape(shapes[0]), self.b + parts[1], self.c + parts[2]
        return self

    def free_energy(self, v):
        z = v @ self.w + self.c
        return -(v @ self.b) - np.logaddexp(0, z).sum(axis=1)

    def log_likelihood(self, rows: DataFrame) -> float:
        """Mean exact log-likelihood of rows of binary units; the normaliser is summed over all states of the hidden units, at most 2^20."""
        hidden = len(self.c)
        if hidden > 20:
            raise ValueError("too many hidden units for the exact normaliser")
        total = -np.inf
        for at in range(0, 1 << hidden, 4096):  # a block of states of the hidden units at a time
            states = np.arange(at, min(1 << hidden, at + 4096))
            h = (states[:, None] >> np.arange(hidden) & 1).astype(float)
            z = h @ self.c + np.logaddexp(0, h @ self.w.T + self.b).sum(axis=1)
            total = np.logaddexp(total, np.logaddexp.reduce(z))
        summed, n = _sum(rows.select("row", "x"), lambda v, _, ids: np.array([-self.free_energy(v).sum()]), 1)
        return float(summed[0] / max(n, 1) - total) if n else 0.0

    def pseudo_likelihood(self, rows: DataFrame) -> float:
        """Mean log-likelihood of one entry of each row given the others, times the entries: a monitor of the training of binary units."""

        def gradient(v, _, ids):
            at = ids.astype(np.int64) % v.shape[1]
            flipped = v.copy()
            flipped[np.arange(len(v)), at] = 1 - flipped[np.arange(len(v)), at]
            return np.array([-np.logaddexp(0, self.free_energy(v) - self.free_energy(flipped)).sum() * v.shape[1]])

        total, n = _sum(rows.select("row", "x"), gradient, 1)
        return float(total[0] / max(n, 1)) if n else 0.0

    def reconstruction_error(self, rows: DataFrame) -> float:
        total, n = _sum(rows.select("row", "x"), lambda v, _, ids: np.array([((v - self.visible(self.hidden(v))) ** 2).sum()]), 1)
        return float(total[0] / max(n, 1))


class Network:
    """Feed-forward network; ``pretrain`` sets the layers by stacked RBMs, ``fit`` runs minibatch descent.

    One output is a sigmoid with the loss nll or mse; several are a softmax over classes 0, 1, ... with the loss nll.
    """

    def __init__(self, sizes: list[int], activation: str = "tanh", loss: str = "nll", seed: int = 1):
        rng = np.random.default_rng(seed)
        self.layers = [(rng.normal(0, 1 / np.sqrt(a), (a, b)), np.zeros(b)) for a, b in zip(sizes, sizes[1:])]
        self.activation, self.loss = activation, loss

    def forward(self, x):
        out = [x]
        for k, (w, b) in enumerate(self.layers):
            last = k == len(self.layers) - 1
            out.append(ACTIVATIONS[self.output if last else self.activation][0](out[-1] @ w + b))
        return out

    @property
    def output(self) -> str:
        return "sigmoid" if len(self.layers[-1][1]) == 1 else "softmax"

    def pretrain(self, rows: DataFrame, **options) -> "Network":
        """Greedy: each layer is an RBM on the outputs of the ones below, over all rows."""
        for k, (w, _) in enumerate(self.layers[:-1]):
            below = self.layers[:k]

            def lift(batches, below=below):
                for pdf in batches:
                    x = np.array(pdf["x"].tolist(), dtype=float).reshape(len(pdf), -1)
                    for v, b in below:
                        x = ACTIVATIONS["sigmoid"][0](x @ v + b)
                    yield pd.DataFrame({"row": pdf["row"], "x": list(map(list, x))})

            lifted = rows.select("row", "x").mapInPandas(lift, "row bigint, x array<double>") if k else rows
            machine = Rbm(*w.shape).fit(lifted, **options)
            self.layers[k] = (machine.w, machine.c)
        return self

    def fit(self, rows: DataFrame, iterations: int = 30, rate: float = 0.5, share: float = 0.5) -> "Network":
        """Minibatch descent on rows (row, x, y) with the loss nll or mse."""
        sizes = [(w.shape, b.shape) for w, b in self.layers]
        count = sum(w.size + b.size for w, b in self.layers)
        for step in range(iterations):

            def gradient(x, y, _):
                out = self.forward(x)
                wanted = y[:, None] if self.output == "sigmoid" else (y[:, None] == np.arange(out[-1].shape[1])).astype(float)
                delta, parts = out[-1] - wanted, []
                if self.loss == "mse":
                    delta = delta * ACTIVATIONS["sigmoid"][1](out[-1])
                for k in range(len(self.layers) - 1, -1, -1):
                    parts = [(out[k].T @ delta).ravel(), delta.sum(axis=0), *parts]
                    if k:
                        delta = (delta @ self.layers[k][0].T) * ACTIVATIONS[self.activation][1](out[k])
                return np.concatenate(parts)

            total, n = _sum(_batch(rows.select("row", "x", "y"), step, share), gradient, count)
            if n:
                at, new = 0, []
                for (w, b), (ws, bs) in zip(self.layers, sizes):
                    gw, at = total[at : at + w.size].reshape(ws), at + w.size
                    gb, at = total[at : at + b.size].reshape(bs), at + b.size
                    new.append((w - rate * gw / n, b - rate * gb / n))
                self.layers = new
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        """``row, y, score``: the output, or the likeliest class of several."""
        decide = (lambda a: a[:, 0]) if self.output == "sigmoid" else (lambda a: a.argmax(axis=1).astype(float))

        def run(batches):
            for pdf in batches:
                x = np.array(pdf["x"].tolist(), dtype=float).reshape(len(pdf), -1)
                yield pd.DataFrame({"row": pdf["row"], "y": pdf["y"], "score": decide(self.forward(x)[-1]) if len(pdf) else []})

        return rows.select("row", F.col("y").cast("double").alias("y"), "x").mapInPandas(run, "row bigint, y double, score double")
