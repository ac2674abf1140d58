"""Sparse logistic regression, binary or multinomial: follow the regularised leader with an elastic net.

Features are hashed counts. What a model learns from is a sample of bounded size, whose features are made by many tasks
and learned from by one; the weights that are not zero, at most dims x classes numbers, come to the driver.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

HASHED = 1 << 20


@dataclass(frozen=True)
class Params:
    """dims: buckets of the hash. alpha, beta: learning rate; l1, l2: penalties. sample: rows to learn from. spare: share of them for the temperature."""

    dims: int = 1 << 16
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 1e-4
    l2: float = 1e-6
    epochs: int = 4
    sample: int = 4000
    spare: float = 0.2


def counted(bucket: np.ndarray, offsets: np.ndarray, dims: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, counts) of each text."""
    for a, b in zip(offsets, offsets[1:]):
        part = bucket[a:b]
        if b - a < 512:
            at, n = np.unique(part, return_counts=True)
        else:
            n = np.bincount(part, minlength=dims)
            at = np.flatnonzero(n)
            n = n[at]
        yield at, n


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Leader:
    """Weights per bucket and class; they are worked out from the sums of gradients when they are looked at."""

    def __init__(self, p: Params, classes: int) -> None:
        self.p, self.z, self.n = p, np.zeros((p.dims, classes)), np.zeros((p.dims, classes))

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, p = self.z[at], self.p
        return np.where(np.abs(z) <= p.l1, 0.0, -(z - np.sign(z) * p.l1) / ((p.beta + np.sqrt(self.n[at])) / p.alpha + p.l2))

    def learn(self, at: np.ndarray, value: np.ndarray, label: int) -> None:
        w = self.weights(at)
        error = softmax(value @ w)
        error[label] -= 1
        g = value[:, None] * error
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.p.alpha * w
        self.n[at] = n + g * g


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the scores that makes the spare rows likeliest, by golden section on its logarithm."""
    if not len(labels):
        return 1.0
    loss = lambda t: -np.log(np.maximum(softmax(scores / np.exp(t))[np.arange(len(labels)), labels], 1e-300)).sum()
    lo, hi, cut = np.log(0.25), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = hi - cut * (hi - lo), lo + cut * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def _fitted(batches: Iterator[pa.RecordBatch], p: Params, classes: int) -> Iterator[pa.RecordBatch]:
    rows = []
    for batch in batches:
        order, label, at, value = (batch.column(i) for i in range(4))
        ends = at.offsets.to_numpy()
        a, v = at.flatten().to_numpy(), value.flatten().to_numpy()
        first = ends[0]
        rows += [(o, y, a[s - first:e - first].copy(), v[s - first:e - first].copy()) for o, y, s, e in zip(order.to_pylist(), label.to_pylist(), ends, ends[1:])]
    rows.sort(key=lambda r: (r[0], r[1], len(r[2])))
    spare = [r for i, r in enumerate(rows) if (i * p.spare) % 1 + p.spare > 1 - 1e-9 and len(rows) > 20]
    keep = [r for i, r in enumerate(rows) if not ((i * p.spare) % 1 + p.spare > 1 - 1e-9 and len(rows) > 20)]
    leader = Leader(p, classes)
    for epoch in range(p.epochs):
        for i in np.random.default_rng(epoch).permutation(len(keep)):
            _, y, at, value = keep[i]
            leader.learn(at, value.astype(np.float64), y)
    w = leader.weights(slice(None))
    t = temperature(np.array([v @ w[a] for _, _, a, v in spare]).reshape(-1, classes), np.array([r[1] for r in spare], np.int64))
    i, k = np.nonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(i, -1).astype(np.int32)), pa.array(np.append(k, 0).astype(np.int32)), pa.array(np.append(w[i, k], t))], names=["at", "class", "weight"])


def fit(features: DataFrame, p: Params, classes: int) -> tuple[np.ndarray, float]:
    """(weights, temperature) from rows of order long, label int, at array<int>, value array<float>: a bounded sample."""
    w, t = np.zeros((p.dims, classes)), 1.0
    for r in features.repartition(1).mapInArrow(lambda it: _fitted(it, p, classes), "at int, class int, weight double").collect():
        if r["at"] < 0:
            t = r["weight"]
        else:
            w[r["at"], r["class"]] = r["weight"]
    return w, t


def sampled(rows: DataFrame, n: int, most: int, *keys: str) -> DataFrame:
    """About `most` of n rows, chosen by a hash of the keys, so the choice does not hang on partitions."""
    share = min(1.0, most / max(1, n))
    return rows if share >= 1 else rows.filter(F.pmod(F.xxhash64(F.lit("sample"), *keys), F.lit(HASHED)) < int(share * HASHED))


def crc_mod(id_col: Column, m: int) -> Column:
    """crc32 of an id as text, modulo m; a null id counts as empty text."""
    return (F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % m).cast("int")
