"""Embedding near copies by an epsilon grid order join.

Unit vectors are at least as far apart as their projections on the leading principal directions. There a grid of cells as
wide as the largest distance that still links gives the order of the cells; the sequence is cut into blocks with a bounding
box each. Pairs of intervals of the sequence are refined level by level, from a few long ones down to blocks, and those
whose boxes are too far apart are left out with all they hold. The remaining pairs of blocks are joined by tasks, which
halve them in the same way down to small products of matrices.

Equal vectors are one node with a weight, so copies are never paired with each other. A task returns sums of links per node
and a spanning forest of its links, never all pairs.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import ship, stable
from .graph import components, labelled

LEADING = 8
BLOCK = 4096
LEAF = 512
FAN = 8
#: Single precision only chooses which pairs are looked at again in double precision.
SLACK = 1e-4


def usable(v: Column) -> Column:
    """Whether a vector has a direction: not null, only finite numbers, not all zero."""
    return F.coalesce(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision, short ones filled with zeros, and their own lengths."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = np.zeros((len(sizes), width))
    x[np.arange(width) < sizes[:, None]] = flat
    x /= np.maximum(np.abs(x).max(axis=1, keepdims=True, initial=0), np.finfo(float).tiny)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), np.finfo(float).tiny), sizes


def _moments(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    second, n = np.zeros((width + 1, width + 1)), 0
    for batch in batches:
        u = np.hstack([matrix(batch.column(0), width)[0], np.ones((batch.num_rows, 1))])
        second += u.T @ u
        n += batch.num_rows
    if n:
        i, j = np.indices(second.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(second.ravel())], names=["i", "j", "s"])


def directions(vectors: DataFrame, width: int, leading: int) -> np.ndarray:
    """Leading principal directions over all vectors. The driver gets sums of products: width squared numbers."""
    rows = vectors.select("vector").mapInArrow(lambda it: _moments(it, width), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    m = np.zeros((width + 1, width + 1))
    for r in rows:
        m[r["i"], r["j"]] = r["s"]
    n = max(m[width, width], 1.0)
    mean = m[width, :width] / n
    return np.linalg.eigh(m[:width, :width] / n - np.outer(mean, mean))[1][:, ::-1][:, :leading]


def _projected(batches: Iterator[pa.RecordBatch], axes: np.ndarray, eps: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        p = matrix(batch.column(2), len(axes))[0] @ axes
        cells = np.floor(p / eps).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]), pa.array(x.ravel())) for x in (cells, p)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *lists], names=["node", "weight", "vector", "cells", "place"])


def _far(lo: np.ndarray, hi: np.ndarray, lo2: np.ndarray, hi2: np.ndarray, eps: float) -> bool:
    gap = np.maximum(0, np.maximum(lo - hi2, lo2 - hi))
    return float(gap @ gap) > eps * eps


class Joint:
    """The links between two sequences of nodes (or within one): sums per node and classes."""

    def __init__(self, u: np.ndarray, sizes: np.ndarray, weight: np.ndarray, axes: np.ndarray, least: float, eps: float) -> None:
        self.u, self.single, self.sizes, self.weight = u, u.astype(np.float32), sizes, weight
        self.place, self.least, self.eps = u @ axes, least, eps
        self.links, self.label = np.zeros(len(u), np.int64), np.arange(len(u))

    def join(self, a: tuple[int, int], b: tuple[int, int]) -> None:
        """Links of interval a with interval b; the same interval twice means its own pairs."""
        boxes = [(p.min(axis=0), p.max(axis=0)) for p in (self.place[slice(*a)], self.place[slice(*b)])]
        if a != b and _far(*boxes[0], *boxes[1], self.eps):
            return
        if max(a[1] - a[0], b[1] - b[0]) <= LEAF:
            self.compare(a, b)
            return
        halves = lambda x: [x] if x[1] - x[0] <= LEAF else [(x[0], (x[0] + x[1]) // 2), ((x[0] + x[1]) // 2, x[1])]
        for x in halves(a):
            for y in halves(b):
                if a != b or x <= y:
                    self.join(x, y)

    def compare(self, a: tuple[int, int], b: tuple[int, int]) -> None:
        near = self.single[slice(*a)] @ self.single[slice(*b)].T >= self.least - SLACK
        i, j = np.nonzero(np.triu(near, 1) if a == b else near)
        if not len(i):
            return
        i, j = i + a[0], j + b[0]
        c = np.einsum("ij,ij->i", self.u[i], self.u[j])
        for k in np.flatnonzero(np.abs(c - self.least) < 1e-12):
            x, y = self.u[i[k]], self.u[j[k]]
            c[k] = math.fsum(x * y) / math.sqrt(math.fsum(x * x) * math.fsum(y * y))
        ok = (c >= self.least) & (self.sizes[i] == self.sizes[j])
        i, j = i[ok], j[ok]
        np.add.at(self.links, i, self.weight[j])
        np.add.at(self.links, j, self.weight[i])
        self.merge(self.label[i], self.label[j])

    def merge(self, x: np.ndarray, y: np.ndarray) -> None:
        while (apart := x != y).any():
            to = np.arange(len(self.label))
            np.minimum.at(to, np.maximum(x[apart], y[apart]), np.minimum(x[apart], y[apart]))
            while (to[to] != to).any():
                to = to[to]
            self.label, x, y = to[self.label], to[x], to[y]


def _block_pair(both: pa.Table, axes: np.ndarray, least: float, eps: float) -> pa.Table:
    same = both.column("i")[0] == both.column("j")[0]
    u, sizes = matrix(both.column("vector").combine_chunks(), len(axes))
    first = both.column("first").to_numpy()
    node, weight = both.column("node").to_numpy(), both.column("weight").to_numpy()
    place = u @ axes
    order = np.lexsort([*np.floor(place / eps).T[::-1], ~first])
    n = int(first.sum())
    j = Joint(u[order], sizes[order], weight[order], axes, least, eps)
    node = node[order]
    j.join((0, n), (0, n) if same else (n, len(node)))
    hit = np.flatnonzero(j.links)
    root = node[j.label[hit]]
    return pa.table({"node": node[hit], "links": j.links[hit], "other": root})


def _boxes(blocks: DataFrame, level: int, leading: int) -> DataFrame:
    """(part, box) of the intervals of FAN**level blocks."""
    lo = F.array(*[F.min(F.col("lo")[k]) for k in range(leading)])
    hi = F.array(*[F.max(F.col("hi")[k]) for k in range(leading)])
    return blocks.groupBy(F.floor(F.col("block") / FAN**level).cast("long").alias("part")).agg(lo.alias("lo"), hi.alias("hi"))


def _near(eps: float) -> Column:
    gap = lambda i: F.greatest(F.lit(0.0), F.col("a.lo")[i] - F.col("b.hi")[i], F.col("b.lo")[i] - F.col("a.hi")[i])
    return F.aggregate(F.sequence(F.lit(0), F.size("a.lo") - 1), F.lit(0.0), lambda s, i: s + gap(i) * gap(i)) <= eps * eps


def block_pairs(blocks: DataFrame, n: int, leading: int, eps: float) -> DataFrame:
    """(i, j), i <= j: blocks whose boxes may hold links, by refining pairs of intervals level by level."""
    top = max(1, math.ceil(math.log(max(n, 2), FAN)))
    pairs = None
    for level in range(top - 1, -1, -1):
        boxes = _boxes(blocks, level, leading).withColumn("above", F.floor(F.col("part") / FAN).cast("long"))
        if pairs is None:
            pairs = boxes.select(F.col("above").alias("i"), F.col("above").alias("j")).distinct()
        grown = pairs.join(boxes.alias("a"), F.col("i") == F.col("a.above")).join(boxes.alias("b"), F.col("j") == F.col("b.above"))
        pairs = grown.filter((F.col("a.part") <= F.col("b.part")) & _near(eps)).select(F.col("a.part").alias("i"), F.col("b.part").alias("j"))
    return pairs


def classes(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95, leading: int = LEADING, block: int = BLOCK) -> DataFrame:
    """One row per row of df: id, n_links (other vectors with cosine >= least), component_id and kept (id = component_id).

    Rows without id and vectors without a direction (null, zero, null or non-finite components) have no links. Vectors of
    different lengths never link. Equal vectors, and rows repeated, link with each other. Different vectors under one id keep
    their own links and components; components with the same smallest id show the same component_id. Extra columns are not
    returned; an empty table gives an empty result.
    """
    spark = df.sparkSession
    ship(spark)
    vector = df[vector_col]
    rows = df.select(df[id_col].cast("long").alias("id"), F.when(usable(vector) & df[id_col].isNotNull(), vector).alias("vector"))
    rows = rows.select("*", *[F.when(F.col("vector").isNotNull(), F.xxhash64(F.lit(s), "vector")).alias(f"d{s}") for s in (0, 1)])
    nodes = rows.filter("vector is not null").groupBy("d0", "d1").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("weight"), F.first("vector").alias("vector"))
    held = stable(nodes.withColumn("node", F.monotonically_increasing_id()), "vectors")  # a vector is a node, whatever ids it has
    width, count = held.agg(F.coalesce(F.max(F.size("vector")), F.lit(1)), F.count(F.lit(1))).first()
    eps = math.sqrt(max(0.0, 2 - 2 * least)) + 1e-9
    leading = min(leading, width)
    axes = directions(held, width, leading)
    placed = held.select("node", "weight", "vector").mapInArrow(lambda it: _projected(it, axes, eps), f"node long, weight long, vector {dict(held.dtypes)['vector']}, cells array<int>, place array<double>")
    parts = max(1, math.ceil(count / block))
    order = [F.col("cells")[k] for k in range(leading)]
    ranged = stable(placed.repartitionByRange(parts, *order, "node").select("*", F.spark_partition_id().alias("part")), "sequence")
    before = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    at = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*order, "node")) - 1
    sequence = stable(ranged.join(before, "part").select("node", "weight", "vector", "place", F.floor(at / block).cast("long").alias("block")), "blocks")
    ends = sequence.groupBy("block").agg(*[F.array(*[f(F.col("place")[k]) for k in range(leading)]).alias(name) for f, name in ((F.min, "lo"), (F.max, "hi"))])
    pairs = block_pairs(stable(ends, "boxes"), parts, leading, eps)
    body = sequence.select("block", "node", "weight", "vector")
    side = lambda p, c, first: p.join(body, F.col(c) == F.col("block")).select("i", "j", "node", "weight", "vector", F.lit(first).alias("first"))
    both = side(pairs, "i", True).union(side(pairs.filter("i < j"), "j", False))
    found = stable(both.groupBy("i", "j").applyInArrow(lambda t: _block_pair(t, axes, least, eps), "node long, links long, other long"), "found")
    sums = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = components(found.select("node", "other"), "node", "other")
    merged = nodes_of(held, sums, known)
    out = labelled(rows.select("id", "d0", "d1"), merged, ["d0", "d1"], "weight", held.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0])
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component", "id").alias("component_id"),
                      F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(True)).alias("kept"))


def nodes_of(held: DataFrame, sums: DataFrame, known: DataFrame) -> DataFrame:
    """(d0, d1, weight, n_links, component) of the nodes; a component's label is the smallest id of its rows."""
    m = held.select("d0", "d1", "node", "least", "weight").join(sums, "node", "left").join(known, "node", "left").withColumn("of", F.coalesce("component", "node")).drop("component")
    label = m.filter(F.col("of") != F.col("node")).groupBy("of").agg(F.min("least").alias("other"))
    label = held.select(F.col("node").alias("of"), F.col("least").alias("own")).join(label, "of", "left").select("of", F.least("own", "other").alias("component"))
    return m.join(label, "of").select("d0", "d1", "weight", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component")
