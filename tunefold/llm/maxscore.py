"""Exact top-k inner products by MaxScore over sharded postings.

A document is a list of (term, integer weight), so is a query; the score is their inner product and may be negative.
Documents are dealt to shards of bounded size and queries to blocks of bounded size, and a task joins one shard with one
block. In a shard every term has its postings and its largest and smallest weight, hence a bound of what it can add to a
query's score. With the k-th best score so far as the limit, the terms of least bound whose bounds together stay below it
are non-essential: a document without any other term cannot enter. The postings of the essential terms are added up, the
others are probed in falling order of their bounds for the documents that can still reach the limit. The results of all
shards are merged per query.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import ship, stable

SHARD = 8192
QUERIES = 1024
SEED_DOCS = 256
#: Queries whose essential columns are added up at once.
TOGETHER = 64
LONG = (1 << 63) - 1


class Postings:
    """Postings of the documents of a shard, which are numbered in the order of their ids.

    Terms that a quarter of the documents have are columns of a matrix (in double precision, if all scores are exact in it),
    so that adding up their postings for many queries is a product of matrices; the others are lists of documents and weights.
    """

    def __init__(self, n: int, doc: np.ndarray, term: np.ndarray, weight: np.ndarray, exact: bool) -> None:
        order = np.lexsort((doc, term))
        self.n, self.doc, self.weight = n, doc[order], weight[order]
        self.terms, start = np.unique(term[order], return_index=True)
        self.start = np.append(start, len(order))
        self.most = np.maximum.reduceat(self.weight, start) if len(start) else np.zeros(0, np.int64)
        self.least = np.minimum.reduceat(self.weight, start) if len(start) else np.zeros(0, np.int64)
        full = np.flatnonzero(np.diff(self.start) * 4 >= n) if exact else np.zeros(0, np.int64)
        self.column = np.full(len(self.terms), -1)
        self.column[full] = np.arange(len(full))
        self.matrix = np.zeros((len(full), n))
        for row, t in zip(self.matrix, full):
            docs, w = self.of(t)
            row[docs] = w

    def of(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and weights of a term."""
        s, e = self.start[t], self.start[t + 1]
        return self.doc[s:e], self.weight[s:e]

    def probe(self, t: int, docs: np.ndarray):
        """Weights of a term in some documents, 0 where it does not occur."""
        if self.column[t] >= 0:
            return self.matrix[self.column[t], docs]
        have, w = self.of(t)
        at = np.minimum(np.searchsorted(have, docs), len(have) - 1)
        return np.where(have[at] == docs, w[at], 0)

    def scores(self, at: np.ndarray, q: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Whole scores of some documents for the terms `at` with weights `q`."""
        full = self.column[at] >= 0
        out = q[full].astype(np.float64) @ self.matrix[np.ix_(self.column[at[full]], docs)] if full.any() else np.zeros(len(docs), self.weight.dtype)
        for t, w in zip(at[~full], q[~full]):
            out = out + w * self.probe(t, docs)
        return out


class Query:
    """The terms of a query that a shard has, by rising bound. cut: how many of them are non-essential for the limit."""

    def __init__(self, p: Postings, terms: np.ndarray, weights: np.ndarray, own: np.ndarray, k: int) -> None:
        at = np.searchsorted(p.terms, terms)
        ok = (at < len(p.terms)) & (weights != 0)
        ok[ok] = p.terms[at[ok]] == terms[ok]
        at, q = at[ok], weights[ok]
        bound = np.maximum(np.maximum(q * p.most[at], q * p.least[at]), 0)
        order = np.argsort(bound, kind="stable")
        self.at, self.q, self.bound, self.own, self.k, self.limit, self.cut = at[order], q[order], bound[order], own, k, None, 0
        self.reach = np.cumsum(self.bound)
        self.raised(p, np.setdiff1d(np.arange(min(p.n, SEED_DOCS + len(own))), own))
        if self.limit is not None:
            self.cut = int(np.searchsorted(self.reach, self.limit, side="left"))

    def raised(self, p: Postings, docs: np.ndarray) -> None:
        """Raise the limit to the k-th best of some documents."""
        if len(docs) >= self.k:
            best = np.sort(p.scores(self.at, self.q, docs))[-self.k]
            self.limit = best if self.limit is None else max(best, self.limit)

    def best(self, p: Postings, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the k best of a shard, and of all equal to the last. score: sums of the essential columns."""
        essential = self.at[self.cut:]
        dense = p.column[essential] >= 0
        touched = np.full(p.n, bool(dense.any()) or not self.cut)
        for t, w in zip(essential[~dense], self.q[self.cut:][~dense]):
            docs, weight = p.of(t)
            score[docs] += w * weight
            touched[docs] = True
        touched[self.own] = False
        docs = np.flatnonzero(touched)
        got = score[docs]
        rest = self.reach[self.cut - 1] if self.cut else 0
        if self.cut and len(docs) > self.k:
            self.raised(p, docs[np.argpartition(got, len(got) - self.k)[-self.k:]] if got.dtype != object else docs[: self.k])
        for t, w, b in zip(self.at[: self.cut][::-1], self.q[: self.cut][::-1], self.bound[: self.cut][::-1]):
            able = got + rest >= self.limit
            docs, got = docs[able], got[able]
            got = got + w * p.probe(t, docs)
            rest -= b
        if len(docs) > self.k:
            last = np.sort(got)[-self.k] if got.dtype == object else np.partition(got, len(got) - self.k)[-self.k]
            docs, got = docs[got >= last], got[got >= last]
        return docs, got


def search(p: Postings, queries: list[Query]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The k best of a shard for each query: essential columns of all queries at once, then each query's lists and probes."""
    weights = np.zeros((len(queries), len(p.matrix)))
    for i, q in enumerate(queries):
        at = p.column[q.at[q.cut:]]
        weights[i, at[at >= 0]] = q.q[q.cut:][at >= 0]
    sums = weights @ p.matrix if len(p.matrix) else np.zeros((len(queries), p.n), p.weight.dtype)
    return [q.best(p, s) for q, s in zip(queries, sums)]


def _spread(column: pa.Array, rows: np.ndarray, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind)


def _tile(table: pa.Table, k: int) -> pa.Table:
    table = table.sort_by("id").combine_chunks()
    asked = table.column("asked").to_numpy()
    parts = []
    for side in (False, True):
        t = table.filter(pa.array(asked == side)).combine_chunks()
        terms, weights = t.column("terms").combine_chunks(), t.column("weights").combine_chunks()
        sizes = np.diff(terms.offsets.to_numpy()) if len(terms) else np.zeros(0, np.int64)
        parts.append((t.column("id").to_numpy(), t.column("n").to_numpy(), np.repeat(np.arange(len(sizes)), sizes), _spread(terms, sizes, np.int64), _spread(weights, sizes, np.int64), np.concatenate(([0], np.cumsum(sizes)))))
    (ids, copies, doc, term, weight, _), (asks, _, _, qterm, qweight, ends) = parts
    out_q, out_d, out_s = [], [], []
    if len(ids) and len(asks):
        largest = lambda w: float(np.abs(w.astype(np.float64)).max(initial=0))
        reach = largest(weight) * largest(qweight) * max(1, len(np.unique(term)))
        if reach >= 2.0**61:
            weight, qweight = weight.astype(object), qweight.astype(object)
        used = weight != 0
        p = Postings(len(ids), doc[used], term[used], weight[used], reach < 2.0**52)
        for at in range(0, len(asks), TOGETHER):
            some = range(at, min(at + TOGETHER, len(asks)))
            own = [np.arange(*np.searchsorted(ids, [asks[i], asks[i] + 1])) for i in some]
            found = search(p, [Query(p, qterm[ends[i]:ends[i + 1]], qweight[ends[i]:ends[i + 1]], o, k) for i, o in zip(some, own)])
            for i, (docs, got) in zip(some, found):
                order = np.lexsort((ids[docs], -got))[:k] if got.dtype != object else np.array(sorted(range(len(docs)), key=lambda j: (-got[j], ids[docs[j]]))[:k], np.int64)
                docs, got = docs[order], got[order]
                times = np.minimum(copies[docs], k)
                out_q.append(np.full(int(times.sum()), asks[i]))
                out_d.append(np.repeat(ids[docs], times))
                out_s.append(np.repeat(np.array([max(-LONG - 1, min(LONG, int(s))) for s in got], np.int64), times))
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return pa.table({"query_id": join(out_q).astype(np.int64), "vec_id": join(out_d).astype(np.int64), "score": join(out_s).astype(np.int64)})


def top_k(docs: DataFrame, queries: DataFrame, k: int = 20, *, shard: int = SHARD, block: int = QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best documents of every query, ties to the smaller id.

    Both inputs have id, terms (array of int, no term twice) and weights (array of long, as long as terms); rows with a
    null among these take no part, other columns are not looked at. A document with the query's id is the query itself and
    left out. Documents without a common term score 0 and count like others. Repeated rows of a document are as many
    documents; of rows that repeat a query's id the one with the smallest terms and weights asks. Scores beyond a long
    stop at its ends. No queries or no documents give an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    slim = lambda d: d.select(d["id"].cast("long").alias("id"), d["terms"].cast("array<int>").alias("terms"), d["weights"].cast("array<long>").alias("weights")).dropna()
    held = stable(slim(docs).groupBy("id", "terms", "weights").agg(F.count(F.lit(1)).alias("n")), "documents")
    asks = stable(slim(queries).groupBy("id").agg(F.min(F.struct("terms", "weights")).alias("v")).select("id", "v.terms", "v.weights"), "queries")
    shards, blocks = max(1, math.ceil(held.count() / shard)), max(1, math.ceil(asks.count() / block))
    deal = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "id", "terms", "weights"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = held.select(deal(shards, 1).alias("shard"), every(blocks).alias("block"), F.lit(False).alias("asked"), "id", "n", "terms", "weights")
    right = asks.select(every(shards).alias("shard"), deal(blocks, 2).alias("block"), F.lit(True).alias("asked"), "id", F.lit(1).cast("long").alias("n"), "terms", "weights")
    found = left.union(right).groupBy("shard", "block").applyInArrow(lambda t: _tile(t, k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
