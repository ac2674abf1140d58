"""Ranked lexical search over per-term geometric blocks.

Documents become sparse vectors of integers: one coordinate per term, its saturated frequency. They are dealt to shards of
bounded size. In a shard every term has its posting list, clustered by the similarity of the whole documents (a random
projection of their vectors; evenly spaced members of the list are the centres), so a block holds documents that look alike.
A block keeps the coordinatewise maximum of its documents, exact and in full for every query that reads the list. The inner
product of this summary with a query is at least the score of each document inside: a block is skipped only when that bound
is below the k-th best score so far, else its documents are scored in full. Lists are read by falling contribution, blocks
by falling bound. The k best of all shards are merged per query.
"""
from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import words
from .common import ship, stable
from .mapped import slices

#: Queries of a block and their characters: what is broadcast. A block reads all documents once.
QUERIES, QUERY_CHARS = 1024, 4 << 20
#: Numbers in a shard's matrix (documents x terms), and documents of a shard at most.
CELLS, DOCS = 8 << 20, 2048
#: Documents a posting block should hold; blocks scored before the limit is looked at again; dimensions of the projection.
BLOCK, FIRST, DIMS = 16, 4, 64
VECTOR = "id long, n long, terms array<int>, times array<int>"


@functools.cache
def letters() -> np.ndarray:
    """Per code point, whether it belongs to a term: ASCII letters and digits, and everything beyond ASCII."""
    ok = np.ones(0x110000, bool)
    ok[:128] = [chr(i).isalnum() for i in range(128)]
    return ok


def terms(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every term, offsets of the texts' terms); only A to Z are lower-cased."""
    low = [(t or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass") for t in texts]
    return words.tokens(low, lower=False, table=letters())


def _vectors(batches: Iterator[pa.RecordBatch], vocabulary: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Per document its number of terms, and how often it has each term of the vocabulary."""
    size = max(1, len(vocabulary))
    for part in (p for batch in batches for p in slices(batch)):
        hashes, ends = terms(part.column(1).to_pylist())
        at = np.minimum(np.searchsorted(vocabulary, hashes), size - 1)
        hit = vocabulary[at] == hashes if len(vocabulary) else np.zeros(len(hashes), bool)
        doc = np.repeat(np.arange(part.num_rows), np.diff(ends))
        key, times = np.unique(doc[hit] * size + at[hit], return_counts=True)
        offsets = pa.array(np.searchsorted(key, np.arange(part.num_rows + 1) * size).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (key % size, times)]
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(ends).astype(np.int64)), *lists], names=["id", "n", "terms", "times"])


def _holders(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(term, documents that hold it) of a partition."""
    held = np.zeros(size, np.int64)
    for batch in batches:
        held += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
    at = np.flatnonzero(held)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(held[at])], names=["term", "df"])


class Asked:
    """The queries of a block: per query its terms (numbers of the vocabulary) and how often it has them."""

    def __init__(self, texts: list[str | None]) -> None:
        hashes, ends = terms(texts)
        self.vocabulary = np.unique(hashes)
        at = np.searchsorted(self.vocabulary, hashes)
        self.queries = [np.unique(at[a:b], return_counts=True) for a, b in zip(ends, ends[1:])]


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


class Blocks:
    """A posting list: documents in the order of their blocks, where blocks start, and the summaries over some columns."""

    def __init__(self, docs: np.ndarray, place: np.ndarray, matrix: np.ndarray, columns: np.ndarray) -> None:
        many = -(-len(docs) // BLOCK)
        if many > 1:
            centres = docs[np.arange(many) * len(docs) // many]
            nearest = (place[docs] @ place[centres].T).argmax(axis=1)
            order = np.argsort(nearest, kind="stable")
            docs, nearest = docs[order], nearest[order]
            self.start = np.append(np.flatnonzero(np.append(True, nearest[1:] != nearest[:-1])), len(docs))
        else:
            self.start = np.array([0, len(docs)])
        self.docs, self.columns = docs, columns
        self.summary = np.maximum.reduceat(matrix[np.ix_(docs, columns)], self.start[:-1], axis=0)

    def bounds(self, columns: np.ndarray, q: np.ndarray) -> np.ndarray:
        """At least the score of every document of each block; columns are among those of the summaries."""
        return self.summary[:, np.searchsorted(self.columns, columns)].astype(np.int64) @ q

    def of(self, blocks: np.ndarray) -> np.ndarray:
        return np.concatenate([self.docs[self.start[b]:self.start[b + 1]] for b in blocks])


class Shard:
    """Documents, numbered in the order of their ids, as a matrix of the shard's terms, and the queries' part of it."""

    def __init__(self, n: int, doc: np.ndarray, term: np.ndarray, value: np.ndarray, weights: np.ndarray, queries: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.here, column = np.unique(term, return_inverse=True)
        self.matrix = np.zeros((n, len(self.here)), np.int32)
        self.matrix[doc, column] = value
        w = weights[self.here]
        turn = words.mix(self.here.astype(np.uint64)[:, None] * np.uint64(DIMS) + np.arange(DIMS, dtype=np.uint64))
        place = (self.matrix * w.astype(np.float32)).astype(np.float32) @ np.where(turn & np.uint64(1), 1, -1).astype(np.float32)
        self.place = place / np.maximum(np.linalg.norm(place, axis=1, keepdims=True), 1e-9)
        order = np.lexsort((doc, column))
        self.doc, ends = doc[order], np.searchsorted(column[order], np.arange(len(self.here) + 1))
        self.list = [slice(a, b) for a, b in zip(ends, ends[1:])]
        self.most = np.maximum.reduceat(value[order], ends[:-1]) if len(ends) > 1 else np.zeros(0, np.int64)
        self.asked, readers = [], [[] for _ in self.here]
        for t, times in queries:
            at = np.minimum(np.searchsorted(self.here, t), max(0, len(self.here) - 1))
            ok = (self.here[at] == t) & (weights[t] > 0) if len(self.here) else np.zeros(len(t), bool)
            self.asked.append((at[ok], (times * weights[t])[ok]))
            for c in at[ok]:
                readers[c].append(len(self.asked) - 1)
        self.readers, self.blocks = readers, {}

    def blocked(self, column: int) -> Blocks:
        if column not in self.blocks:
            columns = np.unique(np.concatenate([self.asked[i][0] for i in self.readers[column]]))
            self.blocks[column] = Blocks(self.doc[self.list[column]], self.place, self.matrix, columns)
        return self.blocks[column]

    def best(self, query: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores): the k best with a score above 0, best first, ties to the smaller document."""
        columns, q = self.asked[query]
        docs, scores, limit = np.zeros(0, np.int64), np.zeros(0, np.int64), 1
        seen = np.zeros(len(self.matrix), bool)
        for column in columns[np.argsort(-q * self.most[columns], kind="stable")]:
            blocks = self.blocked(column)
            bounds = blocks.bounds(columns, q)
            todo = np.flatnonzero(bounds >= limit)
            todo = todo[np.argsort(-bounds[todo], kind="stable")]
            step = FIRST
            while len(todo):
                some = blocks.of(todo[:step])
                some = some[~seen[some]]
                seen[some] = True
                got = self.matrix[np.ix_(some, columns)].astype(np.int64) @ q
                some, got = some[got >= limit], got[got >= limit]
                if len(some):
                    docs, scores = np.concatenate((docs, some)), np.concatenate((scores, got))
                    top = np.lexsort((docs, -scores))[:k]
                    docs, scores = docs[top], scores[top]
                    if len(docs) == k:
                        limit = int(scores[-1])
                todo = todo[step:]
                todo, step = todo[bounds[todo] >= limit], step * 2
        return docs, scores


def _shard(rows: pa.Table, weights: np.ndarray, queries: list[tuple[np.ndarray, np.ndarray]], n: int, length: int, k: int) -> pa.Table:
    rows = rows.sort_by([("id", "ascending")]).combine_chunks()  # a null id comes last here and is put first
    nulls = rows.column("id").null_count
    if nulls:
        rows = pa.concat_tables([rows.slice(rows.num_rows - nulls), rows.slice(0, rows.num_rows - nulls)]).combine_chunks()
    t, times = (rows.column(c).combine_chunks() for c in ("terms", "times"))
    sizes = np.diff(t.offsets.to_numpy())
    doc, t, times = np.repeat(np.arange(len(sizes)), sizes), t.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
    m = 75 + 25 * rows.column("n").to_numpy() * n // length
    shard = Shard(len(sizes), doc, t, 1_000_000_000 * times // (1000 * times + 12 * m[doc]), weights, queries)
    found = [shard.best(i, k) for i in range(len(queries))]
    at = np.concatenate([d for d, _ in found])
    return pa.table({"query": np.repeat(np.arange(len(found)), [len(d) for d, _ in found]).astype(np.int32), "doc_id": rows.column("id").take(pa.array(at)), "score": np.concatenate([s for _, s in found])})


def _block(docs: DataFrame, asked: Asked, k: int) -> DataFrame | None:
    """(query, rank, doc_id, score) for the queries of a block, by their number; None without any term in the documents."""
    vocabulary = asked.vocabulary
    vectors = stable(docs.mapInArrow(lambda it: _vectors(it, vocabulary), VECTOR).withColumn("row", F.monotonically_increasing_id()), "vectors")
    n, length, holders = vectors.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.size("terms") > 0)).first()
    if not holders:
        return None
    size = len(vocabulary)
    df = np.zeros(size, np.int64)  # one number per term of the block's queries
    for r in vectors.select("terms").mapInArrow(lambda it: _holders(it, size), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r["term"]] = r["df"]
    weights = np.array([weight(n, int(x)) for x in df], np.int64)
    held = docs.sparkSession.sparkContext.broadcast((weights, asked.queries))  # a block of queries is bounded
    shards = math.ceil(holders / max(64, min(DOCS, CELLS // size)))
    dealt = vectors.filter(F.size("terms") > 0).withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    found = dealt.groupBy("shard").applyInArrow(lambda t: _shard(t, *held.value, n, length, k), "query int, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_first()))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def search(docs: DataFrame, queries: DataFrame, k: int = 20, *, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """query_id, rank (from 1), doc_id, score: the k best documents of every query with a score above 0, ties to the smaller id.

    A term is a run of ASCII letters, digits and characters beyond ASCII, with A to Z lower-cased. With N the documents with
    a term, L all their terms, n those of a document, df the documents holding a term and tf its occurrences in one, its
    weight is floor(1000 ln((2N + 2) / (2df + 1))), m = 75 + 25 n N div L, and a score sums, over the query's terms with
    repeats, weight * (10^9 tf div (1000 tf + 12 m)).

    Null and empty texts have no terms and are in no result; a null id of a document counts as the smallest; repeated rows
    are as many documents. Of rows that repeat a query's id (null is one) the smallest text asks. Other columns are not
    looked at; without documents or queries the result is empty. Terms are told apart by 64-bit hashes. Queries are
    worked on in blocks of bounded size, each against all documents.
    """
    spark = docs.sparkSession
    ship(spark)
    slim = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    asks = queries.select(queries[query_id].alias("id"), queries[query_text].alias("text")).groupBy("id").agg(F.min("text").alias("text")).filter("text is not null")
    asks = stable(asks, "queries")
    many, chars = asks.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    parts = max(math.ceil(many / QUERIES), math.ceil(chars / QUERY_CHARS))
    out = []
    for part in range(parts):
        rows = asks.filter(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == part).collect()  # about QUERIES rows at most
        found = _block(slim, Asked([r["text"] for r in rows]), k) if rows else None
        if found is not None:
            names = spark.createDataFrame([(i, r["id"]) for i, r in enumerate(rows)], f"query int, __id {asks.schema['id'].dataType.simpleString()}")
            out.append(found.join(F.broadcast(names), "query").select(F.col("__id").alias(query_id), F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    if not out:
        return asks.filter("false").select(F.col("id").alias(query_id), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    return functools.reduce(DataFrame.unionByName, out)
