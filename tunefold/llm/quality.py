"""Quality of a text: logistic regression on hashed word n-grams, learned by follow the regularised leader.

A word is what stands between white space. It counts as itself, and as its form: case, digits, what it ends with, and
whether it repeats the word before it. Single words and pairs of words, and runs of one to three forms, are hashed; a score
is the sparse dot product of their damped counts with the weights.
"""
from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import carried, ship
from .linear import Params, counted, crc_mod, fit, sampled, softmax
from .mapped import slices
from .words import mix, tokens

PARAMS = Params(dims=1 << 17, alpha=0.3, l1=1e-4, sample=6000)
LEAST = 0.3


@functools.cache
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: not white space; and kind: 0 other, 1 lower case, 2 upper case, 3 other letter, 4 digit."""
    dark = np.ones(0x110000, bool)
    kind = np.zeros(0x110000, np.int8)
    for i, c in enumerate(map(chr, range(0x110000))):
        if c.isspace():
            dark[i] = False
        elif c.isalpha():
            kind[i] = 1 if c.islower() else 2 if c.isupper() else 3
        elif c.isdigit():
            kind[i] = 4
    return dark, kind


def _forms(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(hash, form) of every word of a text."""
    dark, kind = _classes()
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    edge = np.diff(np.concatenate(([0], dark[c].astype(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    k = kind[c]
    many = [np.add.reduceat(np.append(k == x, False).astype(np.int32), start) for x in (1, 2, 4)]
    last, before = c[end - 1], c[np.maximum(end - 2, start)]
    closing = np.where(k[end - 1] == 0, last, 0).astype(np.uint64)
    twice = (k[end - 1] == 0) & (last == before) & (end - start > 1)
    form = (np.minimum(many[0], 2) * 3 + np.minimum(many[1], 2)) * 2 + (many[2] > 0)
    word = tokens([text], lower=False, table=dark)[0]
    word = word if len(word) == len(start) else mix(start.astype(np.uint64))
    again = np.concatenate(([False], word[1:] == word[:-1]))
    form = ((form.astype(np.uint64) * np.uint64(2) + (k[start] == 2)) * np.uint64(2) + twice) * np.uint64(2) + again
    return word, mix(form * np.uint64(1 << 21) + closing)


def grams(texts: list[str | None], dims: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, damped counts of length 1) of every text; a text always has the constant bucket 0."""
    for t in texts:
        word, form = _forms(t or "")
        runs = [word, mix(word[:-1] * np.uint64(3) + word[1:]), mix(form + np.uint64(7)), mix(form[:-1] * np.uint64(5) + form[1:]), mix(form[:-2] * np.uint64(25) + form[1:-1] * np.uint64(5) + form[2:])]
        b = (np.concatenate(runs) % np.uint64(dims - 1)).astype(np.int64) + 1
        at, n = next(counted(b, np.array([0, len(b)]), dims))
        v = 1 + np.log(n)
        v /= max(np.sqrt(v @ v), 1e-12)
        yield np.append(at, 0), np.append(v, 0.2)


@dataclass
class Model:
    weights: np.ndarray
    temperature: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probability of label 1; one half if nothing was learned."""
        x = [v @ self.weights[at] for at, v in grams(texts, len(self.weights))]
        return softmax(np.array(x).reshape(-1, 2) / self.temperature)[:, 1]


def _features(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            made = list(grams(part.column(2).to_pylist(), dims))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([a.astype(np.int32) for a, _ in made], pa.list_(pa.int32())), pa.array([v.astype(np.float32) for _, v in made], pa.list_(pa.float32()))],
                                             names=["order", "label", "at", "value"])


def train(df: DataFrame, labels: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", allowed: Column | None = None, params: Params = PARAMS) -> Model:
    """Model from the documents with a label 0 or 1, which `allowed` (on the labels' rows) admits: about params.sample of
    them, a bounded number chosen by a hash of the id. Null texts count as empty. Of several labels of an id the smallest counts."""
    ship(df.sparkSession)
    marked = labels.filter(labels[label_col].isin(0, 1) & labels[id_col].isNotNull() & (F.lit(True) if allowed is None else allowed))
    marked = marked.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("label")).groupBy("id").agg(F.min("label").alias("label"))
    chosen = sampled(marked, marked.count(), params.sample, "id")
    docs = df.select(df[id_col].alias("id"), F.coalesce(df[text_col], F.lit("")).alias("text"))
    rows = docs.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text"))  # at most about params.sample short rows
    made = rows.select(F.xxhash64("id").alias("order"), "label", "text").mapInArrow(lambda it: _features(it, params.dims), "order long, label int, at array<int>, value array<float>")
    return Model(*fit(made, params, 2))


def score(df: DataFrame, model: Model, *, text_col: str = "text", keep: list[str] | None = None, least: float = LEAST) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 if score >= least) to the columns to carry along (all, if not given).

    Whole texts are read, a null one as empty; nothing but the text is looked at. Like-named columns are replaced.
    """
    spark = df.sparkSession
    ship(spark)
    names = carried(df.columns if keep is None else keep, ["score", "predicted"])
    src = df.select(*names, df[text_col].alias("__text"))
    held = spark.sparkContext.broadcast(model)  # 2 x dims numbers, whatever the corpus is
    out = ", ".join([*(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in names), "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(held.value.score(part.column(len(names)).to_pylist()), pa.float64())], names=[*names, "score"])

    return src.mapInArrow(run, out).withColumn("predicted", (F.col("score") >= least).cast("int"))


def held_out(id_col: Column) -> Column:
    """Labels never learned from: crc32 of the id as text leaves 0 modulo 5."""
    return crc_mod(id_col, 5) == 0
