"""Language of a text: sparse multinomial logistic regression on TF-IDF of character n-grams.

Texts are lower-cased, everything but letters is one space, and runs of one to three characters are hashed. Document
frequencies come from all rows that may be learned from; the regression learns from a bounded sample of them by follow the
regularised leader with an elastic net, and a temperature fitted on spare rows makes its scores probabilities.
"""
from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import carried, ship
from .linear import Params, counted, crc_mod, fit, sampled, softmax
from .mapped import slices
from .words import mix

PARAMS = Params(alpha=0.5, l1=2e-4, sample=4000)
LONGEST = 3
NONE = "und"


@functools.cache
def letters() -> np.ndarray:
    """For each code point, whether it is a letter or a mark on one."""
    return np.fromiter((c.isalpha() or unicodedata.category(c)[0] == "M" for c in map(chr, range(0x110000))), bool, 0x110000)


def grams(texts: list[str | None], dims: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, counts) of every text's n-grams; nothing for a text without letters."""
    for t in texts:
        c = np.frombuffer(f" {(t or '').lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        ok = letters()[c]
        if not ok.any():
            yield np.zeros(0, np.int64), np.zeros(0, np.int64)
            continue
        c = np.where(ok, c, 32)
        c = c[ok | np.append(True, ok[:-1])].astype(np.uint64)
        runs, h = [], np.zeros(len(c), np.uint64)
        for n in range(LONGEST):
            h = h[: len(c) - n] * np.uint64(0x100000001B3) + c[n:] + np.uint64(1)
            runs.append(mix(h + np.uint64(n << 60)) % np.uint64(dims))
        b = np.concatenate(runs).astype(np.int64)
        yield next(counted(b, np.array([0, len(b)]), dims))


def weighed(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (1 + np.log(n)) * idf[at]
    return v / max(np.sqrt(v @ v), 1e-12)


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray
    idf: np.ndarray
    temperature: float

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        for at, n in grams(texts, len(self.idf)):
            if not len(at) or not self.langs:
                langs.append(NONE)
                scores.append(0.0)
                continue
            p = softmax(weighed(at, n, self.idf) @ self.weights[at] / self.temperature)
            k = int(p.argmax())
            langs.append(self.langs[k])
            scores.append(float(p[k]))
        return langs, scores


def _frequencies(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    df, rows = np.zeros(dims, np.int64), 0
    for part in (p for batch in batches for p in slices(batch)):
        for at, _ in grams(part.column(0).to_pylist(), dims):
            df[at] += 1
        rows += part.num_rows
    hit = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(hit, -1).astype(np.int32)), pa.array(np.append(df[hit], rows))], names=["at", "n"])


def _features(batches: Iterator[pa.RecordBatch], idf: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            made = [(at, weighed(at, n, idf)) for at, n in grams(part.column(2).to_pylist(), len(idf))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([a.astype(np.int32) for a, _ in made], pa.list_(pa.int32())), pa.array([v.astype(np.float32) for _, v in made], pa.list_(pa.float32()))],
                                             names=["order", "label", "at", "value"])


def train(df: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", allowed: Column | None = None, params: Params = PARAMS) -> Model:
    """Model from the rows with text and language that `allowed` admits. It learns from about params.sample of them
    (bounded, chosen by a hash of the id); counts cover all. Without such rows the model knows no language."""
    ship(df.sparkSession)
    rows = df.filter(df[text_col].isNotNull() & df[lang_col].isNotNull() & (F.lit(True) if allowed is None else allowed))
    rows = rows.select(df[id_col].alias("id"), df[text_col].alias("text"), df[lang_col].cast("string").alias("lang"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs, total = sorted(counts), sum(counts.values())
    df_rows = rows.select("text").mapInArrow(lambda it: _frequencies(it, params.dims), "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    seen = np.zeros(params.dims)
    for r in df_rows:
        if r["at"] >= 0:
            seen[r["at"]] = r["n"]
    idf = np.log((1 + total) / (1 + seen)) + 1
    if not langs:
        return Model([], np.zeros((params.dims, 0)), idf, 1.0)
    part = sampled(rows, total, params.sample, "id").groupBy("id", "lang").agg(F.min("text").alias("text"))
    label = F.coalesce(*[F.when(F.col("lang") == x, F.lit(i)) for i, x in enumerate(langs)])
    made = part.select(F.xxhash64("id").alias("order"), label.cast("int").alias("label"), "text").mapInArrow(lambda it: _features(it, idf), "order long, label int, at array<int>, value array<float>")
    weights, t = fit(made, params, len(langs))
    return Model(langs, weights, idf, t)


def predict(df: DataFrame, model: Model, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds lang_pred and score (0 to 1) to the columns to carry along (all, if not given); like-named ones are replaced.

    Null texts and texts without a letter are `und` with score 0. Whole texts are read; only the text is looked at.
    """
    spark = df.sparkSession
    ship(spark)
    names = carried(df.columns if keep is None else keep, ["lang_pred", "score"])
    src = df.select(*names, df[text_col].alias("__text"))
    held = spark.sparkContext.broadcast(model)  # dims x languages numbers, whatever the corpus is
    out = ", ".join([*(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in names), "lang_pred string, score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in slices(batch)):
            langs, scores = held.value.predict(part.column(len(names)).to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*names, "lang_pred", "score"])

    return src.mapInArrow(run, out)


def held_out(id_col: Column) -> Column:
    """Rows never learned from: crc32 of the id as text leaves 2 modulo 4."""
    return crc_mod(id_col, 4) == 2
