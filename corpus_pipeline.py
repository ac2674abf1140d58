"""Corpus preparation: quality, near copies, personal data, mixture and tokens, one operator per stage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again for the next. For
every stage: all columns may be null; a null text counts as empty unless the stage says otherwise; whole texts are read,
however long; rows that repeat a doc_id are rows like others; columns beyond those of documents are neither looked at nor
returned, whatever their names; an empty table gives an empty result of the same columns.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tunefold.llm import bpe, catalog, minhash, mixing, pii, quality
from tunefold.llm.common import read_table, small_batches, stable

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Share of the tokens that the mixture keeps.
SHARE = 0.9


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from the labels of the documents at hand.

    A document stays if its score is 0.3 or more. Null and empty texts are scored like any other. Without labels every score
    is one half, so all stay. Of several labels of an id the smallest counts.
    """
    small_batches(spark)
    labels = read_table(spark, sf_dir, "labels")
    model = quality.train(docs, labels, allowed=~quality.held_out(labels["doc_id"]))
    return quality.score(docs, model, keep=list(COLUMNS)).filter("predicted = 1").select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of near copies, that of the smallest id and then digest.

    Documents without id or text all stay; empty texts are copies of each other. Ties cannot arise: equal rows are one
    document, of which one row stays. No text is lost where ids repeat.
    """
    small_batches(spark)
    return minhash.deduplicated(docs.select(*COLUMNS), by_id=False).select(*COLUMNS)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars counts the new text. A null text stays null.

    Spans that overlap are replaced as one.
    """
    found = pii.find(docs.select(*COLUMNS), keep=list(COLUMNS))
    return pii.redacted(found).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mixture to the target weights, SHARE of the tokens, each document at most once.

    A null or numberless source is a domain of its own, a null language or source a leaf of its own. Hashes order a leaf's
    documents, ids break ties; of equal rows as many stay as are chosen.
    """
    docs = docs.select(*COLUMNS)
    chosen = mixing.select(docs, domain=mixing.family(docs["source"]), tokens=mixing.words(docs["text"]), weights=catalog.MIX, share=SHARE, epochs=1)
    return mixing.taken(docs, chosen).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of ids and decoded text. A null or empty text has no ids."""
    small_batches(spark)
    return catalog.coded(docs, keep=["token_ids"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_quality),
    ("MinHash near-dedup", one_of_each),
    ("PII", without_personal_data),
    ("mixing sources to target weights", mixture),
    ("BPE encoding and decoding", tokens),
]
#: Learned weights and sketches are not expressed in SQL. Tests hold the stages against labels, plain Python and the tokenizers library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's rows written to the shared folder and read back."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stable(docs, f"stage{i}")
    return docs
