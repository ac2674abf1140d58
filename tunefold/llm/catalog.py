"""The training-data queries op1..op13 and the SQL that says the same thing."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, ego, idfiles, langid, lexical, maxscore, minhash, mixing, oracles, pii, quality, repair, sharding, warc
from .common import read_table, shared_folder


def op1_shard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of 3 regions x 2 racks x 4, and where they would be with one shard more."""
    return sharding.assign(read_table(spark, sf_dir, "documents"), sharding.Layout.of(24), grown=sharding.Layout.of(25))


def coded(docs: DataFrame, tokenizer: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Every whole text encoded and decoded again, as digests; keep: more columns of the coded rows."""
    if tokenizer is None:
        import public_tokenizers
        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    rows = bpe.round_trip(docs, tokenizer, keep=["doc_id"])
    ids = F.concat_ws(",", F.col("token_ids").cast("array<string>"))
    return rows.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), *(keep or []))


def op2_bpe(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Token digests of all documents."""
    return coded(read_table(spark, sf_dir, "documents"), tokenizer)


def op3_grid_order_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings with cosine of at least 0.95."""
    return ego.classes(read_table(spark, sf_dir, "embeddings"), least=0.95)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, by a model that never saw a quarter of the documents."""
    docs = read_table(spark, sf_dir, "documents")
    model = langid.train(docs, allowed=~langid.held_out(docs["doc_id"]))
    out = langid.predict(docs, model, keep=["doc_id"])
    return out.select("doc_id", langid.held_out(out["doc_id"]).alias("held_out"), "lang_pred", "score")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text: counts and spans."""
    found = pii.find(read_table(spark, sf_dir, "documents"), keep=["doc_id"])
    base = F.filter("pii", lambda s: s["base"])
    return found.select("doc_id", *[pii.count(F.col("pii"), k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")],
                        F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("pii")).alias("spans"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every whole text, by a model that never saw a fifth of the labels."""
    labels = read_table(spark, sf_dir, "labels")
    docs = read_table(spark, sf_dir, "documents")
    model = quality.train(docs, labels, allowed=~quality.held_out(labels["doc_id"]))
    out = quality.score(docs, model, keep=["doc_id"])
    return out.select("doc_id", quality.held_out(out["doc_id"]).alias("held_out"), "score", "predicted")


MIX = {"domain": {"family0": 2.0, "family1": 3.0, "family2": 2.0, "family3": 1.0}, "lang": {"en": 4.0, "de": 2.0, "fr": 2.0}, "source": {}}


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is read in a mixture of as many tokens as there are, with up to four epochs of a source."""
    docs = read_table(spark, sf_dir, "documents")
    return mixing.select(docs, domain=mixing.family(docs["source"]), tokens=mixing.words(docs["text"]), weights=MIX, share=1.0, epochs=4)


def op8_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 embeddings of largest inner product for every 20th, over components in 64ths; a component is a term."""
    e = read_table(spark, sf_dir, "embeddings")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    docs = e.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite).select(
        F.col("vec_id").alias("id"), F.transform("embedding", lambda x, i: i).alias("terms"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 64)).alias("weights"))
    return maxscore.top_k(docs, docs.filter(F.col("id") % 20 == 0), 20)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as an archive with revisits and read back: responses with their payloads, revisits by their headers."""
    path = shared_folder(spark, "warc")
    warc.write(warc.deduplicated(read_table(spark, sf_dir, "pages")), path)
    back = warc.read(spark, path)
    full = back.filter(F.col("record_type") == "response").select("record_id", "record_type", "refers_to", F.length("payload").cast("long").alias("payload_bytes"), warc.base32_sha1(F.col("payload")).alias("payload_digest"))
    again = warc.read(spark, path, payload="false").filter(F.col("record_type") == "revisit").select("record_id", "record_type", "refers_to", "payload_bytes", "payload_digest")
    number = lambda c: F.expr(f"try_cast(substring_index({c}, ':', -1) AS bigint)")
    return full.unionByName(again).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near copies of every document."""
    return minhash.classes(read_table(spark, sf_dir, "documents"))


def op11_four_russians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and the repaired text of all conversations, after planted damage."""
    rows = read_table(spark, sf_dir, "conversations")
    return repair.report(repair.damaged(rows), ids=rows)


def op12_geometric_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    return lexical.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), 20)


def op13_id_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """The token ids of all documents, each closed by id 2, written as files with a shared dictionary and read back."""
    if tokenizer is None:
        import public_tokenizers
        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    path = shared_folder(spark, "ids")
    idfiles.write(read_table(spark, sf_dir, "documents"), tokenizer, path, end=2)
    return idfiles.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_shard_tree": op1_shard_tree,
    "op2_bpe": op2_bpe,
    "op3_grid_order_join": op3_grid_order_join,
    "op4_language": op4_language,
    "op5_pii": op5_pii,
    "op6_quality": op6_quality,
    "op7_mixing": op7_mixing,
    "op8_maxscore": op8_maxscore,
    "op9_warc": op9_warc,
    "op10_order_minhash": op10_order_minhash,
    "op11_four_russians": op11_four_russians,
    "op12_geometric_blocks": op12_geometric_blocks,
    "op13_id_files": op13_id_files,
}
#: Trained models (4, 6), a tokenizer (2) and sketches (10) have no SQL; tests hold them against a library, brute force and held-out rows.
ORACLES: dict[str, str] = {
    "op1_shard_tree": oracles.OP1,
    "op3_grid_order_join": oracles.OP3,
    "op5_pii": oracles.op5(),
    "op7_mixing": oracles.op7(MIX, 1.0, 4),
    "op8_maxscore": oracles.OP8,
    "op9_warc": oracles.OP9,
    "op11_four_russians": oracles.op11(),
    "op12_geometric_blocks": oracles.OP12,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
