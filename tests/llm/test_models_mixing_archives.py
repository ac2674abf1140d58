"""Classifiers on held-out rows, mixtures, archives and the pipeline; every query with SQL against DuckDB."""
import base64
import collections
import contextlib
import gzip
import hashlib
import io
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tunefold.llm import catalog, langid, linear, minhash, mixing, oracles, pii, quality, warc

TABLES = "documents embeddings pages labels".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, duck, sf, name):
    df = catalog.queries()[name](spark, sf)
    cols = sorted(df.columns)
    cur = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted(repr(tuple(r[i] for i in at)) for r in cur.fetchall())
    assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == want and want


# classifiers ------------------------------------------------------------------------------------------------------

def test_leader_learns_what_can_be_learned_and_stays_sparse():
    rng = np.random.default_rng(0)
    p = linear.Params(dims=500, alpha=0.5, l1=0.5)
    m = linear.Leader(p, 3)
    rows = []
    for _ in range(600):
        y = int(rng.integers(3))
        at = np.unique(np.concatenate((rng.integers(0, 400, 10), [400 + y])))
        rows.append((at, np.ones(len(at)), y))
    for at, v, y in rows[:500]:
        m.learn(at, v, y)
    w = m.weights(slice(None))
    assert np.mean([np.argmax(v @ w[at]) == y for at, v, y in rows[500:]]) > 0.97
    assert (w != 0).mean() < 0.6
    scores = np.log(np.array([[0.7, 0.2, 0.1]] * 10)) * 5
    assert 3 < linear.temperature(scores, np.array([0] * 7 + [1, 1, 2])) < 7


def test_language_on_held_out_documents(spark, sf):
    rows = catalog.op4_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 20 and np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95


def test_language_of_odd_texts(docs_of):
    train = docs_of(["der die das und nicht ist", "le la les et pas est", "the and of not is", None, "null language"] * 4, lang=["de", "fr", "en", "en", None] * 4)
    model = langid.train(train)
    assert model.langs == ["de", "en", "fr"]
    texts = [None, "", "123 !!", "und die", "les est " * 40_000]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs_of(texts), model).collect()}
    assert [got[i][0] for i in range(5)] == ["und", "und", "und", "de", "fr"] and got[0][1] == 0.0
    none = langid.train(train.limit(0))
    assert [r["lang_pred"] for r in langid.predict(docs_of(["text"]), none).collect()] == ["und"]
    assert langid.predict(docs_of(["x"]).limit(0), model).count() == 0


def test_quality_on_held_out_labels(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    rows = catalog.op6_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 30 and np.mean([r["predicted"] == r["quality"] for r in held]) > 0.93
    assert all((r["score"] >= 0.3) == (r["predicted"] == 1) and 0 <= r["score"] <= 1 for r in rows)


def test_quality_of_odd_texts(spark, docs_of):
    docs = docs_of(["Good words here. More of it.", "BAD!! BAD!! BAD!!", None, ""] * 5)
    labels = spark.createDataFrame([(i, (1, 0, 1, 1)[i % 4], 0) for i in range(20)] + [(0, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    rows = quality.score(docs_of([None, "", "Fine words here.", "BAD!! BAD!!", "x " * 100_000, " \n\t"]), model).collect()
    got = {r["doc_id"]: r["predicted"] for r in rows}
    assert got[2] == 1 and got[3] == 0 and len(rows) == 6 and all(isinstance(r["score"], float) for r in rows)
    nothing = quality.train(docs.limit(0), labels.limit(0))
    assert quality.score(docs, nothing).filter("score <> 0.5").count() == 0
    assert quality.score(docs.limit(0), model).count() == 0


# mixtures ---------------------------------------------------------------------------------------------------------

def filled(budget, nodes):
    """Shares by repeating: give by weight, cap, share what is left among the others."""
    share, open_ = {k: 0.0 for k in nodes}, {k for k, (c, w) in nodes.items() if w > 0}
    while open_ and budget > 1e-9:
        total = sum(nodes[k][1] for k in open_)
        short = {k for k in open_ if nodes[k][0] <= budget * nodes[k][1] / total + 1e-9}
        if not short:
            return share | {k: budget * nodes[k][1] / total for k in open_}
        for k in short:
            share[k] = nodes[k][0]
        budget -= sum(share[k] for k in short)
        open_ -= short
    return share


def test_shortages_go_to_siblings_first(spark):
    rows = [("a", "x", "1", 100), ("a", "x", "2", 1000), ("a", "y", "1", 10), ("b", "x", "1", 50), ("b", "y", "3", 5000), ("c", "x", "1", 20), ("z", "x", "1", 900)]
    weights = {"domain": {"a": 2.0, "b": 2.0, "z": 0.0}, "lang": {"x": 3.0}, "source": {"2": 0.5}}
    leaves = spark.createDataFrame(rows, "domain string, lang string, source string, tokens long").withColumn("cap", F.col("tokens").cast("double"))
    w = lambda level, name: weights[level].get(name, 1.0)
    for total in (0, 100, 700, 3000, 6000, 50_000):
        want = {}
        doms = {d: (sum(r[3] for r in rows if r[0] == d), w("domain", d)) for d in "abcz"}
        for d, bd in filled(total, doms).items():
            langs = {l: (sum(r[3] for r in rows if r[:2] == (d, l)), w("lang", l)) for l in {r[1] for r in rows if r[0] == d}}
            for l, bl in filled(bd, langs).items():
                for s, bs in filled(bl, {r[2]: (r[3], w("source", r[2])) for r in rows if r[:2] == (d, l)}).items():
                    want[d, l, s] = bs
        got = {(r["domain"], r["lang"], r["source"]): r["budget"] for r in mixing.budgets(leaves, F.lit(float(total)), weights).collect()}
        assert all(abs(got.get(k, 0) - v) <= 1 for k, v in want.items())


def test_prefixes_meet_budgets(docs_of):
    rng = random.Random(11)
    n = 400
    texts = ["w " * rng.randint(0, 60) for _ in range(n)] + [None, "", "same words"] + ["same words"] * 6
    ids = list(range(n + 2)) + [900] * 7
    docs = docs_of(texts, ids, lang=[rng.choice(["en", "de", None]) for _ in range(n + 2)] + ["en"] * 7, source=[rng.choice(["src1", "src2", "other", None]) for _ in range(n + 2)] + ["src1"] * 7)
    how = dict(domain=mixing.family(docs["source"]), tokens=mixing.words(docs["text"]), weights={"domain": {"family1": 5.0}, "lang": {"de": 2.0}, "source": {}})
    whole = mixing.select(docs, share=1.0, epochs=1, **how).agg(F.sum("n_rows"), F.sum("taken")).first()
    assert whole[1] == whole[0] or whole[0] - whole[1] < 10  # only rows without tokens at the end of a leaf may be left
    for share, epochs in ((0.3, 1), (0.9, 3)):
        got = mixing.select(docs, share=share, epochs=epochs, **how)
        total = sum(len((t or "").split()) for t in texts)
        taken = sum(r["taken"] * r["n_tokens"] for r in got.collect())
        assert abs(taken - share * total) < 61 * 12
        out = mixing.taken(docs, got)
        assert out.columns == docs.columns and out.count() == got.agg(F.sum("taken")).first()[0]
    assert mixing.select(docs.limit(0), share=1.0, epochs=1, **how).count() == 0


# archives ---------------------------------------------------------------------------------------------------------

def test_archives_round_trip(spark, tmp_path):
    htmls = ["<p>a</p>", "<p>a</p>", "", None, "é\r\n\r\nx" * 3000, "WARC/1.1\r\n\r\n", "<p>a</p>", "\0" * 10] + [f"<b>{i}</b>" * i for i in range(60)]
    rows = [(i, f"http://x/{i}\r\ny" if i == 4 else (None if i == 5 else f"http://x/{i}"), h, "z") for i, h in enumerate(htmls)] + [(None, "u", "<p>a</p>", "z"), (7, "u7", "\0" * 10, "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string").repartition(4)
    first = {}
    for i, h in enumerate(htmls):
        first.setdefault(h or "", i)
    for level in (6, 0):
        path = str(tmp_path / f"l{level}")
        warc.write(warc.deduplicated(pages), path, level=level, file_bytes=20_000)
        back = {r["record_id"]: r for r in warc.read(spark, path, partition_bytes=30_000).collect()}
        assert len(back) == len(htmls) + 1 and warc.read(spark, path).count() == len(rows)
        for i, h in enumerate(htmls):
            r, data = back[f"urn:page:{i}"], (h or "").encode()
            assert r["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode() and r["payload_bytes"] == len(data)
            if first[h or ""] == i:
                assert r["record_type"] == "response" and bytes(r["payload"]) == data and r["refers_to"] is None
            else:
                assert r["record_type"] == "revisit" and r["payload"] is None and r["refers_to"] == f"urn:page:{first[h or '']}"
        assert back["urn:page:null"]["refers_to"] == "urn:page:0"
        some = warc.read(spark, path, payload="false").filter("record_type = 'response' and target_uri like 'http://x/1%'")
        shown = io.StringIO()
        with contextlib.redirect_stdout(shown):
            some.explain("formatted")
        assert "StringStartsWith(target_uri,http://x/1)" in shown.getvalue() and "EqualTo(record_type,response)" in shown.getvalue()
        assert {r["record_id"] for r in some.collect()} == {f"urn:page:{i}" for i in range(len(htmls)) if str(i)[0] == "1" and first[htmls[i] or ""] == i}
        assert some.filter("payload is not null").count() == 0
    assert warc.deduplicated(pages.limit(0)).count() == 0


def test_archives_of_others(spark, tmp_path):
    one = warc.record({"record_type": "response", "record_id": "urn:a", "target_uri": "http://a", "payload_digest": "X", "payload": b"hello", "payload_bytes": None, "refers_to": None}, "2020-01-01T00:00:00Z")
    two = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:b>\r\nContent-Length: 70000\r\n\r\n" + b"q" * 70_000 + b"\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(two) + gzip.compress(one))
    (tmp_path / "b.warc").write_bytes(two + one)
    rows = warc.read(spark, str(tmp_path)).collect()
    assert collections.Counter((r["record_id"], bytes(r["payload"])[:5], len(r["payload"])) for r in rows) == {("urn:a", b"hello", 5): 3, ("urn:b", b"qqqqq", 70_000): 2}
    assert warc.read(spark, str(tmp_path)).filter(F.col("record_id") == "urn:a").count() == 3
    assert warc.read(spark, str(tmp_path)).filter(F.col("record_type").isin("resource", "x")).count() == 2


# the pipeline -----------------------------------------------------------------------------------------------------

def test_every_stage_on_its_own_input(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    stages = [f for _, f in corpus_pipeline.STAGES]
    columns = list(corpus_pipeline.COLUMNS)
    text = lambda d: {r["doc_id"]: r["text"] for r in d.collect()}

    more = sf.replace("sf0.001", "sf0.01")  # the smallest tables have too few labels to learn from
    good = stages[0](spark, spark.read.parquet(f"{more}/documents.parquet").withColumn("score", F.lit("x")), more)
    assert good.columns == columns
    labels = spark.read.parquet(f"{more}/labels.parquet")
    kept = {r["doc_id"] for r in good.select("doc_id").collect()}
    marks = labels.collect()
    assert np.mean([(r["doc_id"] in kept) == (r["quality"] == 1) for r in marks]) > 0.93

    once = stages[1](spark, docs, sf)
    classes = {r["doc_id"]: r["class_id"] for r in minhash.classes(docs).collect()}
    assert once.columns == columns and text(once) == {i: t for i, t in text(docs).items() if classes[i] == i}

    clean = stages[2](spark, docs, sf)
    before, after = text(docs), text(clean)
    assert clean.columns == columns and before.keys() == after.keys() and clean.filter("n_chars <> length(text)").count() == 0
    spans = {r["doc_id"]: sorted((s["start"], s["end"], s["kind"]) for s in r["pii"]) for r in pii.find(docs, keep=["doc_id"]).collect()}
    for i, t in before.items():
        merged = []
        for a, b, kind in spans[i]:
            if merged and a < merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]), merged[-1][2])
            else:
                merged.append((a, b, kind))
        for a, b, kind in reversed(merged):
            t = t[:a] + f"[{kind.upper()}]" + t[b:]
        assert after[i] == t

    mixed = stages[3](spark, docs, sf)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = {r[0] for r in con.execute("SELECT doc_id FROM (" + oracles.op7(catalog.MIX, corpus_pipeline.SHARE, 1) + ")").fetchall()}
    assert mixed.columns == columns and set(text(mixed)) == want and mixed.count() == len(want)

    coded = stages[4](spark, docs, sf)
    assert sorted(tuple(r) for r in coded.drop("token_ids").collect()) == sorted(tuple(r) for r in catalog.op2_bpe(spark, sf).collect())


def test_pipeline_runs_and_takes_empty_documents(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert 0 < out.count() < spark.read.parquet(f"{sf}/documents.parquet").count()
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_stages_take_nulls_and_extra_columns(spark, sf, docs_of):
    docs = docs_of([None, "", "word " * 3, "word " * 3, "x@y.zz and more words here"], [None, 1, 2, 2, 3], lang=[None, "en", "en", "en", None], source=[None, "src1", "src1", "src1", "src2"])
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() <= 5 and "doc_id" in out.columns
