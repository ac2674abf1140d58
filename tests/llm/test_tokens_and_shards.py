"""Sharding, byte-level BPE and personal data against plain Python and the tokenizers library."""
import hashlib
import random
import re
import zlib

import public_tokenizers
import duckdb
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tunefold.llm import bpe, catalog, pii, sharding

PATH = public_tokenizers.path("byte_bpe_50k.json")


# sharding ---------------------------------------------------------------------------------------------------------

def test_slots_have_no_gaps_and_sizes_are_bytes(docs_of):
    texts = [None, "", "é€", "x" * 50_000] + ["same"] * 30 + [f"t{i}" for i in range(200)]
    ids = [None, 1, 2, 3] + [5] * 30 + list(range(10, 210))
    rows = sharding.assign(docs_of(texts, ids), sharding.Layout.of(24), grown=sharding.Layout.of(25)).collect()
    assert len(rows) == len(texts)
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 24) and r["law"] == "key"
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    want = sorted((t and len(t.encode()) or 0) + 8 for t in texts)
    assert sorted(r["size"] for r in rows) == want
    assert sorted(r["text_crc32"] for r in rows) == sorted(zlib.crc32((t or "").encode()) for t in texts)
    assert len({r["shard"] for r in rows if r["doc_id"] == 5}) == 1


def test_growth_and_weights_move_rows_only_into_what_grew(spark):
    ids = spark.range(20_000)
    for n in (24, 25, 30, 31):
        got = ids.select(sharding.shard_of(F.col("id"), sharding.Layout.of(n)).alias("a"), sharding.shard_of(F.col("id"), sharding.Layout.of(n + 1)).alias("b")).filter("a <> b")
        assert {r["b"] for r in got.select("b").distinct().collect()} == {n}
        assert abs(got.count() - 20_000 / (n + 1)) < 6 * (20_000 / (n + 1)) ** 0.5
    more = sharding.Layout((*sharding.Layout.of(24).shards, (1, 5, 2.0)))  # shard 5 is made three times as heavy
    moved = ids.select(sharding.shard_of(F.col("id"), sharding.Layout.of(24)).alias("a"), sharding.shard_of(F.col("id"), more).alias("b"))
    assert {r["b"] for r in moved.filter("a <> b").select("b").distinct().collect()} == {5}
    share = moved.filter("b = 5").count() / 20_000
    assert abs(share - 3 / 26) < 0.01


def test_shards_of_nothing(docs_of):
    assert sharding.assign(docs_of(["x"]).limit(0), sharding.Layout.of(24)).count() == 0
    with pytest.raises(ValueError):
        sharding.Layout.of(0)


# byte-level BPE ---------------------------------------------------------------------------------------------------

PIECES = ["a", "th", "e ", " ", "\n", "\t", "  ", "'s", "'ll", "é", "ü", "ß", "1", "22", "!!", "<|endoftext|>", "<|end", "日本", " ", "\x85", "\x1c", "👍", "\r\n", "ing", "tion", "\0", "​", "﻿", "́"]


def test_ids_and_texts_equal_the_library(docs_of):
    rng = random.Random(5)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += [None, "", "ab" * 3000, "é" * 1500, " " * 4000 + "x", "the" * 2000, "word " * 20_000] + ["again"] * 5
    t = Tokenizer.from_file(PATH)
    rows = {r["doc_id"]: r for r in bpe.decode(bpe.encode(docs_of(texts), PATH), PATH).collect()}
    for i, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert rows[i]["token_ids"] == ids
        assert rows[i]["decoded"] == t.decode(ids, skip_special_tokens=False) == (text or "")
        assert rows[i]["score"] == "x" and rows[i]["id"] == 7


def test_decoding_any_ids(spark):
    rng = random.Random(6)
    t = Tokenizer.from_file(PATH)
    lists = [[rng.randrange(50257) for _ in range(rng.randint(0, 20))] for _ in range(300)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)] + [(-1, None), (-2, [60_000, 64])], "doc_id long, token_ids array<int>")
    rows = {r["doc_id"]: r["decoded"] for r in bpe.decode(df, PATH).collect()}
    assert all(rows[i] == t.decode(x, skip_special_tokens=False) for i, x in enumerate(lists))
    assert rows[-1] == "" and rows[-2] == t.decode([64])


def test_bpe_query_digests(spark, sf):
    t = Tokenizer.from_file(PATH)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = catalog.op2_bpe(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = t.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_no_documents_no_tokens(docs_of):
    assert bpe.decode(bpe.encode(docs_of(["x"]).limit(0), PATH), PATH).count() == 0


# personal data ----------------------------------------------------------------------------------------------------

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    odd, even = digits[::-1][::2], digits[::-1][1::2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def confirmed(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {"email": True, "ip": all(int(p) <= 255 for p in match.split(".")) if kind == "ip" else True, "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def base_spans(text):
    found = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if confirmed(k, m.group())]
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(found))


BITS = ["a", "b.c", "@", "x@y.zz", ".", "-", " ", "+", "1", "22", "4444 3333 2222 1111", "4111-1111-1111-1111", "10.0.0.1", "300.1.1.1", "001.002.003.0255", "+1 (555) 123-4567", "+", "(", "é", "👍", "_", "%", "\n", "DE89370400440532013000", "078-05-1120 ssn "]


def test_base_spans_equal_the_patterns(docs_of):
    rng = random.Random(7)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    texts += [None, "", "a" * 100_000, "9" * 50_000, "+1" + " (" * 20_000, "1 " * 30_000, "a@b.c_d@e.f", "x@y.z " * 1500, "1." * 20_000 + "1"]
    rows = pii.find(docs_of(texts)).select("doc_id", pii.joined(F.filter("pii", lambda s: s["base"])).alias("s")).collect()
    assert {r["doc_id"]: r["s"] for r in rows} == {i: base_spans(t) for i, t in enumerate(texts)}


def test_further_kinds_need_their_checks(docs_of):
    texts = ["DE89370400440532013000", "iban DE89 3704 0044 0532 0130 00 ok", "DE89370400440532013001", "xDE89370400440532013000", "my ssn is 078-05-1120", "078-05-1120", "ssn 000-05-1120", "order 078-05-1120 social"]
    rows = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["pii"] if not s["base"]] for r in pii.find(docs_of(texts), keep=["doc_id"]).collect()}
    assert rows == {0: [("iban", 0, 22)], 1: [("iban", 5, 32)], 2: [], 3: [], 4: [("ssn", 10, 21)], 5: [], 6: [], 7: []}


def test_account_codes_before_capitals_and_digits(docs_of):
    code = "DE89370400440532013000"
    texts = [code + " BIC COBADEFFXXX", code + " Bank", "DE89 3704 0044 0532 0130 00 12345", code + " FR1420041010050500013M02606"]
    rows = {r["doc_id"]: [(s["start"], s["end"]) for s in r["pii"] if s["kind"] == "iban"] for r in pii.find(docs_of(texts), keep=["doc_id"]).collect()}
    assert rows == {0: [(0, 22)], 1: [(0, 22)], 2: [(0, 27)], 3: [(0, 22), (23, 50)]}


def test_redaction(docs_of):
    long = "é" * 5000 + " x@y.zz " + "b" * 9000 + " 10.0.0.1 end"
    texts = [None, "", "plain", "x@y.zz", "a x@y.zz, 4111 1111 1111 1111.", long, "+1 (555) 123-4567, 10.0.0.1"]
    rows = {r["doc_id"]: r["text"] for r in pii.redacted(pii.find(docs_of(texts))).collect()}
    assert rows[0] is None and rows[1] == "" and rows[2] == "plain" and rows[3] == "[EMAIL]" and rows[4] == "a [EMAIL], [CARD]."
    assert rows[5] == "é" * 5000 + " [EMAIL] " + "b" * 9000 + " [IP] end"
    assert "555" not in rows[6] and "10.0.0.1" not in rows[6] and rows[6].startswith("[PHONE]")


def test_personal_data_stays_in_the_engine(spark, sf, docs_of):
    plan = catalog.op5_pii(spark, sf)._jdf.queryExecution().executedPlan().toString() + catalog.op7_mixing(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert pii.find(docs_of(["x"]).limit(0)).count() == 0


def test_account_codes_are_the_same_in_sql(spark, tmp_path):
    code = "DE89370400440532013000"
    texts = [code, f"iban {code} BIC COBADEFF", f"{code} Bank", f"{code} und 12 mehr", f"{code}1 no", f"x{code}", f"{code}-7", f"{code}{code}", f"{code} {code} {code}", f"AA00 {code}", "GB82 WEST 1234 5698 7654 32",
             "GB82 WEST 1234 5698 7654 32 IBAN XX12 3456", "invoice NO9386011117947", "NO9386011117947 order", "QQ12 3456 7890 1234 5678", "DE89 " * 40, None, "", f"konto:{code},{code};{code}", "FR14 2004 1010 0505 0001 3M02 606 and FR1420041010050500013M02606"]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["spans"], r["base_sha256"]) for r in catalog.op5_pii(spark, str(tmp_path)).collect()}
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cur = c.execute(catalog.oracle_sql()["op5_pii"])
    names = [d[0] for d in cur.description]
    want = {r[names.index("doc_id")]: (r[names.index("spans")], r[names.index("base_sha256")]) for r in cur.fetchall()}
    assert got == want and sum("iban" in s for s, _ in got.values()) >= 10


def test_one_pass_gives_what_two_give(docs_of):
    docs = docs_of(["one two", None, "", "été 日本語", "<|endoftext|> x", "w " * 3000])
    one = {r["doc_id"]: (r["token_ids"], r["decoded"]) for r in bpe.round_trip(docs, PATH).collect()}
    two = {r["doc_id"]: (r["token_ids"], r["decoded"]) for r in bpe.decode(bpe.encode(docs, PATH), PATH).collect()}
    assert one == two and bpe.round_trip(docs.limit(0), PATH).columns == bpe.decode(bpe.encode(docs, PATH), PATH).columns
