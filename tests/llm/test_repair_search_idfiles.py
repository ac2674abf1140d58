"""Conversation repair, ranked lexical search and files of ids against brute force and the tokenizers library."""
import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tunefold.llm import bpe, catalog, idfiles, lexical, repair, split

FOLLOW = {0: 2, 1: 2, 2: 3, 3: 2}
KEEP = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}


def cheapest(rows):
    """(cost, letters, states) over rows of (initial, is cut short, has to go): a search by cost, then letters."""
    queue, done = [(0, "", 0, 0, ())], set()
    while True:
        cost, letters, i, s, out = heapq.heappop(queue)
        if (i, s) in done:
            continue
        done.add((i, s))
        if i == len(rows) and s in (0, 3):
            return cost, letters, out
        heapq.heappush(queue, (cost + 5, letters + "I", i, FOLLOW[s], (*out, (FOLLOW[s], None))))
        if i < len(rows):
            initial, short, gone = rows[i]
            heapq.heappush(queue, (cost + 2, letters + "D", i + 1, s, out))
            if not gone:
                more = 5 * short
                heapq.heappush(queue, (cost + more + 1, letters + "R", i + 1, FOLLOW[s], (*out, (FOLLOW[s], i))))
                if (initial, s) in KEEP:
                    heapq.heappush(queue, (cost + more, letters + "K", i + 1, KEEP[initial, s], (*out, (0, i))))


def repaired_by_hand(rows):
    """The report of one conversation's rows (turn, role, text)."""
    fill = lambda x: " " if x is None else x
    rows = sorted(((t is not None, t or 0, fill(r), hashlib.md5(fill(x).encode()).hexdigest(), fill(x)) for t, r, x in rows))
    seen, symbols, counts = set(), [], Counter()
    for _, _, role, _, text in rows:
        end = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else ""
        seen.add((role, text))
        counts[fault] += 1
        symbols.append((role[:1], fault == "truncated", fault in ("blank", "duplicate")))
    cost, letters, out = cheapest(symbols)
    names = {2: "user", 3: "assistant"}
    lines = [f"{names.get(s, rows[i][2] if i is not None else '')}:{rows[i][4] if i is not None else ''}" for s, i in out]
    turns = [t for known, t, *_ in rows if known]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(symbols, symbols[1:]))
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def random_conversations(rng, many, longest):
    texts = ["Yes.", "No!", "cut", "", None, " \t\n", "Why? ", "so. \x0b", "\xa0", "What\n"]
    rows = []
    for c in range(many):
        for _ in range(rng.randint(1, longest)):
            rows.append((None if c == 0 else c, rng.choice([None, *range(12)]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), rng.choice(texts)))
    return rows + rng.sample(rows, len(rows) // 5)


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
CONVERSATION = "conv_id long, turn long, role string, text string, key int, at string"


def test_block_tables_equal_a_search():
    rng, t = random.Random(2), repair.tables()
    kinds = "sua?"
    for _ in range(3000):
        symbols = np.array([rng.randrange(9) for _ in range(rng.randint(0, 15))], np.int64)
        cost, letters, _ = cheapest([(kinds[c // 2] if c < 8 else "u", bool(c % 2) if c < 8 else False, c == 8) for c in symbols.tolist()])
        got, _, paid, state = t.walk(symbols)
        assert ("".join(got) + repair.TAIL[state], sum(paid) + 5 * len(repair.TAIL[state])) == (letters, cost)
        cut = rng.randint(0, len(symbols))
        behind, leave = t.function(symbols[:cut]), t.function(symbols[cut:])
        v = leave[0][0]
        one, two = t.walk(symbols[:cut], int(v), 0), t.walk(symbols[cut:], 0, int(behind[1][v, 0]))
        assert one[3] == behind[1][v, 0] and "".join(one[0] + two[0]) == "".join(got)


@pytest.mark.parametrize("bits", [1, 3, repair.CHUNK_BITS])
def test_repair_equals_brute_force(spark, bits):
    rows = random_conversations(random.Random(bits), 25, 40)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], CONVERSATION).repartition(5)
    want = {}
    for c, *r in rows:
        want.setdefault(c, []).append(r)
    got = repair.report(df, chunk_bits=bits).collect()
    assert {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in got} == {c: repaired_by_hand(r) for c, r in want.items()} and len(got) == len(want)
    turns = repair.repaired(df, chunk_bits=bits).orderBy("conv_id", "at", "place").collect()
    lines = {}
    for r in turns:
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    assert {c: hashlib.sha256("\n".join(lines.get(c, [])).encode()).hexdigest() for c in want} == {r["conv_id"]: r["repaired_sha256"] for r in got}


def test_one_conversation_of_many_rows_is_cut_into_chunks(spark):
    rng = random.Random(9)
    rows = [(7, t, rng.choice(["user", "assistant", "user", "system"]), rng.choice(["Yes.", "cut", f"Number {t}."])) for t in range(4000)] + [(7, 5, "user", "Again.")] * 500
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], CONVERSATION)
    got = repair.report(df, chunk_bits=8).collect()
    assert [tuple(r[c] for c in COLUMNS) for r in got] == [repaired_by_hand([r[1:] for r in rows])]


def test_conversations_that_vanish_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi.", 1, "x"), (2, None, None, None, 1, "x")], CONVERSATION)
    out = {r["conv_id"]: r for r in repair.report(df.filter("conv_id = 2"), ids=df).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    assert tuple(out[1][c] for c in COLUMNS) == (0, 0, 0, 0, 0, 0, "", nothing)
    assert tuple(out[2][c] for c in COLUMNS) == (0, 1, 0, 0, 0, 2, "D", nothing)
    assert repair.report(df.limit(0)).count() == 0 and repair.repaired(df.limit(0)).count() == 0


def test_damage_goes_by_the_crc_of_id_and_turn(spark):
    rows = [(c, t, "system", "One. Two! Three?", 1, "x") for c in (1, None) for t in [*range(60), None]]
    got = Counter(tuple(r) for r in repair.damaged(spark.createDataFrame(rows, CONVERSATION)).select("conv_id", "turn", "role", "text").collect())
    want = Counter()
    for c, t, role, text, *_ in rows:
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if fault:
            want[c, t, "user" if fault == 4 else role, "" if fault == 1 else "One Two Three" if fault == 2 else text] += 2 if fault == 3 else 1
    assert got == want


# ranked search ----------------------------------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(low)


def ranked_by_hand(docs, items, k):
    bags = [(i, Counter(words_of(t))) for i, t in docs]
    n, length = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    out = {}
    for item, text in items:
        scores = []
        for i, bag in bags:
            m = 100 - 25 + 25 * sum(bag.values()) * n // max(1, length)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * bag[w] // (1000 * bag[w] + 12 * m)) for w in words_of(text) if bag[w])
            scores += [(-s, i is not None, i or 0, i)] if s else []
        for rank, (s, _, _, i) in enumerate(sorted(scores)[:k], 1):
            out[item, rank] = (i, -s)
    return out


def invented(rng, many, size):
    common, rare = [f"w{i}" for i in range(12)], [f"Ünique{i}" for i in range(size)]
    return [" ".join(rng.choice(common if rng.random() < 0.6 else rare) for _ in range(rng.randint(1, 60))) for _ in range(many)]


DOCS = "doc_id long, text string, row string, n int, terms string, shard int"


@pytest.mark.parametrize("docs_per_shard, queries", [(2048, 1024), (64, 3)])
def test_ranked_search_equals_brute_force(spark, monkeypatch, docs_per_shard, queries):
    monkeypatch.setattr(lexical, "DOCS", docs_per_shard)
    monkeypatch.setattr(lexical, "QUERIES", queries)
    rng = random.Random(4)
    texts = invented(rng, 400, 60)
    docs = list(enumerate(texts)) + [(500 + i, texts[0]) for i in range(60)] + [(3, texts[0]), (3, texts[3]), (None, texts[5]), (900, None), (901, ""), (902, "!?.. --"), (903, "ONE one İ_one²"), (904, "w1 " * 5000 + "Ünique3")]
    items = [(i, t) for i, t in enumerate(invented(rng, 12, 60))] + [(20, texts[0]), (None, "Ünique1 ünique1 w2"), (21, None), (22, ""), (23, "nowhere"), (24, "w1 " * 50)]
    got = lexical.search(spark.createDataFrame([(i, t, "r", 1, "t", 2) for i, t in docs], DOCS).repartition(4), spark.createDataFrame(items, "item_id long, text string"), 7)
    assert {(r["item_id"], r["rank"]): (r["doc_id"], r["score"]) for r in got.collect()} == ranked_by_hand(docs, items, 7)
    assert got.count() == len(ranked_by_hand(docs, items, 7))


def test_rows_that_repeat_a_query_and_empty_inputs(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma"), (3, "delta")], "doc_id long, text string")
    asks = spark.createDataFrame([("q", "gamma"), ("q", "alpha"), ("q", None)], "item_id string, text string")
    assert [tuple(r)[:3] for r in lexical.search(docs, asks, 5).collect()] == [("q", 1, 1)]
    for d, q in ((docs.limit(0), asks), (docs, asks.limit(0)), (docs.filter("doc_id = 3"), asks)):
        assert lexical.search(d, q, 5).collect() == [] and lexical.search(d, q, 5).columns == ["item_id", "rank", "doc_id", "score"]


def test_blocks_bound_their_documents_and_are_skipped():
    rng = np.random.default_rng(3)
    n, width = 600, 40
    group = rng.integers(0, 6, n)
    own = np.arange(width) % 6 == group[:, None]
    matrix = np.where(rng.random((n, width)) < np.where(own, 0.7, 0.3), rng.integers(1, np.where(own, 1000, 100)), 0)
    doc, term = np.nonzero(matrix)
    queries = [(np.unique(np.append(np.arange(i % 6, width, 6), rng.choice(width, 3))), None) for i in range(10)]
    queries = [(t, np.ones(len(t), np.int64)) for t, _ in queries]
    weights = rng.integers(1, 50, width)
    shard = lexical.Shard(n, doc, term, matrix[doc, term], weights, queries)
    scored = 0
    for i, (t, times) in enumerate(queries):
        scores = matrix[:, t] @ (times * weights[t])
        columns, q = shard.asked[i]
        for c in columns:
            b = shard.blocked(c)
            assert sorted(b.docs) == sorted(doc[term == shard.here[c]])
            for bound, a, e in zip(b.bounds(columns, q), b.start, b.start[1:]):
                assert bound >= scores[b.docs[a:e]].max()
        of = lexical.Blocks.of
        def counting(self, blocks):
            nonlocal scored
            out = of(self, blocks)
            scored += len(out)
            return out
        lexical.Blocks.of = counting
        try:
            docs, got = shard.best(i, 5)
        finally:
            lexical.Blocks.of = of
        want = sorted((-s, d) for d, s in enumerate(scores) if s > 0)[:5]
        assert [(-s, d) for d, s in zip(docs, got)] == want
    assert scored < sum(len(shard.doc[shard.list[c]]) for cs, _ in shard.asked for c in cs) / 2


# files of ids -----------------------------------------------------------------------------------------------------

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_words_are_split_as_the_library_does(library):
    rng = random.Random(5)
    odd = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'", "''", "'S", "'r", "'lls", " ", "  ", "\n", "\t ", "\x1c", "\x85", "\xa0", "\u3000", "\u1c89", "\ua7cb", "\u0558", "\U00012550", "a", "ab", "12", "²", "!", "?!", "é", "日本", "🙂", " word", "<|endoftext|>"]
    texts = ["".join(rng.choice(odd) for _ in range(rng.randint(0, 25))) for _ in range(4000)] + ["", "x" * 500, " word" * 200_000, "9" * 300, "né" * 70]
    c = bpe.Coder(open(PATH, "rb").read())
    for some in (texts, texts[::-1]):
        ids, counts = c.encoded(some)
        ends = np.cumsum(counts)
        for text, a, b in zip(some, ends - counts, ends):
            assert ids[a:b].tolist() == library(text)
        assert c.decoded(ids, counts) == some
    for text in texts[:300] + ["w ord " * 300]:
        parts = split.pieces(text, 16)
        assert "".join(parts) == text and [i for p in parts for i in library(p)] == library(text)


def test_a_full_table_of_words_still_answers(monkeypatch):
    monkeypatch.setattr(split, "CACHED", 5)
    asked = []

    def make(words):
        asked.extend(words)
        sizes = np.array([len(w) for w in words])
        return np.frombuffer("".join(words).encode("utf-32-le"), np.int32), np.cumsum(sizes) - sizes, sizes

    table = split.Table(make)
    for text in ("ab cd ab", "ab ef gh ij", "x" * 99 + " f g ab", "ab g b h", "x" * 99, "", "ab"):
        ids, counts = split.encoded([text, text], table)
        assert "".join(map(chr, ids)) == text * 2 and list(counts) == [len(text)] * 2
    assert asked.count("ab") < 4 and asked.count("x" * 99) == 2 and len(table.keys) <= 9


def test_files_of_ids_come_back_in_order(spark, docs_of, library, tmp_path):
    texts = ["one two", None, "", "<|endoftext|> x", "été 日本語 🙂", "long " * 3000, "same", "same", "z" * 5000]
    ids = [9, 4, None, 2, 2, 30, 7, 7, 1]
    path = f"file://{tmp_path}/ids"
    idfiles.write(docs_of(texts, ids), PATH, path, end=2, file_bytes="200")
    back = idfiles.read(spark, path).collect()
    rows = sorted(back, key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, 1, 2, 2, 4, 7, 7, 9, 30]
    at = 0
    for r in rows:
        assert r["start"] == at and r["n_tokens"] * 4 == len(r["ids"])
        at += r["n_tokens"]
    want = Counter((i, np.array([*library(t), 2], "<u4").tobytes()) for i, t in zip(ids, texts))
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in rows) == want
    assert len(list((tmp_path / "ids").glob("*.ids"))) > 3
    one = idfiles.read(spark, path).filter("doc_id = 30")
    assert [(r["start"], r["n_tokens"]) for r in one.collect()] == [(r["start"], r["n_tokens"]) for r in rows if r["doc_id"] == 30]
    assert sorted(r["doc_id"] for r in idfiles.read(spark, path).filter("doc_id in (2, 9, 77)").collect()) == [2, 2, 9]
    slim = idfiles.read(spark, path, ids="false").collect()
    assert Counter((r["doc_id"], r["start"], r["n_tokens"]) for r in slim) == Counter((r["doc_id"], r["start"], r["n_tokens"]) for r in rows) and all(r["ids"] is None for r in slim)


def test_files_of_ids_of_many_documents_share_a_dictionary(spark, sf, library, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r for r in catalog.op13_id_files(spark, sf).collect()}
    at = 0
    for d in docs.orderBy("doc_id").collect():
        ids = np.array([*library(d["text"]), 2], "<u4")
        assert tuple(got[d["doc_id"]]) == (d["doc_id"], at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    path = f"file://{tmp_path}/many"
    idfiles.write(docs, PATH, path)
    size = sum(f.stat().st_size for f in (tmp_path / "many").glob("*.ids"))
    assert size < 2 * at
    dictionary, = (tmp_path / "many").glob("dictionary-*")
    assert 0 < dictionary.stat().st_size <= idfiles.DICTIONARY
    dictionary.write_bytes(b"other")
    with pytest.raises(Exception, match="another dictionary"):
        idfiles.read(spark, path).count()


def test_no_documents_make_no_files(spark, docs_of, tmp_path):
    empty = docs_of(["a"]).limit(0)
    idfiles.write(empty, PATH, f"file://{tmp_path}/none", end=2)
    assert idfiles.read(spark, f"file://{tmp_path}/none").count() == 0
