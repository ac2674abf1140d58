"""Near copies, vector joins and top-k search against brute force."""
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from tunefold.llm import ego, maxscore, minhash, words
from tunefold.llm.graph import components


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def classes_of(n, links):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return [top(x) for x in range(n)]


# words and alignment ----------------------------------------------------------------------------------------------

def test_banded_edits_equal_the_full_table():
    rng = random.Random(1)
    for _ in range(4000):
        a = [rng.randrange(4) for _ in range(rng.randint(0, 25))]
        b = list(a)
        for _ in range(rng.randint(0, 8)):
            k = rng.randint(0, len(b))
            if rng.random() < 0.5:
                b.insert(k, rng.randrange(4))
            elif b:
                del b[k % len(b)]
        most, want = rng.randint(0, 12), levenshtein(a, b)
        got = minhash.edits(np.array(a, np.uint64), np.array(b, np.uint64), most)
        assert got == want if want <= most else got > most


def test_hashes_of_words_do_not_hang_on_the_batch():
    texts = ["The quick, brown FOX", None, "", "...", "naïve été 日本語 x1", "a " * 700_000, "z" * 1_500_000 + " end"]
    together, offsets = words.tokens(texts)
    for i, t in enumerate(texts):
        alone = words.tokens([t])[0]
        assert (together[offsets[i]:offsets[i + 1]] == alone).all()
    assert list(np.diff(offsets)) [:6] == [4, 0, 0, 0, 4, 700_000]
    assert (words.tokens(["the quick brown fox"])[0] == together[:4]).all()


def test_sketches_see_order_and_repetition():
    rng = random.Random(2)
    w = [f"w{i}" for i in range(80)]
    a, b = " ".join(w), " ".join(w[40:] + w[:40])
    s, _ = minhash.sketches([a, a + " ", b, " ".join(rng.sample(w, 80)), "one two", ""])
    assert (s[0] == s[1]).all() and 0 < (s[0] == s[2]).sum() < 32 and not (s[0] == s[3]).any()


# near copies ------------------------------------------------------------------------------------------------------

def noisy(rng, base, n):
    w = base.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"q{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    fresh = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    passage = fresh(60)
    texts = [fresh(rng.randint(30, 200)) for _ in range(60)]
    texts += [noisy(rng, t, rng.randint(1, max(1, len(t.split()) // 40))) for t in texts[:25]]
    texts += [texts[0].upper() + "!", texts[1], texts[1], texts[1]]
    texts += [fresh(50) + " " + passage + " " + fresh(50) for _ in range(20)]
    hot = fresh(120)
    texts += [noisy(rng, hot, 3) for _ in range(40)] + ["", "", "!!!", "!!!", "???", None, None, "one", "one", "One"]
    return texts


def expected(texts):
    h, o = words.tokens(texts)
    w = [h[o[i]:o[i + 1]].tolist() for i in range(len(texts))]
    links = []
    for i in range(len(texts)):
        for j in range(i):
            if texts[i] is None or texts[j] is None:
                continue
            long = max(len(w[i]), len(w[j]))
            if texts[i] == texts[j] or (long and abs(len(w[i]) - len(w[j])) <= 0.2 * long and levenshtein(w[i], w[j]) <= 0.2 * long):
                links.append((j, i))
    return classes_of(len(texts), links)


def test_classes_equal_brute_force(docs_of, corpus):
    got = {r["doc_id"]: (r["class_id"], r["kept"]) for r in minhash.classes(docs_of(corpus)).collect()}
    want = expected(corpus)
    assert got == {i: (c, c == i) for i, c in enumerate(want)}
    left = sorted(r["doc_id"] for r in minhash.deduplicated(docs_of(corpus)).collect())
    assert left == sorted(set(want))


def edited(rng, words_, share):
    """A share of the words replaced, dropped or doubled, at scattered places."""
    out = []
    at = set(rng.sample(range(len(words_)), round(share * len(words_))))
    for i, w in enumerate(words_):
        kind = rng.randrange(4) if i in at else -1
        out += [w] if kind < 0 else [] if kind == 0 else [w, f"q{rng.randrange(10**6)}"] if kind == 1 else [f"q{rng.randrange(10**6)}"]
    return out


def test_pairs_just_above_the_similarity_meet():
    rng = random.Random(11)
    one, two = [], []
    while len(one) < 400:
        a = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 200))]
        b = edited(rng, a, rng.uniform(0.1, 0.2))
        if 0.8 <= 1 - levenshtein(a, b) / max(len(a), len(b)) <= 0.9:
            one.append(" ".join(a))
            two.append(" ".join(b))
    s, t = minhash.sketches(one)[0], minhash.sketches(two)[0]
    assert (s == t).any(axis=1).mean() >= 0.99


@pytest.mark.parametrize("group", [minhash.GROUP, 8])
def test_a_bucket_of_many_small_classes(docs_of, monkeypatch, group):
    monkeypatch.setattr(minhash, "GROUP", group)
    rng = random.Random(12)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for _ in range(120):
        own = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        texts += [" ".join(passage + own), " ".join(passage + edited(rng, own, 0.2))]
    rng.shuffle(texts)
    how = {"picked": 1, "functions": 2}
    s = minhash.sketches(texts, **how)[0]
    h, o = words.tokens(texts)
    w = [h[o[i]:o[i + 1]] for i in range(len(texts))]
    links = [(j, i) for i in range(len(texts)) for j in range(i) if (s[i] == s[j]).any() and minhash.similar(w[i], w[j])]
    assert max(np.unique(s[:, 0], return_counts=True)[1]) > 60 and len(links) > 60
    got = {r["doc_id"]: r["class_id"] for r in minhash.classes(docs_of(texts), **how).collect()}
    assert got == dict(enumerate(classes_of(len(texts), links)))


def test_a_bucket_of_one_class_by_any_order_of_words(docs_of, monkeypatch):
    rng = random.Random(13)
    texts = [" ".join(["p q r s t"] * 12 + [f"w{rng.randrange(10**6)}"] * 3) for _ in range(50)]
    monkeypatch.setattr(minhash, "CELLS", 8)
    monkeypatch.setattr(minhash, "GROUP", 2)
    how = {"picked": 1, "functions": 1, "rounds": 0}
    s = minhash.sketches(texts, picked=1, functions=1)[0][:, 0]
    links = [(j, i) for i in range(50) for j in range(i) if s[i] == s[j]]
    got = {r["doc_id"]: r["class_id"] for r in minhash.classes(docs_of(texts), **how).collect()}
    assert len(links) > 100 and got == dict(enumerate(classes_of(50, links)))


def test_rare_words_find_every_similar_pair():
    rng = random.Random(15)
    seen = np.zeros(minhash.CELLS, np.int64)
    texts = []
    for _ in range(300):
        a = [f"w{rng.randrange(400)}" for _ in range(rng.randint(1, 80))]
        texts += [" ".join(a), " ".join(edited(rng, a, rng.uniform(0, 0.2)))]
    label, ends = minhash._labels(texts)
    np.add.at(seen, (label % np.uint64(minhash.CELLS)).astype(np.int64), 1)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])
    rare = [set(r) for b in minhash._rare(iter([batch]), seen, 0.8) for r in b.column(1).to_pylist()]
    h, o = words.tokens(texts)
    found = 0
    for i in range(0, len(texts), 2):
        if minhash.similar(h[o[i]:o[i + 1]], h[o[i + 1]:o[i + 2]], 0.8):
            assert rare[i] & rare[i + 1]
            found += 1
    assert found > 200 and sum(map(len, rare)) < 0.4 * len(h)


@pytest.mark.parametrize("group", [minhash.GROUP, 100])
def test_a_template_shared_by_many_other_texts(docs_of, monkeypatch, group):
    monkeypatch.setattr(minhash, "GROUP", group)
    rng = random.Random(16)
    template = [f"t{i}" for i in range(70)]
    texts = [" ".join(template + [f"w{rng.randrange(10**7)}" for _ in range(50)]) for _ in range(1500)]
    texts += [t + " more" for t in texts[:40]] + [t.rsplit(" ", 12)[0] + " x y z" for t in texts[40:80]]
    got = {r["doc_id"]: (r["class_id"], r["linked_id"]) for r in minhash.classes(docs_of(texts)).collect()}
    for i in range(1500):
        assert got[i] == ((i, 1500 + i) if i < 80 else (i, None))
    assert all(got[1500 + i] == (i, i) for i in range(80))


def test_pairs_of_a_cell_are_compared_where_its_texts_are(spark):
    rng = random.Random(17)
    base = [f"t{i}" for i in range(60)]
    texts = [" ".join(edited(rng, base, 0.1)) for _ in range(30)]
    h, o = words.tokens(texts)
    w = [h[o[i]:o[i + 1]] for i in range(len(texts))]
    every = [(a, b, (a % 2) * 10 + b % 2) for a in range(30) for b in range(a + 1, 30)]
    want = sorted((a, b) for a, b, _ in every if minhash.similar(w[a], w[b]))
    pairs = spark.createDataFrame(every, "a long, b long, cell long")
    got = minhash._compared(pairs, spark.createDataFrame(list(enumerate(texts)), "id long, text string"), 0.8)
    assert sorted(map(tuple, got.collect())) == want and 20 < len(want) < len(every)
    # the only join is that of the texts of the cells, of which there are far fewer than pairs
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


@pytest.mark.parametrize("block", [minhash.BLOCK, 3])
def test_blocks_change_no_class(docs_of, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(18)
    passage = [f"p{i}" for i in range(60)]
    texts = [" ".join(passage + [f"w{rng.randrange(30)}" for _ in range(17)]) for _ in range(80)]
    s = minhash.sketches(texts)[0]
    h, o = words.tokens(texts)
    w = [h[o[i]:o[i + 1]] for i in range(len(texts))]
    links = [(j, i) for i in range(len(texts)) for j in range(i) if (s[i] == s[j]).any() and minhash.similar(w[i], w[j])]
    got = {r["doc_id"]: r["class_id"] for r in minhash.classes(docs_of(texts)).collect()}
    assert got == dict(enumerate(classes_of(len(texts), links)))


def test_pairs_of_a_bucket_are_rows_of_no_table():
    rng = random.Random(19)
    base, tail = [f"t{i}" for i in range(60)], [f"w{i}" for i in range(60)]
    texts = [" ".join(base + rng.sample(tail, 60)) for _ in range(80)]
    texts += [t + " more" for t in texts[:30]]
    s, h, o = minhash.sketches(texts)[0], *words.tokens(texts)
    w = [h[o[i]:o[i + 1]] for i in range(len(texts))]
    buckets = [(int(k), np.flatnonzero(s[:, f] == k).tolist()) for f in range(64) for k in np.unique(s[:, f])]
    rows = [{"key": int(np.uint64(k).view(np.int64)), "id": i, "class": i, "words": len(w[i]), "bag": minhash.bags(w[i], np.array([0, len(w[i])])).tobytes(),
             "sketch": s[i].view(np.int64).tolist(), "part": 0, "text": texts[i]} for k, ids in buckets if len(ids) > 1 for i in ids]
    batch = pa.RecordBatch.from_pylist(rows)
    met = sum(b.num_rows for b in minhash._met(iter([batch.slice(0, 57), batch.slice(57)]), 0.8))
    links = [(a, b) for got in minhash._joined(iter([batch.slice(0, 57), batch.slice(57)]), 0.8) for a, b in zip(*map(pa.Array.to_pylist, got.columns))]
    every = [(i, j) for j in range(len(texts)) for i in range(j) if (s[i] == s[j]).any() and minhash.similar(w[i], w[j])]
    assert met <= len(rows) and set(links) <= set(every) and classes_of(len(texts), links) == classes_of(len(texts), every)
    # each similar pair is looked at in one of the buckets that it shares
    assert sorted(links) == sorted(every) and len(every) == 30


def test_repeated_and_missing_ids(docs_of):
    texts = ["a b c d e f g", "a b c d e f g", "other text here now", "a b c d e f g", None]
    got = sorted((r["doc_id"] is None, r["doc_id"], r["class_id"], r["kept"]) for r in minhash.classes(docs_of(texts, [4, 4, 4, None, 9])).collect() if r["doc_id"] is not None)
    assert got == [(False, 4, 4, True)] * 3 + [(False, 9, 9, True)]
    rows = minhash.deduplicated(docs_of(texts, [4, 4, 4, None, 9])).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == [(False, 4), (False, 9), (True, 0)]
    assert minhash.classes(docs_of(["x"]).limit(0)).count() == 0


def test_other_texts_under_a_repeated_id_are_kept(docs_of):
    rng = random.Random(14)
    a, b, c = (" ".join(f"{x}{rng.randrange(10**6)}" for _ in range(60)) for x in "abc")
    texts, ids = [a, a, b, c, c + " more", b, b], [3, 5, 5, 5, 7, 5, 9]
    got = sorted((r["doc_id"], r["class_id"]) for r in minhash.classes(docs_of(texts, ids), rounds=0).collect())
    assert got == [(3, 3), (5, 3), (5, 5), (5, 5), (5, 5), (7, 5), (9, 5)]
    left = minhash.deduplicated(docs_of(texts, ids), by_id=False, rounds=0).collect()
    assert sorted((r["doc_id"], r["text"]) for r in left) == sorted([(3, a), (5, b), (5, c)])
    left = minhash.deduplicated(docs_of(texts[:3], ids[:3]), rounds=0).collect()
    assert sorted((r["doc_id"], r["text"]) for r in left) == [(3, a), (5, b)]


def test_components_of_long_chains(spark):
    n = 300
    edges = [(i, i + 1) for i in range(n)] + [(1000, 1001), (1001, 1002), (1002, 1000), (7, 7)]
    random.Random(4).shuffle(edges)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, n + 1)} | {1001: 1000, 1002: 1000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# vectors ----------------------------------------------------------------------------------------------------------

def vectors(seed, kind="float"):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(300, 16))
    x[100:160] = x[:60] + rng.normal(size=(60, 16)) * 0.06
    x[160:180] = x[200] + rng.normal(size=(20, 16)) * 0.02
    x[180:190] = x[5]
    rows = [(i, [float(np.float32(v)) for v in r], "x") for i, r in enumerate(x)]
    rows += [(400, None, "x"), (401, [0.0] * 16, "x"), (402, [1.0] * 15 + [math.nan], "x"), (403, [math.inf] + [1.0] * 15, "x"), (404, [None] + [1.0] * 15, "x"), (405, [], "x"), (406, [1.0, 2.0], "x"), (407, [2.0, 4.0], "x"),
             (None, rows[5][1], "x"), (408, [v * 3 for v in rows[5][1]], "x"), (5, rows[5][1], "x")]
    return rows


def test_joins_equal_brute_force(spark):
    rows = vectors(8)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, node string")
    for least, block in ((0.95, 64), (0.8, 4096)):
        got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in ego.classes(df, least=least, block=block).collect() if r["vec_id"] is not None)
        ok = [(i, v) for i, v, _ in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
        near = lambda a, b: len(a) == len(b) and np.dot(np.float32(a).astype(float), np.float32(b).astype(float)) / np.linalg.norm(np.float32(a).astype(float)) / np.linalg.norm(np.float32(b).astype(float)) >= least - 1e-12
        links = {(x, y) for x, (_, a) in enumerate(ok) for y, (_, b) in enumerate(ok) if x != y and near(a, b)}
        count = [sum((x, y) in links for y in range(len(ok))) for x in range(len(ok))]
        group = classes_of(len(ok), links)
        least_id = {g: min(ok[x][0] for x in range(len(ok)) if group[x] == g) for g in set(group)}
        want = [(ok[x][0], count[x], least_id[group[x]], ok[x][0] == least_id[group[x]]) for x in range(len(ok))]
        want += [(i, 0, i, True) for i, v, _ in rows if i is not None and i not in {o[0] for o in ok}]
        assert got == sorted(want)
    assert ego.classes(df.limit(0)).count() == 0


def brute_top(docs, queries, k):
    out = []
    for q, qv in queries.items():
        s = sorted((-sum(w * qv.get(t, 0) for t, w in v.items()), i) for i, v in docs if i != q)
        out += [(q, n, i, -x) for n, (x, i) in enumerate(s[:k], 1)]
    return sorted(out)


def test_different_vectors_under_one_id_keep_their_links(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(5, a), (5, b), (6, [1.0, 0.01, 0.0]), (7, [0.01, 1.0, 0.0]), (10, c), (9, c), (10, c)]
    got = sorted(tuple(r) for r in ego.classes(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(5, 1, 5, True), (5, 1, 5, True), (6, 1, 5, False), (7, 1, 5, False), (9, 2, 9, True), (10, 2, 9, False), (10, 2, 9, False)]


def test_top_k_equals_brute_force(spark):
    rng = random.Random(9)
    vec = lambda terms, low: {t: rng.randint(low, 20) for t in rng.sample(range(40), terms)}
    for low, terms, n in ((-20, 12, 300), (0, 5, 700), (1, 40, 300), (0, 0, 30)):
        docs = [(i, vec(rng.randint(0, terms), low)) for i in range(n)]
        docs += [docs[3], docs[3], (n, dict(docs[3][1])), (n + 1, {0: 10**12}), (n + 2, {})]
        queries = {i: v for i, v in docs if i % 20 == 0} | {10_000: {0: 10**9, 1: -(10**9)}, 10_001: {}}
        make = lambda rows: spark.createDataFrame([(i, sorted(v), [v[t] for t in sorted(v)], "x") for i, v in rows] + [(77_777, None, [1], "x")], "id long, terms array<int>, weights array<long>, score string")
        got = sorted(tuple(r) for r in maxscore.top_k(make(docs), make(queries.items()), 7, shard=100, block=8).collect())
        cap = lambda x: max(-(2**63), min(2**63 - 1, x))
        assert got == [(q, r, i, cap(s)) for q, r, i, s in brute_top(docs, queries, 7)]
    empty = make(docs).limit(0)
    assert maxscore.top_k(make(docs), empty).count() == 0 and maxscore.top_k(empty, make(docs)).count() == 0
