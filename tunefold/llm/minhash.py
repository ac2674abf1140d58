"""Near copies by order MinHash with banded alignment.

A sketch draws several functions; each takes the PICKED smallest of a text's occurrence-labelled runs of WORDS words and
keeps them in the order of the text, so texts agree in a sketch only if they share those runs, equally often and in the
same order. Texts with an equal sketch meet in a bucket. First the members of the buckets of FEW functions are compared with
the bucket's leader, which is the member of the smallest hash whatever the bucket, so large groups meet few leaders and come
together for about one comparison a text. Then, in ROUNDS rounds over all buckets that still hold different classes, one
member of each class is compared with a leader.

What is left are buckets that hold several classes. In one of at most GROUP texts all pairs of different classes are looked
at by their lengths and counts of words in BAG cells, which rule out most: they differ by no more than the edits. A pair that
shares several buckets is looked at in one of them, drawn by its ids. Pairs are rows of no table: the first pass over a bucket
returns the members that have such a partner, the second one gets their texts, compares them and returns the links that bring
classes together. Members of larger buckets are joined by an exact filter instead: with at most d edits, two texts share one of
the d + 1 rarest words of each (words labelled by their occurrence, in one order for all texts, rare ones first), so only
members of a family of such buckets that share a rare word, and are of about a length, meet; a template that thousands of
texts share is frequent and stays out. No pair that shares a bucket is left out unless it is in one class. A comparison
aligns the words inside the band of the edits that similarity still allows; similarity is 1 - edits / words of the longer text.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words
from .common import ship, stable
from .graph import components, labelled
from .mapped import slices

#: For SIMILARITY: with a share e of the words replaced, s = (1 - e)^WORDS of the runs stay, J = s / (2 - s), and a pair shares a
#: sketch with 1 - (1 - J^PICKED)^FUNCTIONS: above 0.999 at e = 0.2 (0.984 even if no two edits meet in a run).
WORDS = 3
PICKED = 2
FUNCTIONS = 64
SIMILARITY = 0.8
#: Functions of the first comparisons, and rounds over all of them.
FEW = 8
ROUNDS = 1
#: Runs looked at per function: those under the bound that about so many fall below, all if fewer than PICKED do.
DRAWN = 12
#: Cells of the counts of words.
BAG = 256
#: Texts of a bucket that one task compares by lengths and counts; larger buckets are joined by rare words.
GROUP = 4096
#: Texts, and words of them, that form a part of a bucket; a bucket of more is compared in cells of two parts.
BLOCK = 2048
HELD = 1 << 21
#: Cells in which words are counted to order them by rarity; any order is right, a good one makes few pairs.
CELLS = 1 << 18
STEP = np.uint64(0x9E3779B97F4A7C15)


def sketches(texts: list[str | None], *, k: int = WORDS, picked: int = PICKED, functions: int = FUNCTIONS) -> tuple[np.ndarray, np.ndarray]:
    """(texts x functions) sketches and the number of runs of each text; a text without words has none."""
    return _drawn(*words.tokens(texts), k, picked, functions)


def _drawn(hashes: np.ndarray, offsets: np.ndarray, k: int, picked: int, functions: int) -> tuple[np.ndarray, np.ndarray]:
    runs, offsets = words.shingles(hashes, offsets, k)
    counts = np.diff(offsets)
    label = words.mix(runs + words.occurrences(runs, offsets).astype(np.uint64) * STEP)
    doc = np.repeat(np.arange(len(counts)), counts)
    bound = np.where(counts <= DRAWN, 1.0, DRAWN / np.maximum(counts, 1))
    bound = np.where(bound >= 1, float(2**64 - 2048), bound * 2.0**64).astype(np.uint64)
    bound[counts <= DRAWN] = np.uint64(2**64 - 1)
    limit, top = bound[doc], np.uint64(2**64 - 1)
    out = np.zeros((len(counts), functions), np.uint64)
    for f, odd in enumerate(words.mix(np.arange(1, functions + 1, dtype=np.uint64) * STEP) | np.uint64(1)):
        draw = label * odd
        at = np.flatnonzero(draw <= limit)
        few = np.bincount(doc[at], minlength=len(counts)) < np.minimum(counts, picked)
        if few.any():
            at = np.union1d(at, np.flatnonzero(few[doc]))
        d, left = doc[at], draw[at]
        first = np.flatnonzero(np.append(True, d[1:] != d[:-1])) if len(d) else np.zeros(0, np.int64)
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(d))))
        chosen = np.zeros(len(at), bool)
        for _ in range(picked):
            least = np.flatnonzero(~chosen & (left == np.minimum.reduceat(left, first)[group])) if len(d) else first
            least = least[np.append(True, group[least][1:] != group[least][:-1])] if len(least) else least
            chosen[least], left[least] = True, top
        top_at = at[chosen]
        d = doc[top_at]
        place = (np.arange(len(d)) - np.searchsorted(d, d) + 1).astype(np.uint64)
        np.add.at(out[:, f], d, words.mix(label[top_at] ^ (place * STEP)))
        out[:, f] = words.mix(out[:, f] + np.uint64(f))
    return out, counts


def bags(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts x BAG) how many words fall in each cell, at most 255."""
    n = len(offsets) - 1
    cell = np.repeat(np.arange(n), np.diff(offsets)) * BAG + (hashes % np.uint64(BAG)).astype(np.int64)
    return np.minimum(np.bincount(cell, minlength=n * BAG), 255).astype(np.uint8).reshape(n, BAG)


def near(bag: np.ndarray, n: np.ndarray, other: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """Whether texts with these counts of words and numbers of words can be similar: an edit moves at most one word out and one in."""
    apart = bag.astype(np.int16) - other
    most = ((1 - similarity) * np.maximum(n, m) + 1e-9).astype(np.int64)
    return (np.abs(n - m) <= most) & (np.maximum(apart, 0).sum(axis=-1) <= most) & (np.maximum(-apart, 0).sum(axis=-1) <= most)


def _ends(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    other = np.flatnonzero(a[:n] != b[:n])
    return int(other[0]) if len(other) else n


def edits(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Insertions, deletions and replacements that turn a into b; some number above `most` if more are needed.

    Equal ends are cut off. The rest is aligned column by column in a band of `most` cells to each side of the diagonal,
    whose vertical differences are the bits of two integers that move down with it.
    """
    if abs(len(a) - len(b)) > most:
        return most + 1
    n = _ends(a, b)
    a, b = a[n:], b[n:]
    n = _ends(a[::-1], b[::-1])
    a, b = a[: len(a) - n].tolist(), b[: len(b) - n].tolist()
    if len(a) < len(b):
        a, b = b, a
    n = len(a)
    if not b or most >= n:
        if not b:
            return n
        most = n
    rise, full, low = most, (1 << (2 * most + 1)) - 1, 1 << (2 * most)
    seen: dict[int, tuple[int, int]] = {}
    for i, x in enumerate(a[:most]):
        seen[x] = (1, seen.get(x, (1, 0))[1] | 1 << (i + most))
    up, down, score = ((1 << (most + 1)) - 1) << most, 0, most
    for j, y in enumerate(b, 1):
        if j + most <= n:
            x = a[j + most - 1]
            at, bits = seen.get(x, (j, 0))
            seen[x] = (j, bits >> (j - at) | low)
        at, bits = seen.get(y, (j, 0))
        equal = bits >> (j - at)
        same = ((((equal & up) + up) ^ up) | equal | down) & full
        right = (down | ~(same | up)) & full
        left = same & up
        if j + most <= n:
            score += not same & low
        else:
            cell = 1 << (n - j + most)
            score += bool(right & cell) - bool(left & cell)
        up, down = (left | ~(same >> 1 | right)) & full, same >> 1 & right
    return score


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether two sequences of words have at least this edit similarity. Texts without words have none."""
    longer = max(len(a), len(b))
    if not longer:
        return False
    most = int((1 - similarity) * longer + 1e-9)
    return edits(a, b, most) <= most


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(BAG), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def _bag(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BAG)


def _sketched(batches: Iterator[pa.RecordBatch], k: int, picked: int, functions: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            hashes, ends = words.tokens(part.column(2).to_pylist())
            s, n = _drawn(hashes, ends, k, picked, functions)
            s = s[n > 0].view(np.int64)
            offsets = np.concatenate(([0], np.cumsum(np.where(n > 0, s.shape[1], 0)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(offsets), pa.array(s.ravel())), pa.array(np.diff(ends).astype(np.int64)), _binary(bags(hashes, ends))],
                                             names=["id", "digest", "sketch", "words", "bag"])


def _possible(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, n, b, m = (batch.column(c) for c in ("bag_a", "words_a", "bag_b", "words_b"))
        yield batch.select(["a", "b"]).filter(pa.array(near(_bag(a), n.to_numpy(), _bag(b), m.to_numpy(), similarity)))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of every value of the first column, which come in a row."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
        for first, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)]):
            if held and (first or held[-1].column(0)[-1].as_py() != key[0]):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(first, end - first))
    if held:
        yield pa.Table.from_batches(held)


def _candidates(rows: pa.Table, similarity: float) -> Iterator[tuple[int, np.ndarray]]:
    """(row, rows): the members of a bucket in different classes that can be similar and that this bucket compares, by rising length.

    Two texts share the buckets of several functions; their ids draw the one of these functions whose bucket compares them.
    In a cell of two parts only members of different parts meet.
    """
    n, part = rows.column("words").to_numpy(), rows.column("part").to_numpy()
    order = np.argsort(n, kind="stable")
    n, part, cls = n[order], part[order], rows.column("class").to_numpy()[order]
    bag, sketch = _bag(rows.column("bag"))[order], np.stack(rows.column("sketch").to_numpy())[order]
    draw = words.mix(rows.column("id").to_numpy()[order].astype(np.uint64))
    functions = sketch.shape[1]
    own, crossed = int(np.argmax(sketch[0] == rows.column("key")[0].as_py())), part.min() != part.max()
    stop = np.searchsorted(n, np.floor(n / similarity + 1e-9), side="right")
    for i in range(len(n)):
        j = np.arange(i + 1, stop[i])
        j = j[(cls[j] != cls[i]) & ((part[j] != part[i]) if crossed else True)]
        if len(j):
            j = j[near(bag[i], n[i], bag[j], n[j], similarity)]
        if len(j):
            turn = ((draw[i] + draw[j]) % np.uint64(functions)).astype(np.int64)
            away = np.where(sketch[j] == sketch[i], (np.arange(functions) - turn[:, None]) % functions, functions)
            j = j[away.argmin(axis=1) == own]
        if len(j):
            yield int(order[i]), order[j]


def _met(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """(key, id): members of a bucket that it has to compare with another."""
    for rows in _runs(batches):
        wanted = np.zeros(rows.num_rows, bool)
        for i, j in _candidates(rows, similarity):
            wanted[i] = wanted[j] = True
        if wanted.any():
            yield from rows.select(["key", "id"]).filter(pa.array(wanted)).combine_chunks().to_batches()


def _joined(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """(a, b): similar members of a cell, whose rows come in a row; as many as bring its classes together, fewer than it has rows."""
    for rows in _runs(batches):
        ids, cls = rows.column("id").to_pylist(), rows.column("class").to_pylist()
        hashes, ends = words.tokens(rows.column("text").to_pylist())
        text = [hashes[x:y] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]
        root = {c: c for c in cls}

        def top(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        found = []
        for i, others in _candidates(rows, similarity):
            for j in others.tolist():
                one, two = top(cls[i]), top(cls[j])
                if one != two and similar(text[i], text[j], similarity):
                    root[two] = one
                    found.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])


def _labels(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(word with its occurrence, as a hash; offsets of the texts)."""
    hashes, ends = words.tokens(texts)
    return words.mix(hashes + words.occurrences(hashes, ends).astype(np.uint64) * STEP), ends


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, words that fall in it) of a partition's texts."""
    seen = np.zeros(CELLS, np.int64)
    for part in (p for batch in batches for p in slices(batch)):
        seen += np.bincount((_labels(part.column(0).to_pylist())[0] % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], names=["cell", "n"])


def allowed(n: int, similarity: float) -> int:
    """The most edits between a text of n words and any that is similar to it, which has at most n / similarity words."""
    return int((1 - similarity) * int(n / similarity + 1e-9) + 1e-9)


def _rare(batches: Iterator[pa.RecordBatch], seen: np.ndarray, similarity: float) -> Iterator[pa.RecordBatch]:
    """The rarest words of each text, one more than the edits any partner allows."""
    for part in (p for batch in batches for p in slices(batch)):
        label, ends = _labels(part.column(1).to_pylist())
        n = np.diff(ends)
        doc = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((label, seen[(label % np.uint64(CELLS)).astype(np.int64)], doc))
        most = np.array([min(x, allowed(x, similarity) + 1) for x in n.tolist()], np.int64)
        kept = order[(np.arange(len(doc)) - ends[doc]) < most[doc]]
        yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(most)).astype(np.int32)), pa.array(label[kept].view(np.int64)))], names=["id", "rare"])


def _linked(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            one, two = (words.tokens(part.column(c).to_pylist()) for c in (2, 3))
            ok = [similar(one[0][one[1][i]:one[1][i + 1]], two[0][two[1][i]:two[1][i + 1]], similarity) for i in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _aligned(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """(a, b): the similar ones of the pairs (cell, id, other, no text) of a cell, whose rows come in a row after those of its texts (cell, id, no other, text)."""
    cell, seen = None, {}
    for part in (p for batch in batches for p in slices(batch)):
        cells, ids, other = (part.column(c).to_pylist() for c in (0, 1, 2))
        at = [i for i, x in enumerate(other) if x is None]
        hashes, ends = words.tokens(part.column(3).take(pa.array(at, pa.int64())).to_pylist())
        k, found = 0, []
        for c, one, two in zip(cells, ids, other):
            if c != cell:
                cell, seen = c, {}
            if two is None:
                seen[one] = hashes[ends[k]:ends[k + 1]].copy()
                k += 1
            elif similar(seen[one], seen[two], similarity):
                found.append((one, two))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], names=["a", "b"])


def _compared(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(a, b): the similar ones of pairs a, b, cell."""
    members = pairs.select("cell", F.col("a").alias("id")).union(pairs.select("cell", "b")).distinct().join(texts, "id")
    none = lambda kind: F.lit(None).cast(kind)
    rows = members.select("cell", "id", none("long").alias("other"), "text").union(pairs.select("cell", "a", "b", none("string")))
    return rows.repartition("cell").sortWithinPartitions("cell", F.col("other").asc_nulls_first()).mapInArrow(lambda it: _aligned(it, similarity), "a long, b long")


def _in_classes(buckets: DataFrame, classes: DataFrame | None) -> DataFrame:
    if classes is None:
        return buckets.withColumn("class", F.col("id"))
    return buckets.join(classes.withColumnRenamed("node", "id"), "id", "left").select("id", "key", F.coalesce("component", "id").alias("class"))


def _first_pairs(buckets: DataFrame) -> DataFrame:
    """(a, b): members of a bucket and its leader, the member of the smallest hash."""
    lead = buckets.groupBy("key").agg(F.min(F.struct(F.xxhash64(F.lit(0), "id").alias("h"), "id")).alias("lead"))
    return buckets.join(lead.select("key", F.col("lead.id").alias("lead")), "key").filter("id <> lead").select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")).distinct()


def _mixed(rows: DataFrame) -> DataFrame:
    """(key, one, n): buckets that hold different classes, the smallest of them, and the number of members."""
    return rows.groupBy("key").agg(F.min("class").alias("one"), F.max("class").alias("two"), F.count(F.lit(1)).alias("n")).filter("one < two").select("key", "one", "n")


def _pairs(rows: DataFrame, turn: int) -> DataFrame:
    """(a, b): one member of each class of a bucket with the bucket's leader. Hashes of turn and id choose both."""
    ones = rows.groupBy("key", "class").agg(F.min(F.struct(F.xxhash64(F.lit(turn), "id").alias("h"), "id")).alias("m"))
    lead = ones.groupBy("key").agg(F.min("m").alias("lead"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", F.col("lead.id").alias("lead"))
    met = ones.select("key", F.col("m.id").alias("id")).join(lead, "key").filter("id <> lead")
    return met.select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")).distinct()


def _rest(rows: DataFrame, texts: DataFrame, sketched: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links between classes that share a bucket, as many as bring together those that its similar pairs do."""
    mixed = stable(rows.join(_mixed(rows), "key"), "mixed")
    small = mixed.filter(F.col("n") <= GROUP).select("key", "id", "class").join(sketched.select("id", "words", "bag", "sketch"), "id")
    whole = small.select("key", "id", "class", "words", "bag", "sketch", F.lit(0).alias("part"))
    met = stable(whole.repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: _met(it, similarity), "key long, id long"), "met")
    held = met.join(small, ["key", "id"]).withColumn("part", F.xxhash64("id"))
    parts = held.groupBy("key").agg(F.greatest(F.ceil(F.sum("words") / HELD), F.ceil(F.count(F.lit(1)) / BLOCK)).cast("int").alias("parts"))
    held = held.join(parts, "key").withColumn("part", F.pmod("part", "parts").cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    held = held.withColumn("cell", F.xxhash64("key", F.least("part", "with"), F.greatest("part", "with"))).drop("with", "parts").join(texts, "id")
    held = held.select("cell", "key", "part", "id", "class", "words", "bag", "sketch", "text").repartition("cell").sortWithinPartitions("cell")
    found = held.mapInArrow(lambda it: _joined(it, similarity), "a long, b long")
    large = mixed.filter(F.col("n") > GROUP)
    if not large.limit(1).count():
        return found
    # a pair of both kinds is looked at twice
    pairs = stable(_by_rare_words(large, texts, sketched, similarity).withColumn("cell", F.col("a")), "possible")
    return found.union(_compared(pairs, texts, similarity))


def _by_rare_words(mixed: DataFrame, texts: DataFrame, sketched: DataFrame, similarity: float) -> DataFrame:
    """(a, b): the pairs of different classes that share a bucket, of rows key, id, class, one, found by a rare word that they share.

    Families are the components of classes that share buckets; a text is once in its family, whatever it shares.
    """
    inside = mixed.select("id", "class", "one").distinct()
    family = components(inside.filter(F.col("class") != F.col("one")).select(F.col("class").alias("a"), F.col("one").alias("b")))
    members = inside.select("id", "class").distinct().join(family.select(F.col("node").alias("class"), "component"), "class", "left").select("id", "class", F.coalesce("component", "class").alias("family"))
    held = stable(members.join(texts, "id"), "members")
    seen = np.zeros(CELLS, np.int64)  # CELLS numbers, whatever the corpus is
    for r in held.select("text").mapInArrow(_counted, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        seen[r["cell"]] = r["n"]
    count = held.sparkSession.sparkContext.broadcast(seen)
    rare = held.select("id", "text").mapInArrow(lambda it: _rare(it, count.value, similarity), "id long, rare array<long>")
    one = held.select("id", "class", "family").join(rare, "id").join(sketched.select("id", "words"), "id").select("id", "class", "family", "words", F.explode("rare").alias("word"))
    # a word that only one class of the family has makes no pair
    shared = one.groupBy("family", "word").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).filter("lo < hi").select("family", "word")
    one = stable(one.join(shared, ["family", "word"], "left_semi"), "rare")
    side = lambda n: one.select("family", "word", *[F.col(c).alias(f"{c}_{n}") for c in ("id", "class", "words")])
    longer = F.greatest("words_1", "words_2")
    close = (F.col("class_1") < F.col("class_2")) & (F.abs(F.col("words_1") - F.col("words_2")) <= F.floor(longer * (1 - similarity) + 1e-9))
    pairs = side(1).join(side(2), ["family", "word"]).filter(close).select(F.least("id_1", "id_2").alias("a"), F.greatest("id_1", "id_2").alias("b")).distinct()
    sketch = lambda c: sketched.select(F.col("id").alias(c), F.col("sketch").alias(f"sketch_{c}"))
    return pairs.join(sketch("a"), "a").join(sketch("b"), "b").filter(F.arrays_overlap("sketch_a", "sketch_b")).select("a", "b")


def classes(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, k: int = WORDS,
            picked: int = PICKED, functions: int = FUNCTIONS, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of df: id, class_id (smallest id of the class), kept (id = class_id) and linked_id.

    linked_id is the smallest id of a different text that this one was compared with and found similar to, null without any:
    every text that is not alone in its class has one, so the links shown hold the class together but for copies.

    Classes are the components of links: equal texts, and similar pairs among all that share a sketch (rounds: of leaders,
    which change the work and not the result). Rows without id or text take no part (class_id = id, kept); texts without
    any word link with equal texts only, empty ones included. A row's class is that of its text: rows that share an id but
    not the text can be in different classes, and classes with the same smallest id show the same class_id. Extra columns
    are not returned; an empty table gives an empty result.
    """
    docs = _docs(df, id_col, text_col)
    nodes, known, links, total = _known(docs, similarity, k, picked, functions, rounds)
    return _labelled(docs, nodes, known, links, id_col, total)


def _docs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(df[id_col].cast("long").alias("id"), F.md5(df[text_col].cast("binary")).alias("digest"), df[text_col].alias("text"))


def _known(docs: DataFrame, similarity: float, k: int, picked: int, functions: int, rounds: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """One row per different text (digest, node, its number; least, its smallest id; n, its rows), the components of nodes, the links found, and the number of rows."""
    ship(docs.sparkSession)
    how = {"k": k, "picked": picked, "functions": functions}
    part = docs.filter(F.col("id").isNotNull() & F.col("text").isNotNull())
    drawn = stable(part.mapInArrow(lambda it: _sketched(it, **how), "id long, digest string, sketch array<long>, words long, bag binary"), "sketches")
    # rows of one digest have one text, so any of their sketches will do
    nodes = drawn.groupBy("digest").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"), F.min_by(F.struct("sketch", "words", "bag"), "id").alias("s"))
    nodes = stable(nodes.select("digest", F.monotonically_increasing_id().alias("node"), "least", "n", "s.*"), "nodes")
    firsts = nodes.select(F.col("node").alias("id"), "sketch", "words", "bag")
    single = firsts.select("id", F.posexplode("sketch").alias("f", "key"))
    shared = single.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    single = stable(single.join(shared, "key", "left_semi").select("id", "key", "f"), "buckets")
    wanted = nodes.join(single.select(F.col("id").alias("node")).distinct(), "node", "left_semi").select("digest", F.col("least").alias("id"), "node")
    texts = stable(part.join(wanted, ["id", "digest"]).dropDuplicates(["id", "digest"]).select(F.col("node").alias("id"), "text"), "texts")
    side = lambda c: firsts.select(F.col("id").alias(c), F.col("words").alias(f"words_{c}"), F.col("bag").alias(f"bag_{c}"))
    known = links = None
    for turn in range(rounds + 2):
        rows = None if known is None else _in_classes(single.select("id", "key"), known)
        pairs = _first_pairs(single.filter(F.col("f") < FEW)) if known is None else _pairs(rows, turn) if turn <= rounds else _rest(rows, texts, firsts, similarity)
        if turn <= rounds:
            pairs = stable(pairs, "pairs").join(side("a"), "a").join(side("b"), "b").mapInArrow(lambda it: _possible(it, similarity), "a long, b long")
            pairs = stable(pairs, "possible")
            asked = texts.join(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "id", "left_semi")  # of the texts only those to be compared are dealt
            text = lambda c: asked.select(F.col("id").alias(c), F.col("text").alias(f"t{c}"))
            found = stable(pairs.join(text("a"), "a").join(text("b"), "b").select("a", "b", "ta", "tb").mapInArrow(lambda it: _linked(it, similarity), "a long, b long"), "found")
        else:
            found = stable(pairs.distinct(), "found")
        links = found if links is None else links.union(found)
        known = components(found if known is None else found.union(known.toDF("a", "b")))
    return nodes.select("digest", "node", "least", "n"), known, links, drawn.count()


def _merged(nodes: DataFrame, known: DataFrame) -> DataFrame:
    """nodes with their class, a node, and class_id, the smallest id of its rows."""
    rows = nodes.join(known, "node", "left").withColumn("class", F.coalesce("component", "node")).drop("component")
    labels = rows.filter(F.col("class") != F.col("node")).groupBy("class").agg(F.min("least").alias("least"))
    own = nodes.select(F.col("node").alias("class"), F.col("least").alias("own")).join(labels, "class", "left")
    own = own.select("class", F.least("own", "least").alias("class_id"))
    return rows.join(own, "class")


def _labelled(docs: DataFrame, nodes: DataFrame, known: DataFrame, links: DataFrame, id_col: str, total: int) -> DataFrame:
    ids = docs.select("id", F.when(F.col("id").isNotNull(), F.col("digest")).alias("digest"))
    both = links.union(links.select("b", "a")).toDF("node", "other").join(nodes.select(F.col("node").alias("other"), F.col("least").alias("linked_id")), "other")
    merged = _merged(nodes, known).join(both.groupBy("node").agg(F.min("linked_id").alias("linked_id")), "node", "left").select("digest", "n", "class_id", "linked_id")
    out = labelled(ids, merged, ["digest"], "n", total).select("id", F.coalesce("class_id", "id").alias("class_id"), "linked_id")
    return out.select(F.col("id").alias(id_col), "class_id", F.coalesce(F.col("id") == F.col("class_id"), F.lit(True)).alias("kept"), "linked_id")


def deduplicated(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, k: int = WORDS,
                 picked: int = PICKED, functions: int = FUNCTIONS, rounds: int = ROUNDS, by_id: bool = True) -> DataFrame:
    """One row of df of every class, that of the smallest id and then digest; with by_id, of those that share an id only the first by digest.

    Rows without id or text all stay. Columns are those of df. Without by_id no text is lost where ids repeat.
    """
    nodes, known, _, _ = _known(_docs(df, id_col, text_col), similarity, k, picked, functions, rounds)
    stay = _merged(nodes, known).groupBy("class").agg(F.min(F.struct("least", "digest")).alias("s")).select("s.*")
    if by_id:
        stay = stay.groupBy("least").agg(F.min("digest").alias("digest"))
    stay = stay.select(F.col("least").alias("__id"), F.col("digest").alias("__digest"))
    has = F.col(id_col).cast("long").isNotNull() & F.col(text_col).isNotNull()
    rows = df.filter(has).withColumns({"__id": F.col(id_col).cast("long"), "__digest": F.md5(F.col(text_col).cast("binary"))})
    once = rows.join(stay, ["__id", "__digest"], "left_semi").dropDuplicates(["__id", "__digest"]).select(*df.columns)
    return once.unionByName(df.filter(~has))
