"""Byte-level BPE: whole texts to token ids and back, by a contiguous rank array per word.

A word is held as its parts (one entry per boundary) and the merge rank of every pair of neighbours. The smallest rank,
the leftmost of equal ones, is found by a scan; its boundary is deleted and the ranks of its two neighbours are looked up
again. Short words of about a length are rows of one array and take each step together. Words longer than SHORT parts keep
the same order of merges with a heap, so a text without spaces is not quadratic. Ranks belong to pairs of ids, as in the
merge list, not to the joined bytes.
"""
from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from . import split
from .common import carried, ship
from .mapped import slices

NONE = 1 << 30
SHORT = 128
#: Lengths of words, in bytes, that are worked on together, many words at once.
WIDTHS = (2, 4, 6, 8, 12, 16, 24, 32)


def byte_names() -> list[str]:
    """The printable character that stands for each byte in a vocabulary file: itself, or the next one from 256 on."""
    names, free = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            names.append(chr(b))
        else:
            names.append(chr(free))
            free += 1
    return names


class Coder:
    """Merges and vocabulary of a byte-level tokenizer file (JSON)."""

    def __init__(self, text: bytes) -> None:
        spec = json.loads(text)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        if spec["normalizer"] or model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("a byte-level BPE file without normalizer and prefix space is needed")
        vocab, added = model["vocab"], spec["added_tokens"]
        if any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in added):
            raise ValueError("added tokens that take their neighbourhood with them are not supported")
        names = byte_names()
        self.first = [vocab[c] for c in names]
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs.setdefault(vocab[a] << 32 | vocab[b], (rank, vocab[a + b]))
        back = {c: b for b, c in enumerate(names)}
        table = {i: t for t, i in vocab.items()} | {a["id"]: a["content"] for a in added}
        self.bytes = [b""] * (max(table) + 1)
        for i, t in table.items():
            self.bytes[i] = bytes(back[c] for c in t) if all(c in back for c in t) else t.encode()
        self.added = {a["content"]: np.array([a["id"]], np.int32).tobytes() for a in added if a["content"]}
        self.cut = re.compile("(" + "|".join(re.escape(c) for c in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        keys = sorted(self.pairs)
        self.keys, self.ranks = np.array(keys, np.int64), np.array([self.pairs[k][0] for k in keys], np.int32)
        self.new = np.zeros(len(model["merges"]), np.int32)
        self.new[self.ranks] = [self.pairs[k][1] for k in keys]
        self.bytes_first = np.array(self.first, np.int32)
        self.table = split.Table(self.many)
        sizes = np.array([len(b) for b in self.bytes])
        self.blob, self.size, self.place = np.frombuffer(b"".join(self.bytes), np.uint8), sizes, np.cumsum(sizes) - sizes

    def word(self, word: bytes) -> list[int]:
        parts = [self.first[b] for b in word]
        if len(parts) > SHORT:
            return self.long_word(parts)
        pairs = self.pairs
        ranks = [pairs.get(a << 32 | b, (NONE,))[0] for a, b in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == NONE:
                break
            i = ranks.index(best)
            parts[i] = pairs[parts[i] << 32 | parts[i + 1]][1]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = pairs.get(parts[i - 1] << 32 | parts[i], (NONE,))[0]
            if i < len(ranks):
                ranks[i] = pairs.get(parts[i] << 32 | parts[i + 1], (NONE,))[0]
        return parts

    def long_word(self, parts: list[int]) -> list[int]:
        n, pairs = len(parts), self.pairs
        right, left, gone = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(n)
        heap = [(p[0], i, p[1]) for i in range(n - 1) if (p := pairs.get(parts[i] << 32 | parts[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, new = heapq.heappop(heap)
            j = right[i]
            if gone[i] or j >= n or pairs.get(parts[i] << 32 | parts[j], (0, -1))[1] != new:
                continue
            parts[i], gone[j], right[i] = new, 1, right[j]
            if right[j] < n:
                left[right[j]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b < n and (p := pairs.get(parts[a] << 32 | parts[b])):
                    heapq.heappush(heap, (p[0], a, p[1]))
        return [p for p, g in zip(parts, gone) if not g]

    def ranked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of neighbours, NONE for those that never merge (or where one is missing, -1)."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
        return np.where(self.keys[at] == key, self.ranks[at], NONE) if len(self.keys) else np.full(key.shape, NONE, np.int32)

    def merged(self, parts: np.ndarray) -> np.ndarray:
        """The merges of many short words, a row each, filled up with -1: one step deletes a boundary in every row that has one."""
        out, rows = parts.copy(), np.arange(len(parts))
        ranks = self.ranked(parts[:, :-1], parts[:, 1:])
        while len(rows):
            best = ranks.argmin(axis=1)
            every = np.arange(len(rows))
            rank = ranks[every, best]
            alive = rank < NONE
            if not alive.all():
                out[rows[~alive]] = parts[~alive]
                rows, parts, ranks, best, rank = rows[alive], parts[alive], ranks[alive], best[alive], rank[alive]
                every = every[: len(rows)]
                if not len(rows):
                    break
            parts[every, best] = self.new[rank]
            behind = np.arange(parts.shape[1] - 1) > best[:, None]
            parts[:, :-1] = np.where(behind, parts[:, 1:], parts[:, :-1])
            parts[:, -1] = -1
            ranks[:, :-1] = np.where(np.arange(ranks.shape[1] - 1) >= best[:, None], ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = NONE
            left = np.flatnonzero(best > 0)
            ranks[left, best[left] - 1] = self.ranked(parts[left, best[left] - 1], parts[left, best[left]])
            right = np.flatnonzero(best < ranks.shape[1])
            ranks[right, best[right]] = self.ranked(parts[right, best[right]], parts[right, best[right] + 1])
        return out

    def many(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each word's begin, how many): short words of about a length together, long ones one by one."""
        coded = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        data, start = np.frombuffer(b"".join(coded), np.uint8), np.cumsum(sizes) - sizes
        flat, place, many, held = [], np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), 0
        for low, width in zip((0, *WIDTHS), WIDTHS):
            some = np.flatnonzero((sizes > low) & (sizes <= width))
            if not len(some):
                continue
            at = start[some, None] + np.arange(width)
            inside = np.arange(width) < sizes[some, None]
            parts = self.merged(np.where(inside, self.bytes_first[data[np.minimum(at, len(data) - 1)]], -1).astype(np.int32))
            kept = parts >= 0
            many[some] = kept.sum(axis=1)
            flat.append(parts[kept])
            place[some] = held + np.cumsum(many[some]) - many[some]
            held += len(flat[-1])
        for i in np.flatnonzero(sizes > WIDTHS[-1]).tolist():
            flat.append(np.array(self.word(coded[i]), np.int32))
            place[i], many[i] = held, len(flat[-1])
            held += len(flat[-1])
        return np.concatenate(flat) if flat else np.zeros(0, np.int32), place, many

    def encoded(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, how many each has). A null text is an empty one. Contents of added tokens are those tokens."""
        texts = [t or "" for t in texts]
        if self.cut is None or not any(map(self.cut.search, texts)):
            return split.encoded(texts, self.table)
        parts = [(i, p) for i, t in enumerate(texts) for p in self.cut.split(t)]
        ids, counts = split.encoded(["" if p in self.added else p for _, p in parts], self.table)
        ends, counts_of, out = np.cumsum(counts), np.zeros(len(texts), np.int64), []
        for (i, p), a, b in zip(parts, ends - counts, ends):
            out.append(np.frombuffer(self.added[p], np.int32) if p in self.added else ids[a:b])
            counts_of[i] += len(out[-1])
        return np.concatenate(out), counts_of

    def decoded(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of ids that lie one after the other; ids outside the vocabulary have none, bytes that are no UTF-8 become U+FFFD."""
        known = (ids >= 0) & (ids < len(self.size))
        at = np.where(known, ids, 0)
        sizes = np.where(known, self.size[at], 0)
        data = self.blob[split.spans(self.place[at], sizes)].tobytes()
        stops = np.append(0, np.cumsum(sizes))[np.cumsum(counts)].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip([0, *stops], stops)]

    def encode(self, text: str | None) -> bytes:
        """Ids of one text as packed int32."""
        return self.encoded([text])[0].tobytes()

    def decode(self, ids: list[int] | None) -> str:
        """Text of one list of ids."""
        return self.decoded(np.array(ids or [], np.int64), np.array([len(ids or [])]))[0]


@functools.lru_cache(maxsize=2)
def coder(text: bytes) -> Coder:
    return Coder(text)


def _mapped(df: DataFrame, tokenizer: str, source: str, out: str, kind: T.DataType, keep: list[str] | None, make) -> DataFrame:
    names = carried([c for c in df.columns] if keep is None else keep, [out])
    src = df.select(*names, df[source].alias("__source"))
    ship(df.sparkSession)
    with open(tokenizer, "rb") as f:
        held = df.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: a few MB whatever the corpus is

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(held.value)
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], make(c, part.column(len(names)))], names=[*names, out])

    return src.mapInArrow(run, T.StructType([*[src.schema[c] for c in names], T.StructField(out, kind)]))


def _ids(c: Coder, texts: pa.Array) -> pa.Array:
    ids, counts = c.encoded(texts.to_pylist())
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(ids))


def _texts(c: Coder, ids: pa.Array) -> pa.Array:
    ids = ids.fill_null([]) if ids.null_count else ids
    return pa.array(c.decoded(ids.flatten().fill_null(-1).to_numpy().astype(np.int64), np.diff(ids.offsets.to_numpy())), pa.string())


def encode(df: DataFrame, tokenizer: str, *, text_col: str = "text", out: str = "token_ids", keep: list[str] | None = None) -> DataFrame:
    """Adds the token ids (array of int) of every whole text; null and empty texts have no tokens.

    tokenizer: path of the vocabulary file on the driver, broadcast to the tasks. keep: the columns to carry along (all, if
    not given); one named like `out` is replaced. Rows stay in their partitions; an empty table stays empty.
    """
    return _mapped(df, tokenizer, text_col, out, T.ArrayType(T.IntegerType()), keep, _ids)


def decode(df: DataFrame, tokenizer: str, *, ids_col: str = "token_ids", out: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """Adds the text of the ids; null ids give an empty text. Other columns as in encode()."""
    return _mapped(df, tokenizer, ids_col, out, T.StringType(), keep, _texts)


def round_trip(df: DataFrame, tokenizer: str, *, text_col: str = "text", ids_out: str = "token_ids", out: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """encode() and decode() in one pass over the texts: adds the ids and the text of those ids. Columns as in encode()."""
    names = carried(df.columns if keep is None else keep, [ids_out, out])
    src = df.select(*names, df[text_col].alias("__source"))
    ship(df.sparkSession)
    with open(tokenizer, "rb") as f:
        held = df.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: a few MB whatever the corpus is

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(held.value)
        for part in (p for batch in batches for p in slices(batch)):
            ids = _ids(c, part.column(len(names)))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids, _texts(c, ids)], names=[*names, ids_out, out])

    return src.mapInArrow(run, T.StructType([*[src.schema[c] for c in names], T.StructField(ids_out, T.ArrayType(T.IntegerType())), T.StructField(out, T.StringType())]))
