"""Hashes of the words of many texts at once, with NumPy, for the operators that look at word shingles and n-grams."""
from __future__ import annotations

import functools
import unicodedata
from collections.abc import Sequence

import numpy as np

#: Code points hashed at a time.
PIECE = 1 << 18
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits all depend on all bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


@functools.cache
def word_table() -> np.ndarray:
    """For each code point, whether it belongs to a word: letters, digits and the marks that join them."""
    return np.fromiter((c.isalnum() or unicodedata.category(c)[0] == "M" for c in map(chr, range(0x110000))), bool, 0x110000)


@functools.lru_cache(maxsize=1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base and its inverse to all powers up to n."""
    return tuple(np.concatenate((np.ones(1, np.uint64), np.multiply.accumulate(np.full(n, b, np.uint64)))) for b in (BASE, INVERSE))


def _piece(points: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of one piece of text."""
    inside = np.zeros(len(points) + 2, np.int8)
    inside[1:-1] = table[points]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = powers(2 * PIECE) if len(points) <= 2 * PIECE else powers.__wrapped__(len(points))
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(mix(points.astype(np.uint64) + np.uint64(1)) * up[: len(points)], out=sums[1:])
    return start, mix((sums[end] - sums[start]) * down[start])


def tokens(texts: Sequence[str | None], lower: bool = True, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, offsets of the texts' words). Null texts have no words; a word is a run of letters, digits and marks."""
    table = word_table() if table is None else table
    texts = [(t.lower() if lower else t) if t else "" for t in texts]
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    whole = "\n".join([*texts, ""])
    starts, hashes, at = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    while at < len(whole):
        cut = at + PIECE
        if cut < len(whole):
            ends_at = lambda *stop: [p + 1 for p in (whole.find(" ", cut, *stop), whole.find("\n", cut, *stop)) if p >= 0]
            cut = min(ends_at(cut + PIECE) or ends_at())  # never inside a word: the text ends with a line end
        points = np.frombuffer(whole[at:cut].encode("utf-32-le", "surrogatepass"), np.uint32)
        s, h = _piece(points, table)
        starts.append(s + at)
        hashes.append(h)
        at = cut
    start = np.concatenate(starts)
    return np.concatenate(hashes), np.concatenate(([0], np.searchsorted(start, ends)))


def shingles(hashes: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every run of k words, offsets of the texts' runs). A text of fewer words is one run, one of none has no run."""
    n, counts = len(hashes), np.diff(offsets)
    runs = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(counts)), runs)
    out = np.concatenate(([0], np.cumsum(runs)))
    first = np.arange(out[-1]) - out[doc] + offsets[doc]
    stop = offsets[doc + 1]
    h = np.zeros(len(first), np.uint64)
    for j in range(k):
        at = first + j
        ok = at < stop
        h += np.where(ok, mix(hashes[np.minimum(at, max(0, n - 1))] + np.uint64(j * 0x51ED2701)) if n else np.uint64(0), np.uint64(0))
    return mix(h), out


def occurrences(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How often each value occurred before in its text."""
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    key = values ^ mix(doc.astype(np.uint64) + BASE)
    order = np.argsort(key)
    k = key[order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = k[1:] == k[:-1]
    twice = order[same[1:] | same[:-1]]  # only values that come again are sorted by text and place
    twice = twice[np.lexsort((twice, values[twice], doc[twice]))]
    v, d = values[twice], doc[twice]
    fresh = np.ones(len(v), bool)
    fresh[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    at = np.arange(len(v))
    out = np.zeros(len(values), np.int64)
    out[twice] = at - np.maximum.accumulate(np.where(fresh, at, 0))
    return out
