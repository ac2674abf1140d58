"""The byte-level split of many texts into words at once, with NumPy, and their ids from a table of words.

A word is an English contraction, a run of letters, of numbers or of other characters, each with one space before it, or
white space. Where words start follows from the classes of neighbouring characters, so whole arrays are split at a time.
Equal words are looked up once for all texts at hand, by 64-bit hashes of their characters; what a word is worth is asked by
the word itself.
"""
from __future__ import annotations

import functools
import re
from collections.abc import Callable, Sequence

import numpy as np

from .words import PIECE, mix, powers

#: Words kept in a table, and the length of the longest of them.
CACHED = 200_000
LONGEST = 64
WHITE, LETTER, NUMBER, OTHER = range(4)
#: The characters with the property White_Space.
SPACES = [9, 10, 11, 12, 13, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: First and last of the letters and numbers that came after version 16 of Unicode, which the library follows.
LATER = [(0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD),
         (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9),
         (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA),
         (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81),
         (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F),
         (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F)]
#: A text may be cut before a space between a character that is no white space and a letter: no word spans that place.
CUT = re.compile("(?<=[^" + "".join(map(chr, SPACES)) + "]) (?=[A-Za-z])")
APOSTROPHE = 0x27


@functools.cache
def classes() -> np.ndarray:
    import regex  # knows every letter and number of version 16
    every = "".join(map(chr, range(0x110000)))
    table = np.full(0x110000, OTHER, np.uint8)
    for kind, name in ((LETTER, "L"), (NUMBER, "N")):
        for run in regex.finditer(rf"\p{{{name}}}+", every):
            table[run.start():run.end()] = kind
    for first, last in LATER:
        table[first:last + 1] = OTHER
    table[SPACES] = WHITE
    return table


def pieces(text: str, most: int = PIECE) -> list[str]:
    """A text in parts of little more than `most` characters, cut between words."""
    out, at = [], 0
    while len(text) - at > most and (cut := CUT.search(text, at + most)):
        out.append(text[at:cut.start()])
        at = cut.start()
    return [*out, text[at:]]


def starts(c: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where words start in joined texts of code points c, whose texts start at `first`."""
    n, k = len(c), classes()[c]
    begin, head = np.ones(n, bool), np.zeros(n + 1, bool)
    np.not_equal(k[1:], k[:-1], out=begin[1:])
    head[first] = True
    begin |= head[:n]
    dark = np.flatnonzero(begin & (k != WHITE) & ~head[:n])
    dark = dark[k[dark - 1] == WHITE]
    begin[dark - 1] = True
    begin[dark[c[dark - 1] == 0x20]] = False
    a = np.flatnonzero((c == APOSTROPHE) & begin)
    a = a[a + 1 < n]
    a = a[~head[a + 1] & (k[a + 1] == LETTER)]
    if len(a):
        one, two = c[a + 1], np.where((a + 2 < n) & ~head[np.minimum(a + 2, n)], c[np.minimum(a + 2, n - 1)], 0)
        short = np.isin(one, [ord(x) for x in "stmd"])
        long = (np.isin(one, [ord(x) for x in "rv"]) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        begin[a[short | long] + 1] = False
        then = np.concatenate((a[short] + 2, a[long] + 3))
        begin[then[then < n]] = True
    return np.flatnonzero(begin)


class Table:
    """Ids of words by the words' hashes. `make` gives those of the words that are missing: (ids, where each word's begin, how many).

    Sorted hashes point into one array of ids. When more than CACHED words are held, those not seen since the last time go.
    """

    def __init__(self, make: Callable[[list[str]], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        self.make, self.flat = make, np.zeros(0, np.int32)
        self.keys, self.place, self.many, self.used = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def of(self, hashes: np.ndarray, start: np.ndarray, end: np.ndarray, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where they begin for each word, how many) for words of a text with these hashes and ends."""
        at = np.minimum(np.searchsorted(self.keys, hashes), max(0, len(self.keys) - 1))
        known = self.keys[at] == hashes if len(self.keys) else np.zeros(len(hashes), bool)
        self.used[at[known]] = True
        place, many, flat = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64), self.flat
        place[known], many[known] = self.place[at[known]], self.many[at[known]]
        rest = np.flatnonzero(~known)
        if len(rest):
            new, first, word = np.unique(hashes[rest], return_index=True, return_inverse=True)
            a, b = start[rest[first]], end[rest[first]]
            ids, where, counts = self.make([text[i:j] for i, j in zip(a.tolist(), b.tolist())])
            flat = np.concatenate((flat, ids))
            where = where + len(self.flat)
            place[rest], many[rest] = where[word], counts[word]
            short = b - a <= LONGEST
            self.keep(flat, new[short], where[short], counts[short])
        return flat, place, many

    def keep(self, flat: np.ndarray, keys: np.ndarray, place: np.ndarray, many: np.ndarray) -> None:
        old = self.used if len(self.keys) + len(keys) > CACHED else np.ones(len(self.keys), bool)
        joined = [np.concatenate((x[old], y)) for x, y in ((self.keys, keys), (self.place, place), (self.many, many), (self.used & old.all(), np.ones(len(keys), bool)))]
        if not old.all() or len(joined[0]) > CACHED:
            joined[3][:] = False
            flat, joined[1] = flat[spans(joined[1], joined[2])], np.cumsum(joined[2]) - joined[2]
        order = np.argsort(joined[0], kind="stable")
        self.keys, self.place, self.many, self.used = (x[order] for x in joined)
        self.flat = flat


def spans(place: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The numbers place, place + 1, ... of every span, one after the other."""
    ends = np.cumsum(many)
    return np.repeat(place - (ends - many), many) + np.arange(ends[-1] if len(ends) else 0)


def _joined(parts: list[str], table: Table) -> tuple[np.ndarray, np.ndarray]:
    text = "".join(parts)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(p) for p in parts])
    first = np.cumsum(sizes) - sizes
    if not len(c):
        return np.zeros(0, np.int32), np.zeros(len(parts), np.int64)
    start = starts(c, first[sizes > 0])
    end = np.append(start[1:], len(c))
    up, down = powers(2 * PIECE) if len(c) <= 2 * PIECE else powers.__wrapped__(len(c))
    sums = np.zeros(len(c) + 1, np.uint64)
    np.cumsum(mix(c.astype(np.uint64) + np.uint64(1)) * up[: len(c)], out=sums[1:])
    flat, place, many = table.of(mix((sums[end] - sums[start]) * down[start]), start, end, text)
    ends = np.append(0, np.cumsum(many))[np.searchsorted(start, first + sizes)]
    return flat[spans(place, many)], np.diff(ends, prepend=0)


def encoded(texts: Sequence[str], table: Table) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts one after the other, how many each text has)."""
    out, counts, parts, owners, held = [], np.zeros(len(texts), np.int64), [], [], 0

    def flush() -> None:
        ids, n = _joined(parts, table)
        out.append(ids)
        np.add.at(counts, owners, n)

    for i, t in enumerate(texts):
        for p in pieces(t) if len(t) > PIECE else [t]:
            parts.append(p)
            owners.append(i)
            held += len(p)
            if held >= PIECE:
                flush()
                parts, owners, held = [], [], 0
    if parts:
        flush()
    return (np.concatenate(out) if out else np.zeros(0, np.int32)), counts
