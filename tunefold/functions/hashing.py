"""Deterministic randomness: values depend only on (seed, replicate, key), never on partitioning."""
from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .angles import col


def hash_key(seed: int, *parts) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[col(p).cast("string") for p in parts]))


def uniform(seed: int, *parts) -> Column:
    """Uniform number in [0, 1) with 32 random bits."""
    return F.conv(F.substring(hash_key(seed, *parts), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def replicate(df: DataFrame, n: int, name: str = "rep") -> DataFrame:
    """Fan every row out to n replicates (narrow, no join)."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


class Md5:
    """md5 of many short texts at once, after a common head: the leading 64 bits, as numbers in the order of the hex texts."""

    ROUND = 1 << 14
    TURN = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
    SINE = [np.uint32(int(abs(math.sin(i + 1)) * 4294967296)) for i in range(64)]

    def __init__(self, texts: pa.Array) -> None:
        self.texts, self.words = texts.cast(pa.binary()), {}

    def _message(self, at: int) -> np.ndarray | None:
        """(16 x texts) words of the one block with `at` free bytes before every text; None if a text is too long for one."""
        if at not in self.words:
            sizes = pc.binary_length(self.texts).to_numpy(zero_copy_only=False).astype(np.int64)
            n = len(sizes)
            if n and at + sizes.max() > 55:
                self.words[at] = None
            else:
                ends = np.cumsum(sizes)
                data = np.frombuffer(b"".join(self.texts.to_pylist()), np.uint8)
                block = np.zeros((n, 64), np.uint8)
                block[np.repeat(np.arange(n), sizes), at + np.arange(len(data)) - np.repeat(ends - sizes, sizes)] = data
                block[np.arange(n), at + sizes] = 128
                words = block.view("<u4")
                words[:, 14] = (at + sizes) * 8
                self.words[at] = np.ascontiguousarray(words.T)
        return self.words[at]

    def after(self, head: str) -> np.ndarray:
        head = head.encode()
        words = self._message(len(head))
        if words is None:
            return np.array([int.from_bytes(hashlib.md5(head + x).digest()[:8], "big") for x in self.texts.to_pylist()], np.uint64)
        front = np.frombuffer(head.ljust((len(head) + 3) // 4 * 4, b"\0"), "<u4")
        out = np.empty(words.shape[1], np.uint64)
        for lo in range(0, len(out), self.ROUND):
            m = [w[lo:lo + self.ROUND] for w in words]
            m = [x | front[i] if i < len(front) else x for i, x in enumerate(m)]
            m = [x if x.any() else None for x in m]
            n = min(self.ROUND, len(out) - lo)
            start = [np.uint32(v) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
            a, b, c, d = (np.full(n, v, np.uint32) for v in start)
            f, g = np.empty(n, np.uint32), np.empty(n, np.uint32)
            for i in range(64):
                if i < 16:
                    k = i
                    np.bitwise_xor(c, d, out=f)
                    np.bitwise_and(f, b, out=f)
                    np.bitwise_xor(f, d, out=f)
                elif i < 32:
                    k = (5 * i + 1) % 16
                    np.bitwise_xor(b, c, out=f)
                    np.bitwise_and(f, d, out=f)
                    np.bitwise_xor(f, c, out=f)
                elif i < 48:
                    k = (3 * i + 5) % 16
                    np.bitwise_xor(b, c, out=f)
                    np.bitwise_xor(f, d, out=f)
                else:
                    k = 7 * i % 16
                    np.bitwise_not(d, out=f)
                    np.bitwise_or(f, b, out=f)
                    np.bitwise_xor(f, c, out=f)
                f += a
                f += self.SINE[i]
                if m[k] is not None:
                    f += m[k]
                turn = self.TURN[i // 16][i % 4]
                np.left_shift(f, np.uint32(turn), out=g)
                np.right_shift(f, np.uint32(32 - turn), out=f)
                f |= g
                f += b
                a, d, c, b, f = d, c, b, f, a
            a, b = (a + start[0]).byteswap(), (b + start[1]).byteswap()
            out[lo:lo + n] = a.astype(np.uint64) << np.uint64(32) | b
        return out
