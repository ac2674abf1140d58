"""Smoothing on bin grids: the kernel is a short literal list, each cell is fanned to its neighbours and re-summed.

Missing cells stay missing. A curve's bins are one small group, so the only shuffle is the final aggregate.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.angles import col


def gaussian_kernel(sigma: float, truncate: float = 4.0) -> list[tuple[int, float]]:
    """Offsets and normalized weights with radius int(truncate * sigma + 0.5)."""
    r = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-r, r + 1)]
    s = sum(w)
    return [(i - r, v / s) for i, v in enumerate(w)]


def boxcar_kernel(size: int) -> list[tuple[int, float]]:
    if size < 1 or size % 2 == 0:
        raise ValueError("boxcar width must be an odd number of bins")
    return [(i, 1.0 / size) for i in range(-(size // 2), size // 2 + 1)]


def resolve_kernel(kernel: list[tuple[int, float]], n: int, mode: str) -> dict[int, list[tuple[int, float]]]:
    """For each target bin the (source, weight) list after applying the border mode."""
    def src(i: int) -> int | None:
        if mode == "wrap":
            return i % n
        if mode == "nearest":
            return min(max(i, 0), n - 1)
        if mode == "reflect":
            j = i % (2 * n)
            return j if j < n else 2 * n - 1 - j
        return i if 0 <= i < n else None
    out = {}
    for t in range(n):
        acc: dict[int, float] = {}
        for o, w in kernel:
            s = src(t + o)
            if s is not None:
                acc[s] = acc.get(s, 0.0) + w
        out[t] = sorted(acc.items())
    return out


def _fan(df: DataFrame, axis: str, kernel: list[tuple[int, float]], n: int, mode: str) -> DataFrame:
    """Copy every row to the targets it contributes to, with `_w`. The table is n x kernel literals."""
    by_src: dict[int, list[tuple[int, float]]] = {}
    for t, items in resolve_kernel(kernel, n, mode).items():
        for s, w in items:
            by_src.setdefault(s, []).append((t, w))
    table = F.array(*[F.array(*[F.struct(F.lit(t).alias("t"), F.lit(w).alias("w")) for t, w in sorted(by_src.get(s, []))])
                      if by_src.get(s) else F.array().cast("array<struct<t:int,w:double>>") for s in range(n)])
    return (df.withColumn("_k", F.explode(F.get(table, F.col(axis))))
            .withColumn("_src", F.col(axis)).withColumn(axis, F.col("_k.t")).withColumn("_w", F.col("_k.w")).drop("_k"))


def smooth_sum(df: DataFrame, keys: list[str], axis: str, values: list[str], kernel, n: int, mode: str) -> DataFrame:
    """Plain convolution of each value (missing input counts as 0)."""
    f = _fan(df, axis, kernel, n, mode)
    return f.groupBy(*keys, axis).agg(*[F.sum(F.coalesce(F.col(v), F.lit(0.0)) * F.col("_w")).alias(v) for v in values])


def gaussian_rate(df: DataFrame, keys: list[str], axes: dict[str, tuple[float, int, str]], *, count: str, seconds: str) -> DataFrame:
    """Gaussian on counts and exposure separately, one pass per axis, then divide. axes: name -> (sigma, n, mode)."""
    cur, names = df, list(axes)
    for a, (sigma, n, mode) in axes.items():
        others = [x for x in names if x != a]
        cur = smooth_sum(cur, [*keys, *others], a, [count, seconds], gaussian_kernel(sigma), n, mode)
    return cur.withColumn("rate_hz", F.when(F.col(seconds) > 0, F.col(count) / F.col(seconds)))


def kernel_mean(df: DataFrame, keys: list[str], axis: str, value: str, kernel, n: int, mode: str) -> DataFrame:
    """Weight-normalized smoothing over finite cells; a missing centre stays missing."""
    f = _fan(df, axis, kernel, n, mode)
    v = F.col(value)
    centre = F.max(F.when(F.col("_src") == F.col(axis), v.isNotNull()))
    num, den = F.sum(v * F.col("_w")), F.sum(F.when(v.isNotNull(), F.col("_w")))
    return f.groupBy(*keys, axis).agg(F.when(centre, num / den).alias(value))


def circular_boxcar(df: DataFrame, keys: list[str], axis: str, size: int, n: int, *, count: str, seconds: str) -> DataFrame:
    """Circular mean of counts and exposure separately; bins without exposure keep a NULL rate."""
    f = _fan(df, axis, boxcar_kernel(size), n, "wrap")
    own = F.max(F.when(F.col("_src") == F.col(axis), F.coalesce(F.col(seconds), F.lit(0.0)) > 0))
    agg = f.groupBy(*keys, axis).agg(F.sum(F.col(count) * F.col("_w")).alias(count),
                                     F.sum(F.coalesce(F.col(seconds), F.lit(0.0)) * F.col("_w")).alias(seconds), own.alias("_own"))
    return agg.withColumn("rate_hz", F.when(F.col("_own") & (F.col(seconds) > 0), F.col(count) / F.col(seconds))).drop("_own")


def boxcar_nan(df: DataFrame, keys: list[str], axis: str, value: str, size: int, n: int, *, circular: bool) -> DataFrame:
    return kernel_mean(df, keys, axis, value, boxcar_kernel(size), n, "wrap" if circular else "constant")


def smooth_3x3(df: DataFrame, keys: list[str], *, rate: str, exposure: str, wrap_x: int | None = None) -> DataFrame:
    """1-2-1 kernel in y and x on rate*exposure and exposure; borders are truncated, missing cells stay missing."""
    offs = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(float((2 - abs(dy)) * (2 - abs(dx)))).alias("w"))
                     for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    f = df.withColumn("_o", F.explode(offs))
    tx = F.col("x") + F.col("_o.dx")
    f = f.select(*keys, (F.col("y") + F.col("_o.dy")).alias("y"), (F.pmod(tx, F.lit(wrap_x)) if wrap_x else tx).alias("x"),
                 (F.col(rate) * F.col(exposure) * F.col("_o.w")).alias("_n"),
                 F.when(F.col(rate).isNotNull(), F.col(exposure) * F.col("_o.w")).alias("_d"),
                 ((F.col("_o.dy") == 0) & (F.col("_o.dx") == 0) & F.col(rate).isNotNull() & (F.col(exposure) > 0)).alias("_own"))
    g = f.groupBy(*keys, "y", "x").agg(F.sum("_n").alias("_n"), F.sum("_d").alias("_d"), F.max("_own").alias("_own"))
    return g.filter("_own").select(*keys, "y", "x", (F.col("_n") / F.col("_d")).alias(rate))
