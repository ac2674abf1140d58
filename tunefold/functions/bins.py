"""Bin assignment: left-closed bins, the last one closed on both sides unless stated."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .angles import col


def even_bin(x, lo: float, width: float, n: int, close_last: bool = True) -> Column:
    """Bin index 0..n-1 of evenly spaced bins, NULL outside."""
    x = col(x)
    hi = lo + width * n
    b = F.floor((x - F.lit(float(lo))) / F.lit(float(width))).cast("int")
    inside = (x >= lo) & (x < hi)
    out = F.when(inside, F.least(b, F.lit(n - 1)))
    return out.when(x == hi, F.lit(n - 1)) if close_last else out


def angle_bin(deg, n: int) -> Column:
    """Bin of an angle on [0, 360) after wrapping."""
    b = F.floor(F.pmod(col(deg), F.lit(360.0)) / F.lit(360.0 / n)).cast("int")
    return F.when(b.isNotNull(), F.least(b, F.lit(n - 1)))


def right_closed_bin(x, lo: float, width: float, n: int) -> Column:
    """Bins (lo, lo+w], ...; used by circular-arena distance maps."""
    x = col(x)
    b = (F.ceil((x - F.lit(float(lo))) / F.lit(float(width))) - 1).cast("int")
    return F.when((b >= 0) & (b < n), b)


def edge_bin(x, edges: list[float]) -> Column:
    """Bin index on an irregular ascending edge list (short parameter list, not data)."""
    x = col(x)
    arr = F.array(*[F.lit(float(e)) for e in edges])
    n = F.size(F.filter(arr, lambda e: e <= x)) - 1
    return F.when(x == float(edges[-1]), F.lit(len(edges) - 2)).when(
        (x >= float(edges[0])) & (x < float(edges[-1])), n)


def centers_from_edges(edges: list[float]) -> list[float]:
    return [(a + b) / 2 for a, b in zip(edges[:-1], edges[1:])]


def edges_from_centers(centers: list[float]) -> list[float]:
    """Edges midway between centers, ends extended by half a step."""
    if len(centers) < 2:
        raise ValueError("need at least two centers")
    mids = [(a + b) / 2 for a, b in zip(centers[:-1], centers[1:])]
    return [centers[0] - (mids[0] - centers[0])] + mids + [centers[-1] + (centers[-1] - mids[-1])]


def check_divisor(n: int, group: int) -> int:
    if group <= 0 or n % group:
        raise ValueError("group size must divide the bin count")
    return n // group


def bin_dim(spark: SparkSession, n: int, name: str = "bin") -> DataFrame:
    """Fixed-size bin dimension 0..n-1."""
    return spark.range(n).select(F.col("id").cast("int").alias(name))


def fan_bins(df: DataFrame, n: int, name: str = "bin") -> DataFrame:
    """One row per input row and bin; n is a fixed parameter, so no join is needed."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
