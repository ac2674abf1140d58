"""Lookups and checks on long response cubes, and the display clock."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def unit_map(cube: DataFrame, unit: str, unit_id: int) -> DataFrame:
    """One unit's cells; the filter reaches the scan."""
    return cube.filter(F.col(unit) == unit_id)


def cells_equal(cube: DataFrame, value: str, target) -> DataFrame:
    return cube.filter(F.col(value) == target)


def view(cube: DataFrame, keys: list[str], dims: list[str], value: str) -> DataFrame:
    """4-D, 2-D or 1-D view: sum over the dimensions left out."""
    return cube.groupBy(*keys, *dims).agg(F.sum(value).alias(value))


def align_trials(responses: DataFrame, maps: DataFrame, keys: list[str]) -> DataFrame:
    """Pooled trial responses beside the map value of the same unit and cell, with an equality flag."""
    p = responses.groupBy(*keys, "y", "x").agg(F.sum("response").alias("pooled"))
    return p.join(maps, [*keys, "y", "x"]).withColumn("matches", F.col("pooled") == F.col("mapped"))


def display_clock(frames: DataFrame, session: list[str], t: str, step: float) -> DataFrame:
    """Even clock from the first to the last frame of every session, built from two numbers per session."""
    b = frames.groupBy(*session).agg(F.min(t).alias("_a"), F.max(t).alias("_z"))
    n = F.floor((F.col("_z") - F.col("_a")) / step).cast("int")
    return b.withColumn("_i", F.explode(F.sequence(F.lit(0), n))).select(*session, (F.col("_a") + F.col("_i") * step).alias("clock_s"))
