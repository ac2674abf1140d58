"""Angle arithmetic on columns (degrees unless the name says rad)."""
from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

TWO_PI = 2.0 * math.pi


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def wrap360(deg) -> Column:
    return F.pmod(col(deg), F.lit(360.0))


def wrap180(deg) -> Column:
    """Wrap to [-180, 180)."""
    return F.pmod(col(deg) + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)


def wrap_pi(rad) -> Column:
    """Wrap to [-pi, pi)."""
    return F.pmod(col(rad) + F.lit(math.pi), F.lit(TWO_PI)) - F.lit(math.pi)


def circular_distance(a, b) -> Column:
    """Shortest angular distance in degrees."""
    return F.abs(wrap180(col(a) - col(b)))


def cosd(deg) -> Column:
    return F.cos(F.radians(col(deg)))


def sind(deg) -> Column:
    return F.sin(F.radians(col(deg)))


def direction(sum_cos: Column, sum_sin: Column) -> Column:
    """Direction of a vector sum in [0, 360); NULL for the zero vector."""
    return F.when((sum_cos != 0) | (sum_sin != 0), wrap360(F.degrees(F.atan2(sum_sin, sum_cos))))


def range_label(lo, hi) -> Column:
    """Text label of a degree range, signed axis."""
    return F.format_string("%.0f..%.0f", wrap180(lo), wrap180(hi))


def unit_clip(x: Column) -> Column:
    """Clip to [-1, 1]; NULL stays NULL (least and greatest alone would skip it)."""
    return F.when(x.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(-1.0), x)))
