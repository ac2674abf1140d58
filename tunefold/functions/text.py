"""String keys, status joins and truthiness."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from .angles import col


def unit_key(mouse, date, probe, unit_id) -> Column:
    return F.concat_ws(":", *[col(c).cast("string") for c in (mouse, date, probe, unit_id)])


def unit_suffix(key) -> Column:
    return F.substring_index(col(key), ":", -1)


def join_status(conditions: list[tuple[Column, str]], ok: str = "classified") -> Column:
    """Names of all true conditions joined by ';', or the ok word when none holds."""
    text = F.concat_ws(";", *[F.when(c, F.lit(name)) for c, name in conditions])
    return F.when(text == "", F.lit(ok)).otherwise(text)


def truthy(text) -> Column:
    return F.lower(F.trim(col(text))).isin("1", "true", "yes", "y", "t", "on")


def null_if_nan(x) -> Column:
    x = col(x).cast("double")
    return F.when(~F.isnan(x), x)
