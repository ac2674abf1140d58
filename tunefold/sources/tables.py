"""Row-level selections and validity checks on the recording tables. Checks return violation rows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.angles import col


def good_units(labels: DataFrame, spikes: DataFrame, keys: list[str], good: str = "good") -> DataFrame:
    """Units with the good label and their spike counts; silent units stay with 0."""
    n = spikes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_spikes"))
    g = labels.filter(F.col("label") == good).select(*keys)
    return g.join(n, keys, "left").withColumn("n_spikes", F.coalesce("n_spikes", F.lit(0)))


def hd_pick(classes: DataFrame, wanted: list[int] | None, cls: str = "hd_class") -> DataFrame:
    """Units of the wanted classes; None keeps all."""
    return classes if wanted is None else classes.filter(F.col(cls).isin(list(wanted)))


def anatomy_select(units: DataFrame, flag: str) -> DataFrame:
    """Units explicitly inside the region; unknown is not inside."""
    return units.filter(F.coalesce(F.col(flag), F.lit(False)))


def band_mask(df: DataFrame, center: str, lo: float | None, hi: float | None) -> DataFrame:
    """Bin centers in (lo, hi]; an open end keeps everything on that side."""
    c = F.lit(True)
    if lo is not None:
        c = c & (F.col(center) > lo)
    if hi is not None:
        c = c & (F.col(center) <= hi)
    return df.filter(c)


def factorial_violations(trials: DataFrame, session: list[str], order: str, levels: dict[str, range], *, width: float) -> DataFrame:
    """Blocks that do not hold every factor combination exactly once: expected combinations with their real count."""
    from ..operators.ordered import sequence
    size = 1
    for v in levels.values():
        size *= len(v)
    t = sequence(trials, session, [order], width=width, row_number="_r")
    t = t.withColumn("block", F.floor((F.col("_r") - 1) / size))
    have = t.groupBy(*session, "block", *levels).agg(F.count(F.lit(1)).alias("n"))
    want = t.select(*session, "block").distinct()
    for k, v in levels.items():
        want = want.withColumn(k, F.explode(F.array(*[F.lit(int(i)) for i in v])))
    full = want.join(have, [*session, "block", *levels], "full_outer")
    return full.withColumn("n", F.coalesce("n", F.lit(0))).filter("n <> 1")


def non_increasing(df: DataFrame, keys: list[str], t: str, *, width: float, seq: str) -> DataFrame:
    """Rows whose time does not exceed the previous row's, rows taken in `seq` order."""
    from ..operators.ordered import sequence
    return sequence(df, keys, [seq], width=width, lag={"_p": t}).filter(F.col(t) <= F.col("_p")).drop("_p")


def negative_ids(df: DataFrame, unit: str) -> DataFrame:
    return df.filter(F.col(unit).isNull() | (F.col(unit) < 0))
