"""Von Mises kernel regression between paired directions.

Directions are collapsed to distinct (x, y) states with multiplicities first. Peaks live on a bin grid, so the
state table, and with it every pair of states, is bounded by the grid and not by the number of units.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.angles import cosd, sind, wrap180, wrap360, circular_distance
from ..session import cut_lineage

KAPPAS = [0.0, 0.125, 0.25, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0]


def _states(pairs: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    return pairs.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*group, wrap360(x).alias("x"), wrap180(y).alias("y")).agg(F.count(F.lit(1)).alias("m"))


def _fan(df: DataFrame) -> DataFrame:
    return df.withColumn("kappa", F.explode(F.array(*[F.lit(k) for k in KAPPAS])))


def _loss(c: Column, s: Column, y: Column) -> Column:
    """1 - cos(error); an undefined prediction costs the maximum of 2."""
    r = F.hypot(c, s)
    return F.when(r > 1e-12, 1.0 - (c * cosd(y) + s * sind(y)) / r).otherwise(F.lit(2.0))


def kernel_fit(pairs: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """Leave-one-out loss per concentration and the best one (smallest loss, then smallest kappa)."""
    st = cut_lineage(_states(pairs, group, x, y))
    q = st.select(*group, F.col("x").alias("qx"), F.col("y").alias("qy"), F.col("m").alias("qm"))
    j = _fan(q.join(st, group))
    # a unit's own term has weight 1; subtracting one copy leaves the others of its state in
    w = F.exp(F.col("kappa") * (cosd(F.col("qx") - F.col("x")) - 1.0))
    own = (F.col("x") == F.col("qx")) & (F.col("y") == F.col("qy"))
    mm = w * (F.col("m") - F.when(own, 1).otherwise(0))
    s = j.groupBy(*group, "qx", "qy", "qm", "kappa").agg(F.sum(mm * cosd("y")).alias("c"), F.sum(mm * sind("y")).alias("s"), F.sum(mm).alias("w"))
    loss = _loss(F.col("c") / F.col("w"), F.col("s") / F.col("w"), F.col("qy"))
    return s.groupBy(*group, "kappa").agg((F.sum(F.col("qm") * F.coalesce(loss, F.lit(2.0))) / F.sum("qm")).alias("loss"), F.sum("qm").alias("n"))


def best_kappa(losses: DataFrame, group: list[str]) -> DataFrame:
    return losses.groupBy(*group).agg(F.min_by("kappa", F.struct(F.round("loss", 12), F.col("kappa"))).alias("kappa"), F.min("loss").alias("loss"), F.first("n").alias("n"))


def nested_loo(pairs: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """Nested leave-one-out error: for every held-out state the bandwidth is chosen without it.

    The inner sums without (held-out i, inner j) equal the full sums at j minus the terms of i and of j itself.
    """
    st = cut_lineage(_states(pairs, group, x, y))
    a = st.select(*group, F.col("x").alias("jx"), F.col("y").alias("jy"), F.col("m").alias("jm"))
    w = lambda p, q: F.exp(F.col("kappa") * (cosd(F.col(p) - F.col(q)) - 1.0))
    full = _fan(a.join(st, group)).groupBy(*group, "jx", "jy", "jm", "kappa").agg(
        F.sum(F.col("m") * w("jx", "x") * cosd("y")).alias("C"), F.sum(F.col("m") * w("jx", "x") * sind("y")).alias("S"), F.sum(F.col("m") * w("jx", "x")).alias("W"))
    full = cut_lineage(full)
    i = st.select(*group, F.col("x").alias("ix"), F.col("y").alias("iy"), F.col("m").alias("im"))
    j = i.join(full, group)
    same = (F.col("ix") == F.col("jx")) & (F.col("iy") == F.col("jy"))
    wij = w("ix", "jx")
    c = F.col("C") - cosd("jy") - wij * cosd("iy")
    s = F.col("S") - sind("jy") - wij * sind("iy")
    W = F.col("W") - 1.0 - wij
    ln = F.when(W > 1e-12, _loss(c / W, s / W, F.col("jy"))).otherwise(F.lit(2.0))
    mult = F.col("jm") - F.when(same, 1).otherwise(0)
    inner = j.groupBy(*group, "ix", "iy", "im", "kappa").agg((F.sum(mult * ln) / F.sum(mult)).alias("loss"))
    pick = inner.groupBy(*group, "ix", "iy", "im").agg(F.min_by("kappa", F.struct(F.round("loss", 12), F.col("kappa"))).alias("kappa"))
    # prediction at i from everything else with the chosen kappa
    at = full.select(*group, F.col("jx").alias("ix"), F.col("jy").alias("iy"), "kappa", "C", "S")
    p = pick.join(at, [*group, "ix", "iy", "kappa"])
    pc, ps = F.col("C") - cosd("iy"), F.col("S") - sind("iy")
    pred = F.when(F.hypot(pc, ps) > 1e-12, F.degrees(F.atan2(ps, pc)))
    err = F.abs(wrap180(pred - F.col("iy")))
    return p.groupBy(*group).agg(F.sum("im").alias("total_n"), (F.sum(F.col("im") * err) / F.sum(F.when(err.isNotNull(), F.col("im")))).alias("nested_mae_deg"))


def baselines(pairs: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """Constant-offset and fixed-allocentric models with the resultant of x + y."""
    a = pairs.groupBy(*group).agg(F.sum(cosd(y)).alias("_c"), F.sum(sind(y)).alias("_s"), F.sum(cosd(F.col(x) + F.col(y))).alias("_ac"), F.sum(sind(F.col(x) + F.col(y))).alias("_as"), F.count(F.lit(1)).alias("n"))
    return a.select(*group, "n", F.degrees(F.atan2("_s", "_c")).alias("constant_deg"), wrap360(F.degrees(F.atan2("_as", "_ac"))).alias("beta_deg"), (F.hypot("_ac", "_as") / F.col("n")).alias("resultant"))


def kernel_predict(pairs: DataFrame, group: list[str], x: str, y: str, kappa: DataFrame, n_grid: int) -> DataFrame:
    """Prediction, response agreement, effective sample size and nearest training distance on an even heading grid."""
    st = _states(pairs, group, x, y).join(kappa.select(*group, "kappa"), group)
    g = st.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n_grid - 1)))).withColumn("q", F.col("q") * (360.0 / n_grid))
    w = F.exp(F.col("kappa") * (cosd(F.col("q") - F.col("x")) - 1.0))
    a = g.groupBy(*group, "q").agg(F.sum(F.col("m") * w * cosd("y")).alias("_c"), F.sum(F.col("m") * w * sind("y")).alias("_s"), F.sum(F.col("m") * w).alias("_w"),
                                   F.sum(F.col("m") * w * w).alias("_w2"), F.min(circular_distance("q", "x")).alias("nearest_deg"))
    r = F.hypot("_c", "_s") / F.col("_w")
    return a.select(*group, F.col("q").alias("hd_deg"), F.when(r > 1e-12, wrap180(F.degrees(F.atan2("_s", "_c")))).alias("rf_deg"), r.alias("resultant"),
                    (F.col("_w") ** 2 / F.col("_w2")).alias("effective_n"), "nearest_deg")
