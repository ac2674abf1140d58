"""Boundary maps seen from the animal, behavioural states, matched comparisons and control simulations."""
from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.angles import col, circular_distance, cosd, sind, wrap360
from ..functions.bins import even_bin, right_closed_bin
from ..functions.geometry import ray_direction, ray_rectangle, wall_circle, wall_rectangle
from ..session import cut_lineage
from .dense import dense_by_table


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A column made once a row: a generator of one row, so that it is not written out again in every step and filter that reads it."""
    return df.withColumn(name, F.explode(F.array(value)))


def ray_bins(poses: DataFrame, *, n_theta: int, dist_cm: float, n_dist: int, arena: tuple[float, float] | None = None, circle: tuple[float, float, float] | None = None) -> DataFrame:
    """Every pose with its (theta_bin, dist_bin) of the wall, one row per fixed bearing. A narrow step: the rays
    come from the pose in the row, so nothing is joined. Circular arenas use right-closed distance bins."""
    step = 360.0 / n_theta
    f = poses.withColumn("theta_bin", F.explode(F.sequence(F.lit(0), F.lit(n_theta - 1))))
    dx, dy = ray_direction(F.col("hd") + (F.col("theta_bin") + 0.5) * step)
    f = _once(f, "_ray", F.struct(dx.alias("dx"), dy.alias("dy")))
    at = ("x", "y", "_ray.dx", "_ray.dy")
    f = _once(f, "_wall", wall_rectangle(*at, *arena) if arena else wall_circle(*at, *circle))
    db = even_bin("_wall", 0.0, dist_cm, n_dist) if arena else right_closed_bin("_wall", 0.0, dist_cm, n_dist)
    return f.withColumn("dist_bin", db).drop("_ray", "_wall").filter("dist_bin IS NOT NULL")


def occupancy_map(poses: DataFrame, keys: list[str], dt: float, **geom) -> DataFrame:
    return ray_bins(poses, **geom).groupBy(*keys, "theta_bin", "dist_bin").agg((F.count(F.lit(1)) * dt).alias("occ_s"))


def spike_map(spike_poses: DataFrame, keys: list[str], count: str, **geom) -> DataFrame:
    """Spikes x rays from spikes that already carry their pose and a count."""
    return ray_bins(spike_poses, **geom).groupBy(*keys, "theta_bin", "dist_bin").agg(F.sum(count).alias("n_spikes"))


def ego_rates(counts: DataFrame, occupancy: DataFrame, session: list[str], unit: list[str], extra: list[str] = ()) -> DataFrame:
    """Rate on every visited cell of the session; unvisited cells do not exist (missing)."""
    cell = [*extra, "theta_bin", "dist_bin"]
    j = dense_by_table(counts, [*session, *unit], occupancy, session, cell, ["n_spikes"], ["occ_s"], fill=0)
    return j.withColumn("rate_hz", F.when(F.col("occ_s") > 0, F.col("n_spikes") / F.col("occ_s")))


def band_sum(rates: DataFrame, keys: list[str], lo: float, hi: float, dist_cm: float) -> DataFrame:
    """Sum of stored rates over bin centers in (lo, hi]; entirely missing stays missing."""
    c = (F.col("dist_bin") + 0.5) * dist_cm
    return rates.filter((c > lo) & (c <= hi)).groupBy(*keys, "theta_bin").agg(F.sum("rate_hz").alias("rate_hz"))


def band_mean(rates: DataFrame, keys: list[str], lo: float, hi: float, dist_cm: float, group: int) -> DataFrame:
    """Equal-cell mean over the band and grouped bearings."""
    c = (F.col("dist_bin") + 0.5) * dist_cm
    return rates.filter((c > lo) & (c <= hi)).groupBy(*keys, F.floor(F.col("theta_bin") / group).cast("int").alias("theta_bin")).agg(F.avg("rate_hz").alias("rate_hz"))


def joint_map(df: DataFrame, keys: list[str], n_hd: int, bands: dict[str, tuple[int, int]], value: Column, out: str, **geom) -> DataFrame:
    """HD x bearing sums per distance-bin band [start, stop)."""
    r = ray_bins(df, **geom).withColumn("hd_bin", F.least(F.floor(F.pmod(F.col("hd"), F.lit(360.0)) / (360.0 / n_hd)).cast("int"), F.lit(n_hd - 1)))
    arr = F.array(*[F.when((F.col("dist_bin") >= a) & (F.col("dist_bin") < b), F.lit(k)) for k, (a, b) in bands.items()])
    r = r.withColumn("band", F.explode(F.filter(arr, lambda x: x.isNotNull())))
    return r.groupBy(*keys, "band", "hd_bin", "theta_bin").agg(F.sum(value).alias(out))


def distance_peaks(rates: DataFrame, keys: list[str], bands: dict[str, tuple[float, float]], dist_cm: float) -> DataFrame:
    """2-D argmax per unit and band, first cell in row-major order on ties."""
    c = (F.col("dist_bin") + 0.5) * dist_cm
    arr = F.array(*[F.when((c > a) & (c <= b), F.lit(k)) for k, (a, b) in bands.items()])
    r = rates.withColumn("band", F.explode(F.filter(arr, lambda x: x.isNotNull())))
    o = F.when(F.col("rate_hz").isNotNull(), F.struct(F.col("rate_hz"), -F.col("theta_bin"), -F.col("dist_bin")))
    g = r.groupBy(*keys, "band").agg(F.max_by(F.struct("theta_bin", "dist_bin"), o).alias("p"), F.max("rate_hz").alias("peak_hz"))
    return g.select(*keys, "band", F.col("p.theta_bin").alias("theta_bin"), F.col("p.dist_bin").alias("dist_bin"), "peak_hz")


def subset_maps(poses: DataFrame, spikes: DataFrame, session: list[str], unit: list[str], subsets: dict[str, Column], dt: float, **geom) -> DataFrame:
    """Rate maps of several frame subsets in one pass: a cell's poses and spikes are counted for all subsets at once, not fanned to them."""
    def counted(df, keys, value, name):
        g = ray_bins(df, **geom).groupBy(*keys, "theta_bin", "dist_bin").agg(*[F.count_if(c).alias(f"_n_{k}") for k, c in subsets.items()])
        each = F.explode(F.array(*[F.struct(F.lit(k).alias("subset"), F.col(f"_n_{k}").alias("n")) for k in subsets])).alias("_q")
        return g.select(*keys, "theta_bin", "dist_bin", each).filter("_q.n > 0").select(*keys, "theta_bin", "dist_bin", "_q.subset", value(F.col("_q.n")).alias(name))

    o = counted(poses, session, lambda c: c * dt, "occ_s")
    n = counted(spikes, [*session, *unit], lambda c: c, "n_spikes")
    tag = F.create_map(*[x for i, k in enumerate(subsets) for x in (F.lit(k), F.lit(i))])
    coded = lambda d: d.withColumn("_s", tag[F.col("subset")])
    j = dense_by_table(coded(n), [*session, *unit], coded(o), session, ["_s", "theta_bin", "dist_bin"], ["n_spikes"], ["subset", "occ_s"], fill=0)
    return j.drop("_s").withColumn("rate_hz", F.col("n_spikes") / F.col("occ_s"))


def boundary_quality(maps: DataFrame, keys: list[str], *, min_bins: int = 3) -> DataFrame:
    """Half and unheld stability, modulation (q95 - q05)/q95 and their product, from subsets full, first, second, unheld."""
    p = maps.groupBy(*keys, "theta_bin", "dist_bin").agg(*[F.max(F.when(F.col("subset") == s, F.col("rate_hz"))).alias(s) for s in ("full", "first", "second", "unheld")])

    def corr(a, b):
        ok = F.col(a).isNotNull() & F.col(b).isNotNull()
        A, B = F.when(ok, F.col(a)), F.when(ok, F.col(b))
        return F.when((F.count(A) >= min_bins) & (F.stddev_pop(A) > 0) & (F.stddev_pop(B) > 0), F.corr(A, B))

    g = p.groupBy(*keys).agg(corr("first", "second").alias("half_r"), corr("full", "unheld").alias("unheld_r"),
                             F.percentile("full", F.lit(0.05)).alias("_q05"), F.percentile("full", F.lit(0.95)).alias("_q95"),
                             F.count_if(F.col("first").isNotNull() & F.col("second").isNotNull()).alias("half_shared_bins"))
    mod = F.when(F.col("_q95") > 0, (F.col("_q95") - F.col("_q05")) / F.col("_q95"))
    return g.select(*keys, "half_r", "unheld_r", mod.alias("modulation"), F.when(F.col("half_r").isNotNull(), F.greatest("half_r", F.lit(0.0)) * mod).alias("score"), "half_shared_bins")


def product_vs_joint(joint: DataFrame, keys: list[str]) -> DataFrame:
    """Joint rate beside the separable product of its marginals (row and column shares of the total)."""
    t = joint.groupBy(*keys).agg(F.sum("n_spikes").alias("_t"))
    h = joint.groupBy(*keys, "hd_bin").agg(F.sum("n_spikes").alias("_h"))
    b = joint.groupBy(*keys, "theta_bin").agg(F.sum("n_spikes").alias("_b"))
    j = joint.join(h, [*keys, "hd_bin"]).join(b, [*keys, "theta_bin"]).join(t, keys)
    return j.withColumn("product", F.col("_h") * F.col("_b") / F.col("_t")).drop("_h", "_b", "_t")


def behavior_states(frames: DataFrame, session: list[str], *, pos_cm: float, n_pos: int, hd_deg: float = 12.0, speed_edges: list[float] | None = None,
                    geometry: list[float] = (), arena: tuple[float, float] = (40.0, 40.0)) -> DataFrame:
    """Position x heading (x speed) states: counts, mean position, circular mean heading, mean wall distances."""
    cell = lambda c: F.least(F.floor(F.col(c) / pos_cm).cast("int"), F.lit(n_pos - 1))
    f = frames.withColumns({"xb": cell("x"), "yb": cell("y"), "hb": F.floor(F.col("hd") / hd_deg).cast("int")})
    keys = [*session, "xb", "yb", "hb"]
    if speed_edges:
        f = f.withColumn("sb", sum((F.when(F.col("speed") >= e, 1).otherwise(0) for e in speed_edges[1:]), F.when(F.col("speed") >= speed_edges[0], 1).otherwise(0)))
        keys.append("sb")
    g = f.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"), F.sum(cosd("hd")).alias("_c"), F.sum(sind("hd")).alias("_s"),
                             *[F.avg(ray_rectangle("x", "y", F.col("hd") + b, *arena)).alias(f"g{i}") for i, b in enumerate(geometry)])
    out = g.withColumn("hd", wrap360(F.degrees(F.atan2("_s", "_c")))).drop("_c", "_s")
    if geometry:
        out = out.withColumn("geometry", F.array(*[F.col(f"g{i}") for i in range(len(geometry))])).drop(*[f"g{i}" for i in range(len(geometry))])
    return out


def state_matches(states: DataFrame, session: list[str], key: str, *, rms_cm: float = 2.0, min_sep: float = 10.0, min_hd: float = 60.0, n_geom: int) -> DataFrame:
    """State pairs of similar geometry but different place and heading.

    An RMS of r over d axes bounds each single axis by r*sqrt(d); axis 0 is cut into cells of that size and only
    neighbouring cells meet. States live on a position x heading grid, so the table is bounded by the arena.
    """
    reach = rms_cm * (n_geom ** 0.5)
    b = F.floor(F.get("geometry", F.lit(0)) / reach).cast("long")
    left = states.select(*session, F.col(key).alias("a"), F.col("geometry").alias("ga"), F.col("x").alias("xa"), F.col("y").alias("ya"), F.col("hd").alias("ha"), F.col("n").alias("na"), b.alias("_b"))
    right = states.select(*session, F.col(key).alias("b"), F.col("geometry").alias("gb"), F.col("x").alias("xb"), F.col("y").alias("yb"), F.col("hd").alias("hb"), F.col("n").alias("nb"),
                          F.explode(F.array(b - 1, b, b + 1)).alias("_b"))
    j = left.join(right, [*session, "_b"]).filter("a < b")
    d2 = F.aggregate(F.zip_with("ga", "gb", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v) / n_geom
    sep = F.hypot(F.col("xa") - F.col("xb"), F.col("ya") - F.col("yb"))
    hd = circular_distance("ha", "hb")
    j = j.withColumns({"rms_cm": F.sqrt(d2), "separation_cm": sep, "hd_separation_deg": hd, "common_n": F.least("na", "nb")})
    return j.filter((F.col("rms_cm") <= rms_cm) & (sep >= min_sep) & (hd >= min_hd)).select(*session, "a", "b", "rms_cm", "separation_cm", "hd_separation_deg", "common_n")


def greedy_match(pairs: DataFrame, session: list[str], score: str) -> DataFrame:
    """One-to-one matching in score order (ties by a, then b).

    A pair that is the best remaining one for both ends is what the serial greedy would take next for them, so
    each round takes all such pairs at once; the loop ends when nothing is left. Rounds are checkpointed.
    """
    rest = cut_lineage(pairs.select(*session, "a", "b", score))
    done = None
    while not rest.isEmpty():
        o = F.struct(F.col(score), F.col("a"), F.col("b"))
        ends = rest.select(*session, F.explode(F.array("a", "b")).alias("s"), o.alias("o")).groupBy(*session, "s").agg(F.min("o").alias("best"))
        ea = ends.select(*session, F.col("s").alias("a"), F.col("best").alias("ba"))
        eb = ends.select(*session, F.col("s").alias("b"), F.col("best").alias("bb"))
        j = rest.join(ea, [*session, "a"]).join(eb, [*session, "b"])
        win = cut_lineage(j.filter((o == F.col("ba")) & (o == F.col("bb"))).select(*session, "a", "b", score))
        used = win.select(*session, F.explode(F.array("a", "b")).alias("s"))
        rest = cut_lineage(rest.join(used.withColumnRenamed("s", "a"), [*session, "a"], "left_anti").join(used.withColumnRenamed("s", "b"), [*session, "b"], "left_anti").select(*session, "a", "b", score))
        done = win if done is None else done.unionByName(win)
    return done if done is not None else rest


def cv_lookup(frames: DataFrame, counts: DataFrame, session: list[str], unit: list[str], *, folds: int, guard_s: float, n_bins: int, trial: DataFrame, t: str = "t") -> DataFrame:
    """Training rate per fold and heading bin, outside the fold and its guard.

    Exposure and counts are first summed per heading bin and fold slot; the held-out sums are then total minus
    what lies inside [start - guard, end + guard), so frames are fanned to at most a few folds.
    """
    hb = F.least(F.floor(F.col("hd") / (360.0 / n_bins)).cast("int"), F.lit(n_bins - 1))
    D = (F.col("t1") - F.col("t0")) / folds

    def blocked(df):
        lo = F.greatest(F.ceil((F.col(t) - guard_s - F.col("t0")) / D).cast("int") - 1, F.lit(0))
        hi = F.least(F.floor((F.col(t) + guard_s - F.col("t0")) / D).cast("int"), F.lit(folds - 1))
        f = df.join(trial, session).withColumn("bin", hb).withColumn("fold", F.explode(F.sequence(lo, hi)))
        s, e = F.col("t0") + F.col("fold") * D, F.col("t0") + (F.col("fold") + 1) * D
        return f.filter((F.col(t) >= s - guard_s) & (F.col(t) < e + guard_s))

    ef = blocked(frames).groupBy(*session, "fold", "bin").agg(F.count(F.lit(1)).alias("_ob"))
    et = frames.withColumn("bin", hb).groupBy(*session, "bin").agg(F.count(F.lit(1)).alias("_ot"))
    cf = blocked(counts).groupBy(*session, *unit, "fold", "bin").agg(F.sum("n").alias("_cb"))
    ct = counts.withColumn("bin", hb).groupBy(*session, *unit, "bin").agg(F.sum("n").alias("_ct"))
    occ = et.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).join(ef, [*session, "fold", "bin"], "left")
    occ = occ.withColumn("train_n", F.col("_ot") - F.coalesce("_ob", F.lit(0)))
    units = ct.select(*session, *unit).distinct()
    j = units.join(occ, session).join(ct, [*session, *unit, "bin"], "left").join(cf, [*session, *unit, "fold", "bin"], "left")
    n = F.coalesce("_ct", F.lit(0)) - F.coalesce("_cb", F.lit(0))
    return j.select(*session, *unit, "fold", "bin", F.when(F.col("train_n") > 0, n / F.col("train_n")).alias("expected_per_frame"))


def poisson_draw(lam, u) -> Column:
    """Inverse Poisson CDF at u by a running sum that ends 12 SD above the mean; for means up to a few hundred."""
    # lam and u ride in the accumulator, so they are evaluated once per row and not in every step
    z = F.struct(col(lam).alias("l"), col(u).alias("u"), F.exp(-col(lam)).alias("p"), F.exp(-col(lam)).alias("c"), F.lit(0).alias("k"))

    def step(acc, i):
        p = acc["p"] * acc["l"] / i
        return F.struct(acc["l"].alias("l"), acc["u"].alias("u"), p.alias("p"), (acc["c"] + p).alias("c"),
                        F.when(acc["u"] > acc["c"], i).otherwise(acc["k"]).cast("int").alias("k"))

    top = F.ceil(col(lam) + 12.0 * F.sqrt(col(lam)) + 12.0).cast("int")
    return F.when(col(lam).isNotNull(), F.aggregate(F.sequence(F.lit(1), F.coalesce(top, F.lit(1))), z, step)["k"])


def poisson_counts(mean: float, u: np.ndarray) -> np.ndarray:
    """Inverse Poisson CDF at every u, for any mean: the terms within 12 SD of it."""
    if mean <= 0:
        return np.zeros(len(u), np.int64)
    far = 12.0 * math.sqrt(mean) + 12.0
    k = np.arange(max(0, math.floor(mean - far)), math.ceil(mean + far) + 1)
    log = k[0] * math.log(mean) - mean - math.lgamma(k[0] + 1) + np.append(0.0, np.cumsum(math.log(mean) - np.log(k[1:])))
    return k[0] + np.minimum(np.searchsorted(np.cumsum(np.exp(log)), u, "left"), len(k) - 1)


def hashed_uniforms(text: str, n: int) -> np.ndarray:
    """Uniform numbers of the replicates 0 to n - 1 of a text: splitmix64 from its md5, so they depend on nothing else."""
    x = np.uint64(int(hashlib.md5(text.encode()).hexdigest()[:16], 16)) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / 2.0**53


def _summed(states: DataFrame, keys: list[str], cell: list[str], n: str, lam: str) -> DataFrame:
    m = F.col(n) * F.col(lam)
    return states.filter(m.isNotNull()).groupBy(*keys, *cell).agg(F.sum(m).alias("_mean"))


def _key(seed: int, *parts: str) -> Column:
    return F.concat_ws("|", F.lit(str(seed)), *[F.col(p).cast("string") for p in parts])


def poisson_null(states: DataFrame, keys: list[str], cell: list[str], n: str, lam: str, *, n_sim: int, seed: int) -> DataFrame:
    """Simulated counts per replicate and cell from per-frame expectations.

    `states` holds, per unit and cell (heading bin, map bin, ...), the number n of frames and their common expectation. The
    sum of independent Poisson counts is Poisson with the summed mean, so one draw per cell stands for all frames of its
    states. Draws are made in the row of a cell after the only shuffle.
    """
    @F.pandas_udf("array<long>")
    def draws(text: pd.Series, mean: pd.Series) -> pd.Series:
        return pd.Series([poisson_counts(m, hashed_uniforms(t, n_sim)) for t, m in zip(text, mean)], dtype=object)

    r = _summed(states, keys, cell, n, lam).withColumn("_n", draws(_key(seed, *keys, *cell), F.col("_mean")))
    return r.select(F.posexplode("_n").alias("sim", "n"), *keys, *cell).select("sim", *keys, *cell, "n")


def poisson_strengths(states: DataFrame, keys: list[str], cell: str, n: str, lam: str, occupancy: DataFrame, within: list[str], n_bins: int, *, n_sim: int, seed: int) -> DataFrame:
    """(keys, null): per unit the vector lengths of n_sim maps of poisson_null() counts over heading bins, NULL for a map without a count.

    `occupancy` has the exposure `o` per `within` and `cell`. A unit's cells are one row, so no replicate is a row of a table.
    """
    angle = np.radians((np.arange(n_bins) + 0.5) * (360.0 / n_bins))

    @F.pandas_udf("array<double>")
    def strengths(text: pd.Series, bins: pd.Series, means: pd.Series, seen: pd.Series) -> pd.Series:
        out = []
        for t, b, m, o in zip(text, bins, means, seen):
            rate = np.array([poisson_counts(x, hashed_uniforms(f"{t}|{c}", n_sim)) for c, x in zip(b, m)]) / np.asarray(o, float)[:, None]
            w = rate.sum(axis=0)
            with np.errstate(invalid="ignore"):
                r = np.minimum(np.hypot(np.cos(angle[b]) @ rate, np.sin(angle[b]) @ rate) / w, 1.0)
            out.append([float(v) if x > 0 else None for v, x in zip(r, w)])
        return pd.Series(out, dtype=object)

    r = _summed(states, keys, [cell], n, lam).join(occupancy.select(*within, cell, "o"), [*within, cell])
    r = r.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(cell).alias("b"), F.col("_mean").alias("m"), F.col("o").cast("double").alias("o")))).alias("_c"))
    return r.select(*keys, strengths(_key(seed, *keys), F.col("_c.b"), F.col("_c.m"), F.col("_c.o")).alias("null"))
