"""Tuning curves: counts and exposure per bin, rates, and per-unit strength statistics."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.angles import col, cosd, sind, direction, unit_clip
from ..functions.bins import angle_bin, fan_bins, even_bin
from ..functions import special
from .dense import dense_fixed


def dense_units(df: DataFrame, keys: list[str], n: int, name: str = "bin") -> DataFrame:
    """Every key with every bin 0..n-1."""
    return fan_bins(df.select(*keys).distinct(), n, name)


def bin_exposure(frames: DataFrame, keys: list[str], angle: str, n: int, fs: float, name: str = "bin") -> DataFrame:
    """Seconds per angle bin from samples at a fixed rate."""
    b = angle_bin(angle, n).alias(name)
    return frames.filter(F.col(angle).isNotNull()).groupBy(*keys, b).agg((F.count(F.lit(1)) / fs).alias("occ_s"))


def rate_curve(spike_angles: DataFrame, keys: list[str], angle: str, exposure: DataFrame, n: int,
               exposure_keys: list[str] | None = None) -> DataFrame:
    """Counts / exposure on a dense grid; unvisited bins keep a NULL rate, silent visited bins are 0."""
    ek = exposure_keys or []
    counts = (spike_angles.filter(F.col(angle).isNotNull())
              .groupBy(*keys, angle_bin(angle, n).alias("bin")).agg(F.count(F.lit(1)).alias("n_spikes")))
    dense = dense_fixed(counts, keys, {"bin": n}, ["n_spikes"], fill=0)
    return (dense.join(exposure, [*ek, "bin"], "left")
            .withColumn("rate_hz", F.when(F.col("occ_s") > 0, F.col("n_spikes") / F.col("occ_s"))))


def tuning_curve(spikes: DataFrame, frames: DataFrame, session: list[str], unit: list[str], *, t: str, ft: str,
                 angle: str, n: int, fs: float, width: float, tie: str = "earlier") -> DataFrame:
    """Nearest-frame heading of every spike, then counts, exposure and rate per bin."""
    from .asof import asof_nearest
    ok = frames.filter(F.col(angle).isNotNull())
    hit = asof_nearest(spikes, ok, session, t, ft, [angle], tie=tie, width=width)
    return rate_curve(hit, [*session, *unit], angle, bin_exposure(ok, session, angle, n, fs), n, session)


def rebin_counts(curve: DataFrame, keys: list[str], group: int, *, count: str = "n_spikes", seconds: str = "occ_s") -> DataFrame:
    """Sum counts and seconds over `group` adjacent bins, then divide."""
    g = F.floor(F.col("bin") / group).cast("int").alias("bin")
    return (curve.groupBy(*keys, g).agg(F.sum(count).alias(count), F.sum(seconds).alias(seconds))
            .withColumn("rate_hz", F.when(F.col(seconds) > 0, F.col(count) / F.col(seconds))))


def paired_feature_tuning(samples: DataFrame, keys: list[str], feats: dict[str, tuple[float, float, int]]) -> DataFrame:
    """Counts of several features on the rows where all of them are measured, so totals agree."""
    ok = samples
    for f in feats:
        ok = ok.filter(F.col(f).isNotNull())
    parts = F.array(*[F.struct(F.lit(f).alias("feature"), even_bin(f, lo, w, n).alias("bin"))
                      for f, (lo, w, n) in feats.items()])
    long = ok.select(*keys, F.explode(parts).alias("p")).select(*keys, "p.*")
    return long.groupBy(*keys, "feature", "bin").agg(F.count(F.lit(1)).alias("n_spikes"))


def vector_stats(curve: DataFrame, keys: list[str], n: int, *, rate: str = "rate_hz") -> DataFrame:
    """Rate-weighted vector length and preferred direction over measured bins."""
    th = (F.col("bin") + 0.5) * (360.0 / n)
    s = curve.groupBy(*keys).agg(F.sum(F.col(rate) * cosd(th)).alias("_c"), F.sum(F.col(rate) * sind(th)).alias("_s"),
                                 F.sum(rate).alias("_w"), F.count(rate).alias("n_bins"))
    mvl = unit_clip(F.hypot("_c", "_s") / F.col("_w"))
    return s.select(*keys, "n_bins", F.when(F.col("_w") > 0, mvl).alias("mvl"),
                    F.when(F.col("_w") > 0, direction(F.col("_c"), F.col("_s"))).alias("preferred_deg"))


def mean_resultant(df: DataFrame, keys: list[str], angle: str) -> DataFrame:
    """|mean exp(i theta)| over measured angles."""
    a = df.groupBy(*keys).agg(F.count(angle).alias("n"), F.avg(cosd(angle)).alias("_c"), F.avg(sind(angle)).alias("_s"))
    return a.select(*keys, "n", unit_clip(F.hypot("_c", "_s")).alias("mrl"))


def rayleigh_uniformity(df: DataFrame, keys: list[str], angle: str) -> DataFrame:
    """n, r, z and the finite-n p of a one-angle-per-row sample."""
    m = mean_resultant(df, keys, angle).withColumnRenamed("mrl", "r")
    return m.withColumn("z", F.col("n") * F.col("r") * F.col("r")).withColumn("p", special.rayleigh_p("n", "r"))


def rayleigh_occupancy(curve: DataFrame, keys: list[str], n: int, *, count: str = "n_spikes", seconds: str = "occ_s") -> DataFrame:
    """Two-degree Poisson score test of cos/sin modulation with exposure as offset; singular designs give NULL."""
    th = (F.col("bin") + 0.5) * (360.0 / n)
    v = curve.filter(F.col(seconds) > 0).withColumns({"_c": cosd(th), "_s": sind(th), "_w": F.col(seconds), "_n": F.col(count).cast("double")})
    w = v.groupBy(*keys).agg(
        F.sum("_w").alias("W"), F.sum("_n").alias("N"), F.count(F.lit(1)).alias("b"),
        *[F.sum(F.col("_w") * e).alias(a) for a, e in
          {"wc": F.col("_c"), "ws": F.col("_s"), "wcc": F.col("_c") ** 2, "wss": F.col("_s") ** 2, "wcs": F.col("_c") * F.col("_s")}.items()],
        F.sum(F.col("_n") * F.col("_c")).alias("nc"), F.sum(F.col("_n") * F.col("_s")).alias("ns"))
    W, N = F.col("W"), F.col("N")
    mc, ms = F.col("wc") / W, F.col("ws") / W
    a, d, b = N * (F.col("wcc") / W - mc * mc), N * (F.col("wss") / W - ms * ms), N * (F.col("wcs") / W - mc * ms)
    u, v2 = F.col("nc") - N * mc, F.col("ns") - N * ms
    det = a * d - b * b
    ok = (N > 0) & (F.col("b") >= 3) & (det > 1e-12 * (a + d) * (a + d))
    score = F.when(ok, (d * u * u - 2.0 * b * u * v2 + a * v2 * v2) / det)
    return w.select(*keys, score.alias("score")).withColumn("p", F.exp(-F.col("score") / 2.0))


def kappa_table(stats: DataFrame, r: str = "mvl", cut: float | None = None) -> DataFrame:
    """Concentration value and the inclusive cutoff flag (the flag needs only r, as A is increasing)."""
    rc = special.KAPPA_CUT_RESULTANT if cut is None else cut
    return stats.withColumn("kappa", special.kappa_from_resultant(r)).withColumn("kappa_pass", F.col(r) >= rc)


def classify_hd(stats: DataFrame, rayleigh_p: str, shuffle_p: str, kappa_pass: str, alpha: float = 0.01) -> DataFrame:
    """Class 0-3; NULL when either test is missing. An unavailable kappa never reaches class 3."""
    hits = (F.col(rayleigh_p) <= alpha).cast("int") + (F.col(shuffle_p) <= alpha).cast("int")
    return stats.withColumn("hd_class", F.when(hits.isNull(), F.lit(None).cast("int"))
                            .when((hits == 2) & F.coalesce(F.col(kappa_pass), F.lit(False)), F.lit(3)).otherwise(hits))


def class_counts(classes: DataFrame, group: list[str], cls: str = "hd_class") -> DataFrame:
    return classes.groupBy(*group, cls).agg(F.count(F.lit(1)).alias("n_units"))


def information_content(curve: DataFrame, keys: list[str], *, rate: str = "rate_hz", seconds: str = "occ_s",
                        map_mean: bool = False) -> DataFrame:
    """Bits per spike: sum p * (rate/mean) * log2(rate/mean); map_mean uses the plain mean over cells."""
    m = curve.filter(F.col(rate).isNotNull() & (F.col(seconds) > 0))
    tot = m.groupBy(*keys).agg(
        F.sum(seconds).alias("_T"), F.sum(F.col(rate) * F.col(seconds)).alias("_RT"), F.avg(rate).alias("_avg"),
        F.sum(F.when(F.col(rate) > 0, F.col(seconds) * F.col(rate) * F.log2(rate)).otherwise(0.0)).alias("_L"))
    # sum p*(r/m)*log2(r/m) = (sum s*r*log2 r - log2(m) * sum s*r) / (T*m)
    mean = F.col("_avg") if map_mean else F.col("_RT") / F.col("_T")
    bits = (F.col("_L") - F.log2(mean) * F.col("_RT")) / (F.col("_T") * mean)
    return tot.select(*keys, F.when(mean > 0, bits).alias("bits"))


def min_occupancy_mask(curve: DataFrame, floor_s: float) -> DataFrame:
    return curve.withColumn("rate_hz", F.when(F.col("occ_s") >= floor_s, F.col("rate_hz")))


def map2d(rows: DataFrame, keys: list[str], x: str, y: str, extent: float, n: int) -> DataFrame:
    """Counts on an n x n position grid."""
    w = extent / n
    return (rows.select(*keys, even_bin(x, 0.0, w, n).alias("x_bin"), even_bin(y, 0.0, w, n).alias("y_bin"))
            .filter("x_bin IS NOT NULL AND y_bin IS NOT NULL").groupBy(*keys, "x_bin", "y_bin").agg(F.count(F.lit(1)).alias("n")))


def spatial_coverage(exposure: DataFrame, keys: list[str], nx: int, ny: int, circle: tuple[float, float, float] | None = None,
                     bin_cm: float = 2.5) -> DataFrame:
    """Share of arena bins with any exposure; a circular arena counts only bins with centers inside it."""
    xc, yc = (F.col("x_bin") + 0.5) * bin_cm, (F.col("y_bin") + 0.5) * bin_cm
    if circle:
        cx, cy, r = circle
        inside = (xc - cx) ** 2 + (yc - cy) ** 2 <= r * r
        exposure = exposure.filter(inside)
        total = sum(1 for i in range(nx) for j in range(ny)
                    if ((i + .5) * bin_cm - cx) ** 2 + ((j + .5) * bin_cm - cy) ** 2 <= r * r)
    else:
        total = nx * ny
    seen = exposure.groupBy(*keys, "x_bin", "y_bin").agg(F.sum("dur_s").alias("s")).filter("s > 0")
    return seen.groupBy(*keys).agg((F.count(F.lit(1)) / F.lit(float(total))).alias("coverage"))


def circular_curve_summary(curve: DataFrame, keys: list[str], n: int, guard: int = 1) -> DataFrame:
    """Peak, range width above the median around the peak, and background rate outside range and guard.

    The range is the circular run of above-median bins holding the peak bin.
    """
    g = curve.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("bin", "rate_hz"))).alias("c"),
                                 F.percentile("rate_hz", F.lit(0.5)).alias("median"),
                                 F.max_by("bin", F.struct(F.col("rate_hz"), -F.col("bin"))).alias("peak_bin"),
                                 F.max("rate_hz").alias("peak_rate"))
    r = F.transform(F.col("c"), lambda e: e["rate_hz"])
    at = lambda i: F.element_at(r, (F.pmod(i, F.lit(n)) + 1).cast("int"))
    steps = F.sequence(F.lit(1), F.lit(n - 1))
    above = lambda sgn: F.coalesce(F.array_min(F.filter(steps, lambda d: ~F.coalesce(at(F.col("peak_bin") + sgn * d) > F.col("median"), F.lit(False)))) - 1, F.lit(n - 1))
    g = g.withColumn("right", above(1)).withColumn("left", above(-1))
    width = F.least(F.col("left") + F.col("right") + 1, F.lit(n))
    out = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda b: (
        (F.pmod(b - F.col("peak_bin"), F.lit(n)) > F.col("right") + guard)
        & (F.pmod(F.col("peak_bin") - b, F.lit(n)) > F.col("left") + guard)))
    vals = F.filter(F.transform(out, lambda b: at(b)), lambda v: v.isNotNull())
    bg = F.when(F.size(vals) > 0, F.aggregate(vals, F.lit(0.0), lambda a, v: a + v) / F.size(vals))
    return g.select(*keys, "peak_bin", "peak_rate", "median", width.cast("int").alias("width_bins"), bg.alias("background_rate"))
