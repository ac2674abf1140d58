"""Correlograms, spectra, band-pass phase and phase statistics."""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.angles import col, unit_clip, wrap_pi
from ..functions.special import rayleigh_p
from .asof import neighbours
from .dense import dense_fixed
from .ordered import halo, islands, sequence


# ---- correlograms ----
def acg(spikes: DataFrame, keys: list[str], t: str, *, bin_s: float, max_lag_s: float) -> DataFrame:
    """Positive half of the autocorrelogram: lag index 0..radius with centred bins; no self pairs, coincidences count twice.

    Equal times are first merged into one row with a multiplicity. Times are cut into stretches of one maximum
    lag and only meet their own and the next stretch, so a busy unit spreads over its time axis. A stretch and the
    next one are one row with a sorted array, in which the border of every lag bin is searched for every time: the
    work grows with times and bins and not with pairs.
    """
    size, has = int(math.floor(max_lag_s / bin_s + 0.5)) + 1, F.col(t).isNotNull() & ~F.isnan(F.col(t).cast("double"))
    for k in keys:
        has = has & F.col(k).isNotNull()
    e = spikes.filter(has).groupBy(*keys, F.col(t).alias("_t")).agg(F.count(F.lit(1)).alias("_m"))
    b = F.floor(F.col("_t") / max_lag_s).cast("long")
    both = e.withColumn("_b", F.explode(F.array(b, b - 1)))
    g = both.groupBy(*keys, "_b").agg(F.sort_array(F.collect_list(F.struct(F.col("_t").cast("double").alias("t"), F.col("_m").alias("m"), (F.col("_b") == b).alias("own")))).alias("_s"))

    @F.pandas_udf("array<bigint>")
    def counted(times: pd.Series, many: pd.Series, own: pd.Series) -> pd.Series:
        if not len(times):
            return pd.Series([], dtype=object)
        ends = np.cumsum([len(x) for x in times])
        return pd.Series(list(lag_counts(np.concatenate(times.to_list()), np.concatenate(many.to_list()), np.concatenate(own.to_list()).astype(bool), ends, bin_s, max_lag_s, size)))

    c = g.filter(F.exists("_s", lambda x: x["own"])).select(*keys, counted("_s.t", "_s.m", "_s.own").alias("_c"))
    n = c.select(*keys, F.posexplode("_c").alias("lag", "n")).groupBy(*keys, "lag").agg(F.sum("n").alias("n")).filter("n > 0")
    return n.withColumn("n", F.when(F.col("lag") == 0, F.col("n") * 2).otherwise(F.col("n")))


def lag_counts(t: np.ndarray, m: np.ndarray, own: np.ndarray, ends: np.ndarray, bin_s: float, max_lag_s: float, size: int) -> np.ndarray:
    """(groups x lags) pairs of an own time and a time behind it in its group, up to ends; times rise within a group and stand for m equal ones."""
    i = np.flatnonzero(own)
    group = np.searchsorted(ends, i, "right")
    at, weight, before = t[i], m[i], np.concatenate(([0], np.cumsum(m)))

    def border(low: np.ndarray, high: np.ndarray, inside) -> np.ndarray:
        """The first place from low on whose distance is not inside; distances rise in floating point too, so this is exact."""
        low, high = low.copy(), high.copy()
        while (at_work := np.flatnonzero(low < high)).size:
            mid = (low[at_work] + high[at_work]) >> 1
            ok = inside(t[mid] - at[at_work])
            low[at_work] = np.where(ok, mid + 1, low[at_work])
            high[at_work] = np.where(ok, high[at_work], mid)
        return low

    last = border(i + 1, ends[group], lambda d: d <= max_lag_s)
    out, place = np.zeros((len(ends), size), np.int64), i + 1
    cuts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    for lag in range(size):
        nxt = border(place, last, lambda d: np.floor(d / bin_s + 0.5) <= lag) if lag + 1 < size else last
        n = weight * (before[nxt] - before[place])
        if lag == 0:
            n = n + weight * (weight - 1) // 2
        out[group[cuts], lag] = np.add.reduceat(n, cuts)
        place = nxt
    return out


def symmetric(half: DataFrame) -> DataFrame:
    """Both signs of the correlogram."""
    return half.withColumn("lag", F.explode(F.array_distinct(F.array("lag", -F.col("lag")))))


def correlogram_spectrum(half: DataFrame, keys: list[str], *, radius: int, n_fft: int | None = None, power: bool = False, detrend: bool = False) -> DataFrame:
    """|DFT| of the symmetric correlogram per unit; each unit's correlogram is one short array."""
    size = 2 * radius + 1
    nf = n_fft or size

    @F.pandas_udf("array<double>")
    def spectrum(lags: pd.Series, counts: pd.Series) -> pd.Series:
        x = np.zeros((len(lags), size))
        for i, (l, c) in enumerate(zip(lags, counts)):
            l, c = np.asarray(l), np.asarray(c, dtype=float)
            x[i, radius + l] = c
            x[i, radius - l] = c
        if detrend:
            x -= x.mean(axis=1, keepdims=True)
        s = np.abs(np.fft.rfft(x, n=nf, axis=1))
        return pd.Series(list(s ** 2 if power else s))

    g = half.groupBy(*keys).agg(F.collect_list(F.struct("lag", "n")).alias("_c"))
    s = g.withColumn("_s", spectrum(F.col("_c.lag"), F.col("_c.n")))
    return s.select(*keys, F.posexplode("_s").alias("k", "spectrum"))


def spectral_index(spec: DataFrame, keys: list[str], *, df: float, band: tuple[float, float], half_width: float, references: list[tuple[float, float]]) -> DataFrame:
    """Peak in the band (first on ties), mean around it over the mean of the reference bands together, and each band's mean."""
    f = F.col("k") * df
    s = spec.withColumn("f", f)
    inb = (F.col("f") >= band[0]) & (F.col("f") <= band[1])
    pk = s.groupBy(*keys).agg(F.max_by("f", F.when(inb, F.struct(F.col("spectrum"), -F.col("k")))).alias("peak_f"))
    refs = [(F.col("f") >= a) & (F.col("f") <= b) for a, b in references]
    any_ref = refs[0]
    for r in refs[1:]:
        any_ref = any_ref | r
    g = s.join(pk, keys).groupBy(*keys, "peak_f").agg(
        F.avg(F.when(F.abs(F.col("f") - F.col("peak_f")) <= half_width, F.col("spectrum"))).alias("peak_mean"), F.avg(F.when(any_ref, F.col("spectrum"))).alias("reference_mean"),
        *[F.avg(F.when(r, F.col("spectrum"))).alias(f"band{i}_mean") for i, r in enumerate(refs)])
    ok = F.col("reference_mean") > 0
    return g.withColumn("index", F.when(ok, F.col("peak_mean") / F.col("reference_mean"))).withColumn("peak_f", F.when(ok, F.col("peak_f")))


def rhythmicity(spikes: DataFrame, keys: list[str], unit: list[str], t: str, *, bin_s: float = 0.002, max_lag_s: float = 2.0, band=(4.0, 11.0), half_width: float = 1.0,
                reference=(0.0, 125.0), threshold: float = 5.0) -> DataFrame:
    """Correlogram inside segments, summed per unit, its spectrum and the band index; rhythmic when index >= threshold."""
    radius = int(round(max_lag_s / bin_s))
    half = acg(spikes, keys, t, bin_s=bin_s, max_lag_s=max_lag_s).groupBy(*unit, "lag").agg(F.sum("n").alias("n"))
    spec = correlogram_spectrum(half, unit, radius=radius)
    s = spectral_index(spec, unit, df=1.0 / ((2 * radius + 1) * bin_s), band=band, half_width=half_width, references=[reference])
    n = spikes.groupBy(*unit).agg(F.count(F.lit(1)).alias("n_spikes"))
    return n.join(s, unit, "left").withColumn("rhythmic", F.coalesce(F.col("index") >= threshold, F.lit(False)))


def phase_precession(phases: DataFrame, keys: list[str], unit: list[str], cycles: str, *, bin_c: float = 0.01, max_lag_c: float = 4.0, band=(0.85, 1.3), half_width: float = 0.025,
                     references=((0.5, 0.85), (1.3, 1.8)), min_peak: int = 5, threshold: float = 1.5, n_fft: int = 8192) -> DataFrame:
    """The same on cumulative cycles: ratio to the stronger sideband, candidate when the peak lies above one cycle by half an independent bin."""
    radius = int(round(max_lag_c / bin_c))
    half = acg(phases, keys, cycles, bin_s=bin_c, max_lag_s=max_lag_c).groupBy(*unit, "lag").agg(F.sum("n").alias("n"))
    top = half.groupBy(*unit).agg(F.max("n").alias("peak_count"))
    spec = correlogram_spectrum(half, unit, radius=radius, n_fft=n_fft)
    s = spectral_index(spec, unit, df=1.0 / (n_fft * bin_c), band=band, half_width=half_width, references=list(references)).join(top, unit)
    den = F.greatest(*[F.col(f"band{i}_mean") for i in range(len(references))])
    s = s.withColumn("index", F.when(den > 0, F.col("peak_mean") / den))
    margin = 1.0 / (2 * max_lag_c + bin_c) / 2
    ok = (F.col("peak_count") > min_peak) & F.col("index").isNotNull()
    return s.withColumn("eligible", ok).withColumn("candidate", ok & F.coalesce((F.col("index") >= threshold) & (F.col("peak_f") > 1.0 + margin), F.lit(False)))


def welch_psd(samples: DataFrame, keys: list[str], idx: str, value: str, *, nwin: int, fs: float) -> DataFrame:
    """Mean Hann periodogram of complete finite blocks, constant detrend, one-sided density. A block is one array row."""
    @F.pandas_udf("array<double>")
    def periodogram(blocks: pd.Series) -> pd.Series:
        x = np.stack([np.asarray(b, dtype=float) for b in blocks]) if len(blocks) else np.zeros((0, nwin))
        w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(nwin) / nwin)
        p = np.abs(np.fft.rfft((x - x.mean(axis=1, keepdims=True)) * w, axis=1)) ** 2 / (fs * (w ** 2).sum())
        p[:, 1:(nwin + 1) // 2] *= 2
        return pd.Series(list(p))

    b = samples.filter(F.col(value).isNotNull()).groupBy(*keys, F.floor(F.col(idx) / nwin).alias("block")).agg(
        F.count(F.lit(1)).alias("_n"), F.sort_array(F.collect_list(F.struct(F.col(idx).alias("i"), F.col(value).alias("v")))).alias("_x"))
    b = b.filter(F.col("_n") == nwin).withColumn("_p", periodogram(F.col("_x.v")))
    return (b.select(*keys, "block", F.posexplode("_p").alias("k", "p")).groupBy(*keys, "k").agg(F.avg("p").alias("psd"), F.count(F.lit(1)).alias("n_blocks"))
            .withColumn("f", F.col("k") * (fs / nwin)))


def band_power_fraction(psd: DataFrame, keys: list[str], band: tuple[float, float], reference: tuple[float, float], df: float) -> DataFrame:
    """Trapezoid power of a band over that of the reference band (even frequency steps)."""
    def trap(lo, hi):
        ins = (F.col("f") >= lo - 1e-12) & (F.col("f") <= hi + 1e-12)
        s, a, z = F.sum(F.when(ins, F.col("psd"))), F.min_by("psd", F.when(ins, F.col("k"))), F.max_by("psd", F.when(ins, F.col("k")))
        return (s - (a + z) / 2) * df
    return psd.groupBy(*keys).agg(trap(*band).alias("_b"), trap(*reference).alias("_r")).select(*keys, (F.col("_b") / F.col("_r")).alias("fraction"))


# ---- filters and phase ----
def analytic_kernel(fs: float, lo: float, hi: float, half: int) -> tuple[list[float], list[float]]:
    """Hamming low-pass of the half band moved to the centre frequency: quadrature pair of FIR taps."""
    f0, fc = (lo + hi) / 2, (hi - lo) / 2
    re, im = [], []
    for n in range(-half, half + 1):
        sinc = 2 * fc / fs if n == 0 else math.sin(2 * math.pi * fc * n / fs) / (math.pi * n)
        w = 0.54 + 0.46 * math.cos(math.pi * n / half)
        re.append(2 * sinc * w * math.cos(2 * math.pi * f0 * n / fs))
        im.append(2 * sinc * w * math.sin(2 * math.pi * f0 * n / fs))
    return re, im


def lowpass_kernel(fs: float, cut: float, half: int) -> list[float]:
    t = [(2 * cut / fs if n == 0 else math.sin(2 * math.pi * cut * n / fs) / (math.pi * n)) * (0.54 + 0.46 * math.cos(math.pi * n / half)) for n in range(-half, half + 1)]
    s = sum(t)
    return [x / s for x in t]


def fir(samples: DataFrame, keys: list[str], idx: str, value: str, kernels: dict[str, list[float]], *, bucket: int) -> DataFrame:
    """Convolve with symmetric-length FIR kernels; rows without the full neighbourhood get NULL (edge exclusion)."""
    half = (len(next(iter(kernels.values()))) - 1) // 2
    h = halo(samples, keys, idx, half, bucket, {"_w": lambda w: F.collect_list(F.struct(F.col(idx).alias("i"), F.col(value).cast("double").alias("v"))).over(w)})
    full = F.size("_w") == 2 * half + 1
    out = {}
    for name, taps in kernels.items():
        arr = F.array(*[F.lit(float(x)) for x in reversed(taps)])  # y[n] = sum h[m] x[n - m]
        out[name] = F.when(full, F.aggregate(F.zip_with("_w", arr, lambda e, k: e["v"] * k), F.lit(0.0), lambda a, b: a + b))
    return h.withColumns(out).drop("_w")


def band_phase(samples: DataFrame, keys: list[str], idx: str, value: str, *, fs: float, band: tuple[float, float], half: int, bucket: int) -> DataFrame:
    """Phase and amplitude inside gap-free, non-constant runs; segment is NULL near run ends. `half` is the edge exclusion too."""
    from ..session import cut_lineage
    ok = samples.filter(F.col(value).isNotNull())
    r = cut_lineage(islands(ok, keys, [idx], F.col("_p").isNull() | (F.col(idx) - F.col("_p") > 1), width=float(bucket), lag={"_p": idx}))
    flat = r.groupBy(*keys, "run_id").agg((F.max(value) == F.min(value)).alias("_flat"))
    r = r.join(flat, [*keys, "run_id"]).filter("NOT _flat").drop("_flat")
    re, im = analytic_kernel(fs, *band, half)
    f = fir(r, [*keys, "run_id"], idx, value, {"re": re, "im": im}, bucket=bucket)
    f = f.withColumn("phase_rad", F.atan2("im", "re")).withColumn("amplitude", F.hypot("re", "im")).withColumn("segment_id", F.when(F.col("re").isNotNull(), F.col("run_id")))
    return f.drop("re", "im", "run_id")


def fir_decimate(samples: DataFrame, keys: list[str], idx: str, value: str, q: int, *, half: int, bucket: int) -> DataFrame:
    """Anti-alias low-pass at 0.8 of the new Nyquist, then every q-th sample."""
    f = fir(samples, keys, idx, value, {"_y": lowpass_kernel(1.0, 0.4 / q, half)}, bucket=bucket)
    return f.filter((F.col(idx) % q == 0) & F.col("_y").isNotNull()).select(*keys, (F.col(idx) / q).cast("long").alias(idx), F.col("_y").alias(value))


def sample_phase(spikes: DataFrame, phase: DataFrame, session: list[str], t: str, pt: str, *, width: float) -> DataFrame:
    """Interpolated unwrapped phase at event times inside one segment, NULL across gaps."""
    nb = neighbours(spikes, phase, session, t, pt, ["segment_id", "unwrapped_rad"], width=width)
    p, n = F.col("_prev"), F.col("_next")
    exact = p["t"] == F.col(t)
    inside = p["segment_id"].isNotNull() & (exact | (p["segment_id"] == n["segment_id"]))
    y = F.when(exact, p["unwrapped_rad"]).otherwise(p["unwrapped_rad"] + (F.col(t) - p["t"]) * (n["unwrapped_rad"] - p["unwrapped_rad"]) / (n["t"] - p["t"]))
    ok = F.coalesce(inside, F.lit(False))
    out = nb.withColumn("unwrapped_rad", F.when(ok, y)).withColumn("segment_id", F.when(ok, p["segment_id"]))
    return out.withColumn("phase_rad", wrap_pi("unwrapped_rad")).drop("_prev", "_next")


def phase_bin(rad, n: int) -> Column:
    b = F.floor((col(rad) + math.pi) / (2 * math.pi / n)).cast("int")
    return F.when(b.isNotNull(), F.least(b, F.lit(n - 1)))


def phase_exposure(phase: DataFrame, keys: list[str], t: str, n: int, *, width: float, weight: Column | None = None) -> DataFrame:
    """Seconds per phase bin: every sample interval counts once, at its midpoint phase."""
    s = sequence(phase.filter("segment_id IS NOT NULL"), [*keys, "segment_id"], [t], width=width, lead={"_nt": t, "_nu": "unwrapped_rad"}).filter("_nt IS NOT NULL")
    mid = wrap_pi((F.col("unwrapped_rad") + F.col("_nu")) / 2)
    return s.groupBy(*keys, phase_bin(mid, n).alias("bin")).agg(F.sum(F.col("_nt") - F.col(t)).alias("occ_s"))


def phase_histogram(sampled: DataFrame, exposure: DataFrame, session: list[str], unit: list[str], n: int) -> DataFrame:
    """Counts, exposure and rate per phase bin on the exposed bins."""
    K = [*session, *unit]
    c = sampled.filter("phase_rad IS NOT NULL").groupBy(*K, phase_bin("phase_rad", n).alias("bin")).agg(F.count(F.lit(1)).alias("n_spikes"))
    d = dense_fixed(c, K, {"bin": n}, ["n_spikes"], fill=0).join(exposure, [*session, "bin"], "left")
    return d.withColumn("rate_hz", F.when(F.col("occ_s") > 0, F.col("n_spikes") / F.col("occ_s")))


def phase_locking(sampled: DataFrame, keys: list[str], *, p_threshold: float = 0.01) -> DataFrame:
    """Vector length, preferred phase, pairwise consistency and Rayleigh p of spike phases."""
    p = F.col("phase_rad")
    g = sampled.groupBy(*keys).agg(F.count(p).alias("n"), F.count_if(p.isNull()).alias("n_excluded"), F.avg(F.cos(p)).alias("_c"), F.avg(F.sin(p)).alias("_s"))
    g = g.withColumn("mvl", unit_clip(F.hypot("_c", "_s"))).withColumn("preferred_rad", F.atan2("_s", "_c")).drop("_c", "_s")
    n, r = F.col("n"), F.col("mvl")
    g = g.withColumn("ppc", F.when(n > 1, (n * r * r - 1) / (n - 1))).withColumn("z", n * r * r)
    g = g.withColumn("p", unit_clip(rayleigh_p("n", "mvl", 1)))
    return g.withColumn("locked", F.coalesce(F.col("p") < p_threshold, F.lit(False)))


def analyze_theta(locking: DataFrame, rhythm: DataFrame, precession: DataFrame, keys: list[str], *, min_spikes: int) -> DataFrame:
    """One row per unit with gates and q values over assessed units only."""
    from .pairs import bh_fdr
    j = locking.join(rhythm, keys, "left").join(precession.select(*keys, F.col("index").alias("precession_index"), "candidate"), keys, "left")
    enough = F.col("n_spikes") > min_spikes
    j = j.withColumn("p", F.when(enough, F.col("p"))).withColumn("status", F.when(~F.coalesce(enough, F.lit(False)), "insufficient_spikes").otherwise("assessed"))
    return bh_fdr(j, [], "p")
