"""Tracking preparation: holds, runs, smoothing, speed, exposure, arena-centre features, and centre-cell tuning."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.angles import col, wrap360, cosd, sind, unit_clip
from ..functions.bins import even_bin, fan_bins
from ..functions.geometry import bearing_to
from ..functions.text import join_status
from ..session import cut_lineage
from .asof import asof_nearest
from .ordered import BUCKET, exact_quantile, halo, islands, sequence


def hold_last_in_bounds(frames: DataFrame, session: list[str], t: str, x: str, y: str, legal: Column, *, width: float) -> DataFrame:
    """An out-of-bounds point takes the last legal point; leading ones become missing; missing stays missing."""
    p = F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    here = F.col(x).isNotNull() & F.col(y).isNotNull()
    out = sequence(frames, session, [t], width=width, last={"_legal": F.when(here & legal, p)})
    out = out.withColumn("held", here & ~legal)
    return out.withColumn(x, F.when(here, F.col("_legal.x"))).withColumn(y, F.when(here, F.col("_legal.y"))).drop("_legal")


def median_gap(frames: DataFrame, session: list[str], t: str, *, width: float, gap_width: float | None = None) -> DataFrame:
    """Median frame interval per session."""
    g = sequence(frames.select(*session, t), session, [t], width=width, lag={"_p": t}).withColumn("_g", F.col(t) - F.col("_p"))
    return exact_quantile(g, session, "_g", 0.5, "dt", width=gap_width)


def frame_runs(frames: DataFrame, session: list[str], t: str, valid: str, *, width: float, gap_width: float | None = None, gap_factor: float = 1.5) -> DataFrame:
    """Exposure of every frame and the run id of valid frames (broken by an invalid frame or a gap > 1.5 median)."""
    dt = cut_lineage(median_gap(frames, session, t, width=width, gap_width=gap_width))
    f = sequence(frames, session, [t], width=width, lag={"_pt": t, "_pv": valid}, lead={"_nt": t}, keep_bucket=True).join(dt, session)
    half = lambda gap: F.when(gap <= gap_factor * F.col("dt"), gap / 2).otherwise(F.col("dt") / 2)
    gp, gn = F.col(t) - F.col("_pt"), F.col("_nt") - F.col(t)
    f = f.withColumn("exposure_left", F.col(t) - F.when(gp.isNull(), F.lit(0.0)).otherwise(half(gp)))
    f = f.withColumn("exposure_right", F.col(t) + F.when(gn.isNull(), F.lit(0.0)).otherwise(half(gn)))
    f = f.withColumn("exposure_s", F.col("exposure_right") - F.col("exposure_left"))
    brk = gp.isNull() | ~F.coalesce(F.col("_pv"), F.lit(False)) | (gp > gap_factor * F.col("dt"))
    f = f.withColumn("_brk", F.when(F.col(valid) & brk, 1).otherwise(0))
    f = cut_lineage(f.drop("_pt", "_pv", "_nt"))
    f = sequence(f, session, [t], width=width, cumsum={"run_id": "_brk"}).drop("_brk")
    return f.withColumn("run_id", F.when(F.col(valid), F.col("run_id")))


def boxcar_time(frames: DataFrame, keys: list[str], t: str, values: list[str], width_s: float, *, bucket_s: float) -> DataFrame:
    """Centred mean over width_s inside a run, truncated at its ends. Works on integer microseconds."""
    f = frames.withColumn("_us", F.round(F.col(t) * 1e6).cast("long"))
    half = int(round(width_s * 5e5))
    return halo(f, keys, "_us", half, int(bucket_s * 1e6), {f"{v}_smooth": (lambda w, v=v: F.avg(v).over(w)) for v in values}).drop("_us")


def gradient_speed(frames: DataFrame, keys: list[str], t: str, x: str, y: str, *, width: float) -> DataFrame:
    """Speed from the second-order non-uniform gradient, one-sided at run ends, missing for one-point runs."""
    f = sequence(frames, keys, [t], width=width, lag={"_t0": t, "_x0": x, "_y0": y}, lead={"_t2": t, "_x2": x, "_y2": y})

    def grad(c):
        a, b = F.col(t) - F.col("_t0"), F.col("_t2") - F.col(t)
        p, q, r = F.col(f"_{c}0"), F.col({"x": x, "y": y}[c]), F.col(f"_{c}2")
        mid = (a * a * r + (b * b - a * a) * q - b * b * p) / (a * b * (a + b))
        return F.when(a.isNotNull() & b.isNotNull(), mid).when(b.isNotNull(), (r - q) / b).when(a.isNotNull(), (q - p) / a)

    return f.withColumn("speed", F.hypot(grad("x"), grad("y"))).drop("_t0", "_x0", "_y0", "_t2", "_x2", "_y2")


def prepare(frames: DataFrame, session: list[str], *, t: str = "t", arena: tuple[float, float], smooth_s: float, speed_min: float,
            width: float, gap_width: float | None = None, tolerance: float = 1e-9, on_target_deg: float | None = None) -> DataFrame:
    """Frames with runs, smoothed position, speed, exposure, centre bearing/distance and the moving flag (strict).

    The bearing is NULL within `tolerance` of the centre; with `on_target_deg` it is taken everywhere, from that direction on the centre itself."""
    w, h = arena
    f = frames.withColumn("valid", F.col("valid") & F.coalesce((F.col("x") >= 0) & (F.col("x") <= w) & (F.col("y") >= 0) & (F.col("y") <= h), F.lit(False)))
    f = cut_lineage(frame_runs(f, session, t, "valid", width=width, gap_width=gap_width))
    ok = boxcar_time(f.filter("valid"), [*session, "run_id"], t, ["x", "y"], smooth_s, bucket_s=width)
    ok = cut_lineage(ok)
    ok = gradient_speed(ok, [*session, "run_id"], t, "x_smooth", "y_smooth", width=width)
    dist = F.hypot(F.lit(w / 2) - F.col("x_smooth"), F.lit(h / 2) - F.col("y_smooth"))
    ok = ok.withColumn("cd_cm", dist).withColumn(
        "cb_deg", F.when((dist > (tolerance if on_target_deg is None else -1.0)) & F.col("hd").isNotNull(),
                         bearing_to("x_smooth", "y_smooth", F.lit(w / 2), F.lit(h / 2), "hd", on_target_deg)))
    ok = ok.withColumn("moving", F.coalesce(F.col("speed") > speed_min, F.lit(False)))
    new = ["x_smooth", "y_smooth", "speed", "cd_cm", "cb_deg", "moving"]
    rest = f.filter("NOT valid").select(*f.columns, *[F.lit(None).cast(dict(ok.dtypes)[c]).alias(c) for c in new[:-1]], F.lit(False).alias("moving"))
    return ok.select(*f.columns, *new).unionByName(rest)


def assign_spikes(spikes: DataFrame, behavior: DataFrame, session: list[str], *, t: str = "t", ft: str = "t", cols: list[str], width: float) -> DataFrame:
    """Nearest frame (tie earlier) when that frame is valid and the spike lies in its exposure."""
    need = list(dict.fromkeys([*cols, "valid", "moving", "exposure_left", "exposure_right"]))
    hit = asof_nearest(spikes, behavior, session, t, ft, need, tie="earlier", width=width)
    ok = F.col("valid") & (F.col(t) >= F.col("exposure_left")) & (F.col(t) <= F.col("exposure_right"))
    drop = [c for c in ("exposure_left", "exposure_right") if c not in cols]
    return hit.filter(ok).drop("sample_t", *drop)


def feature_bins(max_dist: float, angle_deg: float = 3.0, dist_cm: float = 2.0) -> dict[str, tuple[str, float, int]]:
    import math
    n = int(round(360 / angle_deg))
    return {"hd": ("hd", angle_deg, n), "cb": ("cb_deg", angle_deg, n), "cd": ("cd_cm", dist_cm, max(1, math.ceil(max_dist / dist_cm)))}


def _fan(df: DataFrame, feats) -> DataFrame:
    arr = F.array(*[F.struct(F.lit(f).alias("feature"), even_bin(c, 0.0, w, n).alias("bin")) for f, (c, w, n) in feats.items()])
    return df.withColumn("_f", F.explode(arr)).select("*", "_f.*").drop("_f").filter("bin IS NOT NULL")


def center_exposure(behavior: DataFrame, session: list[str], trial: DataFrame, feats) -> DataFrame:
    """Moving exposure per feature bin, whole and by half of the trial (a frame at the midpoint is clipped)."""
    j = behavior.filter("moving").join(trial, session)
    mid = (F.col("t0") + F.col("t1")) / 2
    first = F.least(F.greatest(F.least("exposure_right", mid) - F.col("exposure_left"), F.lit(0.0)), F.col("exposure_s"))
    f = _fan(j.withColumn("_h1", first), feats)
    return f.groupBy(*session, "feature", "bin").agg(F.sum("exposure_s").alias("occ_s"), F.sum("_h1").alias("occ1_s"), F.sum(F.col("exposure_s") - F.col("_h1")).alias("occ2_s"))


def center_counts(assigned: DataFrame, session: list[str], unit: list[str], trial: DataFrame, feats, t: str = "t", extra: list[str] = ()) -> DataFrame:
    """Moving spikes per feature bin, whole and by half of the trial."""
    j = assigned.filter("moving").join(trial, session)
    f = _fan(j.withColumn("_first", F.col(t) < (F.col("t0") + F.col("t1")) / 2), feats)
    return f.groupBy(*extra, *session, *unit, "feature", "bin").agg(F.count(F.lit(1)).alias("n"), F.count_if("_first").alias("n1"), F.count_if(~F.col("_first")).alias("n2"))


def center_statistics(counts: DataFrame, exposure: DataFrame, session: list[str], unit: list[str], feats, *, angle_box: int = 5, dist_box: int = 3,
                      min_bins: int = 3, extra: list[str] = ()) -> DataFrame:
    """Strength (vector length or R2) and split-half stability per unit and feature.

    A curve is a bounded row: the bins of one unit and feature are packed into arrays, so smoothing, vectors,
    fits and correlations are evaluated in the row after a single shuffle.
    """
    K = [*extra, *session, *unit, "feature"]
    sizes = F.create_map(*[x for f, (_, _, n) in feats.items() for x in (F.lit(f), F.lit(n))])
    widths = F.create_map(*[x for f, (_, w, _) in feats.items() for x in (F.lit(f), F.lit(float(w)))])
    c = counts.groupBy(*K).agg(F.map_from_entries(F.collect_list(F.struct("bin", F.struct("n", "n1", "n2")))).alias("_c"))
    e = exposure.groupBy(*session, "feature").agg(F.map_from_entries(F.collect_list(F.struct("bin", F.struct("occ_s", "occ1_s", "occ2_s")))).alias("_e"))
    j = c.join(e, [*session, "feature"]).withColumn("_n", sizes[F.col("feature")]).withColumn("_w", widths[F.col("feature")])
    idx = F.sequence(F.lit(0), F.col("_n") - 1)
    num = lambda f: F.transform(idx, lambda b: F.coalesce(F.try_element_at("_c", b)[f].cast("double"), F.lit(0.0)))
    sec = lambda f: F.transform(idx, lambda b: F.coalesce(F.try_element_at("_e", b)[f], F.lit(0.0)))
    j = j.withColumns({"n0": num("n"), "n1": num("n1"), "n2": num("n2"), "o0": sec("occ_s"), "o1": sec("occ1_s"), "o2": sec("occ2_s")})
    angular = F.col("feature") != "cd"

    def window(a, b, half, wrap):
        offs = F.sequence(F.lit(-half), F.lit(half))
        pos = lambda o: F.pmod(b + o, F.col("_n")) if wrap else b + o
        inside = F.filter(offs, lambda o: (pos(o) >= 0) & (pos(o) < F.col("_n")))
        return F.transform(inside, lambda o: F.get(a, pos(o)))

    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))

    def smooth(i):
        n, o = F.col(f"n{i}"), F.col(f"o{i}")
        ang = F.transform(idx, lambda b: F.when((F.get(o, b) > 0), total(window(n, b, angle_box // 2, True)) / total(window(o, b, angle_box // 2, True))))
        rate = F.transform(idx, lambda b: F.when(F.get(o, b) > 0, F.get(n, b) / F.get(o, b)))
        lin = F.transform(idx, lambda b: F.when(F.get(o, b) > 0, total(window(rate, b, dist_box // 2, False)) / F.size(F.filter(window(rate, b, dist_box // 2, False), lambda v: v.isNotNull()))))
        return F.when(angular, ang).otherwise(lin)

    j = j.withColumns({"s0": smooth(0), "s1": smooth(1), "s2": smooth(2), "r0": F.transform(idx, lambda b: F.when(F.get("o0", b) > 0, F.get("n0", b) / F.get("o0", b)))})

    def pearson(pairs, key, out_r2=False):
        n = F.size(pairs)
        zero = F.struct(*[F.lit(0.0).alias(k) for k in ("a", "b", "aa", "bb", "ab")])
        s = F.aggregate(pairs, zero, lambda acc, p: F.struct((acc["a"] + p["a"]).alias("a"), (acc["b"] + p["b"]).alias("b"), (acc["aa"] + p["a"] * p["a"]).alias("aa"),
                                                           (acc["bb"] + p["b"] * p["b"]).alias("bb"), (acc["ab"] + p["a"] * p["b"]).alias("ab")))
        va, vb = s["aa"] - s["a"] * s["a"] / n, s["bb"] - s["b"] * s["b"] / n
        cov = s["ab"] - s["a"] * s["b"] / n
        ok = (n >= key) & (va > 1e-12) & (vb > 1e-12)
        return F.when(ok, cov * cov / (va * vb)) if out_r2 else F.when(ok, unit_clip(cov / F.sqrt(va * vb)))

    both = F.filter(F.transform(idx, lambda b: F.struct(F.get("s1", b).alias("a"), F.get("s2", b).alias("b"))), lambda p: p["a"].isNotNull() & p["b"].isNotNull())
    fit = F.filter(F.transform(idx, lambda b: F.struct(((b + 0.5) * F.col("_w")).alias("a"), F.get("r0", b).alias("b"))), lambda p: p["b"].isNotNull())
    th = lambda b: F.radians((b + 0.5) * F.col("_w"))
    full = ~F.exists("s0", lambda v: v.isNull())
    vec = F.hypot(total(F.transform(idx, lambda b: F.get("s0", b) * F.cos(th(b)))), total(F.transform(idx, lambda b: F.get("s0", b) * F.sin(th(b)))))
    mvl = F.when(full & (total(F.col("s0")) > 0), vec / total(F.col("s0")))
    strength = F.when(angular, mvl).otherwise(pearson(fit, 3, True))
    visited = F.size(F.filter("o0", lambda v: v > 0))
    return j.select(*K, strength.alias("strength"), pearson(both, min_bins).alias("stability"), visited.alias("n_visited"), F.col("_n").alias("n_bins"))


def classify_center(stats: DataFrame, n_moving: DataFrame, coverage: DataFrame, thresholds: DataFrame, session: list[str], unit: list[str], *,
                    min_spikes: int = 100, min_coverage: float = 0.8, shuffled: bool = True) -> DataFrame:
    """Cell flag and status per unit and feature; any failed gate makes the flag NULL, never false."""
    th = thresholds.groupBy("feature").agg(F.max(F.when(F.col("statistic") == "strength", F.col("threshold"))).alias("t_strength"),
                                           F.max(F.when(F.col("statistic") == "stability", F.col("threshold"))).alias("t_stability"))
    j = stats.join(n_moving, [*session, *unit], "left").join(coverage, session, "left").join(F.broadcast(th), "feature", "left")
    angular = F.col("feature") != "cd"
    covered = F.when(angular, F.col("n_visited") == F.col("n_bins")).otherwise(F.col("n_visited") >= 3)
    status = join_status([
        (F.coalesce("n_moving", F.lit(0)) <= min_spikes, "insufficient_spikes"),
        (~F.coalesce(F.col("coverage") > min_coverage, F.lit(False)), "insufficient_spatial_coverage"),
        (angular & ~covered, "incomplete_angular_coverage"), (~angular & ~covered, "insufficient_distance_bins"),
        (F.col("strength").isNull(), "undefined_tuning_strength"), (F.col("stability").isNull(), "undefined_split_half_stability"),
        (F.lit(not shuffled), "shuffle_not_run"),
        (F.lit(shuffled) & (F.col("t_strength").isNull() | F.col("t_stability").isNull()), "unavailable_null_distribution")])
    j = j.withColumn("status", status)
    flag = F.when(F.col("status") == "classified", (F.col("strength") > F.col("t_strength")) & (F.col("stability") > F.col("t_stability")))
    return j.withColumn("is_cell", flag)


def pose_support(frames: DataFrame, session: list[str], t: str, valid: str, *, width: float, gap_width: float | None = None) -> DataFrame:
    """Gap-split support of valid samples with half-frame margins, and the sampling rate."""
    r = frame_runs(frames, session, t, valid, width=width, gap_width=gap_width).filter(valid)
    g = r.groupBy(*session, "run_id").agg(F.min(t).alias("_a"), F.max(t).alias("_b"), F.first("dt").alias("dt"), F.count(F.lit(1)).alias("n_frames"))
    return g.select(*session, "run_id", (F.col("_a") - F.col("dt") / 2).alias("start_s"), (F.col("_b") + F.col("dt") / 2).alias("end_s"), (1 / F.col("dt")).alias("fs"), "n_frames")


def trajectory_breaks(frames: DataFrame, session: list[str], t: str, frame: str, *, max_speed: float, max_gap: float, width: float) -> DataFrame:
    """True where a drawn path must break: too fast, too long a gap, or a skipped frame id."""
    f = sequence(frames, session, [t], width=width, lag={"_t": t, "_x": "x", "_y": "y", "_f": frame})
    gap = F.col(t) - F.col("_t")
    fast = F.hypot(F.col("x") - F.col("_x"), F.col("y") - F.col("_y")) / gap > max_speed
    return f.withColumn("breaks", F.col("_t").isNull() | (gap > max_gap) | fast | (F.col(frame) < F.col("_f"))).drop("_t", "_x", "_y", "_f")
