"""Stimulus response cubes: trial counts, presentations, rates, windows and 1-D projections."""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.angles import col, wrap180
from .dense import dense_fixed
from .intervals import trial_window_join
from .ordered import sequence

CELL = ["y", "x"]


def strict_sum(v) -> Column:
    """Sum that is NULL as soon as one input is NULL."""
    v = col(v)
    return F.when(F.count(v) == F.count(F.lit(1)), F.sum(v))


def response_cube(spikes: DataFrame, trials: DataFrame, session: list[str], unit: list[str], cell: list[str], *,
                  lo: float, hi: float, bin_s: float, t: str = "t", onset: str = "onset_s", blocks: int = 64) -> DataFrame:
    """Counts per unit, stimulus cell and lag bin over [onset+lo, onset+hi).

    Hits grow with the product of spikes and trials, so they are never rows: units are dealt to `blocks` per session, every
    block gets its session's trials in order, and each unit's hits are counted where its spikes are. What is shuffled is
    spikes once and trials `blocks` times.
    """
    usable = lambda df, c: df.filter(F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in [*session, c])) & ~F.isnan(F.col(c).cast("double")))
    s = usable(spikes, t).select(*session, *unit, F.col(t).cast("double").alias("_t"), F.pmod(F.xxhash64(*unit), F.lit(blocks)).alias("_b"))
    # a cell is one text, so NULLs in it stay what they are
    r = usable(trials, onset).select(*session, F.to_json(F.struct(*cell)).alias("_cell"), F.col(onset).cast("double").alias("_o"),
                                     F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("_b"))
    who = F.to_json(F.struct(*session, *unit)).alias("_who")
    s = s.select(*session, "_b", who, "_t")
    n_bins = int(math.ceil((hi - lo) / bin_s)) + 2  # one more at each end, for lags that rounding puts beyond an edge

    def count(sp: pa.Table, tr: pa.Table) -> pa.Table:
        sp, tr = sp.to_pandas(), tr.to_pandas().sort_values("_o", kind="stable")
        o = tr["_o"].to_numpy()
        code, cells = pd.factorize(tr["_cell"])
        first, last = o + lo, o + hi
        who, hits = [], []
        for name, times in sp.groupby("_who")["_t"]:
            total = np.zeros(len(cells) * n_bins, np.int64)
            times = times.to_numpy()
            for k in range(0, len(times), 1024):
                x = times[k:k + 1024]
                a, z = np.searchsorted(last, x, "right"), np.searchsorted(first, x, "right")
                m = z - a
                at = np.repeat(a - (np.cumsum(m) - m), m) + np.arange(m.sum())
                lag = np.floor((np.repeat(x, m) - o[at] - lo) / bin_s).astype(np.int64)
                total += np.bincount(code[at] * n_bins + lag + 1, minlength=len(total))
            hit = np.flatnonzero(total)
            who.append(name)
            hits.append((hit, total[hit]))
        ends = pa.array(np.cumsum([0, *[len(h) for h, _ in hits]]), pa.int32())
        flat = [np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for v in ([h for h, _ in hits], [n for _, n in hits])]
        pair = pa.StructArray.from_arrays([pa.array(v) for v in flat], ["at", "n"])
        return pa.table({"_who": pa.array(who, pa.string()), "_cells": pa.array(["[" + ",".join(cells) + "]"] * len(who), pa.string()),
                         "_hits": pa.ListArray.from_arrays(ends, pair)})

    keys = [*session, "_b"]
    got = s.groupBy(*keys).cogroup(r.groupBy(*keys)).applyInArrow(count, "_who STRING, _cells STRING, _hits ARRAY<STRUCT<at: BIGINT, n: BIGINT>>")
    text = lambda df, cols: ", ".join(f"`{c}`: {df.schema[c].dataType.simpleString()}" for c in cols)
    back = got.select(F.from_json("_who", f"STRUCT<{text(spikes, [*session, *unit])}>").alias("_w"),
                      F.from_json("_cells", f"ARRAY<STRUCT<{text(trials, cell)}>>").alias("_c"), "_hits")
    back = back.select("_w", "_c", F.explode("_hits").alias("_h"))  # texts are read once a unit, before its hits become rows
    at = F.floor(F.col("_h.at") / n_bins).cast("int")
    return back.select("_w.*", *[F.get("_c", at)[c].alias(c) for c in cell], (F.col("_h.at") % n_bins - 1).cast("int").alias("t_bin"), F.col("_h.n").alias("n"))


def trial_bounds(trials: DataFrame, session: list[str], onset: str = "onset_s", *, width: float,
                 last_edge: DataFrame | None = None) -> DataFrame:
    """Offset of every trial = next onset; the last takes the final edge when one is given."""
    out = sequence(trials, session, [onset], width=width, lead={"offset_s": onset})
    if last_edge is not None:
        out = out.join(last_edge.select(*session, F.col("edge_s")), session, "left")
        out = out.withColumn("offset_s", F.coalesce("offset_s", "edge_s")).drop("edge_s")
    return out


def presentations(trials: DataFrame, keys: list[str], dur: str | None = None) -> DataFrame:
    """Trials and seconds per position."""
    aggs = [F.count(F.lit(1)).alias("presentations")]
    if dur:
        aggs.append(F.sum(dur).alias("occupancy_s"))
    return trials.groupBy(*keys).agg(*aggs)


def resolve_presentations(saved: DataFrame, trials: DataFrame, keys: list[str]) -> DataFrame:
    """Saved counts win; missing ones are rebuilt from the trials."""
    built = presentations(trials, keys).withColumnRenamed("presentations", "_built")
    return (saved.join(built, keys, "full_outer")
            .withColumn("presentations", F.coalesce("presentations", "_built")).drop("_built"))


def cover_pixels(trials: DataFrame, first: Column, last: Column, n_px: int, name: str = "px") -> DataFrame:
    """One row per trial and covered pixel; the screen wraps."""
    return trials.withColumn(name, F.explode(F.sequence(first.cast("int"), last.cast("int")))).withColumn(
        name, F.pmod(F.col(name), F.lit(n_px)))


def coarsen_any(pixels: DataFrame, keys: list[str], px: str, group: int, name: str = "bin") -> DataFrame:
    """A coarse bin is covered when any of its pixels is, once per key."""
    return pixels.select(*keys, F.floor(F.col(px) / group).cast("int").alias(name)).distinct()


def bar_coverage(trials: DataFrame, center_px, width_px: int, n_px: int, group: int, keys: list[str]) -> DataFrame:
    """Pixel and trial counts per coarse bin under vertical bars of a given width."""
    first = F.floor(col(center_px) - width_px / 2.0 + 0.5)
    px = cover_pixels(trials, first, first + (width_px - 1), n_px)
    b = F.floor(F.col("px") / group).cast("int").alias("bin")
    per = px.groupBy(*keys, "trial_id", b).agg(F.count(F.lit(1)).alias("_p"))
    return per.groupBy(*keys, "bin").agg(F.sum("_p").alias("pixel_count"), F.count(F.lit(1)).alias("trial_count"))


def free_moving_exposure(trials: DataFrame, keys: list[str], *, bar_deg, heading, width_deg: float, n_px: int, group: int) -> DataFrame:
    """Trials that put the bar into each observer-relative coarse bin, each trial counted once per bin."""
    rel = F.pmod(col(bar_deg) - col(heading), F.lit(360.0))
    per_px = 360.0 / n_px
    first = F.floor((rel - width_deg / 2) / per_px)
    px = cover_pixels(trials.filter(rel.isNotNull()), first, first + int(round(width_deg / per_px)) - 1, n_px)
    return (coarsen_any(px, [*keys, "trial_id"], "px", group).groupBy(*keys, "bin")
            .agg(F.count(F.lit(1)).alias("n_trials")))


def moving_pixel(x_deg, px_per_deg: float, offset_px, n_px: int, sign: int = 1) -> Column:
    """Trial x in pixels shifted by a per-trial background or heading offset, modulo the screen."""
    return F.pmod(F.floor(col(x_deg) * px_per_deg + sign * col(offset_px)), F.lit(n_px)).cast("int")


def time_sum(cube: DataFrame, keys: list[str], t0: int, t1: int, *, t_bin: str = "t_bin", value: str = "n") -> DataFrame:
    """Sum over lag bins t0 <= t_bin < t1 (bounds must be bin edges, i.e. integers)."""
    if int(t0) != t0 or int(t1) != t1 or t1 <= t0:
        raise ValueError("window ends must be bin edges")
    return cube.filter((F.col(t_bin) >= t0) & (F.col(t_bin) < t1)).groupBy(*keys).agg(F.sum(value).alias(value))


def edge_index(edges: list[float], value: float, tol: float = 1e-12) -> int:
    """Index of a time that must coincide with a bin edge."""
    hits = [i for i, e in enumerate(edges) if abs(e - value) <= tol]
    if not hits:
        raise ValueError("time is not a bin edge")
    return hits[0]


def counts_to_rates(cube: DataFrame, grid: DataFrame, cell: list[str], bin_s: float, *, value: str = "n") -> DataFrame:
    """Hz = counts / (presentations * bin width); never-presented cells stay NULL."""
    return cube.join(grid, cell, "left").withColumn(
        "rate_hz", F.when(F.col("presentations") > 0, F.col(value) / (F.col("presentations") * bin_s)))


def mean_rate(rates: DataFrame, keys: list[str], *, rate: str = "rate_hz", weight: str) -> DataFrame:
    """Time-weighted mean rate; NULL when any bin of the window is NULL."""
    return rates.groupBy(*keys).agg((strict_sum(F.col(rate) * F.col(weight)) / F.sum(weight)).alias("mean_hz"))


def dense_map(values: DataFrame, keys: list[str], shape: tuple[int, int], value: str, fill=None,
              grid: DataFrame | None = None) -> DataFrame:
    """Every unit with every cell of the ny x nx grid (only presented cells when a grid table is given)."""
    ny, nx = shape
    out = dense_fixed(values, keys, {"y": ny, "x": nx}, [value], fill=fill)
    return out if grid is None else out.join(grid.select("y", "x"), ["y", "x"], "left_semi")


def sum_to_1d(maps: DataFrame, keys: list[str], axis: str, *, value: str, mask: DataFrame | None = None,
              skip_missing: bool = False) -> DataFrame:
    """Collapse the other axis. With a mask only rows of the other axis touched by it enter.
    A missing cell makes the sum missing unless skip_missing is set."""
    other = "y" if axis == "x" else "x"
    if mask is not None:
        maps = maps.join(mask.select(*keys, other).distinct(), [*keys, other], "left_semi")
    s = F.sum(value) if skip_missing else strict_sum(value)
    return maps.groupBy(*keys, axis).agg(s.alias(value))


def pooled_profile(cube: DataFrame, grid: DataFrame, keys: list[str], axis: str, duration_s: float, *, value: str = "n") -> DataFrame:
    """Sum of counts / (sum of presentations * duration) along one axis."""
    g = grid.groupBy(axis).agg(F.sum("presentations").alias("p"))
    return (cube.groupBy(*keys, axis).agg(F.sum(value).alias(value)).join(g, axis)
            .withColumn("rate_hz", F.col(value) / (F.col("p") * duration_s)).drop("p"))


def zero_bin_count(maps: DataFrame, keys: list[str], value: str, *, missing_counts: bool) -> DataFrame:
    """Zero (or zero-or-missing) bins per unit and the number of valid bins."""
    bad = (F.col(value) == 0) | (F.col(value).isNull() if missing_counts else F.lit(False))
    return maps.groupBy(*keys).agg(F.count_if(bad).alias("n_zero"), F.count(value).alias("n_valid"))


def rf_pick(maps: DataFrame, keys: list[str], value: str, k: int) -> DataFrame:
    """Keep units with at most k measured zero bins; missing is not zero."""
    ok = zero_bin_count(maps, keys, value, missing_counts=False).filter(F.col("n_zero") <= k)
    return maps.join(ok.select(*keys), keys, "left_semi")


def bin_qc(maps: DataFrame, keys: list[str], value: str, k: int = 2) -> DataFrame:
    """Keep flag: at most k zero-or-missing bins and at least one valid bin."""
    z = zero_bin_count(maps, keys, value, missing_counts=True)
    return z.withColumn("keep", (F.col("n_zero") <= k) & (F.col("n_valid") >= 1))


def psth(spikes: DataFrame, trials: DataFrame, session: list[str], unit: list[str], *, lo: float, hi: float, bin_s: float) -> DataFrame:
    """Lag histogram per unit with the rate per trial of its session."""
    hits = trial_window_join(spikes, trials, session, lo=lo, hi=hi)
    b = F.floor((F.col("lag_s") - lo) / bin_s).cast("int").alias("t_bin")
    n = trials.groupBy(*session).agg(F.count(F.lit(1)).alias("n_trials"))
    return (hits.groupBy(*session, *unit, b).agg(F.count(F.lit(1)).alias("n")).join(n, session)
            .withColumn("per_trial", F.col("n") / F.col("n_trials"))
            .withColumn("rate_hz", F.col("per_trial") / bin_s))


def region_psth(rates: DataFrame, keys: list[str], region: str, t_bin: str = "t_bin", group: int = 1) -> DataFrame:
    """Mean and SEM over the positions of a region per display bin; sample SD, one position gives NULL SEM."""
    b = F.floor(F.col(t_bin) / group).cast("int").alias(t_bin)
    per = rates.groupBy(*keys, region, "y", "x", b).agg(F.avg("rate_hz").alias("_r"))
    return per.groupBy(*keys, region, t_bin).agg(F.count("_r").alias("n"), F.avg("_r").alias("mean_hz"),
                                                 (F.stddev_samp("_r") / F.sqrt(F.count("_r"))).alias("sem_hz"))


def moments(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mergeable n, sum and sum of squares."""
    v = F.col(value)
    return df.groupBy(*keys).agg(F.count(v).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("ss"))


def merge_moments(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Pool partial moments into mean and SEM."""
    p = parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    var = (F.col("ss") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)
    return p.select(*keys, "n", (F.col("s") / F.col("n")).alias("mean"),
                    F.when(F.col("n") > 1, F.sqrt(F.greatest(var, F.lit(0.0)) / F.col("n"))).alias("sem"))


def nested_means(df: DataFrame, levels: list[list[str]], value: str) -> DataFrame:
    """Average level by level (region bins -> cell -> animal), SEM at the last level."""
    cur = df
    for keys in levels[:-1]:
        cur = cur.groupBy(*keys).agg(F.avg(value).alias(value))
    return merge_moments(moments(cur, levels[-1], value), levels[-1])
