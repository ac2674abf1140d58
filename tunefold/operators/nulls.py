"""Null distributions: pairing permutations, circular shifts, bootstraps. All draws are hashes of stable keys."""
from __future__ import annotations

import hashlib
from typing import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.angles import col, cosd, sind
from ..functions.bins import angle_bin
from ..functions.hashing import hash_key, replicate, uniform
from ..session import cut_lineage
from .ordered import exact_quantile, hash_rank, numbered, sequence
from . import pairs as P


def _stat_fisher(df, group, a, b):
    return P.fisher_lee(df, group, a, b).select(*group, F.col("rho").alias("value"))


def _stat_js(df, group, a, b):
    return P.js_circular_corr(df, group, a, b).select(*group, F.col("rho").alias("value"))


def _stat_mantel(df, group, a, b):
    return P.mantel_spearman(df, group, a, b).select(*group, F.col("rho").alias("value"))


def _stat_spearman(df, group, a, b):
    return P.spearman(df, group, a, b).select(*group, F.col("rho").alias("value"))


def _stat_resultant(df, group, a, b):
    return P.alignment_offset(df, group, a, b).select(*group, F.col("resultant").alias("value"))


def _stat_circlin(df, group, a, b):
    return P.circular_linear(df, group, a, b).select(*group, F.col("r").alias("value"))


STATISTICS: dict[str, Callable] = {"fisher_lee": _stat_fisher, "js": _stat_js, "mantel": _stat_mantel, "spearman": _stat_spearman,
                                   "resultant": _stat_resultant, "circular_linear": _stat_circlin}


def permuted_pairs(pairs: DataFrame, within: list[str], unit: str, a: str, b: str, n_rep: int, seed: int, carry: list[str] = ()) -> DataFrame:
    """(rep, a, b) with b reassigned by a hash order of units inside `within`."""
    rest = [c for c in carry if c not in within]
    base = numbered(pairs.select(*within, unit, a, *rest), within, unit, "_r")
    h = replicate(pairs.select(*within, unit, b), n_rep).withColumn("_h", hash_key(seed, "rep", unit))
    h = hash_rank(h, ["rep", *within], "_h", "_r", tie=[unit])
    return h.select("rep", *within, "_r", b).join(base.select(*within, "_r", a, *rest), [*within, "_r"]).drop("_r")


def pairing_permutation(pairs: DataFrame, group: list[str], unit: str, a: str, b: str, statistic: str, *, n_rep: int = 10_000,
                        seed: int = 1, within: list[str] | None = None, two_sided: bool = True) -> DataFrame:
    """Observed statistic and p = (1 + #null >= observed) / (n + 1); undefined statistics give NULL p."""
    # one row per unit: written once, then read by the observed and the permuted side
    ok = cut_lineage(pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull()))
    w = list(dict.fromkeys([*group, *(within or [])]))
    fn = STATISTICS[statistic]
    obs = fn(ok, group, a, b)
    null = fn(cut_lineage(permuted_pairs(ok, w, unit, a, b, n_rep, seed)), ["rep", *group], a, b)
    v = F.abs("value") if two_sided else F.col("value")
    j = null.select("rep", *group, v.alias("_null")).join(obs.withColumn("_obs", v), group)
    g = j.groupBy(*group, "value").agg(F.count_if(F.col("_null") >= F.col("_obs") - 1e-12).alias("_ge"))
    return obs.join(g.drop("value"), group, "left").select(*group, F.col("value").alias("observed"),
                                                           F.when(F.col("value").isNotNull(), (1 + F.coalesce("_ge", F.lit(0))) / F.lit(n_rep + 1.0)).alias("p"))


def bootstrap_samples(pairs: DataFrame, group: list[str], unit: str, n_rep: int, seed: int) -> DataFrame:
    """Resample units with replacement inside each group: slot k of replicate r takes unit floor(u * n)."""
    base = numbered(pairs, group, unit, "_slot")
    n = pairs.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    draws = replicate(base.select(*group, "_slot").join(n, group), n_rep)
    draws = draws.withColumn("_slot", (F.floor(uniform(seed, "rep", *group, "_slot") * F.col("_n")) + 1).cast("long"))
    return draws.select("rep", *group, "_slot").join(base.withColumn("_slot", F.col("_slot").cast("long")), [*group, "_slot"]).drop("_slot")


def bootstrap_ci(pairs: DataFrame, group: list[str], unit: str, a: str, b: str, statistic: str, *, n_rep: int = 2000, seed: int = 1,
                 limit: float = 1.0, lo: float = 0.025, hi: float = 0.975) -> DataFrame:
    """Percentile bounds; undefined draws push the lower bound to -limit and the upper to +limit."""
    s = bootstrap_samples(pairs, group, unit, n_rep, seed)
    draws = STATISTICS[statistic](s, ["rep", *group], a, b)
    # one number per replicate, so the built-in percentile holds n_rep values per group
    return draws.groupBy(*group).agg(
        F.percentile(F.coalesce(F.col("value"), F.lit(-limit)), F.lit(lo)).alias("ci_low"),
        F.percentile(F.coalesce(F.col("value"), F.lit(limit)), F.lit(hi)).alias("ci_high"),
        (F.count("value") / F.lit(float(n_rep))).alias("defined_fraction"))


def block_bootstrap(blocks: DataFrame, keys: list[str], session: list[str], *, n_rep: int = 1000, seed: int = 0) -> DataFrame:
    """CI of a rate difference from per-block weighted spikes and exposures of two sides.

    `blocks`: session, block, exposure_a, exposure_b, and per unit spikes_a, spikes_b. Every replicate draws as many
    blocks as there are, with replacement; a block's multiplicity is shared by all units of the session.
    """
    b = blocks.select(*session, "block").distinct()
    b = numbered(b, session, "block", "_slot")
    n = b.groupBy(*session).agg(F.count(F.lit(1)).alias("_n"))
    d = replicate(b.select(*session, "_slot").join(n, session), n_rep)
    d = d.withColumn("_slot", (F.floor(uniform(seed, "rep", *session, "_slot") * F.col("_n")) + 1).cast("long"))
    mult = d.groupBy("rep", *session, "_slot").agg(F.count(F.lit(1)).alias("_m"))
    mult = mult.join(b.withColumn("_slot", F.col("_slot").cast("long")), [*session, "_slot"]).select("rep", *session, "block", "_m")
    j = blocks.join(mult, [*session, "block"])
    sums = j.groupBy("rep", *keys).agg(*[F.sum(F.col("_m") * F.col(c)).alias(c) for c in ("spikes_a", "spikes_b", "exposure_a", "exposure_b")])
    rate = lambda s: F.when(F.col(f"exposure_{s}") > 0, F.col(f"spikes_{s}") / F.col(f"exposure_{s}"))
    draws = sums.withColumn("_d", rate("b") - rate("a"))
    ci = draws.groupBy(*keys).agg(F.percentile("_d", F.lit(0.025)).alias("ci_low"), F.percentile("_d", F.lit(0.975)).alias("ci_high"))
    obs = blocks.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("spikes_a", "spikes_b", "exposure_a", "exposure_b")])
    return obs.select(*keys, (rate("b") - rate("a")).alias("difference_hz")).join(ci, keys)


def feature_support(frames: DataFrame, epochs: DataFrame, session: list[str], *, ft: str, angle: str, width: float) -> DataFrame:
    """Stretch of the concatenated epoch clock that belongs to every frame (nearest frame, tie to the later one)."""
    from .intervals import to_epoch_clock, epoch_clock
    ec = epoch_clock(epochs, session, width=width).withColumn("_len", F.col("end_s") - F.col("start_s"))
    f = to_epoch_clock(frames.select(*session, F.col(ft).alias("_ft"), angle), epochs, session, "_ft", id_col="epoch_id", width=width)
    f = sequence(f, [*session, "epoch_id"], ["clock_t"], width=width, lag={"_prev": "clock_t"})
    f = f.join(ec.select(*session, "epoch_id", "clock_start"), [*session, "epoch_id"])
    return f.select(*session, "epoch_id", F.coalesce((F.col("_prev") + F.col("clock_t")) / 2, F.col("clock_start")).alias("left_t"), angle)


#: Stretches of the clock and spikes of a unit that one task should hold, spikes of a block of units, shifted spikes looked up
#: at a time, and rows of a batch that a task hands back.
STRETCHES, BLOCK, LOOKUPS, ROWS = 1 << 18, 1 << 16, 1 << 16, 1 << 14


def _swept(batches, n_bins: int, n_rep: int, seed: int, whole: bool):
    """Per unit and replicate the counts per bin of its shifted spikes that fall into one chunk of the clock; their vector length if that is `whole` the clock."""
    angle = np.radians((np.arange(n_bins) + 0.5) * (360.0 / n_bins))

    def batch_of(key, made):
        reps, counts, parts = (np.concatenate([m[i] for m in made]) for i in (1, 2, 3))
        if whole:
            value = pa.array(counts)
        else:
            value = pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1, dtype=np.int32) * n_bins), pa.array(counts.ravel()))
        keys = pa.array([m[0] for m in made], key).take(pa.array(np.repeat(np.arange(len(made)), [len(m[1]) for m in made])))
        return pa.RecordBatch.from_arrays([pa.array(reps), *keys.flatten(), value, pa.array(parts)], names=["rep", *[f.name for f in key], "_v", "_w"])

    for batch in batches:
        key, made, held = batch.schema.field("_units").type.value_type.field("_key").type, [], 0
        for row in range(batch.num_rows):
            at = {c: batch.column(c)[row] for c in ("_left", "_bin", "_occ", "_units")}
            left, bins = at["_left"].values.to_numpy(zero_copy_only=False), at["_bin"].values.to_numpy(zero_copy_only=False).astype(np.int64)
            occ = at["_occ"].values.to_numpy(zero_copy_only=False)
            hi, length = (batch.column(c)[row].as_py() for c in ("_hi", "_len"))
            for unit in at["_units"]:
                name, t = unit["_name"].as_py(), unit["_t"].values.to_numpy(zero_copy_only=False)
                u = np.array([int(hashlib.md5(f"{seed}|{r}|{name}".encode()).hexdigest()[:8], 16) for r in range(n_rep)]) / 4294967296.0
                n = np.zeros((n_rep, n_bins), np.int64)
                some = max(1, LOOKUPS // max(1, min(len(t), LOOKUPS)))
                for first in range(0, len(t), LOOKUPS):
                    for lo in range(0, n_rep, some):
                        shift = u[lo:lo + some]
                        moved = t[None, first:first + LOOKUPS] + shift[:, None] * length
                        # below two lengths the remainder is the difference, which is exact
                        np.subtract(moved, length, out=moved, where=moved >= length)
                        if moved.max() >= length:
                            moved = np.fmod(moved, length)
                        place = np.searchsorted(left, moved, "right") - 1
                        inside = place >= 0
                        if hi is not None:
                            inside &= moved < hi
                        b = np.where(inside, bins[np.maximum(place, 0)], -1)
                        b += np.arange(1, len(shift) + 1)[:, None] * (n_bins + 1) - n_bins
                        n[lo:lo + some] += np.bincount(b.ravel(), minlength=len(shift) * (n_bins + 1)).reshape(len(shift), n_bins + 1)[:, 1:]
                hit = np.flatnonzero(n.any(axis=1))
                if whole:
                    r = n[hit] / occ
                    add = lambda f: sum((r[:, b] * f[b] for b in range(n_bins)), np.zeros(len(hit)))
                    w = add(np.ones(n_bins))
                    value, parts = np.hypot(add(np.cos(angle)), add(np.sin(angle))), w
                else:
                    value, parts = n[hit], np.ones(len(hit))
                made.append((unit["_key"].as_py(), hit.astype(np.int32), value, parts))
                held += len(hit)
                if held >= ROWS:
                    yield batch_of(key, made)
                    made, held = [], 0
        if made:
            yield batch_of(key, made)


def hd_shuffle(spikes: DataFrame, frames: DataFrame, epochs: DataFrame, session: list[str], unit: list[str], *, t: str, ft: str, angle: str,
               occupancy: DataFrame, n_bins: int, n_rep: int, seed: int, width: float) -> DataFrame:
    """Null vector lengths of circularly shifted spikes on the epoch clock. Epochs without a frame must be dropped before.

    Frames are first turned into stretches of the clock, which is cut into chunks of about STRETCHES. Blocks of units meet
    the chunks of their session, whatever the number of replicates: a task sweeps its replicates over the sorted stretches
    by binary search, so no spike is multiplied before a shuffle. Where every clock is one chunk the task gives vector lengths,
    otherwise counts per bin, which are summed up over the chunks.
    """
    from .intervals import to_epoch_clock
    K = [*session, *unit]
    s = cut_lineage(to_epoch_clock(spikes, epochs, session, t, id_col="epoch_id", width=width).filter(F.col("clock_t").isNotNull()).select(*K, "clock_t"))
    total = epochs.groupBy(*session).agg(F.sum(F.col("end_s") - F.col("start_s")).alias("_len"))
    support = feature_support(frames, epochs, session, ft=ft, angle=angle, width=width).select(*session, "left_t", F.coalesce(angle_bin(angle, n_bins), F.lit(-1)).cast("int").alias("_b"))
    support = cut_lineage(support.join(total, session))
    parts = support.groupBy(*session).agg(F.ceil(F.count(F.lit(1)) / STRETCHES).alias("_p"))
    chunk = F.floor(F.col("left_t") / F.col("_len") * F.col("_p")).cast("int").alias("_chunk")
    chunks = support.join(parts, session).groupBy(*session, "_len", chunk).agg(F.sort_array(F.collect_list(F.struct("left_t", "_b"))).alias("_s"))
    after = F.lead(F.col("_s")[0]["left_t"]).over(Window.partitionBy(*session).orderBy("_chunk"))
    chunks = chunks.select(*session, "_len", F.col("_s.left_t").alias("_left"), F.col("_s._b").alias("_bin"), after.alias("_hi"))
    # unvisited bins count as one sample, in the shuffle only
    seen = occupancy.groupBy(*session).agg(F.map_from_entries(F.collect_list(F.struct("bin", "occ_n"))).alias("_occ"))
    chunks = chunks.join(seen, session, "left").withColumn("_occ", F.array(*[F.coalesce(F.try_element_at(F.col("_occ"), F.lit(b)), F.lit(1)).cast("double") for b in range(n_bins)]))
    name = F.concat_ws("|", *[F.col(c).cast("string") for c in K]).alias("_name")
    # only a unit of more spikes than a task should hold is cut
    number = s.groupBy(*K).agg(F.count(F.lit(1)).alias("_c")).withColumn("_p", F.ceil(F.col("_c") / STRETCHES))
    number = cut_lineage(number.join(number.groupBy(*session).agg(F.ceil(F.sum("_c") / BLOCK).alias("_u")), session))
    whole = number.filter("_p > 1").isEmpty() and parts.filter("_p > 1").isEmpty()
    some = s.join(number, K).withColumn("_block", F.pmod(F.xxhash64(*unit), F.col("_u"))).withColumn("_slice", F.pmod(F.xxhash64("clock_t"), F.col("_p")))
    units = some.groupBy(*K, "_block", "_slice").agg(F.sort_array(F.collect_list("clock_t")).alias("_t"))
    units = units.groupBy(*session, "_block", "_slice").agg(F.collect_list(F.struct(F.struct(*K).alias("_key"), name, "_t")).alias("_units"))
    types = dict(spikes.dtypes)
    out = ", ".join(["rep int", *(f"{c} {types[c]}" for c in K), "_v double" if whole else "_v array<long>", "_w double"])
    # large rows of much work: dealt one by one, and not put together again by their size
    work = units.join(chunks, session).select("_left", "_bin", "_occ", "_hi", "_len", "_units").repartition(int(s.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    swept = work.mapInArrow(lambda it: _swept(it, n_bins, n_rep, seed, whole), out)
    if whole:
        return swept.select("rep", *K, (F.col("_v") / F.col("_w")).alias("null_mvl"))
    n = swept.groupBy("rep", *K).agg(F.array(*[F.sum(F.col("_v")[b]) for b in range(n_bins)]).alias("_n"))
    o = n.join(seen, session, "left")
    rates = F.transform("_n", lambda x, b: x / F.coalesce(F.try_element_at(F.col("_occ"), b), F.lit(1)))
    angle_of = lambda b: (b + 0.5) * (360.0 / n_bins)
    add = lambda f: F.aggregate(F.transform("_r", lambda r, b: r * f(b)), F.lit(0.0), lambda x, y: x + y)
    g = o.withColumn("_r", rates).select("rep", *K, add(lambda b: cosd(angle_of(b))).alias("_c"), add(lambda b: sind(angle_of(b))).alias("_s"), add(lambda b: F.lit(1.0)).alias("_w"))
    return g.select("rep", *K, (F.hypot("_c", "_s") / F.col("_w")).alias("null_mvl"))


def shuffle_p(observed: DataFrame, nulls: DataFrame, keys: list[str], value: str, null: str) -> DataFrame:
    """p = (1 + #null >= observed) / (#null + 1)."""
    j = nulls.join(observed.select(*keys, value), keys)
    return j.groupBy(*keys).agg(((1 + F.count_if(F.col(null) >= F.col(value))) / (F.count(null) + 1.0)).alias("p"))


def clock_shift(spikes: DataFrame, trial: DataFrame, session: list[str], unit: list[str], t: str, *, n_rep: int, seed: int, min_shift: float = 20.0) -> DataFrame:
    """Spike times moved by a hashed shift of at least min_shift around the trial, per unit and replicate."""
    K = [*session, *unit]
    j = replicate(spikes.join(trial.select(*session, "t0", "t1"), session), n_rep)
    D = F.col("t1") - F.col("t0")
    j = j.filter((F.col(t) >= F.col("t0")) & (F.col(t) <= F.col("t1")) & (D > 2 * min_shift))
    sh = F.lit(min_shift) + uniform(seed, "rep", *K) * (D - 2 * min_shift)
    return j.withColumn(t, F.col("t0") + F.pmod(F.col(t) - F.col("t0") + sh, D)).drop("t0", "t1")


def null_threshold(nulls: DataFrame, group: list[str], value: str, q: float = 0.99, width: float | None = 0.01) -> DataFrame:
    """Pooled percentile of all null values per statistic; pooling has no size bound, so ranks are distributed."""
    return exact_quantile(nulls, group, value, q, "threshold", width=width)
