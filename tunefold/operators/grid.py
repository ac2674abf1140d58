"""Response regions on stimulus grids: z maps, seeds, components, sections, centers and permutation tests.

A stimulus grid is a fixed small raster (for example 7 x 30), so one map is a bounded row. Components are
labelled map by map inside an Arrow batch: no iteration over shuffles, no checkpoint, any number of
units and replicates spread freely over tasks.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.angles import col
from ..functions.hashing import hash_key, replicate
from ..session import cut_lineage
from .dense import cell_code
from .ordered import hash_rank, numbered, sequence


def z_map(responses: DataFrame, trials: DataFrame, session: list[str], unit: list[str], *, stratum: str = "stratum",
          response: str = "response") -> DataFrame:
    """Mean response per cell against its exact permutation mean and SD within strata.

    `trials` has one row per presentation (session, stratum, y, x); `responses` carries the non-zero
    responses with their cell and stratum. Labels permuted within a stratum of N trials give each cell a
    mean of n*m and a variance of v*n*(N-n)/(N-1) for its n trials, so nothing is simulated.
    """
    K = list(dict.fromkeys([*session, *unit]))
    cell = cell_code(["y", "x"])
    # stimulus side: per session a short list of strata, each with its trial count and cell counts
    pos = trials.groupBy(*session, stratum, "y", "x").agg(F.count(F.lit(1)).alias("_n"))
    stim = (pos.groupBy(*session, stratum).agg(F.sum("_n").alias("_tot"), F.collect_list(F.struct("y", "x", "_n")).alias("_cells"))
            .groupBy(*session).agg(F.collect_list(F.struct(F.col(stratum).alias("_st"), "_tot", "_cells")).alias("_strata")))
    # unit side: per unit a map stratum -> moments and summed responses per cell (bounded by the grid)
    mom = (responses.groupBy(*K, stratum, "y", "x").agg(F.sum(response).alias("_s"), F.sum(F.col(response) * F.col(response)).alias("_ss"))
           .groupBy(*K, stratum).agg(F.sum("_s").alias("_usum"), F.sum("_ss").alias("_ussq"),
                                     F.map_from_entries(F.collect_list(F.struct(cell.alias("k"), F.col("_s").alias("v")))).alias("_hit"))
           .groupBy(*K).agg(F.map_from_entries(F.collect_list(F.struct(F.col(stratum).alias("k"), F.struct("_usum", "_ussq", "_hit").alias("v")))).alias("_m")))
    j = mom.join(stim, session).select(*K, "_m", F.explode("_strata").alias("_q"))
    j = j.select(*K, F.try_element_at("_m", F.col("_q._st")).alias("_u"), F.col("_q._tot").alias("_tot"), F.explode("_q._cells").alias("_c"))
    j = j.select(*K, "_u", "_tot", "_c.*")
    m = F.coalesce(F.col("_u._usum"), F.lit(0.0)) / F.col("_tot")
    v = F.greatest(F.coalesce(F.col("_u._ussq"), F.lit(0.0)) / F.col("_tot") - m * m, F.lit(0.0))
    fpc = F.when(F.col("_tot") > 1, F.col("_n") * (F.col("_tot") - F.col("_n")) / (F.col("_tot") - 1)).otherwise(F.lit(0.0))
    s = F.coalesce(F.try_element_at(F.col("_u._hit"), cell), F.lit(0.0))
    z = j.groupBy(*K, "y", "x").agg(F.sum("_n").alias("n_trials"), F.sum(s).alias("_s"), F.sum(m * F.col("_n")).alias("_e"), F.sum(v * fpc).alias("_var"))
    n = F.col("n_trials")
    return with_z(z.select(*K, "y", "x", "n_trials", (F.col("_s") / n).alias("response"), (F.col("_e") / n).alias("null_mean"), (F.sqrt("_var") / n).alias("null_sd")))


def with_z(m: DataFrame) -> DataFrame:
    ok = F.col("response").isNotNull() & (F.col("null_sd") > 0)
    return m.withColumn("z", F.when(ok, (F.col("response") - F.col("null_mean")) / F.col("null_sd")))


def bottom_row_baseline(m: DataFrame, keys: list[str], ny: int, nx: int) -> DataFrame:
    """Use mean and population SD of the last two rows as reference; any missing cell there leaves the map untested."""
    b = m.filter(F.col("y") >= ny - 2).groupBy(*keys).agg(F.count("response").alias("_c"), F.avg("response").alias("_m"), F.stddev_pop("response").alias("_s"))
    b = b.select(*keys, F.when(F.col("_c") == 2 * nx, F.col("_m")).alias("null_mean"), F.when(F.col("_c") == 2 * nx, F.col("_s")).alias("null_sd"))
    return with_z(m.drop("null_mean", "null_sd", "z").join(b, keys, "left"))


def spatial_reference(m: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Each unit's mean and population SD over its measured non-zero cells as reference (map mode)."""
    v = m.filter(F.col(value).isNotNull() & (F.col(value) != 0))
    b = v.groupBy(*keys).agg(F.avg(value).alias("null_mean"), F.stddev_pop(value).alias("null_sd"))
    return with_z(v.withColumn("response", F.col(value)).join(b, keys))


def score(m: DataFrame, alternative: str) -> DataFrame:
    return m.withColumn("score", F.col("z") if alternative == "greater" else -F.col("z"))


def _neighbour_fan(cells: DataFrame, radius_y: int, radius_x: int, nx: int, wrap_x: bool, offsets=None) -> DataFrame:
    offs = offsets or [(dy, dx) for dy in range(-radius_y, radius_y + 1) for dx in range(-radius_x, radius_x + 1)]
    arr = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in offs])
    f = cells.withColumn("_o", F.explode(arr))
    x = F.col("x") + F.col("_o.dx")
    return f.withColumn("y", F.col("y") + F.col("_o.dy")).withColumn("x", F.pmod(x, F.lit(nx)) if wrap_x else x).drop("_o")


def seed_expand(m: DataFrame, keys: list[str], threshold: float, decay: float, nx: int, wrap_x: bool = True) -> DataFrame:
    """Cells at or above the threshold, plus cells above the lowered threshold in the 8-neighbourhood of an original seed."""
    cand = m.filter(F.col("score") >= threshold).select(*keys, "y", "x")
    near = _neighbour_fan(cand, 1, 1, nx, wrap_x).distinct()
    return m.filter(F.col("score") >= threshold - decay).join(near, [*keys, "y", "x"], "left_semi")


def labelled(mask: np.ndarray, offsets: list[tuple[int, int]], wrap_x: bool) -> np.ndarray:
    """(maps, y, x) smallest flat cell of the component each masked cell belongs to; ny * nx elsewhere."""
    n, ny, nx = mask.shape
    big = ny * nx
    lab = np.where(mask, np.arange(big).reshape(ny, nx), big)
    while True:
        pad = np.pad(lab, ((0, 0), (2, 2), (0, 0)), constant_values=big)
        new = lab
        for dy, dx in offsets:
            s = pad[:, 2 + dy:2 + dy + ny, :]
            if wrap_x:
                s = np.roll(s, -dx, axis=2)
            else:
                s = np.pad(s, ((0, 0), (0, 0), (2, 2)), constant_values=big)[:, :, 2 + dx:2 + dx + nx]
            new = np.minimum(new, s)
        new = np.where(mask, new, big)
        # follow labels to their own label, which shortens long chains
        ext = np.concatenate([new.reshape(n, -1), np.full((n, 1), big)], axis=1)
        new = np.take_along_axis(ext, new.reshape(n, -1), axis=1).reshape(lab.shape)
        if np.array_equal(new, lab):
            return lab
        lab = new


def label_udf(ny: int, nx: int, offsets: list[tuple[int, int]], wrap_x: bool):
    """Arrow UDF: flat candidate cells of a map -> smallest flat cell of the component each one belongs to."""
    @F.pandas_udf("array<int>")
    def label(cells: pd.Series) -> pd.Series:
        if not len(cells):
            return pd.Series([], dtype=object)
        sizes = np.array([len(c) for c in cells])
        rows = np.repeat(np.arange(len(cells)), sizes)
        flat = np.concatenate([np.asarray(c, dtype=np.int64) for c in cells])
        mask = np.zeros((len(cells), ny * nx), bool)
        mask[rows, flat] = True
        out = labelled(mask.reshape(-1, ny, nx), offsets, wrap_x).reshape(len(cells), -1)[rows, flat].astype(np.int32)
        return pd.Series(np.split(out, np.cumsum(sizes)[:-1]))
    return label


FOUR = [(0, 1), (0, -1), (1, 0), (-1, 0)]
GAP_TWO = [(dy, dx) for dy in range(-2, 3) for dx in range(-2, 3) if (dy, dx) != (0, 0)]


def components(cells: DataFrame, keys: list[str], ny: int, nx: int, *, wrap_x: bool = True, offsets=None, label: str = "component") -> DataFrame:
    """Add the component id (its smallest flat cell) to every candidate cell. One map is one row while labelling."""
    rest = [c for c in cells.columns if c not in {*keys, label}]
    row = F.struct((F.col("y") * nx + F.col("x")).cast("int").alias("_f"), *rest)
    packed = cells.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("_cells"))
    lab = packed.withColumn("_l", label_udf(ny, nx, offsets or FOUR, wrap_x)(F.col("_cells._f")))
    lab = lab.select(*keys, F.explode(F.arrays_zip("_cells", "_l")).alias("_z"))
    return lab.select(*keys, *[F.col(f"_z._cells.{c}") for c in rest], F.col("_z._l").alias(label))


def drop_small(labelled: DataFrame, keys: list[str], drop_bins: int, label: str = "component") -> DataFrame:
    w = Window.partitionBy(*keys, label)
    return labelled.withColumn("_size", F.count(F.lit(1)).over(w)).filter(F.col("_size") > drop_bins).drop("_size")


def component_mass(labelled: DataFrame, keys: list[str], label: str = "component") -> DataFrame:
    return labelled.groupBy(*keys, label).agg(F.sum("score").alias("mass"), F.count(F.lit(1)).alias("size"))


def sections(mask: DataFrame, keys: list[str], ny: int, nx: int, *, wrap_x: bool = True) -> DataFrame:
    """Retained cells grouped when at most one bin apart, diagonals included; dropped cells never bridge."""
    return components(mask, keys, ny, nx, wrap_x=wrap_x, offsets=GAP_TWO, label="section")


def section_centers(sec: DataFrame, keys: list[str], weight: str, nx: int, *, wrap_x: bool = True) -> DataFrame:
    """Weighted medoid cell of every section: least weighted squared distance, then larger weight, then first cell.

    A section is at most one grid, so its cells travel as one array and the cost is evaluated in the row.
    """
    S = [*keys, "section"]
    w = F.greatest(F.coalesce(F.col(weight), F.lit(0.0)), F.lit(0.0))
    g = sec.groupBy(*S).agg(F.collect_list(F.struct("y", "x", w.alias("w"))).alias("_c"), F.max(w).alias("_mw"), F.count(F.lit(1)).alias("size"))
    g = g.withColumn("_c", F.transform("_c", lambda e: F.struct(e["y"].alias("y"), e["x"].alias("x"), F.when(F.col("_mw") > 0, e["w"]).otherwise(F.lit(1.0)).alias("w"))))

    def cost(c):
        def add(acc, e):
            dx = F.abs(e["x"] - c["x"])
            d = F.least(dx, F.lit(nx) - dx) if wrap_x else dx
            return acc + e["w"] * ((e["y"] - c["y"]) * (e["y"] - c["y"]) + d * d)
        return F.round(F.aggregate("_c", F.lit(0.0), add), 9)

    best = F.array_min(F.transform("_c", lambda c: F.struct(cost(c).alias("cost"), (-c["w"]).alias("nw"), c["y"].alias("y"), c["x"].alias("x"))))
    return g.withColumn("_b", best).select(*S, F.col("_b.y").alias("y"), F.col("_b.x").alias("x"), "size")


def component_moments(sec: DataFrame, centers: DataFrame, keys: list[str], weight: str, nx: int) -> DataFrame:
    """Amplitude, centroid and SD of a section with x unwrapped around its medoid."""
    S = [*keys, "section"]
    j = sec.join(centers.select(*S, F.col("x").alias("_cx")), S)
    ux = F.col("_cx") + F.pmod(F.col("x") - F.col("_cx") + nx // 2, F.lit(nx)) - nx // 2
    j = j.withColumn("_ux", ux).withColumn("_w", F.greatest(F.col(weight), F.lit(0.0)))
    g = j.groupBy(*S).agg(F.max(weight).alias("amplitude"), F.sum("_w").alias("_W"), F.sum(F.col("_w") * F.col("y")).alias("_y"), F.sum(F.col("_w") * F.col("_ux")).alias("_x"),
                          F.sum(F.col("_w") * F.col("y") ** 2).alias("_yy"), F.sum(F.col("_w") * F.col("_ux") ** 2).alias("_xx"))
    my, mx = F.col("_y") / F.col("_W"), F.col("_x") / F.col("_W")
    return g.filter("_W > 0").select(*S, "amplitude", my.alias("y_mean"), F.pmod(mx, F.lit(float(nx))).alias("x_mean"),
                                     F.sqrt(F.greatest(F.col("_yy") / F.col("_W") - my * my, F.lit(0.0))).alias("y_sd"),
                                     F.sqrt(F.greatest(F.col("_xx") / F.col("_W") - mx * mx, F.lit(0.0))).alias("x_sd"))


def fill_single_holes(labelled: DataFrame, valid: DataFrame, keys: list[str], nx: int, *, wrap_x: bool = True, min_neighbours: int = 3, label: str = "component") -> DataFrame:
    """Testable cells outside the mask whose valid 4-neighbours (at least min_neighbours) all belong to one cluster."""
    near = _neighbour_fan(valid.select(*keys, "y", "x", F.col("y").alias("_ty"), F.col("x").alias("_tx")), 0, 0, nx, wrap_x, FOUR)
    near = near.join(valid.select(*keys, "y", "x"), [*keys, "y", "x"], "left_semi").join(labelled.select(*keys, "y", "x", label), [*keys, "y", "x"], "left")
    g = near.groupBy(*keys, F.col("_ty").alias("y"), F.col("_tx").alias("x")).agg(
        F.count(F.lit(1)).alias("_n"), F.count(label).alias("_in"), F.min(label).alias("_lo"), F.max(label).alias("_hi"))
    g = g.filter((F.col("_n") >= min_neighbours) & (F.col("_n") == F.col("_in")) & (F.col("_lo") == F.col("_hi")))
    return g.join(labelled.select(*keys, "y", "x"), [*keys, "y", "x"], "left_anti").select(*keys, "y", "x", F.col("_lo").alias(label))


def permute_trials(trials: DataFrame, session: list[str], trial: str, stratum: str, n_rep: int, seed: int) -> DataFrame:
    """Cell labels shuffled within (session, stratum), per replicate; shared by all units of the session.

    The r-th trial in hash order takes the cell of the r-th trial in id order. Both numberings are cut into
    buckets, so one huge stratum still spreads over tasks.
    """
    base = numbered(trials.select(*session, stratum, trial, "y", "x"), [*session, stratum], trial, "_r")
    h = replicate(trials.select(*session, stratum, trial), n_rep).withColumn("_h", hash_key(seed, "rep", trial))
    h = hash_rank(h, ["rep", *session, stratum], "_h", "_r", tie=[trial])
    return h.join(base.select(*session, stratum, "_r", "y", "x"), [*session, stratum, "_r"]).select("rep", *session, stratum, trial, "y", "x")


#: A session's trials that one task may hold, units that share its permutations, and replicates worked on at a time.
MOST_TRIALS, UNITS, REPS = 1 << 17, 128, 64


def permuted_cells(trials: list[tuple[np.ndarray, list[bytes], np.ndarray]], n: int, reps: range, seed: int) -> np.ndarray:
    """(trials x replicates) cell of every trial: per stratum (places, ids as text, cells), all in the order of the ids."""
    out = np.empty((n, len(reps)), np.int32)
    for at, ids, cells in trials:
        for j, r in enumerate(reps):
            head = f"{seed}|{r}|".encode()
            h = np.frombuffer(b"".join([hashlib.md5(head + i).digest() for i in ids]), ">u8")[::2]
            out[at[np.argsort(h, kind="stable")], j] = cells
    return out


def _null_rows(batches, ny: int, nx: int, z: float, n_rep: int, seed: int, sign: float, wrap_x: bool):
    cells = ny * nx
    for batch in batches:
        done = []
        for row in batch.to_pylist():
            trials = row["_trials"]
            place = {t["id"]: i for i, t in enumerate(trials)}
            strata: dict = {}
            for i, t in enumerate(trials):
                strata.setdefault(t["st"], []).append(i)
            packed = [(np.array(at), [trials[i]["id"].encode() for i in at], np.array([trials[i]["c"] for i in at], np.int32)) for at in strata.values()]
            units = [(u, np.array([place[r["id"]] for r in u["_resp"]]), np.array([r["v"] for r in u["_resp"]], float)) for u in row["_units"]]
            refs = [[np.array([c[f] for c in u["_ref"]]) for f in ("c", "n", "m", "s")] for u, _, _ in units]
            masses = [np.zeros(n_rep) for _ in units]
            for lo in range(0, n_rep, REPS):
                reps = range(lo, min(lo + REPS, n_rep))
                where = permuted_cells(packed, len(trials), reps, seed)
                for (u, at, v), (c, n, m, s), out in zip(units, refs, masses):
                    code = where[at] + np.arange(len(reps), dtype=np.int64) * cells
                    sums = np.bincount(code.ravel(), np.repeat(v, len(reps)), minlength=len(reps) * cells).reshape(len(reps), cells)
                    score = np.full((len(reps), cells), -np.inf)
                    value = (sums[:, c] / n - m) / s
                    score[:, c] = sign * value
                    mask = score >= z
                    lab = labelled(mask.reshape(-1, ny, nx), FOUR, wrap_x).reshape(len(reps), cells)
                    rep, cell = np.nonzero(mask)
                    mass = np.bincount(rep * cells + lab[rep, cell], score[rep, cell], minlength=len(reps) * cells)
                    out[reps.start:reps.stop] = mass.reshape(len(reps), cells).max(axis=1)
            done += [{**u["_key"], "null_masses": m.tolist()} for (u, _, _), m in zip(units, masses)]
        key = batch.schema.field("_units").type.value_type.field("_key").type
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema([*key, pa.field("null_masses", pa.list_(pa.float64()))]))


def null_by_blocks(responses: DataFrame, trials: DataFrame, ref: DataFrame, session: list[str], unit: list[str], trial: str, *, ny: int, nx: int, z: float, n_rep: int, seed: int,
                   stratum: str, alternative: str, wrap_x: bool) -> DataFrame:
    """(K, null_masses): the largest cluster mass of every replicate, for a block of units of a session at a time.

    A block of units meets the session's trials once; replicates are made inside the task, so no row is multiplied by them.
    """
    K = list(dict.fromkeys([*session, *unit]))
    sign = 1.0 if alternative == "greater" else -1.0
    cell = (F.col("y") * nx + F.col("x")).cast("int").alias("c")
    own = responses.groupBy(*K).agg(F.collect_list(F.struct(F.col(trial).cast("string").alias("id"), F.col("response").cast("double").alias("v"))).alias("_resp"))
    refs = ref.groupBy(*K).agg(F.collect_list(F.struct(cell, F.col("n_trials").cast("double").alias("n"), F.col("null_mean").alias("m"), F.col("null_sd").alias("s"))).alias("_ref"))
    units = own.join(refs, K).select(*session, F.struct(*K).alias("_key"), "_resp", "_ref")
    number = units.groupBy(*session).agg(F.ceil(F.count(F.lit(1)) / UNITS).cast("int").alias("_n"))
    units = units.join(number, session).withColumn("_block", F.pmod(F.xxhash64("_key"), F.col("_n")).cast("int"))
    blocks = units.groupBy(*session, "_block").agg(F.collect_list(F.struct("_key", "_resp", "_ref")).alias("_units"))
    listed = trials.groupBy(*session).agg(F.sort_array(F.collect_list(F.struct(F.col(stratum).cast("string").alias("st"), F.col(trial).alias("o"), F.col(trial).cast("string").alias("id"), cell))).alias("_trials"))
    listed = listed.select(*session, F.transform("_trials", lambda t: F.struct(t["st"].alias("st"), t["id"].alias("id"), t["c"].alias("c"))).alias("_trials"))
    out = ", ".join([*(f"{c} {dict(responses.dtypes)[c]}" for c in K), "null_masses array<double>"])
    return blocks.join(listed, session).select("_trials", "_units").mapInArrow(lambda it: _null_rows(it, ny, nx, z, n_rep, seed, sign, wrap_x), out)


def null_by_rows(responses: DataFrame, trials: DataFrame, ref: DataFrame, session: list[str], unit: list[str], trial: str, *, ny: int, nx: int, z: float, n_rep: int, seed: int,
                 stratum: str, alternative: str, wrap_x: bool) -> DataFrame:
    """(rep, K, null_mass) for sessions whose trials no task should hold: one row per replicate and response."""
    K = list(dict.fromkeys([*session, *unit]))
    perm = permute_trials(trials, session, trial, stratum, n_rep, seed)
    sums = responses.join(perm, [*session, trial]).groupBy("rep", *K, "y", "x").agg(F.sum("response").alias("_sum"))
    if alternative == "greater":
        # a cell without response is below its mean, so only cells hit in a replicate can pass the threshold
        pm = sums.join(ref, [*K, "y", "x"])
    else:
        pm = replicate(ref, n_rep).join(sums, ["rep", *K, "y", "x"], "left")
    pm = pm.withColumn("z", (F.coalesce("_sum", F.lit(0.0)) / F.col("n_trials") - F.col("null_mean")) / F.col("null_sd"))
    pc = components(score(pm, alternative).filter(F.col("score") >= z).select("rep", *K, "y", "x", "score"), ["rep", *K], ny, nx, wrap_x=wrap_x)
    return component_mass(pc, ["rep", *K]).groupBy("rep", *K).agg(F.max("mass").alias("null_mass"))


def cluster_permutation(responses: DataFrame, trials: DataFrame, session: list[str], unit: list[str], trial: str, *, ny: int, nx: int,
                        z: float = 1.5, alpha: float = 0.05, n_rep: int = 10_000, seed: int = 0, stratum: str = "stratum",
                        alternative: str = "greater", wrap_x: bool = True, most_trials: int = MOST_TRIALS) -> tuple[DataFrame, DataFrame]:
    """Clusters with p from the per-unit null of the largest cluster mass. Returns (cells, clusters).

    `responses` holds non-zero responses per unit and trial. A unit's null keeps one number per replicate. Sessions of more
    than `most_trials` trials take the way that spreads one session's trials over tasks; both give the same draws.
    """
    K = list(dict.fromkeys([*session, *unit]))
    placed = responses.join(trials.select(*session, trial, stratum, "y", "x"), [*session, trial])
    zm = cut_lineage(z_map(placed, trials, session, unit, stratum=stratum))
    obs = cut_lineage(components(score(zm, alternative).filter(F.col("score") >= z), K, ny, nx, wrap_x=wrap_x))
    masses = component_mass(obs, K)
    ref = zm.select(*K, "y", "x", "n_trials", "null_mean", "null_sd").filter("null_sd > 0")
    how = dict(ny=ny, nx=nx, z=z, n_rep=n_rep, seed=seed, stratum=stratum, alternative=alternative, wrap_x=wrap_x)
    many = trials.groupBy(*session).agg(F.count(F.lit(1)).alias("_t")).filter(F.col("_t") > most_trials).select(*session)
    small = null_by_blocks(responses.join(many, session, "left_anti"), trials.join(many, session, "left_anti"), ref, session, unit, trial, **how)
    hits = masses.join(small, K).select(*K, "component", F.size(F.filter("null_masses", lambda x: F.round(x, 9) >= F.round("mass", 9))).cast("long").alias("_ge"))
    if many.limit(1).count():
        large = null_by_rows(responses.join(many, session, "left_semi"), trials.join(many, session, "left_semi"), ref, session, unit, trial, **how)
        hits = hits.union(masses.join(large, K).groupBy(*K, "component").agg(F.count_if(F.round("null_mass", 9) >= F.round("mass", 9)).alias("_ge")))
    clusters = masses.join(hits, [*K, "component"], "left").withColumn("p", (1 + F.coalesce("_ge", F.lit(0))) / F.lit(n_rep + 1.0)).drop("_ge")
    clusters = clusters.withColumn("significant", F.col("p") <= alpha)
    return obs, clusters


def project_mask(mask: DataFrame, keys: list[str], axis: str) -> DataFrame:
    """Any retained cell along the other axis."""
    return mask.select(*keys, axis).distinct()


def detect_map(m: DataFrame, keys: list[str], value: str, *, ny: int, nx: int, sigma: float, drop_bins: int, wrap_x: bool = True, decay: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Map mode: spatial reference over non-zero cells, signed sigma threshold, size filter, sections and centers."""
    alt = "greater" if sigma > 0 else "less"
    zm = score(spatial_reference(m, keys, value), alt)
    cand = seed_expand(zm, keys, abs(sigma), decay, nx, wrap_x) if decay else zm.filter(F.col("score") >= abs(sigma))
    kept = drop_small(components(cand, keys, ny, nx, wrap_x=wrap_x), keys, drop_bins)
    eff = (F.col("response") - F.col("null_mean")) * (1.0 if alt == "greater" else -1.0)
    sec = sections(kept.withColumn("effect", F.greatest(eff, F.lit(0.0))), keys, ny, nx, wrap_x=wrap_x)
    return sec, section_centers(sec, keys, "effect", nx, wrap_x=wrap_x)


def analyze_rf(rates: DataFrame, keys: list[str], *, ny: int, nx: int, max_zero: int = 2, sigmas_2d=(1.8, -1.0), sigmas_1d=(1.0, -0.75), drop_bins: int = 0) -> DataFrame:
    """QC, then 2-D and 1-D regions of both polarities in one long center table."""
    from .rates import bin_qc
    keep = bin_qc(rates, keys, "mean_hz", max_zero).filter("keep").select(*keys)
    m = rates.join(keep, keys, "left_semi")
    flat = m.groupBy(*keys, "x").agg(F.when(F.count("mean_hz") == F.count(F.lit(1)), F.sum("mean_hz")).alias("mean_hz")).withColumn("y", F.lit(0))
    out = None
    for dim, src, h, sig in (("2d", m, ny, sigmas_2d), ("1d", flat, 1, sigmas_1d)):
        for s in sig:
            _, c = detect_map(src, keys, "mean_hz", ny=h, nx=nx, sigma=s, drop_bins=drop_bins)
            c = c.select(*keys, F.lit(dim).alias("dim"), F.lit("excitatory" if s > 0 else "inhibitory").alias("polarity"), "y", "x", "size")
            out = c if out is None else out.unionByName(c)
    return out
