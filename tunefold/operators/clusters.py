"""Cluster permutation of hits in trial windows: a unit's responses are counted from its spikes and are rows of no table."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.hashing import Md5

#: Spikes of a block of units, units times stretches of trials of a block, spikes times replicates of one task, trials of a
#: stretch, and single trials that are counted at a time.
SPIKES, STRETCHES, WORK, TRIALS, PIECE = 1 << 19, 1 << 25, 1 << 26, 64, 1 << 16


class Hits:
    """Units' spikes as ranges of a session's trials in order of onset: a spike hits the trials of one range."""

    def __init__(self, unit: np.ndarray, first: np.ndarray, after: np.ndarray, units: int, trials: int):
        some = after > first
        unit, first, after = unit[some], first[some], after[some]
        self.units, self.trials = units, trials
        who, at = np.concatenate([unit, unit]), np.concatenate([first, after])
        sign = np.repeat(np.array([1, -1], np.int32), len(unit))
        order = np.lexsort((at, who))
        self.who, self.at, self.sign = who[order], at[order], sign[order]
        # whole stretches of trials per unit, and the single trials that ranges have more or less than those
        n = -(-trials // TRIALS)
        near = lambda x: np.minimum((x + TRIALS // 2) // TRIALS, n)
        low, high = near(first), near(after)
        whole = np.zeros((units, n + 1), np.int32)
        np.add.at(whole, (unit, low), 1)
        np.subtract.at(whole, (unit, high), 1)
        # sums of whole numbers are exact in either type
        exact = np.bincount(unit, after - first + TRIALS, minlength=1).max() < 1 << 24
        self.whole = np.cumsum(whole, axis=1, dtype=np.int32)[:, :n].astype(np.float32 if exact else np.float64)
        edge = lambda b: np.minimum(b * TRIALS, trials)
        self.more = self._single(np.append(unit, unit), np.append(first, edge(high)), np.append(edge(low), after))
        self.less = self._single(np.append(unit, unit), np.append(edge(low), after), np.append(first, edge(high)))

    @staticmethod
    def _single(unit: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """Pieces of the trials lo to hi by unit: first and last unit, the units counted from the first, the trials."""
        some = hi > lo
        order = np.argsort(unit[some], kind="stable")
        unit, lo, hi = (x[some][order].astype(np.int32) for x in (unit, lo, hi))
        ends = np.cumsum(hi - lo, dtype=np.int64)
        out = []
        for piece in np.split(np.arange(len(unit)), np.flatnonzero(np.diff(ends // PIECE)) + 1) if len(unit) else []:
            u, n = unit[piece], hi[piece] - lo[piece]
            at = np.repeat(lo[piece] - (np.cumsum(n, dtype=np.int32) - n), n) + np.arange(n.sum(), dtype=np.int32)
            out.append((int(u[0]), int(u[-1]), np.repeat(u - u[0], n), at))
        return out

    def moments(self, stratum: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(units x strata) sums of the responses and of their squares."""
        seen = np.zeros((self.trials + 1, n), np.int64)
        seen[np.arange(1, self.trials + 1), stratum] = 1
        seen = np.cumsum(seen, axis=0)
        level = np.cumsum(self.sign)  # a unit's edges sum up to 0, so the next one starts anew
        long = seen[self.at[1:]] - seen[self.at[:-1]]
        v = np.where(level[:-1] > 0, level[:-1], 0)[:, None]
        out = [np.zeros((self.units, n), np.int64) for _ in range(2)]
        for o, x in zip(out, (v * long, v * v * long)):
            for s in range(n):
                o[:, s] = np.bincount(self.who[:-1], x[:, s], self.units) if len(x) else 0
        return out[0].astype(float), out[1].astype(float)

    def sums(self, cell: np.ndarray, n: int) -> np.ndarray:
        """(units x cells) summed responses if the trials, in order of onset, have these cells (n: none)."""
        width = n + 1
        table = np.bincount(np.arange(self.trials) // TRIALS * width + cell, minlength=self.whole.shape[1] * width).reshape(-1, width)[:, :n]
        out = (self.whole @ table.astype(self.whole.dtype)).astype(np.int64)
        for sign, pieces in ((1, self.more), (-1, self.less)):
            for lo, hi, unit, at in pieces:
                out[lo:hi + 1] += sign * np.bincount(unit * width + cell[at], minlength=(hi - lo + 1) * width).reshape(-1, width)[:, :n]
        return out


def neighbours(mask: np.ndarray, wrap_x: bool) -> np.ndarray:
    """Smallest flat place (map and cell) of the 4-connected component of every masked cell of (maps, y, x), in their order."""
    flat = np.flatnonzero(mask)
    number = np.cumsum(mask.ravel(), dtype=np.int32).reshape(mask.shape) - 1
    edges = [(number[:, 1:][b], number[:, :-1][b]) for b in [mask[:, 1:] & mask[:, :-1]]] + [(number[:, :, 1:][b], number[:, :, :-1][b]) for b in [mask[:, :, 1:] & mask[:, :, :-1]]]
    if wrap_x and mask.shape[2] > 1:
        b = mask[:, :, 0] & mask[:, :, -1]
        edges.append((number[:, :, 0][b], number[:, :, -1][b]))
    p, q = (np.concatenate([e[i] for e in edges]) for i in (0, 1))
    lab = np.arange(len(flat), dtype=np.int32)
    while len(p):
        least = np.minimum(lab[p], lab[q])
        new = lab.copy()
        np.minimum.at(new, p, least)
        np.minimum.at(new, q, least)
        new = new[new]
        if np.array_equal(new, lab):
            break
        lab = new
    return flat[lab]


def _clusters(batches, ny: int, nx: int, z: float, n_rep: int, seed: int, sign: float, wrap_x: bool, lo: float, hi: float):
    cells = ny * nx
    for batch in batches:
        for row in range(batch.num_rows):
            get = lambda c: batch.column(c)[row]
            trials, units = get("_trials").values, get("_units").values
            part, parts = get("_part").as_py(), get("_parts").as_py()
            keys, spikes = units.field("_key"), units.field("_t")
            # trials come in order of their ids; strata are numbered, a missing cell has the place behind the grid
            texts, onset = trials.field("id"), trials.field("o").to_numpy(zero_copy_only=False).astype(float)
            names = trials.field("st").dictionary_encode(null_encoding="encode")
            stratum, strata = names.indices.to_numpy(zero_copy_only=False), len(names.dictionary)
            cell = trials.field("c").fill_null(cells).to_numpy(zero_copy_only=False).astype(np.int32)
            order = np.argsort(onset, kind="stable")
            starts, ends = onset[order] + lo, onset[order] + hi
            size = spikes.value_lengths().to_numpy(zero_copy_only=False)
            t = spikes.flatten().to_numpy(zero_copy_only=False)
            hits = Hits(np.repeat(np.arange(len(size)), size), np.searchsorted(ends, t, "right"), np.searchsorted(starts, t, "right"), len(size), len(onset))
            # closed form reference: see grid.z_map
            tot = np.bincount(stratum, minlength=strata).astype(float)
            seen = np.zeros((strata, cells + 1))
            np.add.at(seen, (stratum, cell), 1.0)
            seen = seen[:, :cells]
            one, two = hits.moments(stratum[order], strata)
            m, n = one / tot, seen.sum(axis=0)
            v = np.maximum(two / tot - m * m, 0.0)
            spread = seen * (tot[:, None] - seen) / np.maximum(tot - 1, 1)[:, None] * (tot > 1)[:, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                mean, sd = (sum(m[:, [s]] * seen[s] for s in range(strata)) / n), np.sqrt(sum(v[:, [s]] * spread[s] for s in range(strata))) / n
            sd = np.where(sd > 0, sd, np.nan)

            def components(cell):
                with np.errstate(divide="ignore", invalid="ignore"):
                    value = sign * ((hits.sums(cell, cells) / n - mean) / sd)
                mask = value >= z
                root, score = neighbours(mask.reshape(-1, ny, nx), wrap_x), value[mask]
                place, at, size = np.unique(root, return_inverse=True, return_counts=True)
                return place, np.bincount(at, score, len(place)), size

            place, mass, size = components(cell[order])
            owner, limit, reached = place // cells, np.round(mass, 9), np.zeros(len(place), np.int64)
            groups = [np.flatnonzero(stratum == s) for s in range(strata)]
            texts = [Md5(texts.take(pa.array(g))) for g in groups]
            back = np.empty(len(order), np.int64)
            back[order] = np.arange(len(order))
            for rep in range(part, n_rep, parts):
                moved = np.empty(len(cell), np.int32)
                for g, text in zip(groups, texts):
                    # the r-th trial in hash order takes the cell of the r-th in order of ids
                    moved[back[g[np.argsort(text.after(f"{seed}|{rep}|"), kind="stable")]]] = cell[g]
                where, got, _ = components(moved)
                top = np.zeros(len(keys))
                np.maximum.at(top, where // cells, got)
                reached += np.round(top, 9)[owner] >= limit
            first = np.full(len(place), part == 0)
            ours = keys.take(pa.array(owner))
            yield pa.RecordBatch.from_arrays([*ours.flatten(), pa.array((place % cells).astype(np.int32)), pa.array(mass, mask=~first), pa.array(size.astype(np.int64), mask=~first), pa.array(reached)],
                                             names=[*[f.name for f in ours.type], "component", "mass", "size", "_ge"])


def hit_clusters(spikes: DataFrame, trials: DataFrame, session: list[str], unit: list[str], trial: str, *, t: str, onset: str, lo: float, hi: float, ny: int, nx: int,
                 z: float = 1.5, alpha: float = 0.05, n_rep: int = 10_000, seed: int = 0, stratum: str = "stratum", alternative: str = "greater", wrap_x: bool = True) -> DataFrame:
    """What grid.cluster_permutation gives as clusters if a response is the number of a unit's spikes in [onset+lo, onset+hi).

    In order of onset a spike hits one range of trials, so a cell's sum is a difference of running counts at its two ends. A
    task holds the trials of a session and a block of its units and makes a part of the replicates; only clusters leave it. Their
    number of rows is bounded by the grid, whatever the rates. A session's trials must fit a task (some 100 bytes each).
    """
    K = list(dict.fromkeys([*session, *unit]))
    cell = (F.col("y") * nx + F.col("x")).cast("int").alias("c")
    own = spikes.filter(F.col(t).isNotNull() & ~F.isnan(t)).groupBy(*K).agg(F.sort_array(F.collect_list(F.col(t).cast("double"))).alias("_t"))
    size = own.groupBy(*session).agg(F.sum(F.size("_t")).alias("_n"), F.count(F.lit(1)).alias("_u"))
    size = size.join(trials.groupBy(*session).agg((F.count(F.lit(1)) / TRIALS).alias("_s")), session)
    blocks = F.ceil(F.greatest(F.col("_n") / SPIKES, F.col("_u") * F.col("_s") / STRETCHES)).cast("int")
    parts = F.least(F.greatest(F.ceil(F.col("_n") / blocks * n_rep / WORK), F.lit(1)), F.lit(n_rep)).cast("int")
    own = own.join(size, session).withColumn("_block", F.pmod(F.xxhash64(*unit), blocks)).withColumn("_parts", parts)
    packed = own.groupBy(*session, "_block", "_parts").agg(F.collect_list(F.struct(F.struct(*K).alias("_key"), "_t")).alias("_units"))
    listed = trials.groupBy(*session).agg(F.sort_array(F.collect_list(F.struct(F.col(trial).alias("i"), F.col(stratum).cast("string").alias("st"), F.col(trial).cast("string").alias("id"), F.col(onset).cast("double").alias("o"), cell))).alias("_trials"))
    listed = listed.select(*session, F.transform("_trials", lambda e: F.struct(e["st"].alias("st"), e["id"].alias("id"), e["o"].alias("o"), e["c"].alias("c"))).alias("_trials"))
    work = packed.join(listed, session).select("_trials", "_units", "_parts", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    # large rows of much work: dealt one by one, and not put together again by their size
    work = work.repartition(int(spikes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    types = dict(spikes.dtypes)
    out = ", ".join([*(f"{c} {types[c]}" for c in K), "component int, mass double, size long, _ge long"])
    side = 1.0 if alternative == "greater" else -1.0
    done = work.mapInArrow(lambda it: _clusters(it, ny, nx, z, n_rep, seed, side, wrap_x, lo, hi), out)
    done = done.groupBy(*K, "component").agg(F.max("mass").alias("mass"), F.max("size").alias("size"), ((1 + F.sum("_ge")) / F.lit(n_rep + 1.0)).alias("p"))
    return done.withColumn("significant", F.col("p") <= alpha)
