"""Pulse, run and cycle operators on ordered samples."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.angles import col
from .ordered import sequence, islands


def sync_streams(a: DataFrame, b: DataFrame, durations: DataFrame, rec: str, t: str, *, width: float) -> DataFrame:
    """Pair the n-th pulses of two devices per recording (extra pulses drop out), then put recordings end to end.

    `durations` has one row per recording: the running offset is over recordings, not samples.
    """
    na = sequence(a.select(rec, F.col(t).alias("_ta")), [rec], ["_ta"], width=width, row_number="pair_no")
    nb = sequence(b.select(rec, F.col(t).alias("_tb")), [rec], ["_tb"], width=width, row_number="pair_no")
    w = Window.orderBy(rec).rowsBetween(Window.unboundedPreceding, -1)
    off = durations.select(rec, F.coalesce(F.sum("dur").over(w), F.lit(0.0)).alias("_off"))
    j = na.join(nb, [rec, "pair_no"]).join(off, rec)
    return j.select(rec, F.col("pair_no").cast("long").alias("pair_no"), (F.col("_ta") + F.col("_off")).alias("t_a"),
                    (F.col("_tb") + F.col("_off")).alias("t_b"))


# ---- edges and pulses ----
def threshold_edges(samples: DataFrame, keys: list[str], t: str, state: Column, *, width: float) -> DataFrame:
    """Samples where the level changes; the first sample of a channel is never an edge."""
    s = sequence(samples.withColumn("_on", state), keys, [t], width=width, lag={"_prev": "_on"})
    return s.filter(F.col("_on") != F.col("_prev")).withColumn("rising", F.col("_on")).drop("_on", "_prev")


def pulses(edges: DataFrame, keys: list[str], t: str, *, width: float) -> DataFrame:
    """Rise followed by fall, with the midpoint; incomplete pulses at both ends drop out."""
    e = sequence(edges.select(*keys, t, "rising"), keys, [t], width=width, lead={"end_s": t})
    e = e.filter(F.col("rising") & F.col("end_s").isNotNull()).select(*keys, F.col(t).alias("start_s"), "end_s")
    return e.withColumn("mid_s", (F.col("start_s") + F.col("end_s")) / 2)


def edge_select(p: DataFrame, keys: list[str], which: str) -> DataFrame:
    """Rising, falling or both ends of pulse pairs as one column."""
    cols = {"rising": ["start_s"], "falling": ["end_s"], "both": ["start_s", "end_s"]}[which]
    return p.select(*keys, F.explode(F.array(*cols)).alias("edge_s"))


def fill_short_gaps(rows: DataFrame, keys: list[str], idx: str, mask: str, k: int, *, width: float, polarity: bool = True) -> DataFrame:
    """Runs of the other state not longer than k between two rows of `polarity` are switched. Rows are numbered by idx."""
    on = F.col(mask) if polarity else ~F.col(mask)
    s = sequence(rows, keys, [idx], width=width, last={"_a": F.when(on, F.col(idx))}, nxt={"_b": F.when(on, F.col(idx))})
    fill = (F.col("_b") - F.col("_a") - 1) <= k
    filled = on | F.coalesce(fill, F.lit(False))
    return s.withColumn(mask, filled if polarity else ~filled).drop("_a", "_b")


def threshold_periods(samples: DataFrame, keys: list[str], t: str, above: Column, *, min_s: float = 0.0, max_gap_s: float = 0.0, width: float) -> DataFrame:
    """Periods of a condition: from the sample before the rise to the last true sample, short interruptions bridged."""
    s = sequence(samples.withColumn("_on", above), keys, [t], width=width, lag={"_p": "_on", "_pt": t}, lead={"_n": "_on"})
    s = s.filter("_on")
    starts = F.when(F.col("_p").isNull(), F.col(t)).when(~F.col("_p"), F.col("_pt"))
    stops = F.when(F.col("_n").isNull() | ~F.col("_n"), F.col(t))
    # a rise and its fall may be different rows, so both go through one ordered stream of marks
    marks = s.select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("k"), starts.alias("at"), F.col(t).alias("o")),
                                              F.struct(F.lit(1).alias("k"), stops.alias("at"), F.col(t).alias("o")))).alias("m")).select(*keys, "m.*").filter("at IS NOT NULL")
    p = sequence(marks, keys, ["o", "k"], width=width, lead={"end_s": "at"}).filter("k = 0").select(*keys, F.col("at").alias("start_s"), "end_s")
    runs = islands(p, keys, ["start_s"], F.col("_pe").isNull() | (F.col("start_s") - F.col("_pe") > max_gap_s), width=width, lag={"_pe": "end_s"})
    m = runs.groupBy(*keys, "run_id").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"))
    return m.filter(F.col("end_s") - F.col("start_s") >= min_s).drop("run_id")


def unwrap(rows: DataFrame, keys: list[str], t: str, phase: str, *, width: float, out: str = "unwrapped_rad") -> DataFrame:
    """Remove 2 pi jumps inside a run: minus 2 pi times the running sum of rounded jumps."""
    tau = 6.283185307179586
    s = sequence(rows, keys, [t], width=width, lag={"_p": phase}, keep_bucket=True)
    s = s.withColumn("_j", F.coalesce(F.round((F.col(phase) - F.col("_p")) / tau), F.lit(0.0))).drop("_p")
    return sequence(s, keys, [t], width=width, cumsum={"_k": "_j"}).withColumn(out, F.col(phase) - tau * F.col("_k")).drop("_j", "_k")


def interp_missing(rows: DataFrame, keys: list[str], idx: str, value: str, *, width: float) -> DataFrame:
    """Linear fill between valid neighbours; ends take the nearest valid value."""
    p = F.when(F.col(value).isNotNull(), F.struct(F.col(idx).alias("i"), F.col(value).alias("v")))
    s = sequence(rows, keys, [idx], width=width, last={"_a": p}, nxt={"_b": p})
    f = (F.col(idx) - F.col("_a.i")) / (F.col("_b.i") - F.col("_a.i"))
    y = F.when(F.col("_a").isNull(), F.col("_b.v")).when(F.col("_b").isNull() | (F.col("_a.i") == F.col("_b.i")), F.col("_a.v")).otherwise(
        F.col("_a.v") + f * (F.col("_b.v") - F.col("_a.v")))
    return s.withColumn(value, y).drop("_a", "_b")


def interp_replace(rows: DataFrame, edits: DataFrame, keys: list[str], idx: str, value: str) -> DataFrame:
    """Replace positions start..end by n evenly spaced values between both end values, then renumber.

    `edits`: one row per key with start, stop, n. New positions follow from the edit alone, so no global
    numbering is needed.
    """
    j = rows.join(edits, keys, "left")
    i = F.col(idx)
    ends = j.filter((i == F.col("start")) | (i == F.col("stop"))).groupBy(*keys).agg(
        F.max(F.when(i == F.col("start"), F.col(value))).alias("_v0"), F.max(F.when(i == F.col("stop"), F.col(value))).alias("_v1"))
    outside = j.filter(F.col("start").isNull() | (i < F.col("start")) | (i > F.col("stop")))
    moved = F.when(F.col("start").isNotNull() & (i > F.col("stop")), i + F.col("n") - (F.col("stop") - F.col("start") + 1)).otherwise(i)
    kept = outside.select(*keys, moved.alias(idx), value)
    new = edits.join(ends, keys).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    new = new.select(*keys, (F.col("start") + F.col("_k")).alias(idx), (F.col("_v0") + F.col("_k") * (F.col("_v1") - F.col("_v0")) / (F.col("n") - 1)).alias(value))
    return kept.unionByName(new)


def apply_session_edit(rows: DataFrame, edits: DataFrame, keys: list[str], idx: str, value: str, *, width: float) -> DataFrame:
    """Delete by original index, renumber from 0, then interpolate on the new index."""
    gone = edits.select(*keys, F.explode("delete_frames").alias(idx)).distinct()
    left = rows.join(gone, [*keys, idx], "left_anti")
    left = sequence(left, keys, [idx], width=width, row_number="_r").withColumn(idx, (F.col("_r") - 1).cast("long")).drop("_r")
    e = edits.filter("start IS NOT NULL").select(*keys, F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), F.col("n").cast("long").alias("n"))
    return interp_replace(left.select(*keys, idx, value), e, keys, idx, value)


# ---- trains of edges ----
def typical_intervals(edges: DataFrame, keys: list[str], t: str, *, tolerance: float, width: float, gap_width: float | None = None) -> DataFrame:
    """Interval to the next edge with its typical flag and 0-based edge index."""
    from .ordered import exact_quantile
    from ..session import cut_lineage
    e = cut_lineage(sequence(edges, keys, [t], width=width, lead={"_nt": t}, row_number="_r").withColumn("edge_idx", (F.col("_r") - 1).cast("long")).drop("_r"))
    e = e.withColumn("interval_s", F.col("_nt") - F.col(t)).drop("_nt")
    med = exact_quantile(e, keys, "interval_s", 0.5, "typical_s", width=gap_width)
    e = e.join(med, keys)
    return e.withColumn("typical", F.abs(F.col("interval_s") - F.col("typical_s")) <= tolerance * F.col("typical_s"))


def periodic_block(iv: DataFrame, keys: list[str], t: str, support: int, *, width: float) -> DataFrame:
    """First and last edge of the stretch spanned by windows of `support` consecutive typical intervals.

    A window of n typical intervals exists exactly inside a run of at least n of them, so runs replace the
    sliding count.
    """
    from .ordered import BUCKET
    r = iv.filter("interval_s IS NOT NULL")
    r = islands(r, keys, [t], ~F.col("typical") | F.coalesce(~F.col("_p"), F.lit(True)), width=width, lag={"_p": "typical"})
    runs = r.filter("typical").groupBy(*keys, "run_id").agg(F.count(F.lit(1)).alias("n"), F.min("edge_idx").alias("a"), F.max("edge_idx").alias("b")).filter(F.col("n") >= support)
    return runs.groupBy(*keys).agg(F.min("a").alias("first_edge"), (F.max("b") + 1).alias("last_edge"))


def gap_groups(iv: DataFrame, keys: list[str], t: str, *, tolerance: float, phase_tol: float, width: float, direction: str | None = None) -> DataFrame:
    """Runs of abnormal intervals with the expected interval count, phase error and repair flag."""
    r = islands(iv.filter("interval_s IS NOT NULL"), keys, [t], F.col("typical") | F.coalesce(F.col("_p"), F.lit(True)), width=width, lag={"_p": "typical"})
    extra = [F.min_by(direction, t).alias("_d0"), F.max_by(F.col("_nd"), F.col(t)).alias("_d1")] if direction else []
    g = r.filter("NOT typical").groupBy(*keys, "run_id").agg(
        F.min("edge_idx").alias("left_edge"), (F.max("edge_idx") + 1).alias("right_edge"), F.min(t).alias("left_s"), F.sum("interval_s").alias("span_s"),
        F.count(F.lit(1)).alias("observed"), F.max(F.col("interval_s") < (1 - tolerance) * F.col("typical_s")).alias("has_short"),
        F.max(F.col("interval_s") > (1 + tolerance) * F.col("typical_s")).alias("has_long"), F.first("typical_s").alias("typical_s"), *extra)
    g = g.withColumn("expected", F.rint(F.col("span_s") / F.col("typical_s")).cast("long"))
    g = g.withColumn("change", F.col("expected") - F.col("observed")).withColumn("phase_error", F.abs(F.col("span_s") / F.col("typical_s") - F.col("expected")))
    pol = F.lit(True)
    if direction:
        pol = F.col("_d1") == F.when(F.col("expected") % 2 == 0, F.col("_d0")).otherwise(-F.col("_d0"))
    ok = (F.col("change") > 0) & (F.col("phase_error") <= phase_tol) & F.col("has_short") & F.col("has_long") & pol
    return g.withColumn("candidate", ok).drop("run_id", *(["_d0", "_d1"] if direction else []))


def gap_repair_plan(groups: DataFrame, required: DataFrame, keys: list[str]) -> DataFrame:
    """Pick the one subset of candidates whose changes sum to the required count; refuse when there is not exactly one.

    n_plans is 0, 1, or 2 for more. Subsets are counted by a running table of sums (a recording has few candidate gaps); with a single
    solution, a candidate belongs to it exactly when leaving the candidate out removes every solution.
    """
    c = groups.filter("candidate").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("left_edge", F.col("change").cast("int").alias("change")))).alias("_c"))
    j = required.join(c, keys, "left").withColumn("_c", F.coalesce("_c", F.array().cast("array<struct<left_edge:bigint,change:int>>")))
    need = F.greatest(F.col("required").cast("int"), F.lit(0))

    def ways(items):
        start = F.transform(F.sequence(F.lit(0), need), lambda s: F.when(s == 0, F.lit(1)).otherwise(F.lit(0)).cast("long"))
        step = lambda acc, e: F.transform(acc, lambda v, s: F.least(F.lit(2).cast("long"), v + F.when(s >= e["change"], F.get(acc, s - e["change"])).otherwise(F.lit(0)).cast("long")))
        return F.get(F.aggregate(items, start, step), need)

    j = j.withColumn("n_plans", F.when(F.col("required") > 0, ways(F.col("_c"))).otherwise(F.lit(0).cast("long")))
    chosen = F.filter("_c", lambda e: ways(F.filter("_c", lambda o: o["left_edge"] != e["left_edge"])) == 0)
    j = j.withColumn("selected_edges", F.when(F.col("n_plans") == 1, F.transform(chosen, lambda e: e["left_edge"])))
    status = F.when(F.col("required") < 0, "extra_transitions").when(F.col("required") == 0, "complete").when(F.col("n_plans") == 1, "repaired").when(F.col("n_plans") == 0, "no_plan").otherwise("ambiguous")
    return j.select(*keys, "required", "n_plans", "selected_edges", status.alias("status"))


def repaired_edges(groups: DataFrame, plan: DataFrame, keys: list[str]) -> DataFrame:
    """Evenly spaced edges that replace the inside of every selected gap."""
    s = plan.select(*keys, F.explode("selected_edges").alias("left_edge"))
    g = groups.join(s, [*keys, "left_edge"]).withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("expected") - 1)))
    return g.select(*keys, "left_edge", F.col("_k").cast("int").alias("k"), (F.col("left_s") + F.col("_k") * F.col("span_s") / F.col("expected")).alias("edge_s"))


def trim_abnormal_ends(iv: DataFrame, keys: list[str]) -> DataFrame:
    """Edges to keep after cutting abnormal runs that touch either end: first normal interval's start to last normal's end."""
    r = iv.filter("interval_s IS NOT NULL")
    return r.groupBy(*keys).agg(F.min(F.when(F.col("typical"), F.col("edge_idx"))).alias("first_edge"), (F.max(F.when(F.col("typical"), F.col("edge_idx"))) + 1).alias("last_edge"),
                                (F.max("edge_idx") + 1).alias("n_last"))


# ---- pulse groups and stages ----
def classify_pulse_groups(p: DataFrame, keys: list[str], *, gap: float, tolerance: float, width: float, start: str = "start_s", end: str = "end_s") -> DataFrame:
    """Singles, doubles and triples of close pulses; a longer close run splits 3, 3, ..., rest."""
    r = islands(p, keys, [start], F.coalesce(F.abs(F.col(start) - F.col("_pe") - gap) > tolerance, F.lit(True)), width=width, lag={"_pe": end})
    r = sequence(r, [*keys, "run_id"], [start], width=width, row_number="_pos")
    r = r.withColumn("group_no", F.floor((F.col("_pos") - 1) / 3).cast("long"))
    n = r.groupBy(*keys, "run_id").agg(F.count(F.lit(1)).alias("_len"))
    r = r.join(n, [*keys, "run_id"])
    return r.withColumn("stage", F.least(F.lit(3), F.col("_len") - F.col("group_no") * 3).cast("int")).drop("_len", "_pos", "run_id", "group_no")


def stage_intervals(p: DataFrame, keys: list[str], *, rec: DataFrame | None, width: float, start: str = "start_s", end: str = "end_s") -> DataFrame:
    """Runs of equal stage; a run ends just before the next one starts; recording ends are padded."""
    from ..session import cut_lineage
    r = islands(p, keys, [start], F.coalesce(F.col("stage") != F.col("_ps"), F.lit(True)), width=width, lag={"_ps": "stage"})
    g = cut_lineage(r.groupBy(*keys, "run_id").agg(F.first("stage").alias("stage"), F.min(start).alias("start"), F.max(end).alias("_e")))
    g = sequence(g, keys, ["run_id"], width=1e6, lead={"_ns": "start"}, lag={"_before": "run_id"})
    g = g.select(*keys, "stage", "start", F.coalesce(F.col("_ns") - 1, F.col("_e")).alias("stop"), F.col("_before").isNull().alias("_first"), F.col("_ns").isNull().alias("_last"))
    if rec is None:
        return g.drop("_first", "_last")
    j = g.join(rec, keys)
    prev = F.when(F.col("stage") > 1, F.col("stage") - 1).otherwise(F.lit(3))
    parts = F.array(F.struct(F.col("stage"), F.col("start"), F.col("stop"), F.lit(True).alias("ok")),
                    F.struct(prev.alias("stage"), F.col("rec_start").alias("start"), (F.col("start") - 1).alias("stop"), (F.col("_first") & (F.col("start") > F.col("rec_start"))).alias("ok")),
                    F.struct(F.col("stage"), (F.col("stop") + 1).alias("start"), F.col("rec_end").alias("stop"), (F.col("_last") & (F.col("stop") < F.col("rec_end"))).alias("ok")))
    return j.select(*keys, F.explode(parts).alias("p")).select(*keys, "p.*").filter("ok").drop("ok")


def classify_durations(p: DataFrame, keys: list[str], order: str, dur: str, *, short: float, medium: float, long: float, start_max: float, width: float) -> DataFrame:
    """start / triplet / broadlet / singlet per group. Two triplets can never overlap, as their duration classes
    contradict each other, so the pattern is a pure look-ahead."""
    s = sequence(p, keys, [order], width=width, lead={"_d1": dur}, row_number="_n", keep_bucket=True)
    s = sequence(s, keys, [order], width=width, lead={"_d2": "_d1"}, lag={"_b1": dur}, keep_bucket=True)
    first = (F.col("_n") == 1) & (F.col(dur) < start_max)
    trip = lambda a, b, c: F.coalesce((a < short) & (b >= short) & (b < medium) & (c >= medium), F.lit(False))
    s = s.withColumn("_t", trip(F.col(dur), F.col("_d1"), F.col("_d2")) & ~first)
    s = sequence(s, keys, [order], width=width, lag={"_t1": "_t"}, keep_bucket=True)
    s = sequence(s, keys, [order], width=width, lag={"_t2": "_t1"})
    s = s.filter(~F.coalesce(F.col("_t1"), F.lit(False)) & ~F.coalesce(F.col("_t2"), F.lit(False)))
    kind = F.when(first, "start_indicator").when(F.col("_t"), "triplet").when(F.col(dur) > long, "broadlet").otherwise("singlet")
    return s.withColumn("kind", kind).drop("_d1", "_d2", "_b1", "_n", "_t", "_t1", "_t2")


def duration_classes(p: DataFrame, dur: str, short: float, medium: float) -> DataFrame:
    return p.withColumn("duration_class", F.when(F.col(dur) < short, "short").when(F.col(dur) < medium, "medium").otherwise("long"))


def burst_edges(edges: DataFrame, keys: list[str], t: str, threshold: float, *, width: float) -> DataFrame:
    """First edge of each run in which gaps stay below, or stay at or above, the threshold."""
    s = sequence(edges, keys, [t], width=width, lead={"_n": t}, keep_bucket=True).withColumn("close", (F.col("_n") - F.col(t)) < threshold)
    s = sequence(s, keys, [t], width=width, lag={"_p": "close", "_pt": t}).filter("close IS NOT NULL")
    return s.filter(F.col("_pt").isNull() | (F.col("close") != F.col("_p"))).drop("_n", "_p", "_pt")


def combine_close_events(events: DataFrame, samples: DataFrame, keys: list[str], *, max_gap: float, trough: float, t: str, value: str, widths: tuple[float, ...], width: float) -> DataFrame:
    """Join an event with its successor when they are close and the signal dips low between them."""
    from .intervals import window_join
    e = sequence(events, keys, ["start_s"], width=width, lead={"_ns": "start_s", "_ne": "end_s"}).filter("_ns IS NOT NULL")
    hit = window_join(samples.select(*keys, t, value), e.select(*keys, F.col("start_s").alias("_k"), F.col("end_s").alias("_e0"), F.col("_ns").alias("_e1")), keys, t,
                      start="_e0", end="_e1", widths=widths, closed="both")
    lo = hit.groupBy(*keys, F.col("_k").alias("start_s")).agg(F.min(value).alias("_min"))
    j = e.join(lo, [*keys, "start_s"], "left")
    join = F.coalesce((F.col("_ns") - F.col("end_s") <= max_gap) & (F.col("_min") <= trough), F.lit(False))
    return j.select(*keys, "start_s", F.when(join, F.col("_ne")).otherwise(F.col("end_s")).alias("end_s"), join.alias("combined"))


def distribute_plateau(rows: DataFrame, keys: list[str], idx: str, value: str, *, width: float) -> DataFrame:
    """Spread the jump after a flat run over the run in integer steps (floor), end value included."""
    from ..session import cut_lineage
    r = cut_lineage(islands(rows, keys, [idx], F.coalesce(F.col(value) != F.col("_p"), F.lit(True)), width=width, lag={"_p": value}))
    g = r.groupBy(*keys, "run_id").agg(F.count(F.lit(1)).alias("_len"), F.min(idx).alias("_i0"), F.first(value).alias("_v"))
    g = sequence(g, keys, ["run_id"], width=1e6, lead={"_nv": "_v"}).drop("_v")
    j = r.join(g, [*keys, "run_id"])
    y = F.floor(F.col(value) + (F.col(idx) - F.col("_i0")) * (F.col("_nv") - F.col(value)) / (F.col("_len") - 1)).cast("double")
    return j.withColumn(value, F.when((F.col("_len") > 1) & F.col("_nv").isNotNull(), y).otherwise(F.col(value))).drop("run_id", "_len", "_i0", "_nv")


# ---- cycles and intervals ----
def cycle_ranges(anchors: DataFrame, keys: list[str], t: str, *, rec_end: str, width: float, sub: list[str] = (), ties: list[str] = ()) -> DataFrame:
    """Cycle end = next start - 1, the last one ends with the recording; `sub` nests the rule one level down.

    `ties` orders anchors of one time; without it their order is open."""
    s = sequence(anchors, [*keys, *sub], [t, *ties], width=width, lead={"_n": t})
    return s.withColumn("stop", F.coalesce(F.col("_n") - 1, F.col(rec_end))).drop("_n")


def scale_cycles(cycles: DataFrame, cols: list[str], factor: float) -> DataFrame:
    return cycles.withColumns({c: F.rint(F.col(c) / factor).cast("long") for c in cols})


def raw_intervals(on: DataFrame, keys: list[str], t: str, *, min_s: float, rules: list[tuple[str, float, float]], width: float) -> DataFrame:
    """Pairs of consecutive on-times with a minimum duration, labelled by the first duration rule that holds."""
    s = sequence(on, keys, [t], width=width, lead={"_n": t}).filter(F.col("_n") - F.col(t) >= min_s)
    d = F.col("_n") - F.col(t)
    lab = F.coalesce(*[F.when((d >= lo) & (d <= hi), F.lit(name)) for name, lo, hi in rules], F.lit("other"))
    return s.select(*keys, F.col(t).alias("start_s"), F.col("_n").alias("end_s"), d.alias("duration_s"), lab.alias("interval_type"))


DURATION_RULES = [("combo", 14.0, 15.5), ("combo", 29.5, 30.5), ("hold", 19.5, 20.5), ("baseline", 299.5, 301.5), ("baseline", 1799.0, 1801.0)]


def protocol_match(observed: DataFrame, expected: DataFrame, keys: list[str], *, tol: float = 0.05) -> DataFrame:
    """Greedy ordered match of observed to expected durations.

    The next match depends on the previous one, so each session folds its own short interval list (a protocol
    has tens of entries). An observed interval takes the earliest remaining expected entry within tol; entries
    with its own label win when there are any.
    """
    o = observed.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("start_s", "duration_s", "interval_type"))).alias("_o"))
    e = expected.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("position", "expected_s", "label"))).alias("_e"))
    # a session without a protocol keeps its intervals, all unmatched
    j = o.join(e, keys, "left").withColumn("_e", F.coalesce("_e", F.array().cast("array<struct<position:int,expected_s:double,label:string>>")))
    start = F.struct(F.lit(0).alias("next"), F.array().cast("array<struct<start_s:double,duration_s:double,interval_type:string,position:int,label:string,error_pct:double>>").alias("out"))

    def step(acc, x):
        err = lambda c: F.abs(x["duration_s"] - c["expected_s"]) / c["expected_s"] * 100.0
        fit = F.filter("_e", lambda c: (c["position"] >= acc["next"]) & (c["expected_s"] > 0) & (err(c) <= tol * 100.0))
        own = F.filter(fit, lambda c: c["label"] == x["interval_type"])
        use = F.when((x["interval_type"] != "other") & (F.size(own) > 0), own).otherwise(fit)
        best = F.get(use, F.lit(0))
        row = F.struct(x["start_s"].alias("start_s"), x["duration_s"].alias("duration_s"), x["interval_type"].alias("interval_type"), best["position"].cast("int").alias("position"),
                       best["label"].alias("label"), F.when(best.isNotNull(), err(best)).alias("error_pct"))
        return F.struct(F.coalesce(best["position"].cast("int") + 1, acc["next"]).alias("next"), F.concat(acc["out"], F.array(row)).alias("out"))

    m = j.withColumn("_m", F.aggregate("_o", start, step)["out"]).select(*keys, F.explode("_m").alias("m")).select(*keys, "m.*")
    method = F.when(F.col("position").isNull(), "unmatched").when(F.col("label") == F.col("interval_type"), "ordered_match").otherwise("fallback")
    return m.withColumn("method", method).withColumn("resolved", F.coalesce("label", "interval_type"))


def threshold_curve(rows: DataFrame, keys: list[str], value: str, thresholds: list[float]) -> DataFrame:
    """Percentage of samples above each threshold, one pass with one aggregate per threshold."""
    g = rows.groupBy(*keys).agg(*[F.avg(F.when(F.col(value) > x, 100.0).otherwise(0.0)).alias(f"_{i}") for i, x in enumerate(thresholds)])
    arr = F.array(*[F.struct(F.lit(float(x)).alias("threshold"), F.col(f"_{i}").alias("pct")) for i, x in enumerate(thresholds)])
    return g.select(*keys, F.explode(arr).alias("r")).select(*keys, "r.*")
