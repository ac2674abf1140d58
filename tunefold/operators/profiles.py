"""Profiles: peaks, orders, scaling, regridding, alignment and pairing of curve tables.

One curve is at most a few hundred bins, so windows keyed by the unit are small by construction.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.angles import col, wrap180, wrap360


def peak_bin(curve: DataFrame, keys: list[str], axis: list[str], value: str, *, lowest: bool = False) -> DataFrame:
    """Bin of the maximum (or minimum), first bin on ties, none when everything is missing; also the tie count."""
    v = F.col(value)
    score = -v if lowest else v
    order = F.when(v.isNotNull(), F.struct(score.alias("v"), *[(-F.col(a)).alias(f"a{i}") for i, a in enumerate(axis)]))
    g = curve.groupBy(*keys).agg(F.max_by(F.struct(*axis), order).alias("_p"), (F.min(v) if lowest else F.max(v)).alias("peak_value"))
    return g.select(*keys, *[F.col(f"_p.{a}").alias(f"peak_{a}") for a in axis], "peak_value").filter(F.col("peak_value").isNotNull())


def peak_ties(curve: DataFrame, keys: list[str], value: str) -> DataFrame:
    """How many bins share the maximum."""
    w = Window.partitionBy(*keys)
    return (curve.withColumn("_m", F.max(value).over(w)).groupBy(*keys)
            .agg(F.count_if(F.col(value) == F.col("_m")).alias("n_ties")))


def peak_order(peaks: DataFrame, group: list[str], peak: str, original: list[str]) -> DataFrame:
    """Rank units by peak, then original order; units without a peak go last. One row per unit."""
    from .ordered import sequence
    d = peaks.withColumn("_g", F.lit(0)).withColumn("_pk", F.coalesce(F.col(peak).cast("double"), F.lit(float("inf"))))
    # numbering is cut by peak value, so the cohort never has to be sorted in one task
    cut = F.coalesce(F.floor(F.col(peak)).cast("long"), F.lit(2 ** 62))
    return sequence(d, ["_g", *group], ["_pk", *original], bucket=cut, row_number="order_no").drop("_g", "_pk").withColumn("order_no", F.col("order_no").cast("int"))


def normalize_max(curve: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Divide by the row maximum; all-zero rows stay zero."""
    m = F.max(value).over(Window.partitionBy(*keys))
    return curve.withColumn(value, F.when(m > 0, F.col(value) / m).otherwise(F.col(value)))


def minmax(curve: DataFrame, keys: list[str], value: str) -> DataFrame:
    w = Window.partitionBy(*keys)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return curve.withColumn(value, F.when(hi > lo, (F.col(value) - lo) / (hi - lo)).when(F.col(value).isNotNull(), F.lit(0.0)))


def zscore(curve: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Population SD; a constant row has no score."""
    w = Window.partitionBy(*keys)
    sd = F.stddev_pop(value).over(w)
    return curve.withColumn(value, F.when(sd > 0, (F.col(value) - F.avg(value).over(w)) / sd))


def reference_levels(df: DataFrame, keys: list[str], value: str, k: float) -> DataFrame:
    """mean and mean +- k population SD."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), (F.avg(value) - k * F.stddev_pop(value)).alias("low"),
                                 (F.avg(value) + k * F.stddev_pop(value)).alias("high"))


def rebin_adjacent(curve: DataFrame, keys: list[str], group: int, value: str) -> DataFrame:
    """Sum adjacent bins; a missing bin makes its group missing."""
    from .rates import strict_sum
    return curve.groupBy(*keys, F.floor(F.col("bin") / group).cast("int").alias("bin")).agg(strict_sum(value).alias(value))


def pool_exposure_rebin(curve: DataFrame, keys: list[str], group: int, *, rate: str = "rate_hz", seconds: str = "occ_s") -> DataFrame:
    """rate x seconds -> rebin -> divide -> row maximum 1."""
    g = curve.withColumn("_n", F.col(rate) * F.col(seconds)).groupBy(*keys, F.floor(F.col("bin") / group).cast("int").alias("bin")).agg(
        F.sum("_n").alias("_n"), F.sum(seconds).alias(seconds))
    g = g.withColumn(rate, F.when(F.col(seconds) > 0, F.col("_n") / F.col(seconds))).drop("_n")
    return normalize_max(g, keys, rate)


def resample(curve: DataFrame, keys: list[str], angle: str, value: str, n_out: int, *, period: float = 360.0,
             shift: Column | None = None, start: float | None = None, periodic: bool = True, fill=None) -> DataFrame:
    """Linear interpolation of knots (angle, value) to n_out bin centers, optionally shifted per row's unit.

    Knots carry their right neighbour (the first knot again, one period later, when periodic); every
    segment emits the targets that fall inside it, so no join is needed. Missing knots blank their segments.
    """
    step = period / n_out
    lo0 = (step / 2) if start is None else start
    w = Window.partitionBy(*keys).orderBy(angle)
    full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    k = curve.withColumns({"_na": F.lead(angle).over(w), "_nv": F.lead(value).over(w), "_fa": F.first(angle).over(full), "_fv": F.first(value).over(full)})
    sh = F.lit(0.0) if shift is None else shift
    if periodic:
        k = k.withColumns({"_nv": F.when(F.col("_na").isNull(), F.col("_fv")).otherwise(F.col("_nv")),
                           "_na": F.coalesce(F.col("_na"), F.col("_fa") + period)})
        # targets j with center(j) + shift in [angle, next) modulo the period
        a = (F.col(angle) - sh - lo0) / step
        b = (F.col("_na") - sh - lo0) / step
        first, last = F.ceil(a).cast("int"), (F.ceil(b) - 1).cast("int")
    else:
        a, b = (F.col(angle) - sh - lo0) / step, (F.col("_na") - sh - lo0) / step
        first = F.greatest(F.ceil(a), F.lit(0)).cast("int")
        tail = F.col("_na").isNull()
        last = F.least(F.when(tail, F.when(a == first, first).otherwise(first - 1)).otherwise(F.ceil(b) - 1), F.lit(n_out - 1)).cast("int")
    k = k.filter(first <= last).withColumn("_j", F.explode(F.sequence(first, last)))
    pos = F.lit(lo0) + F.col("_j") * step + sh
    frac = (pos - F.col(angle)) / (F.col("_na") - F.col(angle))
    y = F.when(F.col("_na").isNull() | (frac == 0), F.col(value)).otherwise(F.col(value) + frac * (F.col("_nv") - F.col(value)))
    j = F.pmod(F.col("_j"), F.lit(n_out)) if periodic else F.col("_j")
    out = k.select(*keys, j.cast("int").alias("bin"), y.alias(value))
    if periodic or fill is None:
        return out
    from .tuning import dense_units
    return (dense_units(curve, keys, n_out).join(out.withColumn("_has", F.lit(True)), [*keys, "bin"], "left")
            .withColumn(value, F.when(F.col("_has").isNull(), F.lit(fill)).otherwise(F.col(value))).drop("_has"))


def align_profiles(curve: DataFrame, offsets: DataFrame, keys: list[str], angle: str, value: str, n_out: int) -> DataFrame:
    """Shift every unit so its own offset comes to 0, on a [-180, 180) grid of bin centers."""
    c = curve.join(offsets, keys)
    c = c.filter(F.col("offset_deg").isNotNull())
    return resample(c, keys, angle, value, n_out, shift=F.col("offset_deg"), start=-180.0 + 180.0 / n_out)


def peak_histogram(peaks: DataFrame, group: list[str], peak: str, n: int) -> DataFrame:
    """Counts per peak bin with empty bins kept."""
    from .tuning import dense_units
    c = peaks.filter(F.col(peak).isNotNull()).groupBy(*group, F.col(peak).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return dense_units(peaks, group, n).join(c, [*group, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def pair_units(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of one-row-per-unit tables on full identity."""
    return a.join(b, keys)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Violation rows: identities that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def pair_eligibility(curves: DataFrame, keys: list[str], feature: str, value: str, a: str, b: str) -> DataFrame:
    """Units whose curves are complete and not constant in both features."""
    g = curves.filter(F.col(feature).isin(a, b)).groupBy(*keys).agg(*[
        F.bool_and(F.when(F.col(feature) == f, F.col(value).isNotNull())).alias(f"full_{t}") for f, t in ((a, "a"), (b, "b"))], *[
        (F.max(F.when(F.col(feature) == f, F.col(value))) > F.min(F.when(F.col(feature) == f, F.col(value)))).alias(f"varies_{t}")
        for f, t in ((a, "a"), (b, "b"))])
    return g.withColumn("eligible", F.coalesce(F.col("full_a") & F.col("full_b") & F.col("varies_a") & F.col("varies_b"), F.lit(False)))


def pair_audit(a: DataFrame, b: DataFrame, keys: list[str], selection: DataFrame, peak: str) -> DataFrame:
    """Audit flags of a two-table pairing; selected means no flag is raised."""
    j = (a.select(*keys, F.lit(True).alias("_a"), F.col(peak).alias("_pa"))
         .join(b.select(*keys, F.lit(True).alias("_b"), F.col(peak).alias("_pb")), keys, "full_outer")
         .join(selection.select(*keys).distinct().withColumn("_s", F.lit(True)), keys, "left"))
    j = j.select(*keys, F.col("_a").isNull().alias("missing_a"), F.col("_b").isNull().alias("missing_b"),
                 F.col("_s").isNull().alias("outside_selection"),
                 (~F.coalesce((F.col("_pa") > 0) & (F.col("_pb") > 0), F.lit(False))).alias("no_positive_peak"))
    return j.withColumn("selected", ~(F.col("missing_a") | F.col("missing_b") | F.col("outside_selection") | F.col("no_positive_peak")))


def top_bins(peaks: DataFrame, peak: str, k: int) -> DataFrame:
    """The k fullest peak bins, ties to the lower index. The histogram has a fixed number of bins."""
    h = peaks.filter(F.col(peak).isNotNull()).groupBy(peak).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(F.desc("n"), peak)
    return h.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def select_schemes(pairs: DataFrame, peak: str, k: int, valid: Column, strict: Column) -> DataFrame:
    """Three nested cohorts: valid, strict, and strict units in the k fullest bins of the strict histogram."""
    s = pairs.withColumns({"scheme_1": F.coalesce(valid, F.lit(False)), "scheme_2": F.coalesce(valid & strict, F.lit(False))})
    top = top_bins(s.filter("scheme_2"), peak, k).select(peak, F.lit(True).alias("_top"))
    return s.join(F.broadcast(top), peak, "left").withColumn("scheme_3", F.col("scheme_2") & F.coalesce("_top", F.lit(False))).drop("_top")


def signed_order(curve: DataFrame, n: int) -> DataFrame:
    """Position of each 0-360 bin on the -180..180 axis; values untouched."""
    return curve.withColumn("signed_pos", F.pmod(F.col("bin") + F.lit(n // 2), F.lit(n)))


def overview_order(curve: DataFrame, keys: list[str], value: str, group: list[str]) -> DataFrame:
    """Display table: rows scaled by their maximum, units numbered by peak."""
    p = peak_order(peak_bin(curve, keys, ["bin"], value), group, "peak_bin", keys)
    return normalize_max(curve, keys, value).join(p.select(*keys, "order_no"), keys)


def stack_curves(tables: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Union of curve tables with a label."""
    out = None
    for name, t in tables.items():
        t = t.withColumn("label", F.lit(name))
        out = t if out is None else out.unionByName(t)
    return out
