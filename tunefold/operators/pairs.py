"""Population pairing statistics. Everything that only depends on pairs of peaks is computed from sums or from
a table of distinct peak states with multiplicities, never from all unit pairs."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.angles import col, cosd, sind, wrap180, wrap360, direction, circular_distance, unit_clip
from ..functions.special import cramer3
from .ordered import sequence
from .profiles import peak_bin, peak_order, align_profiles


def prepare_comparison(reference: DataFrame, matched: DataFrame, keys: list[str], n: int, value: str = "rate_hz") -> DataFrame:
    """Matched curves shifted by the reference peak, with both peaks, the peak sum and the display order."""
    rp = peak_bin(reference, keys, ["bin"], value).select(*keys, F.col("peak_bin").alias("reference_peak"))
    mp = peak_bin(matched, keys, ["bin"], value).select(*keys, F.col("peak_bin").alias("matched_peak"))
    both = rp.join(mp, keys).withColumn("sum_peak", F.pmod(F.col("reference_peak") + F.col("matched_peak"), F.lit(n)))
    ranked = peak_order(both, [], "reference_peak", keys)
    off = rp.select(*keys, ((F.col("reference_peak") + 0.5) * (360.0 / n)).alias("offset_deg"))
    c = matched.select(*keys, ((F.col("bin") + 0.5) * (360.0 / n)).alias("deg"), value)
    return align_profiles(c, off, keys, "deg", value, n).join(ranked, keys)


def fisher_lee_sums(a, b, w: Column | None = None) -> dict[str, Column]:
    """Aggregates that fix the Fisher-Lee coefficient (double-angle identity, O(n))."""
    a, b = F.radians(col(a)), F.radians(col(b))
    w = F.lit(1.0) if w is None else w
    out = {"fl_n": F.sum(w)}
    for name, x in (("d", a - b), ("p", a + b), ("a", 2.0 * a), ("b", 2.0 * b)):
        out[f"fl_c{name}"], out[f"fl_s{name}"] = F.sum(w * F.cos(x)), F.sum(w * F.sin(x))
    return out


def fisher_lee_value() -> Column:
    """rho from fisher_lee_sums; NULL below three pairs or when one side is degenerate."""
    sq = lambda t: F.col(f"fl_c{t}") ** 2 + F.col(f"fl_s{t}") ** 2
    n2 = F.col("fl_n") ** 2
    da, db = n2 - sq("a"), n2 - sq("b")
    tol = 1e-12 * n2
    return F.when((F.col("fl_n") >= 3) & (da > tol) & (db > tol), unit_clip((sq("d") - sq("p")) / F.sqrt(da * db)))


def fisher_lee(pairs: DataFrame, group: list[str], a: str, b: str) -> DataFrame:
    ok = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    s = ok.groupBy(*group).agg(*[e.alias(k) for k, e in fisher_lee_sums(a, b).items()])
    return s.select(*group, F.col("fl_n").cast("long").alias("n"), fisher_lee_value().alias("rho"))


def js_circular_corr(pairs: DataFrame, group: list[str], a: str, b: str) -> DataFrame:
    """Pearson correlation of sine-centred angles, from trigonometric sums in one pass.

    sin(a - ma) = sin a cos ma - cos a sin ma, so all centred moments follow from raw ones.
    """
    A, B = F.radians(col(a)), F.radians(col(b))
    e = {"sa": F.sin(A), "ca": F.cos(A), "sb": F.sin(B), "cb": F.cos(B)}
    ok = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    aggs = [F.count(F.lit(1)).alias("n")] + [F.avg(v).alias(k) for k, v in e.items()]
    for p, q in (("sa", "sa"), ("ca", "ca"), ("sa", "ca"), ("sb", "sb"), ("cb", "cb"), ("sb", "cb"),
                 ("sa", "sb"), ("sa", "cb"), ("ca", "sb"), ("ca", "cb")):
        aggs.append(F.avg(e[p] * e[q]).alias(f"{p}_{q}"))
    s = ok.groupBy(*group).agg(*aggs)
    c = F.col
    ha, hb = F.hypot("sa", "ca"), F.hypot("sb", "cb")
    ua, va, ub, vb = c("ca") / ha, c("sa") / ha, c("cb") / hb, c("sb") / hb   # cos and sin of the means
    ma, mb = c("sa") * ua - c("ca") * va, c("sb") * ub - c("cb") * vb
    vaa = c("sa_sa") * ua ** 2 - 2 * c("sa_ca") * ua * va + c("ca_ca") * va ** 2 - ma ** 2
    vbb = c("sb_sb") * ub ** 2 - 2 * c("sb_cb") * ub * vb + c("cb_cb") * vb ** 2 - mb ** 2
    vab = c("sa_sb") * ua * ub - c("sa_cb") * ua * vb - c("ca_sb") * va * ub + c("ca_cb") * va * vb - ma * mb
    rho = F.when((c("n") >= 3) & (vaa > 1e-15) & (vbb > 1e-15), unit_clip(vab / F.sqrt(vaa * vbb)))
    return s.select(*group, "n", rho.alias("rho"))


def alignment_offset(pairs: DataFrame, group: list[str], reference: str, matched: str) -> DataFrame:
    """Angle (in [-180, 180)) and length of the mean vector of matched - reference."""
    d = F.col(matched) - F.col(reference)
    s = pairs.filter(d.isNotNull()).groupBy(*group).agg(F.avg(cosd(d)).alias("_c"), F.avg(sind(d)).alias("_s"))
    return s.select(*group, wrap180(F.degrees(F.atan2("_s", "_c"))).alias("offset_deg"), F.hypot("_c", "_s").alias("resultant"))


def peak_states(pairs: DataFrame, group: list[str], cols: list[str]) -> DataFrame:
    """Distinct peak states and how many units hold each; peaks lie on a bin grid, so this table is bounded by the grid."""
    return pairs.groupBy(*group, *cols).agg(F.count(F.lit(1)).alias("m"))


def state_pairs(states: DataFrame, group: list[str], cols: list[str]) -> DataFrame:
    """Unordered unit pairs expressed through states: `pairs_n` counts unit pairs, own-state pairs included.

    The upper triangle is taken over states; m*(m-1)/2 covers the pairs inside one state.
    """
    ordv = F.struct(*cols)
    s = states.withColumn("_o", ordv)
    left = s.select(*group, *[F.col(c).alias(f"{c}_1") for c in cols], F.col("m").alias("m_1"), F.col("_o").alias("o_1"))
    right = s.select(*group, *[F.col(c).alias(f"{c}_2") for c in cols], F.col("m").alias("m_2"), F.col("_o").alias("o_2"))
    j = left.join(right, group)
    j = j.filter(F.col("o_1") <= F.col("o_2"))
    n = F.when(F.col("o_1") == F.col("o_2"), F.col("m_1") * (F.col("m_1") - 1) / 2).otherwise(F.col("m_1") * F.col("m_2"))
    return j.withColumn("pairs_n", n.cast("double")).filter("pairs_n > 0").drop("o_1", "o_2", "m_1", "m_2")


def weighted_rank(df: DataFrame, group: list[str], value: str, weight: str, out: str) -> DataFrame:
    """Average rank of a value that stands for `weight` tied rows."""
    w = Window.partitionBy(*group)
    peers = F.sum(weight).over(Window.partitionBy(*group, value))
    upto = F.sum(weight).over(w.orderBy(value).rangeBetween(Window.unboundedPreceding, 0))
    return df.withColumn(out, upto - (peers - 1.0) / 2.0)


def weighted_corr(df: DataFrame, group: list[str], x: str, y: str, w: str, out: str = "rho") -> DataFrame:
    W = F.col(w)
    s = df.groupBy(*group).agg(F.sum(W).alias("n"), F.sum(W * F.col(x)).alias("sx"), F.sum(W * F.col(y)).alias("sy"),
                               F.sum(W * F.col(x) ** 2).alias("xx"), F.sum(W * F.col(y) ** 2).alias("yy"), F.sum(W * F.col(x) * F.col(y)).alias("xy"))
    c = F.col
    vx, vy = c("xx") - c("sx") ** 2 / c("n"), c("yy") - c("sy") ** 2 / c("n")
    rho = F.when((vx > 1e-9) & (vy > 1e-9), unit_clip((c("xy") - c("sx") * c("sy") / c("n")) / F.sqrt(vx * vy)))
    return s.select(*group, F.col("n").alias("n_pairs"), rho.alias(out))


def mantel_spearman(pairs: DataFrame, group: list[str], a: str, b: str) -> DataFrame:
    """Rank correlation of the two tables of pairwise angular distances, over distinct peak states."""
    sp = state_pairs(peak_states(pairs, group, [a, b]), group, [a, b])
    d = sp.withColumns({"da": F.round(circular_distance(f"{a}_1", f"{a}_2"), 9), "db": F.round(circular_distance(f"{b}_1", f"{b}_2"), 9)})
    d = d.groupBy(*group, "da", "db").agg(F.sum("pairs_n").alias("pairs_n"))
    d = weighted_rank(weighted_rank(d, group, "da", "pairs_n", "ra"), group, "db", "pairs_n", "rb")
    return weighted_corr(d, group, "ra", "rb", "pairs_n")


def average_rank(df: DataFrame, group: list[str], value: str, out: str, *, width: float | None = None) -> DataFrame:
    """Tied values share the mean rank. Ranks come from value counts, so ties never pile up; `width` cuts the
    value axis so that a group with very many distinct values spreads over tasks."""
    v = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    v = sequence(v, group, [value], width=width, cumsum={"_cum": "_n"})
    v = v.withColumn(out, F.col("_cum") - (F.col("_n") - 1.0) / 2.0).drop("_n", "_cum")
    return df.join(v, [*group, value], "left")


def spearman(df: DataFrame, group: list[str], x: str, y: str, *, widths: tuple[float | None, float | None] = (None, None)) -> DataFrame:
    ok = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    r = average_rank(average_rank(ok, group, x, "_rx", width=widths[0]), group, y, "_ry", width=widths[1])
    g = r.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.corr("_rx", "_ry").alias("rho"), F.stddev_pop("_rx").alias("_a"), F.stddev_pop("_ry").alias("_b"))
    return g.select(*group, "n", F.when((F.col("_a") > 0) & (F.col("_b") > 0), F.col("rho")).alias("rho"))


def map_correlation(a: DataFrame, b: DataFrame, keys: list[str], cell: list[str], value: str, min_bins: int) -> DataFrame:
    """Pearson on the shared finite cells of two maps; NULL below min_bins or for a constant map."""
    j = a.select(*keys, *cell, F.col(value).alias("_a")).join(b.select(*keys, *cell, F.col(value).alias("_b")), [*keys, *cell])
    j = j.filter(F.col("_a").isNotNull() & F.col("_b").isNotNull())
    g = j.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_bins"), F.corr("_a", "_b").alias("_r"), F.stddev_pop("_a").alias("_x"), F.stddev_pop("_b").alias("_y"))
    return g.select(*keys, "n_bins", F.when((F.col("n_bins") >= min_bins) & (F.col("_x") > 0) & (F.col("_y") > 0), unit_clip(F.col("_r"))).alias("r"))


def linear_fit(df: DataFrame, keys: list[str], x: str, y: str, min_n: int = 3) -> DataFrame:
    """Slope, intercept, R2 and count; NULL with fewer than min_n points or a constant side."""
    ok = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    g = ok.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("_s"), F.regr_intercept(y, x).alias("_i"),
                              F.regr_r2(y, x).alias("_r"), F.var_pop(x).alias("_vx"), F.var_pop(y).alias("_vy"))
    good = (F.col("n") >= min_n) & (F.col("_vx") > 0) & (F.col("_vy") > 0)
    return g.select(*keys, "n", F.when(good, F.col("_s")).alias("slope"), F.when(good, F.col("_i")).alias("intercept"), F.when(good, F.col("_r")).alias("r2"))


def depth_fits(df: DataFrame, session: list[str], shank: str, x: str, y: str, min_n: int = 3) -> DataFrame:
    """OLS per session and per shank in one pass over grouping sets, with a status."""
    ok = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    sets = [[F.col(c) for c in session], [F.col(c) for c in (*session, shank)]]
    g = ok.groupingSets(sets, *session, shank).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("_s"), F.regr_intercept(y, x).alias("_i"), F.regr_r2(y, x).alias("_r"),
        F.var_pop(x).alias("_v"), F.grouping(shank).alias("_g"))
    status = F.when(F.col("n") < min_n, "too_few_units").when(F.col("_v") == 0, "constant_depth").otherwise("fitted")
    g = g.withColumn("status", status)
    f = F.col("status") == "fitted"
    return g.select(*session, F.when(F.col("_g") == 0, F.col(shank)).alias(shank), (F.col("_g") == 1).alias("pooled"), "n",
                    F.when(f, F.col("_s")).alias("slope"), F.when(f, F.col("_i")).alias("intercept"), F.when(f, F.col("_r")).alias("r2"), "status")


def _circ_design_sums(theta, ys: dict[str, Column]) -> dict[str, Column]:
    t = F.radians(col(theta))
    c, s = F.cos(t), F.sin(t)
    out = {"n": F.count(F.lit(1)).cast("double"), "c": F.sum(c), "s": F.sum(s), "cc": F.sum(c * c), "ss": F.sum(s * s), "cs": F.sum(c * s)}
    for k, y in ys.items():
        out |= {f"{k}_0": F.sum(y), f"{k}_c": F.sum(y * c), f"{k}_s": F.sum(y * s), f"{k}_y": F.sum(y * y)}
    return out


def _circ_solve(k: str) -> list[Column]:
    c = F.col
    m = [[c("n"), c("c"), c("s")], [c("c"), c("cc"), c("cs")], [c("s"), c("cs"), c("ss")]]
    return cramer3(m, [c(f"{k}_0"), c(f"{k}_c"), c(f"{k}_s")])


def circular_linear(df: DataFrame, keys: list[str], angle: str, y: str) -> DataFrame:
    """Multiple correlation R of y on 1 + sin + cos, from the normal equations."""
    ok = df.filter(F.col(angle).isNotNull() & F.col(y).isNotNull())
    s = ok.groupBy(*keys).agg(*[e.alias(k) for k, e in _circ_design_sums(angle, {"y": F.col(y).cast("double")}).items()])
    b = _circ_solve("y")
    fit = b[0] * F.col("y_0") + b[1] * F.col("y_c") + b[2] * F.col("y_s") - F.col("y_0") ** 2 / F.col("n")
    tot = F.col("y_y") - F.col("y_0") ** 2 / F.col("n")
    return s.select(*keys, F.col("n").cast("long").alias("n"), F.when(tot > 1e-12, F.sqrt(F.least(F.greatest(fit / tot, F.lit(0.0)), F.lit(1.0)))).alias("r"))


def circular_regression(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """OLS of cos(y) and sin(y) on [1, cos x, sin x]: six coefficients per key."""
    yr = F.radians(F.col(y))
    ok = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    s = ok.groupBy(*keys).agg(*[e.alias(k) for k, e in _circ_design_sums(x, {"yc": F.cos(yr), "ys": F.sin(yr)}).items()])
    bc, bs = _circ_solve("yc"), _circ_solve("ys")
    return s.select(*keys, F.col("n").cast("long").alias("n"), *[b.alias(f"bc{i}") for i, b in enumerate(bc)], *[b.alias(f"bs{i}") for i, b in enumerate(bs)])


def conversion_predict(df: DataFrame, x, out: str = "predicted_deg") -> DataFrame:
    """Evaluate circular_regression coefficients (present as columns) at x; NULL when the vector vanishes."""
    c, s = cosd(x), sind(x)
    pc = F.col("bc0") + F.col("bc1") * c + F.col("bc2") * s
    ps = F.col("bs0") + F.col("bs1") * c + F.col("bs2") * s
    return df.withColumn(out, F.when(F.hypot(pc, ps) > 1e-12, wrap360(F.degrees(F.atan2(ps, pc)))))


def circular_regression_error(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Mean absolute angular error of the fitted conversion on its own data."""
    coef = circular_regression(df, keys, x, y)
    j = conversion_predict(df.join(coef, keys), x)
    return j.groupBy(*keys).agg(F.count("predicted_deg").alias("n"), F.avg(circular_distance("predicted_deg", y)).alias("mae_deg"))


def bh_fdr(df: DataFrame, group: list[str], p: str, out: str = "q") -> DataFrame:
    """Benjamini-Hochberg over assessed rows; unassessed rows keep NULL.

    q of a row = min over p' >= p of p' * m / rank(p'); it depends only on distinct p values, so those
    are counted first and ties never need a per-row window.
    """
    g = ["_g", *group]
    d = df.withColumn("_g", F.lit(0))
    a = d.filter(F.col(p).isNotNull()).groupBy(*g, p).agg(F.count(F.lit(1)).alias("_c"))
    m = a.groupBy(*g).agg(F.sum("_c").alias("_m"))
    a = sequence(a, g, [p], width=0.001, cumsum={"_r": "_c"}).join(m, g)
    a = a.withColumn("_raw", F.col(p) * F.col("_m") / F.col("_r")).withColumn("_b", F.floor(F.col(p) / 0.001))
    # running minimum from the top: inside a slice of p, and over the slices above it (at most 1001 rows)
    s = a.groupBy(*g, "_b").agg(F.min("_raw").alias("_bm"))
    s = s.select(*g, "_b", F.min("_bm").over(Window.partitionBy(*g).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)).alias("_above"))
    own = F.min("_raw").over(Window.partitionBy(*g, "_b").orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0))
    a = a.join(s, [*g, "_b"]).withColumn(out, F.least(own, F.col("_above"), F.lit(1.0))).select(*g, p, out)
    return d.join(a, [*g, p], "left").drop("_g")


def center_pairs_histogram(centers: DataFrame, keys: list[str], a: str, b: str, width: float, *, same: bool) -> DataFrame:
    """Correlogram of wrapped center differences within a unit with one bin centred on 0.

    same=True pairs different centers of one list in both orders. Counts come from distinct angles with
    multiplicities; equal angles of different centers add m*(m-1).
    """
    A = centers.filter(F.col("kind") == a).groupBy(*keys, F.col("deg").alias("d1")).agg(F.count(F.lit(1)).alias("m1"))
    B = centers.filter(F.col("kind") == b).groupBy(*keys, F.col("deg").alias("d2")).agg(F.count(F.lit(1)).alias("m2"))
    j = A.join(B, keys)
    n = F.col("m1") * F.col("m2")
    if same:
        n = F.when(F.col("d1") == F.col("d2"), F.col("m1") * (F.col("m1") - 1)).otherwise(n)
    nb = int(round(360.0 / width))
    b_ = F.pmod(F.floor(F.pmod(F.col("d2") - F.col("d1") + width / 2, F.lit(360.0)) / width), F.lit(nb)).cast("int")
    return j.withColumn("_n", n).filter("_n > 0").groupBy(b_.alias("bin")).agg(F.sum("_n").alias("n"))


def weighted_partial(df: DataFrame, stratum: str, x: str, y: str, w: str) -> DataFrame:
    """Association of x and y after per-stratum weighted intercepts; one row."""
    W = F.col(w)
    s = df.groupBy(stratum).agg(F.sum(W).alias("sw"), F.sum(W * F.col(x)).alias("sx"), F.sum(W * F.col(y)).alias("sy"),
                                F.sum(W * F.col(x) ** 2).alias("xx"), F.sum(W * F.col(y) ** 2).alias("yy"), F.sum(W * F.col(x) * F.col(y)).alias("xy"), F.count(F.lit(1)).alias("k"))
    c = F.col
    t = s.agg(F.sum("k").alias("n"), F.sum(c("xx") - c("sx") ** 2 / c("sw")).alias("vx"), F.sum(c("yy") - c("sy") ** 2 / c("sw")).alias("vy"),
              F.sum(c("xy") - c("sx") * c("sy") / c("sw")).alias("vxy"))
    return t.select("n", F.when((c("vx") > 0) & (c("vy") > 0), unit_clip(c("vxy") / F.sqrt(c("vx") * c("vy")))).alias("r"))
