"""Smoothing and profile queries."""
from pyspark.sql import functions as F

from .registry import query, CTES
from . import roles as R
from ..operators import smoothing as S, profiles as P, tuning as T, rates as RT
from .q_rates import rmap

K = ["unit_id", "feature"]


def _box(n, off_sql):
    return f"SELECT unnest(range(-{n}, {n + 1})) AS o"


@query("W09_circular_boxcar", """SELECT a.unit_id, a.feature, a.bin, round(sum(b.n_spikes) / sum(b.occ_s), 7) AS rate_hz FROM r_curves a JOIN r_curves b
  ON a.unit_id = b.unit_id AND a.feature = b.feature AND ((b.bin - a.bin) + 32) % 30 <= 4 GROUP BY 1, 2, 3""")
def w09(spark, sf):
    return S.circular_boxcar(R.curves(spark, sf), K, "bin", 5, 30, count="n_spikes", seconds="occ_s").select(*K, "bin", R.rnd("rate_hz", 7).alias("rate_hz"))


CTES["r_gauss"] = """SELECT o, exp(-0.5 * (o / CAST(1.5 AS DOUBLE)) ** 2) / sum(exp(-0.5 * (o / CAST(1.5 AS DOUBLE)) ** 2)) OVER () AS w FROM (SELECT unnest(range(-6, 7)) AS o)"""


@query("W10_gaussian_smooth", """SELECT unit_id, feature, CAST(((bin + o) % 30 + 30) % 30 AS INTEGER) AS bin, round(sum(n_spikes * w) / sum(occ_s * w), 7) AS rate_hz FROM r_curves, r_gauss GROUP BY 1, 2, 3""")
def w10(spark, sf):
    return S.gaussian_rate(R.curves(spark, sf), K, {"bin": (1.5, 30, "wrap")}, count="n_spikes", seconds="occ_s").select(*K, "bin", R.rnd("rate_hz", 7).alias("rate_hz"))


@query("W10_gaussian_smooth_2d", """WITH m AS (SELECT unit_id, y, x, coalesce(n, 0) AS n, 1.0 AS s FROM r_map),
  a AS (SELECT unit_id, y, ((x + o) % 30 + 30) % 30 AS x, sum(n * w) AS n FROM m, r_gauss GROUP BY 1, 2, 3),
  b AS (SELECT unit_id, t AS y, x, sum(n * w) AS n FROM (SELECT a.*, t, w FROM a, (SELECT unnest(range(7)) AS t), r_gauss WHERE least(greatest(t + o, 0), 6) = y) GROUP BY 1, 2, 3)
  SELECT unit_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, round(n, 6) AS n FROM b""")
def w10b(spark, sf):
    m = rmap(spark, sf, 0).withColumn("s", F.lit(1.0)).withColumn("n", F.col("n").cast("double"))
    g = S.gaussian_rate(m, ["unit_id"], {"x": (1.5, 30, "wrap"), "y": (1.5, 7, "nearest")}, count="n", seconds="s")
    return g.select("unit_id", "y", "x", R.rnd("n").alias("n"))


CTES["r_holes"] = "SELECT unit_id, feature, bin, CASE WHEN n_spikes % 4 > 0 THEN rate_hz END AS v FROM r_curves"


def holes(spark, sf):
    return R.curves(spark, sf).select(*K, "bin", F.when(F.col("n_spikes") % 4 > 0, F.col("rate_hz")).alias("v"))


@query("W11_gaussian_smooth_nan", """SELECT a.unit_id, a.feature, a.bin, round(CASE WHEN any_value(a.v) IS NOT NULL THEN sum(b.v * w) / sum(CASE WHEN b.v IS NOT NULL THEN w END) END, 7) AS v
  FROM r_holes a JOIN r_holes b USING (unit_id, feature) JOIN r_gauss ON ((a.bin + o) % 30 + 30) % 30 = b.bin GROUP BY 1, 2, 3""")
def w11(spark, sf):
    return S.kernel_mean(holes(spark, sf), K, "bin", "v", S.gaussian_kernel(1.5), 30, "wrap").select(*K, "bin", R.rnd("v", 7).alias("v"))


@query("W12_boxcar_nan", """SELECT a.unit_id, a.feature, a.bin, round(CASE WHEN any_value(a.v) IS NOT NULL THEN avg(b.v) END, 6) AS v
  FROM r_holes a JOIN r_holes b ON a.unit_id = b.unit_id AND a.feature = b.feature AND abs(a.bin - b.bin) <= 1 GROUP BY 1, 2, 3""")
def w12(spark, sf):
    return S.boxcar_nan(holes(spark, sf), K, "bin", "v", 3, 30, circular=False).select(*K, "bin", R.rnd("v", 6).alias("v"))


@query("W13_smooth_3x3_exposure", """SELECT a.unit_id, a.y, a.x, round(sum(b.n * g.presentations * (2 - abs(a.y - b.y)) * (2 - abs(a.x - b.x))) / sum(g.presentations * (2 - abs(a.y - b.y)) * (2 - abs(a.x - b.x))), 7) AS n
  FROM (SELECT * FROM r_map WHERE n IS NOT NULL) a JOIN (SELECT * FROM r_map WHERE n IS NOT NULL) b ON a.unit_id = b.unit_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1
  JOIN r_grid g ON g.y = b.y AND g.x = b.x GROUP BY 1, 2, 3""")
def w13(spark, sf):
    m = rmap(spark, sf).join(R.grid(spark, sf), ["y", "x"]).withColumn("n", F.col("n").cast("double"))
    return S.smooth_3x3(m, ["unit_id"], rate="n", exposure="presentations").select("unit_id", "y", "x", R.rnd("n", 7).alias("n"))


CTES["r_peaks"] = "SELECT unit_id, feature, arg_min(bin, (-rate_hz, bin)) AS peak_bin, max(rate_hz) AS peak_value FROM r_curves GROUP BY ALL"


def peaks(spark, sf):
    return P.peak_bin(R.curves(spark, sf), K, ["bin"], "rate_hz")


@query("W14_peak_bin", "SELECT unit_id, feature, peak_bin, round(peak_value, 6) AS peak_value FROM r_peaks")
def w14(spark, sf):
    return peaks(spark, sf).withColumn("peak_value", R.rnd("peak_value"))


@query("W14_peak_bin_2d_ties", """SELECT unit_id, arg_min(y, (-coalesce(n, 0), y, x)) AS peak_y, arg_min(x, (-coalesce(n, 0), y, x)) AS peak_x, max(coalesce(n, 0)) AS peak_value,
  count(*) FILTER (coalesce(n, 0) = m) AS n_ties FROM (SELECT *, max(coalesce(n, 0)) OVER (PARTITION BY unit_id) AS m FROM r_map) GROUP BY unit_id""")
def w14b(spark, sf):
    m = rmap(spark, sf, 0)
    return P.peak_bin(m, ["unit_id"], ["y", "x"], "n").join(P.peak_ties(m, ["unit_id"], "n"), "unit_id")


@query("W15_peak_order", """SELECT unit_id, feature, CAST(row_number() OVER (PARTITION BY feature ORDER BY CASE WHEN peak_bin >= 3 THEN peak_bin END ASC NULLS LAST, unit_id) AS INTEGER) AS order_no FROM r_peaks""")
def w15(spark, sf):
    p = peaks(spark, sf).withColumn("peak_bin", F.when(F.col("peak_bin") >= 3, F.col("peak_bin")))
    return P.peak_order(p, ["feature"], "peak_bin", ["unit_id"]).select(*K, "order_no")


for _name, _fn, _sql in [
    ("W19_normalize_max", P.normalize_max, "CASE WHEN max(v) OVER w > 0 THEN v / max(v) OVER w ELSE v END"),
    ("W20_minmax", P.minmax, "CASE WHEN max(v) OVER w > min(v) OVER w THEN (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) WHEN v IS NOT NULL THEN 0 END"),
    ("W21_zscore", P.zscore, "CASE WHEN stddev_pop(v) OVER w > 0 THEN (v - avg(v) OVER w) / stddev_pop(v) OVER w END"),
]:
    query(_name, f"SELECT unit_id, feature, bin, round({_sql}, 7) AS v FROM r_holes WINDOW w AS (PARTITION BY unit_id, feature)")(
        lambda spark, sf, _f=_fn: _f(holes(spark, sf), K, "v").select(*K, "bin", R.rnd("v", 7).alias("v")))


@query("W22_rebin_adjacent", """SELECT unit_id, feature, CAST(bin // 2 AS INTEGER) AS bin, round(CASE WHEN count(v) = count(*) THEN sum(v) END, 7) AS v FROM r_holes GROUP BY 1, 2, 3""")
def w22(spark, sf):
    return P.rebin_adjacent(holes(spark, sf), K, 2, "v").select(*K, "bin", R.rnd("v", 7).alias("v"))


@query("W23_pool_exposure_rebin", """SELECT unit_id, feature, bin, round(r / max(r) OVER (PARTITION BY unit_id, feature), 7) AS rate_hz FROM (
  SELECT unit_id, feature, CAST(bin // 3 AS INTEGER) AS bin, sum(rate_hz * occ_s) / sum(occ_s) AS r FROM r_curves GROUP BY 1, 2, 3)""")
def w23(spark, sf):
    return P.pool_exposure_rebin(R.curves(spark, sf), K, 3).select(*K, "bin", R.rnd("rate_hz", 7).alias("rate_hz"))


INTERP = """SELECT t.unit_id, t.feature, t.b AS bin, round(l.rate_hz + (pos / 12 - 0.5 - floor(pos / 12 - 0.5)) * (r.rate_hz - l.rate_hz), 6) AS rate_hz
  FROM ({targets}) t JOIN r_curves l ON l.unit_id = t.unit_id AND l.feature = t.feature AND l.bin = ((CAST(floor(pos / 12 - 0.5) AS INTEGER)) % 30 + 30) % 30
  JOIN r_curves r ON r.unit_id = t.unit_id AND r.feature = t.feature AND r.bin = ((CAST(floor(pos / 12 - 0.5) AS INTEGER) + 1) % 30 + 30) % 30"""


def degrees(df):
    return df.withColumn("deg", (F.col("bin") + 0.5) * 12.0)


@query("W24_resample_angles", INTERP.format(targets="SELECT unit_id, feature, CAST(b AS INTEGER) AS b, (b + CAST(0.5 AS DOUBLE)) * 8 AS pos FROM r_peaks, (SELECT unnest(range(45)) AS b)"))
def w24(spark, sf):
    return P.resample(degrees(R.curves(spark, sf)), K, "deg", "rate_hz", 45).select(*K, "bin", R.rnd("rate_hz").alias("rate_hz"))


@query("W24_resample_bounded", """SELECT t.unit_id, t.feature, t.b AS bin, round(CASE WHEN pos < 6 OR pos > 354 THEN -1 WHEN r.rate_hz IS NULL THEN l.rate_hz ELSE l.rate_hz + (pos / 12 - 0.5 - floor(pos / 12 - 0.5)) * (r.rate_hz - l.rate_hz) END, 6) AS rate_hz
  FROM (SELECT unit_id, feature, CAST(b AS INTEGER) AS b, (b + CAST(0.5 AS DOUBLE)) * 8 AS pos FROM r_peaks, (SELECT unnest(range(45)) AS b)) t
  LEFT JOIN r_curves l ON l.unit_id = t.unit_id AND l.feature = t.feature AND l.bin = CAST(floor(pos / 12 - 0.5) AS INTEGER)
  LEFT JOIN r_curves r ON r.unit_id = t.unit_id AND r.feature = t.feature AND r.bin = CAST(floor(pos / 12 - 0.5) AS INTEGER) + 1""")
def w24b(spark, sf):
    return P.resample(degrees(R.curves(spark, sf)), K, "deg", "rate_hz", 45, periodic=False, fill=-1.0).select(*K, "bin", R.rnd("rate_hz").alias("rate_hz"))


ALIGN_T = "SELECT unit_id, feature, CAST(b AS INTEGER) AS b, b * CAST(12 AS DOUBLE) - 174 + (peak_bin + CAST(0.5 AS DOUBLE)) * 12 AS pos FROM r_peaks, (SELECT unnest(range(30)) AS b)"


@query("W25_align_profiles", INTERP.format(targets=ALIGN_T))
def w25(spark, sf):
    off = peaks(spark, sf).select(*K, ((F.col("peak_bin") + 0.5) * 12.0).alias("offset_deg"))
    c = degrees(R.curves(spark, sf).select(*K, "bin", "rate_hz"))
    return P.align_profiles(c, off, K, "deg", "rate_hz", 30).select(*K, "bin", R.rnd("rate_hz").alias("rate_hz"))


@query("W26_prepare_comparison", """SELECT m.unit_id, m.bin AS bin, m.rate_hz AS aligned_rate, rp.peak_bin AS reference_peak, mp.peak_bin AS matched_peak, CAST((rp.peak_bin + mp.peak_bin) % 30 AS INTEGER) AS sum_peak,
  CAST(dense_rank() OVER (ORDER BY rp.peak_bin, m.unit_id) AS INTEGER) AS order_no
  FROM (%s) m JOIN r_peaks rp ON rp.unit_id = m.unit_id AND rp.feature = 'hd' JOIN r_peaks mp ON mp.unit_id = m.unit_id AND mp.feature = 'rf' WHERE m.feature = 'rf'""".replace("%s", INTERP.format(
    targets="SELECT q.unit_id, 'rf' AS feature, CAST(b AS INTEGER) AS b, b * CAST(12 AS DOUBLE) - 174 + (peak_bin + CAST(0.5 AS DOUBLE)) * 12 AS pos FROM r_peaks q, (SELECT unnest(range(30)) AS b) WHERE q.feature = 'hd'")))
def w26(spark, sf):
    from ..operators.pairs import prepare_comparison
    c = R.curves(spark, sf)
    r = prepare_comparison(c.filter("feature = 'hd'"), c.filter("feature = 'rf'"), ["unit_id"], 30)
    return r.select("unit_id", "bin", R.rnd("rate_hz").alias("aligned_rate"), "reference_peak", "matched_peak", "sum_peak", "order_no")


@query("W46_overview_order", """SELECT unit_id, feature, bin, round(CASE WHEN max(rate_hz) OVER w > 0 THEN rate_hz / max(rate_hz) OVER w ELSE rate_hz END, 7) AS rate_hz,
  CAST(dense_rank() OVER (PARTITION BY feature ORDER BY peak_bin, unit_id) AS INTEGER) AS order_no FROM r_curves JOIN r_peaks USING (unit_id, feature) WINDOW w AS (PARTITION BY unit_id, feature)""")
def w46(spark, sf):
    return P.overview_order(R.curves(spark, sf), K, "rate_hz", ["feature"]).select(*K, "bin", R.rnd("rate_hz", 7).alias("rate_hz"), "order_no")


@query("W47_reference_levels", "SELECT l_suppkey AS unit_id, round(avg(l_quantity), 7) AS mean, round(avg(l_quantity) - 2 * stddev_pop(l_quantity), 7) AS low, round(avg(l_quantity) + 2 * stddev_pop(l_quantity), 7) AS high FROM lineitem GROUP BY 1")
def w47(spark, sf):
    r = P.reference_levels(R.resp(spark, sf), ["unit_id"], "response", 2.0)
    return r.select("unit_id", *[R.rnd(c, 7).alias(c) for c in ("mean", "low", "high")])


@query("W50_signed_reorder", "SELECT unit_id, feature, bin, CAST((bin + 15) % 30 AS INTEGER) AS signed_pos, n_spikes FROM r_curves")
def w50(spark, sf):
    return P.signed_order(R.curves(spark, sf), 30).select(*K, "bin", "signed_pos", "n_spikes")


@query("A72_peak_histogram", "SELECT f.feature, CAST(b AS INTEGER) AS bin, count(p.unit_id) AS n FROM (SELECT DISTINCT feature FROM r_peaks) f CROSS JOIN (SELECT unnest(range(30)) AS b) LEFT JOIN r_peaks p ON p.feature = f.feature AND p.peak_bin = b GROUP BY 1, 2")
def a72(spark, sf):
    return P.peak_histogram(peaks(spark, sf), ["feature"], "peak_bin", 30)


@query("J01_unit_pair_join", "SELECT a.unit_id, a.peak_bin AS reference_peak, b.peak_bin AS matched_peak FROM r_peaks a JOIN r_peaks b USING (unit_id) WHERE a.feature = 'hd' AND b.feature = 'rf'")
def j01(spark, sf):
    p = peaks(spark, sf)
    a = p.filter("feature = 'hd'").select("unit_id", F.col("peak_bin").alias("reference_peak"))
    b = p.filter("feature = 'rf'").select("unit_id", F.col("peak_bin").alias("matched_peak"))
    return P.pair_units(a, b, ["unit_id"])


@query("F12_pair_eligibility", """SELECT unit_id, fa AND fb AND va AND vb AS eligible FROM (SELECT unit_id, bool_and(v IS NOT NULL) FILTER (feature = 'hd') AS fa, bool_and(v IS NOT NULL) FILTER (feature = 'rf') AS fb,
  max(v) FILTER (feature = 'hd') > min(v) FILTER (feature = 'hd') AS va, max(v) FILTER (feature = 'rf') > min(v) FILTER (feature = 'rf') AS vb
  FROM (SELECT unit_id, feature, CASE WHEN n_spikes >= 10 THEN rate_hz END AS v FROM r_curves) GROUP BY unit_id)""")
def f12(spark, sf):
    c = R.curves(spark, sf).withColumn("v", F.when(F.col("n_spikes") >= 10, F.col("rate_hz")))
    return P.pair_eligibility(c, ["unit_id"], "feature", "v", "hd", "rf").select("unit_id", "eligible")


@query("F13_select_pair_audit", """SELECT coalesce(a.unit_id, b.unit_id) AS unit_id, a.unit_id IS NULL AS missing_a, b.unit_id IS NULL AS missing_b, s.unit_id IS NULL AS outside_selection,
  NOT coalesce(a.peak_value > 0 AND b.peak_value > 0, false) AS no_positive_peak,
  NOT (a.unit_id IS NULL OR b.unit_id IS NULL OR s.unit_id IS NULL OR NOT coalesce(a.peak_value > 0 AND b.peak_value > 0, false)) AS selected
  FROM (SELECT * FROM r_peaks WHERE feature = 'hd' AND peak_bin >= 5) a FULL JOIN (SELECT * FROM r_peaks WHERE feature = 'rf' AND peak_bin >= 3) b ON a.unit_id = b.unit_id
  LEFT JOIN (SELECT s_suppkey AS unit_id FROM supplier WHERE s_acctbal > 2000) s ON s.unit_id = coalesce(a.unit_id, b.unit_id)""")
def f13(spark, sf):
    p = peaks(spark, sf)
    sel = R.table(spark, sf, "supplier").filter("s_acctbal > 2000").select(F.col("s_suppkey").alias("unit_id"))
    return P.pair_audit(p.filter("feature = 'hd' AND peak_bin >= 5"), p.filter("feature = 'rf' AND peak_bin >= 3"), ["unit_id"], sel, "peak_value")


@query("F14_select_schemes", """WITH s AS (SELECT unit_id, feature, peak_bin, peak_value > 0 AS s1, peak_value > 0 AND feature = 'hd' AS s2 FROM r_peaks),
  t AS (SELECT peak_bin FROM s WHERE s2 GROUP BY peak_bin ORDER BY count(*) DESC, peak_bin LIMIT 3)
  SELECT unit_id, feature, peak_bin, s1 AS scheme_1, s2 AS scheme_2, s2 AND peak_bin IN (SELECT peak_bin FROM t) AS scheme_3 FROM s""")
def f14(spark, sf):
    return P.select_schemes(peaks(spark, sf), "peak_bin", 3, F.col("peak_value") > 0, F.col("feature") == "hd").select(*K, "peak_bin", "scheme_1", "scheme_2", "scheme_3")


@query("topk_bins", "SELECT peak_bin, n, CAST(rank AS INTEGER) AS rank FROM (SELECT peak_bin, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, peak_bin) AS rank FROM r_peaks GROUP BY peak_bin) WHERE rank <= 5")
def topk(spark, sf):
    return P.top_bins(peaks(spark, sf), "peak_bin", 5)


@query("stack_curves", "SELECT 'a' AS label, unit_id, bin, n_spikes FROM r_curves WHERE feature = 'hd' UNION ALL SELECT 'b', unit_id, bin, n_spikes FROM r_curves WHERE feature = 'rf'")
def stack(spark, sf):
    c = R.curves(spark, sf)
    return P.stack_curves({"a": c.filter("feature = 'hd'").select("unit_id", "bin", "n_spikes"), "b": c.filter("feature = 'rf'").select("unit_id", "bin", "n_spikes")}, ["unit_id"])
