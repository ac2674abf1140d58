"""Population pairing, regression and null-distribution queries."""
from pyspark.sql import functions as F

from .registry import query, CTES
from . import roles as R
from ..operators import pairs as P, nulls as N, populations as PO, profiles as PR
from .q_profiles import peaks
from .q_tuning import WEEK

K = ["unit_id", "feature"]
CTES["r_pairs"] = """SELECT a.unit_id, CAST(a.unit_id % 5 AS INTEGER) AS grp, (a.peak_bin + 0.5) * CAST(12 AS DOUBLE) AS hd_deg, (b.peak_bin + 0.5) * CAST(12 AS DOUBLE) AS rf_deg
  FROM r_peaks a JOIN r_peaks b ON a.unit_id = b.unit_id AND a.feature = 'hd' AND b.feature = 'rf'"""


def pairs(spark, sf):
    p = peaks(spark, sf)
    a = p.filter("feature = 'hd'").select("unit_id", ((F.col("peak_bin") + 0.5) * 12.0).alias("hd_deg"))
    b = p.filter("feature = 'rf'").select("unit_id", ((F.col("peak_bin") + 0.5) * 12.0).alias("rf_deg"))
    return a.join(b, "unit_id").withColumn("grp", (F.col("unit_id") % 5).cast("int"))


PAIRWISE_FL = """SELECT {g}, round(sum(sin(radians(a.{a} - b.{a})) * sin(radians(a.{b} - b.{b}))) / sqrt(sum(sin(radians(a.{a} - b.{a})) ** 2) * sum(sin(radians(a.{b} - b.{b})) ** 2)), 6) AS rho"""


@query("A38_fisher_lee", """SELECT a.unit_id, any_value(m) AS n, round(sum(sin(radians(a.hd - b.hd)) * sin(radians(a.rf - b.rf))) / sqrt(sum(sin(radians(a.hd - b.hd)) ** 2) * sum(sin(radians(a.rf - b.rf)) ** 2)), 6) AS rho
  FROM (SELECT *, row_number() OVER (PARTITION BY unit_id) AS i, count(*) OVER (PARTITION BY unit_id) AS m FROM r_angles) a JOIN (SELECT *, row_number() OVER (PARTITION BY unit_id) AS i FROM r_angles) b
  ON a.unit_id = b.unit_id AND a.i < b.i GROUP BY a.unit_id""".replace("PARTITION BY unit_id)", "PARTITION BY unit_id ORDER BY hd, rf, part_no)").replace("count(*) OVER (PARTITION BY unit_id ORDER BY hd, rf, part_no)", "count(*) OVER (PARTITION BY unit_id)"))
def a38(spark, sf):
    return P.fisher_lee(R.angles(spark, sf), ["unit_id"], "hd", "rf").select("unit_id", "n", R.rnd("rho").alias("rho"))


@query("A39_js_circular_corr", """WITH m AS (SELECT *, atan2(avg(sin(radians(hd))) OVER w, avg(cos(radians(hd))) OVER w) AS ma, atan2(avg(sin(radians(rf))) OVER w, avg(cos(radians(rf))) OVER w) AS mb FROM r_angles WINDOW w AS (PARTITION BY unit_id))
  SELECT unit_id, count(*) AS n, round(corr(sin(radians(hd) - ma), sin(radians(rf) - mb)), 6) AS rho FROM m GROUP BY unit_id""")
def a39(spark, sf):
    return P.js_circular_corr(R.angles(spark, sf), ["unit_id"], "hd", "rf").select("unit_id", "n", R.rnd("rho").alias("rho"))


CTES["r_mantel"] = """SELECT grp, da, db, (rank() OVER (PARTITION BY grp ORDER BY da) + (count(*) OVER (PARTITION BY grp, da) - 1) / CAST(2 AS DOUBLE)) AS ra,
  (rank() OVER (PARTITION BY grp ORDER BY db) + (count(*) OVER (PARTITION BY grp, db) - 1) / CAST(2 AS DOUBLE)) AS rb FROM (
  SELECT a.grp, least(abs(a.hd_deg - b.hd_deg), 360 - abs(a.hd_deg - b.hd_deg)) AS da, least(abs(a.rf_deg - b.rf_deg), 360 - abs(a.rf_deg - b.rf_deg)) AS db
  FROM r_pairs a JOIN r_pairs b ON a.grp = b.grp AND a.unit_id < b.unit_id)"""


@query("A40_J12_mantel_spearman", "SELECT grp, CAST(count(*) AS DOUBLE) AS n_pairs, round(CASE WHEN stddev_pop(ra) > 0 AND stddev_pop(rb) > 0 THEN corr(ra, rb) END, 6) AS rho FROM r_mantel GROUP BY grp")
def a40(spark, sf):
    return P.mantel_spearman(pairs(spark, sf), ["grp"], "hd_deg", "rf_deg").select("grp", "n_pairs", R.rnd("rho").alias("rho"))


@query("A41_alignment_offset", """SELECT unit_id, round(((degrees(atan2(s, c)) + 540) % 360) - 180, 4) AS offset_deg, round(sqrt(s * s + c * c), 6) AS resultant FROM (
  SELECT unit_id, avg(sin(radians(rf - hd))) AS s, avg(cos(radians(rf - hd))) AS c FROM r_angles GROUP BY unit_id)""")
def a41(spark, sf):
    return P.alignment_offset(R.angles(spark, sf), ["unit_id"], "hd", "rf").select("unit_id", R.rnd("offset_deg", 4).alias("offset_deg"), R.rnd("resultant").alias("resultant"))


CTES["r_rank"] = """SELECT l_suppkey AS unit_id, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / CAST(2 AS DOUBLE) AS rx,
  rank() OVER (PARTITION BY l_suppkey ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_suppkey, l_discount) - 1) / CAST(2 AS DOUBLE) AS ry, l_orderkey, l_linenumber FROM lineitem"""


@query("W28_average_rank", "SELECT unit_id, l_orderkey, l_linenumber, rx FROM r_rank")
def w28(spark, sf):
    li = R.table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "unit_id")
    return P.average_rank(li, ["unit_id"], "l_quantity", "rx", width=5.0).select("unit_id", "l_orderkey", "l_linenumber", "rx")


@query("A42_spearman", "SELECT unit_id, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r_rank GROUP BY unit_id")
def a42(spark, sf):
    li = R.table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "unit_id")
    return P.spearman(li, ["unit_id"], "l_quantity", "l_discount", widths=(5.0, 0.01)).select("unit_id", "n", R.rnd("rho").alias("rho"))


@query("A43_map_correlation", """SELECT a.unit_id, count(*) AS n_bins, round(CASE WHEN count(*) >= 10 THEN corr(a.rate_hz, b.rate_hz) END, 6) AS r FROM r_curves a JOIN r_curves b ON a.unit_id = b.unit_id AND a.bin = b.bin
  AND a.feature = 'hd' AND b.feature = 'rf' GROUP BY 1""")
def a43(spark, sf):
    c = R.curves(spark, sf)
    return P.map_correlation(c.filter("feature = 'hd'"), c.filter("feature = 'rf'"), ["unit_id"], ["bin"], "rate_hz", 10).select("unit_id", "n_bins", R.rnd("r").alias("r"))


@query("A87_coordinate_frame_corr", """WITH m AS (SELECT unit_id, polarity, y, x, sum(response) AS v FROM r_resp GROUP BY ALL)
  SELECT a.unit_id, count(*) AS n_bins, round(CASE WHEN count(*) >= 5 THEN corr(a.v, b.v) END, 6) AS r FROM m a JOIN m b ON a.unit_id = b.unit_id AND a.y = b.y AND a.x = b.x AND a.polarity = 'O' AND b.polarity = 'F' GROUP BY 1""")
def a87(spark, sf):
    m = R.resp(spark, sf).groupBy("unit_id", "polarity", "y", "x").agg(F.sum("response").alias("v"))
    return P.map_correlation(m.filter("polarity = 'O'"), m.filter("polarity = 'F'"), ["unit_id"], ["y", "x"], "v", 5).select("unit_id", "n_bins", R.rnd("r").alias("r"))


@query("A34_linear_fit", """SELECT p_brand, count(*) AS n, round(regr_slope(p_retailprice, p_size), 6) AS slope, round(regr_intercept(p_retailprice, p_size), 5) AS intercept, round(regr_r2(p_retailprice, p_size), 7) AS r2 FROM part GROUP BY 1""")
def a34(spark, sf):
    r = P.linear_fit(R.table(spark, sf, "part"), ["p_brand"], "p_size", "p_retailprice")
    return r.select("p_brand", "n", R.rnd("slope").alias("slope"), R.rnd("intercept", 5).alias("intercept"), R.rnd("r2", 7).alias("r2"))


@query("A35_depth_fits", """SELECT p_brand, CASE WHEN grouping(shank) = 0 THEN shank END AS shank, grouping(shank) = 1 AS pooled, count(*) AS n, round(CASE WHEN count(*) >= 3 THEN regr_slope(p_retailprice, p_size) END, 6) AS slope,
  CASE WHEN count(*) < 3 THEN 'too_few_units' WHEN var_pop(p_size) = 0 THEN 'constant_depth' ELSE 'fitted' END AS status FROM (SELECT *, CAST(p_partkey % 16 AS INTEGER) AS shank FROM part) GROUP BY GROUPING SETS ((p_brand), (p_brand, shank))""")
def a35(spark, sf):
    p = R.table(spark, sf, "part").withColumn("shank", (F.col("p_partkey") % 16).cast("int"))
    return P.depth_fits(p, ["p_brand"], "shank", "p_size", "p_retailprice").select("p_brand", "shank", "pooled", "n", R.rnd("slope").alias("slope"), "status")


CTES["r_cl"] = """SELECT l_suppkey AS unit_id, radians(l_extendedprice % CAST(360 AS DOUBLE)) AS th, l_quantity AS y FROM lineitem"""


@query("A36_circular_linear", """SELECT unit_id, n, round(sqrt(greatest((rc * rc + rs * rs - 2 * rc * rs * k) / (1 - k * k), 0)), 6) AS r FROM (
  SELECT unit_id, count(*) AS n, corr(y, cos(th)) AS rc, corr(y, sin(th)) AS rs, corr(cos(th), sin(th)) AS k FROM r_cl GROUP BY unit_id)""")
def a36(spark, sf):
    a = R.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("unit_id"), (F.col("l_extendedprice") % F.lit(360.0)).alias("hd"), F.col("l_quantity").alias("y"))
    return P.circular_linear(a, ["unit_id"], "hd", "y").select("unit_id", "n", R.rnd("r").alias("r"))


# two-regressor OLS in centred form, an independent way to the same coefficients
CTES["r_creg"] = """SELECT unit_id, n, {cols} FROM (SELECT unit_id, count(*) AS n, avg(c) AS mc, avg(s) AS ms, var_pop(c) AS vc, var_pop(s) AS vs, covar_pop(c, s) AS k, avg(yc) AS myc, avg(ys) AS mys,
   covar_pop(yc, c) AS pc, covar_pop(yc, s) AS ps, covar_pop(ys, c) AS qc, covar_pop(ys, s) AS qs FROM (SELECT unit_id, cos(radians(hd)) AS c, sin(radians(hd)) AS s, cos(radians(rf)) AS yc, sin(radians(rf)) AS ys FROM r_angles) GROUP BY unit_id)""".format(
    cols="(pc * vs - ps * k) / (vc * vs - k * k) AS bc1, (ps * vc - pc * k) / (vc * vs - k * k) AS bc2, myc - (pc * vs - ps * k) / (vc * vs - k * k) * mc - (ps * vc - pc * k) / (vc * vs - k * k) * ms AS bc0, "
         "(qc * vs - qs * k) / (vc * vs - k * k) AS bs1, (qs * vc - qc * k) / (vc * vs - k * k) AS bs2, mys - (qc * vs - qs * k) / (vc * vs - k * k) * mc - (qs * vc - qc * k) / (vc * vs - k * k) * ms AS bs0")


@query("A37_circular_regression", "SELECT unit_id, n, " + ", ".join(f"round({b}, 6) AS {b}" for b in ("bc0", "bc1", "bc2", "bs0", "bs1", "bs2")) + " FROM r_creg")
def a37(spark, sf):
    r = P.circular_regression(R.angles(spark, sf), ["unit_id"], "hd", "rf")
    return r.select("unit_id", "n", *[R.rnd(b).alias(b) for b in ("bc0", "bc1", "bc2", "bs0", "bs1", "bs2")])


@query("G24_conversion_predict_mae", """SELECT unit_id, count(*) AS n, round(avg(least(d, 360 - d)), 4) AS mae_deg FROM (SELECT a.unit_id, abs(((degrees(atan2(bs0 + bs1 * cos(radians(hd)) + bs2 * sin(radians(hd)), bc0 + bc1 * cos(radians(hd)) + bc2 * sin(radians(hd)))) + 360) % 360) - rf) AS d
  FROM r_angles a JOIN r_creg USING (unit_id)) GROUP BY unit_id""")
def g24(spark, sf):
    return P.circular_regression_error(R.angles(spark, sf), ["unit_id"], "hd", "rf").select("unit_id", "n", R.rnd("mae_deg", 4).alias("mae_deg"))


@query("A49_bh_fdr", """WITH p AS (SELECT unit_id, feature, CASE WHEN unit_id % 7 > 0 THEN round(exp(-score / 2), 9) END AS p FROM r_ray), r AS (SELECT *, p * count(*) OVER () / rank() OVER (ORDER BY p DESC) AS z, row_number() OVER (ORDER BY p) AS i, count(*) OVER () AS m FROM p WHERE p IS NOT NULL)
  SELECT p.unit_id, p.feature, round(CASE WHEN q.q IS NOT NULL THEN least(q.q, 1) END, 7) AS q FROM p LEFT JOIN (SELECT unit_id, feature, min(p * m / i) OVER (ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS q FROM r) q USING (unit_id, feature)""")
def a49(spark, sf):
    from ..operators.tuning import rayleigh_occupancy
    r = rayleigh_occupancy(R.curves(spark, sf), K, 30).withColumn("p", F.when(F.col("unit_id") % 7 > 0, F.round("p", 9)))
    return P.bh_fdr(r, [], "p").select(*K, R.rnd("q", 7).alias("q"))


@query("A78_weighted_partial_assoc", """WITH d AS (SELECT l_returnflag AS st, l_quantity AS x, l_extendedprice AS y, 1.0 / (1 + l_linenumber) AS w FROM lineitem),
  m AS (SELECT *, x - sum(w * x) OVER p / sum(w) OVER p AS dx, y - sum(w * y) OVER p / sum(w) OVER p AS dy FROM d WINDOW p AS (PARTITION BY st))
  SELECT count(*) AS n, round(sum(w * dx * dy) / sqrt(sum(w * dx * dx) * sum(w * dy * dy)), 6) AS r FROM m""")
def a78(spark, sf):
    d = R.table(spark, sf, "lineitem").withColumn("w", 1.0 / (1 + F.col("l_linenumber")))
    return P.weighted_partial(d, "l_returnflag", "l_quantity", "l_extendedprice", "w").select("n", R.rnd("r").alias("r"))


NREP = 39
CTES["r_pperm"] = f"""SELECT h.rep, h.grp, b.hd_deg, h.rf_deg FROM (SELECT rep, grp, rf_deg, row_number() OVER (PARTITION BY rep, grp ORDER BY md5('1|' || rep || '|' || unit_id), unit_id) AS r FROM r_pairs, (SELECT unnest(range({NREP})) AS rep)) h
  JOIN (SELECT grp, hd_deg, row_number() OVER (PARTITION BY grp ORDER BY unit_id) AS r FROM r_pairs) b ON b.grp = h.grp AND b.r = h.r"""
FLS_RAW = "(sum(cos(radians(hd_deg - rf_deg))) ** 2 + sum(sin(radians(hd_deg - rf_deg))) ** 2 - sum(cos(radians(hd_deg + rf_deg))) ** 2 - sum(sin(radians(hd_deg + rf_deg))) ** 2) / sqrt((count(*) ** 2 - sum(cos(2 * radians(hd_deg))) ** 2 - sum(sin(2 * radians(hd_deg))) ** 2) * (count(*) ** 2 - sum(cos(2 * radians(rf_deg))) ** 2 - sum(sin(2 * radians(rf_deg))) ** 2))"
# undefined below three pairs and when one side has a single axis
FLS = ("CASE WHEN count(*) >= 3 AND count(*) ** 2 - sum(cos(2 * radians(hd_deg))) ** 2 - sum(sin(2 * radians(hd_deg))) ** 2 > 1e-12 * count(*) ** 2 "
       "AND count(*) ** 2 - sum(cos(2 * radians(rf_deg))) ** 2 - sum(sin(2 * radians(rf_deg))) ** 2 > 1e-12 * count(*) ** 2 THEN greatest(-1, least(1, " + FLS_RAW + ")) END")


@query("G14_pairing_permutation", f"""WITH o AS (SELECT grp, {FLS} AS v FROM r_pairs GROUP BY grp), n AS (SELECT rep, grp, {FLS} AS v FROM r_pperm GROUP BY ALL)
  SELECT o.grp, round(o.v, 6) AS observed, round(CASE WHEN o.v IS NOT NULL THEN (1 + count(*) FILTER (abs(n.v) >= abs(o.v) - 1e-12)) / CAST({NREP + 1} AS DOUBLE) END, 6) AS p FROM o JOIN n ON n.grp = o.grp GROUP BY o.grp, o.v""")
def g14(spark, sf):
    r = N.pairing_permutation(pairs(spark, sf), ["grp"], "unit_id", "hd_deg", "rf_deg", "fisher_lee", n_rep=NREP, seed=1)
    return r.select("grp", R.rnd("observed").alias("observed"), R.rnd("p").alias("p"))


@query("G14_mantel_permutation")
def g14m(spark, sf):
    r = N.pairing_permutation(pairs(spark, sf), ["grp"], "unit_id", "hd_deg", "rf_deg", "mantel", n_rep=NREP, seed=1)
    return r.select("grp", R.rnd("observed").alias("observed"), R.rnd("p").alias("p"))


@query("G15_bootstrap_ci", f"""WITH b AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY unit_id) AS r, count(*) OVER (PARTITION BY grp) AS n FROM r_pairs),
  d AS (SELECT rep, grp, floor(('0x' || substr(md5('1|' || rep || '|' || grp || '|' || r), 1, 8))::UBIGINT / CAST(4294967296 AS DOUBLE) * n) + 1 AS r FROM b, (SELECT unnest(range({NREP})) AS rep)),
  s AS (SELECT d.rep, d.grp, {FLS} AS v FROM d JOIN b ON b.grp = d.grp AND b.r = d.r GROUP BY 1, 2)
  SELECT grp, round(quantile_cont(coalesce(v, -1), 0.025), 6) AS ci_low, round(quantile_cont(coalesce(v, 1), 0.975), 6) AS ci_high, round(count(v) / CAST({NREP} AS DOUBLE), 6) AS defined_fraction FROM s GROUP BY grp""")
def g15(spark, sf):
    r = N.bootstrap_ci(pairs(spark, sf), ["grp"], "unit_id", "hd_deg", "rf_deg", "fisher_lee", n_rep=NREP, seed=1)
    return r.select("grp", *[R.rnd(c).alias(c) for c in ("ci_low", "ci_high", "defined_fraction")])


HREP, BREP = 999, 9
CTES["r_fe"] = "SELECT f.session, f.t, f.hd, e.epoch_id, e.start_s, e.end_s FROM r_frames f JOIN r_epochs e ON e.session = f.session AND f.t >= e.start_s AND f.t < e.end_s"
CTES["r_ep"] = """SELECT *, coalesce(sum(end_s - start_s) OVER (PARTITION BY session ORDER BY start_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c0, sum(end_s - start_s) OVER (PARTITION BY session) AS len
  FROM r_epochs SEMI JOIN r_fe USING (session, epoch_id)"""


def frame_epochs(spark, sf):
    from ..operators.asof import point_in_interval
    e = R.epochs(spark, sf)
    f = point_in_interval(R.frames(spark, sf), e, ["session"], "t", id_col="epoch_id", width=WEEK).filter("epoch_id IS NOT NULL")
    from ..session import cut_lineage
    f = cut_lineage(f)
    return f, cut_lineage(e.join(f.select("session", "epoch_id").distinct(), ["session", "epoch_id"], "left_semi"))


@query("G12_hd_shuffle", f"""WITH sp AS (SELECT s.session, s.unit_id, c0 + (s.t - start_s) AS ct, len FROM r_spikes s JOIN r_ep e ON e.session = s.session AND s.t >= start_s AND s.t < end_s),
  sh AS (SELECT rep, session, unit_id, (ct + ('0x' || substr(md5('3|' || rep || '|' || session || '|' || unit_id), 1, 8))::UBIGINT / CAST(4294967296 AS DOUBLE) * len) % len AS ct FROM sp, (SELECT unnest(range({HREP})) AS rep)),
  loc AS (SELECT sh.*, e.epoch_id, e.start_s + (sh.ct - e.c0) AS rt FROM sh ASOF JOIN r_ep e ON e.session = sh.session AND sh.ct >= e.c0),
  nn AS (SELECT l.*, CASE WHEN p.t IS NULL OR (n.t IS NOT NULL AND n.t - l.rt <= l.rt - p.t) THEN n.hd ELSE p.hd END AS hd FROM loc l ASOF LEFT JOIN r_fe p ON p.session = l.session AND p.epoch_id = l.epoch_id AND l.rt >= p.t
    ASOF LEFT JOIN r_fe n ON n.session = l.session AND n.epoch_id = l.epoch_id AND l.rt < n.t),
  oc AS (SELECT session, CAST(floor(hd / 12.0) AS INTEGER) AS bin, count(*) AS n FROM r_fe GROUP BY ALL),
  cn AS (SELECT rep, session, unit_id, CAST(floor(hd / 12.0) AS INTEGER) AS bin, count(*) AS k FROM nn GROUP BY ALL),
  rt AS (SELECT c.*, k / CAST(coalesce(oc.n, 1) AS DOUBLE) AS r FROM cn c LEFT JOIN oc ON oc.session = c.session AND oc.bin = c.bin)
  SELECT rep, session, unit_id, round(sqrt(sum(r * cos(radians((bin + 0.5) * 12))) ** 2 + sum(r * sin(radians((bin + 0.5) * 12))) ** 2) / sum(r), 6) AS null_mvl FROM rt GROUP BY 1, 2, 3""".replace(f"unnest(range({HREP})) AS rep", f"CAST(unnest(range({HREP})) AS INTEGER) AS rep"))
def g12(spark, sf):
    from ..functions.bins import angle_bin
    f, e = frame_epochs(spark, sf)
    oc = f.groupBy("session", angle_bin("hd", 30).alias("bin")).agg(F.count(F.lit(1)).alias("occ_n"))
    r = N.hd_shuffle(R.spikes(spark, sf), f, e, ["session"], ["unit_id"], t="t", ft="t", angle="hd", occupancy=oc, n_bins=30, n_rep=HREP, seed=3, width=WEEK)
    return r.withColumn("null_mvl", R.rnd("null_mvl"))


@query("A45_null_percentile", """SELECT l_returnflag AS statistic, round(quantile_cont(l_extendedprice, 0.99), 5) AS threshold FROM lineitem GROUP BY 1""")
def a45(spark, sf):
    li = R.table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "statistic")
    return N.null_threshold(li, ["statistic"], "l_extendedprice", 0.99, width=500.0).select("statistic", R.rnd("threshold", 5).alias("threshold"))


@query("G16_block_bootstrap", f"""WITH b AS (SELECT session, unit_id, CAST(floor(t / 86400) AS BIGINT) AS block, CAST(count(*) FILTER (spike_id % 2 = 0) AS DOUBLE) AS sa, CAST(count(*) FILTER (spike_id % 2 = 1) AS DOUBLE) AS sb FROM r_spikes GROUP BY ALL),
  ex AS (SELECT session, CAST(floor(t / 86400) AS BIGINT) AS block, CAST(count(*) FILTER (valid) AS DOUBLE) AS ea, CAST(count(*) AS DOUBLE) AS eb FROM r_frames GROUP BY ALL),
  j AS (SELECT b.session, b.unit_id, b.block, sa, sb, ea, eb FROM b JOIN ex USING (session, block)),
  k AS (SELECT session, block, row_number() OVER (PARTITION BY session ORDER BY block) AS r, count(*) OVER (PARTITION BY session) AS n FROM (SELECT DISTINCT session, block FROM j)),
  d AS (SELECT rep, session, floor(('0x' || substr(md5('5|' || rep || '|' || session || '|' || r), 1, 8))::UBIGINT / CAST(4294967296 AS DOUBLE) * n) + 1 AS r FROM k, (SELECT unnest(range({BREP})) AS rep)),
  s AS (SELECT rep, j.session, unit_id, sum(sb) / sum(eb) - sum(sa) / nullif(sum(ea), 0) AS v FROM d JOIN k ON k.session = d.session AND k.r = d.r JOIN j ON j.session = k.session AND j.block = k.block GROUP BY 1, 2, 3),
  o AS (SELECT session, unit_id, sum(sb) / sum(eb) - sum(sa) / nullif(sum(ea), 0) AS v FROM j GROUP BY ALL)
  SELECT o.session, o.unit_id, round(o.v, 6) AS difference_hz, round(quantile_cont(s.v, 0.025), 6) AS ci_low, round(quantile_cont(s.v, 0.975), 6) AS ci_high FROM o JOIN s ON s.session = o.session AND s.unit_id = o.unit_id GROUP BY 1, 2, o.v""")
def g16(spark, sf):
    day = F.floor(F.col("t") / 86400.0).alias("block")
    b = R.spikes(spark, sf).groupBy("session", "unit_id", day).agg(F.count_if(F.col("spike_id") % 2 == 0).cast("double").alias("spikes_a"), F.count_if(F.col("spike_id") % 2 == 1).cast("double").alias("spikes_b"))
    ex = R.frames(spark, sf).groupBy("session", day).agg(F.count_if("valid").cast("double").alias("exposure_a"), F.count(F.lit(1)).cast("double").alias("exposure_b"))
    r = N.block_bootstrap(b.join(ex, ["session", "block"]), ["session", "unit_id"], ["session"], n_rep=BREP, seed=5)
    return r.select("session", "unit_id", *[R.rnd(c).alias(c) for c in ("difference_hz", "ci_low", "ci_high")])


@query("G29_pair_statistics")
def g29(spark, sf):
    """Offsets, three association statistics and the peak-sum test of every recording in one row."""
    p = pairs(spark, sf)
    from ..operators.tuning import rayleigh_uniformity
    out = P.alignment_offset(p, ["grp"], "hd_deg", "rf_deg").join(P.js_circular_corr(p, ["grp"], "hd_deg", "rf_deg").withColumnRenamed("rho", "circular_rho"), "grp")
    out = out.join(P.mantel_spearman(p, ["grp"], "hd_deg", "rf_deg").withColumnRenamed("rho", "mantel_rho"), "grp")
    s = rayleigh_uniformity(p.withColumn("s", F.pmod(F.col("hd_deg") + F.col("rf_deg"), F.lit(360.0))), ["grp"], "s")
    return out.join(s.select("grp", F.col("r").alias("sum_r"), F.col("p").alias("sum_p")), "grp")


# ---- cohort tables ----
@query("A75_depth_summary", "SELECT p_brand, p_size % 4 AS shank, count(*) AS n_units, count(p_retailprice) AS n_placed, round(max(p_retailprice) - min(p_retailprice), 6) AS span_um FROM part GROUP BY 1, 2")
def a75(spark, sf):
    p = R.table(spark, sf, "part").withColumn("shank", F.col("p_size") % 4)
    return PO.depth_summary(p, ["p_brand"], "shank", "p_retailprice").withColumn("span_um", R.rnd("span_um"))


@query("W45_depth_normalize", """SELECT p_partkey, round(max(p_retailprice) OVER w - p_retailprice, 6) AS depth_um, round((max(p_retailprice) OVER w - p_retailprice) / nullif(max(p_retailprice) OVER w - min(p_retailprice) OVER w, 0), 7) AS depth_fraction
  FROM part WINDOW w AS (PARTITION BY p_brand, p_size % 4)""")
def w45(spark, sf):
    p = R.table(spark, sf, "part").withColumn("shank", F.col("p_size") % 4)
    return PO.depth_normalize(p, ["p_brand", "shank"], "p_retailprice").select("p_partkey", R.rnd("depth_um").alias("depth_um"), R.rnd("depth_fraction", 7).alias("depth_fraction"))


@query("F15_population_category", """SELECT s_suppkey AS unit_id, CASE WHEN NOT coalesce(m, false) THEN 'absent' WHEN NOT coalesce(keep, false) THEN 'failed_qc' WHEN n = 0 THEN 'none' WHEN n = 1 THEN 'one' ELSE 'many' END AS category
  FROM supplier LEFT JOIN (SELECT l_suppkey AS u, bool_or(l_quantity > 49 AND l_discount > 0.08) AS m, avg(l_discount) > 0.0495 AS keep, count(*) FILTER (l_quantity = 50 AND l_tax >= 0.07) AS n FROM lineitem GROUP BY 1) ON u = s_suppkey""")
def f15(spark, sf):
    li = R.table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "unit_id")
    u = R.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("unit_id"))
    return PO.population_category(u, li, ["unit_id"], mapped=(F.col("l_quantity") > 49) & (F.col("l_discount") > 0.08), region=(F.col("l_quantity") == 50) & (F.col("l_tax") >= 0.07), keep=R.mean_above("l_discount", "0.0495"))


@query("A74_fraction_summary", """SELECT n_regionkey AS mouse, count(*) FILTER (c_acctbal > 0 AND c_mktsegment IS NOT NULL) AS tuned_n, count(*) FILTER (c_mktsegment IS NOT NULL) AS tuned_of,
   round(100.0::DOUBLE * count(*) FILTER (c_acctbal > 0 AND c_mktsegment IS NOT NULL) / count(*) FILTER (c_mktsegment IS NOT NULL), 6) AS tuned_pct,
   count(*) FILTER (c_mktsegment = 'BUILDING' AND c_acctbal > 5000) AS mapped_n, count(*) FILTER (c_acctbal > 5000) AS mapped_of, round(100.0::DOUBLE * count(*) FILTER (c_mktsegment = 'BUILDING' AND c_acctbal > 5000) / count(*) FILTER (c_acctbal > 5000), 6) AS mapped_pct
  FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1""")
def a74(spark, sf):
    c = R.table(spark, sf, "customer").join(R.table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).withColumn("mouse", F.col("n_regionkey"))
    r = PO.fraction_summary(c, ["mouse"], {"tuned": (F.col("c_acctbal") > 0, F.col("c_mktsegment").isNotNull()), "mapped": (F.col("c_mktsegment") == "BUILDING", F.col("c_acctbal") > 5000)})
    return r.withColumn("tuned_pct", R.rnd("tuned_pct")).withColumn("mapped_pct", R.rnd("mapped_pct"))


@query("set_partition_counts", """SELECT CASE WHEN a AND b THEN 'both' WHEN a THEN 'only_a' WHEN b THEN 'only_b' ELSE 'none' END AS part, count(*) AS n FROM (SELECT p_partkey, coalesce(a, false) AS a, coalesce(b, false) AS b FROM part LEFT JOIN (
  SELECT l_partkey, bool_or(l_quantity > 48) AS a, bool_or(l_discount > 0.09) AS b FROM lineitem GROUP BY 1) ON l_partkey = p_partkey) GROUP BY 1""")
def setparts(spark, sf):
    li = R.table(spark, sf, "lineitem").withColumnRenamed("l_partkey", "unit_id")
    return PO.partition_counts(R.table(spark, sf, "part").withColumnRenamed("p_partkey", "unit_id"), li, ["unit_id"], F.col("l_quantity") > 48, F.col("l_discount") > 0.09)


@query("A79_range_record", "SELECT l_returnflag AS grp, round(min(l_extendedprice), 4) AS min, round(max(l_extendedprice), 4) AS max, count(DISTINCT l_suppkey) AS n_units FROM lineitem GROUP BY 1")
def a79(spark, sf):
    li = R.table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "grp")
    return PO.range_record(li, ["grp"], "l_extendedprice", "l_suppkey").select("grp", R.rnd("min", 4).alias("min"), R.rnd("max", 4).alias("max"), "n_units")


@query("A83_aggregate_unit_lists", "SELECT DISTINCT l_returnflag AS stimulus, l_suppkey AS unit_id FROM lineitem")
def a83(spark, sf):
    li = R.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("stimulus"), F.col("l_suppkey").alias("unit_id"), "l_linenumber")
    return PO.unit_union([li.filter("l_linenumber % 2 = 1"), li.filter("l_linenumber % 2 = 0")], ["stimulus", "unit_id"])


@query("A84_basic_stats", "SELECT c_mktsegment, round(min(c_acctbal), 4) AS min, round(max(c_acctbal), 4) AS max, round(avg(c_acctbal), 5) AS mean, round(median(c_acctbal), 5) AS median, round(stddev_pop(c_acctbal), 5) AS sd FROM customer GROUP BY 1")
def a84(spark, sf):
    r = PO.basic_stats(R.table(spark, sf, "customer"), ["c_mktsegment"], "c_acctbal")
    return r.select("c_mktsegment", R.rnd("min", 4).alias("min"), R.rnd("max", 4).alias("max"), *[R.rnd(c, 5).alias(c) for c in ("mean", "median", "sd")])


@query("A71_pool_on_edge_union", """WITH p AS (SELECT c_mktsegment AS g, c_nationkey AS lo, c_nationkey + 1 + c_custkey % 9 AS hi, 1 + c_custkey % 3 AS v FROM customer), e AS (SELECT DISTINCT g, unnest([lo, hi]) AS lo FROM p),
  c AS (SELECT g, lo, lead(lo) OVER (PARTITION BY g ORDER BY lo) AS hi FROM e)
  SELECT c.g AS panel, CAST(c.lo AS BIGINT) AS lo, CAST(c.hi AS BIGINT) AS hi, CAST(coalesce(sum(v), 0) AS BIGINT) AS total FROM c LEFT JOIN p ON p.g = c.g AND p.lo <= c.lo AND p.hi >= c.hi WHERE c.hi IS NOT NULL GROUP BY 1, 2, 3""")
def a71(spark, sf):
    c = R.table(spark, sf, "customer")
    p = c.select(F.col("c_mktsegment").alias("panel"), F.col("c_nationkey").cast("long").alias("lo"), (F.col("c_nationkey") + 1 + F.col("c_custkey") % 9).alias("hi"), (1 + F.col("c_custkey") % 3).alias("value"))
    return PO.pool_on_edge_union(p, ["panel"]).select("panel", "lo", "hi", F.col("total").cast("long").alias("total"))


@query("F17_evidence_table", """SELECT s_suppkey AS unit_id, CASE WHEN sup IS NULL OR sta IS NULL OR sig IS NULL THEN 'inconclusive' WHEN sup AND sta AND sig THEN 'supported' ELSE 'not_supported' END AS conclusion FROM (
  SELECT s_suppkey, n >= 550 AS sup, CASE WHEN s_acctbal > 500 THEN d > 0.0495 END AS sta, q < 26 AS sig FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n, avg(l_discount) AS d, avg(l_quantity) AS q FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey)""")
def f17(spark, sf):
    s = R.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("n"), R.mean_above("l_discount", "0.0495").alias("d"), F.avg("l_quantity").alias("q"))
    b = R.table(spark, sf, "supplier").join(s, "s_suppkey", "left")
    e = PO.evidence_table(b, {"sup": F.col("n") >= 550, "sta": F.when(F.col("s_acctbal") > 500, F.col("d")), "sig": F.col("q") < 26})
    return e.select(F.col("s_suppkey").alias("unit_id"), "conclusion")


@query("F19_table_diff", """WITH a AS (SELECT c_custkey % 500 AS k, sum(c_acctbal) AS v FROM customer WHERE c_nationkey < 12 GROUP BY 1), b AS (SELECT c_custkey % 500 AS k, sum(c_acctbal) AS v FROM customer WHERE c_nationkey < 14 GROUP BY 1)
  SELECT coalesce(a.k, b.k) AS k, round(a.v, 4) AS left_value, round(b.v, 4) AS right_value FROM a FULL JOIN b ON a.k = b.k WHERE NOT coalesce(abs(a.v - b.v) <= 0.5, false)""")
def f19(spark, sf):
    c = R.table(spark, sf, "customer").withColumn("k", F.col("c_custkey") % 500)
    a = c.filter("c_nationkey < 12").groupBy("k").agg(F.sum("c_acctbal").alias("v"))
    b = c.filter("c_nationkey < 14").groupBy("k").agg(F.sum("c_acctbal").alias("v"))
    return PO.table_diff(a, b, ["k"], "v", 0.5).select("k", R.rnd("left_value", 4).alias("left_value"), R.rnd("right_value", 4).alias("right_value"))


@query("F01_good_units", """SELECT c_custkey AS unit_id, count(s.spike_id) AS n_spikes FROM customer LEFT JOIN r_spikes s ON s.unit_id = c_custkey WHERE c_mktsegment = 'MACHINERY' GROUP BY 1""")
def f01(spark, sf):
    from ..sources.tables import good_units
    lab = R.table(spark, sf, "customer").select(F.col("c_custkey").alias("unit_id"), F.col("c_mktsegment").alias("label"))
    return good_units(lab, R.spikes(spark, sf), ["unit_id"], "MACHINERY")


@query("F05_hd_pick", "SELECT unit_id, feature FROM r_vec WHERE CASE WHEN sqrt(c * c + s * s) / w >= 0.08 THEN 3 WHEN sqrt(c * c + s * s) / w >= 0.05 THEN 2 ELSE 0 END IN (2, 3)")
def f05(spark, sf):
    from ..operators.tuning import vector_stats
    from ..sources.tables import hd_pick
    v = vector_stats(R.curves(spark, sf), K, 30).withColumn("hd_class", F.when(F.col("mvl") >= 0.08, 3).when(F.col("mvl") >= 0.05, 2).otherwise(0))
    return hd_pick(v, [2, 3]).select(*K)


@query("F16_anatomy_select", "SELECT c_custkey AS unit_id FROM customer WHERE coalesce(CASE WHEN c_acctbal > 0 THEN c_nationkey < 5 END, false)")
def f16(spark, sf):
    from ..sources.tables import anatomy_select
    c = R.table(spark, sf, "customer").withColumn("in_region", F.when(F.col("c_acctbal") > 0, F.col("c_nationkey") < 5))
    return anatomy_select(c, "in_region").select(F.col("c_custkey").alias("unit_id"))


@query("F20_band_mask", "SELECT l_suppkey AS unit_id, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 4) AS total FROM lineitem WHERE l_discount * 100 + 0.5 > 2 AND l_discount * 100 + 0.5 <= 6.5 GROUP BY 1")
def f20(spark, sf):
    from ..sources.tables import band_mask
    li = R.table(spark, sf, "lineitem").withColumn("c", F.col("l_discount") * 100 + 0.5)
    return band_mask(li, "c", 2.0, 6.5).groupBy(F.col("l_suppkey").alias("unit_id")).agg(F.count(F.lit(1)).alias("n"), R.rnd(F.sum("l_quantity"), 4).alias("total"))


@query("F11_factorial_block_check", """WITH b AS (SELECT session, trial_id, y_idx, luminance, (row_number() OVER (PARTITION BY session ORDER BY onset_s) - 1) // 14 AS blk FROM r_trials), e AS (SELECT * FROM (SELECT DISTINCT session, blk FROM b) CROSS JOIN (SELECT DISTINCT y_idx, luminance FROM r_trials))
  SELECT e.session, CAST(e.blk AS BIGINT) AS block, e.y_idx, e.luminance, count(b.trial_id) AS n FROM e LEFT JOIN b ON b.session = e.session AND b.blk = e.blk AND b.y_idx = e.y_idx AND b.luminance = e.luminance GROUP BY 1, 2, 3, 4 HAVING count(b.trial_id) <> 1""")
def f11(spark, sf):
    from ..sources.tables import factorial_violations
    return factorial_violations(R.trials(spark, sf), ["session"], "onset_s", {"y_idx": range(7), "luminance": range(2)}, width=WEEK).select("session", "block", "y_idx", "luminance", "n")


@query("J11_cohort_archive_join", """SELECT o_custkey, c_nationkey, n_name, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2, 3""")
def j11(spark, sf):
    o = R.table(spark, sf, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"))
    c = R.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    n = R.table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    j, _ = PO.left_checked(o.join(c, "o_custkey"), n, ["c_nationkey"])
    return j.select("o_custkey", "c_nationkey", "n_name", R.rnd("total", 2).alias("total"))


@query("J10_subset_violations", "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def j10(spark, sf):
    o = R.table(spark, sf, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return PO.subset_violations(R.table(spark, sf, "lineitem"), o, ["l_orderkey"])
