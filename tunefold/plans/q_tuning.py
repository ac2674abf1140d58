"""Tuning-curve queries."""
from pyspark.sql import functions as F

from .registry import query, CTES
from . import roles as R
from ..operators import tuning as T, asof, intervals as I
from ..functions.bins import angle_bin, even_bin
from ..functions.angles import cosd, sind

WEEK = 86400.0
FS = 1.0 / 600.0  # stand-in frame rate: one view every ten minutes

# nearest frame per spike with the tie to the earlier frame, written as two neighbours
CTES["r_nearest"] = """SELECT s.*, CASE WHEN p.t IS NULL OR (n.t IS NOT NULL AND n.t - s.t < s.t - p.t) THEN n.hd ELSE p.hd END AS hd,
    CASE WHEN p.t IS NULL OR (n.t IS NOT NULL AND n.t - s.t < s.t - p.t) THEN n.t ELSE p.t END AS ft,
    CASE WHEN p.t IS NULL OR (n.t IS NOT NULL AND n.t - s.t < s.t - p.t) THEN n.frame_id ELSE p.frame_id END AS frame_id
  FROM r_spikes s ASOF LEFT JOIN r_frames p ON s.session = p.session AND s.t >= p.t
  ASOF LEFT JOIN r_frames n ON s.session = n.session AND s.t < n.t"""

CTES["r_tc"] = """SELECT u.session, u.unit_id, b.bin, coalesce(c.n, 0) AS n_spikes, f.occ_s,
    CASE WHEN f.occ_s > 0 THEN coalesce(c.n, 0) / f.occ_s END AS rate_hz
  FROM (SELECT DISTINCT session, unit_id FROM r_nearest) u CROSS JOIN (SELECT CAST(range AS INTEGER) AS bin FROM range(30)) b
  LEFT JOIN (SELECT session, unit_id, CAST(floor(hd / 12.0) AS INTEGER) AS bin, count(*) AS n FROM r_nearest GROUP BY ALL) c
    ON c.session = u.session AND c.unit_id = u.unit_id AND c.bin = b.bin
  LEFT JOIN (SELECT session, CAST(floor(hd / 12.0) AS INTEGER) AS bin, count(*) * CAST(600 AS DOUBLE) AS occ_s FROM r_frames GROUP BY ALL) f
    ON f.session = u.session AND f.bin = b.bin"""


def tc(spark, sf):
    return T.tuning_curve(R.spikes(spark, sf), R.frames(spark, sf), ["session"], ["unit_id"], t="t", ft="t",
                          angle="hd", n=30, fs=FS, width=WEEK)


@query("J02_asof_nearest", """SELECT session, spike_id, frame_id, round(ft, 6) AS sample_t FROM r_nearest""")
def j02(spark, sf):
    hit = asof.asof_nearest(R.spikes(spark, sf), R.frames(spark, sf), ["session"], "t", "t", ["frame_id"], tie="earlier", width=WEEK)
    return hit.select("session", "spike_id", "frame_id", R.rnd("sample_t").alias("sample_t"))


@query("A01_tuning_curve", """SELECT session, unit_id, bin, n_spikes, round(occ_s, 6) AS occ_s, round(rate_hz, 9) AS rate_hz FROM r_tc""")
def a01(spark, sf):
    return tc(spark, sf).select("session", "unit_id", "bin", "n_spikes", R.rnd("occ_s").alias("occ_s"), R.rnd("rate_hz", 9).alias("rate_hz"))


CTES["r_vec"] = """SELECT unit_id, feature, count(rate_hz) AS n_bins, sum(rate_hz) AS w,
  sum(rate_hz * cos(radians((bin + 0.5) * 12))) AS c, sum(rate_hz * sin(radians((bin + 0.5) * 12))) AS s FROM r_curves GROUP BY ALL"""

CTES["r_ray"] = """SELECT unit_id, feature, CASE WHEN N > 0 AND b >= 3 AND a * d - o * o > 1e-12 * (a + d) * (a + d)
   THEN (d * u * u - 2 * o * u * v + a * v * v) / (a * d - o * o) END AS score FROM (
  SELECT unit_id, feature, N, b, N * (cc / W - c / W * c / W) AS a, N * (ss / W - s / W * s / W) AS d, N * (cs / W - c / W * s / W) AS o,
   nc - N * c / W AS u, ns - N * s / W AS v FROM (
   SELECT unit_id, feature, sum(n_spikes) AS N, count(*) AS b, sum(occ_s) AS W, sum(occ_s * co) AS c, sum(occ_s * si) AS s, sum(occ_s * co * co) AS cc,
    sum(occ_s * si * si) AS ss, sum(occ_s * co * si) AS cs, sum(n_spikes * co) AS nc, sum(n_spikes * si) AS ns
   FROM (SELECT *, cos(radians((bin + 0.5) * 12)) AS co, sin(radians((bin + 0.5) * 12)) AS si FROM r_curves) GROUP BY ALL))"""


@query("A01_A27_A29_heading_tuning", """SELECT v.unit_id, v.feature, round(sqrt(c * c + s * s) / w, 6) AS mvl,
  round(((degrees(atan2(s, c)) % 360) + 360) % 360, 4) AS preferred_deg, round(r.score, 5) AS score, round(exp(-r.score / 2), 6) AS p
  FROM r_vec v JOIN r_ray r USING (unit_id, feature)""")
def flagship(spark, sf):
    c = R.curves(spark, sf)
    keys = ["unit_id", "feature"]
    v = T.vector_stats(c, keys, 30).join(T.rayleigh_occupancy(c, keys, 30), keys)
    return v.select(*keys, R.rnd("mvl").alias("mvl"), R.rnd("preferred_deg", 4).alias("preferred_deg"),
                    R.rnd("score", 5).alias("score"), R.rnd("p").alias("p"))


@query("A02_rebin_counts_exposure", """SELECT unit_id, feature, CAST(floor(bin / 3) AS INTEGER) AS bin, CAST(sum(n_spikes) AS BIGINT) AS n_spikes,
  round(sum(occ_s), 6) AS occ_s, round(sum(n_spikes) / sum(occ_s), 6) AS rate_hz FROM r_curves GROUP BY 1, 2, 3""")
def a02(spark, sf):
    return T.rebin_counts(R.curves(spark, sf), ["unit_id", "feature"], 3).select(
        "unit_id", "feature", "bin", "n_spikes", R.rnd("occ_s").alias("occ_s"), R.rnd("rate_hz").alias("rate_hz"))


@query("A03_heading_profiles", """WITH ok AS (SELECT n.* FROM r_nearest n JOIN r_epochs e ON e.session = n.session AND n.t >= e.start_s AND n.t < e.end_s)
  SELECT session, unit_id, CAST(floor(hd / 12.0) AS INTEGER) AS bin, count(*) AS n_spikes FROM ok GROUP BY ALL""")
def a03(spark, sf):
    inside = I.restrict(R.spikes(spark, sf), R.epochs(spark, sf), ["session"], "t", id_col="epoch_id", width=WEEK)
    hit = asof.asof_nearest(inside, R.frames(spark, sf), ["session"], "t", "t", ["hd"], tie="earlier", width=WEEK)
    return hit.groupBy("session", "unit_id", angle_bin("hd", 30).alias("bin")).agg(F.count(F.lit(1)).alias("n_spikes"))


@query("A04_paired_feature_tuning", """SELECT unit_id, feature, bin, count(*) AS n_spikes FROM (
  SELECT unit_id, 'hd' AS feature, CAST(floor(hd / 12.0) AS INTEGER) AS bin FROM r_angles WHERE rf >= 30
  UNION ALL SELECT unit_id, 'pitch', CAST(CASE WHEN rf = 360 THEN 10 ELSE floor((rf - 30) / 30.0) END AS INTEGER) FROM r_angles WHERE rf >= 30) GROUP BY ALL""")
def a04(spark, sf):
    a = R.angles(spark, sf).withColumn("pitch", F.when(F.col("rf") >= 30, F.col("rf")))
    return T.paired_feature_tuning(a, ["unit_id"], {"hd": (0.0, 12.0, 30), "pitch": (30.0, 30.0, 11)})


@query("A20_allocentric_map", """WITH h AS (SELECT n.session, n.unit_id, f.x, f.y FROM r_nearest n JOIN r_frames f USING (session, frame_id) WHERE f.valid)
  SELECT session, unit_id, CAST(least(floor(x), 39) AS INTEGER) AS x_bin, CAST(least(floor(y), 39) AS INTEGER) AS y_bin, count(*) AS n FROM h GROUP BY ALL""")
def a20(spark, sf):
    hit = asof.asof_nearest(R.spikes(spark, sf), R.frames(spark, sf), ["session"], "t", "t", ["x", "y", "valid"], tie="earlier", width=WEEK)
    return T.map2d(hit.filter("valid"), ["session", "unit_id"], "x", "y", 40.0, 40)


@query("A24_spatial_coverage", """SELECT session, round(count(DISTINCT (least(floor(x / 2.5), 15), least(floor(y / 2.5), 15))) / CAST(256 AS DOUBLE), 9) AS coverage
  FROM r_frames WHERE valid GROUP BY session""")
def a24(spark, sf):
    f = R.frames(spark, sf).filter("valid").select("session", even_bin("x", 0.0, 2.5, 16).alias("x_bin"),
                                                   even_bin("y", 0.0, 2.5, 16).alias("y_bin"), F.lit(1.0).alias("dur_s"))
    return T.spatial_coverage(f, ["session"], 16, 16).select("session", R.rnd("coverage", 9).alias("coverage"))


@query("A24_circular_coverage", """SELECT session, round(count(DISTINCT (xb, yb)) / (SELECT CAST(count(*) AS DOUBLE) FROM range(16) a(i), range(16) b(j)
   WHERE ((i + 0.5) * 2.5 - 20) ** 2 + ((j + 0.5) * 2.5 - 20) ** 2 <= 400), 9) AS coverage
  FROM (SELECT session, least(floor(x / 2.5), 15) AS xb, least(floor(y / 2.5), 15) AS yb FROM r_frames WHERE valid)
  WHERE ((xb + 0.5) * 2.5 - 20) ** 2 + ((yb + 0.5) * 2.5 - 20) ** 2 <= 400 GROUP BY session""")
def a24c(spark, sf):
    f = R.frames(spark, sf).filter("valid").select("session", even_bin("x", 0.0, 2.5, 16).alias("x_bin"),
                                                   even_bin("y", 0.0, 2.5, 16).alias("y_bin"), F.lit(1.0).alias("dur_s"))
    return T.spatial_coverage(f, ["session"], 16, 16, (20.0, 20.0, 20.0)).select("session", R.rnd("coverage", 9).alias("coverage"))


@query("A26_mean_resultant", """SELECT unit_id, count(hd) AS n, round(sqrt(avg(cos(radians(hd))) ** 2 + avg(sin(radians(hd))) ** 2), 9) AS mrl
  FROM r_angles GROUP BY unit_id""")
def a26(spark, sf):
    return T.mean_resultant(R.angles(spark, sf), ["unit_id"], "hd").select("unit_id", "n", R.rnd("mrl", 9).alias("mrl"))


@query("A27_rate_mvl", """SELECT unit_id, feature, n_bins, round(sqrt(c * c + s * s) / w, 8) AS mvl,
  round(((degrees(atan2(s, c)) % 360) + 360) % 360, 5) AS preferred_deg FROM r_vec""")
def a27(spark, sf):
    return T.vector_stats(R.curves(spark, sf), ["unit_id", "feature"], 30).select(
        "unit_id", "feature", "n_bins", R.rnd("mvl", 8).alias("mvl"), R.rnd("preferred_deg", 5).alias("preferred_deg"))


@query("A28_rayleigh_uniformity", """SELECT unit_id, n, round(r, 8) AS r, round(n * r * r, 6) AS z,
  round(CASE WHEN n >= 3 THEN exp(sqrt(1.0::DOUBLE + 4.0 * n + 4.0 * (n * n - (n * r) * (n * r))) - (1 + 2 * n)) END, 6) AS p
  FROM (SELECT unit_id, CAST(count(*) AS DOUBLE) AS nd, count(*) AS n, sqrt(avg(cos(radians(hd))) ** 2 + avg(sin(radians(hd))) ** 2) AS r FROM r_angles GROUP BY unit_id)""")
def a28(spark, sf):
    return T.rayleigh_uniformity(R.angles(spark, sf), ["unit_id"], "hd").select(
        "unit_id", "n", R.rnd("r", 8).alias("r"), R.rnd("z").alias("z"), R.rnd("p").alias("p"))


@query("A29_rayleigh_occupancy", """SELECT unit_id, feature, round(score, 6) AS score, round(exp(-score / 2), 8) AS p FROM r_ray""")
def a29(spark, sf):
    return T.rayleigh_occupancy(R.curves(spark, sf), ["unit_id", "feature"], 30).select(
        "unit_id", "feature", R.rnd("score").alias("score"), R.rnd("p", 8).alias("p"))


KAPPA_SQL = """list_reduce([r * (2 - r * r) / (1 - r * r)] || [0.0 FOR i IN range(12)], lambda k, z:
  k - (list_reduce([0.0] || [CAST(121 - i AS DOUBLE) FOR i IN range(1, 121)], lambda a, m: 1.0 / (2.0 * m / k + a)) - r)
    / (1 - list_reduce([0.0] || [CAST(121 - i AS DOUBLE) FOR i IN range(1, 121)], lambda a, m: 1.0 / (2.0 * m / k + a)) / k
       - list_reduce([0.0] || [CAST(121 - i AS DOUBLE) FOR i IN range(1, 121)], lambda a, m: 1.0 / (2.0 * m / k + a)) ** 2))"""


@query("A30_von_mises_kappa", f"""SELECT unit_id, feature, round({KAPPA_SQL}, 6) AS kappa, r >= 0.124033502 AS kappa_pass
  FROM (SELECT unit_id, feature, sqrt(c * c + s * s) / w AS r FROM r_vec)""")
def a30(spark, sf):
    v = T.kappa_table(T.vector_stats(R.curves(spark, sf), ["unit_id", "feature"], 30))
    return v.select("unit_id", "feature", R.rnd("kappa").alias("kappa"), "kappa_pass")


@query("A31_information_content", """SELECT unit_id, feature, round(sum(occ_s / T * rate_hz / m * CASE WHEN rate_hz > 0 THEN log2(rate_hz / m) ELSE 0 END), 7) AS bits
  FROM (SELECT *, sum(occ_s) OVER w AS T, sum(rate_hz * occ_s) OVER w / sum(occ_s) OVER w AS m FROM r_curves WINDOW w AS (PARTITION BY unit_id, feature)) GROUP BY ALL""")
def a31(spark, sf):
    return T.information_content(R.curves(spark, sf), ["unit_id", "feature"]).select("unit_id", "feature", R.rnd("bits", 7).alias("bits"))


@query("A33_curve_summary", """WITH m AS (SELECT *, median(rate_hz) OVER (PARTITION BY unit_id, feature) AS md FROM r_curves),
  pk AS (SELECT unit_id, feature, any_value(md) AS md, max(rate_hz) AS pr, arg_min(bin, (-rate_hz, bin)) AS pb FROM m GROUP BY ALL),
  d AS (SELECT m.unit_id, m.feature, m.bin, m.rate_hz, pk.md, pr, pb, ((m.bin - pb) + 30) % 30 AS dr, ((pb - m.bin) + 30) % 30 AS dl FROM m JOIN pk USING (unit_id, feature)),
  lim AS (SELECT unit_id, feature, any_value(md) AS md, any_value(pr) AS pr, any_value(pb) AS pb,
    coalesce(min(CASE WHEN dr > 0 AND NOT rate_hz > md THEN dr END), 30) - 1 AS rr, coalesce(min(CASE WHEN dl > 0 AND NOT rate_hz > md THEN dl END), 30) - 1 AS ll FROM d GROUP BY ALL)
  SELECT unit_id, feature, lim.pb AS peak_bin, round(any_value(lim.pr), 6) AS peak_rate, round(any_value(lim.md), 6) AS median,
    CAST(least(any_value(rr + ll) + 1, 30) AS INTEGER) AS width_bins, round(avg(CASE WHEN dr > rr + 1 AND dl > ll + 1 THEN rate_hz END), 6) AS background_rate
  FROM d JOIN lim USING (unit_id, feature) GROUP BY unit_id, feature, lim.pb""")
def a33(spark, sf):
    s = T.circular_curve_summary(R.curves(spark, sf), ["unit_id", "feature"], 30)
    return s.select("unit_id", "feature", "peak_bin", R.rnd("peak_rate").alias("peak_rate"), R.rnd("median").alias("median"),
                    "width_bins", R.rnd("background_rate").alias("background_rate"))


@query("A47_A48_hd_class_counts", """SELECT CASE WHEN h = 2 AND kp THEN 3 ELSE h END AS hd_class, count(*) AS n_units FROM (
  SELECT CAST(exp(-score / 2) <= 0.01 AS INTEGER) + CAST(exp(-CAST(nn AS DOUBLE) * r * r) <= 0.01 AS INTEGER) AS h, r >= 0.124033502 AS kp FROM (
   SELECT ray.score, v.r, (SELECT count(*) FROM r_angles g WHERE g.unit_id = v.unit_id) AS nn
   FROM (SELECT unit_id, feature, sqrt(c * c + s * s) / w AS r FROM r_vec) v JOIN r_ray ray USING (unit_id, feature))) GROUP BY 1""")
def a47(spark, sf):
    keys = ["unit_id", "feature"]
    c = R.curves(spark, sf)
    v = T.vector_stats(c, keys, 30).join(T.rayleigh_occupancy(c, keys, 30), keys)
    n = R.angles(spark, sf).groupBy("unit_id").agg(F.count(F.lit(1)).alias("nn"))
    v = v.join(n, "unit_id").withColumn("shuffle_p", F.exp(-F.col("nn") * F.col("mvl") * F.col("mvl")))
    v = v.withColumn("kappa_pass", F.col("mvl") >= 0.124033502)
    return T.class_counts(T.classify_hd(v, "p", "shuffle_p", "kappa_pass"), [])


@query("F08_min_occupancy_mask", """SELECT unit_id, feature, bin, round(CASE WHEN occ_s >= 1.0 THEN rate_hz END, 6) AS rate_hz FROM r_curves""")
def f08(spark, sf):
    return T.min_occupancy_mask(R.curves(spark, sf), 1.0).select("unit_id", "feature", "bin", R.rnd("rate_hz").alias("rate_hz"))
