"""Response-cube, projection and PSTH queries."""
from pyspark.sql import functions as F

from .registry import query, CTES
from . import roles as R
from ..operators import rates as RT, tuning as T, asof
from .q_tuning import WEEK

LO, HI, W = -3600.0, 14400.0, 3600.0
CTES["r_hits"] = """SELECT s.session, s.unit_id, s.spike_id, s.t, r.trial_id, r.onset_s, r.x_idx, r.y_idx, r.luminance, s.t - r.onset_s AS lag_s
  FROM r_spikes s JOIN r_trials r ON s.session = r.session AND s.t >= r.onset_s - 3600 AND s.t < r.onset_s + 14400"""


@query("J03_trial_window_join", "SELECT session, spike_id, trial_id, round(lag_s, 6) AS lag_s FROM r_hits")
def j03(spark, sf):
    from ..operators.intervals import trial_window_join
    h = trial_window_join(R.spikes(spark, sf), R.trials(spark, sf), ["session"], lo=LO, hi=HI)
    return h.select("session", "spike_id", "trial_id", R.rnd("lag_s").alias("lag_s"))


@query("A05_rf_cube", """SELECT session, unit_id, y_idx, x_idx, luminance, CAST(floor((lag_s + 3600) / 3600) AS INTEGER) AS t_bin, count(*) AS n FROM r_hits GROUP BY ALL""")
def a05(spark, sf):
    return RT.response_cube(R.spikes(spark, sf), R.trials(spark, sf), ["session"], ["unit_id"], ["y_idx", "x_idx", "luminance"],
                            lo=LO, hi=HI, bin_s=W)


@query("A06_S07_presentations_occupancy", """SELECT session, y_idx, x_idx, count(*) AS presentations, round(sum(off - onset_s), 6) AS occupancy_s FROM (
  SELECT *, lead(onset_s) OVER (PARTITION BY session ORDER BY onset_s) AS off FROM r_trials) GROUP BY ALL""")
def a06(spark, sf):
    tr = RT.trial_bounds(R.trials(spark, sf), ["session"], width=WEEK).withColumn("dur", F.col("offset_s") - F.col("onset_s"))
    return RT.presentations(tr, ["session", "y_idx", "x_idx"], "dur").withColumn("occupancy_s", R.rnd("occupancy_s"))


@query("A07_free_moving_exposure", """WITH h AS (SELECT t.*, CASE WHEN p.t IS NULL OR (n.t IS NOT NULL AND n.t - t.onset_s < t.onset_s - p.t) THEN n.hd ELSE p.hd END AS hd
   FROM r_trials t ASOF LEFT JOIN r_frames p ON t.session = p.session AND t.onset_s >= p.t ASOF LEFT JOIN r_frames n ON t.session = n.session AND t.onset_s < n.t),
  p AS (SELECT session, trial_id, unnest(range(CAST(f AS BIGINT), CAST(f AS BIGINT) + 60)) AS px FROM (
    SELECT *, floor(((((x_idx * CAST(12 AS DOUBLE) - hd) % 360) + 360) % 360 - 10) / CAST(0.3333333333333333 AS DOUBLE)) AS f FROM h))
  SELECT session, bin, count(DISTINCT trial_id) AS n_trials FROM (SELECT session, trial_id, CAST(floor(((px % 1080) + 1080) % 1080 / 36) AS INTEGER) AS bin FROM p) GROUP BY ALL""")
def a07(spark, sf):
    h = asof.asof_nearest(R.trials(spark, sf), R.frames(spark, sf), ["session"], "onset_s", "t", ["hd"], tie="earlier", width=WEEK)
    return RT.free_moving_exposure(h, ["session"], bar_deg=F.col("x_idx") * 12.0, heading="hd", width_deg=20.0, n_px=1080, group=36)


@query("A08_bar_coverage", """WITH p AS (SELECT session, trial_id, unnest(range(CAST(x_idx * 36 - 8 AS BIGINT), CAST(x_idx * 36 - 8 + 17 AS BIGINT))) AS px FROM r_trials)
  SELECT session, CAST(floor(((px % 1080) + 1080) % 1080 / 12) AS INTEGER) AS bin, count(*) AS pixel_count, count(DISTINCT trial_id) AS trial_count FROM p GROUP BY 1, 2""")
def a08(spark, sf):
    tr = R.trials(spark, sf).withColumn("cx", F.col("x_idx") * 36.0)
    return RT.bar_coverage(tr, "cx", 17, 1080, 12, ["session"])


@query("A09_J15_coarsen_any", """SELECT DISTINCT session, trial_id, CAST(floor(((px % 1080) + 1080) % 1080 / 30) AS INTEGER) AS bin FROM (
  SELECT session, trial_id, unnest(range(CAST(x_idx * 36 - 20 AS BIGINT), CAST(x_idx * 36 + 21 AS BIGINT))) AS px FROM r_trials)""")
def a09(spark, sf):
    px = RT.cover_pixels(R.trials(spark, sf), F.col("x_idx") * 36 - 20, F.col("x_idx") * 36 + 20, 1080)
    return RT.coarsen_any(px, ["session", "trial_id"], "px", 30)


@query("A10_time_sum", "SELECT unit_id, y, x, CAST(sum(n) AS BIGINT) AS n FROM r_cube WHERE t_bin >= 2 AND t_bin < 6 GROUP BY ALL")
def a10(spark, sf):
    return RT.time_sum(R.cube(spark, sf), ["unit_id", "y", "x"], 2, 6)


CTES["r_rates"] = "SELECT c.*, g.presentations, c.n / (g.presentations * CAST(0.001 AS DOUBLE)) AS rate_hz FROM r_cube c JOIN r_grid g USING (y, x)"


@query("A12_counts_to_rates", "SELECT unit_id, y, x, t_bin, round(rate_hz, 6) AS rate_hz FROM r_rates")
def a12(spark, sf):
    return RT.counts_to_rates(R.cube(spark, sf), R.grid(spark, sf), ["y", "x"], 0.001).select("unit_id", "y", "x", "t_bin", R.rnd("rate_hz").alias("rate_hz"))


@query("A11_mean_rate", """SELECT unit_id, y, x, round(CASE WHEN count(r) = count(*) THEN sum(r * w) / sum(w) END, 6) AS mean_hz FROM (
  SELECT unit_id, y, x, CASE WHEN n >= 2 THEN rate_hz END AS r, CAST(1 + t_bin AS DOUBLE) AS w FROM r_rates) GROUP BY ALL""")
def a11(spark, sf):
    r = RT.counts_to_rates(R.cube(spark, sf), R.grid(spark, sf), ["y", "x"], 0.001)
    r = r.withColumn("rate_hz", F.when(F.col("n") >= 2, F.col("rate_hz"))).withColumn("w", (1 + F.col("t_bin")).cast("double"))
    return RT.mean_rate(r, ["unit_id", "y", "x"], weight="w").withColumn("mean_hz", R.rnd("mean_hz"))


@query("A13_resolve_presentations", """SELECT y, x, coalesce(CASE WHEN (y + x) % 3 > 0 THEN s.n + 1 END, b.n) AS presentations
  FROM (SELECT y, x, count(*) AS n FROM r_resp WHERE polarity = 'O' GROUP BY ALL) s FULL JOIN (SELECT y, x, count(*) AS n FROM r_resp GROUP BY ALL) b USING (y, x)""")
def a13(spark, sf):
    r = R.resp(spark, sf)
    saved = RT.presentations(r.filter("polarity = 'O'"), ["y", "x"]).withColumn(
        "presentations", F.when((F.col("y") + F.col("x")) % 3 > 0, F.col("presentations") + 1))
    return RT.resolve_presentations(saved, r, ["y", "x"])


CTES["r_map"] = """SELECT u.unit_id, g.y, g.x, c.n FROM (SELECT DISTINCT unit_id FROM r_cube) u CROSS JOIN r_grid g
  LEFT JOIN (SELECT unit_id, y, x, CAST(sum(n) AS BIGINT) AS n FROM r_cube WHERE t_bin < 8 GROUP BY ALL) c ON c.unit_id = u.unit_id AND c.y = g.y AND c.x = g.x"""


def rmap(spark, sf, fill=None):
    s = RT.time_sum(R.cube(spark, sf), ["unit_id", "y", "x"], 0, 8)
    return RT.dense_map(s, ["unit_id"], (7, 30), "n", fill, R.grid(spark, sf))


@query("A14_sum_to_1d", """SELECT unit_id, x, CASE WHEN count(n) = count(*) THEN CAST(sum(n) AS BIGINT) END AS n_strict, CAST(sum(n) AS BIGINT) AS n_skip FROM r_map GROUP BY ALL""")
def a14(spark, sf):
    m = rmap(spark, sf)
    a = RT.sum_to_1d(m, ["unit_id"], "x", value="n").withColumnRenamed("n", "n_strict")
    b = RT.sum_to_1d(m, ["unit_id"], "x", value="n", skip_missing=True).withColumnRenamed("n", "n_skip")
    return a.join(b, ["unit_id", "x"])


@query("A15_F09_rf_projection_tc", """WITH det AS (SELECT DISTINCT unit_id FROM r_map WHERE n >= 190)
  SELECT unit_id, x, CAST(sum(coalesce(n, 0)) AS BIGINT) AS n FROM r_map WHERE unit_id IN (SELECT unit_id FROM det)
   AND (unit_id, y) IN (SELECT DISTINCT (unit_id, y) FROM r_map WHERE n >= 190) GROUP BY ALL""")
def a15(spark, sf):
    m = rmap(spark, sf, 0)
    mask = m.filter("n >= 190")
    return RT.sum_to_1d(m.join(mask.select("unit_id").distinct(), "unit_id", "left_semi"), ["unit_id"], "x", value="n", mask=mask)


@query("A16_vertical_profiles", """WITH p AS (SELECT unit_id, y, sum(coalesce(n, 0)) / CAST(count(*) AS DOUBLE) AS v FROM r_map GROUP BY ALL)
  SELECT unit_id, round(max(v), 6) AS peak_value, arg_min(y, (-v, y)) AS peak_y FROM p GROUP BY unit_id""")
def a16(spark, sf):
    p = rmap(spark, sf, 0).groupBy("unit_id", "y").agg(F.avg("n").alias("v"))
    return p.groupBy("unit_id").agg(R.rnd(F.max("v")).alias("peak_value"), F.max_by("y", F.struct(F.col("v"), -F.col("y"))).alias("peak_y"))


@query("A17_pooled_profile", """SELECT unit_id, c.x, round(n / (p * CAST(0.4 AS DOUBLE)), 6) AS rate_hz FROM (SELECT unit_id, x, sum(n) AS n FROM r_cube GROUP BY ALL) c
  JOIN (SELECT x, sum(presentations) AS p FROM r_grid GROUP BY x) g ON c.x = g.x""")
def a17(spark, sf):
    return RT.pooled_profile(R.cube(spark, sf), R.grid(spark, sf), ["unit_id"], "x", 0.4).select("unit_id", "x", R.rnd("rate_hz").alias("rate_hz"))


@query("F06_rf_pick", """SELECT unit_id, feature, bin, n_spikes FROM r_curves WHERE (unit_id, feature) IN (
  SELECT (unit_id, feature) FROM r_curves GROUP BY unit_id, feature HAVING count(*) FILTER (rate_hz = 0) <= 0)""")
def f06(spark, sf):
    return RT.rf_pick(R.curves(spark, sf), ["unit_id", "feature"], "rate_hz", 0).select("unit_id", "feature", "bin", "n_spikes")


@query("F07_rf_bin_qc", "SELECT unit_id, count(*) FILTER (n IS NULL OR n = 0) AS n_zero, count(n) AS n_valid, count(*) FILTER (n IS NULL OR n = 0) <= 20 AND count(n) >= 1 AS keep FROM r_map GROUP BY unit_id")
def f07(spark, sf):
    return RT.bin_qc(rmap(spark, sf), ["unit_id"], "n", 20)


@query("F10_polarity_select", "SELECT luminance, y_idx, x_idx, count(*) AS presentations FROM r_trials WHERE luminance = 1 GROUP BY ALL")
def f10(spark, sf):
    return RT.presentations(R.trials(spark, sf).filter("luminance = 1"), ["luminance", "y_idx", "x_idx"])


@query("A50_psth", """SELECT h.session, unit_id, CAST(floor((lag_s + 3600) / 1800) AS INTEGER) AS t_bin, count(*) AS n, any_value(k.n) AS n_trials,
  round(count(*) / CAST(any_value(k.n) AS DOUBLE), 9) AS per_trial, round(count(*) / CAST(any_value(k.n) AS DOUBLE) / 1800, 12) AS rate_hz
  FROM r_hits h JOIN (SELECT session, count(*) AS n FROM r_trials GROUP BY 1) k ON k.session = h.session GROUP BY 1, 2, 3""")
def a50(spark, sf):
    p = RT.psth(R.spikes(spark, sf), R.trials(spark, sf), ["session"], ["unit_id"], lo=LO, hi=HI, bin_s=1800.0)
    return p.select("session", "unit_id", "t_bin", "n", "n_trials", R.rnd("per_trial", 9).alias("per_trial"), R.rnd("rate_hz", 12).alias("rate_hz"))


@query("A51_region_psth", """SELECT unit_id, region, tb AS t_bin, count(r) AS n, round(avg(r), 6) AS mean_hz, round(stddev_samp(r) / sqrt(count(r)), 6) AS sem_hz FROM (
  SELECT unit_id, y // 3 AS region, y, x, CAST(floor(t_bin / 2) AS INTEGER) AS tb, avg(rate_hz) AS r FROM r_rates GROUP BY ALL) GROUP BY ALL""")
def a51(spark, sf):
    r = RT.counts_to_rates(R.cube(spark, sf), R.grid(spark, sf), ["y", "x"], 0.001).withColumn("region", F.floor(F.col("y") / 3).cast("int"))
    return RT.region_psth(r, ["unit_id"], "region", group=2).select("unit_id", "region", "t_bin", "n", R.rnd("mean_hz").alias("mean_hz"), R.rnd("sem_hz").alias("sem_hz"))


@query("A52_mergeable_moments", """SELECT n_regionkey AS region, count(c_acctbal) AS n, round(avg(c_acctbal), 6) AS mean, round(stddev_samp(c_acctbal) / sqrt(count(*)), 6) AS sem
  FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def a52(spark, sf):
    c = R.table(spark, sf, "customer")
    parts = RT.moments(c, ["c_nationkey"], "c_acctbal").join(R.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    m = RT.merge_moments(parts.withColumn("region", F.col("n_regionkey")), ["region"])
    return m.select("region", "n", R.rnd("mean").alias("mean"), R.rnd("sem").alias("sem"))


@query("A88_nested_time_means", """WITH a AS (SELECT y // 3 AS region, unit_id, t_bin, avg(rate_hz) AS v FROM r_rates GROUP BY ALL),
  b AS (SELECT unit_id, t_bin, avg(v) AS v FROM a GROUP BY ALL)
  SELECT t_bin, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v) / sqrt(count(v)), 6) AS sem FROM b GROUP BY t_bin""")
def a88(spark, sf):
    r = RT.counts_to_rates(R.cube(spark, sf), R.grid(spark, sf), ["y", "x"], 0.001).withColumn("region", F.floor(F.col("y") / 3).cast("int"))
    m = RT.nested_means(r, [["region", "unit_id", "t_bin"], ["unit_id", "t_bin"], ["t_bin"]], "rate_hz")
    return m.select("t_bin", "n", R.rnd("mean").alias("mean"), R.rnd("sem").alias("sem"))


@query("A85_moving_coordinate_trials", """WITH h AS (SELECT t.*, p.hd FROM r_trials t ASOF JOIN r_frames p ON t.session = p.session AND t.onset_s >= p.t),
  q AS (SELECT session, trial_id, y_idx, CAST(((floor(x_idx * CAST(12 AS DOUBLE) * CAST(3 AS DOUBLE) - hd * 3) % 1080) + 1080) % 1080 AS INTEGER) AS px FROM h)
  SELECT session, y_idx, CAST(floor(px / 36) AS INTEGER) AS bin, count(DISTINCT trial_id) AS presentations FROM q GROUP BY ALL""")
def a85(spark, sf):
    h = asof.asof_backward(R.trials(spark, sf), R.frames(spark, sf), ["session"], "onset_s", "t", ["hd"], width=WEEK).filter("hd IS NOT NULL")
    h = h.withColumn("px", RT.moving_pixel(F.col("x_idx") * 12.0, 3.0, F.col("hd") * 3.0, 1080, -1))
    return RT.coarsen_any(h, ["session", "trial_id", "y_idx"], "px", 36).groupBy("session", "y_idx", "bin").agg(F.count(F.lit(1)).alias("presentations"))
