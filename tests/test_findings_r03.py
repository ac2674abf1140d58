"""Small cases of the findings of round 3."""
from pyspark.sql import functions as F

from table_rows import rows
from tunefold.functions.geometry import bearing_to
from tunefold.operators import behavior as B, dense, egocentric as E, rates as RT, signals as S, spectral as SP
from tunefold.operators.intervals import trial_window_join
from tunefold.plans.roles import mean_above, rnd
from tunefold.sources.files import discover_session_pairs
from tunefold.streaming import streams as ST


def test_bearing_on_the_target_itself(spark):
    d = spark.createDataFrame([(20.0, 20.0, 30.0), (20.0, 10.0, 30.0), (None, 20.0, 30.0)], "x DOUBLE, y DOUBLE, hd DOUBLE")
    b = lambda **kw: [r[0] for r in d.select(bearing_to("x", "y", F.lit(20.0), F.lit(20.0), "hd", **kw)).collect()]
    assert b() == [None, 150.0, None]
    assert b(on_target_deg=180.0) == [150.0, 150.0, None]


def test_frames_on_the_centre_have_the_given_bearing(spark):
    f = spark.createDataFrame([(0, i, 5.0 + i, 30.0, 20.0, 20.0, True) for i in range(3)], "session INT, frame_id INT, t DOUBLE, hd DOUBLE, x DOUBLE, y DOUBLE, valid BOOLEAN")
    prep = lambda **kw: B.prepare(f, ["session"], arena=(40.0, 40.0), smooth_s=0.5, speed_min=0.1, width=100.0, gap_width=10.0, **kw).first()["cb_deg"]
    assert prep() is None and prep(on_target_deg=180.0) == 150.0


def test_rounding_is_that_of_sql(spark):
    d = spark.createDataFrame([(1.005,), (2.675,), (0.285,), (-1.005,), (None,)], "v DOUBLE")
    assert [r[0] for r in d.select(rnd("v", 2)).collect()] == [1.0, 2.68, 0.28, -1.0, None]  # SELECT round(v, 2) in DuckDB


def test_anchors_of_one_time_go_by_their_ties(spark):
    d = spark.createDataFrame([(0, i, 7, 99) for i in (3, 1, 2)] + [(0, 9, 20, 99)], "s INT, i INT, t BIGINT, e BIGINT")
    got = S.cycle_ranges(d, ["s"], "t", rec_end="e", width=5.0, ties=["i"])
    assert rows(got, "i", "stop") == rows(spark.createDataFrame([(1, 6), (2, 6), (3, 19), (9, 99)], "i INT, stop BIGINT"), "i", "stop")


def test_pairs_of_runs_leave_the_join_judged(spark):
    runs = spark.createDataFrame([(i, "m", "d", 0, "s", "rf" if i % 2 else "ebb", 1.0) for i in range(6)], "run_id INT, mouse STRING, date STRING, probe INT, sort_source STRING, kind STRING, coverage DOUBLE")
    units = spark.createDataFrame([(r, u) for r in range(6) for u in range(r, r + 4)] + [(0, 0), (1, None), (2, None)], "run_id INT, unit_id INT")
    got = discover_session_pairs(runs, units, ("rf", "ebb"))
    assert sorted((r["run_a"], r["run_b"], r["n_shared"]) for r in got.collect()) == sorted((a, b, 3) for a in (1, 3, 5) for b in (0, 2, 4) if abs(a - b) == 1)
    assert "expand" not in got._jdf.queryExecution().optimizedPlan().toString().lower() and got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 3


def test_response_cube_counts_hits_where_a_units_spikes_are(spark):
    tr = spark.createDataFrame([(0, i, float(10 * i), i % 2, None if i == 3 else 5) for i in range(6)] + [(None, 9, 0.0, 0, 5)], "session INT, trial_id INT, onset_s DOUBLE, y INT, x INT")
    sp = spark.createDataFrame([(0, u, float(t)) for u in (1, 2, 77) for t in range(0, 60, u + 1)] + [(0, None, 9.5), (0, 1, None), (None, 1, 0.5)], "session INT, unit BIGINT, t DOUBLE")
    got = RT.response_cube(sp, tr, ["session"], ["unit"], ["y", "x"], lo=-4.0, hi=16.0, bin_s=5.0, blocks=3)
    hits = trial_window_join(sp, tr, ["session"], lo=-4.0, hi=16.0).withColumn("t_bin", F.floor((F.col("lag_s") + 4.0) / 5.0).cast("int"))
    want = hits.groupBy("session", "unit", "y", "x", "t_bin").agg(F.count(F.lit(1)).alias("n"))
    assert got.schema.simpleString() == want.schema.simpleString()
    cols = ["session", "unit", "y", "x", "t_bin", "n"]
    assert rows(got, *cols) == rows(want, *cols) and want.count() > 20
    assert "join" not in got._jdf.queryExecution().optimizedPlan().toString().lower()


def poses(spark):
    return spark.createDataFrame([(0, u, float(t), 37.0 * t % 360, 3.0 * t % 40, 7.0 * t % 44) for u in (1, 2) for t in range(40)] + [(0, 1, 1.0, None, 1.0, 1.0)], "s INT, u INT, t DOUBLE, hd DOUBLE, x DOUBLE, y DOUBLE")


def test_a_ray_is_computed_once(spark):
    geom = dict(n_theta=6, dist_cm=4.0, n_dist=15)
    for shape in ({"arena": (40.0, 40.0)}, {"circle": (20.0, 20.0, 20.0)}):
        got = E.ray_bins(poses(spark), **geom, **shape)
        assert got.columns == ["s", "u", "t", "hd", "x", "y", "theta_bin", "dist_bin"] and got.count() > 50
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("SIN(") == 1 and plan.count("COS(") == 1


def test_subsets_are_counted_at_once(spark):
    geom, subs = dict(n_theta=6, dist_cm=4.0, n_dist=15, arena=(40.0, 40.0)), {"all": F.lit(True), "early": F.col("t") < 9, "low": F.when(F.col("t") > 3, F.col("y") < 20)}
    p = poses(spark)
    got = E.subset_maps(p, p, ["s"], ["u"], subs, 0.5, **geom)
    want = []
    for k, c in subs.items():
        r = E.ray_bins(p.filter(c), **geom)
        n = r.groupBy("s", "u", "theta_bin", "dist_bin").agg(F.count(F.lit(1)).alias("n_spikes"))
        o = r.groupBy("s", "theta_bin", "dist_bin").agg((F.count(F.lit(1)) * 0.5).alias("occ_s"))
        want += rows(p.select("s", "u").distinct().join(o, "s").join(n, ["s", "u", "theta_bin", "dist_bin"], "left").fillna(0, ["n_spikes"]).withColumn("subset", F.lit(k)), "u", "subset", "theta_bin", "dist_bin", "n_spikes", "occ_s")
    assert sorted(rows(got, "u", "subset", "theta_bin", "dist_bin", "n_spikes", "occ_s")) == sorted(want)
    # what a spike's subsets add to its row is a count, not a row of its own before the shuffle
    assert got._jdf.queryExecution().optimizedPlan().toString().count("count_if") + got._jdf.queryExecution().optimizedPlan().toString().count("count(") >= 6


def test_dense_cells_are_laid_out_by_a_hash_table(spark):
    d = spark.createDataFrame([(1, 0, 2, 5), (1, None, 2, 7), (2, 3, 3, 1)], "k INT, y INT, x INT, v INT")
    dim = spark.createDataFrame([(1, 0, 2, 0.5), (1, 2, 0, 1.5), (1, None, 2, 2.5), (2, 9, 9, 3.5), (3, 0, 0, 4.5)], "k INT, y INT, x INT, o DOUBLE")
    got = dense.dense_by_table(d, ["k"], dim, ["k"], ["y", "x"], ["v"], ["o"], fill=0)
    assert rows(got, "k", "y", "x", "v", "o") == rows(spark.createDataFrame([(1, 0, 2, 5, 0.5), (1, 2, 0, 0, 1.5), (1, None, 2, 7, 2.5), (2, 9, 9, 0, 3.5)], "k INT, y INT, x INT, v INT, o DOUBLE"), "k", "y", "x", "v", "o")
    assert "element_at" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_a_mean_that_meets_its_limit_is_not_above_it(spark):
    cents = [0, 6, 7, 7, 4, 4, 10, 9, 6, 5, 4, 2, 1, 7, 2, 7, 2, 7, 1, 8]  # 99 in all, but the doubles added in this order give more than 0.99
    d = spark.createDataFrame([(1, c / 100) for c in cents] + [(2, c / 100) for c in cents[::-1]] + [(3, 0.0495), (3, 0.0496), (3, None), (4, None), (5, 0.0495)], "k INT, v DOUBLE").coalesce(1)
    got = {r["k"]: r["m"] for r in d.groupBy("k").agg(mean_above("v", "0.0495").alias("m")).collect()}
    assert got == {1: False, 2: False, 3: True, 4: None, 5: False}


def test_streamed_samples_of_one_time_go_by_their_place(spark, tmp_path):
    at = lambda s: f"2024-01-01 00:00:{s:02d}"
    seen = [(1, at(0), 1, False), (1, at(1), 2, True), (1, at(1), 3, False), (1, at(2), 4, False), (1, at(3), 7, False), (1, at(3), 6, True), (2, at(1), 1, True), (2, at(1), 0, False), (2, at(5), 2, False)]
    spark.createDataFrame(seen, "ch INT, ts STRING, i BIGINT, on BOOLEAN").selectExpr("ch", "CAST(ts AS TIMESTAMP) AS ts", "i", "on").write.parquet(f"{tmp_path}/in")
    s = ST.closed(spark.readStream.schema("ch INT, ts TIMESTAMP, i BIGINT, on BOOLEAN").parquet(f"{tmp_path}/in"), f"{tmp_path}/w", "ts", "ch")
    got = ST.drain(ST.stream_pulses(s, "ch", "ts", "on", place="i"), f"{tmp_path}/w", mode="append")
    assert sorted((r["ch"], (r["end_us"] - r["start_us"]) // 10**6, r["start_us"] // 10**6 % 60) for r in got.collect()) == [(1, 0, 1), (1, 0, 3), (2, 4, 1)]


def test_correlogram_counts_borders_and_not_pairs(spark):
    # many lags lie on a border of two bins, where the rounding of the distance decides
    at = [(1, round(i * 0.05 % 3.0, 2)) for i in range(200)] + [(2, -0.3), (2, 0.0), (2, 0.3), (2, 0.9), (3, 1.0), (3, None), (3, float("nan")), (None, 1.0), (None, 1.1)]
    d = spark.createDataFrame(at, "u INT, t DOUBLE")
    got = SP.acg(d, ["u"], "t", bin_s=0.1, max_lag_s=0.6)
    p = d.withColumn("i", F.monotonically_increasing_id()).localCheckpoint()
    q = p.toDF("u", "t2", "i2").join(p, "u").filter("i <> i2 AND t2 >= t AND t2 - t <= 0.6D AND NOT isnan(t)")
    want = q.groupBy("u", F.floor((F.col("t2") - F.col("t")) / 0.1 + 0.5).cast("int").alias("lag")).agg(F.sum(F.when(F.expr("t2 = t"), 1).otherwise(F.when(F.expr("floor((t2 - t) / 0.1D + 0.5D) = 0"), 2).otherwise(1))).alias("n"))
    assert got.schema.simpleString() == "struct<u:int,lag:int,n:bigint>"
    assert rows(got, "u", "lag", "n") == rows(want, "u", "lag", "n") and want.count() > 8
    assert "join" not in got._jdf.queryExecution().optimizedPlan().toString().lower()
