"""File round trips, stores, catalogs and streams over the given tables."""
from pyspark.sql import functions as F

from .registry import query, CTES
from . import roles as R
from ..sources import files as S
from ..streaming import streams as ST
from ..operators import populations as PO
from .q_tuning import WEEK

K = ["unit_id", "feature"]


@query("S01_S02_labelled_spikes", """SELECT c_custkey AS unit_id, c_mktsegment AS label, count(s.spike_id) AS n_spikes FROM customer LEFT JOIN r_spikes s ON s.unit_id = c_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1, 2""")
def s01(spark, sf):
    p = S.scratch(spark, "labels")
    c = R.table(spark, sf, "customer").select(F.col("c_custkey").alias("cluster_id"), F.col("c_mktsegment").alias("KSLabel"))
    c.write.option("sep", "\t").option("header", True).csv(p)
    lab = S.read_unit_labels(spark, p, "BUILDING").select(F.col("cluster_id").alias("unit_id"), F.col("KSLabel").alias("label"))
    n = R.spikes(spark, sf).groupBy("unit_id").agg(F.count(F.lit(1)).alias("n_spikes"))
    return lab.join(n, "unit_id", "left").withColumn("n_spikes", F.coalesce("n_spikes", F.lit(0)))


@query("S03_read_pose_csv", "SELECT event_id AS frame_id, CASE WHEN event_type = 'view' THEN round(value, 6) END AS center_x, CASE WHEN event_type = 'view' THEN CAST(k AS DOUBLE) END AS center_y, CASE WHEN event_type = 'view' THEN round((value * CAST(7.2 AS DOUBLE)) % CAST(360 AS DOUBLE), 6) END AS hd_deg FROM r_ev")
def s03(spark, sf):
    p = S.scratch(spark, "pose")
    e = R.ev(spark, sf)
    e.filter("event_type = 'view'").select(F.col("event_id").alias("frame"), F.col("value").alias("center_x"), F.col("k").cast("double").alias("center_y"),
                                           ((F.col("value") * 7.2) % F.lit(360.0)).alias("hd_deg")).write.option("header", True).csv(p)
    out = S.read_pose_csv(spark, p, e.select(F.col("event_id").alias("frame_id")))
    return out.select("frame_id", R.rnd("center_x").alias("center_x"), "center_y", R.rnd("hd_deg").alias("hd_deg"))


@query("S05_read_intervals", "SELECT interval_type, round(start_s, 6) AS start, round(end_s, 6) AS stop FROM r_intervals WHERE interval_type = 'light'")
def s05(spark, sf):
    p = S.scratch(spark, "intervals")
    R.intervals(spark, sf).select("interval_type", F.col("start_s").alias("start"), F.col("end_s").alias("end")).write.option("header", True).csv(p)
    return S.read_intervals(spark, p, "light").select("interval_type", R.rnd("start").alias("start"), R.rnd("end").alias("stop"))


@query("S08_S09_tc_csv_roundtrip", "SELECT CAST(unit_id AS VARCHAR) AS unit_id, (bin + 0.5) * CAST(12 AS DOUBLE) AS angle, round(rate_hz, 6) AS value FROM r_curves WHERE feature = 'hd'")
def s08(spark, sf):
    p = S.scratch(spark, "tc")
    centers = [(b + 0.5) * 12.0 for b in range(30)]
    c = R.curves(spark, sf).filter("feature = 'hd'").withColumn("angle", (F.col("bin") + 0.5) * 12.0)
    S.tc_csv_write(c, p, "unit_id", "angle", "rate_hz", centers)
    return S.tc_csv_read(spark, p, centers).withColumn("value", R.rnd("value"))


@query("S10_S11_tc_json_roundtrip", "SELECT unit_id, feature, bin, n_spikes, round(rate_hz, 6) AS rate_hz FROM r_curves")
def s10(spark, sf):
    p = S.scratch(spark, "tcj")
    S.tc_json_write(R.curves(spark, sf), p, K)
    return S.tc_json_read(spark, p, "unit_id BIGINT, feature STRING").select(*K, "bin", "n_spikes", R.rnd("rate_hz").alias("rate_hz"))


@query("S12_cube_violations", """SELECT unit_id, y, x, t_bin, CASE WHEN n - 60 < 0 THEN 'negative_count' WHEN coalesce(p, 0) = 0 AND n - 60 > 0 THEN 'count_without_presentation' END AS rule FROM r_cube LEFT JOIN (SELECT y, x, presentations AS p FROM r_grid WHERE x < 28) USING (y, x)
  WHERE n - 60 < 0 OR (coalesce(p, 0) = 0 AND n - 60 > 0)""")
def s12(spark, sf):
    return S.cube_violations(R.cube(spark, sf).withColumn("n", F.col("n") - 60), R.grid(spark, sf).filter("x < 28"), ["unit_id"])


@query("S13_cube_write_bands", "SELECT band, count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS total FROM (SELECT n, unnest(CASE WHEN t_bin < 3 THEN ['full', 'early'] WHEN t_bin < 7 THEN ['full', 'middle'] ELSE ['full', 'late'] END) AS band FROM r_cube) GROUP BY band")
def s13(spark, sf):
    p = S.scratch(spark, "bands")
    b = F.when(F.col("t_bin") < 3, "early").when(F.col("t_bin") < 7, "middle").otherwise("late")
    S.write_bands(R.cube(spark, sf).withColumn("band", F.explode(F.array(F.lit("full"), b))), p)
    return spark.read.parquet(p).groupBy(F.col("band").cast("string").alias("band")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n").alias("total"))


@query("S14_content_key")
def s14(spark, sf):
    return S.content_key(R.cube(spark, sf), {"sigma": 1.8, "wrap": True})


@query("S16_parse_event_log", "SELECT CASE WHEN event_type = 'error' AND k % 4 = 1 THEN 'Center' WHEN event_type = 'error' THEN 'empty' ELSE event_type END AS label, count(DISTINCT user_id) AS n_cycles, min(user_id) AS first_cycle FROM r_ev GROUP BY 1")
def s16(spark, sf):
    p = S.scratch(spark, "log")
    e = R.ev(spark, sf)
    name = F.when(F.col("event_type") == "error", "empty").otherwise(F.col("event_type"))
    e.select(F.concat(F.lit("info label="), name, F.lit(" index="), (F.col("k") % 4).cast("string"), F.lit(" cycle="), F.col("user_id").cast("string")).alias("value")).write.text(p)
    l = S.parse_event_log(spark.read.text(p))
    return l.select("label", F.size("cycles").cast("long").alias("n_cycles"), F.get("cycles", F.lit(0)).alias("first_cycle"))


@query("S17_merge_json_lists", "SELECT l_orderkey AS k, array_to_string(list_concat(coalesce(list(l_linenumber ORDER BY l_linenumber) FILTER (l_returnflag = 'R'), []), coalesce(list(l_linenumber ORDER BY l_linenumber) FILTER (l_returnflag <> 'R'), [])), ',') AS v FROM lineitem GROUP BY 1")
def s17(spark, sf):
    """Every order's returned lines, then its other lines: each row of the table is in one of the two lists, which an order bounds."""
    li = R.table(spark, sf, "lineitem")
    g = lambda c: li.filter(c).groupBy(F.col("l_orderkey").alias("k")).agg(F.sort_array(F.collect_list("l_linenumber")).alias("v"))
    return S.merge_lists(g("l_returnflag = 'R'"), g("l_returnflag <> 'R'"), "k", "v").withColumn("v", F.concat_ws(",", F.col("v").cast("array<string>")))


@query("S19_discover_session_pairs", """WITH r AS (SELECT o_orderkey AS run_id, o_custkey % 50 AS mouse, year(o_orderdate) AS date, CAST(month(o_orderdate) % 2 AS INTEGER) AS probe, o_orderstatus AS src, CASE WHEN o_orderkey % 2 = 0 THEN 'rf' ELSE 'ebb' END AS kind FROM orders WHERE (o_totalprice % 100) / 100 > 0.5),
  u AS (SELECT DISTINCT l_orderkey AS run_id, l_suppkey % 10 AS unit_id FROM lineitem)
  SELECT a.mouse, a.date, a.probe, a.src AS sort_source, a.run_id AS run_a, b.run_id AS run_b, count(DISTINCT ua.unit_id) AS n_shared FROM r a JOIN r b ON a.mouse = b.mouse AND a.date = b.date AND a.probe = b.probe AND a.src = b.src AND a.kind = 'rf' AND b.kind = 'ebb'
  JOIN u ua ON ua.run_id = a.run_id JOIN u ub ON ub.run_id = b.run_id AND ub.unit_id = ua.unit_id GROUP BY 1, 2, 3, 4, 5, 6 HAVING count(DISTINCT ua.unit_id) >= 3""")
def s19(spark, sf):
    o = R.table(spark, sf, "orders")
    runs = o.select(F.col("o_orderkey").alias("run_id"), (F.col("o_custkey") % 50).alias("mouse"), F.year("o_orderdate").cast("long").alias("date"), (F.month("o_orderdate") % 2).alias("probe"), F.col("o_orderstatus").alias("sort_source"),
                    F.when(F.col("o_orderkey") % 2 == 0, "rf").otherwise("ebb").alias("kind"), ((F.col("o_totalprice") % 100) / 100).alias("coverage"))
    u = R.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id"), (F.col("l_suppkey") % 10).alias("unit_id")).distinct()
    return S.discover_session_pairs(runs, u, ("rf", "ebb"), min_coverage=0.5)


@query("S20_result_run_store", "SELECT unit_id, feature, peak_bin FROM r_peaks")
def s20(spark, sf):
    from .q_profiles import peaks
    root = S.scratch(spark, "runs")
    S.save_run({"summary": peaks(spark, sf).select(*K, "peak_bin")}, root, "run1", {"seed": "0"})
    return S.load_run(spark, root, "run1", "summary")


@query("S21_session_edit_upsert", """SELECT coalesce(a.k, b.k) AS session_id, array_to_string(CASE WHEN b.op = 'delete' AND a.i IS NULL THEN list_concat(coalesce(a.d, []), CASE WHEN list_contains(coalesce(a.d, []), b.d) THEN [] ELSE [b.d] END) ELSE coalesce(a.d, []) END, ',') AS delete_frames, CASE WHEN b.op = 'interp' THEN b.d WHEN b.op = 'clear' THEN NULL ELSE a.i END AS interp
  FROM (SELECT c_custkey AS k, [CAST(c_nationkey AS INTEGER), 99] AS d, CASE WHEN c_acctbal > 5000 THEN c_nationkey END AS i FROM customer WHERE c_nationkey < 20) a FULL JOIN (SELECT c_custkey AS k, CAST(c_custkey % 25 AS INTEGER) AS d, CASE c_custkey % 3 WHEN 0 THEN 'delete' WHEN 1 THEN 'interp' ELSE 'clear' END AS op FROM customer WHERE c_nationkey > 5) b ON a.k = b.k""")
def s21(spark, sf):
    c = R.table(spark, sf, "customer").withColumn("date", F.lit("d")).withColumnRenamed("c_custkey", "session_id")
    old = c.filter("c_nationkey < 20").select("date", "session_id", F.array(F.col("c_nationkey").cast("int"), F.lit(99)).alias("delete_frames"), F.when(F.col("c_acctbal") > 5000, F.col("c_nationkey")).alias("interp"))
    op = F.when(F.col("session_id") % 3 == 0, "delete").when(F.col("session_id") % 3 == 1, "interp").otherwise("clear")
    x = (F.col("session_id") % 25).cast("int")
    new = c.filter("c_nationkey > 5").select("date", "session_id", F.array(x).alias("delete_frames"), x.alias("interp"), op.alias("op"))
    out, _ = S.session_edit_upsert(old, new)
    return out.select("session_id", F.concat_ws(",", F.col("delete_frames").cast("array<string>")).alias("delete_frames"), "interp")


@query("S22_file_evidence")
def s22(spark, sf):
    return S.file_evidence(spark, sf, "*.parquet")


@query("J22_collect_nested_fields", "SELECT n_regionkey AS g, n_name || '.' || c_mktsegment AS path, count(*) AS value FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2")
def j22(spark, sf):
    c = R.table(spark, sf, "customer").join(R.table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    a = c.groupBy("n_regionkey", "n_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    a = a.groupBy("n_regionkey", "n_name").agg(F.map_from_entries(F.collect_list(F.struct("c_mktsegment", "n"))).alias("m"))
    d = a.groupBy(F.col("n_regionkey").alias("g")).agg(F.map_from_entries(F.collect_list(F.struct("n_name", "m"))).alias("m"))
    return S.flatten_leaves(d, ["g"], "m", 2)


# ---- streams ----
def ev_stream(spark, sf):
    e = ST.read_table_stream(spark, sf, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), ((us - F.lit(R.EPOCH_US)) / F.lit(1e6)).alias("t"), "user_id", (F.col("user_id") % 8).cast("int").alias("session"), "event_type", "value")


def seconds(us):
    return R.rnd((F.col(us) - F.lit(R.EPOCH_US)) / F.lit(1e6))


@query("T01_stream_pulses", "SELECT session, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s FROM r_pul")
def t01(spark, sf):
    path = S.scratch(spark, "t01")
    e = ST.closed(ev_stream(spark, sf).select("session", "ts", "event_id", (F.col("value") > 40).alias("on")), path, "ts", "session")
    return ST.drain(ST.stream_pulses(e, "session", "ts", "on", place="event_id"), path, mode="append").select("session", seconds("start_us").alias("start_s"), seconds("end_us").alias("end_s"))


@query("T02_stream_tuning", "SELECT session, unit_id, bin, n_spikes, round(occ_s, 6) AS occ_s, round(rate_hz, 9) AS rate_hz FROM r_tc")
def t02(spark, sf):
    from .q_tuning import FS
    path, e = S.scratch(spark, "t02"), ev_stream(spark, sf)
    frames = e.filter("event_type = 'view'").select("session", "ts", ((F.col("value") * 7.2) % F.lit(360.0)).alias("angle"))
    spikes = e.filter(F.col("event_type").isin("click", "purchase", "error")).select("session", "ts", F.col("user_id").alias("unit"))
    frames, spikes = ST.closed(frames, f"{path}/f", "ts", "session"), ST.closed(spikes, f"{path}/s", "ts", "session")
    near = ST.drain(ST.stream_nearest(spikes, frames, "session", "ts", "unit", "angle", horizon_s=90 * 86400.0), f"{path}/near", mode="append")
    near.write.parquet(f"{path}/near.parquet")
    hit = spark.readStream.schema(near.schema).parquet(f"{path}/near.parquet")
    w = ST.drain(ST.stream_tuning(ST.closed(hit, f"{path}/h", "ts", "session"), frames, "session", "ts", "angle", 30, FS, window="1 day"), f"{path}/rate", mode="append")
    out = ST.rates(w, "session", 30)
    return out.select("session", F.col("unit").alias("unit_id"), "bin", "n_spikes", R.rnd("occ_s").alias("occ_s"), R.rnd("rate_hz", 9).alias("rate_hz"))


@query("T03_stream_trial_counts", "SELECT session, trial_id, count(*) AS n FROM r_hits GROUP BY 1, 2")
def t03(spark, sf):
    e = ev_stream(spark, sf)
    sp = e.filter(F.col("event_type").isin("click", "purchase", "error")).select("session", "event_id", "ts")
    tr = ev_stream(spark, sf).filter("event_type = 'signup'").select("session", F.col("event_id").alias("trial_id"), F.col("ts").alias("onset"))
    path = S.scratch(spark, "t03")
    sp, tr = ST.closed(sp, f"{path}/s", "ts", "session"), ST.closed(tr, f"{path}/r", "onset", "session")
    j = ST.stream_window_counts(sp, tr, ["session"], "trial_id", "ts", "onset", "'-3600' SECOND", "'14400' SECOND")
    return ST.drain(j, path, mode="append").groupBy("session", "trial_id").agg(F.sum("n").alias("n"))


@query("T04_stream_rate", "SELECT event_type, CAST(epoch_us(ts) // 86400000000 * 86400000000 AS BIGINT) AS start_us, count(*) AS n FROM events GROUP BY 1, 2")
def t04(spark, sf):
    s = ST.stream_rate(ev_stream(spark, sf), ["event_type"], "ts", "1 day")
    return ST.drain(s, S.scratch(spark, "t04"), mode="update", keys=["event_type", "start_us"])


@query("T04_stream_bursts", """WITH g AS (SELECT session, epoch_us(ts) AS us, sum(CASE WHEN p IS NULL OR epoch_us(ts) - p >= 600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY ts ROWS UNBOUNDED PRECEDING) AS b FROM (SELECT CAST(user_id % 8 AS INTEGER) AS session, ts, lag(epoch_us(ts)) OVER (PARTITION BY user_id % 8 ORDER BY ts) AS p FROM events))
  SELECT session, min(us) AS first_us, max(us) AS last_us, count(*) AS n FROM g GROUP BY session, b""")
def t04b(spark, sf):
    s = ST.stream_bursts(ev_stream(spark, sf), ["session"], "ts", "10 minutes", late="60 days")
    return ST.drain(s, S.scratch(spark, "t04b"), mode="complete")
