"""Interval and clock queries."""
from pyspark.sql import functions as F

from .registry import query, CTES
from . import roles as R
from ..operators import intervals as I, asof
from ..operators.ordered import sequence
from .q_tuning import WEEK

LEVELS = (3600.0, 28800.0)


@query("W17_merge_intervals", "SELECT session, epoch_id, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s FROM r_epochs")
def w17(spark, sf):
    return R.epochs(spark, sf).select("session", "epoch_id", R.rnd("start_s").alias("start_s"), R.rnd("end_s").alias("end_s"))


@query("J04_point_in_interval", """SELECT s.session, spike_id, epoch_id FROM r_spikes s LEFT JOIN r_epochs e ON e.session = s.session AND s.t >= e.start_s AND s.t < e.end_s""")
def j04(spark, sf):
    return asof.point_in_interval(R.spikes(spark, sf), R.epochs(spark, sf), ["session"], "t", id_col="epoch_id", width=WEEK).select("session", "spike_id", "epoch_id")


@query("F02_restrict_epochs", """SELECT s.session, unit_id, count(*) AS n FROM r_spikes s JOIN r_epochs e ON e.session = s.session AND s.t >= e.start_s AND s.t < e.end_s GROUP BY ALL""")
def f02(spark, sf):
    return I.restrict(R.spikes(spark, sf), R.epochs(spark, sf), ["session"], "t", id_col="epoch_id", width=WEEK).groupBy("session", "unit_id").agg(F.count(F.lit(1)).alias("n"))


CTES["r_second"] = "SELECT session, onset_s AS start_s, onset_s + CAST(7200 AS DOUBLE) AS end_s FROM r_trials"


@query("J05_interval_intersect", """SELECT a.session, round(greatest(a.start_s, b.start_s), 6) AS start_s, round(least(a.end_s, b.end_s), 6) AS end_s, count(*) AS n_samples
  FROM r_epochs a JOIN r_second b ON a.session = b.session AND greatest(a.start_s, b.start_s) < least(a.end_s, b.end_s)
  JOIN r_frames f ON f.session = a.session AND f.t BETWEEN greatest(a.start_s, b.start_s) AND least(a.end_s, b.end_s) GROUP BY 1, 2, 3""")
def j05(spark, sf):
    b = R.trials(spark, sf).select("session", F.col("onset_s").alias("start_s"), (F.col("onset_s") + 7200.0).alias("end_s"))
    x = I.intersect_intervals(R.epochs(spark, sf), b, ["session"], width=7200.0)
    k = I.keep_sampled(x, R.frames(spark, sf), ["session"], "t", widths=(7200.0,))
    return k.select("session", R.rnd("start_s").alias("start_s"), R.rnd("end_s").alias("end_s"), "n_samples")


@query("J06_stimulus_at_frame", """SELECT f.session, f.frame_id, CASE WHEN r.luminance = 1 THEN r.x_idx END AS x_idx FROM r_frames f ASOF LEFT JOIN r_trials r ON f.session = r.session AND f.t >= r.onset_s""")
def j06(spark, sf):
    h = asof.asof_backward(R.frames(spark, sf), R.trials(spark, sf), ["session"], "t", "onset_s", ["x_idx", "luminance"], width=WEEK)
    return h.select("session", "frame_id", F.when(F.col("luminance") == 1, F.col("x_idx")).alias("x_idx"))


@query("W16_epoch_clock", """WITH c AS (SELECT *, coalesce(sum(end_s - start_s) OVER (PARTITION BY session ORDER BY start_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c0 FROM r_epochs)
  SELECT s.session, spike_id, epoch_id, round(c0 + (s.t - start_s), 6) AS clock_t, round(s.t + 0.001, 6) AS back_t FROM r_spikes s JOIN c ON c.session = s.session AND s.t >= start_s AND s.t < end_s""")
def w16(spark, sf):
    e = R.epochs(spark, sf)
    f = I.to_epoch_clock(R.spikes(spark, sf), e, ["session"], "t", id_col="epoch_id", width=WEEK)
    f = f.select("session", "spike_id", "epoch_id", "clock_t", (F.col("clock_t") + 0.001).alias("probe_t"))
    b = I.from_epoch_clock(f, e, ["session"], "probe_t", width=WEEK)
    return b.select("session", "spike_id", "epoch_id", R.rnd("clock_t", 6).alias("clock_t"), R.rnd("t", 6).alias("back_t"))


@query("A61_interval_means", """WITH m AS (SELECT i.session, i.interval_type, i.interval_id, avg(f.hd) AS m FROM r_intervals i JOIN r_frames f ON f.session = i.session AND f.t BETWEEN i.start_s AND i.end_s GROUP BY ALL)
  SELECT session, interval_type, count(m) AS n_intervals, round(avg(m), 6) AS mean, round(CASE WHEN count(m) > 1 THEN stddev_pop(m) ELSE 0 END, 6) AS sd FROM m GROUP BY ALL""")
def a61(spark, sf):
    r = I.interval_means(R.frames(spark, sf), R.intervals(spark, sf), ["session"], "t", "hd", id_col="interval_id", phase="interval_type", widths=LEVELS)
    return r.select("session", "interval_type", "n_intervals", R.rnd("mean").alias("mean"), R.rnd("sd").alias("sd"))


@query("A62_event_counts_start", """SELECT i.session, i.interval_id, count(s.spike_id) AS n, round(count(s.spike_id) / any_value(i.end_s - i.start_s), 9) AS rate_hz
  FROM r_intervals i LEFT JOIN r_spikes s ON s.session = i.session AND s.t >= i.start_s AND s.t < i.end_s GROUP BY 1, 2""")
def a62(spark, sf):
    r = I.event_counts(R.spikes(spark, sf), R.intervals(spark, sf), ["session"], id_col="interval_id", ev_start="t", ev_end="t", mode="start", widths=LEVELS)
    return r.select("session", "interval_id", "n", R.rnd("rate_hz", 9).alias("rate_hz"))


@query("A62_event_counts_overlap", """SELECT i.session, i.interval_id, count(r.trial_id) AS n FROM r_intervals i LEFT JOIN r_trials r ON r.session = i.session
  AND r.onset_s < i.end_s AND r.onset_s + 1800 > i.start_s GROUP BY 1, 2""")
def a62b(spark, sf):
    ev = R.trials(spark, sf).withColumn("off", F.col("onset_s") + 1800.0)
    r = I.event_counts(ev, R.intervals(spark, sf), ["session"], id_col="interval_id", ev_start="onset_s", ev_end="off", mode="overlap", widths=(7200.0,))
    return r.select("session", "interval_id", "n")


@query("J17_split_by_session", """SELECT o_orderkey, n_name AS session_name, o_orderkey - f AS local_idx FROM orders JOIN (
  SELECT n_name, n_nationkey * 6000 AS f, n_nationkey * 6000 + 5500 AS l FROM nation) ON o_orderkey >= f AND o_orderkey < l""")
def j17(spark, sf):
    s = R.table(spark, sf, "nation").select(F.lit(0).alias("g"), F.col("n_name").alias("session_name"), (F.col("n_nationkey") * 6000).cast("long").alias("first_idx"),
                                            (F.col("n_nationkey") * 6000 + 5500).cast("long").alias("last_idx"))
    o = R.table(spark, sf, "orders").select(F.lit(0).alias("g"), "o_orderkey")
    return I.split_by_session(o, s, ["g"], "o_orderkey", width=2000.0).select("o_orderkey", "session_name", "local_idx")


@query("J18_sample_to_time", """SELECT l.l_orderkey, l_linenumber, epoch_us(o_orderdate) AS t, o_orderkey IS NULL AS out_of_range FROM lineitem l LEFT JOIN orders ON l_orderkey + 40 = o_orderkey""")
def j18(spark, sf):
    li = R.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    o = R.table(spark, sf, "orders").select("o_orderkey", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("t"))
    return li.join(o, F.col("l_orderkey") + 40 == F.col("o_orderkey"), "left").select("l_orderkey", "l_linenumber", "t", F.col("o_orderkey").isNull().alias("out_of_range"))


CTES["r_knots"] = """SELECT session, min(t) AS src, min(t) * CAST(1.0001 AS DOUBLE) + max(k) AS dst FROM r_ev WHERE event_type = 'view' GROUP BY session, floor(t / CAST(43200 AS DOUBLE))"""


@query("J19_clock_map", """WITH k AS (SELECT session, src, dst, lag(src) OVER w AS ls, lag(dst) OVER w AS ld, lead(src) OVER w AS rs, lead(dst) OVER w AS rd FROM r_knots WINDOW w AS (PARTITION BY session ORDER BY src)),
  g AS (SELECT session, src, CASE WHEN rs IS NULL THEN ls ELSE src END AS s0, CASE WHEN rs IS NULL THEN ld ELSE dst END AS d0, coalesce(rs, src) AS s1, coalesce(rd, dst) AS d1 FROM k),
  f AS (SELECT session, arg_min(struct_pack(s0, d0, s1, d1), src) AS first FROM g GROUP BY session)
  SELECT s.session, s.spike_id, round(coalesce(g.d0, first.d0) + (s.t - coalesce(g.s0, first.s0)) * (coalesce(g.d1, first.d1) - coalesce(g.d0, first.d0)) / (coalesce(g.s1, first.s1) - coalesce(g.s0, first.s0)), 4) AS mapped
  FROM r_spikes s ASOF LEFT JOIN g ON s.session = g.session AND s.t >= g.src JOIN f ON f.session = s.session""")
def j19(spark, sf):
    v = R.ev(spark, sf).filter("event_type = 'view'")
    kn = v.groupBy("session", F.floor(F.col("t") / 43200.0).alias("b")).agg(F.min("t").alias("src"), (F.min("t") * 1.0001 + F.max("k")).alias("dst"))
    m = asof.clock_map(R.spikes(spark, sf), kn, ["session"], "t", src="src", dst="dst", width=WEEK)
    return m.select("session", "spike_id", R.rnd("mapped", 4).alias("mapped"))


@query("J21_segment_pulses_by_cycle", """SELECT h.session, spike_id, anchor_t, label, row_number() OVER (PARTITION BY h.session, anchor_t ORDER BY t) AS pulse_no FROM (
  SELECT s.*, round(a.onset_s, 6) AS anchor_t, a.trial_id AS label FROM r_spikes s ASOF JOIN r_trials a ON a.session = s.session AND s.t >= a.onset_s) h""")
def j21(spark, sf):
    a = R.trials(spark, sf).select("session", F.col("onset_s").alias("anchor_t"), F.col("trial_id").alias("label"))
    r = I.segment_by_anchor(R.spikes(spark, sf), a, ["session"], "t", label="label", width=WEEK)
    return r.select("session", "spike_id", R.rnd("anchor_t").alias("anchor_t"), "label", F.col("pulse_no").cast("long").alias("pulse_no"))


@query("J23_window_around_index", """SELECT e.event_id, c.event_id AS center, e.event_id - c.event_id AS "offset", round(e.value, 4) AS value FROM events e JOIN events c
  ON c.event_type = 'signup' AND e.event_id BETWEEN c.event_id - 2 AND c.event_id + 2""")
def j23(spark, sf):
    e = R.table(spark, sf, "events")
    rows = e.select(F.lit(0).alias("g"), "event_id", R.rnd("value", 4).alias("value"))
    c = e.filter("event_type = 'signup'").select(F.lit(0).alias("g"), F.col("event_id").alias("center"))
    return I.window_around(rows, c, ["g"], "event_id", "center", 2).drop("g")


@query("J20_sync_streams", """WITH a AS (SELECT session, t AS ta, row_number() OVER (PARTITION BY session ORDER BY t) AS n FROM r_ev WHERE event_type = 'click'),
  b AS (SELECT session, t AS tb, row_number() OVER (PARTITION BY session ORDER BY t) AS n FROM r_ev WHERE event_type = 'error'),
  d AS (SELECT session, max(t) AS dur FROM r_ev GROUP BY session),
  o AS (SELECT session, coalesce(sum(dur) OVER (ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM d)
  SELECT session, n AS pair_no, round(ta + off, 6) AS t_a, round(tb + off, 6) AS t_b FROM a JOIN b USING (session, n) JOIN o USING (session)""")
def j20(spark, sf):
    from ..operators.signals import sync_streams
    e = R.ev(spark, sf)
    dur = e.groupBy("session").agg(F.max("t").alias("dur"))
    r = sync_streams(e.filter("event_type = 'click'"), e.filter("event_type = 'error'"), dur, "session", "t", width=WEEK)
    return r.select("session", "pair_no", R.rnd("t_a", 6).alias("t_a"), R.rnd("t_b", 6).alias("t_b"))
