"""Pulse, run, cycle and edit queries."""
from pyspark.sql import functions as F

from .registry import query, CTES
from . import roles as R
from ..operators import signals as S
from .q_tuning import WEEK

K = ["session"]
CTES["r_lev"] = "SELECT session, t, value, value > 40 AS st, lag(value > 40) OVER w AS pst, lead(value > 40) OVER w AS nst, lag(t) OVER w AS pt FROM r_ev WINDOW w AS (PARTITION BY session ORDER BY t)"
CTES["r_edge"] = "SELECT session, t, st AS rising FROM r_lev WHERE st <> pst"
CTES["r_pul"] = "SELECT session, t AS start_s, nt AS end_s FROM (SELECT *, lead(t) OVER (PARTITION BY session ORDER BY t) AS nt FROM r_edge) WHERE rising AND nt IS NOT NULL"


def edges(spark, sf):
    return S.threshold_edges(R.ev(spark, sf).select("session", "t", "value"), K, "t", F.col("value") > 40, width=WEEK)


def pul(spark, sf):
    return S.pulses(edges(spark, sf), K, "t", width=WEEK)


@query("W01_threshold_edges", "SELECT session, round(t, 6) AS t, rising FROM r_edge")
def w01(spark, sf):
    return edges(spark, sf).select("session", R.rnd("t").alias("t"), "rising")


@query("W01_pulse_midpoints", "SELECT session, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s, round((start_s + end_s) / 2 + 1e-7, 6) AS mid_s FROM r_pul")
def w01b(spark, sf):
    return pul(spark, sf).select("session", R.rnd("start_s").alias("start_s"), R.rnd("end_s").alias("end_s"), R.rnd(F.col("mid_s") + 1e-7).alias("mid_s"))


@query("W49_edge_select", "SELECT session, round(unnest([start_s, end_s]), 6) AS edge_s FROM r_pul")
def w49(spark, sf):
    return S.edge_select(pul(spark, sf), K, "both").select("session", R.rnd("edge_s").alias("edge_s"))


CTES["r_row"] = "SELECT session, value, t, value > 20 AS m, row_number() OVER (PARTITION BY session ORDER BY t) AS i FROM r_ev"


def rows(spark, sf):
    from ..operators.ordered import sequence
    e = R.ev(spark, sf).select("session", "t", "value", (F.col("value") > 20).alias("m"))
    return sequence(e, K, ["t"], width=WEEK, row_number="i").withColumn("i", F.col("i").cast("long"))


@query("W03_fill_short_gaps", """SELECT session, i, m OR coalesce(min(CASE WHEN m THEN i END) OVER (PARTITION BY session ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - max(CASE WHEN m THEN i END) OVER (PARTITION BY session ORDER BY i ROWS UNBOUNDED PRECEDING) - 1 <= 2, false) AS m FROM r_row""")
def w03(spark, sf):
    return S.fill_short_gaps(rows(spark, sf), K, "i", "m", 2, width=100.0).select("session", "i", "m")


@query("W04_threshold_periods", """WITH p AS (SELECT session, st, pt, t, sum(CASE WHEN st AND (pst IS NULL OR NOT pst) THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY t ROWS UNBOUNDED PRECEDING) AS r FROM r_lev),
  q AS (SELECT session, r, coalesce(arg_min(coalesce(pt, t), t), 0) AS s, max(t) AS e FROM p WHERE st GROUP BY 1, 2),
  b AS (SELECT *, sum(CASE WHEN pe IS NULL OR s - pe > 6000 THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY s ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, lag(e) OVER (PARTITION BY session ORDER BY s) AS pe FROM q))
  SELECT session, round(min(s), 6) AS start_s, round(max(e), 6) AS end_s FROM b GROUP BY session, g HAVING max(e) - min(s) >= 5000""")
def w04(spark, sf):
    e = R.ev(spark, sf).select("session", "t", "value")
    return S.threshold_periods(e, K, "t", F.col("value") > 40, min_s=5000.0, max_gap_s=6000.0, width=WEEK).select("session", R.rnd("start_s").alias("start_s"), R.rnd("end_s").alias("end_s"))


@query("W27_unwrap_phase", """WITH j AS (SELECT session, frame_id, t, radians(hd) AS ph, round((radians(hd) - lag(radians(hd)) OVER (PARTITION BY session ORDER BY t)) / (2 * pi())) AS k FROM r_frames)
  SELECT session, frame_id, round(ph - 2 * pi() * coalesce(sum(k) OVER (PARTITION BY session ORDER BY t ROWS UNBOUNDED PRECEDING), 0), 6) AS unwrapped_rad FROM j""")
def w27(spark, sf):
    f = R.frames(spark, sf).withColumn("ph", F.radians("hd"))
    return S.unwrap(f, K, "t", "ph", width=WEEK).select("session", "frame_id", R.rnd("unwrapped_rad").alias("unwrapped_rad"))


@query("W29_interp_missing", """WITH h AS (SELECT session, i, CASE WHEN value <= 80 THEN value END AS v FROM r_row), n AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN {'i': i, 'v': v} END IGNORE NULLS) OVER (PARTITION BY session ORDER BY i ROWS UNBOUNDED PRECEDING) AS a,
   first_value(CASE WHEN v IS NOT NULL THEN {'i': i, 'v': v} END IGNORE NULLS) OVER (PARTITION BY session ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM h)
  SELECT session, i, round(CASE WHEN a IS NULL THEN b.v WHEN b IS NULL OR a.i = b.i THEN a.v ELSE a.v + (i - a.i) / CAST(b.i - a.i AS DOUBLE) * (b.v - a.v) END, 6) AS value FROM n""")
def w29(spark, sf):
    r = rows(spark, sf).withColumn("value", F.when(F.col("value") <= 80, F.col("value")))
    return S.interp_missing(r, K, "i", "value", width=100.0).select("session", "i", R.rnd("value").alias("value"))


@query("W30_W31_apply_session_edit", """WITH d AS (SELECT session, value, row_number() OVER (PARTITION BY session ORDER BY i) - 1 AS i FROM r_row WHERE i - 1 NOT IN (2, 5, session)),
  e AS (SELECT session, max(value) FILTER (i = 10) AS v0, max(value) FILTER (i = 14 + session) AS v1 FROM d GROUP BY session)
  SELECT session, CASE WHEN i > 14 + session THEN i + 9 - (session + 5) ELSE i END AS i, round(value, 6) AS value FROM d WHERE i < 10 OR i > 14 + session
  UNION ALL SELECT session, 10 + k, round(v0 + k * (v1 - v0) / 8, 6) FROM e, (SELECT unnest(range(9)) AS k)""")
def w31(spark, sf):
    r = rows(spark, sf).withColumn("i", F.col("i") - 1)
    ed = r.select("session").distinct().select("session", F.array(F.lit(2), F.lit(5), F.col("session")).cast("array<bigint>").alias("delete_frames"),
                                               F.lit(10).alias("start"), (F.lit(14) + F.col("session")).alias("stop"), F.lit(9).alias("n"))
    return S.apply_session_edit(r, ed, K, "i", "value", width=100.0).select("session", "i", R.rnd("value").alias("value"))


# a train of edges that is regular for long stretches: distinct order days per priority
CTES["r_train"] = "SELECT session, sample_idx + CASE WHEN n >= 7 THEN CAST(0.3 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS t, CASE WHEN sample_idx % 2 = 0 THEN 1 ELSE -1 END AS dir FROM r_lfp"
CTES["r_iv"] = """SELECT session, t, dir, row_number() OVER w - 1 AS edge_idx, lead(t) OVER w - t AS iv, lead(dir) OVER w AS nd FROM r_train WINDOW w AS (PARTITION BY session ORDER BY t)"""
CTES["r_ivm"] = "SELECT i.*, md, abs(iv - md) <= 0.2 * md AS typ FROM r_iv i JOIN (SELECT session, quantile_cont(iv, 0.5) AS md FROM r_iv GROUP BY session) USING (session) WHERE iv IS NOT NULL"


def train(spark, sf):
    from ..operators.ordered import sequence
    l = R.lfp(spark, sf).select("session", (F.col("sample_idx") + F.when(F.col("n") >= 7, 0.3).otherwise(0.0)).alias("t"), F.when(F.col("sample_idx") % 2 == 0, 1).otherwise(-1).alias("dir"))
    l = sequence(l, K, ["t"], width=200.0, lead={"_nd": "dir"})
    return S.typical_intervals(l, K, "t", tolerance=0.2, width=200.0, gap_width=0.5)


@query("W32_periodic_block", """WITH g AS (SELECT session, edge_idx, typ, edge_idx - row_number() OVER (PARTITION BY session, typ ORDER BY edge_idx) AS r FROM r_ivm), q AS (SELECT session, min(edge_idx) AS a, max(edge_idx) AS b FROM g WHERE typ GROUP BY session, r HAVING count(*) >= 8)
  SELECT session, min(a) AS first_edge, max(b) + 1 AS last_edge FROM q GROUP BY session""")
def w32(spark, sf):
    return S.periodic_block(train(spark, sf), K, "t", 8, width=200.0)


@query("F18_trim_abnormal_ends", "SELECT session, min(edge_idx) FILTER (typ) AS first_edge, max(edge_idx) FILTER (typ) + 1 AS last_edge, max(edge_idx) + 1 AS n_last FROM r_ivm GROUP BY session")
def f18(spark, sf):
    return S.trim_abnormal_ends(train(spark, sf), K)


CTES["r_gap"] = """SELECT *, CAST(round_even(span / md, 0) AS BIGINT) AS expected FROM (SELECT session, min(edge_idx) AS left_edge, max(edge_idx) + 1 AS right_edge, sum(iv) AS span, count(*) AS observed, bool_or(iv < 0.8 * md) AS sh, bool_or(iv > 1.2 * md) AS lo, any_value(md) AS md,
    arg_min(dir, t) AS d0, arg_max(nd, t) AS d1 FROM (SELECT *, edge_idx - row_number() OVER (PARTITION BY session, typ ORDER BY edge_idx) AS r FROM r_ivm) WHERE NOT typ GROUP BY session, r)"""


def gaps(spark, sf):
    return S.gap_groups(train(spark, sf), K, "t", tolerance=0.2, phase_tol=0.31, width=200.0, direction="dir")


@query("W33_gap_groups", """SELECT session, left_edge, right_edge, round(span, 6) AS span_s, observed, expected, expected - observed AS change, expected > observed AND abs(span / md - expected) <= 0.31 AND sh AND lo AND d1 = CASE WHEN expected % 2 = 0 THEN d0 ELSE -d0 END AS candidate FROM r_gap""")
def w33(spark, sf):
    return gaps(spark, sf).select("session", "left_edge", "right_edge", R.rnd("span_s").alias("span_s"), "observed", "expected", "change", "candidate")


@query("W33_gap_repair")
def w33b(spark, sf):
    from ..session import cut_lineage
    g = cut_lineage(gaps(spark, sf))
    need = g.groupBy("session").agg(F.coalesce(F.sum(F.when(F.col("candidate"), F.col("change"))), F.lit(0)).alias("required"))
    return S.gap_repair_plan(g, need, K).select("session", "required", "n_plans", "status")


CTES["r_stage"] = """WITH p AS (SELECT session, CAST(floor(start_s) AS BIGINT) AS s, CAST(floor(end_s) AS BIGINT) + 1 AS e FROM r_pul), b AS (SELECT *, sum(CASE WHEN abs(s - lag_e - 3000) <= 2500 THEN 0 ELSE 1 END) OVER (PARTITION BY session ORDER BY s ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, lag(e) OVER (PARTITION BY session ORDER BY s) AS lag_e FROM p)),
  n AS (SELECT *, row_number() OVER (PARTITION BY session, run ORDER BY s) - 1 AS pos, count(*) OVER (PARTITION BY session, run) AS len FROM b)
  SELECT session, s, e, CAST(least(3, len - 3 * (pos // 3)) AS INTEGER) AS stage FROM n"""


def stages(spark, sf):
    p = pul(spark, sf).select("session", F.floor("start_s").alias("s"), (F.floor("end_s") + 1).alias("e"))
    return S.classify_pulse_groups(p, K, gap=3000, tolerance=2500, width=WEEK, start="s", end="e")


@query("W34_classify_pulse_groups", "SELECT session, s, e, stage FROM r_stage")
def w34(spark, sf):
    return stages(spark, sf).select("session", "s", "e", "stage")


@query("W35_stage_intervals", """WITH b AS (SELECT *, sum(CASE WHEN stage = ps THEN 0 ELSE 1 END) OVER (PARTITION BY session ORDER BY s ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, lag(stage) OVER (PARTITION BY session ORDER BY s) AS ps FROM r_stage)),
  r AS (SELECT session, g, any_value(stage) AS stage, min(s) AS start, max(e) AS e FROM b GROUP BY session, g), q AS (SELECT *, lead(start) OVER w AS ns, lag(g) OVER w AS pg FROM r WINDOW w AS (PARTITION BY session ORDER BY g))
  SELECT session, stage, start, coalesce(ns - 1, e) AS stop FROM q UNION ALL SELECT session, CASE WHEN stage > 1 THEN stage - 1 ELSE 3 END, CAST(0 AS BIGINT), start - 1 FROM q WHERE pg IS NULL AND start > 0
  UNION ALL SELECT session, stage, e + 1, CAST(2592000 AS BIGINT) FROM q WHERE ns IS NULL AND e < 2592000""")
def w35(spark, sf):
    st = stages(spark, sf)
    rec = st.select("session").distinct().select("session", F.lit(0).cast("long").alias("rec_start"), F.lit(2592000).cast("long").alias("rec_end"))
    return S.stage_intervals(st, K, rec=rec, width=WEEK, start="s", end="e")


CTES["r_dur"] = "SELECT session, round(start_s, 6) AS start_s, end_s - start_s AS d FROM r_pul"


def durs(spark, sf):
    return pul(spark, sf).select("session", "start_s", (F.col("end_s") - F.col("start_s")).alias("d"))


@query("W36_classify_ttl_durations", """WITH s AS (SELECT *, row_number() OVER w AS n, lead(d) OVER w AS d1, lead(d, 2) OVER w AS d2 FROM r_dur WINDOW w AS (PARTITION BY session ORDER BY start_s)), t AS (SELECT *, NOT (n = 1 AND d < 1000) AND coalesce(d < 2000 AND d1 >= 2000 AND d1 < 5000 AND d2 >= 5000, false) AS tr FROM s),
  u AS (SELECT *, coalesce(lag(tr) OVER w, false) OR coalesce(lag(tr, 2) OVER w, false) AS inner_ FROM t WINDOW w AS (PARTITION BY session ORDER BY start_s))
  SELECT session, start_s, CASE WHEN n = 1 AND d < 1000 THEN 'start_indicator' WHEN tr THEN 'triplet' WHEN d > 9000 THEN 'broadlet' ELSE 'singlet' END AS kind FROM u WHERE NOT inner_""")
def w36(spark, sf):
    return S.classify_durations(durs(spark, sf), K, "start_s", "d", short=2000, medium=5000, long=9000, start_max=1000, width=WEEK).select("session", R.rnd("start_s").alias("start_s"), "kind")


@query("W37_duration_classes", "SELECT session, CASE WHEN d < 2000 THEN 'short' WHEN d < 5000 THEN 'medium' ELSE 'long' END AS duration_class, count(*) AS n FROM r_dur GROUP BY 1, 2")
def w37(spark, sf):
    return S.duration_classes(durs(spark, sf), "d", 2000, 5000).groupBy("session", "duration_class").agg(F.count(F.lit(1)).alias("n"))


@query("W38_burst_edges", """WITH f AS (SELECT session, t, lead(t) OVER w - t < 1500 AS c FROM r_ev WINDOW w AS (PARTITION BY session ORDER BY t)), g AS (SELECT *, lag(c) OVER (PARTITION BY session ORDER BY t) AS p FROM f WHERE c IS NOT NULL)
  SELECT session, round(t, 6) AS t, c AS close FROM g WHERE p IS NULL OR c <> p""")
def w38(spark, sf):
    return S.burst_edges(R.ev(spark, sf).select("session", "t"), K, "t", 1500.0, width=WEEK).select("session", R.rnd("t").alias("t"), "close")


@query("W39_combine_close_events", """WITH e AS (SELECT *, lead(start_s) OVER w AS ns, lead(end_s) OVER w AS ne FROM r_pul WINDOW w AS (PARTITION BY session ORDER BY start_s)), m AS (SELECT e.session, e.start_s, min(v.value) AS lo FROM e JOIN r_ev v ON v.session = e.session AND v.t BETWEEN e.end_s AND e.ns GROUP BY 1, 2)
  SELECT e.session, round(e.start_s, 6) AS start_s, round(CASE WHEN ns - e.end_s <= 3000 AND lo <= 10 THEN ne ELSE e.end_s END, 6) AS end_s, coalesce(ns - e.end_s <= 3000 AND lo <= 10, false) AS combined FROM e LEFT JOIN m ON m.session = e.session AND m.start_s = e.start_s WHERE ns IS NOT NULL""")
def w39(spark, sf):
    from ..session import cut_lineage
    p = cut_lineage(pul(spark, sf))
    c = S.combine_close_events(p, R.ev(spark, sf), K, max_gap=3000.0, trough=10.0, t="t", value="value", widths=(7200.0, 86400.0), width=WEEK)
    return c.select("session", R.rnd("start_s").alias("start_s"), R.rnd("end_s").alias("end_s"), "combined")


@query("W40_distribute_plateau", """WITH v AS (SELECT session, i, floor(value / 25) AS v FROM r_row), r AS (SELECT *, sum(CASE WHEN v = pv THEN 0 ELSE 1 END) OVER (PARTITION BY session ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, lag(v) OVER (PARTITION BY session ORDER BY i) AS pv FROM v)),
  s AS (SELECT session, g, count(*) AS len, min(i) AS i0, any_value(v) AS v0 FROM r GROUP BY 1, 2), n AS (SELECT *, lead(v0) OVER (PARTITION BY session ORDER BY g) AS nv FROM s)
  SELECT session, i, CAST(CASE WHEN len > 1 AND nv IS NOT NULL THEN floor(v + (i - i0) * (nv - v) / (len - 1)) ELSE v END AS DOUBLE) AS value FROM r JOIN n USING (session, g)""")
def w40(spark, sf):
    r = rows(spark, sf).select("session", "i", F.floor(F.col("value") / 25).cast("double").alias("value"))
    return S.distribute_plateau(r, K, "i", "value", width=100.0)


@query("W41_cycle_ranges", """SELECT session, luminance, trial_id, CAST(round(onset_s) AS BIGINT) AS start, coalesce(lead(CAST(round(onset_s) AS BIGINT)) OVER (PARTITION BY session, luminance ORDER BY CAST(round(onset_s) AS BIGINT)) - 1, 2600000) AS stop FROM r_trials""")
def w41(spark, sf):
    t = R.trials(spark, sf).select("session", "luminance", "trial_id", F.round("onset_s").cast("long").alias("start"), F.lit(2600000).cast("long").alias("rec"))
    return S.cycle_ranges(t, K, "start", rec_end="rec", width=WEEK, sub=["luminance"], ties=["trial_id"]).select("session", "luminance", "trial_id", "start", "stop")


RULES = [("combo", 1000.0, 2000.0), ("hold", 2500.0, 4500.0), ("baseline", 20000.0, 40000.0)]
CTES["r_raw"] = """SELECT session, t AS start_s, n AS end_s, n - t AS duration_s, CASE WHEN n - t BETWEEN 1000 AND 2000 THEN 'combo' WHEN n - t BETWEEN 2500 AND 4500 THEN 'hold' WHEN n - t BETWEEN 20000 AND 40000 THEN 'baseline' ELSE 'other' END AS interval_type
  FROM (SELECT session, onset_s AS t, lead(onset_s) OVER (PARTITION BY session ORDER BY onset_s) AS n FROM r_trials) WHERE n - t >= 500"""


def raws(spark, sf):
    return S.raw_intervals(R.trials(spark, sf), K, "onset_s", min_s=500.0, rules=RULES, width=WEEK)


@query("W42_raw_intervals", "SELECT session, round(start_s, 6) AS start_s, round(duration_s, 6) AS duration_s, interval_type FROM r_raw")
def w42(spark, sf):
    return raws(spark, sf).select("session", R.rnd("start_s").alias("start_s"), R.rnd("duration_s").alias("duration_s"), "interval_type")


@query("W43_protocol_match", """WITH e AS (SELECT CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS INTEGER) AS position, CAST(p_size * 400 AS DOUBLE) AS es, CASE p_size % 3 WHEN 0 THEN 'combo' WHEN 1 THEN 'hold' ELSE 'baseline' END AS label FROM part WHERE p_type = 'ECONOMY' AND p_brand = 'Brand#1'),
  o AS (SELECT *, CAST(row_number() OVER (PARTITION BY session ORDER BY start_s) AS INTEGER) AS i FROM r_raw),
  f(session, i, nxt, start_s, position, label) AS (SELECT DISTINCT session, 0, 0, CAST(0 AS DOUBLE), CAST(NULL AS INTEGER), CAST(NULL AS VARCHAR) FROM o UNION ALL
   SELECT o.session, o.i, coalesce(c.position + 1, f.nxt), o.start_s, c.position, c.label FROM f JOIN o ON o.session = f.session AND o.i = f.i + 1 LEFT JOIN LATERAL (SELECT position, label FROM e WHERE e.position >= f.nxt AND abs(o.duration_s - es) / es * 100 <= 5
     ORDER BY CASE WHEN label = o.interval_type AND o.interval_type <> 'other' THEN 0 ELSE 1 END, position LIMIT 1) c ON true)
  SELECT session, round(start_s, 6) AS start_s, position, label FROM f WHERE i > 0""")
def w43(spark, sf):
    from ..operators.ordered import sequence
    p = R.table(spark, sf, "part").filter("p_type = 'ECONOMY' AND p_brand = 'Brand#1'")
    p = sequence(p.select(F.lit(0).alias("g"), "p_partkey", "p_size"), ["g"], ["p_partkey"], width=1000.0, row_number="r")
    o = raws(spark, sf)
    lab = F.when(F.col("p_size") % 3 == 0, "combo").when(F.col("p_size") % 3 == 1, "hold").otherwise("baseline")
    e = p.select((F.col("r") - 1).cast("int").alias("position"), (F.col("p_size") * 400).cast("double").alias("expected_s"), lab.alias("label"),
                 F.explode(F.sequence(F.lit(0), F.lit(7))).alias("session"))
    return S.protocol_match(o, e, K).select("session", R.rnd("start_s").alias("start_s"), "position", "label")


@query("A81_threshold_curve", "SELECT session, CAST(th AS DOUBLE) AS threshold, round(avg(CASE WHEN value > th THEN CAST(100 AS DOUBLE) ELSE 0 END), 6) AS pct FROM r_ev, (SELECT unnest(range(0, 200, 5)) AS th) GROUP BY 1, 2")
def a81(spark, sf):
    return S.threshold_curve(R.ev(spark, sf), K, "value", [float(x) for x in range(0, 200, 5)]).withColumn("pct", R.rnd("pct"))
