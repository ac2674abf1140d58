"""Correlogram, spectrum, phase, waveform and kernel-regression queries."""
from pyspark.sql import functions as F

from .registry import query, CTES
from . import roles as R
from ..operators import spectral as S, waveforms as Wf, kernels as KR, signals as SG
from ..session import cut_lineage
from .q_tuning import WEEK
from .q_pairs import pairs

K = ["session", "unit_id"]
CTES["r_acg"] = """SELECT a.session, a.unit_id, CAST(floor((b.t - a.t) / 3600 + 0.5) AS INTEGER) AS lag, count(*) * CASE WHEN floor((b.t - a.t) / 3600 + 0.5) = 0 THEN 2 ELSE 1 END AS n FROM r_spikes a JOIN r_spikes b ON a.session = b.session AND a.unit_id = b.unit_id AND a.spike_id <> b.spike_id
  AND b.t >= a.t AND b.t - a.t <= 86400 GROUP BY a.session, a.unit_id, floor((b.t - a.t) / 3600 + 0.5)"""


def half(spark, sf):
    return S.acg(R.spikes(spark, sf), K, "t", bin_s=3600.0, max_lag_s=86400.0)


@query("A55_J14_acg", "SELECT session, unit_id, lag, n FROM r_acg UNION ALL SELECT session, unit_id, -lag, n FROM r_acg WHERE lag > 0")
def a55(spark, sf):
    return S.symmetric(half(spark, sf)).select(*K, "lag", "n")


CTES["r_tied"] = "SELECT l_suppkey AS unit_id, date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS d, l_orderkey, l_linenumber, row_number() OVER () AS i FROM lineitem"


@query("A55_acg_tied_times", """WITH m AS (SELECT unit_id, d, count(*) AS m FROM r_tied GROUP BY 1, 2)
  SELECT a.unit_id, CAST(b.d - a.d AS INTEGER) AS lag, CAST(sum(CASE WHEN a.d = b.d THEN a.m * (a.m - 1) ELSE a.m * b.m END) AS BIGINT) AS n FROM m a JOIN m b ON a.unit_id = b.unit_id AND b.d - a.d BETWEEN 0 AND 20 GROUP BY 1, 2 HAVING n > 0""")
def a55t(spark, sf):
    d = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("double")
    li = R.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("unit_id"), d.alias("t"))
    return S.acg(li, ["unit_id"], "t", bin_s=1.0, max_lag_s=20.0)


CTES["r_spec"] = """SELECT session, unit_id, CAST(k AS INTEGER) AS k, sqrt(sum(n * cos(2 * pi() * k * lag / 49)) ** 2 + sum(n * sin(2 * pi() * k * lag / 49)) ** 2) AS s FROM (SELECT session, unit_id, lag, n FROM r_acg UNION ALL SELECT session, unit_id, -lag, n FROM r_acg WHERE lag > 0), (SELECT unnest(range(25)) AS k) GROUP BY 1, 2, 3"""


@query("A56_spectrum", "SELECT session, unit_id, k, round(s, 6) AS spectrum FROM r_spec")
def a56(spark, sf):
    return S.correlogram_spectrum(half(spark, sf), K, radius=24).select(*K, "k", R.rnd("spectrum").alias("spectrum"))


DF = 1.0 / (49 * 3600.0)


@query("A57_A58_theta_rhythmicity", f"""WITH f AS (SELECT *, k * CAST({DF!r} AS DOUBLE) AS f FROM r_spec), p AS (SELECT session, unit_id, arg_min(f, (-round(s, 9), k)) AS pf FROM f WHERE f BETWEEN 0.00002 AND 0.00006 GROUP BY 1, 2)
  SELECT f.session, f.unit_id, round(any_value(pf), 9) AS peak_f, round(avg(s) FILTER (abs(f - pf) <= 0.00001) / avg(s) FILTER (f BETWEEN 0 AND 0.0001), 6) AS index FROM f JOIN p ON p.session = f.session AND p.unit_id = f.unit_id GROUP BY 1, 2""")
def a58(spark, sf):
    spec = S.correlogram_spectrum(half(spark, sf), K, radius=24).withColumn("spectrum", F.round("spectrum", 9))
    s = S.spectral_index(spec, K, df=DF, band=(0.00002, 0.00006), half_width=0.00001, references=[(0.0, 0.0001)])
    return s.select(*K, R.rnd("peak_f", 9).alias("peak_f"), R.rnd("index").alias("index"))


# ---- regular trace: daily totals per priority ----
def lfp(spark, sf):
    return R.lfp(spark, sf).select("session", "sample_idx", "uv")


NW = 32
CTES["r_blk"] = "SELECT session, block, i, uv - avg(uv) OVER (PARTITION BY session, block) AS v FROM (SELECT session, sample_idx // 32 AS block, sample_idx % 32 AS i, uv, count(*) OVER (PARTITION BY session, sample_idx // 32) AS c FROM r_lfp) WHERE c = 32"
CTES["r_psd"] = """SELECT session, CAST(k AS INTEGER) AS k, avg(p) AS psd, count(*) AS n_blocks FROM (SELECT session, block, k, (sum(v * h * cos(2 * pi() * k * i / 32)) ** 2 + sum(v * h * sin(2 * pi() * k * i / 32)) ** 2) / 12 * CASE WHEN k IN (0, 16) THEN 1 ELSE 2 END AS p
   FROM (SELECT *, 0.5 - 0.5 * cos(2 * pi() * i / 32) AS h FROM r_blk), (SELECT unnest(range(17)) AS k) GROUP BY 1, 2, 3) GROUP BY 1, 2"""


def psd(spark, sf):
    return S.welch_psd(lfp(spark, sf), ["session"], "sample_idx", "uv", nwin=NW, fs=1.0)


@query("A60_welch_psd", "SELECT session, k, round(psd, 3) AS psd, n_blocks FROM r_psd")
def a60(spark, sf):
    return psd(spark, sf).select("session", "k", R.rnd("psd", 3).alias("psd"), "n_blocks")


@query("A60_band_power_fraction", """SELECT session, round((sum(psd) FILTER (k BETWEEN 4 AND 8) - (any_value(psd) FILTER (k = 4) + any_value(psd) FILTER (k = 8)) / 2) / (sum(psd) FILTER (k BETWEEN 1 AND 16) - (any_value(psd) FILTER (k = 1) + any_value(psd) FILTER (k = 16)) / 2), 6) AS fraction FROM r_psd GROUP BY 1""")
def a60b(spark, sf):
    return S.band_power_fraction(psd(spark, sf), ["session"], (4 / 32, 8 / 32), (1 / 32, 16 / 32), 1 / 32).withColumn("fraction", R.rnd("fraction"))


HALF = 8
RE, IM = S.analytic_kernel(1.0, 0.1, 0.2, HALF)
LP = S.lowpass_kernel(1.0, 0.4 / 3, HALF)
CTES["r_lrun"] = "SELECT *, sum(b) OVER (PARTITION BY session ORDER BY sample_idx ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT session, sample_idx, uv, CASE WHEN sample_idx - lag(sample_idx) OVER (PARTITION BY session ORDER BY sample_idx) = 1 THEN 0 ELSE 1 END AS b FROM r_lfp)"
CTES["r_ker"] = "SELECT unnest(range(-8, 9)) AS o, unnest([" + ", ".join(f"CAST({x!r} AS DOUBLE)" for x in RE) + "]) AS re, unnest([" + ", ".join(f"CAST({x!r} AS DOUBLE)" for x in IM) + "]) AS im, unnest([" + ", ".join(f"CAST({x!r} AS DOUBLE)" for x in LP) + "]) AS lp"
CTES["r_ph"] = "SELECT a.session, a.sample_idx, any_value(a.run) AS run, atan2(sum(b.uv * im), sum(b.uv * re)) AS ph, sqrt(sum(b.uv * im) ** 2 + sum(b.uv * re) ** 2) AS amp FROM r_lrun a JOIN r_ker ON true JOIN r_lrun b ON b.session = a.session AND b.run = a.run AND b.sample_idx = a.sample_idx - o GROUP BY 1, 2 HAVING count(*) = 17"


def phase(spark, sf):
    return S.band_phase(lfp(spark, sf), ["session"], "sample_idx", "uv", fs=1.0, band=(0.1, 0.2), half=HALF, bucket=256)


@query("G25_fir_bandpass_phase", "SELECT session, sample_idx, round(ph, 5) AS phase_rad, round(amp, 3) AS amplitude FROM r_ph")
def g25(spark, sf):
    return phase(spark, sf).filter("segment_id IS NOT NULL").select("session", "sample_idx", R.rnd("phase_rad", 5).alias("phase_rad"), R.rnd("amplitude", 3).alias("amplitude"))


@query("G26_fir_decimate", "SELECT a.session, CAST(a.sample_idx / 3 AS BIGINT) AS sample_idx, round(sum(b.uv * lp), 4) AS uv FROM r_lfp a JOIN r_ker ON true JOIN r_lfp b ON b.session = a.session AND b.sample_idx = a.sample_idx - o WHERE a.sample_idx % 3 = 0 GROUP BY 1, 2 HAVING count(*) = 17")
def g26(spark, sf):
    return S.fir_decimate(lfp(spark, sf), ["session"], "sample_idx", "uv", 3, half=HALF, bucket=256).withColumn("uv", R.rnd("uv", 4))


CTES["r_unw"] = """SELECT session, sample_idx, run, ph - 2 * pi() * coalesce(sum(k) OVER (PARTITION BY session, run ORDER BY sample_idx ROWS UNBOUNDED PRECEDING), 0) AS u FROM (SELECT *, round((ph - lag(ph) OVER (PARTITION BY session, run ORDER BY sample_idx)) / (2 * pi())) AS k FROM r_ph)"""
CTES["r_osp"] = "SELECT o_orderpriority AS session, o_custkey AS unit_id, o_orderkey AS spike_id, (date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) + (o_orderkey % 97) / CAST(97 AS DOUBLE)) / 3 AS t FROM orders"
CTES["r_sph"] = """SELECT s.session, s.unit_id, s.spike_id, s.t, a.run, CASE WHEN s.t = a.sample_idx THEN a.u WHEN b.sample_idx IS NOT NULL AND a.run = b.run THEN a.u + (s.t - a.sample_idx) * (b.u - a.u) / (b.sample_idx - a.sample_idx) END AS u FROM r_osp s
  LEFT JOIN r_unw a ON a.session = s.session AND a.sample_idx = floor(s.t) LEFT JOIN r_unw b ON b.session = s.session AND b.sample_idx = floor(s.t) + 1"""


def osp(spark, sf):
    d = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date"))
    return R.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("session"), F.col("o_custkey").alias("unit_id"), F.col("o_orderkey").alias("spike_id"), ((d + (F.col("o_orderkey") % 97) / 97.0) / 3).alias("t"))


def unwrapped(spark, sf):
    p = cut_lineage(phase(spark, sf).filter("segment_id IS NOT NULL"))
    return cut_lineage(SG.unwrap(p, ["session", "segment_id"], "sample_idx", "phase_rad", width=256.0))


def sampled(spark, sf):
    return S.sample_phase(osp(spark, sf), unwrapped(spark, sf).withColumn("pt", F.col("sample_idx").cast("double")), ["session"], "t", "pt", width=256.0)


@query("G27_sample_phase", "SELECT session, spike_id, round(u, 4) AS unwrapped_rad FROM r_sph")
def g27(spark, sf):
    return sampled(spark, sf).select("session", "spike_id", R.rnd("unwrapped_rad", 4).alias("unwrapped_rad"))


@query("A54_phase_locking", """WITH p AS (SELECT session, unit_id % 40 AS unit_id, u FROM r_sph), g AS (SELECT session, unit_id, count(u) AS n, count(*) FILTER (u IS NULL) AS n_excluded, sqrt(avg(cos(u)) ** 2 + avg(sin(u)) ** 2) AS r FROM p GROUP BY 1, 2)
  SELECT session, unit_id, n, n_excluded, round(r, 5) AS mvl, round(CASE WHEN n > 1 THEN (n * r * r - 1) / (n - 1) END, 5) AS ppc, round(CASE WHEN n >= 1 THEN least(exp(sqrt(1::DOUBLE + 4.0 * n + 4.0 * (n * n - (n * r) ** 2)) - (1 + 2 * n)), 1) END, 4) AS p FROM g""")
def a54(spark, sf):
    l = S.phase_locking(sampled(spark, sf).withColumn("unit_id", F.col("unit_id") % 40), K)
    return l.select(*K, "n", "n_excluded", R.rnd("mvl", 5).alias("mvl"), R.rnd("ppc", 5).alias("ppc"), R.rnd("p", 4).alias("p"))


@query("A53_phase_histogram", """WITH w AS (SELECT session, CAST(floor((((u + v) / 2 + pi()) - 2 * pi() * floor(((u + v) / 2 + pi()) / (2 * pi()))) / (2 * pi() / 18)) AS INTEGER) AS bin, d FROM (SELECT session, u, lead(u) OVER x AS v, lead(sample_idx) OVER x - sample_idx AS d FROM r_unw WINDOW x AS (PARTITION BY session, run ORDER BY sample_idx)) WHERE v IS NOT NULL),
  o AS (SELECT session, bin, CAST(sum(d) AS DOUBLE) AS occ FROM w GROUP BY 1, 2), c AS (SELECT session, unit_id % 40 AS unit_id, CAST(floor(((u + pi()) - 2 * pi() * floor((u + pi()) / (2 * pi()))) / (2 * pi() / 18)) AS INTEGER) AS bin, count(*) AS n FROM r_sph WHERE u IS NOT NULL GROUP BY 1, 2, 3)
  SELECT u.session, u.unit_id, CAST(b AS INTEGER) AS bin, coalesce(c.n, 0) AS n_spikes, o.occ AS occ_s, round(coalesce(c.n, 0) / o.occ, 6) AS rate_hz FROM (SELECT DISTINCT session, unit_id FROM c) u CROSS JOIN (SELECT unnest(range(18)) AS b) LEFT JOIN c ON c.session = u.session AND c.unit_id = u.unit_id AND c.bin = b LEFT JOIN o ON o.session = u.session AND o.bin = b""")
def a53(spark, sf):
    u = unwrapped(spark, sf).withColumn("pt", F.col("sample_idx").cast("double"))
    s = S.sample_phase(osp(spark, sf), u, ["session"], "t", "pt", width=256.0).withColumn("unit_id", F.col("unit_id") % 40)
    h = S.phase_histogram(s, S.phase_exposure(u, ["session"], "pt", 18, width=256.0), ["session"], ["unit_id"], 18)
    return h.select(*K, "bin", "n_spikes", "occ_s", R.rnd("rate_hz").alias("rate_hz"))


def cycles(spark, sf):
    s = sampled(spark, sf).filter("unwrapped_rad IS NOT NULL")
    return s.withColumn("unit_id", F.col("unit_id") % 40).withColumn("cyc", F.col("unwrapped_rad") / 6.283185307179586)


def precession(df):
    return S.phase_precession(df, ["session", "unit_id", "segment_id"], K, "cyc", bin_c=0.1, max_lag_c=4.0, half_width=0.05, n_fft=256)


@query("A59_phase_precession")
def a59(spark, sf):
    return precession(cut_lineage(cycles(spark, sf))).select(*K, R.rnd("peak_f").alias("peak_f"), R.rnd("index").alias("index"), "peak_count", "eligible", "candidate")


@query("G28_analyze_theta")
def g28(spark, sf):
    s = cut_lineage(sampled(spark, sf).withColumn("unit_id", F.col("unit_id") % 40).withColumn("cyc", F.col("unwrapped_rad") / 6.283185307179586))
    rh = S.rhythmicity(s, K, K, "t", bin_s=1.0, max_lag_s=20.0, band=(0.1, 0.2), half_width=0.03, reference=(0.0, 0.5), threshold=1.5)
    out = S.analyze_theta(S.phase_locking(s, K), rh, precession(s.filter("cyc IS NOT NULL")), K, min_spikes=20)
    return out.select(*K, "n_spikes", R.rnd("mvl").alias("mvl"), R.rnd("q").alias("q"), R.rnd("index").alias("rhythm_index"), "rhythmic", "candidate", "status")


# ---- positions, amplitudes, templates ----
@query("A63_position_stats", """WITH s AS (SELECT l_suppkey AS unit_id, l_linenumber AS shank, l_quantity AS y FROM lineitem), m AS (SELECT unit_id, quantile_cont(y, 0.5) AS md, quantile_cont(y, 0.75) - quantile_cont(y, 0.25) AS iqr, count(*) AS n FROM s GROUP BY 1)
  SELECT s.unit_id, (SELECT arg_min(shank, (-c, shank)) FROM (SELECT shank, count(*) AS c FROM s s2 WHERE s2.unit_id = s.unit_id GROUP BY 1)) AS shank, any_value(n) AS n_spikes, any_value(md) AS y_median, quantile_cont(abs(y - md), 0.5) AS y_mad, any_value(iqr) AS y_iqr FROM s JOIN m ON m.unit_id = s.unit_id GROUP BY 1""")
def a63(spark, sf):
    li = R.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("unit_id"), F.col("l_linenumber").alias("shank"), F.col("l_quantity").alias("y"))
    return Wf.position_stats(li, ["unit_id"], "shank", ["y"], width=8.0)


CTES["r_tpl"] = "SELECT vec_id, label, CAST(i // 8 AS INTEGER) AS channel, CAST(i % 8 AS INTEGER) AS s, CAST(v AS DOUBLE) AS v FROM (SELECT vec_id, label, unnest(range(64)) AS i, unnest(embedding) AS v FROM embeddings)"


def tpl(spark, sf):
    e = R.table(spark, sf, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "v"))
    return e.select("vec_id", "label", F.floor(F.col("i") / 8).cast("int").alias("channel"), (F.col("i") % 8).cast("int").alias("s"), F.col("v").cast("double").alias("v"))


@query("A64_amplitude_stats", "WITH n AS (SELECT vec_id, label, sqrt(sum(v * v)) AS a FROM r_tpl GROUP BY 1, 2), m AS (SELECT label, quantile_cont(a, 0.5) AS md, quantile_cont(a, 0.75) - quantile_cont(a, 0.25) AS iqr FROM n GROUP BY 1) SELECT n.label, round(any_value(md), 6) AS median, round(quantile_cont(abs(a - md), 0.5), 6) AS mad, round(any_value(iqr), 6) AS iqr FROM n JOIN m ON m.label = n.label GROUP BY 1")
def a64(spark, sf):
    n = cut_lineage(tpl(spark, sf).groupBy("vec_id", "label").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("a")))
    return Wf.robust_stats(n, ["label"], "a", width=0.05).select("label", *[R.rnd(c).alias(c) for c in ("median", "mad", "iqr")])


CTES["r_ptp"] = "SELECT vec_id, channel, max(v) - min(v) AS ptp FROM r_tpl GROUP BY 1, 2"


@query("A65_template_ptp", "SELECT vec_id, arg_min(channel, (-ptp, channel)) AS best_channel, round(max(ptp), 6) AS ptp FROM r_ptp GROUP BY 1")
def a65(spark, sf):
    return Wf.best_channel(Wf.template_ptp(tpl(spark, sf), ["vec_id"], "channel", "v"), ["vec_id"], "channel").withColumn("ptp", R.rnd("ptp"))


CTES["r_mix"] = "SELECT CAST(p_size % 8 AS INTEGER) AS channel, CAST(p_partkey % 8 AS INTEGER) AS out_channel, avg(p_retailprice) / 1000 AS w FROM part GROUP BY 1, 2"


def mixing(spark, sf):
    p = R.table(spark, sf, "part")
    return p.groupBy((F.col("p_size") % 8).cast("int").alias("channel"), (F.col("p_partkey") % 8).cast("int").alias("out_channel")).agg((F.avg("p_retailprice") / 1000).alias("w"))


@query("A66_unwhiten_templates", "SELECT vec_id, s, out_channel, round(sum(w * v), 6) AS v FROM r_tpl JOIN r_mix USING (channel) GROUP BY 1, 2, 3")
def a66(spark, sf):
    return Wf.unwhiten(tpl(spark, sf), mixing(spark, sf), ["vec_id"], "s").withColumn("v", R.rnd("v"))


CTES["r_contact"] = "SELECT CAST(p_size % 8 AS INTEGER) AS channel, avg(p_partkey % 100) AS x, avg(p_retailprice) / 10 AS y FROM part GROUP BY 1"


@query("A67_unit_center_of_mass", """WITH b AS (SELECT vec_id, arg_min(channel, (-ptp, channel)) AS bc FROM r_ptp GROUP BY 1) SELECT p.vec_id, round(sum(ptp * c.x) / sum(ptp), 5) AS x_um, round(sum(ptp * c.y) / sum(ptp), 5) AS y_um, count(*) AS n_contacts
  FROM r_ptp p JOIN r_contact c ON c.channel = p.channel JOIN b ON b.vec_id = p.vec_id JOIN r_contact q ON q.channel = bc WHERE sqrt((c.x - q.x) ** 2 + (c.y - q.y) ** 2) <= 3 GROUP BY 1""")
def a67(spark, sf):
    p = R.table(spark, sf, "part")
    con = p.groupBy((F.col("p_size") % 8).cast("int").alias("channel")).agg(F.avg(F.col("p_partkey") % 100).alias("x"), (F.avg("p_retailprice") / 10).alias("y"))
    c = Wf.center_of_mass(Wf.template_ptp(tpl(spark, sf), ["vec_id"], "channel", "v"), con, ["vec_id"], radius=3.0)
    return c.select("vec_id", R.rnd("x_um", 5).alias("x_um"), R.rnd("y_um", 5).alias("y_um"), "n_contacts")


CTES["r_step"] = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session, unit_id ORDER BY t) AS r, CAST(ceil(count(*) OVER (PARTITION BY session, unit_id) / CAST(5 AS DOUBLE)) AS BIGINT) AS st FROM r_spikes) WHERE (r - 1) % st = 0"


@query("A68_stepped_sample", "SELECT session, unit_id, spike_id FROM r_step")
def a68s(spark, sf):
    return Wf.stepped_sample(R.spikes(spark, sf), K, "t", 5, width=WEEK).select(*K, "spike_id")


@query("A68_spike_triggered_average", """WITH w AS (SELECT s.session, s.unit_id, s.spike_id, e.event_id - s.spike_id AS o, e.value FROM r_spikes s JOIN events e ON e.event_id BETWEEN s.spike_id - 3 AND s.spike_id + 3), m AS (SELECT *, median(value) OVER (PARTITION BY session, unit_id, spike_id) AS md FROM w)
  SELECT session, unit_id, o AS "offset", round(avg(value - md), 6) AS mean, count(*) AS n FROM m GROUP BY 1, 2, 3""")
def a68(spark, sf):
    sp = R.spikes(spark, sf).select(*K, "spike_id", F.col("spike_id").alias("i"), F.lit(0).alias("g"))
    sm = R.table(spark, sf, "events").select(F.lit(0).alias("g"), F.col("event_id").alias("i"), "value")
    return Wf.spike_triggered_average(sp, sm, ["g"], K, idx="i", value="value", k=3).select(*K, "offset", R.rnd("mean").alias("mean"), "n")


@query("J24_template_assignment", "SELECT l_suppkey AS cluster, coalesce(arg_min(tp, (-n, tp)) FILTER (tp IS NOT NULL), l_suppkey) AS template_id FROM (SELECT l_suppkey, CASE WHEN l_quantity > 5 THEN l_partkey % 50 END AS tp, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY l_suppkey")
def j24(spark, sf):
    li = R.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("cluster"), F.when(F.col("l_quantity") > 5, F.col("l_partkey") % 50).alias("tp"))
    return Wf.dominant_template(li, "cluster", "tp")


# ---- kernel regression ----
CTES["r_kp"] = "SELECT grp, unit_id, hd_deg, CASE WHEN rf_deg >= 180 THEN rf_deg - 360 ELSE rf_deg END AS rf FROM r_pairs"
CTES["r_kl"] = """SELECT grp, k, avg(CASE WHEN sqrt(c * c + s * s) > 1e-12 THEN 1 - (c * cos(radians(rf)) + s * sin(radians(rf))) / sqrt(c * c + s * s) ELSE 2 END) AS loss, count(*) AS n FROM (SELECT a.grp, a.unit_id, a.rf, k, sum(exp(k * (cos(radians(a.hd_deg - b.hd_deg)) - 1)) * cos(radians(b.rf))) / sum(exp(k * (cos(radians(a.hd_deg - b.hd_deg)) - 1))) AS c,
   sum(exp(k * (cos(radians(a.hd_deg - b.hd_deg)) - 1)) * sin(radians(b.rf))) / sum(exp(k * (cos(radians(a.hd_deg - b.hd_deg)) - 1))) AS s FROM r_kp a JOIN r_kp b ON a.grp = b.grp AND a.unit_id <> b.unit_id, (SELECT CAST(unnest([0, 0.125, 0.25, 0.5, 1, 2, 4, 8, 16, 32, 64]) AS DOUBLE) AS k) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2"""


@query("G22_kernel_circular_fit", "SELECT grp, k AS kappa, round(loss, 6) AS loss, n FROM r_kl")
def g22(spark, sf):
    return KR.kernel_fit(pairs(spark, sf), ["grp"], "hd_deg", "rf_deg").select("grp", "kappa", R.rnd("loss").alias("loss"), "n")


@query("G22_nested_loo")
def g22n(spark, sf):
    p = cut_lineage(pairs(spark, sf))
    n = KR.nested_loo(p, ["grp"], "hd_deg", "rf_deg").join(KR.baselines(p, ["grp"], "hd_deg", "rf_deg"), "grp")
    return n.select("grp", "n", R.rnd("nested_mae_deg", 4).alias("nested_mae_deg"), R.rnd("constant_deg", 4).alias("constant_deg"), R.rnd("beta_deg", 4).alias("beta_deg"), R.rnd("resultant").alias("resultant"))


@query("G23_kernel_circular_predict", """WITH b AS (SELECT grp, arg_min(k, (round(loss, 12), k)) AS k FROM r_kl GROUP BY 1), q AS (SELECT p.grp, q * CAST(10 AS DOUBLE) AS q, exp(k * (cos(radians(q * 10 - hd_deg)) - 1)) AS w, rf, least(abs(q * 10 - hd_deg), 360 - abs(q * 10 - hd_deg)) AS d FROM r_kp p JOIN b ON b.grp = p.grp, (SELECT unnest(range(36)) AS q))
  SELECT grp, q AS hd_deg, round(sqrt(sum(w * cos(radians(rf))) ** 2 + sum(w * sin(radians(rf))) ** 2) / sum(w), 6) AS resultant, round(sum(w) ** 2 / sum(w * w), 5) AS effective_n, min(d) AS nearest_deg FROM q GROUP BY 1, 2""")
def g23(spark, sf):
    p = cut_lineage(pairs(spark, sf))
    k = KR.best_kappa(KR.kernel_fit(p, ["grp"], "hd_deg", "rf_deg"), ["grp"])
    r = KR.kernel_predict(p, ["grp"], "hd_deg", "rf_deg", k, 36)
    return r.select("grp", "hd_deg", R.rnd("resultant").alias("resultant"), R.rnd("effective_n", 5).alias("effective_n"), "nearest_deg")
