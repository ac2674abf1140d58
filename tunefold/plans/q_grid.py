"""Region-detection queries."""
from pyspark.sql import functions as F

from .registry import query, CTES
from . import roles as R
from ..operators import grid as G, rates as RT
from ..session import cut_lineage

NY, NX = 7, 30
CTES["r_zmap"] = """WITH st AS (SELECT unit_id, stratum, count(*) AS N, avg(response) AS m, var_pop(response) AS v FROM r_resp GROUP BY ALL),
  ps AS (SELECT unit_id, stratum, y, x, count(*) AS n, sum(response) AS s FROM r_resp GROUP BY ALL)
  SELECT unit_id, y, x, CAST(sum(n) AS BIGINT) AS n_trials, sum(s) / sum(n) AS response, sum(m * n) / sum(n) AS null_mean,
   sqrt(sum(CASE WHEN N > 1 THEN v * n * (N - n) / (N - 1) ELSE 0 END)) / sum(n) AS null_sd FROM (
    SELECT ps.*, st.N AS N2, st.N, m, v FROM (SELECT unit_id, stratum, y, x, n AS n, s FROM ps) ps JOIN (SELECT unit_id, stratum, N, m, v FROM st) st USING (unit_id, stratum)) GROUP BY unit_id, y, x"""
CTES["r_zmap"] = """SELECT unit_id, y, x, CAST(sum(cn) AS BIGINT) AS n_trials, sum(s) / sum(cn) AS response, sum(m * cn) / sum(cn) AS null_mean,
   sqrt(sum(CASE WHEN tot > 1 THEN v * cn * (tot - cn) / (tot - 1) ELSE 0 END)) / sum(cn) AS null_sd FROM (
    SELECT unit_id, stratum, y, x, count(*) AS cn, sum(response) AS s FROM r_resp GROUP BY ALL) JOIN
   (SELECT unit_id, stratum, count(*) AS tot, avg(response) AS m, var_pop(response) AS v FROM r_resp GROUP BY ALL) USING (unit_id, stratum) GROUP BY unit_id, y, x"""
CTES["r_z"] = "SELECT *, CASE WHEN null_sd > 0 THEN (response - null_mean) / null_sd END AS z FROM r_zmap"


def zmap(spark, sf):
    r = R.resp(spark, sf)
    return G.z_map(r, r, ["unit_id"], ["unit_id"])


@query("G01_rf_zmap", "SELECT unit_id, y, x, n_trials, round(response, 6) AS response, round(null_mean, 6) AS null_mean, round(null_sd, 6) AS null_sd, round(z, 6) AS z FROM r_z")
def g01(spark, sf):
    return zmap(spark, sf).select("unit_id", "y", "x", "n_trials", *[R.rnd(c).alias(c) for c in ("response", "null_mean", "null_sd", "z")])


@query("G02_bottom_row_baseline", """WITH b AS (SELECT unit_id, count(response) AS c, avg(response) AS m, stddev_pop(response) AS s FROM r_z WHERE y >= 5 GROUP BY unit_id)
  SELECT unit_id, y, x, round(CASE WHEN c = 60 AND s > 0 THEN (response - m) / s END, 6) AS z FROM r_z LEFT JOIN b USING (unit_id)""")
def g02(spark, sf):
    return G.bottom_row_baseline(zmap(spark, sf), ["unit_id"], NY, NX).select("unit_id", "y", "x", R.rnd("z").alias("z"))


CTES["r_cand"] = """SELECT DISTINCT a.unit_id, a.y, a.x, a.z FROM r_z a JOIN r_z s ON a.unit_id = s.unit_id AND s.z >= 1.5 AND a.z >= 0.8 AND abs(a.y - s.y) <= 1
  AND least(abs(a.x - s.x), 30 - abs(a.x - s.x)) <= 1"""


def cand(spark, sf):
    return G.seed_expand(G.score(zmap(spark, sf), "greater"), ["unit_id"], 1.5, 0.7, NX)


@query("G03_seed_expand", "SELECT unit_id, y, x, round(z, 6) AS z FROM r_cand")
def g03(spark, sf):
    return cand(spark, sf).select("unit_id", "y", "x", R.rnd("z").alias("z"))


CTES["rec_comp"] = """(unit_id, y, x, root)
SELECT unit_id, y, x, y * 30 + x FROM r_cand UNION SELECT c.unit_id, c.y, c.x, r.root FROM rec_comp r JOIN r_cand c ON c.unit_id = r.unit_id
  AND abs(c.y - r.y) + least(abs(c.x - r.x), 30 - abs(c.x - r.x)) = 1"""
CTES["r_comp"] = "SELECT unit_id, y, x, CAST(min(root) AS INTEGER) AS component FROM rec_comp GROUP BY ALL"
CTES["r_kept"] = "SELECT * EXCLUDE (sz) FROM (SELECT k.*, z.z, z.response, z.null_mean, count(*) OVER (PARTITION BY k.unit_id, component) AS sz FROM r_comp k JOIN r_z z USING (unit_id, y, x)) WHERE sz > 1"
CTES["rec_sec"] = """(unit_id, y, x, root)
SELECT unit_id, y, x, y * 30 + x FROM r_kept UNION SELECT c.unit_id, c.y, c.x, r.root FROM rec_sec r JOIN r_kept c ON c.unit_id = r.unit_id
  AND abs(c.y - r.y) <= 2 AND least(abs(c.x - r.x), 30 - abs(c.x - r.x)) <= 2"""
CTES["r_sec"] = "SELECT unit_id, y, x, any_value(section) AS section, any_value(greatest(response - null_mean, 0)) AS effect FROM (SELECT unit_id, y, x, CAST(min(root) AS INTEGER) AS section FROM rec_sec GROUP BY ALL) JOIN r_kept USING (unit_id, y, x) GROUP BY ALL"


def comp(spark, sf):
    return G.components(cand(spark, sf), ["unit_id"], NY, NX)


def kept(spark, sf):
    return G.drop_small(comp(spark, sf), ["unit_id"], 1)


def sec(spark, sf):
    k = kept(spark, sf).withColumn("effect", F.greatest(F.col("response") - F.col("null_mean"), F.lit(0.0)))
    return G.sections(k, ["unit_id"], NY, NX)


@query("G04_components", "SELECT unit_id, y, x, component FROM r_comp")
def g04(spark, sf):
    return comp(spark, sf).select("unit_id", "y", "x", "component")


@query("G04_component_mass", "SELECT unit_id, component, round(sum(z), 6) AS mass, count(*) AS size FROM r_kept GROUP BY ALL")
def g04b(spark, sf):
    return G.component_mass(kept(spark, sf), ["unit_id"]).select("unit_id", "component", R.rnd("mass").alias("mass"), "size")


CTES["r_centers"] = """SELECT unit_id, section, arg_min(y, (c, -w, y, x)) AS y, arg_min(x, (c, -w, y, x)) AS x, count(*) AS size FROM (
  SELECT a.unit_id, a.section, a.y, a.x, any_value(a.effect) AS w, round(sum(b.effect * ((a.y - b.y) ** 2 + least(abs(a.x - b.x), 30 - abs(a.x - b.x)) ** 2)), 9) AS c
  FROM r_sec a JOIN r_sec b ON a.unit_id = b.unit_id AND a.section = b.section GROUP BY 1, 2, 3, 4) GROUP BY 1, 2"""


def centers(spark, sf):
    return G.section_centers(sec(spark, sf), ["unit_id"], "effect", NX)


@query("G05_sections_centers", "SELECT unit_id, section, y, x, size FROM r_centers")
def g05(spark, sf):
    return centers(spark, sf)


@query("A82_component_moments", """SELECT unit_id, section, round(amp, 6) AS amplitude, round(my, 6) AS y_mean, round(((mx % 30) + 30) % 30, 6) AS x_mean, round(sqrt(greatest(yy - my * my, 0)), 5) AS y_sd, round(sqrt(greatest(xx - mx * mx, 0)), 5) AS x_sd FROM (
  SELECT unit_id, section, max(effect) AS amp, sum(effect * y) / sum(effect) AS my, sum(effect * ux) / sum(effect) AS mx, sum(effect * y * y) / sum(effect) AS yy, sum(effect * ux * ux) / sum(effect) AS xx FROM (
   SELECT s.unit_id, s.section, s.y, effect, c.x + ((s.x - c.x + 15) % 30 + 30) % 30 - 15 AS ux FROM r_sec s JOIN r_centers c ON c.unit_id = s.unit_id AND c.section = s.section) GROUP BY 1, 2) WHERE amp > 0""")
def a82(spark, sf):
    s = sec(spark, sf)
    m = G.component_moments(s, centers(spark, sf), ["unit_id"], "effect", NX)
    return m.select("unit_id", "section", R.rnd("amplitude").alias("amplitude"), R.rnd("y_mean").alias("y_mean"), R.rnd("x_mean").alias("x_mean"), R.rnd("y_sd", 5).alias("y_sd"), R.rnd("x_sd", 5).alias("x_sd"))


@query("G06_fill_single_holes", """WITH v AS (SELECT unit_id, y, x FROM r_z WHERE z IS NOT NULL), n AS (SELECT a.unit_id, a.y, a.x, k.component FROM v a JOIN v b ON a.unit_id = b.unit_id
   AND abs(a.y - b.y) + least(abs(a.x - b.x), 30 - abs(a.x - b.x)) = 1 LEFT JOIN r_comp k ON k.unit_id = b.unit_id AND k.y = b.y AND k.x = b.x)
  SELECT n.unit_id, n.y, n.x, min(n.component) AS component FROM n LEFT JOIN r_comp k USING (unit_id, y, x) WHERE k.unit_id IS NULL GROUP BY 1, 2, 3
  HAVING count(*) >= 2 AND count(*) = count(n.component) AND min(n.component) = max(n.component)""")
def g06(spark, sf):
    v = zmap(spark, sf).filter("z IS NOT NULL")
    return G.fill_single_holes(comp(spark, sf), v, ["unit_id"], NX, min_neighbours=2)


@query("G10_project_mask", "SELECT DISTINCT unit_id, x FROM r_kept")
def g10(spark, sf):
    return G.project_mask(kept(spark, sf), ["unit_id"], "x")


@query("G11_J09_rf_centers", "SELECT unit_id, s_nationkey AS nation, x * CAST(12 AS DOUBLE) - 174 AS x_deg, 30 - y * CAST(10 AS DOUBLE) AS y_deg FROM r_centers JOIN supplier ON s_suppkey = unit_id")
def g11(spark, sf):
    s = R.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("unit_id"), F.col("s_nationkey").alias("nation"))
    return centers(spark, sf).join(s, "unit_id").select("unit_id", "nation", (F.col("x") * 12.0 - 174.0).alias("x_deg"), (30.0 - F.col("y") * 10.0).alias("y_deg"))


@query("W18_A86_region_directions", """SELECT c.unit_id, CAST(row_number() OVER (PARTITION BY c.unit_id ORDER BY section) AS INTEGER) AS region_no, ((peak_bin + 0.5) * CAST(12 AS DOUBLE) + c.x * 12 - 174 + 360) % 360 AS direction_deg
  FROM r_centers c JOIN r_peaks p ON p.unit_id = c.unit_id AND p.feature = 'hd'""")
def w18(spark, sf):
    from .q_profiles import peaks
    from ..operators.populations import region_directions
    hd = peaks(spark, sf).filter("feature = 'hd'").select("unit_id", ((F.col("peak_bin") + 0.5) * 12.0).alias("hd_deg"))
    c = centers(spark, sf).withColumn("rf_deg", F.col("x") * 12.0 - 174.0)
    return region_directions(hd, c, ["unit_id"], "section").select("unit_id", "region_no", "direction_deg")


@query("A69_population_counts", """SELECT CASE WHEN grouping(s_nationkey) = 0 THEN s_nationkey END AS probe, y, x, count(*) AS n_units FROM r_kept JOIN supplier ON s_suppkey = unit_id GROUP BY GROUPING SETS ((s_nationkey, y, x), (y, x))""")
def a69(spark, sf):
    from ..operators.populations import population_counts
    s = R.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("unit_id"), F.col("s_nationkey").alias("probe"))
    return population_counts(kept(spark, sf).join(s, "unit_id"), "probe")


@query("A70_distinct_coverage", "SELECT 'x' AS axis, x AS idx, count(DISTINCT unit_id) AS n_units FROM r_kept GROUP BY x UNION ALL SELECT 'y', y, count(DISTINCT unit_id) FROM r_kept GROUP BY y")
def a70(spark, sf):
    from ..operators.populations import distinct_coverage
    return distinct_coverage(kept(spark, sf), ["unit_id"])


@query("A73_J13_center_histogram", """SELECT CAST(floor((((b.x - a.x) * CAST(12 AS DOUBLE) + 6 + 720) % 360) / 12) AS INTEGER) AS bin, count(*) AS n FROM r_centers a JOIN r_centers b ON a.unit_id = b.unit_id AND a.section <> b.section GROUP BY 1""")
def a73(spark, sf):
    from ..operators.pairs import center_pairs_histogram
    c = centers(spark, sf).select("unit_id", F.lit("e").alias("kind"), (F.col("x") * 12.0).alias("deg"))
    return center_pairs_histogram(c, ["unit_id"], "e", "e", 12.0, same=True).withColumn("n", F.col("n").cast("long"))


CTES["r_mmap"] = "SELECT unit_id, y, x, sum(rate_hz) / CAST(11 AS DOUBLE) AS v FROM r_rates GROUP BY ALL"
CTES["r_ref"] = "SELECT unit_id, avg(v) AS m, stddev_pop(v) AS s FROM r_mmap WHERE v <> 0 GROUP BY unit_id"
CTES["r_dc"] = "SELECT unit_id, y, x, -(v - m) AS effect FROM r_mmap JOIN r_ref USING (unit_id) WHERE v <> 0 AND s > 0 AND -(v - m) / s >= 1.2"
CTES["rec_d1"] = """(unit_id, y, x, root)
SELECT unit_id, y, x, y * 30 + x FROM r_dc UNION SELECT c.unit_id, c.y, c.x, r.root FROM rec_d1 r JOIN r_dc c ON c.unit_id = r.unit_id
  AND abs(c.y - r.y) + least(abs(c.x - r.x), 30 - abs(c.x - r.x)) = 1"""
CTES["r_dk"] = "SELECT unit_id, y, x, effect FROM (SELECT *, count(*) OVER (PARTITION BY unit_id, c) AS sz FROM (SELECT unit_id, y, x, min(root) AS c FROM rec_d1 GROUP BY ALL) JOIN r_dc USING (unit_id, y, x)) WHERE sz > 1"
CTES["rec_d2"] = """(unit_id, y, x, root)
SELECT unit_id, y, x, y * 30 + x FROM r_dk UNION SELECT c.unit_id, c.y, c.x, r.root FROM rec_d2 r JOIN r_dk c ON c.unit_id = r.unit_id
  AND abs(c.y - r.y) <= 2 AND least(abs(c.x - r.x), 30 - abs(c.x - r.x)) <= 2"""


@query("G08_detect_rf", "SELECT unit_id, CAST(min(root) AS INTEGER) AS section, y, x, round(any_value(effect), 6) AS effect FROM rec_d2 JOIN r_dk USING (unit_id, y, x) GROUP BY unit_id, y, x")
def g08(spark, sf):
    r = RT.counts_to_rates(R.cube(spark, sf), R.grid(spark, sf), ["y", "x"], 0.001)
    m = r.groupBy("unit_id", "y", "x").agg((F.sum("rate_hz") / 11.0).alias("v"))
    s, _ = G.detect_map(m, ["unit_id"], "v", ny=NY, nx=NX, sigma=-1.2, drop_bins=1)
    return s.select("unit_id", "section", "y", "x", R.rnd("effect").alias("effect"))


@query("G09_analyze_rf")
def g09(spark, sf):
    r = RT.counts_to_rates(R.cube(spark, sf), R.grid(spark, sf), ["y", "x"], 0.001)
    m = r.groupBy("unit_id", "y", "x").agg((F.sum("rate_hz") / 11.0).alias("mean_hz"))
    dense = RT.dense_map(m, ["unit_id"], (NY, NX), "mean_hz")
    return G.analyze_rf(dense, ["unit_id"], ny=NY, nx=NX, max_zero=20)


CTES["r_tr"] = "SELECT session, trial_id, luminance AS stratum, y_idx AS y, x_idx AS x FROM r_trials"
CTES["r_tresp"] = "SELECT session, unit_id, trial_id, CAST(count(*) AS DOUBLE) AS response FROM r_hits GROUP BY ALL"
N_REP = 999
CTES["r_gz"] = """SELECT session, unit_id, y, x, sum(cn) AS nt, sum(m * cn) / sum(cn) AS mu, sqrt(sum(CASE WHEN tot > 1 THEN v * cn * (tot - cn) / (tot - 1) ELSE 0 END)) / sum(cn) AS sd FROM (
   SELECT session, stratum, y, x, count(*) AS cn FROM r_tr GROUP BY ALL) JOIN (SELECT session, stratum, count(*) AS tot FROM r_tr GROUP BY ALL) USING (session, stratum)
   JOIN (SELECT session, unit_id, stratum, sum(response) / any_value(tt) AS m, sum(response ** 2) / any_value(tt) - (sum(response) / any_value(tt)) ** 2 AS v FROM r_tresp JOIN r_tr USING (session, trial_id)
     JOIN (SELECT session, stratum, count(*) AS tt FROM r_tr GROUP BY ALL) USING (session, stratum) GROUP BY ALL) USING (session, stratum) GROUP BY ALL"""
CTES["r_perm"] = f"""SELECT h.rep, h.session, h.trial_id, b.y, b.x FROM (
   SELECT rep, session, stratum, trial_id, row_number() OVER (PARTITION BY rep, session, stratum ORDER BY md5('7|' || rep || '|' || trial_id), trial_id) AS r FROM r_tr, (SELECT unnest(range({N_REP})) AS rep)) h
   JOIN (SELECT session, stratum, y, x, row_number() OVER (PARTITION BY session, stratum ORDER BY trial_id) AS r FROM r_tr) b ON b.session = h.session AND b.stratum = h.stratum AND b.r = h.r"""
CTES["r_pz"] = """SELECT rep, s.session, s.unit_id, s.y, s.x, (s.s / nt - mu) / sd AS z FROM (
   SELECT -1 AS rep, session, unit_id, y, x, sum(response) AS s FROM r_tresp JOIN r_tr USING (session, trial_id) GROUP BY ALL
   UNION ALL SELECT rep, session, unit_id, y, x, sum(response) FROM r_tresp JOIN r_perm USING (session, trial_id) GROUP BY ALL) s JOIN r_gz g ON g.session = s.session AND g.unit_id = s.unit_id AND g.y = s.y AND g.x = s.x
   WHERE sd > 0 AND (s.s / nt - mu) / sd >= 1.5"""
CTES["rec_pc"] = """(rep, unit_id, y, x, root)
SELECT rep, unit_id, y, x, y * 30 + x FROM r_pz UNION SELECT c.rep, c.unit_id, c.y, c.x, r.root FROM rec_pc r JOIN r_pz c ON c.unit_id = r.unit_id AND c.rep = r.rep
  AND abs(c.y - r.y) + least(abs(c.x - r.x), 30 - abs(c.x - r.x)) = 1"""


@query("G07_cluster_permutation", f"""WITH k AS (SELECT rep, unit_id, c, round(sum(z), 9) AS mass, count(*) AS size FROM (SELECT rep, unit_id, y, x, min(root) AS c FROM rec_pc GROUP BY ALL) JOIN r_pz USING (rep, unit_id, y, x) GROUP BY ALL),
  nl AS (SELECT rep, unit_id, max(mass) AS nm FROM k WHERE rep >= 0 GROUP BY ALL)
  SELECT k.unit_id, CAST(k.c AS INTEGER) AS component, round(k.mass, 6) AS mass, k.size, round((1 + count(nl.nm) FILTER (nl.nm >= k.mass)) / CAST({N_REP + 1} AS DOUBLE), 6) AS p
  FROM k LEFT JOIN nl ON nl.unit_id = k.unit_id WHERE k.rep = -1 GROUP BY 1, 2, k.mass, k.size""")
def g07(spark, sf):
    from ..operators.clusters import hit_clusters
    from .q_rates import LO, HI
    tr = R.trials(spark, sf).select("session", "trial_id", "onset_s", F.col("luminance").alias("stratum"), F.col("y_idx").alias("y"), F.col("x_idx").alias("x"))
    cl = hit_clusters(R.spikes(spark, sf), tr, ["session"], ["unit_id"], "trial_id", t="t", onset="onset_s", lo=LO, hi=HI, ny=NY, nx=NX, n_rep=N_REP, seed=7)
    return cl.select("unit_id", "component", R.rnd("mass").alias("mass"), "size", R.rnd("p").alias("p"))
