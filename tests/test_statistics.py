"""Hand-computed and brute-force checks of statistics, grids, nulls and regressions."""
import hashlib
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from table_rows import rows
from tunefold.functions import special
from tunefold.operators import egocentric as E, grid as G, kernels as KR, nulls as N, pairs as P, profiles as PR, signals as SG, smoothing as SM, spectral as SP, tuning as T


def test_null_moments(spark):
    r = spark.createDataFrame([(1, 0, 0, x, float(v)) for x, v in ((0, 1), (0, 2), (1, 5), (1, 8))], "unit_id INT, stratum INT, y INT, x INT, response DOUBLE")
    z = {x: (m, sd, zz) for x, m, sd, zz in rows(G.z_map(r, r, ["unit_id"], ["unit_id"]), "x", "null_mean", "null_sd", "z")}
    assert z[0][0] == 4 and z[0][1] == pytest.approx(math.sqrt(2.5)) and z[0][2] == pytest.approx(-math.sqrt(2.5)) and z[1][2] == pytest.approx(math.sqrt(2.5))


def test_silent_stratum_still_counts_trials(spark):
    tr = spark.createDataFrame([(0, s, t, 0, t % 2) for s in (0, 1) for t in range(4)], "session INT, stratum INT, trial INT, y INT, x INT")
    rs = spark.createDataFrame([(0, 7, 0, 0, 0, 2.0)], "session INT, unit_id INT, stratum INT, y INT, x INT, response DOUBLE")
    got = rows(G.z_map(rs, tr, ["session"], ["unit_id"]), "x", "n_trials", "response", "null_mean")
    assert got == [(0, 4, 0.5, 0.25), (1, 4, 0.0, 0.25)]


def test_components_wrap_and_drop(spark):
    cells = [(0, 0), (0, 2), (0, 3), (2, 0), (2, 1), (2, 2)]
    d = spark.createDataFrame([(1, y, x, 10.0) for y, x in cells], "u INT, y INT, x INT, score DOUBLE")
    keep = G.drop_small(G.components(d, ["u"], 3, 5, wrap_x=False), ["u"], 2)
    assert rows(keep, "y", "x") == [(2, 0), (2, 1), (2, 2)]
    e = spark.createDataFrame([(1, 0, 0, 1.0), (1, 0, 4, 1.0)], "u INT, y INT, x INT, score DOUBLE")
    assert len({c for c, in rows(G.components(e, ["u"], 3, 5, wrap_x=True), "component")}) == 1
    assert len({c for c, in rows(G.components(e, ["u"], 3, 5, wrap_x=False), "component")}) == 2


@pytest.mark.parametrize("offsets,reach", [(G.FOUR, None), (G.GAP_TWO, 2)])
def test_components_flood_fill(spark, offsets, reach):
    rng = np.random.default_rng(2)
    data, want = [], {}
    for u in range(20):
        m = rng.random((7, 30)) < 0.35
        lab = {}
        for s in zip(*np.nonzero(m)):
            if s in lab:
                continue
            stack, comp = [s], []
            lab[s] = None
            while stack:
                y, x = stack.pop()
                comp.append((y, x))
                for dy, dx in offsets:
                    q = (y + dy, (x + dx) % 30)
                    if 0 <= q[0] < 7 and m[q] and q not in lab:
                        lab[q] = None
                        stack.append(q)
            for c in comp:
                want[(u, int(c[0]), int(c[1]))] = min(int(a) * 30 + int(b) for a, b in comp)
        data += [(u, int(y), int(x), 1.0) for y, x in zip(*np.nonzero(m))]
    d = spark.createDataFrame(data, "u INT, y INT, x INT, score DOUBLE")
    assert {(u, y, x): c for u, y, x, c in rows(G.components(d, ["u"], 7, 30, offsets=offsets), "u", "y", "x", "component")} == want


def test_center_ties(spark):
    d = spark.createDataFrame([(1, 0, 0, 0, 1.0), (1, 0, 0, 1, 1.0), (1, 0, 0, 2, 1.0), (2, 0, 3, 0, 1.0), (2, 0, 3, 1, 2.0)], "u INT, section INT, y INT, x INT, w DOUBLE")
    assert rows(G.section_centers(d, ["u"], "w", 30), "u", "y", "x") == [(1, 0, 1), (2, 3, 1)]


def test_hole_fill(spark):
    ring = [(1, 0, 1, 5), (1, 2, 1, 5), (1, 1, 0, 5), (1, 1, 2, 5)]
    m = spark.createDataFrame(ring, "u INT, y INT, x INT, component INT")
    v = spark.createDataFrame([(1, y, x) for y in range(3) for x in range(3)], "u INT, y INT, x INT")
    assert (1, 1) in rows(G.fill_single_holes(m, v, ["u"], 3, wrap_x=False), "y", "x")


def test_kappa(spark):
    ks = [0.1, 0.25, 1.0, 3.0, 10.0, 40.0]
    th = np.linspace(0, 2 * np.pi, 200001)[:-1]
    r = [float(np.mean(np.exp(k * (np.cos(th) - 1)) * np.cos(th)) / np.mean(np.exp(k * (np.cos(th) - 1)))) for k in ks]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(r)] + [(90, 0.0), (91, 1.0)], "i INT, r DOUBLE")
    got = dict(rows(d.select("i", special.kappa_from_resultant("r").alias("k")), "i", "k"))
    for i, k in enumerate(ks):
        assert got[i] == pytest.approx(k, rel=1e-6)
    assert got[90] == 0.0 and got[91] is None


def test_fisher_lee_reflection_and_degenerate(spark):
    a = [10.0, 80.0, 200.0, 310.0]
    d = spark.createDataFrame([("m", x, (30 - x) % 360) for x in a] + [("s", x, (x + 40) % 360) for x in a] + [("c", 5.0, x) for x in a], "g STRING, a DOUBLE, b DOUBLE")
    got = dict(rows(P.fisher_lee(d, ["g"], "a", "b"), "g", "rho"))
    assert got["m"] == pytest.approx(-1) and got["s"] == pytest.approx(1) and got["c"] is None


def test_mantel_states_equal_pairs(spark):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 12, 60) * 30.0, rng.integers(0, 12, 60) * 30.0
    cd = lambda v: [min(abs(x - y), 360 - abs(x - y)) for x, y in itertools.combinations(v, 2)]
    rank = lambda v: np.array([(np.sum(np.array(v) < x) + (np.sum(np.array(v) == x) + 1) / 2) for x in v])
    want = np.corrcoef(rank(cd(a)), rank(cd(b)))[0, 1]
    d = spark.createDataFrame([(0, float(x), float(y)) for x, y in zip(a, b)], "g INT, a DOUBLE, b DOUBLE")
    assert rows(P.mantel_spearman(d, ["g"], "a", "b"), "rho")[0][0] == pytest.approx(want)


def test_nested_kernel_brute(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 12, 14) * 30.0
    y = (x + rng.integers(-2, 3, 14) * 30.0 + 180) % 360 - 180

    def pred(X, Y, q, k):
        w = np.exp(k * (np.cos(np.radians(q - X)) - 1))
        v = np.sum(w * np.exp(1j * np.radians(Y)))
        return None if abs(v) < 1e-10 else np.degrees(np.angle(v))

    def loss(X, Y, k):
        out = []
        for i in range(len(X)):
            m = np.arange(len(X)) != i
            p = pred(X[m], Y[m], X[i], k)
            out.append(2.0 if p is None else 1 - np.cos(np.radians(p - Y[i])))
        return np.mean(out)

    errs = []
    for i in range(14):
        m = np.arange(14) != i
        ls = [round(loss(x[m], y[m], k), 9) for k in KR.KAPPAS]
        p = pred(x[m], y[m], x[i], KR.KAPPAS[int(np.argmin(ls))])
        if p is not None:
            errs.append(abs((p - y[i] + 180) % 360 - 180))
    d = spark.createDataFrame([(0, float(a), float(b)) for a, b in zip(x, y)], "g INT, x DOUBLE, y DOUBLE")
    assert rows(KR.nested_loo(d, ["g"], "x", "y"), "nested_mae_deg")[0][0] == pytest.approx(np.mean(errs), abs=1e-6)


def test_permutation_p_is_exact_for_full_enumeration_bounds(spark):
    d = spark.createDataFrame([(0, i, 30.0 * i, 30.0 * i) for i in range(10)], "g INT, u LONG, a DOUBLE, b DOUBLE")
    o, p = rows(N.pairing_permutation(d, ["g"], "u", "a", "b", "fisher_lee", n_rep=99), "observed", "p")[0]
    assert o == pytest.approx(1.0) and p == pytest.approx(0.01)


def test_permutation_keeps_values_within_group(spark):
    d = spark.createDataFrame([(g, 10 * g + i, float(i), float(100 * g + i)) for g in (0, 1) for i in range(7)], "g INT, u LONG, a DOUBLE, b DOUBLE")
    got = N.permuted_pairs(d, ["g"], "u", "a", "b", 5, 1)
    for r in got.groupBy("rep", "g").agg(F.sort_array(F.collect_list("b")).alias("b")).collect():
        assert r.b == [100.0 * r.g + i for i in range(7)]


def test_permutation_invariant_to_partitions(spark):
    d = spark.createDataFrame([(0, i, float(i), float(i * i)) for i in range(30)], "g INT, u LONG, a DOUBLE, b DOUBLE")
    base = rows(N.permuted_pairs(d, ["g"], "u", "a", "b", 3, 1), "rep", "a", "b")
    for n in ("1", "4", "32"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        assert rows(N.permuted_pairs(d.repartition(int(n)), ["g"], "u", "a", "b", 3, 1), "rep", "a", "b") == base
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_undefined_bootstrap_draws_stretch_bounds(spark):
    d = spark.createDataFrame([(0, i, 10.0, 20.0 * i) for i in range(4)], "g INT, u LONG, a DOUBLE, b DOUBLE")
    lo, hi, f = rows(N.bootstrap_ci(d, ["g"], "u", "a", "b", "fisher_lee", n_rep=20), "ci_low", "ci_high", "defined_fraction")[0]
    assert (lo, hi, f) == (-1.0, 1.0, 0.0)


def test_greedy_equals_serial(spark):
    rng = np.random.default_rng(5)
    prs = {(int(a), int(b)) for a, b in rng.integers(0, 25, (120, 2)) if a < b}
    sc = {p: float(rng.integers(0, 6)) for p in prs}
    used, want = set(), []
    for a, b in sorted(prs, key=lambda p: (sc[p], p)):
        if a not in used and b not in used:
            used |= {a, b}
            want.append((a, b))
    d = spark.createDataFrame([(0, a, b, sc[(a, b)]) for a, b in prs], "k INT, a INT, b INT, s DOUBLE")
    assert rows(E.greedy_match(d, ["k"], "s"), "a", "b") == sorted(want)


def test_state_matches_brute(spark):
    rng = np.random.default_rng(6)
    g = rng.uniform(0, 12, (60, 3))
    xy, hd = rng.uniform(0, 40, (60, 2)), rng.uniform(0, 360, 60)
    want = [(i, j) for i, j in itertools.combinations(range(60), 2) if np.sqrt(np.mean((g[i] - g[j]) ** 2)) <= 3 and np.hypot(*(xy[i] - xy[j])) >= 5
            and abs((hd[i] - hd[j] + 180) % 360 - 180) >= 60]
    d = spark.createDataFrame([(0, i, [float(v) for v in g[i]], float(xy[i][0]), float(xy[i][1]), float(hd[i]), 1) for i in range(60)],
                              "k INT, s INT, geometry ARRAY<DOUBLE>, x DOUBLE, y DOUBLE, hd DOUBLE, n INT")
    assert rows(E.state_matches(d, ["k"], "s", rms_cm=3.0, min_sep=5.0, min_hd=60.0, n_geom=3), "a", "b") == want


def test_poisson_draw(spark):
    lam, us = 0.7, [0.01, 0.4965, 0.4967, 0.85, 0.999]
    cdf = np.cumsum([math.exp(-lam) * lam ** k / math.factorial(k) for k in range(40)])
    d = spark.createDataFrame([(u, lam) for u in us], "u DOUBLE, l DOUBLE")
    got = dict(rows(d.select("u", E.poisson_draw("l", F.col("u")).alias("n")), "u", "n"))
    assert got == {u: int(np.searchsorted(cdf, u)) for u in us}


def test_poisson_null_pieces(spark):
    d = spark.createDataFrame([(u, 0, 400, 0.5) for u in range(300)], "u INT, c INT, n INT, l DOUBLE")
    v = np.array([x for x, in rows(E.poisson_null(d, ["u"], ["c"], "n", "l", n_sim=5, seed=1), "n")], dtype=float)
    assert len(v) == 1500 and abs(v.mean() - 200) < 2 and abs(v.var() - 200) < 30


def test_acg_fixture(spark):
    d = spark.createDataFrame([(0, .05), (0, .15), (1, 1.05), (1, 1.15)], "seg INT, t DOUBLE")
    h = SP.acg(d, ["seg"], "t", bin_s=0.1, max_lag_s=0.2).groupBy("lag").agg(F.sum("n").alias("n"))
    assert rows(SP.symmetric(h), "lag", "n") == [(-1, 2), (1, 2)]
    e = spark.createDataFrame([(0, 1.0), (0, 1.0)], "seg INT, t DOUBLE")
    assert rows(SP.acg(e, ["seg"], "t", bin_s=0.1, max_lag_s=0.2), "lag", "n") == [(0, 2)]


def test_rhythm_detected(spark):
    rng = np.random.default_rng(7)
    th = np.concatenate([i / 8 + rng.normal(0, 0.012, 2) for i in range(480)])
    tonic = np.cumsum(rng.exponential(0.06, 1000))
    d = spark.createDataFrame([("th", float(t)) for t in th] + [("to", float(t)) for t in tonic], "u STRING, t DOUBLE")
    got = {u: (i, f) for u, i, f in rows(SP.rhythmicity(d, ["u"], ["u"], "t"), "u", "index", "peak_f")}
    assert got["th"][0] >= 5 > got["to"][0] and abs(got["th"][1] - 8) < 0.3


def test_band_phase_of_cosine(spark):
    fs, n = 100.0, 1200
    t = np.arange(n) / fs
    x = np.cos(2 * np.pi * 8 * t)
    d = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(x) if not 600 <= i < 640], "k INT, i LONG, v DOUBLE")
    ph = SP.band_phase(d, ["k"], "i", "v", fs=fs, band=(5.0, 11.0), half=100, bucket=300).filter("segment_id IS NOT NULL")
    got = rows(ph, "i", "phase_rad", "segment_id")
    assert {s for _, _, s in got} == {1, 2}
    err = [abs((p - 2 * np.pi * 8 * i / fs + np.pi) % (2 * np.pi) - np.pi) for i, p, _ in got]
    assert max(err) < 0.05


def test_gaussian_kernels(spark):
    rng = np.random.default_rng(8)
    v = rng.random(12)
    d = spark.createDataFrame([(0, i, float(x), 1.0) for i, x in enumerate(v)], "k INT, bin INT, n DOUBLE, s DOUBLE")
    k = SM.gaussian_kernel(1.3)
    for mode, src in (("wrap", lambda i: i % 12), ("nearest", lambda i: min(max(i, 0), 11)), ("reflect", lambda i: (i % 24) if i % 24 < 12 else 23 - i % 24)):
        want = [sum(w * v[src(t + o)] for o, w in k) for t in range(12)]
        got = [x for _, x in rows(SM.smooth_sum(d, ["k"], "bin", ["n"], k, 12, mode), "bin", "n")]
        assert np.allclose(got, want)


def test_missing_centre_stays_missing(spark):
    d = spark.createDataFrame([(0, 0, 1.0), (0, 1, None), (0, 2, 3.0)], "k INT, bin INT, v DOUBLE")
    assert rows(SM.boxcar_nan(d, ["k"], "bin", "v", 3, 3, circular=False), "bin", "v") == [(0, 1.0), (1, None), (2, 3.0)]


def test_normalize_zero_row(spark):
    d = spark.createDataFrame([(0, 0.0), (0, 0.0), (1, 2.0), (1, None)], "u INT, v DOUBLE")
    assert rows(PR.normalize_max(d, ["u"], "v"), "u", "v") == [(0, 0.0), (0, 0.0), (1, 1.0), (1, None)]


def test_peak_first_on_tie_and_missing(spark):
    d = spark.createDataFrame([(0, 0, 1.0), (0, 1, 3.0), (0, 2, 3.0), (1, 0, None)], "u INT, bin INT, v DOUBLE")
    assert rows(PR.peak_bin(d, ["u"], ["bin"], "v"), "u", "peak_bin") == [(0, 1)]


def test_hd_classes(spark):
    d = spark.createDataFrame([(0, .5, .5, True), (1, .01, .5, True), (2, .01, .01, None), (3, .01, .01, True), (4, None, .01, True)], "u INT, r DOUBLE, s DOUBLE, k BOOLEAN")
    assert rows(T.classify_hd(d, "r", "s", "k"), "u", "hd_class") == [(0, 0), (1, 1), (2, 2), (3, 3), (4, None)]


def test_bh(spark):
    p = [0.01, 0.04, 0.03, 0.2, 0.03]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(p)] + [(9, None)], "i INT, p DOUBLE")
    o = np.argsort(p, kind="stable")
    q = np.minimum.accumulate((np.array(p)[o] * 5 / np.arange(1, 6))[::-1])[::-1]
    want = {int(i): float(x) for i, x in zip(o, q)} | {9: None}
    got = dict(rows(P.bh_fdr(d, [], "p"), "i", "q"))
    assert all(got[i] == (None if want[i] is None else pytest.approx(want[i])) for i in want)


def test_gap_repair_refuses_ambiguity(spark):
    g = spark.createDataFrame([("a", 3, 2, True), ("a", 9, 1, True), ("a", 20, 4, True), ("b", 3, 2, True), ("b", 9, 2, True), ("c", 3, 2, True)], "k STRING, left_edge LONG, change LONG, candidate BOOLEAN")
    need = spark.createDataFrame([("a", 5), ("b", 2), ("c", 7), ("d", 0), ("e", -1)], "k STRING, required INT")
    got = {k: (s, e) for k, s, e in [(r.k, r.status, r.selected_edges) for r in SG.gap_repair_plan(g, need, ["k"]).collect()]}
    assert got["a"] == ("repaired", [9, 20]) and got["b"][0] == "ambiguous" and got["c"][0] == "no_plan" and got["d"][0] == "complete" and got["e"][0] == "extra_transitions"


def test_pulse_group_split(spark):
    st = [0, 10, 20, 30, 40, 200, 400, 410]
    d = spark.createDataFrame([(0, float(s), float(s + 5)) for s in st], "k INT, start_s DOUBLE, end_s DOUBLE")
    assert [x for _, x in rows(SG.classify_pulse_groups(d, ["k"], gap=5, tolerance=1, width=25.0), "start_s", "stage")] == [3, 3, 3, 2, 2, 1, 2, 2]


def test_plateau_example(spark):
    v = [1, 2, 3, 4, 4, 4, 4, 4, 4, 16]
    d = spark.createDataFrame([(0, i, float(x)) for i, x in enumerate(v)], "k INT, i LONG, v DOUBLE")
    assert [x for _, x in rows(SG.distribute_plateau(d, ["k"], "i", "v", width=3.0), "i", "v")] == [1, 2, 3, 4, 6, 8, 11, 13, 16, 16]


def test_planted_boundary_cell(spark):
    rng = np.random.default_rng(9)
    n = 4000
    x, y, hd = rng.uniform(0, 40, n), rng.uniform(0, 40, n), rng.uniform(0, 360, n)
    d = np.array([min([(40 - a) / s if s > 1e-12 else (-a / s if s < -1e-12 else 1e9) for a, s in ((px, math.sin(math.radians(h))), (py, -math.cos(math.radians(h))))]) for px, py, h in zip(x, y, hd)])
    lam = 3 * np.exp(-((d - 5) / 3) ** 2)
    f = spark.createDataFrame([(0, 7, float(a), float(b), float(c), int(k)) for a, b, c, k in zip(x, y, hd, rng.poisson(lam))], "session INT, unit_id INT, x DOUBLE, y DOUBLE, hd DOUBLE, n INT")
    geom = dict(n_theta=60, dist_cm=2.0, n_dist=30, arena=(40.0, 40.0))
    r = E.ego_rates(E.spike_map(f, ["session", "unit_id"], "n", **geom), E.occupancy_map(f, ["session"], 1.0, **geom), ["session"], ["unit_id"])
    th, db = rows(E.distance_peaks(r.filter("occ_s > 20"), ["unit_id"], {"all": (0.0, 60.0)}, 2.0), "theta_bin", "dist_bin")[0]
    assert min(th, 59 - th) <= 5 and 1 <= db <= 3


def test_many_candidates_are_ambiguous_without_overflow(spark):
    from tunefold.operators import signals as S
    g = spark.createDataFrame([(0, i, 1, True) for i in range(70)] + [(1, 5, 2, True), (1, 6, 3, True)], "s INT, left_edge LONG, change INT, candidate BOOLEAN")
    r = spark.createDataFrame([(0, 35), (1, 3), (2, 0), (3, -1), (4, 2)], "s INT, required INT")
    got = {x["s"]: (x["status"], x["n_plans"], x["selected_edges"]) for x in S.gap_repair_plan(g, r, ["s"]).collect()}
    assert got == {0: ("ambiguous", 2, None), 1: ("repaired", 1, [6]), 2: ("complete", 0, None), 3: ("extra_transitions", 0, None), 4: ("no_plan", 0, None)}


def test_text_identities_are_permuted_and_resampled(spark):
    from tunefold.operators import nulls
    p = spark.createDataFrame([("s", f"m:{i}", float(7 * i % 360), float(7 * i % 360 + 3)) for i in range(40)], "g STRING, u STRING, a DOUBLE, b DOUBLE")
    r = nulls.pairing_permutation(p, ["g"], "u", "a", "b", "fisher_lee", n_rep=19).collect()
    assert len(r) == 1 and r[0]["observed"] > 0.9 and r[0]["p"] <= 0.1
    ci = nulls.bootstrap_ci(p, ["g"], "u", "a", "b", "fisher_lee", n_rep=19).collect()[0]
    assert 0.5 < ci["ci_low"] <= ci["ci_high"] <= 1.0 + 1e-9


def test_cells_beyond_two_bytes_stay_apart(spark):
    from tunefold.operators import dense
    d = spark.createDataFrame([(1, 0, 70_000, 1.0), (1, 1, 4_464, 2.0)], "k INT, y INT, x INT, v DOUBLE")
    dim = d.select("k", "y", "x")
    got = sorted((r["y"], r["x"], r["v"]) for r in dense.dense_by_table(d, ["k"], dim, ["k"], ["y", "x"], ["v"], []).collect())
    assert got == [(0, 70_000, 1.0), (1, 4_464, 2.0)]


def test_blocks_of_replicates_equal_rows_of_replicates(spark):
    rng = np.random.default_rng(5)
    tr = [(s, t, t % 2, int(rng.integers(3)), int(rng.integers(5))) for s in (0, 1) for t in range(50)]
    rs = [(s, u, t, float(rng.integers(1, 5))) for s in (0, 1) for u in range(4) for t in range(50) if rng.random() < 0.3]
    trials = spark.createDataFrame(tr, "session INT, trial LONG, stratum INT, y INT, x INT")
    resp = spark.createDataFrame(rs, "session INT, unit INT, trial LONG, response DOUBLE")
    for side in ("greater", "less"):
        one, two = (rows(G.cluster_permutation(resp, trials, ["session"], ["unit"], "trial", ny=3, nx=5, z=1.0, n_rep=70, seed=3, alternative=side, **more)[1], "session", "unit", "component", "size", "p")
                    for more in ({}, {"most_trials": 0}))
        assert one == two and len(one) > 8


def test_shift_sweep_equals_a_plain_loop_in_any_chunks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    frames = [(s, round(float(t), 3), float(a)) for s in (0, 1) for t, a in zip(np.sort(rng.uniform(0, 100, 80)), rng.uniform(0, 360, 80))]
    spikes = [(s, u, round(float(t), 3)) for s in (0, 1) for u in (4, 7) for t in rng.uniform(0, 100, 30)]
    epochs = spark.createDataFrame([(s, 0, 0.0, 100.0) for s in (0, 1)], "session INT, epoch_id LONG, start_s DOUBLE, end_s DOUBLE")
    f, s = spark.createDataFrame(frames, "session INT, t DOUBLE, hd DOUBLE"), spark.createDataFrame(spikes, "session INT, unit INT, t DOUBLE")
    occ = f.groupBy("session", F.floor(F.col("hd") / 30).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("occ_n"))
    run = lambda: {(r["rep"], r["session"], r["unit"]): r["null_mvl"] for r in N.hd_shuffle(s, f, epochs, ["session"], ["unit"], t="t", ft="t", angle="hd", occupancy=occ, n_bins=12, n_rep=40, seed=3, width=30.0).collect()}
    want = {}
    for k in (0, 1):
        ft, fa = (np.array([r[i] for r in frames if r[0] == k]) for i in (1, 2))
        seen = np.bincount((fa // 30).astype(int), minlength=12)
        edges = np.append(0.0, (ft[1:] + ft[:-1]) / 2)
        for u in (4, 7):
            t = np.array([r[2] for r in spikes if r[:2] == (k, u)])
            for rep in range(40):
                draw = int(hashlib.md5(f"3|{rep}|{k}|{u}".encode()).hexdigest()[:8], 16) / 2**32
                b = (fa[np.searchsorted(edges, np.fmod(t + draw * 100.0, 100.0), "right") - 1] // 30).astype(int)
                r = np.bincount(b, minlength=12) / np.maximum(seen, 1)
                want[rep, k, u] = abs((r * np.exp(1j * np.radians((np.arange(12) + 0.5) * 30))).sum()) / r.sum()
    for size in (N.STRETCHES, 9):
        monkeypatch.setattr(N, "STRETCHES", size)
        got = run()
        assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)
