"""Small cases of the findings of round 4."""
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from table_rows import rows
from tunefold.functions.hashing import Md5
from tunefold.operators import clusters as C, egocentric as E, grid as G, nulls as N
from tunefold.operators.intervals import trial_window_join
from tunefold.sources.files import discover_session_pairs, file_evidence
from tunefold.streaming import streams as ST


def test_md5_of_many_texts():
    texts = ["", "a", "12345", "é", "x" * 40, "x" * 70, *map(str, range(300))]
    for some in (texts, texts[6:], []):
        got = Md5(pa.array(some, pa.string()))
        for head in ("7|0|", "", "7|998|"):
            assert got.after(head).tolist() == [int(hashlib.md5(f"{head}{x}".encode()).hexdigest()[:16], 16) for x in some]


def test_clusters_of_hits_equal_those_of_responses(spark, monkeypatch):
    rng = np.random.default_rng(5)
    trials = spark.createDataFrame([(s, 3 * i + s, float(rng.integers(0, 4000)) / 4, int(rng.integers(2)), int(rng.integers(3)), int(rng.integers(5))) for s in (0, 1) for i in range(150)] + [(0, 999, None, 0, 1, 1)],
                                   "session INT, trial LONG, onset DOUBLE, stratum INT, y INT, x INT")
    spikes = spark.createDataFrame([(s, u, float(t) / 4) for s in (0, 1) for u in range(5) for t in rng.integers(0, 4000, 4 + 3 * u)] + [(0, 1, None), (0, 1, float("nan")), (3, 1, 5.0)], "session INT, unit INT, t DOUBLE")
    hits = trial_window_join(spikes, trials, ["session"], onset="onset", lo=-20.0, hi=60.0)
    resp = hits.groupBy("session", "unit", "trial").agg(F.count(F.lit(1)).cast("double").alias("response"))
    K, shape = ["session"], dict(ny=3, nx=5, z=1.0, n_rep=60, seed=3)
    cols = ["session", "unit", "component", "mass", "size", "p", "significant"]
    fixed = lambda d: rows(d.withColumn("mass", F.round("mass", 9)), *cols)
    for side in ("greater", "less"):
        want = fixed(G.cluster_permutation(resp, trials.drop("onset"), K, ["unit"], "trial", alternative=side, **shape)[1])
        for spikes_of_block, work in ((C.SPIKES, C.WORK), (20, 300)):
            monkeypatch.setattr(C, "SPIKES", spikes_of_block), monkeypatch.setattr(C, "WORK", work)
            got = C.hit_clusters(spikes, trials, K, ["unit"], "trial", t="t", onset="onset", lo=-20.0, hi=60.0, alternative=side, **shape)
            assert fixed(got) == want and len(want) > 12


def test_a_sweep_hands_back_bounded_batches():
    # one batch of 200 units in, bounded ones out: before, all replicates of all units of a batch were held at once
    rng = np.random.default_rng(7)
    unit = [{"_key": {"session": 0, "unit": u}, "_name": f"0|{u}", "_t": sorted(rng.uniform(0, 10, 1 + u % 5).tolist())} for u in range(200)]
    row = {"_left": [0.0, 2.5, 5.0, 7.5], "_bin": [0, 1, -1, 2], "_occ": [2.0, 1.0, 4.0], "_hi": None, "_len": 10.0, "_units": unit}
    kind = pa.struct([("_key", pa.struct([("session", pa.int32()), ("unit", pa.int64())])), ("_name", pa.string()), ("_t", pa.list_(pa.float64()))])
    batch = pa.RecordBatch.from_pylist([row], pa.schema([("_left", pa.list_(pa.float64())), ("_bin", pa.list_(pa.int32())), ("_occ", pa.list_(pa.float64())), ("_hi", pa.float64()), ("_len", pa.float64()), ("_units", pa.list_(kind))]))
    out = list(N._swept([batch], 3, 999, 3, True))
    assert max(b.num_rows for b in out) < N.ROWS + 999 and sum(b.num_rows for b in out) > 10 * N.ROWS
    got = {(r["rep"], r["unit"]): r["_v"] / r["_w"] for b in out[:2] for r in b.to_pylist()}
    z = np.exp(1j * np.radians([60, 180, 300]))
    for rep, u in list(got)[::97]:
        draw = int(hashlib.md5(f"3|{rep}|0|{u}".encode()).hexdigest()[:8], 16) / 2**32
        b = np.array(row["_bin"])[np.searchsorted(row["_left"], np.fmod(np.array(unit[u]["_t"]) + draw * 10.0, 10.0), "right") - 1]
        r = np.bincount(b[b >= 0], minlength=3) / row["_occ"]
        assert abs(got[rep, u] - abs((r * z).sum()) / r.sum()) < 1e-12


def test_poisson_strengths_are_those_of_the_draws(spark):
    u = E.hashed_uniforms("0|1", 20000)
    assert abs(u.mean() - 0.5) < 0.01 and abs(u.var() - 1 / 12) < 0.005 and (u[:7] == E.hashed_uniforms("0|1", 7)).all()
    for mean in (0.0, 0.7, 40.0, 3000.0):
        v = E.poisson_counts(mean, u)
        assert abs(v.mean() - mean) < 0.05 * (1 + mean ** 0.5) and abs(v.var() - mean) < 0.05 * (1 + mean)
    d = spark.createDataFrame([(0, n, f, b, 40, 0.01 * (b + n) if n else 0.001 * b) for n in (0, 1, 2) for f in range(5) for b in range(4)] + [(0, 1, 5, 0, 10, None)], "s INT, u INT, fold INT, bin INT, n INT, l DOUBLE")
    occ = spark.createDataFrame([(0, b, 200 + b) for b in range(4)], "s INT, bin INT, o INT")
    got = {r["u"]: r["null"] for r in E.poisson_strengths(d, ["s", "u"], "bin", "n", "l", occ, ["s"], 4, n_sim=500, seed=3).collect()}
    counts = np.zeros((3, 500, 4))
    for r in E.poisson_null(d, ["s", "u"], ["bin"], "n", "l", n_sim=500, seed=3).collect():
        counts[r["u"], r["sim"], r["bin"]] = r["n"]
    rate = counts / (200 + np.arange(4))
    for k in range(3):
        assert len(got[k]) == 500  # the whole number of simulations, in the row of the unit
        for v, x in zip(got[k], rate[k]):
            assert (v is None) == (x.sum() == 0) and (v is None or abs(v - abs((x * np.exp(1j * np.radians([45, 135, 225, 315]))).sum()) / x.sum()) < 1e-12)
    assert any(v is None for v in got[0])


def test_digests_of_files_that_no_row_holds(spark, tmp_path):
    rng = np.random.default_rng(3)
    data = {"a.bin": rng.bytes(300_000), "b.bin": b"\n\n" + rng.bytes(5000) + b"\r\n", "c.bin": b"\n" * 4001, "d.bin": b"x" * 9000, "f.bin": b"small", "g[1] h.bin": rng.bytes(7000) + b"\n", "i.gz": rng.bytes(6000)}
    for k, v in data.items():
        (tmp_path / k).write_bytes(v)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = file_evidence(spark, str(tmp_path), whole=1000)
        found = {r["file"]: (r["bytes"], r["sha256"]) for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == {k: (len(v), hashlib.sha256(v).hexdigest()) for k, v in data.items()}
    # only small and packed files are values of rows
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 5


def test_streamed_windows_are_counted_by_stretches(spark, tmp_path):
    rng = np.random.default_rng(9)
    sp = [(int(k), float(t)) for k, t in zip(rng.integers(0, 2, 150), rng.integers(0, 400, 150))] + [(0, None), (None, 5.0)]
    tr = [(int(k), i, float(t)) for i, (k, t) in enumerate(zip(rng.integers(0, 2, 40), rng.integers(0, 400, 40)))] + [(0, 950, None), (None, 951, 5.0), (1, 952, 9000.0)]
    when = lambda c: F.timestamp_micros((F.col(c) * 1_000_000).cast("long") + F.lit(1_704_067_200_000_000))
    spark.createDataFrame(sp, "k INT, t DOUBLE").select("k", when("t").alias("ts")).repartition(3).write.parquet(f"{tmp_path}/s")
    spark.createDataFrame(tr, "k INT, trial LONG, t DOUBLE").select("k", "trial", when("t").alias("onset")).repartition(3).write.parquet(f"{tmp_path}/r")
    read = lambda n, schema, ts: ST.closed(spark.readStream.schema(schema).parquet(f"{tmp_path}/{n}"), f"{tmp_path}/end{n}", ts, "k")
    j = ST.stream_window_counts(read("s", "k INT, ts TIMESTAMP", "ts"), read("r", "k INT, trial LONG, onset TIMESTAMP", "onset"), ["k"], "trial", "ts", "onset", "'-20' SECOND", "'50' SECOND", stretch_s=15)
    got = ST.drain(j, f"{tmp_path}/w", mode="append")
    want = {i: sum(o - 20 <= t < o + 50 for k2, t in sp if None not in (k2, t) and k2 == k) for k, i, o in tr if None not in (k, o)}
    assert {r["trial"]: r["n"] for r in got.groupBy("trial").agg(F.sum("n").alias("n")).collect()} == {i: n for i, n in want.items() if n}
    # a row a trial and stretch, not one a hit
    assert got.count() < sum(want.values()) / 2


def test_shared_units_are_counted_by_bits(spark):
    rng = np.random.default_rng(4)
    has = {r: set(rng.choice(300, 4 + 12 * r, replace=False).tolist()) for r in range(14)} | {90: {1, 2, 3}, 91: {1, 2, 3, 299}}
    runs = spark.createDataFrame([(r, "m", "d", r % 3 if r < 90 else 7, "s", "rf" if r % 2 else "ebb", 1.0) for r in has], "run_id INT, mouse STRING, date STRING, probe INT, sort_source STRING, kind STRING, coverage DOUBLE")
    units = spark.createDataFrame([(r, u) for r, x in has.items() for u in [*x, min(x)]] + [(0, None)], "run_id INT, unit_id INT")
    got = discover_session_pairs(runs, units, ("rf", "ebb"))
    group = lambda r: r % 3 if r < 90 else 7
    want = sorted((a, b, len(has[a] & has[b])) for a in has for b in has if a % 2 and not b % 2 and group(a) == group(b) and len(has[a] & has[b]) >= 3)
    assert sorted((r["run_a"], r["run_b"], r["n_shared"]) for r in got.collect()) == want and len(want) > 5
    assert "array_intersect" not in got._jdf.queryExecution().optimizedPlan().toString()
