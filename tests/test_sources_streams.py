"""Readers on small files and streams fed in several batches."""
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from table_rows import rows
from tunefold.operators import behavior as B, signals as SG, tuning as TU
from tunefold.sources import files as S
from tunefold.streaming import streams as ST


def test_interleaved_int16(spark, tmp_path):
    a = np.arange(40, dtype="<i2").reshape(10, 4)
    a.tofile(tmp_path / "x.bin")
    assert rows(S.scan_interleaved(spark, str(tmp_path / "x.bin"), 4, 2), "sample_idx", "v") == [(i, 4 * i + 2) for i in range(10)]


def test_motive_header(spark, tmp_path):
    (tmp_path / "m.csv").write_text("Format,1.2\n,,body,body\n,,Rot,Pos\nFrame,Time,X,Y\n0,0.0,1.5,2.5\n1,0.1,,3.5\n")
    assert rows(S.read_motive_pose(spark, str(tmp_path / "m.csv"), ["frame", "t_s", "x", "y"]), "frame", "x", "y") == [(0, 1.5, 2.5), (1, None, 3.5)]


def test_catalog(spark, tmp_path):
    d = tmp_path / "rec1"
    d.mkdir()
    (d / "structure.oebin").write_text(json.dumps({"continuous": [{"folder_name": "probe", "sample_rate": 30000.0, "num_channels": 384, "recorded_processor_id": 1}, {"folder_name": "adc", "sample_rate": 30000.0, "num_channels": 8, "recorded_processor_id": 2}]}, indent=1))
    assert rows(S.session_catalog(spark, str(tmp_path)), "recording", "stream_no", "num_channels", "is_probe") == [("rec1", 0, 384, True), ("rec1", 1, 8, False)]


def test_wide_csv_ids_stay_text(spark, tmp_path):
    (tmp_path / "w.csv").write_text("unit_id,-170.0,210.125,-12.5\nm14:260609:B:23,1.0,2.0,NaN\n007,,0.5,1\nNA,3,4,5\n")
    got = S.tc_csv_read(spark, str(tmp_path / "w.csv"))
    assert set(rows(got.select("unit_id").distinct(), "unit_id")) == {("m14:260609:B:23",), ("007",), ("NA",)}
    assert (None,) == [(v,) for u, a, v in rows(got, "unit_id", "angle", "value") if u.startswith("m14") and a == -12.5][0]


def test_overwrite_guard(spark, tmp_path):
    d = spark.createDataFrame([(1, 10.0, 2.0)], "unit_id INT, angle DOUBLE, v DOUBLE")
    p = str(tmp_path / "o")
    S.tc_csv_write(d, p, "unit_id", "angle", "v", [10.0])
    with pytest.raises(Exception):
        S.tc_csv_write(d, p, "unit_id", "angle", "v", [10.0])
    S.tc_csv_write(d, p, "unit_id", "angle", "v", [10.0], overwrite=True)


def test_columnar_document(spark, tmp_path):
    (tmp_path / "t.tc").write_text(json.dumps({"unit_id": [3, 9], "spike_counts": [[1, 2, 0], [0, 0, 5]], "occupancy_time_s": [0.5, 0.0, 2.0]}))
    assert rows(S.columnar_tc_read(spark, str(tmp_path / "t.tc")), "unit_id", "bin", "rate_hz") == [(3, 0, 2.0), (3, 1, None), (3, 2, 0.0), (9, 0, 0.0), (9, 1, None), (9, 2, 2.5)]


def test_content_key_order_free(spark):
    a = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "x INT, y STRING")
    k = lambda d, p={"s": 1}: S.content_key(d, p).collect()[0].key
    assert k(a) == k(a.orderBy(F.desc("x")).repartition(5)) and k(a) != k(a.distinct()) and k(a) != k(a, {"s": 2})


def test_edit_refusal(spark):
    old = spark.createDataFrame([("d", "s", [4, 2], "i")], "date STRING, session_id STRING, delete_frames ARRAY<INT>, interp STRING")
    new = spark.createDataFrame([("d", "s", [2, 7], None, "delete")], "date STRING, session_id STRING, delete_frames ARRAY<INT>, interp STRING, op STRING")
    out, bad = S.session_edit_upsert(old, new)
    assert out.collect()[0].delete_frames == [4, 2] and bad.count() == 1
    out, bad = S.session_edit_upsert(old.withColumn("interp", F.lit(None).cast("string")), new)
    assert out.collect()[0].delete_frames == [4, 2, 7] and bad.count() == 0


def test_gap_exposure(spark):
    f = spark.createDataFrame([(0, i, t, x, 5.0, 0.0, True) for i, (t, x) in enumerate(zip([0.0, .1, .2, 10.0, 10.1, 10.2], [5.0, 6.0, 7.0, 5.0, 6.0, 7.0]))], "session INT, frame_id INT, t DOUBLE, x DOUBLE, y DOUBLE, hd DOUBLE, valid BOOLEAN")
    b = B.prepare(f.withColumn("x", F.col("x").cast("double")), ["session"], arena=(40.0, 40.0), smooth_s=0.0, speed_min=2.5, width=0.25)
    assert sum(e for e, in rows(b, "exposure_s")) == pytest.approx(0.5)
    assert all(s == pytest.approx(10.0) for s, in rows(b, "speed"))


def test_gradient_matches_numpy(spark):
    t = np.array([0, .1, .25, .3, .6, .8])
    x, y = t ** 2, np.sin(t)
    d = spark.createDataFrame([(0, float(a), float(b), float(c)) for a, b, c in zip(t, x, y)], "k INT, t DOUBLE, x DOUBLE, y DOUBLE")
    want = np.hypot(np.gradient(x, t), np.gradient(y, t))
    assert np.allclose([s for _, s in rows(B.gradient_speed(d, ["k"], "t", "x", "y", width=0.2), "t", "speed")], want)


def batches(spark, path, schema, parts):
    """A stream of one file per batch, in the order of parts; times are seconds after 2024."""
    base = 1704067200
    for i, part in enumerate(parts):
        df = spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_seconds(F.col("t") + F.lit(base))).drop("t").coalesce(1)
        df.write.mode("append").parquet(path)
        os.utime(max((os.path.join(path, f) for f in os.listdir(path) if f.endswith(".parquet")), key=os.path.getmtime), (1_700_000_000 + i,) * 2)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_stream_pulses_of_overlapping_batches_equal_the_batch_result(spark, tmp_path):
    rng = np.random.default_rng(1)
    v = [(k, float(i) + k / 10, bool(b)) for k in (0, 1) for i, b in enumerate(rng.random(60) > 0.5)]
    late_first = [[r for r in v if r[1] < 40 and int(r[1]) % 2], [r for r in v if r[1] < 40 and not int(r[1]) % 2] + [(None, 3.0, True), (0, 4.5, None)], [r for r in v if r[1] >= 40], [(1, 1e6, False)]]
    s = batches(spark, str(tmp_path / "src"), "ch INT, t DOUBLE, on BOOLEAN", late_first)
    got = ST.drain(ST.stream_pulses(s, "ch", "ts", "on", late="1 hour"), str(tmp_path / "w"), mode="append")
    all_ = spark.createDataFrame(v + [(1, 1e6, False)], "ch INT, t DOUBLE, on BOOLEAN")
    want = SG.pulses(SG.threshold_edges(all_, ["ch"], "t", F.col("on"), width=7.0), ["ch"], "t", width=7.0)
    to_s = lambda c: F.round((F.col(c) - 1704067200000000) / 1e6, 3).alias(c)
    assert rows(got.select("ch", to_s("start_us"), to_s("end_us")), "ch", "start_us", "end_us") == rows(want.select("ch", F.round("start_s", 3).alias("s"), F.round("end_s", 3).alias("e")), "ch", "s", "e")


def test_rows_behind_the_watermark_do_not_flip_the_level(spark, tmp_path):
    parts = [[(0, 0.0, False), (0, 10.0, True)], [(0, 20.0, False), (0, 90.0, False)], [(0, 5.0, True), (0, 200.0, False)], [(0, 400.0, False)]]
    s = batches(spark, str(tmp_path / "src"), "ch INT, t DOUBLE, on BOOLEAN", parts)
    got = ST.drain(ST.stream_pulses(s, "ch", "ts", "on", late="5 seconds"), str(tmp_path / "w"), mode="append")
    assert [(r.start_us % 10**9, r.end_us % 10**9) for r in got.collect()] == [(10_000_000 + 67200 * 10**6 % 10**9, 20_000_000 + 67200 * 10**6 % 10**9)]


def test_stream_rates_of_overlapping_batches_equal_the_curve(spark, tmp_path):
    rng = np.random.default_rng(2)
    frames = [(k, float(t), float(a)) for k in (0, 1) for t, a in zip(np.sort(rng.choice(4000, 150, replace=False)) + k / 4, rng.random(150) * 360)]
    spikes = [(k, float(t) + 0.5, int(u)) for k in (0, 1) for t, u in zip(rng.choice(4000, 300), rng.integers(0, 3, 300))]
    halves = lambda v: [[r for r in v if int(r[1]) % 3 and r[1] < 2500], [r for r in v if not int(r[1]) % 3 or r[1] >= 2500]]
    last = lambda row: [[row]]
    f = batches(spark, str(tmp_path / "f"), "session INT, t DOUBLE, angle DOUBLE", halves(frames) + last((9, 1e6, 0.0)))
    s = batches(spark, str(tmp_path / "s"), "session INT, t DOUBLE, unit LONG", halves(spikes) + last((9, 1e6, 0)))
    end = lambda d, n: ST.closed(d, str(tmp_path / n), "ts", "session")
    near = ST.drain(ST.stream_nearest(s, f, "session", "ts", "unit", "angle", late="2 hours"), str(tmp_path / "n"), mode="append")
    near.write.parquet(str(tmp_path / "hit"))
    hit = spark.readStream.schema(near.schema).parquet(str(tmp_path / "hit"))
    whole = spark.readStream.schema(spark.read.parquet(str(tmp_path / "f")).schema).parquet(str(tmp_path / "f"))
    w = ST.drain(ST.stream_tuning(end(hit, "h2"), end(whole, "f3"), "session", "ts", "angle", 12, 2.0, window="10 minutes", late="2 hours"), str(tmp_path / "r"), mode="append")
    want = TU.tuning_curve(spark.createDataFrame(spikes, "session INT, t DOUBLE, unit LONG"), spark.createDataFrame(frames, "session INT, t DOUBLE, angle DOUBLE"), ["session"], ["unit"], t="t", ft="t", angle="angle", n=12, fs=2.0, width=600.0)
    cols = ("session", "unit", "bin", "n_spikes", "occ_s", "rate_hz")
    assert rows(ST.rates(w, "session", 12).filter("session < 9"), *cols) == rows(want, *cols) and near.count() == len(spikes)


def test_stream_of_trial_windows_meets_rows_by_stretches_of_time(spark, tmp_path):
    rng = np.random.default_rng(5)
    sp = [(int(k), int(i), float(t)) for i, (k, t) in enumerate(zip(rng.integers(0, 2, 80), rng.integers(0, 400, 80)))] + [(0, 900, None), (None, 901, 5.0)]
    tr = [(int(k), int(i), float(t)) for i, (k, t) in enumerate(zip(rng.integers(0, 2, 25), rng.integers(0, 400, 25)))] + [(0, 950, None)]
    s = batches(spark, str(tmp_path / "s"), "k INT, i INT, t DOUBLE", [sp[::2], sp[1::2]])
    r = batches(spark, str(tmp_path / "r"), "k INT, trial INT, t DOUBLE", [tr[1::2], tr[::2]]).withColumnRenamed("ts", "onset")
    j = ST.stream_trial_counts(s, r, ["k"], "ts", "onset", "'-20' SECOND", "'50' SECOND")
    got = ST.drain(j, str(tmp_path / "w"), mode="append")
    assert got.columns == ["k", "i", "ts", "trial", "onset"]
    want = sorted((i, trial) for k, i, t in sp for k2, trial, o in tr if None not in (k, t, o) and k == k2 and o - 20 <= t < o + 50)
    assert sorted((x["i"], x["trial"]) for x in got.collect()) == want and len(want) > 100
    # rows of one key are told apart by the stretch, in the condition of the join
    assert "_part" in j._jdf.queryExecution().analyzed().toString()
