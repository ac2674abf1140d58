"""Bucketed sequences equal plain windows whatever the bucket width; as-of ties; interval joins."""
import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from table_rows import rows
from tunefold.operators import asof, intervals as I
from tunefold.operators.ordered import exact_quantile, halo, hash_rank, islands, sequence
from tunefold.functions.hashing import hash_key


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(0)
    t = np.sort(rng.uniform(0, 100, 300)).round(6)
    v = rng.normal(size=300)
    data = [(int(i % 2), float(a), float(b) if i % 5 else None) for i, (a, b) in enumerate(zip(t, v))]
    return spark.createDataFrame(data, "k INT, t DOUBLE, v DOUBLE").cache()


@pytest.mark.parametrize("width", [0.05, 1.0, 7.0, 1000.0])
def test_sequence_equals_window(series, width):
    got = sequence(series, ["k"], ["t"], width=width, lag={"lg": "v"}, lead={"ld": "v"}, cumsum={"cs": "v"}, last={"la": "v"}, nxt={"nx": "v"}, row_number="rn")
    want = sequence(series, ["k"], ["t"], lag={"lg": "v"}, lead={"ld": "v"}, cumsum={"cs": "v"}, last={"la": "v"}, nxt={"nx": "v"}, row_number="rn")
    r = lambda d: rows(d.withColumn("cs", F.round("cs", 9)), "k", "t", "lg", "ld", "cs", "la", "nx", "rn")
    assert r(got) == r(want)


def test_nulls_and_nan_have_one_result_with_and_without_width(spark):
    nan, inf = float("nan"), float("inf")
    data = [(k, t, v) for k in (1, None) for t, v in ((None, 1.0), (0.5, 2.0), (0.7, None), (9.0, 4.0), (nan, 5.0), (-inf, 6.0), (inf, 7.0), (-3.0, 8.0))]
    d = spark.createDataFrame(data, "k INT, t DOUBLE, v DOUBLE")
    how = dict(lag={"lg": "v"}, lead={"ld": "v"}, cumsum={"cs": "v"}, last={"la": "v"}, nxt={"nx": "v"}, row_number="rn")
    show = lambda x: sorted(str(tuple(r)) for r in x.select("k", "t", "v", "lg", "ld", "cs", "la", "nx", "rn").collect())
    want = show(sequence(d, ["k"], ["t"], **how))
    assert len(want) == 16
    for width in (0.3, 2.0, 1e6):
        assert show(sequence(d, ["k"], ["t"], width=width, **how)) == want


def test_events_without_time_or_key_stay_without_a_hit(spark):
    e = spark.createDataFrame([(1, 0.4, "a"), (1, None, "b"), (None, 0.4, "c"), (1, float("nan"), "d"), (2, 9.0, "e")], "k INT, t DOUBLE, n STRING")
    s = spark.createDataFrame([(1, 0.0, 10), (1, None, 11), (None, 0.4, 12), (1, float("nan"), 13), (2, 9.5, 14)], "k INT, ft DOUBLE, v INT")
    got = {r["n"]: r["v"] for r in asof.asof_nearest(e, s, ["k"], "t", "ft", ["v"], tie="earlier", width=0.5).collect()}
    assert got == {"a": 10, "b": None, "c": None, "d": None, "e": 14}


def test_chained_steps_read_their_input_once(spark, sf):
    d = spark.read.parquet(f"{sf}/events.parquet").select("user_id", F.col("event_id").cast("double").alias("t"), "value")
    for i in range(4):
        d = sequence(d, ["user_id"], ["t"], width=50.0, lag={f"lag{i}": "value"}, cumsum={f"sum{i}": "value"})
    d.collect()
    plan = d._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    assert plan.count("FileScan") <= 2


def test_what_follows_is_no_frame_up_to_the_last_row(spark):
    """Spark makes such a frame anew for every row, so a bucket would cost the square of its rows."""
    d = spark.createDataFrame([(0, 1.0, 5.0)], "k INT, t DOUBLE, v DOUBLE")
    for width in (None, 1.0):
        plan = sequence(d, ["k"], ["t"], width=width, nxt={"b": "v"})._jdf.queryExecution().optimizedPlan().toString().lower()
        assert "window" in plan and "unboundedfollowing" not in plan


def test_long_gap_without_rows(spark):
    d = spark.createDataFrame([(0, 1.0, 5.0), (0, 900.0, None), (0, 901.0, None), (0, 5000.0, 7.0)], "k INT, t DOUBLE, v DOUBLE")
    got = sequence(d, ["k"], ["t"], width=1.0, last={"a": "v"}, nxt={"b": "v"})
    assert rows(got, "t", "a", "b") == [(1.0, 5.0, 5.0), (900.0, 5.0, 7.0), (901.0, 5.0, 7.0), (5000.0, 7.0, 7.0)]


def test_hash_rank_is_a_permutation(series):
    d = series.withColumn("i", F.row_number().over(Window.partitionBy("k").orderBy("t"))).withColumn("h", hash_key(3, "k", "i"))
    got = hash_rank(d, ["k"], "h", "r", tie=["i"])
    want = d.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("h", "i")))
    assert rows(got, "k", "i", "r") == rows(want, "k", "i", "r")


@pytest.mark.parametrize("p", [0.0, 0.05, 0.5, 0.99, 1.0])
def test_exact_quantile(series, p):
    a = exact_quantile(series, ["k"], "v", p, "q", width=0.3)
    b = exact_quantile(series, ["k"], "v", p, "q")
    assert [(k, round(q, 9)) for k, q in rows(a, "k", "q")] == [(k, round(q, 9)) for k, q in rows(b, "k", "q")]


def test_halo_equals_range_window(series):
    d = series.withColumn("us", (F.col("t") * 1e6).cast("long"))
    got = halo(d, ["k"], "us", 2_000_000, 3_000_000, {"m": lambda w: F.sum("v").over(w)})
    w = Window.partitionBy("k").orderBy("us").rangeBetween(-2_000_000, 2_000_000)
    want = d.withColumn("m", F.sum("v").over(w))
    r = lambda x: rows(x.withColumn("m", F.round("m", 8)), "k", "us", "m")
    assert r(got) == r(want)


def test_islands(spark):
    d = spark.createDataFrame([(0, float(i), s) for i, s in enumerate("aabbbca")], "k INT, t DOUBLE, s STRING")
    got = islands(d, ["k"], ["t"], F.coalesce(F.col("s") != F.col("p"), F.lit(True)), width=2.0, lag={"p": "s"})
    assert [r for _, r in rows(got, "t", "run_id")] == [1, 1, 2, 2, 2, 3, 4]


@pytest.mark.parametrize("tie,expect", [("earlier", 0.0), ("later", 1.0)])
def test_nearest_tie(spark, tie, expect):
    f = spark.createDataFrame([(0, t, i) for i, t in enumerate([0.0, 1.0, 3.0])], "k INT, ft DOUBLE, id INT")
    s = spark.createDataFrame([(0, t) for t in (-1.0, 0.5, 2.0, 2.1, 4.0, 1.0)], "k INT, t DOUBLE")
    got = dict(rows(asof.asof_nearest(s, f, ["k"], "t", "ft", ["id"], tie=tie, width=0.7), "t", "sample_t"))
    assert got[0.5] == expect and got[-1.0] == 0.0 and got[2.1] == 3.0 and got[4.0] == 3.0 and got[1.0] == 1.0
    assert got[2.0] == (1.0 if tie == "earlier" else 3.0)


def test_no_sample_gives_null(spark):
    f = spark.createDataFrame([(1, 0.0, 0)], "k INT, ft DOUBLE, id INT")
    s = spark.createDataFrame([(0, 1.0)], "k INT, t DOUBLE")
    assert rows(asof.asof_nearest(s, f, ["k"], "t", "ft", ["id"], tie="earlier", width=1.0), "t", "id") == [(1.0, None)]


def test_window_is_half_open(spark):
    s = spark.createDataFrame([(0, 1.05), (0, 0.95), (0, 1.0)], "k INT, t DOUBLE")
    tr = spark.createDataFrame([(0, 1, 1.0)], "k INT, trial INT, onset_s DOUBLE")
    assert rows(I.trial_window_join(s, tr, ["k"], lo=0.0, hi=0.05), "t") == [(1.0,)]


@pytest.mark.parametrize("widths", [(1.0,), (1.0, 10.0), (0.5, 4.0, 64.0)])
def test_window_join_brute(spark, widths):
    rng = np.random.default_rng(1)
    p, s, ln = rng.uniform(0, 50, 80), rng.uniform(0, 50, 40), rng.exponential(5, 40)
    P = spark.createDataFrame([(0, i, float(x)) for i, x in enumerate(p)], "k INT, i INT, t DOUBLE")
    W = spark.createDataFrame([(0, j, float(a), float(a + b)) for j, (a, b) in enumerate(zip(s, ln))], "k INT, j INT, a DOUBLE, b DOUBLE")
    want = sorted((i, j) for i in range(80) for j in range(40) if s[j] <= p[i] < s[j] + ln[j])
    assert rows(I.window_join(P, W, ["k"], "t", start="a", end="b", widths=widths), "i", "j") == want


@pytest.mark.parametrize("width", [None, 0.5, 20.0])
def test_merge_touching(spark, width):
    d = spark.createDataFrame([(0, 0.0, 1.0), (0, 1.0, 2.0), (0, 5.0, 9.0), (0, 6.0, 7.0), (0, 8.5, 8.6), (0, 20.0, 21.0)], "k INT, start_s DOUBLE, end_s DOUBLE")
    assert rows(I.merge_intervals(d, ["k"], width=width), "start_s", "end_s") == [(0.0, 2.0), (5.0, 9.0), (20.0, 21.0)]


def test_clock_map_extrapolates(spark):
    k = spark.createDataFrame([(0, 0.0, 10.0), (0, 1.0, 12.0), (0, 3.0, 13.0)], "k INT, src DOUBLE, dst DOUBLE")
    q = spark.createDataFrame([(0, t) for t in (-1.0, 0.5, 2.0, 5.0)], "k INT, t DOUBLE")
    assert rows(asof.clock_map(q, k, ["k"], "t", src="src", dst="dst", width=0.9), "t", "mapped") == [(-1.0, 8.0), (0.5, 11.0), (2.0, 12.5), (5.0, 14.0)]
