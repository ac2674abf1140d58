"""How the given tables play recording roles; every Spark role has a CTE of the same content."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .registry import CTES

EPOCH_US = 1704067200000000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rnd(c, digits: int = 6):
    """Rounded half away from zero on the scaled double, as SQL's round does; Spark's own rounds the shortest decimal text."""
    c = F.col(c) if isinstance(c, str) else c
    scale = F.lit(10.0 ** digits)
    return F.round(c * scale, 0) / scale


def mean_above(c: str, limit: str):
    """avg(c) > limit, a decimal number of up to 4 places. The sum is that of the values' decimal texts (10 places): a sum of doubles that meets the limit exactly would depend on its order."""
    return F.sum(F.col(c).cast("decimal(18,10)")) > F.lit(limit).cast("decimal(8,4)") * F.count(c).cast("decimal(14,0)")


def ev(spark, sf):
    """events with seconds since 2024-01-01, a session of eight and the number in props."""
    e = table(spark, sf, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select(
        "event_id", ((us - F.lit(EPOCH_US)) / F.lit(1e6)).alias("t"), "user_id",
        (F.col("user_id") % 8).cast("int").alias("session"), "event_type", "value",
        F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"))


CTES["r_ev"] = f"""SELECT event_id, (epoch_us(ts) - {EPOCH_US}) / 1e6 AS t, user_id, CAST(user_id % 8 AS INTEGER) AS session,
  event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events"""


def spikes(spark, sf):
    return (ev(spark, sf).filter(F.col("event_type").isin("click", "purchase", "error"))
            .select("session", F.col("user_id").alias("unit_id"), F.col("event_id").alias("spike_id"), "t"))


CTES["r_spikes"] = """SELECT session, user_id AS unit_id, event_id AS spike_id, t FROM r_ev
  WHERE event_type IN ('click', 'purchase', 'error')"""


def frames(spark, sf):
    """Pose samples: heading and position from value and k; low k means a missing pose."""
    return (ev(spark, sf).filter("event_type = 'view'").select(
        "session", F.col("event_id").alias("frame_id"), "t",
        ((F.col("value") * 7.2) % F.lit(360.0)).alias("hd"),
        ((F.col("value") * 10.0) % F.lit(40.0)).alias("x"), (F.col("k") * 0.4).alias("y"),
        (F.col("k") >= 10).alias("valid")))


CTES["r_frames"] = """SELECT session, event_id AS frame_id, t, (value * CAST(7.2 AS DOUBLE)) % CAST(360 AS DOUBLE) AS hd,
  (value * CAST(10 AS DOUBLE)) % CAST(40 AS DOUBLE) AS x, k * CAST(0.4 AS DOUBLE) AS y, k >= 10 AS valid
  FROM r_ev WHERE event_type = 'view'"""


def trials(spark, sf):
    return (ev(spark, sf).filter("event_type = 'signup'").select(
        "session", F.col("event_id").alias("trial_id"), F.col("t").alias("onset_s"),
        (F.col("event_id") % 30).cast("int").alias("x_idx"), (F.col("user_id") % 7).cast("int").alias("y_idx"),
        (F.col("k") % 2).cast("int").alias("luminance")))


CTES["r_trials"] = """SELECT session, event_id AS trial_id, t AS onset_s, CAST(event_id % 30 AS INTEGER) AS x_idx,
  CAST(user_id % 7 AS INTEGER) AS y_idx, CAST(k % 2 AS INTEGER) AS luminance FROM r_ev WHERE event_type = 'signup'"""


def intervals(spark, sf):
    """Possibly overlapping labelled intervals."""
    return (ev(spark, sf).filter("event_type = 'purchase'").select(
        "session", F.col("event_id").alias("interval_id"), F.col("t").alias("start_s"),
        (F.col("t") + F.lit(600.0) + F.col("value") * 60.0).alias("end_s"),
        F.when(F.col("k") % 3 == 0, "baseline").when(F.col("k") % 3 == 1, "light").otherwise("dark").alias("interval_type")))


CTES["r_intervals"] = """SELECT session, event_id AS interval_id, t AS start_s,
  t + CAST(600 AS DOUBLE) + value * CAST(60 AS DOUBLE) AS end_s,
  CASE k % 3 WHEN 0 THEN 'baseline' WHEN 1 THEN 'light' ELSE 'dark' END AS interval_type
  FROM r_ev WHERE event_type = 'purchase'"""

# disjoint epochs: merged intervals numbered in order
CTES["r_epochs"] = """SELECT session, CAST(row_number() OVER (PARTITION BY session ORDER BY min(start_s)) AS BIGINT) AS epoch_id,
   min(start_s) AS start_s, max(end_s) AS end_s FROM (
   SELECT *, sum(brk) OVER (PARTITION BY session ORDER BY start_s, end_s ROWS UNBOUNDED PRECEDING) AS g FROM (
    SELECT *, CASE WHEN start_s <= max(end_s) OVER (PARTITION BY session ORDER BY start_s, end_s
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS brk FROM r_intervals)) GROUP BY session, g"""


def epochs(spark, sf):
    from ..operators.intervals import merge_intervals
    from ..session import cut_lineage
    m = merge_intervals(intervals(spark, sf), ["session"], width=86400.0).withColumnRenamed("merged_id", "epoch_id")
    # a small table many later steps read; keeping its lineage would repeat the merge in each of them
    return cut_lineage(m.select("session", F.col("epoch_id").cast("long").alias("epoch_id"), "start_s", "end_s"))


def resp(spark, sf):
    """Trial responses on a 7 x 30 stimulus grid, one row per unit and presentation."""
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_suppkey").alias("unit_id"), (F.col("l_linenumber") % 7).alias("y"),
                     (F.col("l_partkey") % 30).cast("int").alias("x"), F.col("l_returnflag").alias("stratum"),
                     F.col("l_quantity").alias("response"), F.col("l_linestatus").alias("polarity"),
                     F.rint(F.col("l_discount") * 100).cast("int").alias("t_bin"),
                     F.col("l_orderkey").alias("trial_id"))


CTES["r_resp"] = """SELECT l_suppkey AS unit_id, l_linenumber % 7 AS y, CAST(l_partkey % 30 AS INTEGER) AS x,
  l_returnflag AS stratum, l_quantity AS response, l_linestatus AS polarity,
  CAST(round(l_discount * 100) AS INTEGER) AS t_bin, l_orderkey AS trial_id FROM lineitem"""


def cube(spark, sf):
    """Long response cube: counts per unit, cell and lag bin."""
    return resp(spark, sf).groupBy("unit_id", "y", "x", "t_bin").agg(F.sum("response").cast("long").alias("n"))


CTES["r_cube"] = """SELECT unit_id, y, x, t_bin, CAST(sum(response) AS BIGINT) AS n FROM r_resp GROUP BY ALL"""


def grid(spark, sf):
    """Presentations per cell."""
    return resp(spark, sf).groupBy("y", "x").agg(F.count(F.lit(1)).alias("presentations"))


CTES["r_grid"] = """SELECT y, x, count(*) AS presentations FROM r_resp GROUP BY ALL"""


def angles(spark, sf):
    """Two angle samples per unit and row: a reference and a matched feature, plus an event time in days."""
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_suppkey").alias("unit_id"), (F.col("l_extendedprice") % F.lit(360.0)).alias("hd"),
                     ((F.col("l_extendedprice") * 0.5 + F.col("l_quantity") * 7.0) % F.lit(360.0)).alias("rf"),
                     F.col("l_linenumber").alias("part_no"), F.col("l_linestatus").alias("half"))


CTES["r_angles"] = """SELECT l_suppkey AS unit_id, l_extendedprice % CAST(360 AS DOUBLE) AS hd,
  (l_extendedprice * CAST(0.5 AS DOUBLE) + l_quantity * CAST(7 AS DOUBLE)) % CAST(360 AS DOUBLE) AS rf,
  l_linenumber AS part_no, l_linestatus AS half FROM lineitem"""


def occ(spark, sf, n=30):
    """Exposure per angle bin: every order is a 0.02 s sample."""
    o = table(spark, sf, "orders")
    b = F.floor((F.col("o_totalprice") % F.lit(360.0)) / F.lit(360.0 / n)).cast("int").alias("bin")
    return o.groupBy(b).agg((F.count(F.lit(1)) * 0.02).alias("occ_s"))


CTES["r_occ"] = """SELECT CAST(floor((o_totalprice % CAST(360 AS DOUBLE)) / CAST(12 AS DOUBLE)) AS INTEGER) AS bin,
  count(*) * CAST(0.02 AS DOUBLE) AS occ_s FROM orders GROUP BY 1"""


def curves(spark, sf, n=30):
    """Long tuning curves of two features on a dense unit x bin grid; missing exposure stays NULL."""
    from ..operators.tuning import rate_curve, dense_units
    a = angles(spark, sf)
    long = a.select("unit_id", F.explode(F.array(
        F.struct(F.lit("hd").alias("feature"), F.col("hd").alias("angle")),
        F.struct(F.lit("rf").alias("feature"), F.col("rf").alias("angle")))).alias("f")).select("unit_id", "f.*")
    return rate_curve(long, ["unit_id", "feature"], "angle", occ(spark, sf, n), n)


CTES["r_curves"] = """SELECT u.unit_id, u.feature, o.bin, coalesce(c.n_spikes, 0) AS n_spikes, o.occ_s,
  coalesce(c.n_spikes, 0) / o.occ_s AS rate_hz
  FROM (SELECT DISTINCT unit_id, feature FROM r_angles, (VALUES ('hd'), ('rf')) v(feature)) u CROSS JOIN r_occ o
  LEFT JOIN (SELECT unit_id, feature, CAST(floor(angle / CAST(12 AS DOUBLE)) AS INTEGER) AS bin, count(*) AS n_spikes FROM (
     SELECT unit_id, 'hd' AS feature, hd AS angle FROM r_angles UNION ALL SELECT unit_id, 'rf', rf FROM r_angles) GROUP BY ALL) c
  ON c.unit_id = u.unit_id AND c.feature = u.feature AND c.bin = o.bin"""


def lfp(spark, sf):
    """Three-day totals per priority: a regular trace with gaps where no order fell."""
    o = table(spark, sf, "orders")
    return (o.groupBy(F.col("o_orderpriority").alias("session"),
                      F.floor(F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")) / 3).alias("sample_idx"))
            .agg((F.sum("o_totalprice") / 1000.0).alias("uv"), F.count(F.lit(1)).alias("n")))


CTES["r_lfp"] = """SELECT o_orderpriority AS session, CAST(floor(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) / 3) AS BIGINT) AS sample_idx,
  sum(o_totalprice) / CAST(1000 AS DOUBLE) AS uv, count(*) AS n FROM orders GROUP BY 1, 2"""
