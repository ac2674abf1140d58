"""Interval operators: window joins, merging, intersection, concatenated clocks and per-interval summaries."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.angles import col
from .ordered import sequence, islands, halo
from .asof import point_in_interval


def window_join(points: DataFrame, windows: DataFrame, keys: list[str], t: str, *, start: str, end: str,
                widths: tuple[float, ...], closed: str = "left", how: str = "inner") -> DataFrame:
    """All (point, window) hits with start <= t < end; windows may overlap.

    Each window takes the first bucket size that is at least its length (the last size otherwise) and is
    copied to the few buckets it touches; a point has exactly one bucket per size, so no pair repeats.
    closed='both' includes the end.
    """
    ln = F.col(end) - F.col(start)
    lvl = F.lit(len(widths) - 1)
    for i in range(len(widths) - 2, -1, -1):
        lvl = F.when(ln <= widths[i], F.lit(i)).otherwise(lvl)
    sizes = F.array(*[F.lit(float(w)) for w in widths])
    w = windows.withColumn("_lvl", lvl).withColumn("_w", F.element_at(sizes, F.col("_lvl") + 1))
    w = w.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / F.col("_w")).cast("long"),
                                                F.floor(F.col(end) / F.col("_w")).cast("long")))).drop("_w")
    if len(widths) == 1:
        p = points.withColumn("_lvl", F.lit(0)).withColumn("_b", F.floor(F.col(t) / widths[0]).cast("long"))
    else:
        p = points.withColumn("_lvl", F.explode(F.sequence(F.lit(0), F.lit(len(widths) - 1))))
        p = p.withColumn("_b", F.floor(F.col(t) / F.element_at(sizes, F.col("_lvl") + 1)).cast("long"))
    hit = F.col(f"p.{t}") >= F.col(f"w.{start}")
    hit &= (F.col(f"p.{t}") < F.col(f"w.{end}")) if closed == "left" else (F.col(f"p.{t}") <= F.col(f"w.{end}"))
    on = [F.col(f"p.{k}") == F.col(f"w.{k}") for k in [*keys, "_lvl", "_b"]] + [hit]
    j = p.alias("p").join(w.alias("w"), on, "inner")
    return j.select("p.*", *[F.col(f"w.{c}") for c in w.columns if c not in {*points.columns, "_lvl", "_b"}]).drop("_lvl", "_b")


def trial_window_join(spikes: DataFrame, trials: DataFrame, keys: list[str], *, t: str = "t", onset: str = "onset_s",
                      lo: float, hi: float) -> DataFrame:
    """Spikes in [onset+lo, onset+hi) with their lag; the response window is half open."""
    w = trials.withColumn("_ws", F.col(onset) + lo).withColumn("_we", F.col(onset) + hi)
    out = window_join(spikes, w, keys, t, start="_ws", end="_we", widths=(hi - lo,))
    return out.withColumn("lag_s", F.col(t) - F.col(onset)).drop("_ws", "_we")


def merge_intervals(df: DataFrame, keys: list[str], *, start: str = "start_s", end: str = "end_s",
                    gap: float = 0.0, width: float | None = None) -> DataFrame:
    """Union of intervals that touch or overlap (gap up to `gap`)."""
    from .ordered import order_bucket, BUCKET
    # the running maximum of end crosses buckets through the bucket maxima
    if width is None:
        from pyspark.sql import Window
        w = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
        m = df.withColumn("_pm", F.max(end).over(w))
    else:
        from pyspark.sql import Window
        src = df.withColumn(BUCKET, order_bucket(start, width))
        s = src.groupBy(*keys, BUCKET).agg(F.max(end).alias("_bm"))
        ws = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
        s = s.select(*keys, BUCKET, F.max("_bm").over(ws).alias("_xm"))
        w = Window.partitionBy(*keys, BUCKET).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
        m = src.join(s, [*keys, BUCKET]).withColumn("_pm", F.greatest(F.max(end).over(w), F.col("_xm"))).drop(BUCKET, "_xm")
    runs = islands(m, keys, [start, end], F.col("_pm").isNull() | (F.col(start) > F.col("_pm") + gap),
                   width=width, name="merged_id")
    return runs.groupBy(*keys, "merged_id").agg(F.min(start).alias(start), F.max(end).alias(end),
                                                F.count(F.lit(1)).alias("n_merged"))


def intersect_intervals(a: DataFrame, b: DataFrame, keys: list[str], *, start: str = "start_s", end: str = "end_s",
                        width: float) -> DataFrame:
    """Pairwise overlaps of two interval sets; keeps only positive lengths."""
    def cut(df, tag):
        d = df.select(*keys, F.col(start).alias(f"{tag}s"), F.col(end).alias(f"{tag}e"))
        return d.withColumn("_b", F.explode(F.sequence(F.floor(F.col(f"{tag}s") / width).cast("long"),
                                                       F.floor(F.col(f"{tag}e") / width).cast("long"))))
    j = cut(a, "a").join(cut(b, "b"), [*keys, "_b"])
    lo, hi = F.greatest("as", "bs"), F.least("ae", "be")
    j = j.withColumn(start, lo).withColumn(end, hi).filter(F.col(start) < F.col(end))
    # an overlap shows up in every shared bucket; keep the one holding its start
    return j.filter(F.floor(F.col(start) / width).cast("long") == F.col("_b")).select(*keys, start, end)


def keep_sampled(intervals: DataFrame, samples: DataFrame, keys: list[str], t: str, *, start: str = "start_s",
                 end: str = "end_s", widths: tuple[float, ...]) -> DataFrame:
    """Drop intervals without any sample inside [start, end]."""
    tagged = samples.select(*keys, F.col(t).alias("_t"))
    iv = intervals.select(*keys, start, end)
    hit = window_join(tagged, iv, keys, "_t", start=start, end=end, widths=widths, closed="both")
    return hit.groupBy(*keys, start, end).agg(F.count(F.lit(1)).alias("n_samples"))


def epoch_clock(epochs: DataFrame, keys: list[str], *, start: str = "start_s", end: str = "end_s",
                width: float | None = None) -> DataFrame:
    """Offset of every disjoint epoch on the clock made by joining epochs end to end."""
    ln = F.col(end) - F.col(start)
    out = sequence(epochs, keys, [start], width=width, cumsum={"_cum": ln})
    return out.withColumn("clock_start", F.col("_cum") - ln).drop("_cum")


def to_epoch_clock(points: DataFrame, epochs: DataFrame, keys: list[str], t: str, *, id_col: str, width: float,
                   start: str = "start_s", end: str = "end_s") -> DataFrame:
    """Time on the concatenated clock; points outside every epoch are dropped."""
    ec = epoch_clock(epochs, keys, start=start, end=end, width=width)
    from .asof import asof_backward
    hit = asof_backward(points, ec, keys, t, start, [id_col, end, "clock_start"], width=width)
    return (hit.filter(F.col(t) < F.col(end))
            .withColumn("clock_t", F.col("clock_start") + F.col(t) - F.col("sample_t")).drop(end, "sample_t", "clock_start"))


def from_epoch_clock(points: DataFrame, epochs: DataFrame, keys: list[str], clock_t: str, *, width: float,
                     start: str = "start_s", end: str = "end_s") -> DataFrame:
    """Inverse of to_epoch_clock."""
    ec = epoch_clock(epochs, keys, start=start, end=end, width=width)
    from .asof import asof_backward
    hit = asof_backward(points, ec, keys, clock_t, "clock_start", [start], width=width)
    return hit.withColumn("t", F.col(start) + F.col(clock_t) - F.col("sample_t")).drop(start, "sample_t")


def restrict(points: DataFrame, epochs: DataFrame, keys: list[str], t: str, *, id_col: str, width: float) -> DataFrame:
    """Points inside any disjoint epoch."""
    return point_in_interval(points, epochs, keys, t, id_col=id_col, width=width).filter(F.col(id_col).isNotNull())


def interval_means(samples: DataFrame, intervals: DataFrame, keys: list[str], t: str, value: str, *, id_col: str,
                   phase: str, widths: tuple[float, ...]) -> DataFrame:
    """Mean of the finite samples in each inclusive [start,end], then mean and SD of those means per phase."""
    hit = window_join(samples, intervals, keys, t, start="start_s", end="end_s", widths=widths, closed="both")
    per = hit.groupBy(*keys, phase, id_col).agg(F.avg(value).alias("_m"))
    return per.groupBy(*keys, phase).agg(
        F.count("_m").alias("n_intervals"), F.avg("_m").alias("mean"),
        F.when(F.count("_m") > 1, F.stddev_pop("_m")).otherwise(F.lit(0.0)).alias("sd"))


def event_counts(events: DataFrame, intervals: DataFrame, keys: list[str], *, id_col: str, ev_start: str, ev_end: str,
                 mode: str, widths: tuple[float, ...]) -> DataFrame:
    """Events per interval: mode 'start' counts starts inside [start,end), 'overlap' counts any shared time."""
    if mode == "start":
        ev = events.select(*keys, F.col(ev_start).alias("_t"))
        hit = window_join(ev, intervals.select(*keys, id_col, "start_s", "end_s"), keys, "_t",
                          start="start_s", end="end_s", widths=widths)
        n = hit.groupBy(*keys, id_col).agg(F.count(F.lit(1)).alias("n"))
    else:
        w = widths[-1]
        cut = lambda d, s, e: d.withColumn("_b", F.explode(F.sequence(
            F.floor(F.col(s) / w).cast("long"), F.floor(F.col(e) / w).cast("long"))))
        a = cut(intervals.select(*keys, id_col, "start_s", "end_s"), "start_s", "end_s")
        b = cut(events.select(*keys, F.col(ev_start).alias("es"), F.col(ev_end).alias("ee")), "es", "ee")
        j = a.join(b, [*keys, "_b"]).filter((F.col("es") < F.col("end_s")) & (F.col("ee") > F.col("start_s")))
        j = j.filter(F.floor(F.greatest("es", "start_s") / w).cast("long") == F.col("_b"))
        n = j.groupBy(*keys, id_col).agg(F.count(F.lit(1)).alias("n"))
    out = intervals.join(n, [*keys, id_col], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("rate_hz", F.col("n") / (F.col("end_s") - F.col("start_s")))


def split_by_session(rows: DataFrame, sessions: DataFrame, keys: list[str], idx: str, *, width: float) -> DataFrame:
    """Concatenated sample index -> session and local index, given [first, last) ranges."""
    from .asof import asof_backward
    hit = asof_backward(rows, sessions, keys, idx, "first_idx", ["session_name", "last_idx"], width=width)
    return (hit.filter(F.col(idx) < F.col("last_idx"))
            .withColumn("local_idx", (F.col(idx) - F.col("sample_t")).cast("long")).drop("sample_t", "last_idx"))


def window_around(rows: DataFrame, centers: DataFrame, keys: list[str], idx: str, center: str, k: int) -> DataFrame:
    """Rows within +-k positions of each listed index."""
    c = centers.select(*keys, center).withColumn(idx, F.explode(F.sequence(F.col(center) - k, F.col(center) + k)))
    return rows.join(c, [*keys, idx]).withColumn("offset", F.col(idx) - F.col(center))


def segment_by_anchor(pulses: DataFrame, anchors: DataFrame, keys: list[str], t: str, *, label: str, width: float) -> DataFrame:
    """Label of the last anchor at or before each pulse and the pulse's number within that cycle."""
    from .asof import asof_backward
    hit = asof_backward(pulses, anchors, keys, t, "anchor_t", [label], width=width).filter(F.col(label).isNotNull())
    hit = hit.withColumnRenamed("sample_t", "anchor_t")
    return sequence(hit, [*keys, "anchor_t"], [t], width=width, row_number="pulse_no")
