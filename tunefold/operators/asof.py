"""As-of joins: attach the nearest, previous or next sample of one stream to each row of another."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .ordered import sequence


def _tagged(events: DataFrame, samples: DataFrame, keys: list[str], et: str, st: str, cols: list[str]) -> DataFrame:
    payload = F.struct(F.col(st).alias("t"), *[F.col(c) for c in cols])
    usable = F.col(st).isNotNull() & ~F.isnan(F.col(st).cast("double"))
    for k in keys:
        usable = usable & F.col(k).isNotNull()
    s = samples.filter(usable).select(*keys, F.col(st).cast("double").alias("_t"), F.lit(0).alias("_kind"),
                       payload.alias("_sample"), F.lit(None).alias("_event"))
    e = events.select(*keys, F.col(et).cast("double").alias("_t"), F.lit(1).alias("_kind"),
                      F.lit(None).alias("_sample"), F.struct(*events.columns).alias("_event"))
    return s.union(e)


def neighbours(events: DataFrame, samples: DataFrame, keys: list[str], et: str, st: str, cols: list[str],
               *, width: float, want_next: bool = True) -> DataFrame:
    """Each event with `_prev` (last sample at or before) and `_next` (first sample after) structs.

    Events without time (NULL or NaN) or with a NULL key stay and have neither; such samples are no one's neighbours.
    """
    both = _tagged(events, samples, keys, et, st, cols)
    spec = {"nxt": {"_next": "_sample"}} if want_next else {}
    seq = sequence(both, keys, ["_t", "_kind"], width=width, last={"_prev": "_sample"}, keep=["_t", "_kind", "_event"], **spec)
    timed = F.col("_t").isNotNull() & ~F.isnan("_t")
    found = [F.when(timed, F.col(c)).alias(c) for c in ("_prev", *(["_next"] if want_next else []))]
    return seq.filter("_kind = 1").select("_event.*", *found)


def asof_nearest(events: DataFrame, samples: DataFrame, keys: list[str], et: str, st: str, cols: list[str],
                 *, tie: str, width: float) -> DataFrame:
    """Nearest sample in time; `tie` ('earlier' or 'later') settles exact midpoints. NULL when there is none."""
    if tie not in ("earlier", "later"):
        raise ValueError("tie must be 'earlier' or 'later'")
    nb = neighbours(events, samples, keys, et, st, cols, width=width)
    dp, dn = F.col(et) - F.col("_prev.t"), F.col("_next.t") - F.col(et)
    later = (dn < dp) if tie == "earlier" else ((dn <= dp) & (dp > 0))
    pick = F.when(F.col("_prev").isNull() | later, F.coalesce("_next", "_prev")).otherwise(F.col("_prev"))
    out = nb.withColumn("_hit", pick)
    keep = [c for c in nb.columns if c not in ("_prev", "_next")]
    return out.select(*keep, F.col("_hit.t").alias("sample_t"), *[F.col(f"_hit.{c}").alias(c) for c in cols])


def asof_backward(events: DataFrame, samples: DataFrame, keys: list[str], et: str, st: str, cols: list[str],
                  *, width: float) -> DataFrame:
    """Last sample at or before each event."""
    nb = neighbours(events, samples, keys, et, st, cols, width=width, want_next=False)
    keep = [c for c in nb.columns if c != "_prev"]
    return nb.select(*keep, F.col("_prev.t").alias("sample_t"), *[F.col(f"_prev.{c}").alias(c) for c in cols])


def within_exposure(df: DataFrame, t: str, left: str = "exposure_left", right: str = "exposure_right") -> DataFrame:
    """Keep assignments that fall inside the sample's own support (closed on both ends)."""
    return df.filter((F.col(t) >= F.col(left)) & (F.col(t) <= F.col(right)))


def point_in_interval(points: DataFrame, intervals: DataFrame, keys: list[str], t: str, *, id_col: str,
                      start: str = "start_s", end: str = "end_s", width: float) -> DataFrame:
    """Disjoint half-open intervals: id of the one holding each point, or NULL."""
    hit = asof_backward(points, intervals, keys, t, start, [id_col, end], width=width)
    return hit.withColumn(id_col, F.when(F.col(t) < F.col(end), F.col(id_col))).drop(end, "sample_t")


def clock_map(queries: DataFrame, knots: DataFrame, keys: list[str], t: str, *, src: str, dst: str,
              width: float, out: str = "mapped") -> DataFrame:
    """Piecewise linear clock conversion; ends extrapolate along the first or last segment."""
    k = sequence(knots.select(*keys, src, dst), keys, [src], width=width,
                 lag={"_ls": src, "_ld": dst}, lead={"_rs": src, "_rd": dst})
    # every knot carries its right segment; the last one repeats its left segment
    k = k.select(*keys, F.col(src).alias("_k"),
                 F.when(F.col("_rs").isNotNull(), F.col(src)).otherwise(F.col("_ls")).alias("s0"),
                 F.when(F.col("_rs").isNotNull(), F.col(dst)).otherwise(F.col("_ld")).alias("d0"),
                 F.coalesce("_rs", src).alias("s1"), F.coalesce("_rd", dst).alias("d1"))
    nb = neighbours(queries, k, keys, t, "_k", ["s0", "d0", "s1", "d1"], width=width)
    seg = F.coalesce("_prev", "_next")
    nb = nb.withColumn("_seg", seg)
    y = F.col("_seg.d0") + (F.col(t) - F.col("_seg.s0")) * (F.col("_seg.d1") - F.col("_seg.d0")) / (
        F.col("_seg.s1") - F.col("_seg.s0"))
    return nb.withColumn(out, y).drop("_prev", "_next", "_seg")
