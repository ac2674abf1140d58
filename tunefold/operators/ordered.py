"""Ordered-sequence primitives that survive one very long key.

A plain window puts a whole key into one task. Here every key is cut into order buckets; work inside a
bucket is a normal window, and what must cross a bucket edge (previous row, running total, last valid
value) travels through a small table with one row per non-empty bucket.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.angles import col

BUCKET = "_bucket"
KEY = "_key"


def order_bucket(order_col: str, width: float) -> Column:
    """Bucket of an order value. NULL has the bucket NULL, which sorts first, and NaN the last one, as the values do."""
    x = F.col(order_col)
    return F.when(F.isnan(x.cast("double")), F.lit(2**63 - 1)).otherwise(F.floor(x / F.lit(float(width))).cast("long"))


def _backwards(order: list[str]) -> list[Column]:
    """The same order from its end: what follows a row is then a running value, where a frame up to the last row is made anew for every row."""
    return [F.col(c).desc_nulls_last() for c in order]


def sequence(df: DataFrame, keys: list[str], order: list[str], *, width: float | None = None,
             bucket: Column | None = None, lag=None, lead=None, cumsum=None, last=None, nxt=None,
             row_number: str | None = None, keep_bucket: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Add neighbour, prefix and carry columns in key/order sequence.

    keep: the columns of df that the result needs (all, if not given); others are not shuffled.
    lag / lead: previous / next row's expression. cumsum: inclusive running sum (NULL counts as 0).
    last / nxt: nearest non-NULL value at or before / at or after the row.
    Rows are dealt by keys and bucket once; the summary of the buckets and the rows themselves read that one shuffle,
    so the input is computed once however many steps are chained. NULL keys are a key, NULL orders come first and NaN
    orders last, with and without buckets.
    width cuts order[0] into buckets; bucket gives any other monotone cut. Without either the keys
    must be small groups (bins of a curve) and one window is used.
    """
    lag, lead, cumsum, last, nxt = ({k: col(v) for k, v in (d or {}).items()}
                                    for d in (lag, lead, cumsum, last, nxt))
    if width is None and bucket is None and BUCKET not in df.columns:
        w = Window.partitionBy(*keys).orderBy(*order)
        run = w.rowsBetween(Window.unboundedPreceding, 0)
        fut = Window.partitionBy(*keys).orderBy(*_backwards(order)).rowsBetween(Window.unboundedPreceding, 0)
        out = {k: F.lag(e).over(w) for k, e in lag.items()}
        out |= {k: F.lead(e).over(w) for k, e in lead.items()}
        out |= {k: F.coalesce(F.sum(e).over(run), F.lit(0)) for k, e in cumsum.items()}
        out |= {k: F.last(e, True).over(run) for k, e in last.items()}
        out |= {k: F.last(e, True).over(fut) for k, e in nxt.items()}
        if row_number:
            out[row_number] = F.row_number().over(w)
        return df.withColumns(out).select(*[c for c in df.columns if (keep is None or c in keep) and c not in out], *out)

    if BUCKET not in df.columns:
        b = bucket if bucket is not None else order_bucket(order[0], width)
        df = df.withColumn(BUCKET, b)
    specs = {**lag, **lead, **cumsum, **last, **nxt}
    wanted = [c for c in df.columns if keep is None or c in keep]
    src = df.withColumns({f"_e_{k}": e for k, e in specs.items()}) if specs else df
    # a struct is never NULL itself, so NULL keys and buckets meet in joins as they do in groups
    src = src.select(*dict.fromkeys([*wanted, *keys, *order, BUCKET, *(f"_e_{k}" for k in specs)]))
    src = src.withColumn(KEY, F.struct(*[F.col(k) for k in keys], F.col(BUCKET))).repartition(KEY)
    hashable = [c for c, t in src.dtypes if "map<" not in t]
    ordv = F.struct(*order)
    aggs = []
    for k in lag:
        aggs.append(F.max_by(F.struct(F.col(f"_e_{k}").alias("v")), ordv).alias(f"_s_{k}"))
    for k in lead:
        aggs.append(F.min_by(F.struct(F.col(f"_e_{k}").alias("v")), ordv).alias(f"_s_{k}"))
    for k in cumsum:
        aggs.append(F.sum(f"_e_{k}").alias(f"_s_{k}"))
    for k in last:
        aggs.append(F.max_by(F.col(f"_e_{k}"), F.when(F.col(f"_e_{k}").isNotNull(), ordv)).alias(f"_s_{k}"))
    for k in nxt:
        aggs.append(F.min_by(F.col(f"_e_{k}"), F.when(F.col(f"_e_{k}").isNotNull(), ordv)).alias(f"_s_{k}"))
    if row_number:
        aggs.append(F.count(F.lit(1)).alias(f"_s_{row_number}"))
    # the summary looks at every column (never NULL): both readers of the shuffle then ask for the same one
    seen = F.bit_xor(F.xxhash64(*hashable)).alias("_seen")
    summary = src.groupBy(KEY).agg(*aggs, seen).filter(F.col("_seen").isNotNull())

    ws = Window.partitionBy(*[F.col(f"{KEY}.{k}") for k in keys]).orderBy(F.col(f"{KEY}.{BUCKET}"))
    before = ws.rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*[F.col(f"{KEY}.{k}") for k in keys]).orderBy(F.col(f"{KEY}.{BUCKET}").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    carry = [F.lag(f"_s_{k}").over(ws).alias(f"_x_{k}") for k in lag]
    carry += [F.lead(f"_s_{k}").over(ws).alias(f"_x_{k}") for k in lead]
    carry += [F.coalesce(F.sum(f"_s_{k}").over(before), F.lit(0)).alias(f"_x_{k}")
              for k in list(cumsum) + ([row_number] if row_number else [])]
    carry += [F.last(f"_s_{k}", True).over(before).alias(f"_x_{k}") for k in last]
    carry += [F.last(f"_s_{k}", True).over(after).alias(f"_x_{k}") for k in nxt]
    summary = summary.select(KEY, *carry)

    w = Window.partitionBy(KEY).orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    fut = Window.partitionBy(KEY).orderBy(*_backwards(order)).rowsBetween(Window.unboundedPreceding, 0)
    base = [c for c in wanted if c != BUCKET or keep_bucket]
    joined = src.join(summary, KEY)
    out = []
    for k in lag:
        out.append(F.coalesce(F.lag(F.struct(F.col(f"_e_{k}").alias("v"))).over(w), F.col(f"_x_{k}"))["v"].alias(k))
    for k in lead:
        out.append(F.coalesce(F.lead(F.struct(F.col(f"_e_{k}").alias("v"))).over(w), F.col(f"_x_{k}"))["v"].alias(k))
    for k in cumsum:
        out.append((F.coalesce(F.sum(f"_e_{k}").over(run), F.lit(0)) + F.col(f"_x_{k}")).alias(k))
    for k in last:
        out.append(F.coalesce(F.last(f"_e_{k}", True).over(run), F.col(f"_x_{k}")).alias(k))
    for k in nxt:
        out.append(F.coalesce(F.last(f"_e_{k}", True).over(fut), F.col(f"_x_{k}")).alias(k))
    if row_number:
        out.append((F.row_number().over(w) + F.col(f"_x_{row_number}")).alias(row_number))
    new = set(specs) | ({row_number} if row_number else set())
    return joined.select(*[c for c in base if c not in new], *out)


def islands(df: DataFrame, keys: list[str], order: list[str], breaks, *, width: float | None = None,
            name: str = "run_id", lag=None) -> DataFrame:
    """Run id that grows at every break. `breaks` may use the columns named in `lag`."""
    if lag:
        df = sequence(df, keys, order, width=width, lag=lag, keep_bucket=width is not None)
    out = sequence(df, keys, order, width=width,
                   cumsum={name: F.when(col(breaks), F.lit(1)).otherwise(F.lit(0))})
    return out.drop(BUCKET, *(lag or {}))


def halo(df: DataFrame, keys: list[str], order: str, half: float, width: float, exprs: dict) -> DataFrame:
    """Centred range-window expressions over [x-half, x+half], cut into buckets with copied borders.

    Rows near a bucket edge are copied into the neighbour bucket; only home rows are returned, so the
    result equals one window per key while no task holds more than a bucket and its borders.
    `exprs` maps names to functions of the window spec.
    """
    x = F.col(order)
    lo = F.floor((x - half) / width).cast("long")
    hi = F.floor((x + half) / width).cast("long")
    src = df.withColumn("_home", F.floor(x / width).cast("long"))
    src = src.withColumn(BUCKET, F.explode(F.sequence(lo, hi)))
    w = Window.partitionBy(*keys, BUCKET).orderBy(order).rangeBetween(-half, half)
    return (src.withColumns({k: fn(w) for k, fn in exprs.items()})
            .filter(F.col("_home") == F.col(BUCKET)).drop("_home", BUCKET))


def numbered(df: DataFrame, keys: list[str], ident: str, name: str) -> DataFrame:
    """Row number by an identity, numbers in their order and texts in the order of their hashes, so neither is one bucket."""
    if dict(df.dtypes)[ident] == "string":
        h = df.withColumn("_ih", F.md5(ident))
        return sequence(h, keys, ["_ih", ident], bucket=F.conv(F.substring("_ih", 1, 3), 16, 10).cast("long"), row_number=name).drop("_ih")
    return sequence(df, keys, [ident], bucket=F.floor(F.col(ident) / 65536), row_number=name)


def hash_rank(df: DataFrame, keys: list[str], hash_col: str, name: str, *, spread: int = 2,
              tie: list[str] | None = None) -> DataFrame:
    """Row number by a hex hash, cut by hash prefix so a hot group still spreads over tasks."""
    return sequence(df, keys, [hash_col, *(tie or [])], bucket=F.conv(F.substring(hash_col, 1, spread), 16, 10).cast("long"),
                    row_number=name)


def exact_quantile(df: DataFrame, keys: list[str], value: str, p: float, out: str, *, width: float | None = None) -> DataFrame:
    """Linear-interpolation quantile per key.

    Without `width` this is the built-in percentile, meant for groups of bounded size. With `width` a first
    map-side combined pass counts values per bucket; running counts over that short table say which buckets
    hold the two order statistics, and only the values of those buckets are sorted.
    """
    ok = df.filter(F.col(value).isNotNull())
    if width is None:
        return ok.groupBy(*keys).agg(F.percentile(value, F.lit(p)).alias(out))
    ok = ok.select(*keys, F.col(value).alias("_v"), order_bucket(value, width).alias(BUCKET))
    w = Window.partitionBy(*keys)
    b = ok.groupBy(*keys, BUCKET).agg(F.count(F.lit(1)).alias("_c"))
    b = b.withColumns({"_hi": F.sum("_c").over(w.orderBy(BUCKET)), "_pos": F.lit(p) * (F.sum("_c").over(w) - 1)})
    b = b.withColumn("_lo", F.col("_hi") - F.col("_c"))
    holds = lambda r: (F.col("_lo") <= r) & (r < F.col("_hi"))
    a, z = F.floor("_pos"), F.ceil("_pos")
    target = b.filter(holds(a) | holds(z)).select(*keys, BUCKET, F.col("_lo").alias("_base"), "_pos")
    v = ok.join(target, [*keys, BUCKET]).groupBy(*keys, BUCKET, "_base", "_pos", "_v").agg(F.count(F.lit(1)).alias("_c"))
    v = v.withColumn("_hi", F.col("_base") + F.sum("_c").over(Window.partitionBy(*keys, BUCKET).orderBy("_v"))).withColumn("_lo", F.col("_hi") - F.col("_c"))
    g = v.groupBy(*keys).agg(F.max(F.when(holds(a), F.col("_v"))).alias("_a"), F.max(F.when(holds(z), F.col("_v"))).alias("_z"), F.max("_pos").alias("_p"))
    return g.select(*keys, (F.col("_a") + (F.col("_p") - F.floor("_p")) * (F.col("_z") - F.col("_a"))).alias(out))
