"""Unit position, amplitude, template and waveform summaries."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .ordered import exact_quantile, sequence


def robust_stats(df: DataFrame, keys: list[str], value: str, *, width: float | None = None) -> DataFrame:
    """Median, MAD and IQR per key; the MAD is a second pass with the median joined back."""
    q = {p: exact_quantile(df, keys, value, p, f"q{int(p * 100)}", width=width) for p in (0.25, 0.5, 0.75)}
    med = q[0.5].withColumnRenamed("q50", "median")
    dev = df.join(med, keys).withColumn("_d", F.abs(F.col(value) - F.col("median")))
    mad = exact_quantile(dev, keys, "_d", 0.5, "mad", width=width)
    return med.join(mad, keys).join(q[0.25], keys).join(q[0.75], keys).withColumn("iqr", F.col("q75") - F.col("q25")).drop("q25", "q75")


def position_stats(spikes: DataFrame, keys: list[str], shank: str, coords: list[str], *, width: float | None = None) -> DataFrame:
    """Modal shank (smallest on ties) and robust position per unit."""
    c = spikes.groupBy(*keys, shank).agg(F.count(F.lit(1)).alias("_n"))
    out = c.groupBy(*keys).agg(F.max_by(shank, F.struct(F.col("_n"), -F.col(shank))).alias("shank"), F.sum("_n").alias("n_spikes"))
    for x in coords:
        out = out.join(robust_stats(spikes, keys, x, width=width).select(*keys, *[F.col(k).alias(f"{x}_{k}") for k in ("median", "mad", "iqr")]), keys)
    return out


def template_ptp(templates: DataFrame, keys: list[str], channel: str, value: str) -> DataFrame:
    """Peak-to-peak per channel."""
    return templates.groupBy(*keys, channel).agg((F.max(value) - F.min(value)).alias("ptp"))


def best_channel(ptp: DataFrame, keys: list[str], channel: str) -> DataFrame:
    return ptp.groupBy(*keys).agg(F.max_by(channel, F.struct(F.col("ptp"), -F.col(channel))).alias("best_channel"), F.max("ptp").alias("ptp"))


def unwhiten(templates: DataFrame, mixing: DataFrame, keys: list[str], sample: str) -> DataFrame:
    """Channel-mixing matrix times templates: sum over the input channel."""
    return (templates.join(mixing, "channel").groupBy(*keys, sample, "out_channel").agg(F.sum(F.col("w") * F.col("v")).alias("v")))


def center_of_mass(ptp: DataFrame, contacts: DataFrame, keys: list[str], *, radius: float) -> DataFrame:
    """Amplitude-weighted position over contacts within `radius` of the unit's best channel."""
    best = best_channel(ptp, keys, "channel").select(*keys, F.col("best_channel"))
    b = best.join(contacts.select(F.col("channel").alias("best_channel"), F.col("x").alias("bx"), F.col("y").alias("by")), "best_channel")
    j = ptp.join(contacts, "channel").join(b, keys).filter(F.hypot(F.col("x") - F.col("bx"), F.col("y") - F.col("by")) <= radius)
    return j.groupBy(*keys).agg((F.sum(F.col("ptp") * F.col("x")) / F.sum("ptp")).alias("x_um"), (F.sum(F.col("ptp") * F.col("y")) / F.sum("ptp")).alias("y_um"), F.count(F.lit(1)).alias("n_contacts"))


def stepped_sample(spikes: DataFrame, keys: list[str], t: str, n_max: int, *, width: float) -> DataFrame:
    """At most n_max evenly stepped rows per unit: every ceil(n / n_max)-th in time order."""
    s = sequence(spikes, keys, [t], width=width, row_number="_r")
    n = spikes.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / n_max).alias("_step"))
    return s.join(n, keys).filter((F.col("_r") - 1) % F.col("_step") == 0).drop("_r", "_step")


def spike_triggered_average(spikes: DataFrame, samples: DataFrame, session: list[str], unit: list[str], *, idx: str, value: str, k: int) -> DataFrame:
    """Mean waveform +-k samples around spikes after removing each snippet's median. Spikes carry their sample index."""
    K = [*session, *unit]
    w = spikes.select(*K, "spike_id", F.col(idx).alias("_c")).withColumn(idx, F.explode(F.sequence(F.col("_c") - k, F.col("_c") + k)))
    j = w.join(samples.select(*session, idx, value), [*session, idx]).withColumn("offset", F.col(idx) - F.col("_c"))
    m = F.percentile(value, F.lit(0.5)).over(Window.partitionBy(*K, "spike_id"))  # a snippet has 2k+1 rows
    return j.withColumn("_v", F.col(value) - m).groupBy(*K, "offset").agg(F.avg("_v").alias("mean"), F.count(F.lit(1)).alias("n"))


def dominant_template(spikes: DataFrame, cluster: str, template: str) -> DataFrame:
    """Most frequent template per cluster, smallest id on ties; a cluster without templates keeps its own id."""
    c = spikes.groupBy(cluster, template).agg(F.count(F.lit(1)).alias("_n"))
    g = c.groupBy(cluster).agg(F.max_by(template, F.when(F.col(template).isNotNull(), F.struct(F.col("_n"), -F.col(template)))).alias("_t"))
    return g.select(cluster, F.coalesce("_t", cluster).alias("template_id"))
