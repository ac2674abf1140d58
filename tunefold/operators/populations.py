"""Cohort-level tables: categories, counts, coverage, depths and joins with checks."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.angles import col, wrap360


def region_directions(peaks: DataFrame, centers: DataFrame, keys: list[str], region: str) -> DataFrame:
    """One row per response region: unit peak plus region angle, numbered within the unit (a handful of regions)."""
    w = Window.partitionBy(*keys).orderBy(region)
    return centers.join(peaks, keys).withColumn("region_no", F.row_number().over(w)).withColumn(
        "direction_deg", wrap360(F.col("hd_deg") + F.col("rf_deg")))


def population_counts(mask: DataFrame, group: str) -> DataFrame:
    """Units per cell, per group and pooled (pooled rows have a NULL group)."""
    g = mask.groupingSets([[F.col(group), F.col("y"), F.col("x")], [F.col("y"), F.col("x")]], group, "y", "x").agg(
        F.count(F.lit(1)).alias("n_units"))
    return g


def distinct_coverage(mask: DataFrame, keys: list[str]) -> DataFrame:
    """Units per column and per row, each unit counted once."""
    parts = [mask.select(*keys, F.lit(a).alias("axis"), F.col(a).alias("idx")) for a in ("x", "y")]
    return parts[0].unionByName(parts[1]).distinct().groupBy("axis", "idx").agg(F.count(F.lit(1)).alias("n_units"))


def population_category(units: DataFrame, rows: DataFrame, keys: list[str], *, mapped: Column, region: Column, keep: Column) -> DataFrame:
    """Exclusive category per unit: absent, failed_qc, none, one or many regions.

    One pass over all rows: `mapped` and `region` are conditions on a row (a unit is mapped if one of its rows is, its regions
    are counted), `keep` is an aggregate condition on the unit's rows.
    """
    seen = rows.groupBy(*keys).agg(F.bool_or(F.coalesce(mapped, F.lit(False))).alias("_m"), keep.alias("_q"), F.count_if(region).alias("_n"))
    cat = (F.when(~F.coalesce(F.col("_m"), F.lit(False)), "absent").when(~F.coalesce(F.col("_q"), F.lit(False)), "failed_qc")
           .when(F.col("_n") == 0, "none").when(F.col("_n") == 1, "one").otherwise("many"))
    return units.select(*keys).join(seen, keys, "left").select(*keys, cat.alias("category"))


def fraction_summary(units: DataFrame, group: list[str], flags: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Counts and percentages, each flag with its own denominator condition."""
    aggs = []
    for name, (hit, base) in flags.items():
        n, d = F.count_if(hit & base), F.count_if(base)
        aggs += [n.alias(f"{name}_n"), d.alias(f"{name}_of"), F.when(d > 0, 100.0 * n / d).alias(f"{name}_pct")]
    return units.groupBy(*group).agg(*aggs)


def partition_counts(all_units: DataFrame, rows: DataFrame, keys: list[str], in_a: Column, in_b: Column) -> DataFrame:
    """Units only in a, only in b, in both, in none; a unit is in a set if one of its rows meets the set's condition. One pass over all rows."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    seen = rows.groupBy(*keys).agg(F.bool_or(yes(in_a)).alias("_a"), F.bool_or(yes(in_b)).alias("_b"))
    j = all_units.select(*keys).distinct().join(seen, keys, "left")
    A, B = yes(F.col("_a")), yes(F.col("_b"))
    return j.groupBy(F.when(A & B, "both").when(A, "only_a").when(B, "only_b").otherwise("none").alias("part")).agg(F.count(F.lit(1)).alias("n"))


def depth_normalize(units: DataFrame, shank: list[str], y: str) -> DataFrame:
    """Depth below the topmost unit of the shank and fraction of the shank's span.

    Extremes come from an aggregate, so a crowded shank is never one window.
    """
    m = units.groupBy(*shank).agg(F.max(y).alias("_top"), F.min(y).alias("_bot"))
    j = units.join(m, shank)
    span = F.col("_top") - F.col("_bot")
    return j.withColumn("depth_um", F.col("_top") - F.col(y)).withColumn("depth_fraction", F.when(span > 0, (F.col("_top") - F.col(y)) / span)).drop("_top", "_bot")


def depth_summary(units: DataFrame, rec: list[str], shank: str, y: str) -> DataFrame:
    return units.groupBy(*rec, shank).agg(F.count(F.lit(1)).alias("n_units"), F.count(y).alias("n_placed"), (F.max(y) - F.min(y)).alias("span_um"))


def left_checked(a: DataFrame, b: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Left join plus the rows that break the one-to-one rule."""
    dup = b.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return a.join(b, keys, "left"), dup


def subset_violations(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of a that b does not have."""
    return a.select(*keys).distinct().join(b.select(*keys), keys, "left_anti")


def unit_union(lists: list[DataFrame], keys: list[str]) -> DataFrame:
    out = lists[0].select(*keys)
    for d in lists[1:]:
        out = out.unionByName(d.select(*keys))
    return out.distinct()


def range_record(df: DataFrame, group: list[str], value: str, unit: str) -> DataFrame:
    return df.groupBy(*group).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.count_distinct(unit).alias("n_units"))


def basic_stats(df: DataFrame, group: list[str], value: str) -> DataFrame:
    return df.groupBy(*group).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"),
                                  F.percentile(value, F.lit(0.5)).alias("median"), F.stddev_pop(value).alias("sd"))


def pool_on_edge_union(panels: DataFrame, group: list[str], *, lo: str = "lo", hi: str = "hi", value: str = "value") -> DataFrame:
    """Sum of piecewise-constant panels on the union of their edges, as a running sum of jumps over distinct edges."""
    jumps = panels.select(*group, F.explode(F.array(F.struct(F.col(lo).alias("e"), F.col(value).alias("d")),
                                                    F.struct(F.col(hi).alias("e"), (-F.col(value)).alias("d")))).alias("j"))
    e = jumps.groupBy(*group, F.col("j.e").alias("lo")).agg(F.sum("j.d").alias("_d"))
    w = Window.partitionBy(*group).orderBy("lo")
    e = e.withColumn("hi", F.lead("lo").over(w)).withColumn("total", F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.filter("hi IS NOT NULL").drop("_d")


def evidence_table(base: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """Support, stability and significance flags with a conclusion; a missing flag makes it inconclusive."""
    df = base.withColumns(flags)
    cols = [F.col(k) for k in flags]
    anyn = cols[0].isNull()
    allt = F.coalesce(cols[0], F.lit(False))
    for c in cols[1:]:
        anyn, allt = anyn | c.isNull(), allt & F.coalesce(c, F.lit(False))
    return df.withColumn("conclusion", F.when(anyn, "inconclusive").when(allt, "supported").otherwise("not_supported"))


def table_diff(a: DataFrame, b: DataFrame, keys: list[str], value: str, tol: float) -> DataFrame:
    """Cells that differ by more than tol, or exist or are missing on one side only."""
    j = a.select(*keys, F.col(value).alias("left_value"), F.lit(True).alias("_l")).join(
        b.select(*keys, F.col(value).alias("right_value"), F.lit(True).alias("_r")), keys, "full_outer")
    l, r = F.col("left_value"), F.col("right_value")
    same = F.col("_l").eqNullSafe(F.col("_r")) & ((l.isNull() & r.isNull()) | F.coalesce(F.abs(l - r) <= tol, F.lit(False)))
    return j.filter(~same).drop("_l", "_r")
