"""Dense grids without self joins: a unit's bounded cells travel as one map and are laid out in the row."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def cell_code(cell: list[str]) -> Column:
    """One key per cell, whatever the size of its axes."""
    return F.struct(*[F.col(a).cast("long").alias(f"c{i}") for i, a in enumerate(cell)])


def _packed(df: DataFrame, keys: list[str], cell: list[str], values: list[str]) -> DataFrame:
    entry = F.struct(cell_code(cell).alias("k"), F.struct(*values).alias("v"))
    return df.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("_m"))


def dense_fixed(df: DataFrame, keys: list[str], axes: dict[str, int], values: list[str], fill=None) -> DataFrame:
    """Every key with every cell of a fixed grid; absent cells get NULL or `fill`. Cells must be unique per key."""
    d = _packed(df, keys, list(axes), values)
    for a, n in axes.items():
        d = d.withColumn(a, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    hit = F.try_element_at("_m", cell_code(list(axes)))
    pick = lambda v: hit[v] if fill is None else F.coalesce(hit[v], F.lit(fill))
    return d.select(*keys, *axes, *[pick(v).alias(v) for v in values])


def dense_by_table(df: DataFrame, keys: list[str], dim: DataFrame, dim_keys: list[str], cell: list[str], values: list[str], dim_values: list[str], fill=None) -> DataFrame:
    """Every key with every cell its group has in `dim` (for example the visited cells of its session). Cells must be unique per key and group.

    A cell's key is a text: two maps of texts are laid beside each other by a hash table, while one of structs is searched cell by cell.
    """
    code = F.concat_ws(",", *[F.coalesce(F.col(a).cast("long").cast("string"), F.lit("")) for a in cell])
    packed = lambda d, by, cols, name: d.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct(code.alias("k"), F.struct(*cols).alias("v")))).alias(name))
    d = packed(df, keys, values, "_m").join(packed(dim, dim_keys, [*cell, *dim_values], "_g"), dim_keys)
    both = F.map_zip_with("_g", "_m", lambda k, g, m: F.struct(g.alias("c"), m.alias("v")))
    d = d.select(*keys, F.explode(F.map_values(both)).alias("_x")).filter("_x.c IS NOT NULL").select(*keys, "_x.c.*", F.col("_x.v").alias("_v"))
    pick = lambda v: F.col("_v")[v] if fill is None else F.coalesce(F.col("_v")[v], F.lit(fill))
    return d.select(*keys, *cell, *dim_values, *[pick(v).alias(v) for v in values])
