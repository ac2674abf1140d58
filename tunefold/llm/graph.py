"""Connected components of links, distributed: large-star and small-star steps until nothing changes."""
from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

#: A group with this share of all rows is hot; so there are at most 1 / HOT hot groups.
HOT = 1e-4

from .common import shared_folder


def _kept(edges: DataFrame, step: int) -> tuple[DataFrame, tuple]:
    """The links written to the shared folder, and a fingerprint of the whole set from the same pass."""
    seen = Observation(f"links{step}")
    path = shared_folder(edges.sparkSession, "links")
    edges.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x"),
                  F.coalesce(F.sum(F.shiftright(F.xxhash64("v", "u"), 24)), F.lit(0)).alias("s")).write.parquet(path)
    got = seen.get
    return edges.sparkSession.read.schema(edges.schema).parquet(path), (got["n"], got["x"], got["s"])


def _large(e: DataFrame) -> DataFrame:
    both = e.union(e.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable from every node that has a link and is not itself the smallest.

    Loops and nulls are left out; no links give no rows. The links stay distributed; only counts come to the driver.
    """
    e = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e, mark = _kept(e, 0)
    step = 0
    while mark[0]:
        step += 1
        e, now = _kept(_small(_large(e)), step)
        if now == mark:
            break
        mark = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))


def labelled(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """rows with the columns of their group, null for none (a row without keys has none).

    Groups of `size` above HOT of all rows, at most 1 / HOT of them, are broadcast; their rows then leave the keys for a
    hash of the row's own `id`, so no task of the join gets a whole hot group.
    """
    made = [c for c in groups.columns if c not in keys and c != size]
    hot = groups.filter(F.col(size) > HOT * total)
    as_hot = hot.select(*keys, F.struct(*made).alias("__hot"))
    first = rows.join(F.broadcast(as_hot), keys, "left")
    apart = F.col("__hot").isNotNull() | F.col(keys[0]).isNull()
    spread = [F.when(apart, F.xxhash64(F.lit(k), "id")).otherwise(F.xxhash64(*keys)).alias(f"__k{k}") for k in (0,)]
    first = first.select(*rows.columns, "__hot", apart.alias("__apart"), *spread)
    cold = groups.filter(F.col(size) <= HOT * total).select(*[F.col(k).alias(f"__g_{k}") for k in keys], F.xxhash64(*keys).alias("__k0"), F.struct(*made).alias("__cold"))
    same = ~F.col("__apart")
    for k in keys:
        same = same & (F.col(k) == F.col(f"__g_{k}"))
    both = first.join(cold, (first["__k0"] == cold["__k0"]) & same, "left")
    return both.select(*[F.col(c) for c in rows.columns], *[F.coalesce(F.col(f"__hot.{c}"), F.col(f"__cold.{c}")).alias(c) for c in made])
