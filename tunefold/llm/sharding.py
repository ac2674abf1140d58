"""Shards by a hierarchical weighted hash tree: region, rack, shard.

A node's weight is a list of increments, one per generation of the layout: generation 0 is the initial tree and every
later change of weight is a generation of its own. At each level a key draws -ln(u) / w for every (node, generation)
increment and follows the smallest draw; below the first level it follows only the nodes whose weight rose in the
generation that won. A raised or added weight therefore draws rows only out of elsewhere into the very shard that
caused it, and no row moves between untouched subtrees, at any level.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import digest_bits

BITS = 52


@dataclass(frozen=True)
class Layout:
    """shards: (generation, shard, weight) increments; a rack holds `per_rack` shards and a region `racks` racks."""

    shards: tuple[tuple[int, int, float], ...]
    per_rack: int = 4
    racks: int = 2

    @staticmethod
    def of(n: int, base: int = 24, weights: dict[int, float] | None = None, per_rack: int = 4, racks: int = 2) -> Layout:
        """`base` shards built together, every further one as a generation of its own, so n -> n + 1 only adds a generation.

        Fewer shards than `base` are one tree; the law of growth then starts at that n.
        """
        if n < 1:
            raise ValueError("at least one shard")
        w = weights or {}
        return Layout(tuple((max(0, s - base + 1), s, float(w.get(s, 1.0))) for s in range(n)), per_rack, racks)

    def path(self, shard: int) -> tuple[int, int, int]:
        rack = shard // self.per_rack
        return rack // self.racks, rack, shard

    def children(self, level: int, parent: tuple[int, int] | None) -> dict[tuple[int, int], float]:
        """(generation, node) -> weight of the increments at a level, below the parent (generation, node) if given."""
        out: dict[tuple[int, int], float] = {}
        for g, s, w in self.shards:
            p = self.path(s)
            if w > 0 and (parent is None or (g, p[level - 1]) == parent):
                out[g, p[level]] = out.get((g, p[level]), 0.0) + w
        return out


LEVELS = ("region", "rack", "shard")


def _descend(key: Column, layout: Layout, seed: str, level: int = 0, parent: tuple[int, int] | None = None) -> Column:
    """Smallest draw among the increments, then the same below the winner. An only child needs no draw."""
    nodes = sorted(layout.children(level, parent).items())
    below = [F.lit(n) if level == 2 else _descend(key, layout, seed, level + 1, (g, n)) for (g, n), _ in nodes]
    if len(nodes) == 1:
        return below[0]
    draws = []
    for i, ((g, n), w) in enumerate(nodes):
        u = (digest_bits(seed, LEVELS[level], str(g), str(n), key, bits=BITS).cast("double") + 0.5) / float(2**BITS)
        draws.append(F.struct((-F.log(u) / w).alias("draw"), F.lit(i).alias("child")))
    won = F.least(*draws)["child"]
    if level == 2:
        return F.element_at(F.array(*below), won + 1)
    out = F.when(won == 0, below[0])
    for i, b in enumerate(below[1:], 1):
        out = out.when(won == i, b)
    return out


def shard_of(key: Column, layout: Layout, seed: str = "s") -> Column:
    """Shard number of a key column. A null key is a key like any other."""
    return _descend(key, layout, seed).cast("int")


def assign(df: DataFrame, layout: Layout, *, id_col: str = "doc_id", text_col: str = "text", grown: Layout | None = None,
           seed: str = "s", spread: int = 1024) -> DataFrame:
    """Rows with id, size, text_crc32, law, shard, slot and grown_shard.

    size is the UTF-8 bytes of the text plus 8; a null text has none and the CRC 0. Slots are numbered from 0 without gaps
    in each shard, by (slice of the key's hash, id, CRC, size). Equal rows are counted first and unfolded last, so a
    repeated or null id is no hot group; a slice holds about 1/(shards * spread) of the distinct rows. Other columns of the
    input are not returned, whatever their names; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("crc"))
    rows = rows.groupBy("id", "size", "crc").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.select("*", shard_of(F.col("id"), layout, seed).alias("shard"), (digest_bits(seed, "slice", F.col("id"), bits=48) % spread).cast("int").alias("slice"),
                       (shard_of(F.col("id"), grown, seed) if grown else F.lit(None).cast("int")).alias("grown_shard"))
    w = Window.partitionBy("shard", "slice").orderBy("id", "crc", "size").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("shard", "slice").agg(F.sum("n").alias("rows"))
    sums = sums.select("shard", "slice", F.coalesce(F.sum("rows").over(Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    out = rows.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).join(sums, ["shard", "slice"])
    first = F.col("base") + F.col("before")
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("key").alias("law"), "shard",
                      F.explode(F.sequence(first, first + F.col("n") - 1)).alias("slot"), "grown_shard")
