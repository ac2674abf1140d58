"""Mixing sources to target weights: budgets of tokens down a tree of domains, languages and sources.

A node's budget is shared among its children in proportion to their weights. A child that cannot fill its share is given
what it has, and what is left goes to its siblings in proportion; only if a whole subtree is short does its parent's share
fall and its parent's siblings get more. A leaf's documents are read in seeded epochs, each a new order; its budget is that
many whole epochs and a prefix of the next one. All of it is DataFrame functions; no leaf is sorted as a whole.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stable

LEVELS = ("domain", "lang", "source")
#: Hexadecimal digits of the order's hash that cut a leaf into slices; only the slice with the end of the prefix is sorted.
SLICE = 3
MISSING = "(none)"


def weight_of(column: str, weights: Mapping[str, float] | None) -> Column:
    """Weight of a child by its name; 1 if none is given."""
    if not weights:
        return F.lit(1.0)
    pairs = [F.lit(x) for kv in sorted(weights.items()) for x in (kv[0], float(kv[1]))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(column)), F.lit(1.0))


def shared_out(nodes: DataFrame, parent: Sequence[str], child: str) -> DataFrame:
    """Adds `share` to nodes of (parent, child, cap, weight, budget): the budget of the parent among its children.

    Children in the order of cap / weight are full while the rest of the budget, shared by weight, would fill them.
    """
    key = [*parent] or [F.lit(0)]
    of, order = Window.partitionBy(*key), [F.col("cap") / F.col("weight"), F.col(child)]
    before = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    used, passed = F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    able = nodes.filter(F.col("weight") > 0).withColumns({"__used": used, "__left": F.sum("weight").over(of) - passed})
    able = able.withColumn("__full", F.col("cap") * F.col("__left") <= F.col("weight") * (F.col("budget") - F.col("__used")))
    full = lambda c, is_full: F.coalesce(F.sum(F.when(F.col("__full") == is_full, F.col(c))).over(of), F.lit(0.0))
    share = F.when(F.col("__full"), F.col("cap")).otherwise(F.col("weight") * (F.col("budget") - full("cap", True)) / full("weight", False))
    return able.withColumn("share", share).drop("__used", "__left", "__full")


def budgets(leaves: DataFrame, total: Column, weights: Mapping[str, Mapping[str, float]], levels: Sequence[str] = LEVELS) -> DataFrame:
    """(levels, tokens, budget) of the leaves from (levels, tokens, cap): what each is to give of `total`, from the root down."""
    above = leaves.agg(F.sum("cap").alias("cap")).select(total.cast("double").alias("budget"))
    for depth, child in enumerate(levels, 1):
        parent = levels[: depth - 1]
        nodes = leaves.groupBy(*levels[:depth]).agg(F.sum("cap").cast("double").alias("cap")).withColumn("weight", weight_of(child, weights.get(child)))
        nodes = nodes.join(above, [*parent]) if parent else nodes.crossJoin(above)  # one row at the root
        above = shared_out(nodes, parent, child).select(*levels[:depth], F.col("share").alias("budget"))
    return leaves.join(above, [*levels]).select(*levels, "tokens", F.floor("budget").alias("budget"))


def select(df: DataFrame, *, domain: Column, tokens: Column, weights: Mapping[str, Mapping[str, float]], share: float = 1.0, epochs: int = 1, seed: str = "0",
           id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Rows doc_id, digest (md5 of the text), domain, lang, source, n_tokens, n_rows, taken: how often each document is read.

    The budget is `share` of all tokens; a leaf gives at most `epochs` times its tokens. A document belongs to the prefix
    if the tokens before it are fewer than the leaf's rest, so a leaf exceeds its budget by less than one document. Equal
    rows are one row with n_rows of them. Null domains, languages and sources are one more name, MISSING; a null text has
    no tokens; a leaf without any token is read once. Rows that are not taken are left out; extra columns are not looked
    at; an empty table gives an empty result.
    """
    name = lambda c: F.coalesce(c.cast("string"), F.lit(MISSING))
    rows = df.select(df[id_col].alias("doc_id"), F.md5(F.coalesce(df[text_col], F.lit("")).cast("binary")).alias("digest"), name(domain).alias("domain"), name(df[lang_col]).alias("lang"),
                     name(df[source_col]).alias("source"), F.coalesce(tokens, F.lit(0)).cast("long").alias("n_tokens"))
    # written once: the texts are read once, and no later step is dealt by the leaf, which may hold a third of all rows
    rows = stable(rows.groupBy("doc_id", "digest", *LEVELS, "n_tokens").agg(F.count(F.lit(1)).alias("n_rows")), "rows")
    size = F.col("n_tokens") * F.col("n_rows")
    leaves = stable(rows.groupBy(*LEVELS).agg(F.sum(size).alias("tokens")).withColumn("cap", F.col("tokens") * F.lit(float(epochs))), "leaves")
    plan = budgets(leaves, F.floor(F.col("cap") / epochs * share), weights)
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(1).cast("long")
    plan = stable(plan.withColumn("whole", whole).select(*LEVELS, "whole", (F.col("budget") - F.col("whole") * F.col("tokens")).alias("rest")), "plan")
    order = F.md5(F.concat_ws("|", F.lit(seed), F.col("whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "digest"))
    rows = rows.join(plan, [*LEVELS]).withColumn("order", order).withColumn("slice", F.substring("order", 1, SLICE))
    sums = rows.groupBy(*LEVELS, "slice").agg(F.sum(size).alias("sum"))
    at = Window.partitionBy(*LEVELS).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = stable(sums.select(*LEVELS, "slice", "sum", F.coalesce(F.sum("sum").over(at), F.lit(0)).alias("before")), "slices")
    rows = rows.join(sums, [*LEVELS, "slice"])
    inside = F.col("before") + F.col("sum") < F.col("rest")
    outside = F.col("before") >= F.col("rest")
    sure = rows.filter(inside | outside).withColumn("more", F.when(inside, F.col("n_rows")).otherwise(0))
    w = Window.partitionBy(*LEVELS, "slice").orderBy("order", "doc_id", "domain").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.col("before") - F.coalesce(F.sum(size).over(w), F.lit(0))
    edge = rows.filter(~(inside | outside)).withColumn("left", left)
    some = F.when(F.col("left") <= 0, 0).when(F.col("n_tokens") == 0, F.col("n_rows")).otherwise(F.least(F.col("n_rows"), F.ceil(F.col("left") / F.greatest("n_tokens", F.lit(1)))))
    edge = edge.withColumn("more", some)
    out = ["doc_id", "digest", *LEVELS, "n_tokens", "n_rows", (F.col("whole") * F.col("n_rows") + F.col("more")).cast("long").alias("taken")]
    return sure.select(*out).union(edge.select(*out)).filter("taken > 0")


def words(text: Column) -> Column:
    """Number of words of a text, as its tokens."""
    return F.regexp_count(text, F.lit("[^ \t\n\r]+"))


def family(source: Column) -> Column:
    """Domain of a numbered source: its number's remainder by four; sources without a number are their own domain."""
    n = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    return F.when(n != "", F.concat(F.lit("family"), (F.when(n != "", n).cast("int") % 4).cast("string"))).otherwise("other")


def taken(docs: DataFrame, chosen: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents as often as they are chosen, with their own columns."""
    rows = docs.withColumn("__digest", F.md5(F.coalesce(docs[text_col], F.lit("")).cast("binary")))
    chosen = chosen.groupBy(F.col("doc_id").alias("__id"), F.col("digest").alias("__of")).agg(F.sum("taken").alias("__taken"), F.sum("n_rows").alias("__rows"))
    rows = rows.join(chosen, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__of")))
    nth = F.row_number().over(Window.partitionBy(id_col, "__digest").orderBy(F.lit(0)))
    times = F.floor(F.col("__taken") / F.col("__rows")) + (nth <= F.col("__taken") % F.col("__rows")).cast("long")
    return rows.withColumn("__times", times).filter("__times > 0").withColumn("__n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times")))).select(*[docs[c] for c in docs.columns])
