"""Mixing sources to target weights (operator 10), with DataFrame operations only.

The sources form a tree (for documents: domain, language, source). Each node's token budget is divided among
its children by weight, but none gets more than its subtree holds in ``max_epochs`` epochs; what a child
cannot take goes to its siblings by weight, and only what no sibling can take was never given to the parent.
So a shortage is met by siblings first, then by the parent's siblings, and so on. The division has a closed
form: with children sorted by capacity / weight, the first one that is not filled fixes the common rate.

A leaf with ``T`` tokens and budget ``b`` takes every document ``b div T`` times; of the next epoch, in the
seeded order ``md5(seed:epoch:id)``, it takes the longest prefix that still fits. That prefix is a cutoff key:
the order is cut into buckets of hash prefixes, bucket sums find the bucket in which the budget ends, and only
that bucket's rows are put in order. No leaf is ever sorted or held by one task, and texts are never shuffled.

Definitions: a token is a maximal run of characters other than ASCII white space; null texts have none. Null
level values count as the empty string. Rows with one id (null ids included) share a key and enter together.
Leaves without tokens get no budget and are not taken. Nodes of weight 0 or less get nothing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from antecede.llm.common import attached, stored, whole

#: Hexadecimal digits of a hash that name a bucket of the order.
BUCKET_DIGITS = 3
#: Leaves up to which their budgets are sent to every task; beyond it rows are joined to theirs, hot leaves apart.
BROADCAST_LEAVES = 50_000


def word_count(text: Column | str) -> Column:
    return F.regexp_count(whole(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _weight(column: str, weights: Mapping[str, float], default: float) -> Column:
    if not weights:
        return F.lit(float(default))
    table = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))])
    return F.coalesce(F.try_element_at(table, F.col(column)), F.lit(float(default)))


def leaf_budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, float]], budget: Column, max_epochs: int, default_weight: float = 1.0) -> DataFrame:
    """``levels, _tokens, _budget`` from ``levels, _tokens`` (one row a leaf); ``budget`` may use ``_all``, the tokens of all leaves."""
    root = leaves.agg(F.coalesce(F.sum("_tokens"), F.lit(0)).alias("_all"))
    nodes = root.select(budget.cast("double").alias("_given"), (F.col("_all") * max_epochs).cast("double").alias("_most")).select(F.least("_given", "_most").alias("_budget"))
    above: list[str] = []
    for level in levels:
        own = [*above, level]
        children = leaves.groupBy(*own).agg((F.sum("_tokens") * max_epochs).cast("double").alias("_cap")).where("_cap > 0").withColumn("_w", _weight(level, weights.get(level, {}), default_weight)).where("_w > 0")
        parents = nodes.select(*above, F.col("_budget").alias("_b"))
        children = children.join(parents, above) if above else children.crossJoin(parents)  # the root is one row
        among = Window.partitionBy(*above) if above else Window.partitionBy(F.lit(0))
        ranked = among.orderBy(F.col("_cap") / F.col("_w"), level)
        upto = ranked.rowsBetween(Window.unboundedPreceding, 0)
        children = (
            children.withColumn("_k", F.row_number().over(ranked))
            .withColumn("_rate", (F.col("_b") - (F.sum("_cap").over(upto) - F.col("_cap"))) / (F.sum("_w").over(among) - F.sum("_w").over(upto) + F.col("_w")))
            .withColumn("_full", F.col("_cap") / F.col("_w") <= F.col("_rate"))
            .withColumn("_first", F.min(F.when(~F.col("_full"), F.struct("_k", "_rate"))).over(among))
        )
        nodes = children.select(*own, F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("_w") * F.col("_first._rate")).alias("_budget"))
        above = own
    return leaves.join(nodes, list(levels), "left").select(*levels, "_tokens", F.floor(F.coalesce("_budget", F.lit(0.0)) + F.lit(1e-6)).cast("long").alias("_budget"))


def _key(seed: int, id_col: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col("_epoch").cast("string"), F.lit(":"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))


def mix(docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[str, Mapping[str, float]], budget: Column, max_epochs: int = 1, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", default_weight: float = 1.0) -> DataFrame:
    """``docs`` with ``n_tokens``, ``copies`` (how often the mixture takes the row, 0 if never) and the level columns.

    ``levels`` names the tree's levels from the top, each with its expression; ``budget`` may use ``_all``,
    the tokens of the corpus. Columns of ``docs`` that have one of the new names are replaced.
    """
    names = list(levels)
    level_columns = {n: F.coalesce(c.cast("string"), F.lit("")) for n, c in levels.items()}
    slim = docs.select(F.col(id_col), *[c.alias(n) for n, c in level_columns.items()], word_count(text_col).alias("n_tokens"))
    slim = stored(slim, "mixing")
    cutoffs = leaf_cutoffs(slim, names, weights, budget, max_epochs, seed, id_col, default_weight)
    keep = [c for c in docs.columns if c not in {*names, "n_tokens", "copies"}]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], *[c.alias(n) for n, c in level_columns.items()], word_count(text_col).alias("n_tokens"))
    return with_copies(rows, cutoffs, names, seed, id_col)


def mix_slim(docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[str, Mapping[str, float]], budget: Column, max_epochs: int = 1, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", default_weight: float = 1.0) -> DataFrame:
    """``id_col``, the level columns, ``n_tokens`` and ``copies`` of every row, without the texts."""
    slim = docs.select(F.col(id_col), *[F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in levels.items()], word_count(text_col).alias("n_tokens"))
    slim = stored(slim, "mixing")
    return with_copies(slim, leaf_cutoffs(slim, list(levels), weights, budget, max_epochs, seed, id_col, default_weight), list(levels), seed, id_col)


def leaf_cutoffs(slim: DataFrame, names: Sequence[str], weights: Mapping, budget: Column, max_epochs: int, seed: int, id_col: str, default_weight: float = 1.0) -> DataFrame:
    """By leaf: whole epochs taken, and the last key of the epoch in which the budget ends."""
    leaves = slim.groupBy(*names).agg(F.sum("n_tokens").alias("_tokens"))
    given = leaf_budgets(leaves, names, weights, budget, max_epochs, default_weight)
    given = given.withColumn("_epoch", F.when(F.col("_tokens") > 0, F.floor(F.col("_budget") / F.col("_tokens"))).otherwise(0).cast("long")).withColumn("_rest", F.col("_budget") - F.col("_epoch") * F.col("_tokens"))
    given = stored(given.select(*names, "_epoch", "_rest"), "mixing-leaves")
    keyed = attached(slim, given, list(names), BROADCAST_LEAVES).where("_rest > 0").withColumn("_key", _key(seed, id_col)).withColumn("_bucket", F.substring("_key", 1, BUCKET_DIGITS))
    sums = keyed.groupBy(*names, "_bucket").agg(F.sum("n_tokens").alias("_n"), F.first("_rest").alias("_rest"))
    order = Window.partitionBy(*names).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    ending = sums.withColumn("_before", F.sum("_n").over(order) - F.col("_n")).where((F.col("_before") <= F.col("_rest")) & (F.col("_before") + F.col("_n") > F.col("_rest"))).select(*names, "_bucket", "_before")
    ending = stored(ending, "mixing-ends")
    last = keyed.join(ending, [*names, "_bucket"]).withColumn("_upto", F.col("_before") + F.sum("n_tokens").over(Window.partitionBy(*names, "_bucket").orderBy("_key").rangeBetween(Window.unboundedPreceding, 0)))
    last = last.groupBy(*names, "_bucket").agg(F.max(F.when(F.col("_upto") <= F.col("_rest"), F.col("_key"))).alias("_last")).select(*names, F.coalesce("_last", "_bucket").alias("_last"))
    return stored(given.join(last, list(names), "left").select(*names, "_epoch", F.when(F.col("_rest") > 0, F.col("_last")).otherwise("").alias("_last")), "mixing-cutoffs")


def with_copies(rows: DataFrame, cutoffs: DataFrame, names: Sequence[str], seed: int, id_col: str) -> DataFrame:
    joined = attached(rows, cutoffs, list(names), BROADCAST_LEAVES)
    copies = F.coalesce(F.col("_epoch") + (_key(seed, id_col) <= F.col("_last")).cast("long"), F.lit(0).cast("long"))
    return joined.withColumn("copies", copies).select(*[F.col(f"`{c}`") for c in rows.columns], "copies")
