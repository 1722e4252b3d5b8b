"""History before each row: only rows of its group with a strictly smaller ``dt`` count.

Ties never see each other and row order never matters. Where a row's group or ``dt`` is null, its history is
null. ``dt`` must be integral: a RANGE frame that ends at -1 then means "strictly before".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from antecede.functions.columns import require_columns


def _before(group: str, dt: str):
    return Window.partitionBy(group).orderBy(dt).rangeBetween(Window.unboundedPreceding, -1)


def _known(group: str, dt: str, c: Column) -> Column:
    return F.when(F.col(group).isNotNull() & F.col(dt).isNotNull(), c)


def prior_count(df: DataFrame, group: str, dt: str, name: str = "prior_count") -> DataFrame:
    require_columns(df, group, dt)
    return df.withColumn(name, _known(group, dt, (F.rank().over(Window.partitionBy(group).orderBy(dt)) - 1).cast("long")))


def prior_amount_stats(df: DataFrame, group: str, amount: str, dt: str) -> DataFrame:
    """``prior_sum`` (0 without any), ``prior_count`` of non-null amounts, ``prior_mean`` (null without any)."""
    require_columns(df, group, amount, dt)
    w = _before(group, dt)
    total, n = F.coalesce(F.sum(F.col(amount).cast("double")).over(w), F.lit(0.0)), F.coalesce(F.count(amount).over(w), F.lit(0))
    return df.withColumns({"prior_sum": _known(group, dt, total), "prior_count": _known(group, dt, n)}).withColumn("prior_mean", F.when(F.col("prior_count") > 0, F.col("prior_sum") / F.col("prior_count")))


def time_since_last(df: DataFrame, group: str, dt: str, name: str = "time_since_last") -> DataFrame:
    return df.withColumn(name, _known(group, dt, F.col(dt) - F.max(dt).over(_before(group, dt))))


def _median(values: Column) -> Column:
    """Median of a sorted array."""
    n = F.size(values)
    return (F.get(values, F.floor((n - 1) / 2).cast("int")) + F.get(values, F.floor(n / 2).cast("int"))) / 2


def _buckets(df: DataFrame, group: str, dt: str, content: Column, window: int, own: bool = False) -> DataFrame:
    """A row for each (group, dt): the contents and row counts of the latest whole buckets before it (with its ``own``, up to it) that hold
    ``window`` rows at least, or all."""
    if window <= 0:
        raise ValueError("the window must be positive")
    b = df.where(F.col(group).isNotNull() & F.col(dt).isNotNull()).groupBy(group, dt).agg(content.alias("_c_v"), F.count("*").alias("_c_n"))
    order = Window.partitionBy(group).orderBy(dt)
    b = b.withColumn("_c_upto", F.sum("_c_n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # a bucket has a row at least, so `window` buckets are wide enough
    held = F.collect_list(F.struct(F.col("_c_upto").alias("upto"), F.col("_c_n").alias("n"), F.col("_c_v").alias("v"))).over(order.rowsBetween(1 - window, 0) if own else order.rowsBetween(-window, -1))
    upto = F.col("_c_upto") if own else F.col("_c_upto") - F.col("_c_n")
    return b.select(group, dt, F.filter(held, lambda s: upto - s["upto"] < window).alias("_c_w"))


def _back(df: DataFrame, stats: DataFrame, group: str, dt: str) -> DataFrame:
    return df.join(stats, [group, dt], "left").select(*df.columns, *[c for c in stats.columns if c not in (group, dt)])


def windowed_robust_stats(df: DataFrame, group: str, amount: str, dt: str, window: int) -> DataFrame:
    """``prior_median``, ``prior_mad`` (raw) and ``prior_count_in_window`` (rows, null amounts too) over the latest whole buckets."""
    require_columns(df, group, amount, dt)
    return _back(df, _robust(df, group, amount, dt, window), group, dt)


def _robust(df: DataFrame, group: str, amount: str, dt: str, window: int, own: bool = False) -> DataFrame:
    b = _buckets(df, group, dt, F.collect_list(F.col(amount).cast("double")), window, own)
    b = b.withColumn("_c_s", F.array_sort(F.flatten(F.transform("_c_w", lambda s: s["v"])))).withColumn("prior_median", F.when(F.size("_c_s") > 0, _median(F.col("_c_s"))))
    mad = _median(F.array_sort(F.transform("_c_s", lambda x: F.abs(x - F.col("prior_median")))))
    rows = F.aggregate("_c_w", F.lit(0).cast("bigint"), lambda a, s: a + s["n"])
    return b.select(group, dt, "prior_median", F.when(F.size("_c_s") > 0, mad).alias("prior_mad"), rows.alias("prior_count_in_window"))


def windowed_robust_stats_in(df: DataFrame, history: DataFrame, group: str, amount: str, dt: str, window: int) -> DataFrame:
    """As ``windowed_robust_stats``, for rows that only see ``history`` and never each other.

    The statistics are taken once at each (group, dt) of the history; a row has those of the latest one before it.
    """
    require_columns(df, group, dt)
    require_columns(history, group, amount, dt)
    names = ("prior_median", "prior_mad", "prior_count_in_window")
    known = _robust(history, group, amount, dt, window, own=True).select(group, dt, F.struct(*names).alias("_c_s"), F.lit(False).alias("_c_asks"))
    asked = df.where(F.col(group).isNotNull() & F.col(dt).isNotNull()).select(group, dt).distinct().withColumn("_c_asks", F.lit(True))
    found = known.unionByName(asked, allowMissingColumns=True).withColumn("_c_s", F.last("_c_s", ignorenulls=True).over(_before(group, dt))).where("_c_asks")
    n = F.coalesce("_c_s.prior_count_in_window", F.lit(0).cast("bigint")).alias("prior_count_in_window")
    return _back(df, found.select(group, dt, "_c_s.prior_median", "_c_s.prior_mad", n), group, dt)


def prior_distinct_other(df: DataFrame, group: str, other: str, dt: str, name: str = "prior_distinct_other_count") -> DataFrame:
    """Distinct non-null partners strictly before: a partner counts once, where it first occurs."""
    require_columns(df, group, other, dt)
    rows = df.where(F.col(group).isNotNull() & F.col(dt).isNotNull())
    new = rows.where(F.col(other).isNotNull()).groupBy(group, other).agg(F.min(dt).alias(dt)).groupBy(group, dt).agg(F.count("*").alias("_c_new"))
    new = rows.select(group, dt).distinct().join(new, [group, dt], "left")
    w = Window.partitionBy(group).orderBy(dt).rowsBetween(Window.unboundedPreceding, -1)
    return _back(df, new.select(group, dt, F.coalesce(F.sum("_c_new").over(w), F.lit(0)).cast("long").alias(name)), group, dt)


def windowed_distinct_other(df: DataFrame, group: str, other: str, dt: str, window: int) -> DataFrame:
    """``prior_distinct_other_count_in_window`` and ``prior_count_in_window`` over the latest whole buckets."""
    require_columns(df, group, other, dt)
    b = _buckets(df, group, dt, F.collect_set(other), window)
    distinct = F.size(F.array_distinct(F.flatten(F.transform("_c_w", lambda s: s["v"])))).cast("long")
    rows = F.aggregate("_c_w", F.lit(0).cast("bigint"), lambda a, s: a + s["n"])
    return _back(df, b.select(group, dt, distinct.alias("prior_distinct_other_count_in_window"), rows.alias("prior_count_in_window")), group, dt)
