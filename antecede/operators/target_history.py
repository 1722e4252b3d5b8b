"""Smoothed label history: rates from the past only, and only from partitions that a recipient may learn from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from antecede.config import SmoothingConfig
from antecede.operators.causal import prior_amount_stats

#: By recipient, the partitions whose labels it may see; embargoes never.
SOURCES = {"train": ("train",), "validation": ("train", "validation"), "holdout": ("train", "validation", "holdout")}


def prior_over_all(df: DataFrame, dt: str, value: str) -> DataFrame:
    """``dt, _c_sum, _c_count`` of all rows strictly before each ``dt``.

    Distinct times are cut into ranges of equal time; a range's first prefix is the sum over the ranges before it, so
    no task ever gets more than one range's times.
    """
    by_time = df.where(F.col(dt).isNotNull()).groupBy(dt).agg(F.sum(value).cast("long").alias("_s"), F.count(value).alias("_n"))
    span = by_time.agg(F.min(dt).alias("_lo"), F.max(dt).alias("_hi"))
    cut = by_time.crossJoin(F.broadcast(span)).withColumn("_r", F.floor((F.col(dt) - F.col("_lo")) * 256.0 / (F.col("_hi") - F.col("_lo") + 1)).cast("int"))
    ranges = cut.groupBy("_r").agg(F.sum("_s").alias("_rs"), F.sum("_n").alias("_rn"))
    over = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # 256 rows at most
    ranges = ranges.select("_r", F.coalesce(F.sum("_rs").over(over), F.lit(0)).alias("_rs"), F.coalesce(F.sum("_rn").over(over), F.lit(0)).alias("_rn"))
    within = Window.partitionBy("_r").orderBy(dt).rowsBetween(Window.unboundedPreceding, -1)
    part = lambda c: F.coalesce(F.sum(c).over(within), F.lit(0))
    return cut.select(dt, "_r", part("_s").alias("_ws"), part("_n").alias("_wn")).join(ranges, "_r").select(dt, (F.col("_ws") + F.col("_rs")).alias("_c_sum"), (F.col("_wn") + F.col("_rn")).alias("_c_count"))


def prior_target_rate(pool: DataFrame, group: str, dt: str, target: str, config: SmoothingConfig | None = None) -> DataFrame:
    """Adds counts, the raw, global and smoothed prior rates, and whether history is sufficient or missing altogether."""
    c = config or SmoothingConfig()
    own = prior_amount_stats(pool, group, target, dt).withColumnsRenamed({"prior_sum": "_c_fc", "prior_count": "prior_event_count"}).withColumn("prior_target_count", F.col("_c_fc").cast("long")).drop("prior_mean", "_c_fc")
    out = own.join(prior_over_all(pool, dt, target), dt, "left")
    out = out.withColumn("global_rate", F.when(F.col("_c_count") > 0, F.col("_c_sum") / F.col("_c_count")))
    n, y = F.col("prior_event_count"), F.col("prior_target_count")
    return out.withColumns({"raw_rate": F.when(n > 0, y / n), "smoothed_rate": (y + c.k * F.col("global_rate")) / (n + c.k), "sufficient": n >= c.sufficient, "global_cold_start": F.coalesce(F.col("_c_count"), F.lit(0)) == 0}).drop("_c_sum", "_c_count")


def checked_pool(df: DataFrame, part: str, allowed: Sequence[str]) -> DataFrame:
    return df.where(F.col(part).isin(list(allowed)))


def require_sources(pool: DataFrame, part: str, allowed: Sequence[str]) -> None:
    """ValueError if the pool holds a row of another partition (an action)."""
    if not pool.where(~F.coalesce(F.col(part).isin(list(allowed)), F.lit(False))).isEmpty():
        raise ValueError(f"the pool holds rows outside {tuple(allowed)}")


def target_history(df: DataFrame, recipients: Sequence[str], group: str, dt: str, target: str, part: str = "part", config: SmoothingConfig | None = None) -> DataFrame:
    """Each recipient's rows with the history from its own pool."""
    out = None
    for r in recipients:
        one = prior_target_rate(checked_pool(df, part, SOURCES[r]), group, dt, target, config).where(F.col(part) == r)
        out = one if out is None else out.unionByName(one)
    return out
