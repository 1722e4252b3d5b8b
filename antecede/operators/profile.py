"""Summaries of tables: volumes, missingness, duplicates, joins, group sizes, history sufficiency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from antecede.config import SIZE_BUCKETS, SUFFICIENCY_THRESHOLDS, TOP_KS


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def daily_volume(df: DataFrame, day: str) -> DataFrame:
    return df.groupBy(day).agg(F.count("*").alias("n_rows"))


def daily_rate(df: DataFrame, day: str, target: str) -> DataFrame:
    return df.groupBy(day).agg(F.count(target).alias("n_labeled"), F.coalesce(F.sum(target), F.lit(0)).cast("long").alias("n_positive")).withColumn("rate", ratio(F.col("n_positive"), F.col("n_labeled")))


def daily_count_by_group(df: DataFrame, group: str, day: str) -> DataFrame:
    return df.groupBy(group, day).agg(F.count("*").alias("n_rows"))


def daily_amount_stats_by_group(df: DataFrame, group: str, day: str, amount: str) -> DataFrame:
    return df.groupBy(group, day).agg(F.count(amount).alias("n"), F.sum(amount).alias("total"), F.avg(amount).alias("mean"), F.stddev_samp(amount).alias("std"))


def missingness(df: DataFrame) -> DataFrame:
    """Missing values of every column, from one pass."""
    one = df.agg(F.count("*").alias("_c_n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"_c_{k}") for k, c in enumerate(df.columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"_c_{k}").alias("n_missing")) for k, c in enumerate(df.columns)])
    return one.select("_c_n", F.explode(rows).alias("r")).select("r.column_name", "r.n_missing", (ratio(F.col("r.n_missing"), F.col("_c_n")) * 100).alias("pct_missing"))


def duplicate_rows(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """Rows that repeat an earlier one (nulls equal), and their share."""
    return df.groupBy(*subset).agg(F.count("*").alias("_n")).agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n_duplicates"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows")).withColumn("pct_duplicates", F.coalesce(ratio(F.col("n_duplicates"), F.col("n_rows")) * 100, F.lit(0.0)))


def schema_differences(a: DataFrame, b: DataFrame) -> dict[str, list[str]]:
    return {"only_left": sorted({*a.columns} - {*b.columns}), "only_right": sorted({*b.columns} - {*a.columns})}


def join_validation(left: DataFrame, right: DataFrame, id_col: str) -> DataFrame:
    """One row: matched, orphans, repeats of the ids on either side, share matched, cleanness, first 20 orphans."""
    side = lambda df: df.groupBy(id_col).agg(F.count("*").alias("_n"))
    both = side(left).withColumnRenamed("_n", "_l").join(side(right).withColumnRenamed("_n", "_r"), id_col, "full")
    first = both.where("_l IS NULL").select(id_col).orderBy(id_col).limit(20).agg(F.sort_array(F.collect_list(id_col)).alias("first_orphans"))
    counts = both.agg(F.count("_l").alias("n_left_ids"), F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("n_matched"), F.count_if(F.col("_l").isNull()).alias("n_orphans"), F.coalesce(F.sum(F.col("_l") - 1), F.lit(0)).alias("n_left_duplicates"), F.coalesce(F.sum(F.col("_r") - 1), F.lit(0)).alias("n_right_duplicates"))
    out = counts.withColumn("pct_matched", ratio(F.col("n_matched"), F.col("n_left_ids")) * 100).withColumn("is_clean", (F.col("n_orphans") == 0) & (F.col("n_left_duplicates") == 0) & (F.col("n_right_duplicates") == 0))
    return out.crossJoin(first)  # one row each


def size_bucket(size: Column) -> Column:
    out = F.when(size.isNull(), None)
    for lo, hi, name in SIZE_BUCKETS:
        out = out.when(size >= lo if hi is None else size.between(lo, hi), name)
    return out


def group_sizes(df: DataFrame, group: str) -> DataFrame:
    """How many groups have each size."""
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n_groups"))


def rate_by_group_size(df: DataFrame, group: str, target: str) -> DataFrame:
    sized = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("_n"), F.sum(target).alias("_y"), F.count(target).alias("_k"))
    return sized.groupBy(size_bucket(F.col("_n")).alias("bucket")).agg(F.sum("_n").alias("n_rows"), ratio(F.sum("_y"), F.sum("_k")).alias("rate"))


def group_size_summary(df: DataFrame, group: str) -> DataFrame:
    sizes = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("_n"))
    return sizes.agg(F.count("*").alias("n_groups"), F.count_if(F.col("_n") == 1).alias("n_singletons"), F.max("_n").alias("max_size"), F.percentile("_n", 0.5).alias("median_size"))


def shared_key_rates(df: DataFrame, group: str, target: str, min_size: int = 2) -> DataFrame:
    g = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("_n"), F.sum(target).alias("_y"))
    shared = F.col("_n") >= min_size
    part = lambda c, name: [F.coalesce(F.sum(F.when(c, F.col("_n"))), F.lit(0)).alias(f"n_{name}"), ratio(F.sum(F.when(c, F.col("_y"))), F.sum(F.when(c, F.col("_n")))).alias(f"rate_{name}")]
    return g.agg(*part(shared, "shared"), *part(~shared, "single"), *part(F.lit(True), "overall"))


def _shares(count: str) -> list[Column]:
    return [(F.avg(F.when(F.col(count) >= t, 100.0).otherwise(0.0))).alias(f"pct_ge_{t}") for t in SUFFICIENCY_THRESHOLDS]


def sufficiency(df: DataFrame, count: str) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), *_shares(count))


def sufficiency_by(df: DataFrame, count: str, by: str, values: Sequence[str]) -> DataFrame:
    """Sufficiency by partition, listed ones that are empty included."""
    literal = df.sparkSession.createDataFrame([(v,) for v in values], f"{by} string")
    return literal.join(df.groupBy(by).agg(F.count("*").alias("n_rows"), *_shares(count)), by, "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))


def count_distribution(df: DataFrame, count: str) -> DataFrame:
    q = F.percentile(count, F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75, 0.9, 0.99)]))
    return df.agg(F.min(count).alias("min"), q.alias("_q"), F.max(count).alias("max"), F.avg(count).alias("mean")).select("min", *[F.get("_q", F.lit(k)).alias(f"p{p}") for k, p in enumerate((25, 50, 75, 90, 99))], "max", "mean")


def top_groups(df: DataFrame, group: str, most: int) -> DataFrame:
    """The largest groups with their places; equal sizes by name."""
    sizes = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("_size"))
    few = sizes.orderBy(F.desc("_size"), group).limit(most)
    return few.withColumn("_place", F.row_number().over(Window.orderBy(F.desc("_size"), group)))


def dominant_exclusion(df: DataFrame, group: str, count: str, ks: Sequence[int] = TOP_KS) -> DataFrame:
    """Sufficiency without the k largest groups."""
    placed = df.join(F.broadcast(top_groups(df, group, max(ks)).select(group, "_place")), group, "left").withColumn("_place", F.coalesce("_place", F.lit(max(ks) + 1)))
    by_place = placed.groupBy("_place").agg(F.count("*").alias("_n"), *[F.count_if(F.col(count) >= t).alias(f"_t{t}") for t in SUFFICIENCY_THRESHOLDS])
    k = by_place.withColumn("k", F.explode(F.array(*[F.lit(x) for x in ks]))).where(F.col("_place") > F.col("k"))
    return k.groupBy("k").agg(F.sum("_n").alias("n_rows"), *[(ratio(F.sum(f"_t{t}"), F.sum("_n")) * 100).alias(f"pct_ge_{t}") for t in SUFFICIENCY_THRESHOLDS])


def key_verdict(pct_by_key: dict[str, float], least: float = 50.0) -> str:
    """Which of two keys has enough history: the first, the second, neither, or a different strategy where both have."""
    good = [k for k, v in pct_by_key.items() if v is not None and v >= least]
    return "neither" if not good else good[0] if len(good) == 1 else "different_strategy"


def top_k_concentration(df: DataFrame, other: str, ks: Sequence[int] = TOP_KS) -> DataFrame:
    """Share of rows whose value is among the k commonest."""
    total = df.where(F.col(other).isNotNull()).agg(F.count("*").alias("_all"))
    top = top_groups(df, other, max(ks)).withColumn("k", F.explode(F.array(*[F.lit(x) for x in ks]))).where(F.col("_place") <= F.col("k")).groupBy("k").agg(F.sum("_size").alias("n_rows"))
    return top.crossJoin(total).select("k", "n_rows", (ratio(F.col("n_rows"), F.col("_all")) * 100).alias("pct_rows"))  # one row
