"""Chronological partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from antecede.config import PARTITIONS, SplitConfig


def assign_partition(df: DataFrame, config: SplitConfig, day: str = "day", name: str = "part") -> DataFrame:
    """The first range that holds the row's day; null outside all (rows are never dropped)."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for part, lo, hi in config.ranges:
        out = out.when(F.col(day).between(lo, hi), part)
    return df.withColumn(name, out)


def partition_counts(df: DataFrame, day: str = "day", name: str = "part") -> DataFrame:
    """Rows and first and last day of every partition, empty ones included."""
    literal = df.sparkSession.createDataFrame([(p,) for p in PARTITIONS], f"{name} string")
    found = df.groupBy(name).agg(F.count("*").alias("n_rows"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))
    return literal.join(found, name, "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))


def validate_split(df: DataFrame, config: SplitConfig, id_col: str, day: str = "day", name: str = "part") -> DataFrame:
    """One row: range problems, unassigned rows, empty partitions, ids in several, order of the bounds, validity."""
    counts = partition_counts(df, day, name)
    rank = F.array_position(F.array(*[F.lit(p) for p in PARTITIONS]), F.col(name))
    pairs = counts.where("n_rows > 0").select(rank.alias("k"), "first_day", "last_day").agg(F.sort_array(F.collect_list(F.struct("k", "first_day", "last_day"))).alias("b"))
    ordered = F.forall(F.zip_with(F.slice("b", 1, F.greatest(F.size("b") - 1, F.lit(0))), F.slice("b", 2, F.size("b")), lambda x, y: F.coalesce(x["last_day"] < y["first_day"], F.lit(True))), lambda ok: ok)
    unassigned = df.agg(F.count_if(F.col(name).isNull()).alias("n_unassigned"))
    several = df.groupBy(id_col).agg(F.count_distinct(name).alias("n")).agg(F.count_if(F.col("n") > 1).alias("n_ids_in_several"))
    empty = counts.agg(F.count_if(F.col("n_rows") == 0).alias("n_empty"))
    one = unassigned.crossJoin(several).crossJoin(empty).crossJoin(pairs.select(ordered.alias("chronological")))  # one row each
    bad = len(config.problems())
    return one.withColumn("n_range_problems", F.lit(bad)).withColumn("valid", (F.lit(bad) == 0) & (F.col("n_unassigned") == 0) & (F.col("n_empty") == 0) & (F.col("n_ids_in_several") == 0) & F.col("chronological"))
