"""Drift, association and evaluation statistics; ties are collapsed to distinct values before anything is ordered."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from antecede.operators.profile import ratio


def running(by_value: DataFrame, value: str, sums: Sequence[str], descending: bool = False) -> DataFrame:
    """Inclusive running sums of ``sums`` over ordered distinct values, as ``_r_*``.

    Values are cut by sampled ranges; each task sums its range after the sums of the ranges before it, so the order
    never passes through one task.
    """
    n = int(by_value.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.desc(value) if descending else F.asc(value)
    placed = by_value.repartitionByRange(n, order).withColumn("_part", F.spark_partition_id()).persist()
    offsets = placed.groupBy("_part").agg(*[F.sum(s).alias(f"_o_{s}") for s in sums])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as partitions
    offsets = offsets.select("_part", *[F.coalesce(F.sum(f"_o_{s}").over(before), F.lit(0)).alias(f"_o_{s}") for s in sums])
    within = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumns({f"_w_{s}": F.sum(s).over(within) for s in sums}).join(F.broadcast(offsets), "_part")
    return summed.withColumns({f"_r_{s}": F.col(f"_w_{s}") + F.col(f"_o_{s}") for s in sums}).drop("_part", *[f"_{p}_{s}" for s in sums for p in "wo"])


def score_metrics(df: DataFrame, score: str, label: str) -> DataFrame:
    """``n_rows, n_positive, roc_auc, average_precision``: exact with ties; null where only one class is there."""
    by = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).alias("_v")).agg(F.sum(F.col(label).cast("long")).alias("_p"), F.count("*").alias("_n"))
    r = running(by, "_v", ["_p", "_n"], descending=True)
    total = by.agg(F.coalesce(F.sum("_p"), F.lit(0)).alias("_P"), F.coalesce(F.sum("_n"), F.lit(0)).alias("_N"))
    neg = F.col("_n") - F.col("_p")
    area = neg * (F.col("_r__p") - F.col("_p") / 2.0)  # positives above, half of the tied ones
    sums = r.agg(F.sum(area).alias("_area"), F.sum(F.col("_p") * F.col("_r__p") / F.col("_r__n")).alias("_ap"))
    both = (F.col("_P") > 0) & (F.col("_N") > F.col("_P"))
    return total.crossJoin(sums).select(F.col("_N").alias("n_rows"), F.col("_P").alias("n_positive"), F.when(both, F.try_divide("_area", F.col("_P") * (F.col("_N") - F.col("_P")))).alias("roc_auc"), F.when(both, F.try_divide("_ap", "_P")).alias("average_precision"))


def ks_statistic(df: DataFrame, value: str, early: Column) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance with means and missing shares of both periods; null distance below two values."""
    flagged = df.withColumn("_e", early)
    by = flagged.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count_if("_e").alias("_a"), F.count_if(~F.col("_e")).alias("_b"))
    r = running(by, "_v", ["_a", "_b"])
    stats = flagged.agg(F.count(F.when(F.col("_e"), F.col(value))).alias("n_early"), F.count(F.when(~F.col("_e"), F.col(value))).alias("n_late"), F.avg(F.when(F.col("_e"), F.col(value))).alias("mean_early"), F.avg(F.when(~F.col("_e"), F.col(value))).alias("mean_late"), (F.avg(F.when(F.col("_e"), F.col(value).isNull().cast("double"))) * 100).alias("pct_missing_early"), (F.avg(F.when(~F.col("_e"), F.col(value).isNull().cast("double"))) * 100).alias("pct_missing_late"))
    gap = r.crossJoin(F.broadcast(stats)).agg(F.max(F.abs(F.try_divide(F.col("_r__a"), F.col("n_early")) - F.try_divide(F.col("_r__b"), F.col("n_late")))).alias("_d"))
    return stats.crossJoin(gap).withColumn("ks_statistic", F.when((F.col("n_early") >= 2) & (F.col("n_late") >= 2), F.col("_d"))).drop("_d")


def ks_p_value(d: float, n: int, m: int) -> float:
    """Asymptotic p-value of the two-sample distance."""
    x = d * math.sqrt(n * m / (n + m))
    return 1.0 if x < 0.2 else min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def chi2_statistic(df: DataFrame, category: str, early: Column, most: int = 20) -> DataFrame:
    """Chi-square of category against period; nulls are one category, all but the ``most`` commonest another. Yates only for 2 x 2."""
    named = df.select(F.coalesce(F.col(category).cast("string"), F.lit("__missing__")).alias("_c"), early.alias("_e"))
    counts = named.groupBy("_c").agg(F.count_if("_e").alias("_a"), F.count_if(~F.col("_e")).alias("_b"))
    top = counts.orderBy(F.desc(F.col("_a") + F.col("_b")), "_c").limit(most).select("_c", F.lit(True).alias("_top"))
    folded = counts.join(top, "_c", "left").groupBy(F.when(F.col("_top"), F.col("_c")).otherwise("__other__").alias("_c")).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    total = folded.agg(F.sum("_a").alias("_all_a"), F.sum("_b").alias("_all_b"), F.count("*").alias("_k"))
    one = folded.crossJoin(F.broadcast(total))
    n = F.col("_all_a") + F.col("_all_b")

    def term(seen: str, period: str) -> Column:
        expected = (F.col("_a") + F.col("_b")) * F.col(period) / n
        gap = F.abs(F.col(seen) - expected)
        return F.try_divide(F.pow(F.when(F.col("_k") == 2, F.greatest(gap - 0.5, F.lit(0.0))).otherwise(gap), 2), expected)

    return one.agg(F.max("_k").alias("n_categories"), F.sum(term("_a", "_all_a") + term("_b", "_all_b")).alias("chi2")).withColumn("df", F.col("n_categories") - 1)


def target_correlation(df: DataFrame, columns: Sequence[str], target: str, eps: float = 1e-12) -> DataFrame:
    """Pearson correlations with the target over rows where both are there; constant columns are left out."""
    one = df.agg(*[x for k, c in enumerate(columns) for x in (F.stddev_pop(c).alias(f"_s{k}"), F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(f"_r{k}"))])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.when(F.col(f"_s{k}") > eps, F.nanvl(f"_r{k}", F.lit(None).cast("double"))).alias("correlation")) for k, c in enumerate(columns)])
    return one.select(F.explode(rows).alias("r")).select("r.column_name", "r.correlation").where("correlation IS NOT NULL")


def missing_blocks(missing: DataFrame, correlations: DataFrame) -> DataFrame:
    """Columns of equal missingness (percent to four places), with their correlations."""
    return missing.join(correlations, "column_name", "left").groupBy(F.round("pct_missing", 4).alias("pct_missing")).agg(F.count("*").alias("n_columns"), F.max(F.abs("correlation")).alias("max_abs"), F.avg(F.abs("correlation")).alias("mean_abs"), F.max_by("column_name", F.struct(F.abs("correlation"), "column_name")).alias("top_column"))


def order_correlation(df: DataFrame, id_col: str, dt: str) -> DataFrame:
    """Spearman correlation of id and time by average ranks, from exact running counts."""
    def ranked(c: str) -> DataFrame:
        by = df.where(F.col(id_col).isNotNull() & F.col(dt).isNotNull()).groupBy(F.col(c).alias(c)).agg(F.count("*").alias("_n"))
        return running(by, c, ["_n"]).select(c, (F.col("_r__n") - (F.col("_n") - 1) / 2.0).alias(f"_rank_{c}"))

    return df.select(id_col, dt).join(ranked(id_col), id_col).join(ranked(dt), dt).agg(F.count("*").alias("n_rows"), F.corr(f"_rank_{id_col}", f"_rank_{dt}").alias("spearman"))


def decile_rates(df: DataFrame, score: str, label: str, parts: int = 10) -> DataFrame:
    """Rows and label rate by exact quantile bucket (right-closed, lowest included, equal edges merged)."""
    edges = F.array_distinct(F.percentile(score, F.array(*[F.lit(k / parts) for k in range(parts + 1)])))
    cut = df.where(F.col(score).isNotNull())
    one = cut.agg(edges.alias("_edges"))
    placed = cut.crossJoin(F.broadcast(one)).withColumn("bucket", F.greatest(F.size(F.filter("_edges", lambda e: e < F.col(score))) - 1, F.lit(0)))
    return placed.groupBy("bucket").agg(F.count("*").alias("n_rows"), ratio(F.sum(label), F.count(label)).alias("rate"))


def bucket_rates(df: DataFrame, bucket: Column, label: str, n_buckets: int) -> DataFrame:
    """Rows and label rate by fixed bucket, empty ones included."""
    literal = df.sparkSession.range(n_buckets).select(F.col("id").cast("int").alias("bucket"))
    found = df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n_rows"), ratio(F.sum(label), F.count(label)).alias("rate"))
    return literal.join(found, "bucket", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))


def summary_by(df: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """Mean, sample deviation and share missing by partition and column, from one aggregation."""
    one = df.groupBy(by).agg(F.count("*").alias("_n"), *[x for k, c in enumerate(columns) for x in (F.avg(c).alias(f"_m{k}"), F.stddev_samp(c).alias(f"_s{k}"), F.count(c).alias(f"_c{k}"))])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"_m{k}").alias("mean"), F.col(f"_s{k}").alias("std"), ((F.col("_n") - F.col(f"_c{k}")) * 100.0 / F.col("_n")).alias("pct_missing")) for k, c in enumerate(columns)])
    return one.select(by, F.explode(rows).alias("r")).select(by, "r.*")
