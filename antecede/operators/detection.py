"""Behavioural change: a row's log amount against the robust statistics of its group's latest history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from antecede.config import DetectionConfig
from antecede.functions.columns import log1p_amount
from antecede.operators.causal import windowed_robust_stats, windowed_robust_stats_in
from antecede.operators.profile import ratio
from antecede.operators.stats import score_metrics

FLAGS = ("insufficient_history", "zero_mad", "scored_normal", "scored_outlier")


def behavior_score(df: DataFrame, group: str, amount: str, dt: str, config: DetectionConfig | None = None, history: DataFrame | None = None) -> DataFrame:
    """Adds ``amt_log1p``, the window's statistics, ``modified_zscore`` (null unless scored) and ``flag``; the window is over ``df`` itself or a given history."""
    c = config or DetectionConfig()
    out = df.withColumn("amt_log1p", log1p_amount(amount))
    if history is None:
        out = windowed_robust_stats(out, group, "amt_log1p", dt, c.window)
    else:
        out = windowed_robust_stats_in(out, history.withColumn("amt_log1p", log1p_amount(amount)), group, "amt_log1p", dt, c.window)
    short = F.coalesce(F.col("prior_count_in_window"), F.lit(0)) < c.min_history
    flat = F.col("prior_mad").isNull() | (F.col("prior_mad") <= c.zero_mad_eps)
    z = F.when(~short & ~flat, c.scale * (F.col("amt_log1p") - F.col("prior_median")) / F.when(~flat, F.col("prior_mad")))
    out = out.withColumn("modified_zscore", z)
    return out.withColumn("flag", F.when(short, FLAGS[0]).when(flat, FLAGS[1]).when(F.abs("modified_zscore") >= c.threshold, FLAGS[3]).otherwise(FLAGS[2]))


def flag_coverage(scored: DataFrame, by: str) -> DataFrame:
    """Rows and share of each flag, by partition; flags that do not occur have 0."""
    return scored.groupBy(by).agg(F.count("*").alias("n_rows"), *[(F.count_if(F.col("flag") == f) * 100.0 / F.count("*")).alias(f"pct_{f}") for f in FLAGS])


def evaluate_validation_only(scored: DataFrame, target: str, part: str = "part") -> DataFrame:
    """One row: numbers and target rates of outliers and normal rows, and the AUC of abs(z). Rows of any other partition raise ValueError."""
    if not scored.where(~F.col(part).eqNullSafe("validation")).isEmpty():
        raise ValueError("only validation rows may be evaluated")
    of = lambda flag, name: [F.count_if(F.col("flag") == flag).alias(f"n_{name}"), ratio(F.sum(F.when(F.col("flag") == flag, F.col(target))), F.count(F.when(F.col("flag") == flag, F.col(target)))).alias(f"rate_{name}")]
    rates = scored.agg(F.count("*").alias("n_rows"), *of("scored_outlier", "outlier"), *of("scored_normal", "normal"))
    auc = score_metrics(scored.withColumn("_abs", F.abs("modified_zscore")), "_abs", target).select(F.col("roc_auc").alias("auc_abs_z"))
    return rates.crossJoin(auc)  # one row each
