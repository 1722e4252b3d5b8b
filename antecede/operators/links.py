"""Relationships between two kinds of entities: fan-out, overlap of partners, prevalence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from antecede.config import WINDOWS
from antecede.functions.columns import relationship
from antecede.operators.causal import prior_distinct_other, windowed_distinct_other
from antecede.operators.profile import ratio, sufficiency
from antecede.operators.stats import running
from antecede.storage import stored


def row_coverage(df: DataFrame, anchor: str, other: str, part: str) -> DataFrame:
    return df.groupBy(part).agg(F.count("*").alias("n_rows"), F.count_if(F.col(anchor).isNotNull() & F.col(other).isNotNull()).alias("n_valid"))


def fan_out(df: DataFrame, anchor: str, other: str, dt: str) -> DataFrame:
    """By anchor, the most distinct partners that any of its rows has behind it."""
    return prior_distinct_other(relationship(df, anchor, other), anchor, other, dt, "_c_d").groupBy(anchor).agg(F.max("_c_d").alias("fanout"))


def causal_pairs(df: DataFrame, anchor: str, other: str, dt: str) -> DataFrame:
    """Distinct (anchor, partner) pairs before the anchor's own last time."""
    rows = relationship(df, anchor, other)
    last = rows.groupBy(anchor).agg(F.max(dt).alias("_c_last"))
    first = rows.groupBy(anchor, other).agg(F.min(dt).alias("_c_first"))
    return first.join(last, anchor).where("_c_first < _c_last").select(anchor, other)


def high_fanout(fanout: DataFrame, anchor: str, percent: float = 1.0, least: int = 10) -> DataFrame:
    """The largest fan-outs: max(least, ceil(percent of n)) anchors with ties at the cutoff, none of 0. Two counts find the cutoff."""
    n = fanout.count()
    target = max(least, -(-int(n * percent * 1000) // 100000))
    by_value = fanout.where("fanout > 0").groupBy("fanout").agg(F.count("*").alias("_n"))
    # the least fan-out that fewer than ``target`` anchors exceed
    cutoff = running(by_value, "fanout", ["_n"], descending=True).where(F.col("_r__n") - F.col("_n") < target).agg(F.min("fanout")).first()[0]
    return fanout.where(F.col("fanout") >= (cutoff if cutoff is not None else 2**62)).select(anchor, "fanout")


def partner_prevalence(pairs: DataFrame, other: str, n_anchors: int) -> DataFrame:
    """Share of all anchors that have each partner."""
    return pairs.groupBy(other).agg(F.count("*").alias("n_anchors")).withColumn("prevalence", F.try_divide(F.col("n_anchors"), F.lit(float(n_anchors))))


def _shared(pairs: DataFrame, anchor: str, other: str) -> DataFrame:
    """Pairs with the number of anchors that hold the partner: more than one means shared, without pairing anchors."""
    return pairs.join(pairs.groupBy(other).agg(F.count("*").alias("_held")), other)


def overlap(df: DataFrame, anchor: str, other: str, dt: str, percentile: float = 0.99, signal: float = 20.0) -> DataFrame:
    """Mean share of an anchor's partners that another selected anchor has too, over anchors at or over the percentile's fan-out."""
    fan = stored(fan_out(df, anchor, other, dt), "fan-out")
    cut = fan.agg(F.percentile("fanout", percentile).alias("_cut"))
    chosen = fan.crossJoin(F.broadcast(cut)).where("fanout >= _cut").select(anchor)  # one row
    mine = causal_pairs(df, anchor, other, dt).join(chosen, anchor)
    each = _shared(mine, anchor, other).groupBy(anchor).agg(F.avg((F.col("_held") > 1).cast("double") * 100).alias("_pct"))
    return each.agg(F.count("*").alias("n_anchors"), F.avg("_pct").alias("mean_overlap")).withColumn("signal", F.coalesce(F.col("mean_overlap") >= signal, F.lit(False)))


def adjusted_overlap(df: DataFrame, anchor: str, other: str, dt: str, least_lift: float = 2.0, eps: float = 0.5) -> DataFrame:
    """Observed overlap of high fan-out anchors against what the partners' prevalence alone would give; ratio of means."""
    fan = stored(fan_out(df, anchor, other, dt), "fan-out")
    n = fan.count()
    chosen = stored(high_fanout(fan, anchor), "high-fan-out")
    h = chosen.count()
    pairs = stored(causal_pairs(df, anchor, other, dt), "causal-pairs")
    mine = pairs.join(chosen.select(anchor), anchor)
    held = _shared(mine, anchor, other).join(partner_prevalence(pairs, other, n).select(other, "prevalence"), other)
    each = held.groupBy(anchor).agg(F.avg((F.col("_held") > 1).cast("double") * 100).alias("_o"), F.avg((1 - F.pow(1 - F.col("prevalence"), F.lit(max(h - 1, 0)))) * 100).alias("_e"))
    out = each.agg(F.lit(n).cast("long").alias("n_anchors"), F.lit(h).cast("long").alias("n_high"), F.avg("_o").alias("observed"), F.avg("_e").alias("expected"))
    out = out.withColumn("lift", F.when(F.lit(h) >= 2, F.col("observed") / F.greatest("expected", F.lit(eps))))
    return out.withColumn("signal", F.coalesce(F.col("lift") >= least_lift, F.lit(False)))


def recommend_window(pct_by_window: dict[int, float], unbounded: float, least: float = 0.5) -> int | None:
    """The largest window that keeps at least half of the unbounded share."""
    good = [w for w, p in pct_by_window.items() if unbounded and p >= least * unbounded]
    return max(good, default=None)


def sufficient_relationship(coverage: float, density: float, part_relative: float, dominant_relative: float) -> bool:
    return coverage >= 10 and density >= 10 and part_relative >= 50 and dominant_relative >= 50


def coverage_rate(df: DataFrame, anchor: str, other: str) -> DataFrame:
    return df.agg((ratio(F.count_if(F.col(anchor).isNotNull() & F.col(other).isNotNull()), F.count("*")) * 100).alias("pct_valid"))


def relationship_direction(df: DataFrame, anchor: str, other: str, dt: str, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """One direction of a relationship: sufficiency of the distinct partners behind each row, over all its history (window 0) and over the
    latest events of each window size. Rows without anchor, partner or time are in no direction."""
    rows = relationship(df, anchor, other).where(F.col(dt).isNotNull())
    counted = sufficiency(prior_distinct_other(rows, anchor, other, dt, "_c_d"), "_c_d").withColumn("window_size", F.lit(0))
    for n in windows:
        one = windowed_distinct_other(rows, anchor, other, dt, n)
        counted = counted.unionByName(sufficiency(one, "prior_distinct_other_count_in_window").withColumn("window_size", F.lit(n)))
    return counted
