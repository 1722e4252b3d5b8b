"""Row-local columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECONDS_PER_DAY = 86400


def require_columns(df: DataFrame, *names: str) -> None:
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {missing}")


def null_if_nan(c: Column) -> Column:
    return F.nanvl(c, F.lit(None).cast("double"))


def log1p_amount(amount: str) -> Column:
    return F.log1p(F.col(amount))


def decimal_part(amount: str) -> Column:
    return F.col(amount) - F.floor(amount)


def hour_of_day(dt: str) -> Column:
    return F.pmod(F.floor(F.col(dt) / 3600), F.lit(24)).cast("int")


def day_of_week(dt: str) -> Column:
    """Day in a period of seven, not a calendar's weekday."""
    return F.pmod(F.floor(F.col(dt) / SECONDS_PER_DAY), F.lit(7)).cast("int")


def day_index(dt: str, seconds_per_day: int = SECONDS_PER_DAY) -> Column:
    return F.floor(F.col(dt) / seconds_per_day).cast("int")


def key(parts: Sequence[str], separator: str = "|") -> Column:
    """The parts joined, null if any is null."""
    return F.when(~_any_null(parts), F.concat_ws(separator, *[F.col(p).cast("string") for p in parts]))


def _any_null(parts: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.col(p).isNull()
    return out


def with_group_key(df: DataFrame, parts: Sequence[str], name: str) -> DataFrame:
    """Rows whose key parts are all there, with their key."""
    require_columns(df, *parts)
    return df.dropna(subset=list(parts)).withColumn(name, key(parts))


def relationship(df: DataFrame, anchor: str, other: str) -> DataFrame:
    require_columns(df, anchor, other)
    return df.dropna(subset=[anchor, other])


def with_match_flag(df: DataFrame, ids: DataFrame, id_col: str, name: str = "has_identity") -> DataFrame:
    """1 where the id occurs in ``ids``, else 0."""
    known = ids.select(F.col(id_col)).distinct().withColumn("_c_known", F.lit(True))
    return df.join(known, id_col, "left").withColumn(name, F.col("_c_known").isNotNull().cast("int")).drop("_c_known")


#: Row features: name, expression from (dt, amount) columns.
FEATURES = {"amt_log1p": lambda dt, amt: log1p_amount(amt), "amt_decimal_part": lambda dt, amt: decimal_part(amt), "hour_of_day": lambda dt, amt: hour_of_day(dt), "day_of_week": lambda dt, amt: day_of_week(dt)}


def feature_frame(df: DataFrame, ids: DataFrame, id_col: str, dt: str, amount: str) -> DataFrame:
    """The five row features of each row; labels are never read."""
    return with_match_flag(df, ids, id_col).select(id_col, *[f(dt, amount).alias(n) for n, f in FEATURES.items()], "has_identity")


def fixed_bucket(value: Column, edges: Sequence[float]) -> Column:
    """Number of the left-closed bucket [edge, next edge) with open ends; null for null."""
    out = F.when(value.isNull(), None)
    for k, e in enumerate(edges):
        out = out.when(value < e, k)
    return out.otherwise(len(edges))


def flag_columns(flag: str, values: Sequence[str]) -> list[Column]:
    """One 0/1 column for each value but the reference one, which is left out by the caller."""
    return [(F.col(flag) == v).cast("int").alias(f"flag_{v}") for v in values]
