"""Tables as canonical event views (id, dt, grp, amt, y, ...); nothing but columns is changed."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from antecede.functions.columns import day_index


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(c: str):
    return F.floor(F.unix_micros(F.col(c).cast("timestamp")) / 1000000).cast("long")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), seconds("o_orderdate").alias("dt"), F.col("o_custkey").alias("grp"), F.col("o_totalprice").alias("amt"), (F.col("o_orderstatus") == "F").cast("int").alias("y"), F.col("o_orderpriority").alias("cat"))
    return out.withColumn("day", day_index("dt"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), seconds("ts").alias("dt"), F.col("user_id").alias("grp"), F.col("value").alias("amt"), (F.col("event_type") == "error").cast("int").alias("y"), F.col("event_type").alias("cat"))
    return out.withColumn("day", day_index("dt"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items by supplier; ``dt`` is the day, so there are many ties."""
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.floor(seconds("l_shipdate") / 86400).cast("long").alias("dt"), F.col("l_suppkey").alias("grp"), F.col("l_extendedprice").alias("amt"), F.col("l_partkey").alias("other"), (F.col("l_returnflag") == "R").cast("int").alias("y"), F.col("l_linestatus").alias("cat"))


# CSV and JSON sources.


def normalized(df: DataFrame) -> DataFrame:
    """Columns ``id-NN`` renamed to ``id_NN``."""
    return df.withColumnsRenamed({c: re.sub(r"^id-(\d+)$", r"id_\1", c) for c in df.columns})


def read_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None, schema: T.StructType | None = None) -> DataFrame:
    """A CSV table with its header, pruned to ``columns`` (given in either spelling); an empty list raises ValueError."""
    if columns is not None and not columns:
        raise ValueError("no columns asked for")
    reader = spark.read.option("header", True).option("enforceSchema", False)
    df = normalized(reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path))
    wanted = [re.sub(r"^id-(\d+)$", r"id_\1", c) for c in columns or df.columns]
    if missing := [c for c in wanted if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*wanted)


def sample(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows, or all of a smaller table, by a seeded order."""
    return df.orderBy(F.rand(seed)).limit(n)


def chunks(df: DataFrame, size: int) -> Iterator[list]:
    """Rows in lists of at most ``size``, one partition at a time on the driver."""
    held: list = []
    for row in df.toLocalIterator():
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def read_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON records: one object or a list of them."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def columns_like(df: DataFrame, pattern: str) -> list[str]:
    return [c for c in df.columns if re.fullmatch(pattern, c)]
