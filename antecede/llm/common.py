"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from antecede.storage import cut, drop_stored, scratch, shared_dir, stored, tidy

__all__ = ["cut", "drop_stored", "scratch", "shared_dir", "stored", "tidy"]

#: Rows of one Arrow batch that are turned into Python objects at a time.
SLICE = 256

#: What operators remember in this Python worker between tasks: by operator, how it is forgotten.
_forget: dict[str, Callable[[], None]] = {}


def remembers(owner: str, forget: Callable[[], None]) -> None:
    _forget[owner] = forget


def forget_others(owner: str = "") -> None:
    """Frees what other operators remember in this worker and hands it back to the system; for the start of a task, so that stages in one
    worker do not add up."""
    for name in [n for n in _forget if n != owner]:
        _forget.pop(name)()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # a C library without it
        pass


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; it is never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def rows_of(column: pa.Array, step: int = SLICE) -> Iterator:
    """Python values of an Arrow column, a few at a time."""
    for i in range(0, len(column), step):
        yield from column.slice(i, step).to_pylist()


def whole(text: Column | str) -> Column:
    """A text, empty where null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


#: A key with at least this share of all rows is hot; so there are at most as many hot keys as its reciprocal.
HOT_SHARE = 1 / 2048


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], counts: DataFrame | None = None) -> DataFrame:
    """``rows`` left joined with ``table`` (one row a key; null keys meet nothing), without a hot key's rows in one task.

    ``counts`` has the keys and ``_n``, their number of rows (counted here if not given). Hot keys, of which there are at most
    ``1 / HOT_SHARE``, are broadcast with their row of ``table``; the others' rows are joined by key, and rows that are done are dealt evenly.
    """
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n")) if counts is None else counts
    total = counts.agg(F.sum("_n")).first()[0] or 0
    more = [c for c in table.columns if c not in keys]
    if not total:
        return rows.join(table, keys, "left")
    hot = counts.where((F.col("_n") >= total * HOT_SHARE) & F.concat(*[F.col(k).cast("string") for k in keys]).isNotNull()).select(*keys)
    hot = stored(hot.join(table, keys, "left").select(*keys, F.struct(*more).alias("_hot")).coalesce(1), "hot-keys")
    spread = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])
    first = rows.join(F.broadcast(hot), keys, "left").withColumn("_key", F.struct(*keys)).withColumn("_salt", F.when(F.col("_hot").isNotNull() | F.concat(*[F.col(k).cast("string") for k in keys]).isNull(), spread))
    of = table.select(F.struct(*keys).alias("_of"), F.lit(0).cast("bigint").alias("_none"), F.struct(*more).alias("_cold"))
    # a done row's second key is never 0, so it meets nothing and its first one only deals it out
    first = first.withColumn("_salt", F.coalesce(F.when(F.col("_salt") == 0, 1).otherwise(F.col("_salt")), F.lit(0).cast("bigint")))
    both = first.join(of, (F.col("_key") == F.col("_of")) & (F.col("_salt") == F.col("_none")), "left")
    return both.select(*[F.col(f"`{c}`") for c in rows.columns], *[F.coalesce(F.col(f"_hot.{c}"), F.col(f"_cold.{c}")).alias(c) for c in more])


def attached(rows: DataFrame, table: DataFrame, keys: list[str], few: int) -> DataFrame:
    """``rows`` left joined with the stored ``table`` (one row a key): sent to every task if it has at most ``few`` rows, else ``looked_up``."""
    return rows.join(F.broadcast(table), keys, "left") if table.count() <= few else looked_up(rows, table, keys)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
