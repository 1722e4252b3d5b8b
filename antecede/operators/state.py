"""Record/resolve state: four tables, changed only by idempotent pure functions.

Occurrences (``buffer`` and ``seen``) and labels (``counters`` and ``resolved``) are independent domains. A row whose id is known with
the same content changes nothing; with other content it raises ValueError before anything changes (nulls equal nulls, in a batch and
against the state). Nothing is ever pruned.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from antecede.functions.columns import require_columns

BUFFER, LABEL = ("grp", "dt", "amt"), ("grp", "y")


@dataclass(frozen=True)
class State:
    buffer: DataFrame  # grp, dt, amt
    seen: DataFrame  # id, grp, dt, amt
    counters: DataFrame  # grp, n_positive, n_events
    resolved: DataFrame  # id, grp, y


def initial_state(df: DataFrame, part: str = "part") -> State:
    """Occurrences from every row, labels from train, validation and holdout only."""
    labels = df.where(F.col(part).isin("train", "validation", "holdout") & F.col("y").isNotNull())
    return State(df.select(*BUFFER), df.select("id", *BUFFER), counters(labels), labels.select("id", *LABEL))


def counters(labels: DataFrame) -> DataFrame:
    return labels.groupBy("grp").agg(F.sum("y").cast("long").alias("n_positive"), F.count("*").alias("n_events"))


def new_rows(batch: DataFrame, known: DataFrame, content: tuple[str, ...]) -> DataFrame:
    """The batch's rows with unknown ids, each once."""
    return batch.select("id", *content).dropDuplicates(["id"]).join(known.select("id"), "id", "left_anti")


def conflicts(batch: DataFrame, known: DataFrame, content: tuple[str, ...]) -> DataFrame:
    """Ids that the batch gives with other content than itself or the state."""
    payload = F.struct(*content)
    inside = batch.groupBy("id").agg(F.count_distinct(F.to_json(payload, {"ignoreNullFields": "false"})).alias("n")).where("n > 1").select("id")
    theirs = known.select("id", payload.alias("_theirs"))
    across = batch.select("id", payload.alias("_mine")).join(theirs, "id").where(~F.col("_mine").eqNullSafe(F.col("_theirs"))).select("id")
    return inside.union(across).distinct()


def _checked(batch: DataFrame, known: DataFrame, content: tuple[str, ...]) -> DataFrame:
    require_columns(batch, "id", *content)
    if bad := conflicts(batch, known, content).orderBy("id").limit(5).collect():
        raise ValueError(f"ids given with other content: {[r.id for r in bad]}")
    return new_rows(batch, known, content)


def record_observed(state: State, batch: DataFrame) -> State:
    """Adds occurrences; labels are not read."""
    new = _checked(batch, state.seen, BUFFER)
    return replace(state, buffer=state.buffer.unionByName(new.select(*BUFFER)), seen=state.seen.unionByName(new))


def update_resolved(state: State, batch: DataFrame) -> State:
    """Adds labels to the counters."""
    new = _checked(batch, state.resolved, LABEL)
    merged = state.counters.unionByName(counters(new)).groupBy("grp").agg(F.sum("n_positive").alias("n_positive"), F.sum("n_events").alias("n_events"))
    return replace(state, counters=merged, resolved=state.resolved.unionByName(new))


def summary(state: State) -> DataFrame:
    """One row of sizes."""
    one = lambda df, **aggs: df.agg(*[c.alias(n) for n, c in aggs.items()])
    return one(state.buffer, n_buffer=F.count("*"), n_groups=F.count_distinct("grp")).crossJoin(one(state.counters, n_positive=F.coalesce(F.sum("n_positive"), F.lit(0)), n_events=F.coalesce(F.sum("n_events"), F.lit(0)))).crossJoin(one(state.resolved, n_resolved=F.count("*")))


def score_inputs(state: State, requests: DataFrame, config=None, k: float = 20.0) -> DataFrame:
    """A request's behavioural score against the buffer and its smoothed rate from the counters as they are now; labels are refused."""
    from antecede.operators.detection import behavior_score

    if "y" in requests.columns:
        raise ValueError("a request has no label")
    require_columns(requests, "id", "grp", "dt", "amt")
    # requests see the buffer and never each other
    scored = behavior_score(requests.select("id", "grp", "dt", "amt"), "grp", "amt", "dt", config, state.buffer)
    total = state.counters.agg(F.sum("n_positive").alias("_P"), F.sum("n_events").alias("_N"))
    rate = F.try_divide("_P", "_N")
    out = scored.join(state.counters, "grp", "left").crossJoin(F.broadcast(total))  # one row
    n, y = F.coalesce("n_events", F.lit(0)), F.coalesce("n_positive", F.lit(0))
    return out.withColumns({"smoothed_rate": (y + k * rate) / (n + k), "raw_rate": F.when(n > 0, y / n), "sufficient": n >= 5}).drop("_P", "_N", "n_positive", "n_events")


def save_state(state: State, root: str) -> str:
    """Writes a new version and only then the pointer to it; versions are never overwritten."""
    spark = state.buffer.sparkSession
    version = uuid.uuid4().hex
    for name in ("buffer", "seen", "counters", "resolved"):
        getattr(state, name).write.parquet(f"{root}/{version}/{name}")
    meta = spark.createDataFrame([(version, json.dumps({"format": 1}))], "version string, meta string")
    meta.coalesce(1).write.mode("overwrite").json(f"{root}/current")
    return version


def load_state(spark: SparkSession, root: str) -> State:
    version = spark.read.schema("version string, meta string").json(f"{root}/current").first().version
    return State(*[spark.read.parquet(f"{root}/{version}/{name}") for name in ("buffer", "seen", "counters", "resolved")])
