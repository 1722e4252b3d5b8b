"""Structured Streaming over the record/resolve state: each micro-batch goes through the batch functions, so their checks hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from antecede.operators.state import load_state, record_observed, save_state, update_resolved


def stream_into_state(stream: DataFrame, root: str, checkpoint: str, kind: str = "observed") -> StreamingQuery:
    """Applies a stream of observations or resolutions to the state saved at ``root``; a replayed batch changes nothing."""
    if kind not in ("observed", "resolved"):
        raise ValueError("kind is observed or resolved")
    apply = record_observed if kind == "observed" else update_resolved

    def each(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            save_state(apply(load_state(batch.sparkSession, root), batch), root)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
