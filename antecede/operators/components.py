"""Connected components of a link table, by least labels and pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from antecede.storage import cut, stored

#: Links up to which one task finds the components; beyond it the rounds are joins.
FEW_LINKS = 300_000


def least_labels(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Least place that each of ``n`` places reaches by the links (u, v)."""
    labels = np.arange(n)
    while True:
        low = np.minimum(labels[u], labels[v])
        new = labels.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = new[new]
        if (new == labels).all():
            return labels
        labels = new


def components(links: DataFrame, few_links: int = FEW_LINKS) -> DataFrame:
    """``node, component`` (least node reachable) of all nodes of ``links`` (``a, b``; any direction, repeats allowed).

    A table of at most ``few_links`` distinct links, which is counted first, goes to one task. Else each round takes the least
    label among a node and its neighbours, then the label's own label, so chains shorten by more than half a round. No
    node's neighbours are ever gathered: labels meet them in joins, and minima are taken on the map side first.
    """
    links = stored(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    if links.limit(few_links + 1).count() <= few_links:
        return stored(_by_one_task(links), "components")
    edges = cut(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    # The size that a checkpoint shows is that of the compressed files it came from, so the joins are told not to gather it on the driver.
    labels = cut(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")))
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), F.col("component").alias("_other")).hint("merge"), "b").groupBy(F.col("a").alias("node")).agg(F.min("_other").alias("_near"))
        lower = labels.join(near.hint("merge"), "node").select("node", F.least("component", "_near").alias("_low"), F.col("component").alias("_was"))
        top = lower.select(F.col("node").alias("_low"), F.col("_low").alias("_top"))
        jumped = cut(lower.join(top.hint("merge"), "_low", "left").select("node", F.least("_low", F.coalesce("_top", "_low")).alias("component"), "_was"))
        changed = jumped.where("component <> _was").limit(1).count()
        labels = jumped.select("node", "component")
        if not changed:
            return labels


def _by_one_task(links: DataFrame) -> DataFrame:
    kind = links.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        type_ = held[0].column(0).type
        ends = [np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in held]) for k in (0, 1)]
        nodes, places = np.unique(np.concatenate(ends), return_inverse=True)
        labels = least_labels(len(nodes), *np.split(places, 2))
        yield pa.RecordBatch.from_arrays([pa.array(nodes, type_), pa.array(nodes[labels], type_)], ["node", "component"])

    return links.coalesce(1).mapInArrow(run, f"node {kind}, component {kind}")
