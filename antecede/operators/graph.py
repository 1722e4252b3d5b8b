"""Components of a growing bipartite graph, as seen by each edge at its time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from antecede.functions.columns import require_columns
from antecede.operators.components import components, least_labels
from antecede.storage import stored


class DisjointSet:
    """Union by size with path halving; unknown items are singletons."""

    def __init__(self):
        self.parent, self.sizes = {}, {}

    def find(self, x):
        if x not in self.parent:
            self.parent[x], self.sizes[x] = x, 1
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def size(self, x) -> int:
        return self.sizes[self.find(x)]

    def connected(self, x, y) -> bool:
        return self.find(x) == self.find(y)

    def union(self, x, y) -> None:
        a, b = self.find(x), self.find(y)
        if a != b:
            if self.sizes[a] < self.sizes[b]:
                a, b = b, a
            self.parent[b] = a
            self.sizes[a] += self.sizes[b]

    def __len__(self) -> int:
        return len(self.parent)

    def __contains__(self, x) -> bool:
        return x in self.parent


#: Links of a spanning forest up to which one task replays it (a few 100 MB there); beyond it the rounds are joins. Each round of joins
#: costs the driver plans, stages and task records, so few links should not take many.
FEW_LINKS = 2_000_000
#: Links of which a task makes a forest of its own at a time.
CHUNK = 500_000
_LINK = "_c_x bigint, _c_y bigint, _c_t bigint"
#: Rows up to which a table goes to every task of a join. Files say little of that: compressed Parquet is far smaller than its rows.
FEW_ROWS = 50_000


def _met(rows: DataFrame, table: DataFrame, n: int, on: str) -> DataFrame:
    """``rows`` left-joined with the ``n`` rows of ``table``, which the driver gathers only if they are few."""
    return rows.join(table.hint("broadcast" if n <= FEW_ROWS else "merge"), on, "left")


def _numbered(values: DataFrame, name: str) -> DataFrame:
    """``values`` with a column ``name`` from 0 on without gaps, in any order."""
    at = stored(values.withColumn("_c_at", F.monotonically_increasing_id()), "numbered")
    task = F.shiftright("_c_at", 33)
    ends = at.groupBy(task.alias("_c_task")).agg(F.count("*").alias("_c_n")).orderBy("_c_task").collect()
    starts = [(r[0], sum(e[1] for e in ends[:k])) for k, r in enumerate(ends)]
    starts = values.sparkSession.createDataFrame(starts, "_c_task bigint, _c_start bigint")
    within = at.withColumn("_c_task", task).join(F.broadcast(starts), "_c_task")
    return within.withColumn(name, F.col("_c_start") + F.col("_c_at").bitwiseAND((1 << 33) - 1)).select(*values.columns, name)


def first_forest(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Places of the links (u, v) of a spanning forest of ``n`` places that takes earlier links first."""
    labels, at, taken = np.arange(n), np.arange(len(u)), [np.zeros(0, np.int64)]
    while True:
        x, y = labels[u[at]], labels[v[at]]
        at, x, y = at[x != y], x[x != y], y[x != y]
        if not len(at):
            return np.sort(np.concatenate(taken))
        first = np.full((2, n), len(u))
        for k, side in enumerate((x, y)):
            first[k, side[::-1]] = at[::-1]  # of repeated places the last one stays, so the earliest link
        first = first.min(axis=0)
        picked = np.unique(first[first < len(u)])
        taken.append(picked)
        labels = least_labels(n, labels[u[picked]], labels[v[picked]])[labels]


def _forests(chunk: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each ``chunk`` links at least in a task, those of a spanning forest with the least times: at any time they join what all of them join."""

    def forest(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        x, y, t = (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in held]) for k in range(3))
        order = np.argsort(t, kind="stable")
        nodes, places = np.unique(np.concatenate([x[order], y[order]]), return_inverse=True)
        kept = order[first_forest(len(nodes), *np.split(places, 2))]
        return pa.RecordBatch.from_arrays([pa.array(c[kept]) for c in (x, y, t)], ["_c_x", "_c_y", "_c_t"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= chunk:
                yield forest(held)
                held, n = [], 0
        if held:
            yield forest(held)

    return run


def _forest(links: DataFrame, few_links: int) -> DataFrame:
    """The links ``_c_x, _c_y, _c_t`` of a spanning forest with the least times: at any time they join the nodes that all links up to then join.

    Each round every component takes its first link (ties by the ends) and the links within the new components go. A round leaves at most
    half of the components, and the first one most of the links. Before, each task drops what its own links join earlier; if few are left
    then, one task ends it.
    """
    taken: list[DataFrame] = []
    links = stored(links.where("_c_x <> _c_y").select("_c_x", "_c_y", "_c_t").mapInArrow(_forests(CHUNK), _LINK), "edge-links")
    if links.limit(few_links + 1).count() <= few_links:
        return stored(links.coalesce(1).mapInArrow(_forests(few_links + 1), _LINK), "forest")
    links = links.select("_c_x", "_c_y", F.struct("_c_t", F.col("_c_x").alias("_c_u"), F.col("_c_y").alias("_c_v")).alias("_c_link"))
    while True:
        first = [links.groupBy(F.col(x).alias("_c_x")).agg(F.min(F.struct("_c_link", F.col(y).alias("_c_y"))).alias("_c_first")) for x, y in (("_c_x", "_c_y"), ("_c_y", "_c_x"))]
        first = stored(first[0].union(first[1]).groupBy("_c_x").agg(F.min("_c_first").alias("_c_first")), "first-links")
        taken.append(first.select("_c_first._c_link.*").distinct())
        if first.isEmpty():
            break
        labels = components(first.select(F.col("_c_x").alias("a"), F.col("_c_first._c_y").alias("b")), few_links)
        n = labels.count()
        for x in ("_c_x", "_c_y"):
            links = _met(links, labels.select(F.col("node").alias(x), F.col("component").alias("_c_comp")), n, x).withColumn(x, F.col("_c_comp")).drop("_c_comp")
        pair = F.least("_c_x", "_c_y").alias("_c_x"), F.greatest("_c_x", "_c_y").alias("_c_y")
        links = stored(links.where("_c_x <> _c_y").groupBy(*pair).agg(F.min("_c_link").alias("_c_link")), "edge-links")
    out = reduce(DataFrame.union, taken)
    return stored(out.select(F.col("_c_u").alias("_c_x"), F.col("_c_v").alias("_c_y"), "_c_t"), "forest")


def _halvings(n_nodes: int, n_times: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``_c_h`` and the rows of ``_merges`` from all links of the forest, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        *ends, t = (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in held]) for k in range(3))
        ends = [[e.copy(), np.ones(len(e), np.int64)] for e in ends]
        for h in range(max(n_times - 1, 0).bit_length() - 1, -1, -1):
            right = (t >> h) & 1 == 1
            if right.all():
                continue
            keys = [(t >> (h + 1)) * n_nodes + c for c, _ in ends]
            nodes, first, places = np.unique(np.concatenate([k[~right] for k in keys]), return_index=True, return_inverse=True)
            labels = least_labels(len(nodes), *np.split(places, 2))
            total = np.zeros(len(nodes), np.int64)
            np.add.at(total, labels, np.concatenate([s[~right] for _, s in ends])[first])
            total, new = total[labels], nodes[labels] % n_nodes
            for i in range(0, len(nodes), 1 << 16):
                part = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(nodes[part]), h, np.int32)), *(pa.array(c[part]) for c in (nodes, new, total))], ["_c_h", "_c_key", "_c_new", "_c_total"])
            for (c, size), key in zip(ends, keys, strict=True):
                at = np.minimum(np.searchsorted(nodes, key), len(nodes) - 1)
                moves = right & (nodes[at] == key)
                c[moves], size[moves] = new[at[moves]], total[at[moves]]

    return run


def _merges(links: DataFrame, n_nodes: int, n_times: int, few_links: int) -> list[tuple[int, DataFrame, int]]:
    """For each halving ``h``, from the longest spans on: ``_c_key`` (span and component at its start), the component ``_c_new`` at the start of
    the span's right half, its size ``_c_total``, and the number of rows; components that stay as they are are left out."""
    if links.limit(few_links + 1).count() <= few_links:
        moved = stored(links.coalesce(1).mapInArrow(_halvings(n_nodes, n_times), "_c_h int, _c_key bigint, _c_new bigint, _c_total bigint"), "edge-components")
        counts = moved.groupBy("_c_h").agg(F.count("*").alias("_c_n")).orderBy(F.desc("_c_h")).collect()
        return [(r[0], moved.where(F.col("_c_h") == r[0]).drop("_c_h"), r[1]) for r in counts]
    out = []
    links = links.withColumns({"_c_xs": F.lit(1).cast("long"), "_c_ys": F.lit(1).cast("long")})
    for h in range(max(n_times - 1, 0).bit_length() - 1, -1, -1):
        half = lambda right, h=h: links.where(F.shiftright("_c_t", h).bitwiseAND(1) == int(right))  # noqa: E731, B023
        key = lambda c, h=h: F.shiftright("_c_t", h + 1) * n_nodes + F.col(c)
        left = half(False)
        if left.isEmpty():
            continue
        labels = components(left.select(key("_c_x").alias("a"), key("_c_y").alias("b")), few_links)
        sizes = left.select(key("_c_x").alias("node"), F.col("_c_xs").alias("_c_size")).union(left.select(key("_c_y"), "_c_ys")).distinct()
        sized = stored(labels.join(sizes.hint("merge"), "node"), "edge-components")
        total = sized.groupBy("component").agg(F.sum("_c_size").alias("_c_total"))
        moved = sized.join(total.hint("merge"), "component").select(F.col("node").alias("_c_key"), F.pmod("component", F.lit(n_nodes)).alias("_c_new"), "_c_total")
        moved = stored(moved, "edge-components")
        out.append((h, moved, n := moved.count()))
        right = half(True)
        for x in ("_c_x", "_c_y"):
            right = _met(right.withColumn("_c_key", key(x)), moved, n, "_c_key")
            right = right.withColumns({x: F.coalesce("_c_new", x), f"{x}s": F.coalesce("_c_total", f"{x}s")}).drop("_c_key", "_c_new", "_c_total")
        links = stored(left.unionByName(right), "edge-links")
    return out


def causal_component_metrics(edges: DataFrame, a: str, b: str, dt: str, few_links: int = FEW_LINKS) -> DataFrame:
    """Each edge's component sizes just before its time; all edges of one time are read before any is added.

    Only the links of a spanning forest with the least times ever join components. Its times are halved again and again. For every span of
    times the components at its start are known (single nodes at first); the links of its left half join them to the components at the
    start of its right half, for all spans at once. After as many rounds as the number of times has binary digits each time is a span of its
    own. An edge's end takes part only from the round of its time's highest digit on, and then once for all ends of its time and component.
    A round is joins and minima over the forest's links; at most ``few_links`` of them, which are counted first, are replayed in one task. The
    driver gathers no table of nodes or links.
    Null endpoints raise ValueError; without a time the metrics are null.
    """
    require_columns(edges, a, b, dt)
    if not edges.where(F.col(a).isNull() | F.col(b).isNull()).isEmpty():
        raise ValueError("an edge has a null endpoint")
    of = edges.schema[dt].dataType.simpleString()
    times = edges.where(F.col(dt).isNotNull()).select(F.col(dt).alias("_c_dt")).distinct().orderBy("_c_dt").rdd.zipWithIndex().map(lambda r: (r[0][0], r[1]))
    times = stored(edges.sparkSession.createDataFrame(times, f"_c_dt {of}, _c_t bigint"), "edge-times")
    n_times = times.count()
    keyed = _met(edges.withColumn("_c_dt", F.col(dt)), times, n_times, "_c_dt").drop("_c_dt")
    name = {side: F.col(c).cast("string") for side, c in (("a", a), ("b", b))}
    named = [edges.select(F.lit(side).alias("_c_side"), n.alias("_c_name")).distinct() for side, n in name.items()]
    nodes = stored(_numbered(named[0].union(named[1]), "_c_node"), "edge-nodes")
    n_nodes = nodes.count()
    for side, n in name.items():
        own = nodes.where(F.col("_c_side") == side).select("_c_name", F.col("_c_node").alias(f"_c_{side}"))
        keyed = _met(keyed.withColumn("_c_name", n), own, n_nodes, "_c_name").drop("_c_name")
    keyed = stored(keyed, "edges")
    links = keyed.where("_c_t IS NOT NULL").select(F.col("_c_a").alias("_c_x"), F.col("_c_b").alias("_c_y"), "_c_t")
    merges = _merges(_forest(links, few_links), n_nodes, n_times, few_links)

    digit = F.when(F.col("_c_t") > 0, F.length(F.bin("_c_t")) - 1).cast("long")
    first = [moved.where(F.col("_c_key") < n_nodes).withColumn("_c_key", F.col("_c_key") + h * n_nodes) for h, moved, _ in merges]
    for side in "ab" if first else "":
        keyed = _met(keyed.withColumn("_c_key", digit * n_nodes + F.col(f"_c_{side}")), reduce(DataFrame.union, first), sum(n for *_, n in merges), "_c_key")
        keyed = keyed.withColumns({f"_c_{side}": F.coalesce("_c_new", f"_c_{side}"), f"_c_{side}s": F.coalesce("_c_total", F.lit(1))}).drop("_c_key", "_c_new", "_c_total")
    keyed = stored(keyed if first else keyed.withColumns({"_c_as": F.lit(1).cast("long"), "_c_bs": F.lit(1).cast("long")}), "edges")
    ends = keyed.select("_c_t", F.col("_c_a").alias("_c_was"), F.col("_c_as").alias("_c_size")).union(keyed.select("_c_t", "_c_b", "_c_bs"))
    ends = ends.where("_c_t IS NOT NULL").distinct().withColumn("_c_comp", F.col("_c_was"))
    for h, moved, n in merges:
        due = (digit > h) & (F.shiftright("_c_t", h).bitwiseAND(1) == 1)
        ends = _met(ends.withColumn("_c_key", F.when(due, F.shiftright("_c_t", h + 1) * n_nodes + F.col("_c_comp"))), moved, n, "_c_key")
        ends = stored(ends.withColumns({"_c_comp": F.coalesce("_c_new", "_c_comp"), "_c_size": F.coalesce("_c_total", "_c_size")}).drop("_c_key", "_c_new", "_c_total"), "edge-ends")
    ends = stored(ends.select((F.col("_c_t") * n_nodes + F.col("_c_was")).alias("_c_key"), "_c_comp", "_c_size"), "edge-ends")
    out, n = keyed, ends.count()
    for side in "ab":
        out = _met(out.withColumn("_c_key", F.col("_c_t") * n_nodes + F.col(f"_c_{side}")), ends, n, "_c_key").drop("_c_key")
        out = out.withColumnsRenamed({"_c_comp": f"_c_{side}_comp", "_c_size": f"{side}_component_size"})
    same = F.col("_c_a_comp") == F.col("_c_b_comp")
    merged = F.when(same, F.col("a_component_size")).otherwise(F.col("a_component_size") + F.col("b_component_size"))
    return out.withColumns({"same_component": same, "merged_component_size": merged}).select(*edges.columns, "a_component_size", "b_component_size", "same_component", "merged_component_size")


def component_summary(metrics: DataFrame, *by: str) -> DataFrame:
    q = F.percentile("merged_component_size", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)))
    out = metrics.groupBy(*by).agg(F.count("*").alias("n_edges"), q.alias("_q"), F.max("merged_component_size").alias("max_size"), (F.avg(F.col("same_component").cast("double")) * 100).alias("pct_same"))
    return out.select(*by, "n_edges", *[F.get("_q", F.lit(k)).alias(f"p{p}") for k, p in enumerate((50, 90, 99))], "max_size", "pct_same")


