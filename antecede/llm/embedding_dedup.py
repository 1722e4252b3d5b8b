"""Near-duplicate embeddings by PCA-ordered tiled comparison (operator 1).

Vectors are normalised, equal ones become one (with a count), and all are rotated onto the corpus's principal axes,
which keeps every product. Tiles of neighbours in that order are compared pair by pair:

* tiles, and blocks of a tile, whose boxes in the leading axes (or balls) are too far apart for the threshold are left
  out; blocks that are so close that all their pairs link are counted without a comparison;
* elsewhere the leading axes' products are accumulated first. The rest of a product is at most the product of
  the two suffix norms (Cauchy-Schwarz), so a pair stops as soon as its sum plus that bound stays below the threshold; the few
  pairs left take the next axes, and at last the exact cosine of the original vectors in double precision.

A task gets two tiles of at most ``TILE`` vectors and returns, for each vector with links, the number of them and the least vector
that it reaches within the two tiles: never the pairs. Tile pairs come from an equi-join on cells of the first axis.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of different lengths do not
link. A row with a null id has no links and is kept as it is. Rows that share an id are one vector each, counted as others; their
component is the least one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from antecede.llm.common import stored
from antecede.llm.components import components, least_labels

TILE, BLOCK = 4096, 512
#: Leading axes that are accumulated first, and those that boxes use.
FIRST, BOX = 16, 12
#: Allowance for rounding in every bound; the last comparison is exact.
SLACK = 1e-5
#: Most dimensions for which axes are fitted; longer vectors keep their own order of axes.
LARGEST_FIT = 2048


def unit_rows(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray | None]]:
    """Which vectors can link, and each of those as doubles of norm 1 (else None)."""
    out: list[np.ndarray | None] = []
    for v in column:
        values = v.values if v.is_valid else None
        if values is None or len(values) == 0 or values.null_count:
            out.append(None)
            continue
        x = values.to_numpy(zero_copy_only=False).astype(np.float64)
        top = np.abs(x).max()
        if not np.isfinite(top) or top == 0:
            out.append(None)
            continue
        x = x / top
        out.append(x / np.sqrt((x * x).sum()) + 0.0)
    return np.array([x is not None for x in out], bool), out


def _units(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, dim, unit`` (binary doubles) of vectors that can link."""
    kind = vectors.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, units = unit_rows(batch.column(1))
            units = [u for u in units if u is not None]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), pa.array([len(u) for u in units], pa.int32()), pa.array([u.tobytes() for u in units], pa.binary())], ["id", "dim", "unit"])

    return vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>")).where("id IS NOT NULL").mapInArrow(run, f"id {kind}, dim int, unit binary")


def fit_axes(units: DataFrame) -> dict[int, np.ndarray]:
    """By dimension, the principal axes (columns, most weight first), from the second moments of all vectors."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column(0).to_numpy()
            for d in np.unique(dims):
                if d <= LARGEST_FIT:
                    x = np.frombuffer(b"".join(batch.column(1).filter(pa.array(dims == d)).to_pylist())).reshape(-1, d)
                    sums[d] = sums.get(d, 0) + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["dim", "moments"])

    def merge(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(np.frombuffer(m) for part in parts for m in part.column("moments").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["dim", "moments"])

    schema = "dim int, moments binary"
    found = units.select("dim", "unit").mapInArrow(partial, schema).groupBy("dim").applyInArrow(merge, schema)
    axes = {}
    for row in found.toLocalIterator():
        axes[row.dim] = np.linalg.eigh(np.frombuffer(bytes(row.moments)).reshape(row.dim, row.dim))[1][:, ::-1].copy()
    return axes


def _tiles(units: DataFrame, axes: dict[int, np.ndarray], n: int) -> DataFrame:
    """Packed tiles: ``tile, dim, n, ids, counts, data, lo, hi`` in the order of the leading axes."""
    kind = units.schema["id"].dataType.simpleString()
    sent = units.sparkSession.sparkContext.broadcast(axes)

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, firsts = [], []
            for d, u in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                y = np.frombuffer(u) @ sent.value[d][:, :8] if d in sent.value else np.frombuffer(u)[:8]
                cells.append(int("".join("1" if v > 0 else "0" for v in y), 2))
                firsts.append(float(y[0]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.int32()), pa.array(firsts, pa.float64())], ["id", "dim", "count", "unit", "cell", "first"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, held = TaskContext.get().partitionId(), 0, []

        def flush() -> pa.RecordBatch:
            nonlocal seq, held
            d = held[0][1]
            x = np.frombuffer(b"".join(h[3] for h in held)).reshape(-1, d)
            y = x @ sent.value[d] if d in sent.value else x
            y = y[:, :BOX]
            out = pa.RecordBatch.from_arrays([pa.array([(part << 32) + seq], pa.int64()), pa.array([d], pa.int32()), pa.array([[h[0] for h in held]], pa.list_(id_type)), pa.array([[h[2] for h in held]], pa.list_(pa.int64())), pa.array([x.tobytes()], pa.binary()), pa.array([y.min(axis=0).tolist()], pa.list_(pa.float64())), pa.array([y.max(axis=0).tolist()], pa.list_(pa.float64()))], ["tile", "dim", "ids", "counts", "data", "lo", "hi"])
            seq, held = seq + 1, []
            return out

        for batch in batches:
            id_type = batch.column(0).type
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (len(held) >= TILE or held[0][1] != row[1]):
                    yield flush()
                held.append(row)
        if held:
            yield flush()

    keyed = units.select("id", "dim", "count", "unit").mapInArrow(order, f"id {kind}, dim int, count bigint, unit binary, cell int, first double")
    ranged = keyed.repartitionByRange(max(1, -(-n // TILE)), "dim", "cell", "first", "id").sortWithinPartitions("dim", "cell", "first", "id")
    return ranged.select("id", "dim", "count", "unit").mapInArrow(pack, f"tile bigint, dim int, ids array<{kind}>, counts array<bigint>, data binary, lo array<double>, hi array<double>")


def tile_pairs(tiles: DataFrame, threshold: float) -> DataFrame:
    """``a, b`` (a <= b): tiles whose boxes are not too far apart; they meet in cells of the first axis."""
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK)
    cells = F.sequence(F.floor((F.element_at("lo", 1) - reach / 2) / reach), F.floor((F.element_at("hi", 1) + reach / 2) / reach))
    boxes = tiles.select("tile", "dim", "lo", "hi", F.explode(cells).alias("cell"))
    left, right = boxes.select(F.col("tile").alias("a"), "dim", "cell", F.col("lo").alias("alo"), F.col("hi").alias("ahi")), boxes.select(F.col("tile").alias("b"), "dim", "cell", F.col("lo").alias("blo"), F.col("hi").alias("bhi"))
    gap = F.transform(F.arrays_zip("alo", "ahi", "blo", "bhi"), lambda x: F.greatest(x["alo"] - x["bhi"], x["blo"] - x["ahi"], F.lit(0.0)))
    near = F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g) <= reach * reach
    return left.join(right, ["dim", "cell"]).where("a <= b").where(near).select("a", "b").distinct()


class _Tile:
    def __init__(self, data: bytes, d: int, axes: np.ndarray | None):
        self.x = np.frombuffer(data).reshape(-1, d)
        y = self.x @ axes if axes is not None else self.x
        self.y = y
        k = min(FIRST, d)
        self.head = np.ascontiguousarray(np.hstack([y[:, :k], self._suffix(y, k)[:, None]]), np.float32)
        self.steps = [k for k in (2 * FIRST, 4 * FIRST) if k < d]
        self.suffix = {k: self._suffix(y, k) for k in self.steps}
        self.blocks = []
        for i in range(0, len(y), BLOCK):
            some = y[i : i + BLOCK]
            centre = some.mean(axis=0)
            self.blocks.append((i, min(i + BLOCK, len(y)), some[:, :BOX].min(axis=0), some[:, :BOX].max(axis=0), centre, float(np.sqrt(((some - centre) ** 2).sum(axis=1)).max())))

    @staticmethod
    def _suffix(y: np.ndarray, k: int) -> np.ndarray:
        return np.sqrt((y[:, k:] ** 2).sum(axis=1))


def compare(a: _Tile, b: _Tile, same: bool, threshold: float, stats: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs' places in two tiles; of one tile, each pair once."""
    reach = np.sqrt(max(0.0, 2 - 2 * threshold))
    left, right = [], []
    for i, j, lo, hi, ca, ra in a.blocks:
        for p, q, lo2, hi2, cb, rb in b.blocks:
            if same and p < i:
                continue
            gap = np.maximum(np.maximum(lo - hi2, lo2 - hi), 0)
            between = float(np.sqrt(((ca - cb) ** 2).sum()))
            if (gap * gap).sum() > (reach + SLACK) ** 2 or between - ra - rb > reach + SLACK:
                continue
            if between + ra + rb < reach - SLACK:  # all pairs of the blocks link
                u, v = (x.ravel() for x in np.mgrid[i:j, p:q])
            else:
                u, v = np.nonzero(a.head[i:j] @ b.head[p:q].T >= threshold - SLACK)
                u, v = u + i, v + p
                if same and i == p:
                    u, v = u[u < v], v[u < v]
                if len(u) * 4 > (j - i) * (q - p):
                    ok = (a.x[i:j] @ b.x[p:q].T)[u - i, v - p] >= threshold
                    u, v = u[ok], v[ok]
                else:
                    u, v = _narrowed(a, b, u, v, threshold)
            if same and i == p:
                u, v = u[u < v], v[u < v]
            left.append(u)
            right.append(v)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, int), np.zeros(0, int))


def _narrowed(a: _Tile, b: _Tile, u: np.ndarray, v: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    for k in a.steps:
        if len(u):
            keep = [np.einsum("ij,ij->i", a.y[u[s : s + 8192], :k], b.y[v[s : s + 8192], :k]) + a.suffix[k][u[s : s + 8192]] * b.suffix[k][v[s : s + 8192]] >= threshold - SLACK for s in range(0, len(u), 8192)]
            keep = np.concatenate(keep)
            u, v = u[keep], v[keep]
    if len(u):
        keep = np.concatenate([np.einsum("ij,ij->i", a.x[u[s : s + 8192]], b.x[v[s : s + 8192]]) >= threshold for s in range(0, len(u), 8192)])
        u, v = u[keep], v[keep]
    return u, v


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """``id_col, n_links, component_id, kept`` for each row."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be over 0 and at most 1")
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    units = stored(_units(vectors, id_col, vector_col).withColumn("_same", F.sha2("unit", 256)), "units")
    groups = stored(units.groupBy("_same").agg(F.min("id").alias("id"), F.count("*").alias("count"), F.first("dim").alias("dim"), F.first("unit").alias("unit")), "unit-groups")
    axes = fit_axes(groups)
    # the least id names an equal group; ids shared by groups are told apart by the vector
    tiles = stored(_tiles(groups.select(F.struct("id", "_same").alias("key"), "dim", "count", "unit").withColumn("id", F.concat_ws(":", F.col("key.id").cast("string"), F.col("key._same"))).drop("key"), axes, groups.count()), "tiles")
    pairs = tile_pairs(tiles, threshold)
    sent = spark.sparkContext.broadcast(axes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                d = batch.column(2)[k].as_py()
                same = batch.column(0)[k].as_py() == batch.column(1)[k].as_py()
                (ids_a, counts_a, a), (ids_b, counts_b, b) = ((batch.column(c)[k].values, np.array(batch.column(c + 1)[k].values), _Tile(batch.column(c + 2)[k].as_buffer().to_pybytes(), d, sent.value.get(d))) for c in (3, 6))
                u, v = compare(a, b, same, threshold)
                shift = 0 if same else len(ids_a)
                names = pa.concat_arrays([ids_a] if same else [ids_a, ids_b])
                n = np.zeros(len(names), np.int64)
                np.add.at(n, u, counts_b[v])
                np.add.at(n, v + shift, counts_a[u])
                at = np.flatnonzero(n)
                labels = least_labels(len(names), u, v + shift)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(at)), pa.array(n[at]), names.take(pa.array(labels[at]))], ["id", "n", "other"])

    side = lambda x: tiles.select(F.col("tile").alias(x), *([F.col("dim")] if x == "a" else []), *[F.col(c).alias(f"{x}_{c}") for c in ("ids", "counts", "data")])
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "dim", "a_ids", "a_counts", "a_data", "b_ids", "b_counts", "b_data")
    found = stored(joined.mapInArrow(run, "id string, n bigint, other string"), "vector-links")
    counted = found.groupBy("id").agg(F.sum("n").alias("n"))
    group_of = lambda c: F.substring_index(c, ":", -1)
    labels = components(found.select(F.col("id").alias("a"), F.col("other").alias("b")))
    members = groups.select("_same", "id", "count", F.concat_ws(":", F.col("id").cast("string"), F.col("_same")).alias("node"))
    placed = members.join(labels, "node", "left").join(counted.withColumnRenamed("id", "node"), "node", "left").withColumn("_root", F.coalesce("component", "node"))
    least = placed.groupBy("_root").agg(F.min("id").alias("component_id"))
    placed = placed.join(least, "_root").select("_same", "component_id", (F.coalesce("n", F.lit(0)) + F.col("count") - 1).alias("n_links"))
    linked = units.select("id", "_same").join(placed, "_same").groupBy("id", "_same").agg(F.first("n_links").alias("n_links"), F.first("component_id").alias("component_id"), F.count("*").alias("_rows"))
    by_row = linked.select("id", "n_links", "component_id", F.explode(F.sequence(F.lit(1), F.col("_rows").cast("int"))).alias("_k"))
    alone = _alone(vectors, id_col, vector_col)
    rows = by_row.select(F.col("id").cast(kind).alias(id_col), F.col("n_links").cast("long"), "component_id").unionByName(alone.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return rows.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def _alone(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id`` of rows that link with nothing by definition."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col(id_col).isNull() | ~F.coalesce(usable, F.lit(False))).select(F.col(id_col).alias("id"))
