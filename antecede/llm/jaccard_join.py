"""N-gram Jaccard join in the Jaccard metric space (operator 9).

``d(A, B) = 1 - |A & B| / |A | B|`` is a metric on shingle sets; two sets link when it is at most ``eps``.
The join partitions the space by pivots, in two kinds of levels:

1. **One-shingle pivots.** A set is equally near to the pivots ``{s}`` of all its own shingles and at distance 1 from all others,
   so its Voronoi region is one of its own, and ties go to the pivot that comes first in a fixed order, rarest first. The
   window: a set within ``eps`` of A misses at most ``floor(eps * |A|)`` of A's shingles, so A is copied into the
   regions of its first ``floor(eps * |A|) + 1`` pivots; then any two linked sets meet in one region. (Whole documents make no
   pivots at this level: unrelated ones are at distance 1 from all of them, and a window of ``2 eps`` there copies everything
   everywhere.) The order is only a heuristic: it uses a count sketch of fixed size over the whole corpus.
   Two sets only need to meet in the first region they share; there neither shares the shingles it has before, so their places bound the
   intersection, and most pairs are excluded in the region itself.
   A region with more than a few members is cut by set size, which is a distance too (to the set of all shingles): a member joins its own
   ring and the next smaller one, so that linked sets meet.
2. **Document pivots.** A region with few members is joined directly, after the same counting argument on the copied shingles has
   excluded pairs that miss too many. In a larger one the most central member becomes the pivot, and the exact distance of the other members to it is computed; those within ``eps`` link to it. That closes a region whose members are all connected, as in a group of near copies,
   however large. Else it is joined recursively: pivots leave, more are taken (of the smallest components, and the most central ones), and by the
   triangle inequality a member is only compared with a new pivot when its distance to the first pivot differs by at most ``eps``
   from the new pivot's, when the bits of their signatures allow a link, and when the two are not connected yet. The recursion ends when every region is closed, so the join is exact.

Equal sets are one member from the start. Links are exact: ``100 * |A & B| >= percent * |A | B|`` on 64-bit shingle hashes.

Definitions: words are maximal runs of characters other than ASCII white space, A-Z in lower case; a text with fewer words than a shingle is one
shingle; null, empty and blank texts have empty sets and link with nothing. Rows that share an id are told apart: each has the
component of its own set. Null ids are greater than others. Other columns of the documents are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from antecede.llm.common import drop_stored, forget_others, looked_up, rows_of, stored, tidy, whole
from antecede.llm.components import components
from antecede.llm.shingles import shingle_sets

#: Counters of the sketch that orders shingles (4 bytes each on the driver and in a task).
COUNTERS, COUNTER_BLOCK = 1 << 21, 1 << 13
#: Members of a region up to which it is joined directly.
DIRECT = 12
#: Pivots of a region at its second level (at the first it has one); each further level takes eight times as many.
PIVOTS = 16
#: Ids of documents whose sets are needed, up to which they are sent to every task (8 bytes each); beyond it they are joined.
BROADCAST_IDS = 2_000_000
#: Rows of a stored table of labels or pivots up to which it is sent to every task (some MB); beyond it it is joined. Each shuffled join
#: costs the driver the records of as many tasks as there are shuffle partitions, whatever the rows.
SENT_ROWS = 20_000
_TEXTS = 64
#: Bits of a set's signature (a multiple of 64): each shingle sets one.
SIGNATURE = 1024


def _sketch(docs: DataFrame, text_col: str, size: int) -> np.ndarray:
    """By counter, the number of documents whose shingles fall on it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        table = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, _TEXTS):
                found = shingle_sets(batch.column(0).slice(i, _TEXTS).to_pylist(), size)
                np.add.at(table, np.concatenate(found).astype(np.int64) & (COUNTERS - 1), 1)
        blocks = table.reshape(-1, COUNTER_BLOCK)
        at = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([zlib.compress(blocks[k].astype("<i4").tobytes(), 1) for k in at], pa.binary())], ["block", "counts"])

    def merge(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTER_BLOCK, np.int64)
        for part in parts:
            for x in part.column("counts").to_pylist():
                total += np.frombuffer(zlib.decompress(x), "<i4")
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([zlib.compress(np.minimum(total, 2**31 - 1).astype("<i4").tobytes(), 1)], pa.binary())], ["block", "counts"])

    schema = "block int, counts binary"
    out = np.zeros(COUNTERS, np.int32)
    for row in docs.select(whole(text_col)).mapInArrow(count, schema).groupBy("block").applyInArrow(merge, schema).toLocalIterator():
        out[row.block * COUNTER_BLOCK : (row.block + 1) * COUNTER_BLOCK] = np.frombuffer(zlib.decompress(bytes(row.counts)), "<i4")
    return out


def _ordered(found: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Shingles renamed so that rarer ones come first: the counter's level in the top bits, the hash below."""
    return np.sort((levels[(found & np.uint64(COUNTERS - 1)).astype(np.int64)] << np.uint64(57)) | (found >> np.uint64(7)))


def _signature(found: np.ndarray) -> list[int]:
    """``SIGNATURE`` bits as 64-bit words; a bit that one set has and another has not stands for a shingle that the other misses."""
    bits = np.zeros(SIGNATURE, bool)
    bits[((found >> np.uint64(20)) % np.uint64(SIGNATURE)).astype(np.int64)] = True
    return np.packbits(bits).view(np.int64).tolist()


def _sets(docs: DataFrame, id_col: str, text_col: str, size: int, eps: float) -> DataFrame:
    """``row, id, n, same, sig, first``: each document's set size, its set's hash, its signature, and the shingles whose regions it joins."""
    counts = _sketch(docs, text_col, size)
    levels = docs.sparkSession.sparkContext.broadcast(np.minimum(np.ceil(np.log2(counts + 1) * 2), 63).astype(np.uint8))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        table = levels.value.astype(np.uint64)
        for batch in batches:
            for i in range(0, batch.num_rows, 8 * _TEXTS):
                part = batch.slice(i, 8 * _TEXTS)
                n, same, sig, first = [], [], [], []
                for k in range(0, part.num_rows, _TEXTS):
                    for found in shingle_sets(part.column(1).slice(k, _TEXTS).to_pylist(), size):
                        n.append(len(found))
                        same.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                        sig.append(_signature(found))
                        first.append(_ordered(found, table)[: int(eps * len(found) + 1e-9) + 1 if len(found) else 0].astype(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(same, pa.binary()), pa.array(sig, pa.list_(pa.int64())), pa.array(first, pa.list_(pa.int64()))], ["id", "n", "same", "sig", "first"])

    rows = docs.select(F.col(id_col), whole(text_col)).mapInArrow(run, f"id {kind}, n bigint, same binary, sig array<bigint>, first array<bigint>")
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "shingle-sets")


def _not_excluded(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Pairs (``a, b``) that the first shingles do not exclude: below the smaller of the two last ones all misses are known."""
    side = lambda x: members.select(F.col("row").alias(x), F.col("n").alias(f"n{x}"), F.col("first").alias(f"f{x}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        for batch in batches:
            keep = []
            for na, nb, fa, fb in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), batch.column(5), strict=True):
                x, y = fa.values.to_numpy().view(np.uint64), fb.values.to_numpy().view(np.uint64)
                last = min(x[-1], y[-1])
                shared = len(np.intersect1d(x, y, assume_unique=True))
                need = -(-(na + nb) * percent // (100 + percent))
                keep.append(np.searchsorted(x, last, "right") - shared <= na - need and np.searchsorted(y, last, "right") - shared <= nb - need)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.select("a", "b", "na", "nb", "fa", "fb").mapInArrow(run, "a bigint, b bigint")


def _whole_sets(rows: DataFrame, docs: DataFrame, members: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """``row, whole``: the whole sets of the members in ``rows`` (``row``, repeats allowed), from the texts."""
    spark = docs.sparkSession
    wanted = stored(rows.distinct().join(members.select("row", "id", "same"), "row"), "wanted-sets")
    source = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    if wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS and dict(docs.dtypes)[id_col] in ("bigint", "int"):
        ids = np.sort(np.concatenate([np.zeros(0, np.int64), *(b.column(0).to_numpy().astype(np.int64) for b in wanted.select("id").where("id IS NOT NULL").toArrow().to_batches())]))
        sent = spark.sparkContext.broadcast(ids)
    else:
        source, sent = source.join(wanted.select("id").distinct(), source["id"].eqNullSafe(wanted["id"]), "left_semi"), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        for batch in batches:
            if sent is not None:
                known = batch.column(0).to_numpy(zero_copy_only=False)
                batch = batch.filter(pa.array(np.isin(known, sent.value) | np.array(batch.column(0).is_null())))
            for i in range(0, batch.num_rows, _TEXTS):
                found = shingle_sets(batch.column(1).slice(i, _TEXTS).to_pylist(), size)
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in found], pa.binary()), pa.array([x.tobytes() for x in found], pa.binary())], ["same", "whole"])

    sets = source.mapInArrow(run, "same binary, whole binary").join(wanted.select("row", "same"), "same").groupBy("row").agg(F.first("whole").alias("whole"))
    sets = stored(sets, "whole-sets")
    drop_stored(wanted)
    return sets


def _distances(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b, shared, total``: sizes of intersection and union of each pair's whole sets."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        for batch in batches:
            shared, total = [], []
            for x, y in zip(rows_of(batch.column(2), 64), rows_of(batch.column(3), 64), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                k = len(np.intersect1d(x, y, assume_unique=True))
                shared.append(k)
                total.append(len(x) + len(y) - k)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared, pa.int64()), pa.array(total, pa.int64())], ["a", "b", "shared", "total"])

    both = pairs.join(sets.withColumnsRenamed({"row": "a", "whole": "wa"}), "a").join(sets.withColumnsRenamed({"row": "b", "whole": "wb"}), "b")
    return both.select("a", "b", "wa", "wb").mapInArrow(meet, "a bigint, b bigint, shared bigint, total bigint")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, percent: int = 90, direct: int = DIRECT, pivots: int = PIVOTS) -> DataFrame:
    """``id_col, n_shingles, component_id`` for each row."""
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    eps = 1 - percent / 100
    sets = _sets(docs, id_col, text_col, size, eps)
    members = sets.where("n > 0").groupBy("same").agg(F.min("row").alias("row")).select("row")
    members = stored(sets.join(members, "row"), "set-members")
    tidy(docs.sparkSession)
    links = _link(docs, members, id_col, text_col, size, percent, eps, direct, pivots)
    labels = components(links)
    # equal sets share their member's component; a set that many rows have, and a component of many rows, are looked up apart
    of_set = members.select("same", "row").join(labels.withColumnRenamed("node", "row"), "row", "left").select("same", F.coalesce("component", "row").alias("_of"))
    placed = looked_up(sets.select("row", "id", "n", F.when(F.col("n") > 0, F.col("same")).alias("same")), of_set, ["same"])
    placed = stored(placed.select("id", "n", F.coalesce("_of", "row").alias("_c")), "placed")
    least = placed.groupBy("_c").agg(F.min("id").alias("component_id"))
    out = looked_up(placed, least, ["_c"])
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def _direct_pairs(regions: DataFrame, direct: int, percent: int) -> DataFrame:
    """``a, b`` of all members of regions (of ``direct`` members at most) that may link there."""
    few = regions.groupBy("region").agg(F.collect_list(F.struct("n", "row", "at", "low")).alias("all"))
    few = few.select(F.explode(F.flatten(F.transform("all", lambda x, i: F.transform(F.slice("all", i + 2, direct), lambda y: F.struct(x.alias("x"), y.alias("y")))))).alias("p"))
    side = lambda x, end: [F.col(f"p.{x}.{c}").alias(c + end) for c in ("row", "n", "at", "low")]
    few = few.select(*side("x", ""), *side("y", "2")).where(_near(percent))
    return few.select(F.least("row", "row2").alias("a"), F.greatest("row", "row2").alias("b")).where("a < b")


def _near(percent: int) -> Column:
    """Whether two members may link with this region's shingle as the first that they share: neither then has those before it in
    common with the other. Two that came from the ring above meet in their own ring."""
    most = F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2"))
    return (most * (100 + percent) >= (F.col("n") + F.col("n2")) * percent) & ~(F.col("low") & F.col("low2"))


def _alike(percent: int) -> Column:
    """Whether two members' signatures leave room for a link: neither has more bits of its own than it may have shingles of its own."""
    own = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseAND(F.bitwise_not(b)))), F.lit(0), lambda t, k: t + k)
    need = F.ceil((F.col("n") + F.col("n2")) * percent / (100 + percent) - 1e-9)
    return (own("sig", "sig2") <= F.col("n") - need) & (own("sig2", "sig") <= F.col("n2") - need)


def _with_sizes(spread: DataFrame) -> DataFrame:
    """Members of regions that have two at least, one of them in its own ring, with the number of them."""
    return spread.join(spread.groupBy("region").agg(F.count("*").alias("m"), F.min("low").alias("_own")).where("m > 1 AND NOT _own").select("region", "m"), "region")


#: Columns of a region's members, and the names they have as a pivot's.
_MEMBER = ("region", "row", "n", "sig", "at", "low", "score", "far")
_PIVOT_NAMES = {"row": "pivot", "n": "n2", "sig": "sig2", "at": "at2", "low": "low2", "component": "_pc", "far": "far2"}


def _first_pivots(now: DataFrame) -> DataFrame:
    """By region, the most central member: the one that meets most others over all regions, as the original of many near copies
    does. Ties follow a hash order which all regions share, so that few documents serve many regions."""
    most = now.groupBy("region").agg(F.max(F.struct((~F.col("low")).alias("_own"), "score", F.xxhash64("row").alias("_h"), *_PIVOT_NAMES)).alias("p"))
    return most.select("region", *(F.col(f"p.{c}").alias(to) for c, to in _PIVOT_NAMES.items()))


def _more_pivots(now: DataFrame, take: int) -> DataFrame:
    """By region, ``take`` members of its smallest components and the ``take`` most central ones, which only face members of other
    components; first among those of one salt, then among the salts' first."""
    parts = now.groupBy("region", "component").agg(F.count("*").alias("_size"))
    sized = now.join(parts, ["region", "component"]).withColumn("_salt", F.pmod(F.xxhash64("row"), F.lit(64)))

    def least(order: Column) -> DataFrame:
        ranked = sized.withColumn("_rank", order)
        window = lambda *by: Window.partitionBy(*by).orderBy("_rank")
        firsts = ranked.withColumn("_k", F.row_number().over(window("region", "_salt"))).where(F.col("_k") <= take)
        chosen = firsts.withColumn("_k", F.row_number().over(window("region"))).where(F.col("_k") <= take)
        return chosen.select("region", *(F.col(c).alias(to) for c, to in _PIVOT_NAMES.items()))

    tie = (F.xxhash64("row"), F.col("row"))
    both = least(F.struct("_size", -F.col("score"), *tie)).union(least(F.struct(-F.col("score"), *tie)))
    return both.dropDuplicates(["region", "pivot"])


def _sent(table: DataFrame) -> DataFrame:
    """The stored ``table``, for a join: sent to every task if it is small."""
    return F.broadcast(table) if table.limit(SENT_ROWS + 1).count() <= SENT_ROWS else table


def _link(docs: DataFrame, members: DataFrame, id_col: str, text_col: str, size: int, percent: int, eps: float, direct: int, pivots: int) -> DataFrame:
    """``a, b``: links that connect what the linked pairs of members connect."""
    linked = lambda d: d.where(F.col("shared") * 100 >= F.col("total") * percent).select("a", "b")
    ends = lambda d: d.select(F.col("a").alias("row")).union(d.select(F.col("b").alias("row")))
    regions = stored(_with_sizes(members.select("row", "n", F.lit(False).alias("low"), F.posexplode("first").alias("at", "region"))), "regions")
    # the size is a distance to a pivot too (the set of all shingles): linked sets lie in one ring of it or in neighbouring ones
    ring = F.floor(F.log("n") / (max(-np.log(percent / 100), 1e-6) * (1 + 1e-9))).cast("long")
    rings = F.array(*(F.struct(F.xxhash64("region", ring - k).alias("region"), F.lit(k > 0).alias("low")) for k in (0, 1)))
    large = regions.where(F.col("m") > direct).select("row", "n", "at", F.explode(rings).alias("_r")).select("row", "n", "at", "_r.region", "_r.low")
    large = stored(_with_sizes(large), "rings")
    few = _direct_pairs(regions.where(F.col("m") <= direct), direct, percent).union(_direct_pairs(large.where(F.col("m") <= direct), direct, percent)).distinct()
    pairs = stored(_not_excluded(few, members, percent), "pairs")
    drop_stored(regions)
    tidy(docs.sparkSession)
    sets = _whole_sets(ends(pairs), docs, members, id_col, text_col, size)
    links = stored(linked(_distances(pairs, sets)), "links")
    drop_stored(sets)
    tidy(docs.sparkSession)
    large = large.where(F.col("m") > direct)
    large = large.join(members.select("row", "sig"), "row")
    open_, sets, take = large.join(large.groupBy("row").agg(F.sum("m").alias("score")), "row").withColumn("far", F.lit(None).cast("double")).select(*_MEMBER), None, pivots
    old: list[DataFrame] = []
    while True:
        labels = _sent(components(links))
        now = open_.join(labels.withColumnRenamed("node", "row"), "row", "left").withColumn("component", F.coalesce("component", "row"))
        split = now.groupBy("region").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi"), F.min("low").alias("_own")).where("_lo < _hi AND NOT _own").select("region")
        now = stored(now.join(split, "region"), "open-regions")
        while old:
            drop_stored(old.pop())
        tidy(docs.sparkSession)
        if now.isEmpty():
            return links
        first = sets is None
        if first:
            sets = _whole_sets(now.select("row"), docs, members, id_col, text_col, size)
        chosen = stored(_first_pivots(now) if first else _more_pivots(now, take), "pivots")
        few = _sent(chosen)
        near = F.coalesce(F.abs(F.col("far") - F.col("far2")) <= eps + 1e-9, F.lit(True))
        facing = now.join(few, "region").where((F.col("row") != F.col("pivot")) & (F.col("component") != F.col("_pc")) & _near(percent) & near & _alike(percent))
        facing = stored(facing.select("region", "row", F.least("row", "pivot").alias("a"), F.greatest("row", "pivot").alias("b")), "facing")
        wanted = facing.select("a", "b").distinct()
        measured = stored(_distances(wanted if first else _not_excluded(wanted, members, percent), sets), "distances")
        old += [now, chosen, facing, measured, links]
        links = stored(links.union(linked(measured)), "links")
        rest = now.join(few.select("region", F.col("pivot").alias("row")), ["region", "row"], "left_anti")
        if first:  # the distance to a pivot that a member faced; unknown to members that cannot link to it
            far = facing.join(_sent(measured), ["a", "b"]).select("region", "row", (1 - F.col("shared") / F.col("total")).alias("far"))
            rest = rest.drop("far").join(far, ["region", "row"], "left")
        else:
            take *= 8
        open_ = rest.select(*_MEMBER)
