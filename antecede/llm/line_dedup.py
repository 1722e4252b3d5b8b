"""Removal of lines that repeat across documents (operator 7).

Two Bloom filters of one fixed, documented size hold the hashes of line keys seen in one document at
least and in two at least. Each task fills its own blocks of both, Spark merges them block by block
(seen twice = twice in any part, or once in two parts), and the second filter, whose size does not
depend on the data, goes to all tasks. Only keys that it holds are shuffled, for exact counts of
documents and, where a first occurrence stays, for its choice. A false positive costs a shuffled key
and never changes the result; when the corpus outgrows the filter, more keys are shuffled.

Definitions: a null text counts as empty; a text has one line more than it has newlines, so an empty
one has one empty line. A line's key is the line without ASCII white space at both ends and with A-Z
in lower case; an empty key never repeats. Every row counts as a document, repeated ids included.
Keys are compared by 128-bit hashes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from antecede.llm.common import forget_others, rows_of, stored, whole

#: Bits of each filter: 16 MB, 2 bits a key up to 67 million keys.
FILTER_BITS = 1 << 27
#: Bits of a block, the unit that is merged.
BLOCK_BITS = 1 << 16
#: Repeated keys up to this number (16 bytes each) are sent to every task; beyond it they are joined.
BROADCAST_KEYS = 500_000
_STRIP = b" \t\n\v\f\r"


def line_key(line: bytes) -> bytes:
    return line.strip(_STRIP).lower()  # of bytes: A-Z only


def _keys(text: str) -> list[bytes]:
    """128-bit hash of each line's key, b'' for an empty one."""
    digest = xxhash.xxh3_128_digest
    return [digest(k) if (k := line.strip(_STRIP).lower()) else b"" for line in text.encode().split(b"\n")]


def _slots(hashes: list[bytes], bits: int) -> np.ndarray:
    return (np.frombuffer(b"".join(hashes), ">u8")[::2] & np.uint64(bits - 1)).astype(np.int64)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.uint8)


def repeat_filter(docs: DataFrame, text_col: str = "text", bits: int = FILTER_BITS) -> np.ndarray:
    """The bytes of the filter of hashes that two documents have at least."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for text in rows_of(batch.column(0)):
                if hashes := list({*_keys(text)} - {b""}):
                    slots, n = np.unique(_slots(hashes, bits), return_counts=True)  # two keys of one document may share a slot
                    at, bit = slots >> 3, (128 >> (slots & 7)).astype(np.uint8)
                    again = ((once[at] & bit) > 0) | (n > 1)
                    np.bitwise_or.at(twice, at[again], bit[again])
                    np.bitwise_or.at(once, at, bit)
        a, b = once.reshape(-1, BLOCK_BITS // 8), twice.reshape(-1, BLOCK_BITS // 8)
        blocks = np.flatnonzero(a.any(axis=1))
        for some in np.array_split(blocks, max(1, len(blocks) // 256)):
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array([zlib.compress(x[k].tobytes(), 1) for k in some], pa.binary()) for x in (a, b))], ["block", "once", "twice"])

    def merge(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = twice = None
        for part in parts:
            for a, b in zip(part.column("once").to_pylist(), part.column("twice").to_pylist(), strict=True):
                a, b = _unpacked(a), _unpacked(b)
                once, twice = (a, b) if once is None else (once | a, twice | b | (once & a))
        if twice is not None and twice.any():
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([zlib.compress(twice.tobytes(), 1)], pa.binary())], ["block", "twice"])

    bits = max(BLOCK_BITS, bits)
    merged = docs.select(whole(text_col)).mapInArrow(fill, "block int, once binary, twice binary").groupBy("block").applyInArrow(merge, "block int, twice binary")
    out = np.zeros(bits // 8, np.uint8)
    for row in merged.toLocalIterator():
        k = row.block * (BLOCK_BITS // 8)
        out[k : k + BLOCK_BITS // 8] = _unpacked(bytes(row.twice))
    return out


def repeated_keys(docs: DataFrame, text_col: str = "text", min_docs: int = 10, bits: int = FILTER_BITS) -> DataFrame:
    """``key binary, n_docs``: the keys (as hashes) that are in at least ``min_docs`` documents."""
    if min_docs < 2:
        raise ValueError("min_docs must be 2 or more")
    spark = docs.sparkSession
    seen = spark.sparkContext.broadcast(repeat_filter(docs, text_col, bits))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        twice, found = seen.value, {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], ["key", "n"])
            found.clear()
            return out

        size = twice.size * 8
        for batch in batches:
            for text in rows_of(batch.column(0)):
                if hashes := list({*_keys(text)} - {b""}):
                    slots = _slots(hashes, size)
                    for k in np.flatnonzero(twice[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8) & 1):
                        found[hashes[k]] = found.get(hashes[k], 0) + 1
            if len(found) > 200_000:
                yield flush()
        yield flush()

    counted = docs.select(whole(text_col)).mapInArrow(suspects, "key binary, n bigint").groupBy("key").agg(F.sum("n").alias("n_docs"))
    return counted.where(F.col("n_docs") >= min_docs)


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, bits: int = FILTER_BITS, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """All columns of ``docs``, the text without its repeated lines (left ones joined by a newline), and ``n_lines``, ``n_dropped``."""
    clash = {"n_lines", "n_dropped", "_drop"} & set(docs.columns)
    docs = docs.drop(*clash)
    keys = stored(repeated_keys(docs, text_col, min_docs, bits), "line-keys")
    few = keys.limit(broadcast_keys + 1).count() <= broadcast_keys
    if few:
        sent = docs.sparkSession.sparkContext.broadcast(frozenset(bytes(r.key) for r in keys.select("key").toLocalIterator()))
        return _apply(docs, text_col, sent)
    return _apply(_with_own_keys(docs, keys, id_col, text_col), text_col, None)


def _with_own_keys(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with ``_drop``, each document's own repeated keys, by joins; for more keys than a task may be sent."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        for batch in batches:
            pairs = [(i, k) for i, t in zip(batch.column(0).to_pylist(), rows_of(batch.column(1)), strict=True) for k in {*_keys(t)} - {b""}]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], batch.column(0).type), pa.array([p[1] for p in pairs], pa.binary())], ["_id", "key"])

    kind = docs.schema[id_col].dataType.simpleString()
    pairs = docs.select(F.col(id_col).alias("_id"), whole(text_col)).mapInArrow(own, f"_id {kind}, key binary")
    drops = pairs.join(keys.select("key"), "key", "left_semi").groupBy("_id").agg(F.collect_set("key").alias("_drop"))
    return docs.join(drops, docs[id_col].eqNullSafe(drops["_id"]), "left").drop("_id")


def _apply(docs: DataFrame, text_col: str, sent) -> DataFrame:
    names = [c for c in docs.columns if c not in (text_col, "_drop")]
    order = [c for c in docs.columns if c != "_drop"]
    inner = docs.select(*[F.col(f"`{c}`") for c in names], whole(text_col).alias(text_col), *([F.col("_drop")] if sent is None else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        common = sent.value if sent is not None else frozenset()
        at = len(names)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts, n_lines, n_dropped = [], [], []
                own = part.column(at + 1).to_pylist() if sent is None else [None] * part.num_rows
                for text, mine in zip(part.column(at).to_pylist(), own, strict=True):
                    drop, lines = common if mine is None else frozenset(mine), text.split("\n")
                    kept = lines
                    if drop:
                        keys = _keys(text)
                        if not drop.isdisjoint(keys):
                            kept = [line for line, k in zip(lines, keys, strict=True) if k not in drop]
                    texts.append("\n".join(kept))
                    n_lines.append(len(lines))
                    n_dropped.append(len(lines) - len(kept))
                yield pa.RecordBatch.from_arrays([*part.columns[:at], pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*names, text_col, "n_lines", "n_dropped"])

    fields = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names), f"`{text_col}` string, n_lines bigint, n_dropped bigint"])
    return inner.mapInArrow(run, fields).select(*[F.col(f"`{c}`") for c in [*order, "n_lines", "n_dropped"]])


def kept_sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
