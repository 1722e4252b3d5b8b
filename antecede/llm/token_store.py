"""Token ids as directly addressable codes (operator 8).

An id is cut into 8-bit chunks. Level 0 holds the lowest chunk of every id, level k the k-th chunk of the
ids that have one; a bitmap beside each level tells which ids go on, and a rank directory (set bits before
every 512th position) gives an id's place in the next level. So any single id is read by a few look-ups,
without decoding a block.

On disk a store is a Parquet table of segments (about ``SEGMENT`` ids each, whole documents), one row a
segment: its place in the order, its documents' ids and starts, and the encoded ids as one binary value.
Segments are written in ascending order of document id by range partition; Spark's own writer puts them
into the shared folder, so a lost executor's segments are written again.

A null text counts as empty and has only the end id. Rows with one id stay apart, in the order of their
ids' text (equal rows are the same either way). Null ids come first.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from antecede.llm.common import attached, forget_others, load, remembers, scratch, stored, whole

SEGMENT = 1 << 17
#: Segments up to which their starts are sent to every task.
BROADCAST_SEGMENTS = 500_000
RANK_EVERY = 512
_MAGIC = b"DAC1"
#: Remembered chunks of text between white space, and pieces of them, for each worker; full tables start anew.
CHUNKS, PIECES = 1_000_000, 800_000
# The rules of files that lower-case and keep letter runs, single digits, runs of other characters and some endings.
_ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
_RULES = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": _ENDINGS + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    None,
)
#: Below it no character joins another one in composed form, and letters and digits are the same in every Unicode version.
_PLAIN = "\u0300"


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(ord(_PLAIN)) if unicodedata.category(chr(c))[0] == kind)


_SPLIT = re.compile(rf"{_ENDINGS}|[{_class('L')}]+|[{_class('N')}]|[^\x09-\x0D\x20\x85\xA0{_class('L')}{_class('N')}]+")
#: How a byte is shown in byte-level vocabularies: printable ones as they are, the others from U+0100 on in order.
_KEPT = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or 174 <= c <= 255]
_SHOWN = {c: 256 + k for k, c in enumerate(sorted(set(range(256)) - set(_KEPT)))}


def encode_codes(ids: np.ndarray) -> bytes:
    """``ids`` (unsigned 32-bit) as directly addressable codes."""
    ids = np.ascontiguousarray(ids, np.uint32)
    levels, rest = [], ids
    while True:
        on = rest > 0xFF
        bits = np.packbits(on, bitorder="little")
        ends = np.concatenate([[0], np.cumsum(on)])[::RANK_EVERY].astype("<u4")
        levels.append((rest.astype(np.uint8).tobytes(), bits.tobytes() if on.any() else b"", ends.tobytes() if on.any() else b""))
        if not on.any():
            break
        rest = rest[on] >> 8
    head = struct.pack("<4sIB", _MAGIC, len(ids), len(levels)) + b"".join(struct.pack("<III", *map(len, x)) for x in levels)
    return head + b"".join(b"".join(x) for x in levels)


class Codes:
    """Encoded ids, read in place."""

    def __init__(self, data: bytes):
        magic, self.n, depth = struct.unpack_from("<4sIB", data)
        if magic != _MAGIC:
            raise ValueError("not a code file")
        at, self.levels = 9 + 12 * depth, []
        for k in range(depth):
            parts = []
            for size, kind in zip(struct.unpack_from("<III", data, 9 + 12 * k), ("u1", "u1", "<u4"), strict=True):
                parts.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at))
                at += size
            self.levels.append(parts)

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        """One id, from its own chunks only."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = shift = 0
        for chunks, bits, ranks in self.levels:
            out |= int(chunks[i]) << shift
            shift += 8
            if not len(bits) or not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK_EVERY
            between = bits[block * RANK_EVERY // 8 : (i >> 3) + 1].copy()
            between[-1] &= (1 << (i & 7)) - 1
            i = int(ranks[block]) + int(np.bitwise_count(between).sum())
        return out

    def all(self) -> np.ndarray:
        """Every id, level by level."""
        out, places = np.zeros(self.n, np.uint32), None
        for k, (chunks, bits, _) in enumerate(self.levels):
            add = chunks.astype(np.uint32) << np.uint32(8 * k)
            if places is None:
                out += add
                places = np.arange(self.n)
            else:
                out[places] += add
            if len(bits):
                places = places[np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)]
        return out


class _Pieces(dict):
    """Ids (as little-endian 32-bit integers) of the pieces that the pre-tokenizer makes, by the model alone."""

    def __init__(self, model):
        self.model = model

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= PIECES:
            self.clear()
        plain = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(_SHOWN)
        ids = [t.id for t in self.model.tokenize(plain)]
        own = self[piece] = struct.pack(f"<{len(ids)}I", *ids)
        return own


class ChunkEncoder(dict):
    """Ids of texts by a ``tokenizers`` file whose pre-tokens hold no white space: ids of each chunk between spaces and newlines.

    A chunk that is not remembered is cut as the file's normalizer and pre-tokenizer would cut it, where it has only characters
    below ``_PLAIN`` (they are in composed form and lower-cased one by one); its pieces go to the file's model. Other chunks, those
    with special tokens' marks, and all chunks of files with other rules go through the whole tokenizer. Tables are bounded and start anew when full.
    """

    _of: dict[str, ChunkEncoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        self.cut = _SPLIT.findall if (rules["normalizer"], rules["pre_tokenizer"], rules["post_processor"]) == _RULES else None
        self.pieces = _Pieces(self.tokenizer.model)
        self.special = [t["content"] for t in rules["added_tokens"]]
        for probe in ("two words", "a\nb  c\r\n d", "it's été ΣΣ x", "1234 ?!…", "O'Neill's x²½_y\u00a0Z\x85q İſ \x00\x7f\xad", "".join(map(chr, range(1, 0x300)))):
            if self.ids(probe) != self.tokenizer.encode(probe, add_special_tokens=False).ids:
                raise ValueError(f"this tokenizer joins chunks across white space: {probe!r}")

    @classmethod
    def of(cls, path: str) -> ChunkEncoder:
        """This worker's encoder, made once; it is forgotten when another operator's task starts here."""
        remembers("chunk-encoder", cls._of.clear)
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= CHUNKS:
            self.clear()
        lower = chunk.lower()
        if self.cut and (chunk.isascii() or max(chunk) < _PLAIN > max(lower)) and not any(map(chunk.__contains__, self.special)):
            own = b"".join(map(self.pieces.__getitem__, self.cut(lower)))
        else:
            own = np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        self[chunk] = own
        return own

    def ids(self, text: str) -> list[int]:
        return self.encode(text).tolist()

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, text.replace("\n", " ").split(" "))), "<u4")


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT) -> None:
    """Encodes each text, appends ``end_id`` and writes the store at ``path``."""
    spark = docs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        forget_others("chunk-encoder")
        encoder, part, seq = ChunkEncoder.of(tokenizer), TaskContext.get().partitionId(), 0
        names, starts, ids, size, end = [], [], [], 0, np.array([end_id], np.uint32)

        def flush() -> pa.RecordBatch:
            data = encode_codes(np.concatenate(ids))
            columns = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([size], pa.int64()), pa.array([names], pa.list_(id_type)), pa.array([starts], pa.list_(pa.int32())), pa.array([data], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["part", "seq", "n_tokens", "ids", "starts", "codes"])

        for batch in batches:
            id_type = batch.column(0).type
            for i in range(0, batch.num_rows, 128):
                some = batch.slice(i, 128)
                for name, own in zip(some.column(0).to_pylist(), map(encoder.encode, some.column(1).to_pylist()), strict=True):
                    names.append(name)
                    starts.append(size)
                    ids += (own, end)
                    size += len(own) + 1
                    if size >= segment:
                        yield flush()
                        names, starts, ids, size, seq = [], [], [], 0, seq + 1
        if names:
            yield flush()

    sorted_ = docs.select(F.col(id_col), whole(text_col).alias("_text")).repartitionByRange(n, F.col(id_col)).sortWithinPartitions(id_col, "_text")
    sorted_.mapInArrow(run, f"part int, seq int, n_tokens bigint, ids array<{kind}>, starts array<int>, codes binary").write.option("compression", "uncompressed").parquet(path)


def _starts(segments: DataFrame) -> DataFrame:
    """``part, seq, n_tokens, start``: sums of parts first, then sums within a part."""
    slim = segments.select("part", "seq", "n_tokens")
    sizes = slim.groupBy("part").agg(F.sum("n_tokens").alias("_size"))
    before = sizes.select("part", (F.sum("_size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size")).alias("_before"))
    within = slim.withColumn("_within", F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens"))
    return within.join(before, "part").select("part", "seq", "n_tokens", (F.col("_before") + F.col("_within")).alias("start"))


def read_store(spark, path: str, broadcast_segments: int = BROADCAST_SEGMENTS) -> DataFrame:
    """The segments of a store with ``start``, the number of ids before each; codes are only moved where there are very many segments."""
    segments = spark.read.parquet(path)
    return attached(segments, stored(_starts(segments).drop("n_tokens"), "segment-starts"), ["part", "seq"], broadcast_segments)


def tokens_at(spark, path: str, positions: DataFrame) -> DataFrame:
    """``position, token`` of each distinct ``position`` (counted over the whole store; those outside it have no row), read from the
    segment's chunks by its bitmaps and rank directories. Positions find their segment by equi-join on stretches of ``SEGMENT`` ids."""
    segments = spark.read.parquet(path)
    starts = _starts(segments)
    stretch = lambda c: F.floor(c / SEGMENT)
    over = starts.select("part", "seq", "start", (F.col("start") + F.col("n_tokens")).alias("_end")).withColumn("_at", F.explode(F.sequence(stretch(F.col("start")), stretch(F.col("_end") - 1))))
    asked = positions.select("position").distinct().withColumn("_at", stretch(F.col("position"))).join(over, "_at").where("position >= start AND position < _end")
    asked = asked.groupBy("part", "seq", "start").agg(F.collect_list("position").alias("positions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        for batch in batches:
            for k in range(batch.num_rows):
                codes, wanted = Codes(batch.column(2)[k].as_buffer().to_pybytes()), batch.column(1)[k].values
                start = batch.column(0)[k].as_py()
                yield pa.RecordBatch.from_arrays([wanted, pa.array([codes[i - start] for i in wanted.to_pylist()], pa.int64())], ["position", "token"])

    return asked.join(segments.select("part", "seq", "codes"), ["part", "seq"]).select("start", "positions", "codes").mapInArrow(run, "position bigint, token bigint")


def document_ids(spark, path: str, id_col: str = "doc_id") -> DataFrame:
    """``id_col, start, ids array<int>`` of every document of a store."""
    kind = spark.read.parquet(path).schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, at, ids in _documents(batch):
                yield pa.RecordBatch.from_arrays([name, pa.array(at, pa.int64()), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))], [id_col, "start", "ids"])

    return read_store(spark, path).select("ids", "starts", "codes", "start").mapInArrow(run, f"`{id_col}` {kind}, start bigint, ids array<int>")


def document_digests(spark, path: str, id_col: str = "doc_id") -> DataFrame:
    """``id_col, start, n_tokens, ids_crc32`` of every document, from the files."""
    kind = spark.read.parquet(path).schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, at, ids in _documents(batch):
                yield pa.RecordBatch.from_arrays([name, pa.array(at, pa.int64()), pa.array(map(len, ids), pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())], [id_col, "start", "n_tokens", "ids_crc32"])

    return read_store(spark, path).select("ids", "starts", "codes", "start").mapInArrow(run, f"`{id_col}` {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")


def _documents(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, list[np.ndarray]]]:
    for k in range(batch.num_rows):
        codes = Codes(batch.column(2)[k].as_buffer().to_pybytes())
        starts = np.array(batch.column(1)[k].values, np.int64)
        yield batch.column(0)[k].values, starts + batch.column(3)[k].as_py(), np.split(codes.all(), starts[1:])


def round_trip(spark, sf_dir: str, tokenizer: str) -> DataFrame:
    path = scratch(spark, "tokens")
    write_store(load(spark, sf_dir, "documents"), path, tokenizer)
    return document_digests(spark, path)
