"""SentencePiece BPE by backtracking (operator 3).

A BPE encoding is the only sequence of pieces that covers a text and in which every two neighbours
stay apart when just the two are merged anew. So no merge queue over the text is needed: Aho-Corasick
gives the longest piece at a position, ``compatible`` re-merges it with its left neighbour (remembered
by pair), a shorter piece is tried where they do not fit, and a bitfield keeps positions from which
nothing fits, so that none is entered twice.

Texts are cut where no piece can reach across: before a word mark that follows another character, and
around characters that are in no piece. Such units repeat, so their ids are remembered in a table of
bounded size. Null texts count as empty; an empty text has no ids.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from antecede.llm.common import forget_others, remembers, rows_of, whole

MARK = "▁"
#: Entries of the tables of remembered units and pairs; full ones start anew.
UNITS, PAIRS = 300_000, 600_000
#: Longer units are encoded each time.
LONGEST_UNIT = 48
_PROBES = ("", " ", "  two  spaces ", "line\nline\r\n\tend", "naïve 漢字 \U0001f600 ͸", "1234567.89", "aaaaaaaaaaaaaaaaa", "<s> </s> <unk> <0x41>")


class PieceCodec:
    """Encoder and decoder for a SentencePiece BPE model with byte fallback, identity normaliser and dummy prefix."""

    def __init__(self, model_path: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = library.get_piece_size()
        plain = [i for i in range(n) if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i) or library.is_unused(i))]
        self.names = {library.id_to_piece(i): i for i in plain}
        self.score = {library.id_to_piece(i): library.get_score(i) for i in plain}
        self.pieces = [library.id_to_piece(i) for i in range(n)]
        self.byte_ids = [library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.alphabet = {p for p in self.names if len(p) == 1}
        if not {c for p in self.names for c in p} <= self.alphabet or any(re.search(f"[^{MARK}]{MARK}", p) for p in self.names):
            raise ValueError("a piece crosses a word mark or has a character that is no piece itself")
        self.automaton = ahocorasick.Automaton()
        for p, i in self.names.items():
            self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.length_of = [len(p) for p in self.pieces]
        #: By piece, the longest shorter piece that it starts with, or -1.
        self.shorter = [next((self.names[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in self.names), -1) for p in self.pieces]
        self.text_of = [p.replace(MARK, " ") for p in self.pieces]
        for i in range(n):
            if library.is_control(i):
                self.text_of[i] = ""
        for b, i in enumerate(self.byte_ids):
            self.text_of[i] = chr(b) if b < 128 else chr(0xDC00 + b)
        self.decimal = [str(i) for i in range(n)]
        self._pairs: dict[tuple[int, int], bool] = {}
        self._single: dict[int, bool] = {}
        self._marked: dict[str, tuple[int, ...]] = {}
        self._bare: dict[str, tuple[int, ...]] = {}
        self.newline = self.byte_ids[10]
        self.newline_cuts = "\n" not in self.alphabet
        for probe in _PROBES:
            if self.encode(probe) != library.encode(probe) or self.decode(self.encode(probe)) != library.decode(library.encode(probe)):
                raise ValueError(f"this model is outside what the codec supports: {probe!r}")

    def merged(self, text: str) -> list[str]:
        """The merge loop itself, for a few characters: best score first, leftmost on ties."""
        symbols = list(text)
        while len(symbols) > 1:
            best, at = None, -1
            for k in range(len(symbols) - 1):
                score = self.score.get(symbols[k] + symbols[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if at < 0:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def stands(self, piece: int) -> bool:
        """Whether a piece's own text encodes to it."""
        if (known := self._single.get(piece)) is None:
            known = self._single[piece] = self.merged(self.pieces[piece]) == [self.pieces[piece]]
        return known

    def compatible(self, left: int, right: int) -> bool:
        """Whether two pieces stay as they are when their texts meet."""
        if (known := self._pairs.get((left, right))) is None:
            if len(self._pairs) >= PAIRS:
                self._pairs.clear()
            a, b = self.pieces[left], self.pieces[right]
            known = self._pairs[left, right] = self.merged(a + b) == [a, b]
        return known

    def span(self, text: str) -> list[int]:
        """Ids of a text all of whose characters are pieces."""
        longest, shorter, length_of, pairs, compatible = self.automaton.iter_long, self.shorter, self.length_of, self._pairs, self.compatible
        n, at, open_ = len(text), 0, (1 << (len(text) + 1)) - 1
        path: list[int] = []
        ahead = longest(text)  # goes on as long as each longest piece is taken
        _, i = next(ahead)
        while True:
            end = at + length_of[i]
            if open_ >> end & 1:
                if path:
                    fits = pairs.get((path[-1], i))
                    if fits is None:
                        fits = compatible(path[-1], i)
                else:
                    fits = self.stands(i)
                if fits:
                    path.append(i)
                    at = end
                    if at == n:
                        return path
                    if ahead is None:
                        ahead = longest(text, at)
                    _, i = next(ahead)
                    continue
            while (i := shorter[i]) < 0:  # nothing fits here: no path may come back to this position
                open_ &= ~(1 << at)
                i = path.pop()
                at -= length_of[i]
            ahead = None

    def unit(self, text: str) -> tuple[int, ...]:
        """Ids of a text; characters outside the alphabet become bytes and keep their neighbours apart."""
        if self.alphabet.issuperset(text):
            return tuple(self.span(text)) if text else ()
        out: list[int] = []
        start = 0
        for k, c in enumerate(text):
            if c not in self.alphabet:
                if k > start:
                    out += self.span(text[start:k])
                out += [self.byte_ids[b] for b in c.encode()]
                start = k + 1
        if start < len(text):
            out += self.span(text[start:])
        return tuple(out)

    def _remember(self, table: dict, key: str, prefix: str) -> tuple[int, ...]:
        ids = self.unit(prefix + key)
        if len(key) <= LONGEST_UNIT:
            if len(table) >= UNITS:
                table.clear()
            table[key] = ids
        return ids

    def _line(self, line: str) -> list[tuple[int, ...]]:
        """Ids by unit of a line that is cut off from its neighbours."""
        bare, *words = line.split(MARK)
        out = [self._bare.get(bare) or self._remember(self._bare, bare, "")] if bare else []
        if "" not in words:
            get, missed, table = self._marked.get, self._remember, self._marked
            return out + [get(w) or missed(table, w, MARK) for w in words]
        return out + [self.unit(u) for u in re.findall(f"{MARK}+[^{MARK}]*", line[len(bare) :])]

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        if not self.newline_cuts:
            return list(chain.from_iterable(self._line(marked)))
        lines = marked.split("\n")
        ids = list(chain.from_iterable(self._line(lines[0])))
        for line in lines[1:]:
            ids.append(self.newline)
            ids.extend(chain.from_iterable(self._line(line)))
        return ids

    def decode_bytes(self, ids: list[int]) -> bytes:
        text = "".join(map(self.text_of.__getitem__, ids))
        if ids and text.startswith(" ") and self.pieces[ids[0]].startswith(MARK):
            text = text[1:]
        return text.encode("utf-8", "surrogateescape")

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


_codecs: dict[str, PieceCodec] = {}


def codec(model_path: str) -> PieceCodec:
    """The worker's codec for a model; workers keep it between tasks, until another operator runs there."""
    forget_others("sentencepiece")
    remembers("sentencepiece", _codecs.clear)
    if model_path not in _codecs:
        _codecs[model_path] = PieceCodec(model_path)
    return _codecs[model_path]


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, ids array<int>, decoded string`` for each row; needs no shuffle."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                ids = [c.encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([c.decode(x) for x in ids], pa.string())], [id_col, "ids", "decoded"])

    return docs.select(F.col(id_col), whole(text_col).alias("_text")).mapInArrow(run, f"`{id_col}` {id_type}, ids array<int>, decoded string")


def digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_tokens, ids_sha256, decoded_sha256``: the same codec, but only digests leave the worker."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for text in rows_of(batch.column(1), 128):
                ids = c.encode(text)
                n.append(len(ids))
                ids_sha.append(sha(",".join(map(c.decimal.__getitem__, ids)).encode()))
                text_sha.append(sha(c.decode_bytes(ids)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col), whole(text_col).alias("_text")).mapInArrow(run, f"`{id_col}` {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
