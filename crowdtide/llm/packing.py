"""Vector bin packing of tokenised examples into fixed-length training sequences.

A sequence has three limits at once: tokens, segments (pieces of documents) and loss-bearing
tokens.  Longer examples are cut into full sequences first.  The rest is placed by the dot-product
heuristic: of the waiting pieces that fit, the one goes in whose demand has the largest inner
product with what the sequence has left; a last gap is filled by cutting a waiting piece.  Every
task packs its own documents as they stream by, with a bounded number of pieces waiting, so nothing
is shuffled and only a task's last sequence is left open.

The loss-bearing tokens of a piece are all but its first, which nothing precedes.

Defined results: a null text counts as empty and gives the end token alone; null and repeated ids
are carried through; a document of any length is cut, never shortened; an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdtide.llm.bpe import byte_letters
from crowdtide.llm.memory import WordMemory

LENGTH = 2048
MAX_SEGMENTS = 64
MAX_LOSS = 2048
WAITING = 512          # pieces a task holds back to choose from
SHORTEST_CUT = 4       # a gap below this is padded rather than filled with a cut piece
END_ID = 1
SIMPLE = 0x2B0         # characters below are composed, and lowered one by one whatever stands beside them
FIELDS = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _kinds(first: str) -> str:
    """A character class of all characters below the limit whose category starts so."""
    return "".join(re.escape(chr(c)) for c in range(SIMPLE) if unicodedata.category(chr(c))[0] == first)


class WordTokens(WordMemory):
    """Ids of whole texts by a vocabulary of lowered words, as little-endian bytes.

    Words of ordinary texts are looked up in a bounded memory of what the library's merges gave.
    Texts with other characters, or with a special token's string, go to the library whole.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.letters = byte_letters()
        self.library.no_padding()
        self.library.no_truncation()
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        odd = f"[^\\x00-{re.escape(chr(SIMPLE - 1))}]|[\\x1c-\\x1f\\x85İȺȾ]"
        self.odd = re.compile("|".join([odd, *map(re.escape, special)]))
        letters, numbers = _kinds("L"), _kinds("N")
        self.words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\\s{letters}{numbers}]+")

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def work_out(self, word: str) -> bytes:
        letters = word if word.isascii() and word.isprintable() else "".join(map(self.letters.__getitem__, word.encode()))
        return np.array([t.id for t in self.library.model.tokenize(letters)], dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if self.odd.search(text):
            return self.whole(text)
        return b"".join(map(self.__getitem__, self.words.findall(text.lower())))


_LOADED: dict[str, WordTokens] = {}


def tokens(path: str) -> WordTokens:
    if path not in _LOADED:
        _LOADED[path] = WordTokens(path)
    return _LOADED[path]


class Packer:
    """Places pieces; hands on finished sequences as lists of (document, start, ids, offset)."""

    def __init__(self, length=LENGTH, max_segments=MAX_SEGMENTS, max_loss=MAX_LOSS, waiting=WAITING):
        self.limits = np.array([length, max_segments, max_loss], dtype=np.float64)
        self.length, self.waiting = length, waiting
        # the longest piece that a sequence takes: its tokens and its loss must both fit
        self.longest = int(min(length, max_loss + 1))
        self.pieces: list[tuple] = []

    @staticmethod
    def loss(tokens: int) -> int:
        return max(tokens - 1, 0)

    def add(self, document, ids: bytes) -> Iterator[list[tuple]]:
        n = len(ids) // 4
        start = 0
        while n - start >= self.longest:
            yield [(document, start, ids[4 * start:4 * (start + self.longest)], 0)]
            start += self.longest
        if start < n:
            self.pieces.append((document, start, ids[4 * start:]))
        if len(self.pieces) >= 2 * self.waiting:
            yield from self.place(self.waiting)

    def finish(self) -> Iterator[list[tuple]]:
        yield from self.place(0)

    def place(self, keep: int) -> Iterator[list[tuple]]:
        """Build sequences until no more than ``keep`` pieces wait."""
        size = np.array([len(p[2]) // 4 for p in self.pieces], dtype=np.float64)
        demand = np.stack([size, np.ones(len(size)), np.maximum(size - 1, 0)], axis=1)
        there = np.ones(len(size), dtype=bool)
        while there.sum() > keep:
            left, placed, offset = self.limits.copy(), [], 0
            while True:
                fits = there & (demand <= left).all(axis=1)
                if fits.any():
                    score = (demand / self.limits) @ (left / self.limits)
                    k = int(np.where(fits, score, -1.0).argmax())
                    document, start, ids = self.pieces[k]
                    there[k] = False
                elif left[1] >= 1 and there.any() and (room := int(min(left[0], left[2] + 1))) >= SHORTEST_CUT:
                    k = int(np.where(there, size, -1.0).argmax())  # nothing fits, so all are longer than the gap
                    document, start, whole = self.pieces[k]
                    ids = whole[:4 * room]
                    self.pieces[k] = (document, start + room, whole[4 * room:])
                    size[k] -= room
                    demand[k] = size[k], 1, max(size[k] - 1, 0)
                else:
                    break
                placed.append((document, start, ids, offset))
                n = len(ids) // 4
                offset += n
                left -= (n, 1, self.loss(n))
            yield placed
        self.pieces = [p for p, t in zip(self.pieces, there, strict=True) if t]


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_LOSS, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: where it stands in its document and in its sequence; ``ids`` too if asked for."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    names = ["doc_id", *(f.split()[0] for f in FIELDS.split(", ")), *(["ids"] if with_ids else [])]
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, packer = tokens(path), Packer(length, max_segments, max_loss)
        sequence = TaskContext.get().partitionId() << 40
        kind, ready = None, []

        def batch_of(rows):
            columns = list(zip(*rows, strict=True))
            arrays = [pa.array([d[0] for d in columns[0]], kind), pa.array(columns[1], pa.int64()), pa.array([len(i) // 4 for i in columns[2]], pa.int64()),
                      pa.array([zlib.crc32(i) for i in columns[2]], pa.int64()), pa.array([d[1] for d in columns[0]], pa.int64()),
                      pa.array(columns[4], pa.int64()), pa.array(columns[3], pa.int64())]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(i, "<u4").astype(np.int32) for i in columns[2]], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, names=names)

        def sequences():
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field(0).type
                for who, text in zip(batch.column(0), batch.column(1), strict=True):
                    ids = coder.encode(text.as_py() or "") + end
                    yield from packer.add((who.as_py(), len(ids) // 4), ids)
            yield from packer.finish()

        for placed in sequences():
            ready += [(*piece, sequence) for piece in placed]
            sequence += 1
            if len(ready) >= 2000:
                yield batch_of(ready)
                ready = []
        if ready:
            yield batch_of(ready)

    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, {FIELDS}" + (", ids array<int>" if with_ids else "")
    return source.mapInArrow(run, schema)
