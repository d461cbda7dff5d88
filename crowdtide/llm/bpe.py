"""Byte-pair encoding and decoding with the merge table of a published vocabulary.

Symbols of a word form a doubly linked list.  A priority queue holds the merge ranks of adjacent
pairs; an entry whose symbols have meanwhile been merged is stale and skipped.  Decoding
concatenates the vocabulary's strings.

Defined results: a null text is encoded as an empty one (no ids), null and repeated ids are
carried through, a special token's string in a text becomes its id, as the vocabulary's library does.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdtide.llm.memory import WordMemory

# Fixed value: the pattern that splits text for this vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
STRETCH = 50_000           # words of one text that are held at a time


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: printable ones for themselves, the others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class Encoder(WordMemory):
    """Maps a word to its ids as little-endian bytes."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        vocab, letters = model["model"]["vocab"], byte_letters()
        self.byte_ids = [vocab[letters[b]] for b in range(256)]
        self.merges = {}
        for rank, pair in enumerate(model["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[left], vocab[right]] = (rank, vocab[left + right])
        backward = {c: b for b, c in letters.items()}
        self.strings = {i: bytes(backward[c] for c in token) for token, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.strings |= {i: s.encode() for s, i in self.special.items()}
        self.words = regex.compile(SPLIT)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def merge(self, symbols: list[int]) -> list[int]:
        """Apply the merges, lowest rank first, leftmost first among equals."""
        n = len(symbols)
        if n < 2:
            return symbols
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = []
        for k in range(n - 1):
            if found := self.merges.get((symbols[k], symbols[k + 1])):
                queue.append((found[0], k, symbols[k], symbols[k + 1], found[1]))
        heapq.heapify(queue)
        while queue:
            _, k, left, right, joined = heapq.heappop(queue)
            k2 = after[k]
            if symbols[k] != left or k2 < 0 or symbols[k2] != right:
                continue  # stale: one of the two has been merged since
            symbols[k], symbols[k2] = joined, -1
            after[k] = after[k2]
            if after[k] >= 0:
                before[after[k]] = k
            after[k2] = -1
            if (p := before[k]) >= 0 and (found := self.merges.get((symbols[p], joined))):
                heapq.heappush(queue, (found[0], p, symbols[p], joined, found[1]))
            if (q := after[k]) >= 0 and (found := self.merges.get((joined, symbols[q]))):
                heapq.heappush(queue, (found[0], k, joined, symbols[q], found[1]))
        return [s for s in symbols if s >= 0]

    def work_out(self, word: str) -> bytes:
        return np.array(self.merge([self.byte_ids[b] for b in word.encode()]), dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        parts = self.marks.split(text) if self.marks else [text]
        out = []
        for part in parts:
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
            elif len(part) <= 8 * STRETCH:
                out.append(b"".join(map(self.__getitem__, self.words.findall(part))))
            else:  # a very long text: a bounded stretch of words at a time
                found = (m[0] for m in self.words.finditer(part))
                while words := list(islice(found, STRETCH)):
                    out.append(b"".join(map(self.__getitem__, words)))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Invalid UTF-8, which only foreign ids can give, comes out as replacement characters."""
        numbers = np.frombuffer(ids, "<u4")
        return b"".join(map(self.strings.__getitem__, numbers.tolist())).decode("utf-8", errors="replace")


_LOADED: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``ids``, an array of integers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                ids = [np.frombuffer(coder.encode(t.as_py() or ""), "<u4").astype(np.int32) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and ``text`` from the result of encode_texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            texts = [coder.decode(np.asarray(ids.as_py() or [], "<u4").tobytes()) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the text decoded from them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            counts, hashes, decoded = [], [], []
            for text in batch.column(1):
                ids = coder.encode(text.as_py() or "")
                counts.append(len(ids) // 4)
                hashes.append(hashlib.sha256(ids).hexdigest())
                decoded.append(hashlib.sha256(coder.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
