"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of 64 words.  Every passage is encoded; gated attention weighs the
encodings; the weighted mean gives the score.  Only documents have labels, so the attention learns
from them which passages matter.  Scoring reads every passage of every text.

The model is fitted on a bounded sample of labelled rows (``MAX_TRAIN``), those with the smallest
hashed ids; its weights have a fixed size, whatever the corpus.

Inputs are counts of characters and words of the text alone.

Defined results: a null text counts as empty; a text without words is one passage without words;
null and repeated ids are scored like others (a null id counts as not held out); labels that are
null, or of ids without a document, are left out; without any label of both kinds the score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdtide.llm.words import pieces, word_hashes, word_spans
from crowdtide.session import cut_lineage

PASSAGE = 64
HASHED = 16            # signed buckets for the words themselves
HIDDEN = 24
ATTENTION = 16
MAX_TRAIN = 6000       # labelled documents the model is fitted on, at most
STEPS = 160
RATE = 0.02
DECAY = 1e-3
THRESHOLD = 0.3
FOLDS = 5

_CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "symbol": b"#*$%&|<>{}[]\\^~=@_+/",
    "stop": b".", "comma": b",;:", "shout": b"!?", "quote": b"\"'()-",
}
_TABLES = np.zeros((len(_CLASSES), 256), dtype=bool)
for _k, _chars in enumerate(_CLASSES.values()):
    _TABLES[_k, list(_chars)] = True
DENSE = len(_CLASSES) * 2 + 9
FEATURES = DENSE + HASHED


def _seen_before(hashes: np.ndarray, of: np.ndarray) -> np.ndarray:
    order = np.lexsort((hashes, of))
    h, o = hashes[order], of[order]
    same = np.zeros(len(order), dtype=bool)
    same[order[1:]] = (h[1:] == h[:-1]) & (o[1:] == o[:-1])
    return same


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all passages, and the row of the text each belongs to; every text has one at least."""
    n = len(offsets) - 1
    starts, stops, edges = word_spans(data, offsets)
    words = np.diff(edges)
    per_row = np.maximum(1, -(-words // PASSAGE))
    first = np.concatenate([[0], np.cumsum(per_row)])
    row_of_word = np.repeat(np.arange(n), words)
    place = np.arange(len(starts)) - edges[:-1][row_of_word]
    of = first[row_of_word] + place // PASSAGE
    total = int(first[-1])
    sums = lambda values: np.bincount(of, weights=values, minlength=total)
    size = np.maximum(sums(np.ones(len(of))), 1)
    bytes_of = (stops - starts).astype(np.float64)
    chars = np.maximum(sums(bytes_of), 1)
    out = np.zeros((total, FEATURES), dtype=np.float32)
    counts = []
    for k in range(len(_CLASSES)):
        run = np.concatenate([[0], np.cumsum(_TABLES[k][data], dtype=np.int64)])
        found = run[stops] - run[starts]
        counts.append(found)
        out[:, 2 * k] = sums(found) / chars           # share of characters
        out[:, 2 * k + 1] = sums(found > 0) / size    # share of words that have one
    base = 2 * len(_CLASSES)
    lower, upper, _, symbol = counts[:4]
    out[:, base] = sums((upper > 1) & (lower == 0)) / size
    out[:, base + 1] = sums(symbol == bytes_of) / size
    out[:, base + 3] = chars / size / 10
    out[:, base + 4] = np.sqrt(np.maximum(sums(bytes_of ** 2) / size - (chars / size) ** 2, 0)) / 10
    out[:, base + 5] = np.log1p(size) / 5
    hashes = word_hashes(data, starts, stops)
    # words, and pairs of words, seen before in the passage; words that are the one before again
    again = np.zeros(len(of), dtype=bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    out[:, base + 2] = sums(again) / size
    out[:, base + 6] = sums(_seen_before(hashes, of)) / size
    pairs = hashes.copy()
    pairs[1:] += hashes[:-1] * np.uint64(3)
    out[:, base + 8] = sums(_seen_before(pairs, of)) / size
    out[:, base + 7] = np.log1p(np.repeat(words, per_row)) / 10
    bucket = (hashes % np.uint64(HASHED)).astype(np.int64)
    sign = np.where((hashes >> np.uint64(32)) & np.uint64(1), 1.0, -1.0)
    bag = np.bincount(of * HASHED + bucket, weights=sign, minlength=total * HASHED).reshape(total, HASHED)
    out[:, DENSE:] = bag / np.sqrt(size)[:, None]
    return out, np.repeat(np.arange(n), per_row)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    """Encoder, gated attention and head; plain arrays, so it travels with the task."""

    NAMES = ("encode", "encode_bias", "value", "gate", "attend", "head", "head_bias")

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.mean, self.scale = np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32)
        self.encode, self.encode_bias = draw(FEATURES, HIDDEN), np.zeros(HIDDEN, np.float32)
        self.value, self.gate, self.attend = draw(HIDDEN, ATTENTION), draw(HIDDEN, ATTENTION), draw(ATTENTION, 1)
        self.head, self.head_bias = draw(HIDDEN, 1), np.zeros(1, np.float32)

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) * self.scale, -8, 8)

    def forward(self, x: np.ndarray, bag: np.ndarray) -> tuple:
        """``bag``: rising document numbers of the passages, every number from 0 on in use."""
        starts = np.flatnonzero(np.r_[True, bag[1:] != bag[:-1]])
        h = np.tanh(self.standard(x) @ self.encode + self.encode_bias)
        value, gate = np.tanh(h @ self.value), _sigmoid(h @ self.gate)
        weight = (value * gate @ self.attend)[:, 0]
        weight = np.exp(weight - np.maximum.reduceat(weight, starts)[bag])
        weight /= np.add.reduceat(weight, starts)[bag]
        pooled = np.add.reduceat(h * weight[:, None], starts)
        return starts, h, value, gate, weight, pooled, _sigmoid(pooled @ self.head + self.head_bias)[:, 0]

    def scores(self, x: np.ndarray, bag: np.ndarray) -> np.ndarray:
        return self.forward(x, bag)[-1]

    def fit(self, x: np.ndarray, bag: np.ndarray, y: np.ndarray) -> Model:
        self.mean = x.mean(axis=0)
        self.scale = 1 / np.maximum(x.std(axis=0), 0.02)
        z = self.standard(x)
        weight_of = np.where(y > 0, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
        moments = {n: [np.zeros_like(getattr(self, n)), np.zeros_like(getattr(self, n))] for n in self.NAMES}
        for step in range(1, STEPS + 1):
            starts, h, value, gate, a, pooled, p = self.forward(x, bag)
            error = ((p - y) * weight_of / len(y))[:, None].astype(np.float32)
            d_pooled = (error @ self.head.T)[bag]
            d_weight = (d_pooled * h).sum(axis=1)
            d_score = (a * (d_weight - np.add.reduceat(a * d_weight, starts)[bag]))[:, None]
            d_gated = d_score @ self.attend.T
            d_value, d_gate = d_gated * gate * (1 - value ** 2), d_gated * value * gate * (1 - gate)
            d_h = (d_pooled * a[:, None] + d_value @ self.value.T + d_gate @ self.gate.T) * (1 - h ** 2)
            grads = {
                "encode": z.T @ d_h, "encode_bias": d_h.sum(axis=0), "value": h.T @ d_value, "gate": h.T @ d_gate,
                "attend": (value * gate).T @ d_score, "head": pooled.T @ error, "head_bias": error.sum(axis=0),
            }
            for name, grad in grads.items():
                now = getattr(self, name)
                first, second = moments[name]
                grad = grad + DECAY * now
                first += 0.1 * (grad - first)
                second += 0.001 * (grad * grad - second)
                now -= (RATE * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
        return self


def held_out(id_column):
    """Rows whose label is not learnt from."""
    return F.coalesce(F.crc32(id_column.cast("string")) % FOLDS == 0, F.lit(False))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, data, offsets in pieces(batch.column(1)):
            x, row = passages(data, offsets)
            rows = len(offsets) - 1
            cuts = np.searchsorted(row, np.arange(rows + 1))
            packed = [x[cuts[k]:cuts[k + 1]].astype("<f4").tobytes() for k in range(rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, rows), pa.array(packed, pa.binary()), batch.column(2).slice(first, rows)], names=["doc_id", "x", "y"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN) -> Model | None:
    """The model fitted on at most ``max_train`` labelled documents that are not held out; None without both labels."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("y").alias("y")).where(~held_out(F.col("doc_id")))
    sample = cut_lineage(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    # the sample has at most max_train rows of two numbers, so it is safe to send to every executor
    joined = texts.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "y")
    kind = joined.schema["doc_id"].dataType.simpleString()
    rows = joined.mapInArrow(_featured, f"doc_id {kind}, x binary, y int").toPandas().sort_values("doc_id", kind="stable")
    if rows["y"].nunique() < 2:
        return None
    bags = [np.frombuffer(x, "<f4").reshape(-1, FEATURES) for x in rows["x"]]
    return Model().fit(np.concatenate(bags), np.repeat(np.arange(len(bags)), [len(b) for b in bags]), rows["y"].to_numpy(np.float32))


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in pieces(batch.column(1)):
                rows = len(offsets) - 1
                scores = model.scores(*passages(data, offsets)).astype(np.float64) if model else np.full(rows, 0.5)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, rows), pa.array(scores)], names=["doc_id", "score"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that the model accepts, all columns, in place: no join, so ids may repeat or be null."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in pieces(batch.column(at)):
                rows = len(offsets) - 1
                if model:
                    good = model.scores(*passages(data, offsets)) >= threshold
                    yield batch.slice(first, rows).filter(pa.array(good))
                else:
                    yield batch.slice(first, rows)

    return docs.mapInArrow(run, docs.schema)
