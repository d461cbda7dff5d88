"""Ranked lexical search of a whole query set: what items share is summed once per document.

An item's score is a sum over its terms.  Term sets that several items of a block have in common are
mined as pairs, then pairs of pairs and so on; every shared set is a node whose partial document
accumulator is the sum of two smaller ones.  For a stretch of documents all accumulators are worked
out once, from the leaves up, and each item adds up the few nodes that its terms were merged into.

Documents become postings of the block's terms first (written once), which give the corpus figures
and feed the scoring.  Items come in blocks of bounded length, so what a task is sent is bounded
whatever the number of items; documents are never grouped.

Defined results: a null text has no terms; a document without terms is not part of the corpus; an
item without terms has no rows; an item is a distinct pair of id and text, so repeated item rows give
one result, and items that share an id but not the text are ranked apart; documents with a repeated
id are ranked each; a null document id comes last among equal scores; texts of any length are read
whole; empty tables give no rows.  Other columns of either table are not used.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crowdtide.session import cut_lineage

TOP = 20
BLOCK_CHARS = 1 << 18       # length of the items evaluated together: bounds what a task is sent
ITEM_CHARS = 64             # counted for every item besides its text
NEIGHBOURS = 32             # terms of an item, by frequency, that a term may be paired with
CELLS = 1 << 22             # accumulator values a task holds at a time
SALTS = 64                  # parts of an item's candidates that are cut to the best before they meet
_TERM_BYTES = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
_SPLIT = bytes((b + 32 if 65 <= b <= 90 else b) if b in _TERM_BYTES else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """All terms of a text in UTF-8, ASCII capitals lowered."""
    return (text or "").encode().translate(_SPLIT).split()


class SharingPlan:
    """Which sums a block of items needs: ``rounds`` of shared pairs, and for each item the nodes it adds up.

    Nodes 0 to ``len(terms) - 1`` are the terms.  A term that an item repeats stands for itself several times.
    """

    def __init__(self, items: list[Counter]):
        holders = Counter(t for bag in items for t in bag)
        self.terms = sorted(holders, key=lambda t: (-holders[t], t))
        number = {t: k for k, t in enumerate(self.terms)}
        # the k-th copy of a term is a node of its own while sets are mined, and the term again when summed
        copies = sorted({(number[t], k) for bag in items for t, n in bag.items() for k in range(n)}, key=lambda c: (c[1], c[0]))
        node_of = {c: k for k, c in enumerate(copies)}
        row_of = [c[0] for c in copies]
        sets = [sorted(node_of[number[t], k] for t, n in bag.items() for k in range(n)) for bag in items]
        self.rounds: list[tuple[np.ndarray, np.ndarray]] = []
        made = len(self.terms)
        while True:
            wanted = Counter(p for nodes in sets for p in _pairs(nodes))
            picked = [_matching(nodes, wanted) for nodes in sets]
            uses = Counter(p for pairs in picked for p in pairs)
            shared = sorted((p for p, n in uses.items() if n > 1), key=lambda p: (-uses[p], p))
            if not shared:
                break
            name = {p: len(row_of) + k for k, p in enumerate(shared)}
            self.rounds.append((np.array([row_of[a] for a, _ in shared]), np.array([row_of[b] for _, b in shared])))
            row_of += range(made, made + len(shared))
            made += len(shared)
            for k, pairs in enumerate(picked):
                merged = [p for p in pairs if p in name]
                gone = {node for p in merged for node in p}
                sets[k] = sorted([node for node in sets[k] if node not in gone] + [name[p] for p in merged])
        self.nodes = made
        self.item_rows = np.array([row_of[node] for nodes in sets for node in nodes], dtype=np.int64)
        self.item_starts = np.cumsum([0] + [len(nodes) for nodes in sets[:-1]])

    def scores(self, leaves: np.ndarray) -> np.ndarray:
        """Items by documents, from an array of nodes by documents whose first rows hold the terms' values."""
        done = len(self.terms)
        for left, right in self.rounds:
            np.add(leaves[left], leaves[right], out=leaves[done:done + len(left)])
            done += len(left)
        return np.add.reduceat(leaves[self.item_rows], self.item_starts, axis=0)


def _pairs(nodes: list[int]) -> Iterator[tuple[int, int]]:
    for k, a in enumerate(nodes):
        for b in nodes[k + 1:k + 1 + NEIGHBOURS]:
            yield a, b


def _matching(nodes: list[int], wanted: Counter) -> list[tuple[int, int]]:
    """Disjoint pairs of one item, the most wanted first."""
    used: set[int] = set()
    out = []
    for a, b in sorted((p for p in _pairs(nodes) if wanted[p] > 1), key=lambda p: (-wanted[p], p)):
        if a not in used and b not in used:
            used |= {a, b}
            out.append((a, b))
    return out


def _postings(number: dict[bytes, int]):
    def build(batches):
        for batch in batches:
            rows, totals, ends, found, counts = [], [], [0], [], []
            for row, text in enumerate(batch.column(1)):
                words = terms_of(text.as_py())
                if words:
                    seen = [(number[t], n) for t, n in Counter(words).items() if t in number]
                    found += [t for t, _ in seen]
                    counts += [n for _, n in seen]
                    rows.append(row)
                    totals.append(len(words))
                    ends.append(len(found))
            edges = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int32())), pa.array(totals, pa.int64()),
                    pa.ListArray.from_arrays(edges, pa.array(found, pa.int32())), pa.ListArray.from_arrays(edges, pa.array(counts, pa.int64())),
                ],
                names=["doc_id", "n_terms", "terms", "counts"],
            )

    return build


class _Best:
    """The best ``top`` documents of each item so far."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.held: list = [None] * items
        self.floor = np.ones(items, dtype=np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        good = scores >= self.floor[:, None]
        for item in np.flatnonzero(good.any(axis=1)):
            at = np.flatnonzero(good[item])
            new = (scores[item, at], ids[at], null[at])
            if self.held[item] is not None:
                new = tuple(np.concatenate(both) for both in zip(self.held[item], new, strict=True))
            order = np.lexsort((new[1], new[2], -new[0]))[:self.top]
            self.held[item] = tuple(column[order] for column in new)
            if len(order) == self.top:
                self.floor[item] = self.held[item][0][-1]


def _scoring(plan: SharingPlan, weights: np.ndarray, n_docs: int, n_terms: int, top: int):
    width = max(1, CELLS // plan.nodes)
    items = len(plan.item_starts)

    def score(batches):
        best, kind = _Best(items, top), None
        for batch in batches:
            kind = batch.column(0).type
            null = np.asarray(batch.column(0).is_null())
            ids = batch.column(0).fill_null(0 if pa.types.is_integer(kind) else "").to_numpy(zero_copy_only=False)
            ids = ids if pa.types.is_integer(kind) else ids.astype(str)
            norms = 75 + (25 * batch.column(1).to_numpy() * n_docs) // n_terms
            edges = batch.column(2).offsets.to_numpy()
            terms, counts = batch.column(2).values.to_numpy(), batch.column(3).values.to_numpy()
            for first in range(0, batch.num_rows, width):
                last = min(batch.num_rows, first + width)
                low, high = edges[first], edges[last]
                doc = np.repeat(np.arange(last - first), np.diff(edges[first:last + 1]))
                t, tf = terms[low:high], counts[low:high]
                leaves = np.zeros((plan.nodes, last - first), dtype=np.int64)
                leaves[t, doc] = weights[t] * ((1_000_000_000 * tf) // (1000 * tf + 12 * norms[first + doc]))
                best.add(plan.scores(leaves), ids[first:last], null[first:last])
        for item, held in enumerate(best.held):
            if held is not None:
                ids = pa.array([None if gone else x for x, gone in zip(held[1].tolist(), held[2], strict=True)], kind)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), item, dtype=np.int32)), ids, pa.array(held[0])], names=["item", "doc_id", "score"])

    return score


def _search_block(docs: DataFrame, block: list, top: int) -> DataFrame:
    """item (its place in the block), rank, doc_id and score."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    plan = SharingPlan([Counter(terms_of(r["text"])) for r in block])
    number = {t: k for k, t in enumerate(plan.terms)}
    postings = cut_lineage(docs.mapInArrow(_postings(number), f"doc_id {kind}, n_terms long, terms array<int>, counts array<long>"))
    n_docs, n_terms = postings.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    weights = np.zeros(len(plan.terms), dtype=np.int64)
    # one row for each of the block's terms
    for r in postings.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect():
        weights[r["t"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1)))
    found = postings.mapInArrow(_scoring(plan, weights, n_docs, n_terms, top), f"item int, doc_id {kind}, score long")
    best_first = [F.desc("score"), F.asc_nulls_last("doc_id")]
    for part in (["item", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))], ["item"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*part).orderBy(*best_first))).where(F.col("rank") <= top)
    return found


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """item_id, rank, doc_id and score of each item's ``top`` highest-scoring documents (ids: integers or strings)."""
    spark = docs.sparkSession
    corpus = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    asked = items.select("item_id", F.col("text").cast("string").alias("text")).where(F.col("text").rlike(r"[0-9A-Za-z]|[^\x00-\x7F]")).distinct()
    asked = cut_lineage(asked)
    blocks = math.ceil((asked.agg(F.sum(F.length("text") + ITEM_CHARS)).first()[0] or 0) / block_chars)
    out = None
    for k in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        if block:
            names = spark.createDataFrame([(n, r["item_id"]) for n, r in enumerate(block)], f"item int, item_id {asked.schema['item_id'].dataType.simpleString()}")
            found = _search_block(corpus, block, top).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
            out = found if out is None else out.unionByName(found)
    if out is None:
        return corpus.limit(0).join(asked.select("item_id").limit(0)).select("item_id", F.lit(1).alias("rank"), "doc_id", F.lit(0).cast("long").alias("score"))
    return out
