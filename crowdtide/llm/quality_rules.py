"""Quality rules kept as a ledger of failure bits.

Every rule is evaluated once per document.  The ledger holds the measurements and one bit per
failed rule; policies are masks over these bits, so a new policy, or the question what a rule
costs, needs no second look at the texts.

Defined results: a null text counts as empty (no words, fails the length rule only), null and
repeated ids are carried through, extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdtide.llm.words import pieces, word_hashes, word_spans

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper_words")
# name -> condition under which a document fails
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 10 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "repeated_lines": "100 * n_dup_lines > 70 * n_lines",
    "shouting": "100 * n_upper_words > 30 * n_words",
}
BITS = {name: 1 << k for k, name in enumerate(RULES)}
BASE = ("few_words", "repeated_words")
#: Policies by version; a document is kept if it fails none of the policy's rules.
POLICIES = {
    "1": BASE,
    "2": (*BASE, "symbols", "short_words", "long_words"),
    "3": tuple(RULES),
}
CURRENT = "3"


def _sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[edges[1:]] - total[edges[:-1]]


def _table(chars: bytes) -> np.ndarray:
    has = np.zeros(256, dtype=bool)
    has[list(chars)] = True
    return has


SYMBOL = _table(b"#*$%&|<>")
UPPER = _table(bytes(range(65, 91)))
LOWER = _table(bytes(range(97, 123)))


def _repeats(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which (row, hash) entries occur twice or more in their row, and which are not the first."""
    order = np.lexsort((np.arange(len(hashes)), hashes, rows))
    h, r = hashes[order], rows[order]
    same = np.zeros(len(h), dtype=bool)
    same[1:] = (h[1:] == h[:-1]) & (r[1:] == r[:-1])
    twice = same.copy()
    twice[:-1] |= same[1:]
    out = np.zeros((2, len(h)), dtype=bool)
    out[0, order], out[1, order] = twice, same
    return out


def _measure(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    n = len(offsets) - 1
    starts, stops, edges = word_spans(data, offsets)
    counts = np.diff(edges)
    point = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
    symbols = _sums(SYMBOL[data], offsets)
    # lines: between line feeds and row ends
    breaks = np.flatnonzero(data == 10)
    line_starts = np.union1d(breaks + 1, offsets[:-1][offsets[:-1] < offsets[1:]])
    line_starts = line_starts[line_starts < len(data)]
    row_of = np.searchsorted(offsets, line_starts, side="right") - 1
    next_break = np.append(breaks, len(data))[np.searchsorted(breaks, line_starts)]
    line_stops = np.minimum(next_break, offsets[row_of + 1])
    worded = np.searchsorted(starts, line_stops) > np.searchsorted(starts, line_starts)
    line_starts, line_stops, row_of = line_starts[worded], line_stops[worded], row_of[worded]
    again = _repeats(word_hashes(data, line_starts, line_stops, lower=False), row_of)[1]
    # words in three-word windows that occur twice or more
    words = word_hashes(data, starts, stops, lower=False)
    full = np.maximum(counts - 2, 0)
    window_rows = np.repeat(np.arange(n), full)
    first = np.repeat(edges[:-1] - (np.cumsum(full) - full), full) + np.arange(full.sum())
    trio = words[first] * np.uint64(3) + words[first + 1] * np.uint64(0x9E3779B97F4A7C15) + words[np.minimum(first + 2, max(len(words) - 1, 0))] * np.uint64(0xC2B2AE3D27D4EB4F)
    repeated = first[_repeats(trio, window_rows)[0]]
    covered = np.zeros(len(words) + 2, dtype=bool)
    for k in range(3):
        covered[repeated + k] = True
    uppers = np.concatenate([[0], np.cumsum(UPPER[data], dtype=np.int64)])
    lowers = np.concatenate([[0], np.cumsum(LOWER[data], dtype=np.int64)])
    shouted = (uppers[stops] - uppers[starts] >= 2) & (lowers[stops] == lowers[starts])
    return [
        counts.astype(np.int64), _sums(point[stops] - point[starts], edges), symbols, np.bincount(row_of, minlength=n).astype(np.int64),
        np.bincount(row_of[again], minlength=n).astype(np.int64), _sums(covered[:len(words)], edges), _sums(shouted, edges),
    ]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, data, offsets in pieces(batch.column(1)):
            rows = len(offsets) - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, rows), *map(pa.array, _measure(data, offsets))], names=["doc_id", *MEASURES]
            )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measurements and ``fail_mask``, one bit per failed rule."""
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{m} long" for m in MEASURES)
    measured = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_measured, schema)
    bits = [F.when(F.expr(rule), F.lit(BITS[name])).otherwise(F.lit(0)).cast("long") for name, rule in RULES.items()]
    return measured.withColumn("fail_mask", reduce(lambda a, b: a.bitwiseOR(b), bits))


def policy_mask(rules) -> int:
    return sum(BITS[name] for name in rules)


def verdict(mask, version: str = CURRENT):
    """Column: does a document with these failure bits pass the policy?"""
    return mask.bitwiseAND(F.lit(policy_mask(POLICIES[version])).cast("long")) == 0


def ablation(book: DataFrame, version: str = CURRENT) -> DataFrame:
    """Per rule of the policy: documents it fails, and those that only it keeps out.

    The ledger shrinks to a count per combination of failed bits before anything is shuffled;
    there are at most 2 ** len(RULES) of them, whatever the number of documents.
    """
    mask = policy_mask(POLICIES[version])
    per_mask = book.groupBy(F.col("fail_mask").bitwiseAND(F.lit(mask).cast("long")).alias("failed")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(BITS[name]).cast("long").alias("bit")) for name in POLICIES[version]])
    return (
        per_mask.select("failed", "n", F.explode(rules).alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("failed").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("failed") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
            F.sum("n").alias("n_documents"),
        )
    )
