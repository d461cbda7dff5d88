"""Exact duplicates by counting quotient filters.

Every partition builds a counting quotient filter of its texts' 64-bit fingerprints: the high bits
are the quotient (a slot range), the low bits the remainder, stored sorted with a count each.
Filters of a slot range merge without loss by merging their sorted remainders.  A fingerprint
counted once is a text of its own; the texts of all others are compared byte by byte.

Defined results: a null text equals an empty one; rows with a null id take part and never stay if
another row of the group has an id; repeated rows are all returned; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdtide.session import cut_lineage

SLOT_ROWS = 100_000       # rows for which a slot range is provided: bounds what one merge task holds
RUN = 20_000              # fingerprints a partition gathers before it hands a filter on
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


class QuotientFilter:
    """Sorted remainders with counts for each quotient; ``bits`` is the width of the quotient."""

    def __init__(self, bits: int):
        self.bits = bits
        self.slots: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, fingerprints: np.ndarray) -> None:
        values, counts = np.unique(fingerprints, return_counts=True)
        shift = np.uint64(64 - self.bits)
        quotients = (values >> shift) if self.bits else np.zeros(len(values), dtype=np.uint64)
        remainders = values & ((np.uint64(1) << shift) - np.uint64(1)) if self.bits else values
        edges = np.flatnonzero(np.r_[True, quotients[1:] != quotients[:-1]]) if len(values) else []
        for a, b in zip(edges, [*edges[1:], len(values)], strict=True):
            self.merge(int(quotients[a]), remainders[a:b], counts[a:b])

    def merge(self, quotient: int, remainders: np.ndarray, counts: np.ndarray) -> None:
        """Add another filter's sorted run of one quotient."""
        if quotient in self.slots:
            mine, n = self.slots[quotient]
            both, at = np.unique(np.concatenate([mine, remainders]), return_inverse=True)
            total = np.zeros(len(both), dtype=np.int64)
            np.add.at(total, at, np.concatenate([n, counts]))
            remainders, counts = both, total
        self.slots[quotient] = (remainders, counts.astype(np.int64))

    def repeated(self, quotient: int) -> np.ndarray:
        """Fingerprints counted more than once."""
        remainders, counts = self.slots[quotient]
        found = remainders[counts > 1]
        return found | (np.uint64(quotient) << np.uint64(64 - self.bits)) if self.bits else found


def normalised(texts: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes with ASCII capitals lowered; null is empty."""
    for text in texts.cast(pa.large_binary()):
        yield (text.as_py() or b"").translate(_LOWER)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = [hashlib.sha256(t).digest() for t in normalised(batch.column(1))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(digests, pa.binary()), pa.array([int.from_bytes(d[:8], "little", signed=True) for d in digests], pa.int64())],
            names=["doc_id", "digest", "fp"],
        )


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = list(normalised(batch.column(0)))
        fps = [int.from_bytes(hashlib.sha256(t).digest()[:8], "little", signed=True) for t in texts]
        yield pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), pa.array(texts, pa.binary())], names=["fp", "bytes"])


def _filters(bits: int):
    def build(batches):
        def handed(kept):
            got = list(kept.slots.items())
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([q for q, _ in got], pa.int64()), pa.array([r.astype("<u8").tobytes() for _, (r, _) in got], pa.binary()),
                    pa.array([c.astype("<i8").tobytes() for _, (_, c) in got], pa.binary()),
                ],
                names=["quotient", "remainders", "counts"],
            )

        kept, rows = QuotientFilter(bits), 0
        for batch in batches:
            kept.add(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            rows += batch.num_rows
            if rows >= RUN:
                yield handed(kept)
                kept, rows = QuotientFilter(bits), 0
        yield handed(kept)

    return build


def _merged(bits: int):
    def merge(key, group):
        quotient, kept = key[0].as_py(), QuotientFilter(bits)
        for remainders, counts in zip(group.column("remainders"), group.column("counts"), strict=True):
            kept.merge(quotient, np.frombuffer(remainders.as_py(), "<u8"), np.frombuffer(counts.as_py(), "<i8"))
        return pa.table({"fp": pa.array(kept.repeated(quotient).view(np.int64))})

    return merge


def repeated_fingerprints(prints: DataFrame, rows: int) -> DataFrame:
    """``fp`` of all fingerprints that occur more than once, from merged filters."""
    bits = max(0, int(np.ceil(np.log2(max(rows, 1) / SLOT_ROWS))))
    built = prints.select("fp").mapInArrow(_filters(bits), "quotient long, remainders binary, counts binary")
    return built.groupBy("quotient").applyInArrow(_merged(bits), "fp long")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for every row."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    prints = cut_lineage(source.mapInArrow(_digests, f"doc_id {kind}, digest binary, fp long"))
    suspects = cut_lineage(repeated_fingerprints(prints, prints.count()))
    # Copies meet as whole byte strings, partly counted before the shuffle; so a fingerprint or a
    # digest alone never makes two texts equal.
    texts = source.select("text").mapInArrow(_texts, "fp long, bytes binary").join(suspects, "fp", "left_semi")
    same = texts.groupBy("bytes").agg(F.count(F.lit(1)).alias("n"))
    verified = same.select(F.unhex(F.sha2("bytes", 256)).alias("digest"), F.col("n").alias("group_size")).where("group_size > 1")
    keeps = prints.join(suspects, "fp", "left_semi").groupBy("digest").agg(F.max("doc_id").alias("top"))
    groups = cut_lineage(verified.join(keeps, "digest"))
    # a digest stands for one byte string only; two would show as two rows here
    twice = groups.groupBy("digest").count().where("count > 1")
    if not twice.isEmpty():
        raise ValueError("two different texts have the same SHA-256 digest")
    size = F.coalesce("group_size", F.lit(1)).cast("long")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("top"))
    return (
        prints.join(groups, "digest", "left")
        .select("doc_id", keep.alias("keep_id"), size.alias("group_size"), F.lower(F.hex("digest")).alias("text_sha256"))
        .withColumn("kept", (F.col("group_size") == 1) | F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)))
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns; ids must be unique here."""
    kept = exact_groups(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias("_keep"))
    return docs.join(kept, docs[id_col].eqNullSafe(kept["_keep"]), "left_semi")
