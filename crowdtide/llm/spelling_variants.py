"""Spelling variants of a vocabulary, by asymmetric chunks.

Two words are near if one inserted, deleted or replaced code point turns one into the other.  The shorter
word (either, at equal lengths) is cut into two disjoint chunks, its halves: one edit leaves one of
them whole.  The longer word contributes its grams of the chunks' lengths at the places where a
whole chunk can stand, at its own place before the edit and, if it is longer, shifted by one behind
it.  A half is shared by far too many words of a large vocabulary, so the rule is used once more on
what is left: of the other half, one of its two chunks is whole as well.  A join key is thus a word
without one of its four quarters, from the word itself or, with the shift, from a word one longer.
So each word gives eight keys whatever its length, and words that meet differ in a quarter only.
Pairs that meet are verified; a hash of the key only decides who meets.

Words are counted before they are shuffled, and everything after works on distinct words.

Defined results: a null text has no words; repeated rows count again; a null document id counts as
empty text; texts and words of any length are read whole; of near words with equal counts the smaller
in code-point order is the form; an empty table gives no rows.  Other columns are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crowdtide.session import cut_lineage

MIN_CHARS = 7
MIN_COUNT = 2
RATIO = 10                  # how many times as frequent a word's form must be
JUMPS = 6                   # of doubling length; forms grow RATIO times a step, so 19 steps hold any count
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def without_char(word: Column, place: Column) -> Column:
    """A word without its code point at ``place`` (from 0)."""
    return F.concat(F.substring(word, F.lit(1), place.cast("int")), F.substring(word, place.cast("int") + 2, F.length(word)))


def typing_noise(run: Column, doc_id: Column, every: int = 31) -> Column:
    """A run as a hurried writer might type it: a code point is left out where ``every`` divides the CRC-32 of id and run."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    return F.when(h % every == 0, without_char(run, h % F.length(run))).otherwise(run)


def word_counts(docs: DataFrame, written=lambda run, doc_id: run, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """word and n of all runs of Latin letters in all texts, ASCII capitals lowered; ``written`` may change a run first."""
    lowered = F.translate(F.col("text").cast("string"), _UPPER, _LOWER)
    # greedy: a run is matched whole or, if it is too short, not at all
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(lowered, F.lit("[a-zÀ-ÿ]{%d,}" % min_chars), F.lit(0))).alias("run"))
    words = runs.select(written(F.col("run"), F.col("doc_id")).alias("word")).where(F.length("word") >= min_chars)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def _keys(word: Column, length: Column, shift: int) -> Column:
    """Four keys: what a word of ``length`` has beside each of its quarters.  ``shift`` is 1 for grams of a word one longer."""
    half = F.floor(length / 2).cast("int")
    edges = [F.lit(0), F.floor(half / 2).cast("int"), half, half + F.floor((length - half) / 2).cast("int"), length]
    keys = []
    for quarter in range(4):
        before = F.substring(word, F.lit(1), edges[quarter])
        behind = F.substring(word, edges[quarter + 1] + 1 + shift, length)
        keys.append(F.xxhash64(length, F.lit(quarter), F.concat(before, behind)))
    return F.array(*keys)


def near_pairs(words: DataFrame) -> DataFrame:
    """a, n_a, b, n_b of every two near words of words(word, n), once; the shorter is ``a``, or the smaller at equal lengths."""
    length = F.length("word")
    chunks = words.select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.explode(_keys(F.col("word"), length, 0)).alias("key"))
    same = words.select(F.col("word").alias("b"), F.col("n").alias("n_b"), F.explode(_keys(F.col("word"), length, 0)).alias("key"), F.lit(False).alias("longer"))
    longer = words.select(F.col("word").alias("b"), F.col("n").alias("n_b"), F.explode(_keys(F.col("word"), length - 1, 1)).alias("key"), F.lit(True).alias("longer"))
    met = chunks.join(same.unionByName(longer), "key").where(F.col("longer") | (F.col("a") < F.col("b")))
    # an inserted code point beside equal ones can be seen in two quarters
    return met.where(F.levenshtein("a", "b", 1) == 1).select("a", "n_a", "b", "n_b").distinct()


def roots(pointers: DataFrame) -> DataFrame:
    """word and root of pointers(word, form): forms followed to the last, twice as far each time."""
    reached = cut_lineage(pointers.select("word", F.col("form").alias("root")))
    for _ in range(JUMPS):
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if reached.join(onward, "root", "left_semi").isEmpty():
            break
        reached = cut_lineage(reached.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
    return reached


def variant_forms(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n and root for every row of words(word, n)."""
    words = cut_lineage(words)
    pairs = cut_lineage(near_pairs(words))
    seen = pairs.select("a", "n_a", F.col("b"), F.col("n_b")).union(pairs.select("b", "n_b", "a", "n_a"))
    best = seen.groupBy(F.col("a").alias("word")).agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("minus"), F.col("b").alias("near"))).alias("best"))
    good = -F.col("best.minus") >= ratio * F.col("n")
    formed = cut_lineage(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("best.near")).alias("form"),
        F.when(good, -F.col("best.minus")).alias("form_n")))
    ends = roots(formed.where("form IS NOT NULL"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
