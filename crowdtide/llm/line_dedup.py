"""Boilerplate lines, relative to their site.

A line is boilerplate on a host if it stands on more than ``max_ratio`` of the host's pages, and
on at least ``min_pages`` of them.  Lines are compared trimmed; blank lines always stay.

A host has fewer than ``lines per page / max_ratio`` such lines, so they fit in one array per
host; texts are then filtered where they lie, without taking lines apart over a shuffle.

Defined results: a null host is a host of its own; a null text stays null and holds no line;
repeated rows and ids count as pages of their own; extra columns are kept as they are; a text whose
lines all go becomes empty.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdtide.llm.columns import free_name, has_column
from crowdtide.session import cut_lineage

MAX_RATIO = 0.1
MIN_PAGES = 5


def _lines(text):
    return F.split(text, "\n", -1)


def line_key(line):
    """64-bit hash of a trimmed line; null for a blank one."""
    trimmed = F.btrim(line, F.lit(" \t\r\x0b\x0c"))
    return F.when(trimmed != "", F.xxhash64(trimmed))


def boilerplate(pages: DataFrame, host_col: str, text_col: str, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, and ``line_keys``: the keys of its boilerplate lines.  Hosts without any are left out."""
    seen = pages.select(F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    totals = seen.groupBy(F.col("host").alias("site")).agg(F.count(F.lit(1)).alias("pages"))
    # once per page: a line repeated within it still makes one page
    keys = F.array_distinct(F.transform(_lines(F.col("text")), line_key))
    per_line = seen.select("host", F.explode(keys).alias("line_key")).where("line_key is not null")
    counts = per_line.groupBy("host", "line_key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    # one row per host goes to the lines, of which few are left
    frequent = counts.join(totals, F.col("host").eqNullSafe(F.col("site"))).where(F.col("n") > max_ratio * F.col("pages"))
    return frequent.groupBy("host").agg(F.sort_array(F.collect_list("line_key")).alias("line_keys"))


def drop_boilerplate(pages: DataFrame, host_col: str = "source", text_col: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """All rows and columns, with ``text_col`` rid of boilerplate; adds ``n_lines`` and ``n_dropped``.

    A column of the table that has one of these names stays as it is, and that count is left out.
    """
    host, keys, lines, kept = (free_name(pages, n) for n in ("_host", "_line_keys", "_lines", "_kept"))
    known = boilerplate(pages, host_col, text_col, max_ratio, min_pages).select(F.col("host").alias(host), F.col("line_keys").alias(keys))
    # written, so that the planner knows its size and sends it to the texts only if it is small
    known = cut_lineage(known)
    marked = pages.join(known, pages[host_col].eqNullSafe(known[host]), "left").withColumn(lines, _lines(F.col(text_col)))
    clean = F.filter(lines, lambda line: ~F.coalesce(F.array_contains(F.col(keys), line_key(line)), F.lit(False)))
    marked = marked.withColumn(kept, F.when(F.col(keys).isNull() | F.col(text_col).isNull(), F.col(lines)).otherwise(clean))
    before, after = F.coalesce(F.size(lines), F.lit(0)).cast("long"), F.coalesce(F.size(kept), F.lit(0))
    counted = {n: c for n, c in (("n_lines", before), ("n_dropped", (before - after).cast("long"))) if not has_column(pages, n)}
    return marked.withColumns(counted).withColumn(text_col, F.array_join(kept, "\n")).drop(host, keys, lines, kept)
