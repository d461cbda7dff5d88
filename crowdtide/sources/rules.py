"""Alert rules as a table: upserts and deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crowdtide.functions.text import canonical_section


def upsert_rules(rules: DataFrame, updates: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per key the last write replaces every other column.

    Section names of updates are canonical.  ``created_at`` orders the writes.
    """
    keys = keys or ["endpoint"]
    fresh = updates.withColumn("section_key", canonical_section(F.col("section_key")))
    others = [c for c in rules.columns if c not in keys]
    rank = F.struct("_new", "created_at")
    return (
        rules.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
        .groupBy(*keys).agg(F.max_by(F.struct(*others), rank).alias("_r")).select(*keys, "_r.*").select(*rules.columns)
    )


def delete_rules(rules: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    return rules.join(gone.select(key).distinct(), key, "left_anti").select(*rules.columns)


def dispatch_filter(facility_id: int | None = None, section_key: str | None = None) -> Column:
    """Optional restriction of the rules to a facility and a section."""
    wanted = F.lit(True)
    if facility_id is not None:
        wanted = wanted & (F.col("facility_id") == facility_id)
    if section_key is not None:
        wanted = wanted & (canonical_section(F.col("section_key")) == canonical_section(F.lit(section_key)))
    return wanted
