"""The live feed: parsing, change capture, latest readings and the floor layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW = "STRUCT<LocationId: STRING, IsClosed: BOOLEAN, LastCount: DOUBLE, LastUpdatedDateAndTime: STRING>"


def explode_live_feed(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """A JSON array, or one wrapped in ``rows`` or ``data``, as reading rows.

    Empty and other payloads give no rows; rows without a usable id are dropped.
    """
    text = F.col(column)
    listed = F.when(F.ltrim(text).startswith("["), F.from_json(text, f"ARRAY<{ROW}>"))
    wrapped = F.from_json(text, f"rows ARRAY<{ROW}>, data ARRAY<{ROW}>")
    rest = [F.col(c) for c in payloads.columns if c != column]
    rows = payloads.select(*rest, F.explode(F.coalesce(listed, wrapped["rows"], wrapped["data"])).alias("_r"))
    return rows.select(
        *[F.col(c) for c in payloads.columns if c != column], F.col("_r.LocationId").try_cast("long").alias("location_id"),
        F.col("_r.IsClosed").alias("is_closed"), F.col("_r.LastCount").alias("current_capacity"),
        F.col("_r.LastUpdatedDateAndTime").alias("last_updated"),
    ).filter("location_id IS NOT NULL")


def stamp(column: str) -> Column:
    """Reported time as text; missing and empty are the same."""
    return F.trim(F.coalesce(F.col(column).cast("string"), F.lit("")))


def latest_per_location(readings: DataFrame, columns: list[str], *, by: str = "id") -> DataFrame:
    """Columns of the last arrived reading of each location.

    Arrival order, not event time.  One partial aggregate, no self-join.
    """
    return readings.groupBy("location_id").agg(F.max_by(F.struct(*columns), by).alias("_r")).select("location_id", "_r.*")


def append_if_changed(live: DataFrame, latest: DataFrame, capacity: DataFrame, fetched_at) -> tuple[DataFrame, DataFrame]:
    """(rows to append, one row counting inserted and skipped).

    A reading is appended when its reported time differs from the location's last
    stored one.
    """
    stored = latest.select("location_id", stamp("last_updated").alias("_stored"))
    compared = live.join(stored, "location_id", "left").withColumn("_stamp", stamp("last_updated")).withColumn(
        "_same", F.col("_stamp") == F.coalesce("_stored", F.lit(""))
    )
    caps = capacity.select("location_id", "max_capacity")
    rows = compared.filter(~F.col("_same")).join(caps, "location_id", "left").select(
        "location_id", "is_closed", "current_capacity", "max_capacity", F.col("_stamp").alias("last_updated"), fetched_at.alias("fetched_at")
    )
    counts = compared.agg(F.count_if(~F.col("_same")).alias("inserted"), F.count_if("_same").alias("skipped"))
    return rows, counts


def enrich_dimensions(readings: DataFrame, dimension: DataFrame) -> DataFrame:
    """Readings with their location's facility and section; unknown locations drop out.

    Write the dimension first (``cut_lineage``), so that its size is known and it is sent to the readings.
    """
    return readings.join(dimension.select("location_id", "facility_id", "section_key"), "location_id")


def distinct_locations(readings: DataFrame) -> DataFrame:
    """Every location that reported, once, in order."""
    return readings.filter("location_id IS NOT NULL").select("location_id").distinct().orderBy("location_id")


def overlay_live_on_layout(layout: DataFrame, live: DataFrame) -> DataFrame:
    """Every placed location with its reading, or NULLs; ordered by floor and name."""
    readings = live.select("location_id", "is_closed", "current_capacity", "last_updated")
    return layout.filter("floor IS NOT NULL").join(readings, "location_id", "left").orderBy("facility_id", "floor", "name")


def unassigned_locations(live: DataFrame, sections: DataFrame) -> DataFrame:
    return live.join(sections.select("location_id"), "location_id", "left_anti")
