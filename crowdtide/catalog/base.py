"""Registry of queries with their SQL twins, and the shared input mapping.

Inputs come from the given tables only: ``events`` stands for the sensor feed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdtide.operators.clean import capacity_max, dedupe_timestamps, drop_invalid_rows, open_readings, resample_ratio
from crowdtide.session import cut_lineage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
GRID = 60          # minutes; keeps every scale of the test data dense enough
NOW = "2024-01-25 10:20:00"


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            # R6(x, n) keeps exact ties away from the rounding edge, as r6 does below
            ORACLES[name] = sql.strip().replace("R6(", "round(1e-9 + ")
        return fn

    return register


def r6(column, digits: int = 6):
    return F.round(F.lit(1e-9) + column, digits)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def readings(spark: SparkSession, folder: str) -> DataFrame:
    location = F.col("user_id") % 12
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"), location.alias("location_id"), (F.col("event_type") == "error").alias("is_closed"),
        F.floor("value").cast("double").alias("current_capacity"), (40 + 10 * (location % 5)).cast("int").alias("max_capacity"),
        F.col("ts").alias("observed_at"),
    )


def opened(spark, folder):
    return drop_invalid_rows(open_readings(readings(spark, folder)))


_WRITTEN: dict[tuple[str, str, str], DataFrame] = {}


def once(spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A small table that several queries join, written once for a session and an input folder."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _WRITTEN:
        _WRITTEN[key] = cut_lineage(build())
    return _WRITTEN[key]


def capacity(spark, folder):
    return once(spark, folder, "capacity", lambda: capacity_max(opened(spark, folder)))


def series(spark, folder):
    return (
        dedupe_timestamps(opened(spark, folder)).join(capacity(spark, folder), "location_id")
        .select("location_id", "observed_at", "count", "max_cap")
    )


def ratio(spark, folder, minutes: int = GRID):
    return resample_ratio(series(spark, folder), minutes)


def locations(spark, folder):
    """One row per location that ever reported, with its facility and section."""
    loc = F.col("user_id") % 12
    section = F.when(loc % 3 == 0, "fitness floors").when(loc % 3 == 1, "basketball courts").otherwise("running track")
    return once(spark, folder, "locations", lambda: table(spark, folder, "events").select(
        loc.alias("location_id"), (loc % 2).alias("facility_id"), section.alias("section_key")
    ).distinct())


WEATHER_TYPES = {"temp_c": "view", "wind_mps": "click", "precip_mm": "purchase"}


def weather(spark, folder):
    """Hourly means of one event type per column; hours without stay NULL."""
    hour = F.window("ts", "60 minutes")["start"]
    return table(spark, folder, "events").groupBy(hour.alias("ts")).agg(*[
        F.avg(F.when(F.col("event_type") == kind, F.col("value"))).alias(name) for name, kind in WEATHER_TYPES.items()
    ])


def predictions(spark, folder):
    """y_true with the hour-of-day mean as prediction, per section as model key."""
    base = ratio(spark, folder).join(locations(spark, folder), "location_id")
    means = once(spark, folder, "hourly_means", lambda: base.groupBy(F.hour("bucket_ts").alias("_h")).agg(F.round(F.avg("ratio"), 6).alias("p50")))
    return (
        base.withColumn("_h", F.hour("bucket_ts")).join(means, "_h")
        .select(
            F.col("section_key").alias("model_key"), "location_id", F.col("bucket_ts").alias("ts"), F.round("ratio", 6).alias("y_true"),
            "p50", (F.col("p50") - 0.15).alias("p10"), (F.col("p50") + 0.15).alias("p90"),
            (1 + F.col("location_id") % 3).cast("double").alias("weight"),
        )
    )


OBS = """
observations AS (
  SELECT event_id AS id, user_id % 12 AS location_id, event_type = 'error' AS is_closed,
         CAST(floor(value) AS DOUBLE) AS current_capacity,
         CAST(40 + 10 * ((user_id % 12) % 5) AS INTEGER) AS max_capacity, ts AS observed_at
  FROM events),
opened AS (SELECT * FROM observations WHERE NOT is_closed AND current_capacity >= 0),
caps AS (SELECT location_id, max(max_capacity) AS max_cap FROM opened GROUP BY 1),
series AS (
  SELECT o.location_id, o.observed_at, avg(o.current_capacity) AS count, max(c.max_cap) AS max_cap
  FROM opened o JOIN caps c USING (location_id) GROUP BY 1, 2)
"""


def ratio_sql(minutes: int = GRID) -> str:
    return OBS + f""",
ratio AS (
  SELECT location_id, time_bucket(INTERVAL '{minutes} minutes', observed_at) AS bucket_ts,
         avg(count) AS mean_count, max(max_cap) AS max_cap,
         least(greatest(avg(count) / max(max_cap), 0.0), 1.2) AS ratio
  FROM series GROUP BY 1, 2)
"""


RATIO = ratio_sql()
DIM = """
dim AS (
  SELECT DISTINCT user_id % 12 AS location_id, (user_id % 12) % 2 AS facility_id,
         CASE (user_id % 12) % 3 WHEN 0 THEN 'fitness floors' WHEN 1 THEN 'basketball courts' ELSE 'running track' END AS section_key
  FROM events)
"""
WEATHER = """
weather AS (
  SELECT time_bucket(INTERVAL '60 minutes', ts) AS ts,
         avg(value) FILTER (event_type = 'view') AS temp_c, avg(value) FILTER (event_type = 'click') AS wind_mps,
         avg(value) FILTER (event_type = 'purchase') AS precip_mm
  FROM events GROUP BY 1)
"""
PRED = RATIO + "," + DIM + """,
hourly AS (SELECT hour(bucket_ts) AS h, round(avg(ratio), 6) AS p50 FROM ratio GROUP BY 1),
preds AS (
  SELECT d.section_key AS model_key, r.location_id, r.bucket_ts AS ts, round(r.ratio, 6) AS y_true, h.p50,
         h.p50 - 0.15 AS p10, h.p50 + 0.15 AS p90, CAST(1 + r.location_id % 3 AS DOUBLE) AS weight
  FROM ratio r JOIN dim d USING (location_id) JOIN hourly h ON h.h = hour(r.bucket_ts))
"""
