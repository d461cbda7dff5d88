"""Streams over the sensor feed, run to the end of what there is, against their batch SQL.

The feed is written as a few slices, one after the other; files are read in the order of their
time, a slice per trigger.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdtide.catalog.base import locations, query, r6, readings
from crowdtide.session import shared_folder
from crowdtide.streaming.alerts import alert_batch
from crowdtide.streaming.capture import capture_batch, stream_change_capture, stream_staleness
from crowdtide.streaming.resample import stream_resample

SLICES = 4
FILES = 2           # of a slice, and so of a trigger
LATE = "10 days"    # how late a reading may come; one in fifty comes a slice late
SILENT_HOURS = 1.5


def new_folder(spark) -> str:
    return f"{shared_folder(spark)}/crowdtide/stream-{uuid.uuid4().hex}"


def slices_by_id(spark, d) -> DataFrame:
    """Readings with the slice that brings them, in order of arrival; the reported time changes every six hours."""
    rows = readings(spark, d).withColumn("last_updated", F.date_format(F.window("observed_at", "6 hours")["start"], "yyyy-MM-dd HH:mm"))
    last = rows.agg((F.max("id") + 1).alias("_n"))
    return rows.crossJoin(last).withColumn("slice", F.floor(F.col("id") * SLICES / F.col("_n")).cast("int")).drop("_n")  # one row


def slices_by_time(spark, d) -> DataFrame:
    """Readings with the slice that brings them: a week or so each, but one in fifty comes a slice late."""
    day = F.dayofmonth("observed_at") - 1
    on_time = F.least(F.lit(SLICES - 1), F.floor(day / 8).cast("int"))
    return readings(spark, d).withColumn("slice", F.when(F.col("id") % 50 == 0, F.least(F.lit(SLICES - 1), on_time + 1)).otherwise(on_time))


def feed(sliced: DataFrame, folder: str) -> DataFrame:
    """The slices as a stream; event time is a TIMESTAMP, as watermarks need one."""
    spark = sliced.sparkSession
    rows = sliced.withColumn("observed_at", F.col("observed_at").cast("timestamp"))
    for k in range(SLICES):
        rows.filter(F.col("slice") == k).drop("slice").repartition(FILES).write.parquet(f"{folder}/in/slice={k}")
    stream = spark.readStream.schema(rows.drop("slice").schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", FILES)
    return stream.parquet(f"{folder}/in")


def run_to_end(stream: DataFrame, folder: str, write=None) -> DataFrame:
    """All rows of a stream in append mode, or what ``write`` (a foreachBatch function) makes of them."""
    sink = stream.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    started = (sink.foreachBatch(write) if write else sink.format("parquet").option("path", f"{folder}/out")).start()
    started.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


STAMPS = """stamped AS (
  SELECT event_id AS id, user_id % 12 AS location_id, CAST(floor(value) AS DOUBLE) AS current_capacity, strftime(time_bucket(INTERVAL '6 hours', ts), '%Y-%m-%d %H:%M') AS last_updated FROM events),
changes AS (SELECT * FROM (SELECT *, lag(last_updated) OVER (PARTITION BY location_id ORDER BY id) AS before FROM stamped) WHERE last_updated <> coalesce(before, ''))
"""


@query("stream_change_capture", "WITH " + STAMPS + "SELECT location_id, id, current_capacity, last_updated FROM changes")
def change_capture(spark, d):
    folder = new_folder(spark)
    stream = feed(slices_by_id(spark, d), folder).select("location_id", "id", "is_closed", "current_capacity", "last_updated")
    return run_to_end(stream_change_capture(stream), folder).select("location_id", "id", "current_capacity", "last_updated")


@query("stream_capture_store", "WITH " + STAMPS + "SELECT location_id, current_capacity, 40 + 10 * (location_id % 5) AS max_capacity, last_updated FROM changes")
def capture_store(spark, d):
    """The same changes as rows appended to the store, with capacities."""
    folder = new_folder(spark)
    caps = locations(spark, d).select("location_id", (40 + 10 * (F.col("location_id") % 5)).alias("max_capacity"))
    stream = feed(slices_by_id(spark, d), folder).drop("max_capacity")
    out = f"{folder}/store"
    sink = stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(capture_batch(out, f"{folder}/latest", caps)).start()
    sink.awaitTermination()
    return spark.read.parquet(out).select("location_id", "current_capacity", F.col("max_capacity").cast("bigint").alias("max_capacity"), "last_updated")


@query("stream_resample", """
WITH r AS (SELECT user_id % 12 AS location_id, ts, CAST(floor(value) AS DOUBLE) AS c FROM events)
SELECT location_id, time_bucket(INTERVAL '60 minutes', ts) AS bucket_ts, R6(avg(c), 6) AS mean_count, count(*) AS samples FROM r GROUP BY 1, 2
HAVING time_bucket(INTERVAL '60 minutes', ts) + INTERVAL '60 minutes' <= (SELECT max(ts) - INTERVAL '10 days' FROM r)""")
def resample(spark, d):
    """Hourly means that are final: the watermark, ten days behind the newest reading, has passed them; late readings count."""
    folder = new_folder(spark)
    out = run_to_end(stream_resample(feed(slices_by_time(spark, d), folder), 60, LATE), folder)
    return out.select("location_id", F.col("bucket_ts").cast("timestamp_ntz").alias("bucket_ts"), r6(F.col("mean_count")).alias("mean_count"), "samples")


@query("stream_staleness", f"""
WITH r AS (SELECT user_id % 12 AS location_id, ts, lead(ts) OVER (PARTITION BY user_id % 12 ORDER BY ts) AS following FROM events)
SELECT location_id, ts AS latest_at FROM r
WHERE (following IS NULL OR following - ts > INTERVAL '{int(SILENT_HOURS * 60)} minutes') AND ts + INTERVAL '{int(SILENT_HOURS * 60)} minutes' < (SELECT max(ts) - INTERVAL '10 days' FROM r)""")
def staleness(spark, d):
    """Silences of an hour and a half that are final; late readings end them."""
    folder = new_folder(spark)
    stream = feed(slices_by_time(spark, d), folder).withWatermark("observed_at", LATE).select("location_id", "observed_at")
    out = run_to_end(stream_staleness(stream, SILENT_HOURS), folder)
    return out.select("location_id", F.col("latest_at").cast("timestamp_ntz").alias("latest_at"))


@query("stream_alerts", f"""
WITH sliced AS (
  SELECT event_id AS id, user_id % 12 AS location_id, CAST(floor(value) AS DOUBLE) AS c, CAST(floor(event_id * {SLICES} / (max(event_id) OVER () + 1)) AS INTEGER) AS slice FROM events),
k AS (SELECT unnest(range({SLICES})) AS batch),
latest AS (SELECT batch, location_id, arg_max(c, id) AS c FROM k JOIN sliced ON slice <= batch GROUP BY 1, 2),
places AS (SELECT DISTINCT user_id % 12 AS location_id FROM events),
sec AS (
  SELECT location_id % 2 AS facility_id, CASE location_id % 3 WHEN 0 THEN 'fitness floors' WHEN 1 THEN 'basketball courts' ELSE 'running track' END AS section_key, location_id FROM places
  UNION ALL SELECT location_id % 2, 'overall', location_id FROM places),
pct AS (
  SELECT batch, facility_id, section_key, CAST(round_even(sum(coalesce(CAST(c AS BIGINT), 0)) / sum(40 + 10 * (location_id % 5)) * 100, 0) AS INTEGER) AS percent
  FROM k CROSS JOIN sec LEFT JOIN latest USING (batch, location_id) GROUP BY 1, 2, 3),
rules AS (
  SELECT facility_id * 10000 + p * 100 + s AS id, facility_id, section_key, p AS threshold, CASE WHEN p % 20 = 0 THEN 2 ELSE 0 END AS since, CASE WHEN p = 30 THEN 2 ELSE 99 END AS until
  FROM (SELECT DISTINCT facility_id FROM sec) f, (VALUES ('overall', 1), ('fitness floors', 2), ('basketball courts', 3), ('running track', 4)) v(section_key, s), (SELECT unnest(range(10, 100, 10)) AS p))
SELECT id, min(batch) AS batch FROM rules JOIN pct USING (facility_id, section_key) WHERE batch >= since AND batch < until AND percent <= threshold GROUP BY 1""")
def alerts(spark, d):
    """Rules on every section fire once; between two batches some rules are added and some deleted by others."""
    folder = new_folder(spark)
    places = locations(spark, d)
    sections = places.select("facility_id", "section_key", "location_id")
    sections = sections.unionByName(places.select("facility_id", F.lit("overall").alias("section_key"), "location_id"))
    caps = places.select("location_id", (40 + 10 * (F.col("location_id") % 5)).alias("max_capacity"))
    facilities = places.select("facility_id").distinct()
    names = facilities.withColumn("facility_name", F.concat(F.lit("Hall "), F.col("facility_id").cast("string")))
    listed = F.array(*[F.struct(F.lit(s).alias("section_key"), F.lit(k).alias("s")) for k, s in enumerate(("overall", "fitness floors", "basketball courts", "running track"), 1)])
    rules = facilities.withColumn("_s", F.explode(listed)).withColumn("p", F.explode(F.sequence(F.lit(10), F.lit(90), F.lit(10)))).select(
        (F.col("facility_id") * 10000 + F.col("p") * 100 + F.col("_s.s")).alias("id"), "facility_id", F.col("_s.section_key").alias("section_key"), F.col("p").alias("threshold"),
        F.concat_ws("-", "facility_id", "p", "_s.s").alias("endpoint"), F.lit("2024-01-01").cast("timestamp").alias("created_at"))
    late = F.col("threshold") % 20 == 0
    rules.filter(~late).write.parquet(f"{folder}/rules/batch=-1")
    added = rules.filter(late).withColumns({"change": F.lit("upsert"), "change_id": F.concat(F.lit("a"), "id")})
    gone = rules.filter("threshold = 30").withColumns({"change": F.lit("delete"), "change_id": F.concat(F.lit("d"), "id")})
    work = alert_batch(f"{folder}/rules", f"{folder}/out", f"{folder}/live", sections, caps, names, f"{folder}/changes")

    def write(batch: DataFrame, batch_id: int) -> None:
        if batch_id == 2:       # what others have written since the batch before
            added.unionByName(gone).write.mode("overwrite").parquet(f"{folder}/changes")
        work(batch, batch_id)

    sink = feed(slices_by_id(spark, d), folder).writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    sink.awaitTermination()
    return spark.read.schema("id BIGINT, batch INT").parquet(*[f"{folder}/out/batch={k}" for k in range(SLICES)]).select("id", "batch")
