"""Streams against their batch forms."""

from pyspark.sql import functions as F

from crowdtide.streaming.alerts import alert_batch
from crowdtide.streaming.capture import capture_batch, merge_stretches, stream_change_capture, stream_staleness
from crowdtide.streaming.resample import stream_resample

SCHEMA = "id BIGINT, location_id BIGINT, is_closed BOOLEAN, current_capacity DOUBLE, last_updated STRING, observed_at TIMESTAMP"


def feed(spark, folder, batches):
    """One parquet file per batch, so that one file is one trigger."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/part={i}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(f"{folder}/in")


def run(df, folder, name, mode="append"):
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return df.sparkSession.table(name)


def rows_at(spark, *specs):
    import datetime as dt

    return [(i, loc, False, float(v), stamp, dt.datetime.fromisoformat(ts)) for i, loc, v, stamp, ts in specs]


def test_change_capture_keeps_changes_only(spark, tmp_path):
    batches = [
        rows_at(spark, (1, 1, 5, "a", "2024-01-01 00:00:00"), (2, 1, 6, "a", "2024-01-01 00:01:00"), (3, 2, 7, None, "2024-01-01 00:01:00")),
        rows_at(spark, (4, 1, 8, "a ", "2024-01-01 00:05:00"), (5, 1, 9, "b", "2024-01-01 00:06:00"), (6, 2, 7, "x", "2024-01-01 00:07:00")),
    ]
    out = run(stream_change_capture(feed(spark, tmp_path, batches).drop("observed_at")), tmp_path, "captured")
    assert sorted(r.id for r in out.collect()) == [1, 5, 6]


def test_resample_equals_batch(spark, tmp_path):
    specs = [(i, i % 2, i % 7, "s", f"2024-01-01 0{i // 20}:{(i * 3) % 60:02d}:00") for i in range(60)]
    batches = [rows_at(spark, *specs[:30]), rows_at(spark, *specs[30:]), rows_at(spark, (99, 9, 1, "s", "2024-01-03 00:00:00"))]
    stream = feed(spark, tmp_path, batches)
    got = run(stream_resample(stream, 15, "1 day"), tmp_path, "resampled")
    batch = spark.createDataFrame([r for b in batches[:2] for r in b], SCHEMA).groupBy("location_id", F.window("observed_at", "15 minutes").start.alias("b")).agg(F.avg("current_capacity").alias("m"))
    assert sorted((r.location_id, r.bucket_ts, round(r.mean_count, 6)) for r in got.collect()) == sorted((r.location_id, r.b, round(r.m, 6)) for r in batch.collect())


def test_silence_is_reported_once(spark, tmp_path):
    batches = [
        rows_at(spark, (1, 1, 5, "a", "2024-01-01 00:00:00"), (2, 2, 5, "a", "2024-01-01 00:00:00")),
        rows_at(spark, (3, 2, 5, "a", "2024-01-01 20:00:00")),
        rows_at(spark, (4, 2, 5, "a", "2024-01-02 10:00:00")),
        rows_at(spark, (5, 2, 5, "a", "2024-01-02 11:00:00")),
    ]
    stream = feed(spark, tmp_path, batches).withWatermark("observed_at", "1 minute")
    out = run(stream_staleness(stream.select("location_id", "observed_at")), tmp_path, "silent").collect()
    assert [r.location_id for r in out] == [1]


def test_alert_fires_once(spark, tmp_path):
    rules = spark.createDataFrame([(1, 7, "overall", 50, "e"), (2, 7, "overall", 5, "f"), (3, 7, "sauna", 90, "g")], "id BIGINT, facility_id BIGINT, section_key STRING, threshold INT, endpoint STRING")
    rules.write.parquet(f"{tmp_path}/rules/batch=-1")
    sections = spark.createDataFrame([(7, "overall", 1)], "facility_id BIGINT, section_key STRING, location_id BIGINT")
    capacity = spark.createDataFrame([(1, 100)], "location_id BIGINT, max_capacity INT")
    names = spark.createDataFrame([(7, "Hall")], "facility_id BIGINT, facility_name STRING")
    write = alert_batch(f"{tmp_path}/rules", f"{tmp_path}/out", f"{tmp_path}/live", sections, capacity, names)
    for i, count in enumerate((80, 40, 30)):
        write(spark.createDataFrame(rows_at(spark, (i, 1, count, "s", "2024-01-01 00:00:00")), SCHEMA), i)
    sent = spark.read.parquet(f"{tmp_path}/out").collect()
    assert [(r.id, r.batch) for r in sent] == [(1, 1)]
    assert "40% full (at or below your 50% alert)" in sent[0].message
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/rules/batch=2").collect()) == [2, 3]


def test_captured_changes_do_not_depend_on_the_trigger(spark, tmp_path):
    stamps = ["a", "a", "b", None, "", "b ", "b", "c", "a"]
    rows = rows_at(spark, *[(i, i % 2, i, s, "2024-01-01 00:00:00") for i, s in enumerate(s for s in stamps for _ in range(2))])
    caps = spark.createDataFrame([(0, 40), (1, 50)], "location_id BIGINT, max_capacity INT")
    found = []
    for name, cuts in (("one", [0, 18]), ("many", [0, 3, 4, 11, 18])):
        write = capture_batch(f"{tmp_path}/{name}", f"{tmp_path}/{name}_latest", caps)
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            batch = spark.createDataFrame(rows[a:b], SCHEMA)
            write(batch, k)
            write(batch, k)     # a batch that runs again changes nothing
        stored = spark.read.parquet(f"{tmp_path}/{name}").collect()
        found.append(sorted((r.location_id, r.current_capacity, r.last_updated, r.max_capacity) for r in stored))
    assert found[0] == found[1]
    assert [r[2] for r in found[0] if r[0] == 0] == ["a", "b", "", "b", "c", "a"]


def test_outside_changes_of_rules_are_merged_once(spark, tmp_path):
    """A rule added between two batches fires once, a deleted one does not fire, and a repeated batch takes the same changes."""
    import datetime as dt

    rule = "id BIGINT, facility_id BIGINT, section_key STRING, threshold INT, endpoint STRING, created_at TIMESTAMP"
    day = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(1, 7, "overall", 10, "e", day), (3, 7, "overall", 50, "g", day)], rule).write.parquet(f"{tmp_path}/rules/batch=-1")
    sections = spark.createDataFrame([(7, "overall", 1)], "facility_id BIGINT, section_key STRING, location_id BIGINT")
    capacity = spark.createDataFrame([(1, 100)], "location_id BIGINT, max_capacity INT")
    names = spark.createDataFrame([(7, "Hall")], "facility_id BIGINT, facility_name STRING")
    write = alert_batch(f"{tmp_path}/rules", f"{tmp_path}/out", f"{tmp_path}/live", sections, capacity, names, f"{tmp_path}/changes")
    say = lambda rows: spark.createDataFrame(rows, rule + ", change STRING, change_id STRING").write.mode("append").parquet(f"{tmp_path}/changes")
    batch = lambda k, count: write(spark.createDataFrame(rows_at(spark, (k, 1, count, "s", "2024-01-01 00:00:00")), SCHEMA), k)
    sent = lambda: sorted((r.id, r.threshold, r.batch) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    batch(0, 80)
    say([(2, 7, " Entire  Facility", 60, "f", day, "upsert", "a"), (3, 7, "overall", 50, "g", day, "delete", "b"), (9, 7, "overall", 45, "e", day, "upsert", "c")])
    batch(1, 40)
    assert sent() == [(2, 60, 1), (9, 45, 1)]
    say([(4, 7, "overall", 90, "h", day, "upsert", "d")])
    batch(1, 40)        # repeated after a failure: what came later is not taken yet
    assert sent() == [(2, 60, 1), (9, 45, 1)]
    batch(2, 40)
    batch(3, 40)
    assert sent() == [(2, 60, 1), (4, 90, 2), (9, 45, 1)]


def test_stretches_do_not_depend_on_order():
    import random

    rng = random.Random(2)
    for _ in range(200):
        times, limit = [rng.randrange(300) for _ in range(rng.randrange(1, 40))], rng.randrange(1, 20)
        want = []
        for t in sorted(times):
            want = [*want[:-1], (want[-1][0], t)] if want and t - want[-1][1] <= limit else [*want, (t, t)]
        got = []
        while times:
            cut = rng.randrange(1, len(times) + 1)
            got, times = merge_stretches(got, times[:cut], limit), times[cut:]
        assert got == want


def test_late_readings_end_a_silence_before_it_is_reported(spark, tmp_path):
    batches = [
        rows_at(spark, (1, 1, 5, "a", "2024-01-01 00:00:00"), (2, 1, 5, "a", "2024-01-03 00:00:00")),
        rows_at(spark, (3, 1, 5, "a", "2024-01-02 00:00:00"), (4, 2, 5, "a", "2024-01-03 00:00:00")),
        rows_at(spark, (5, 2, 5, "a", "2024-01-09 00:00:00")),
        rows_at(spark, (6, 2, 5, "a", "2024-01-20 00:00:00")),
    ]
    stream = feed(spark, tmp_path, batches).withWatermark("observed_at", "4 days")
    out = run(stream_staleness(stream.select("location_id", "observed_at")), tmp_path, "late_silent").collect()
    assert sorted((r.location_id, str(r.latest_at)) for r in out) == [(1, "2024-01-03 00:00:00"), (2, "2024-01-03 00:00:00"), (2, "2024-01-09 00:00:00")]
