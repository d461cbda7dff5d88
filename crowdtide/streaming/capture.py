"""Change capture and silence detection with one small state per location."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from crowdtide import config
from crowdtide.sources.live import append_if_changed, latest_per_location, stamp

STATE = "last STRING"
PIECE = 10_000      # changes handed on at a time


def stream_change_capture(readings: DataFrame) -> DataFrame:
    """Drop readings whose reported time equals the location's last one.

    Readings hold location_id, id, current_capacity, is_closed, last_updated.  The state is one
    string per location.  Within a micro-batch a location's readings count in the order of their ids,
    so the changes that come out do not depend on how many readings a trigger gathers; their number is
    bounded by the trigger's rate limit (maxFilesPerTrigger, maxOffsetsPerTrigger), not by the history.
    Pieces of a location are put in order by themselves and merged one reading at a time.
    """
    schema = "location_id BIGINT, id BIGINT, is_closed BOOLEAN, current_capacity DOUBLE, last_updated STRING"
    columns = ["location_id", "id", "is_closed", "current_capacity", "last_updated"]

    def run(key, pieces: Iterator, state) -> Iterator:
        import heapq

        import pandas as pd

        last, kept = state.get[0] if state.exists else "", []
        ordered = [p[columns].sort_values("id").itertuples(index=False, name=None) for p in pieces]
        for row in heapq.merge(*ordered, key=lambda r: r[1]):
            stamped = "" if row[4] is None else str(row[4]).strip()
            if stamped != last:
                kept.append((*row[:4], stamped))
                last = stamped
            if len(kept) >= PIECE:
                yield pd.DataFrame(kept, columns=columns)
                kept = []
        state.update((last,))
        yield pd.DataFrame(kept, columns=columns)

    return readings.groupBy("location_id").applyInPandasWithState(lambda k, p, s: run(k, p, s), schema, STATE, "append", GroupStateTimeout.NoTimeout)


def capture_batch(store: str, latest: str, capacity: DataFrame):
    """foreachBatch writer: append every reading that differs from the one before it.

    Within a batch a location's readings are compared in arrival order, the first one with the
    last reading of the batch before.  So the stored changes do not depend on how many readings
    a trigger gathers.  ``latest`` keeps one row per location and batch; a batch that is run
    again starts from the same rows and replaces what it wrote.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        order = Window.partitionBy("location_id").orderBy("id")
        stamped = batch.withColumn("last_updated", stamp("last_updated"))
        if batch_id > 0:
            known = spark.read.parquet(f"{latest}/batch={batch_id - 1}")
        else:
            known = spark.createDataFrame([], "location_id BIGINT, last_updated STRING")
        before = stamped.withColumn("_before", F.lag("last_updated").over(order)).withColumn("_first", F.row_number().over(order) == 1)
        first, later = before.filter("_first"), before.filter("NOT _first AND last_updated <> _before")
        caps = capacity.select("location_id", "max_capacity")
        changed = later.join(caps, "location_id", "left").select(
            "location_id", "is_closed", "current_capacity", "max_capacity", "last_updated", F.current_timestamp().alias("fetched_at")
        )
        opening, _ = append_if_changed(first, known, capacity, F.current_timestamp())
        opening.unionByName(changed).write.mode("overwrite").parquet(f"{store}/batch={batch_id}")
        newest = latest_per_location(stamped, ["last_updated"])
        kept = known.join(newest.select("location_id"), "location_id", "left_anti").unionByName(newest)
        kept.write.mode("overwrite").parquet(f"{latest}/batch={batch_id}")

    return write


def merge_stretches(stretches: list[tuple[int, int]], times: list[int], limit: int) -> list[tuple[int, int]]:
    """Stretches (first, last) without a gap above ``limit``, after more times have come, in any order."""
    out: list[list[int]] = []
    for first, last in sorted([*stretches, *((t, t) for t in times)]):
        if out and first - out[-1][1] <= limit:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return [tuple(s) for s in out]


def stream_staleness(readings: DataFrame, silent_hours: float = config.STALE_HOURS) -> DataFrame:
    """One row per location and silence: no reading for ``silent_hours`` of event time.

    Needs a watermark on observed_at.  A location's state is the stretches of time without a gap that
    are not settled yet; late readings join or split nothing else, so neither their order nor the
    size of a trigger matters.  A stretch is settled when the watermark has passed its end by the
    limit: then no reading can come that would go on from it, and the silence after it is reported.
    """
    schema = "location_id BIGINT, latest_at TIMESTAMP, age_limit_min DOUBLE"
    limit = int(silent_hours * 3_600_000_000)

    def run(key, pieces, state):
        import pandas as pd

        first, last = state.get if state.exists else ([], [])
        stretches = list(zip(first, last, strict=True))
        for piece in [] if state.hasTimedOut else pieces:
            times = (piece["observed_at"].astype("datetime64[us]").astype("int64")).tolist()
            stretches = merge_stretches(stretches, times, limit)
        # milliseconds; the timer of a stretch fires once the watermark is past it
        due = lambda s: -(-(s[1] + limit) // 1000)
        watermark = state.getCurrentWatermarkMs()
        over = [s for s in stretches if due(s) < watermark]
        open_ones = [s for s in stretches if due(s) >= watermark]
        if open_ones:
            state.update(([s[0] for s in open_ones], [s[1] for s in open_ones]))
            state.setTimeoutTimestamp(max(min(due(s) for s in open_ones), watermark + 1))
        elif state.exists:
            state.remove()
        if over:
            ended = pd.to_datetime([s[1] for s in over], unit="us")
            yield pd.DataFrame({"location_id": [key[0]] * len(over), "latest_at": ended, "age_limit_min": [silent_hours * 60] * len(over)})

    return readings.groupBy("location_id").applyInPandasWithState(
        lambda k, p, s: run(k, p, s), schema, "first ARRAY<BIGINT>, last ARRAY<BIGINT>", "append", GroupStateTimeout.EventTimeTimeout
    )
