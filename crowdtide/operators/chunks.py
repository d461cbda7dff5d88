"""Splitting long series in time, so that no task ever holds a whole series.

A single location may own a third of all rows.  Series operators therefore never
partition by location alone: they partition by (location, chunk of time).  What a
chunk needs from outside is either

* a bounded look-back, added as halo rows copied from the chunk before, or
* an unbounded "last known" or running total, carried in from per-chunk summaries
  whose number grows with the time span only, not with the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crowdtide.functions.timeparts import epoch_micros

MINUTE = 60_000_000
DAY = 24 * 60 * MINUTE

US, CHUNK, HALO = "_us", "_chunk", "_halo"


def with_micros(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumn(US, epoch_micros(F.col(ts)))


def chunk_index(us: Column, size: int) -> Column:
    return F.floor(us / F.lit(size)).cast("long")


def with_chunk(df: DataFrame, ts: str, size: int = DAY) -> DataFrame:
    return with_micros(df, ts).withColumn(CHUNK, chunk_index(F.col(US), size))


def with_halo(df: DataFrame, ts: str, lookback: int, size: int) -> DataFrame:
    """Rows near the end of a chunk also appear, flagged as halo, in the next one."""
    if lookback > size:
        raise ValueError("the look-back must fit into one chunk")
    own = chunk_index(F.col(US), size)
    here = F.struct(own.alias(CHUNK), F.lit(False).alias(HALO))
    following = F.struct((own + 1).alias(CHUNK), F.lit(True).alias(HALO))
    copies = F.when(
        F.col(US) >= (own + 1) * F.lit(size) - F.lit(lookback), F.array(here, following)
    ).otherwise(F.array(here))
    return (
        with_micros(df, ts)
        .withColumn("_copy", F.explode(copies))
        .withColumn(CHUNK, F.col(f"_copy.{CHUNK}"))
        .withColumn(HALO, F.col(f"_copy.{HALO}"))
        .drop("_copy")
    )


def rolling(
    df: DataFrame,
    keys: list[str],
    ts: str,
    frames: dict[str, tuple[int, int, callable]],
    size: int = 7 * DAY,
    carry_out: bool = True,
) -> DataFrame:
    """Columns over time frames ``name -> (from_us, to_us, frame -> Column)``.

    Frames are by time, not by row, since the series have gaps.  Both ends are
    relative to the row and at or before it.
    """
    lookback = max(-start for start, _, _ in frames.values())
    haloed = with_halo(df, ts, lookback, size)
    base = Window.partitionBy(*keys, CHUNK).orderBy(US)
    columns = {
        name: build(base.rangeBetween(start, end)) for name, (start, end, build) in frames.items()
    }
    return haloed.withColumns(columns).filter(~F.col(HALO)).drop(US, CHUNK, HALO)


def running_offset(summary: DataFrame, keys: list[str], total: str, offset: str) -> DataFrame:
    """Exclusive prefix sum over the chunk summaries of each key."""
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    return summary.withColumn(offset, F.coalesce(F.sum(total).over(before), F.lit(0)))


def number_islands(df: DataFrame, keys: list[str], ts: str, starts: str, island: str, size: int = DAY) -> DataFrame:
    """Number the islands of each series; ``starts`` flags the first row of each.

    Equal to a running sum of the flag per key, but computed per chunk with the
    offset of the earlier chunks added.
    """
    chunked = with_chunk(df, ts, size)
    flag = F.col(starts).cast("long")
    per_chunk = running_offset(
        chunked.groupBy(*keys, CHUNK).agg(F.sum(flag).alias("_starts")), keys, "_starts", "_offset"
    ).drop("_starts")
    inside = Window.partitionBy(*keys, CHUNK).orderBy(US).rowsBetween(Window.unboundedPreceding, 0)
    return (
        chunked.withColumn("_inside", F.sum(flag).over(inside))
        .join(per_chunk, [*keys, CHUNK])
        .withColumn(island, F.col("_inside") + F.col("_offset"))
        .drop("_inside", "_offset", US, CHUNK)
    )


def previous_row(df: DataFrame, keys: list[str], ts: str, columns: list[str], size: int = DAY, prefix: str = "prev_") -> DataFrame:
    """The row before each row of a series with unique times, across chunk borders."""
    chunked = with_chunk(df, ts, size)
    row = F.struct(*[F.col(c).alias(prefix + c) for c in columns])
    inside = Window.partitionBy(*keys, CHUNK).orderBy(US)
    last_of_chunk = chunked.groupBy(*keys, CHUNK).agg(F.max_by(row, F.col(US)).alias("_last"))
    over_chunks = Window.partitionBy(*keys).orderBy(CHUNK)
    carried = last_of_chunk.select(*keys, CHUNK, F.lag("_last").over(over_chunks).alias("_carried"))
    return (
        chunked.withColumn("_prev", F.lag(row).over(inside))
        .join(carried, [*keys, CHUNK])
        .withColumn("_prev", F.coalesce("_prev", "_carried"))
        .select(*df.columns, *[F.col(f"_prev.{prefix}{c}").alias(prefix + c) for c in columns])
    )
