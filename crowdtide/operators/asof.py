"""Lag and as-of joins on series with gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crowdtide.functions.timeparts import shift
from crowdtide.operators.chunks import CHUNK, DAY, US, with_chunk

# Lag name -> minutes.
LAGS = {
    "lag_15m": 15, "lag_1h": 60, "lag_2h": 120, "lag_3h": 180,
    "lag_12h": 720, "lag_24h": 1440, "lag_7d": 10080,
}


def lag_join(
    targets: DataFrame,
    series: DataFrame,
    keys: list[str],
    target_ts: str = "bucket_ts",
    series_ts: str = "bucket_ts",
    value: str = "ratio",
    lags: dict[str, int] | None = None,
) -> DataFrame:
    """Exact-time lags in one shuffle on (keys, time).

    Every value is sent once per lag to the time it is a lag *for*, and pivoted
    there by plain conditional aggregates, which combine before the shuffle.
    """
    lags = lags or LAGS
    offsets = F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit(minutes).alias("minutes")) for name, minutes in lags.items()
    ]))
    sent = series.select(*keys, F.col(series_ts).alias("_at"), F.col(value).alias("_value"), offsets.alias("_lag"))
    pivoted = (
        sent.withColumn(target_ts, shift(F.col("_at"), minutes=F.col("_lag.minutes")))
        .groupBy(*keys, target_ts)
        .agg(*[F.max(F.when(F.col("_lag.name") == name, F.col("_value"))).alias(name) for name in lags])
    )
    return targets.join(pivoted, [*keys, target_ts], "left")


def as_of(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_ts: str,
    right_ts: str,
    values: list[str],
    *,
    strict: bool,
    ages: bool = False,
    size: int = DAY,
) -> DataFrame:
    """Each value column's own most recent non-NULL value before (or at) the time.

    Left and right rows are laid into one series and cut into chunks of time; the
    value known at the start of a chunk comes from a summary of the chunks before.
    ``ages`` adds ``<value>_age_min``.  Left columns must differ from ``values``.
    """
    left_columns = left.columns
    laid = (
        with_chunk(left, left_ts, size).withColumn("_is_left", F.lit(True))
        .unionByName(
            with_chunk(
                right.select(*keys, F.col(right_ts).alias("_right_ts"), *values), "_right_ts", size
            ).drop("_right_ts").withColumn("_is_left", F.lit(False)),
            allowMissingColumns=True,
        )
    )
    known = {v: F.when(F.col(v).isNotNull(), F.struct(F.col(v).alias("value"), F.col(US).alias("us"))) for v in values}
    inside = Window.partitionBy(*keys, CHUNK).orderBy(US).rangeBetween(
        Window.unboundedPreceding, -1 if strict else Window.currentRow
    )
    summaries = laid.groupBy(*keys, CHUNK).agg(*[F.max_by(known[v], F.when(F.col(v).isNotNull(), F.col(US))).alias(v) for v in values])
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carried = summaries.select(*keys, CHUNK, *[F.last(v, ignorenulls=True).over(before).alias(f"_in_{v}") for v in values])
    found = laid.withColumns({f"_own_{v}": F.last(known[v], ignorenulls=True).over(inside) for v in values})
    joined = found.filter("_is_left").join(carried, [*keys, CHUNK], "left")
    picked = {v: F.coalesce(F.col(f"_own_{v}"), F.col(f"_in_{v}")) for v in values}
    out: list[Column] = [F.col(c) for c in left_columns]
    for v in values:
        out.append(picked[v]["value"].alias(v))
        if ages:
            out.append(((F.col(US) - picked[v]["us"]) / 60e6).alias(f"{v}_age_min"))
    return joined.select(*out)
