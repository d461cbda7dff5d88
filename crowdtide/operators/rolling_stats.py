"""Rolling statistics and sensor signals of a grid series, all before the target."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crowdtide import config
from crowdtide.functions.timeparts import shift
from crowdtide.operators.chunks import CHUNK, DAY, HALO, MINUTE, US, rolling, with_halo

HOUR = 60 * MINUTE

# Hours back of each statistic.
MEAN_HOURS = {"roll_1h": 1, "roll_2h": 2, "roll_6h": 6, "roll_12h": 12, "roll_24h": 24}
STD_HOURS = {"vol_1h": 1, "vol_3h": 3, "vol_6h": 6}
RANGE_HOURS = {"range_1h": 1, "range_3h": 3, "range_6h": 6}
FLAT_STEP_TOLERANCE = 0.002
SENSOR_WINDOW_MIN = 120


def rolling_statistics(
    targets: DataFrame, keys: list[str], ts: str = "bucket_ts", value: str = "ratio", *,
    grid: int = config.RESAMPLE_MINUTES, names: tuple[str, ...] | None = None,
) -> DataFrame:
    """Means, deviations, ranges and the share of missing steps before each row.

    Rows with a NULL value are targets only.  Frames end one grid step before the
    row, so a row never sees itself.  All frames share one window partitioning.
    """
    step = grid * MINUTE

    def frame(hours, build):
        return (-max(hours * HOUR, step), -1, build)

    v = F.col(value)
    steps = max(2, SENSOR_WINDOW_MIN // grid)
    frames = {n: frame(h, lambda w: F.avg(v).over(w)) for n, h in MEAN_HOURS.items()}
    frames |= {
        n: frame(h, lambda w: F.when(F.count(v).over(w) >= 2, F.stddev_pop(v).over(w))) for n, h in STD_HOURS.items()
    }
    frames |= {n: frame(h, lambda w: F.max(v).over(w) - F.min(v).over(w)) for n, h in RANGE_HOURS.items()}
    frames["missing_recent"] = (-steps * step, -1, lambda w: 1.0 - F.count(v).over(w) / float(steps))
    if names:
        frames = {n: f for n, f in frames.items() if n in names}
    return rolling(targets, keys, ts, frames)


def flatline_steps(series: DataFrame, keys: list[str], ts: str = "bucket_ts", value: str = "ratio", *, grid: int = config.RESAMPLE_MINUTES) -> DataFrame:
    """Grid points right before each time that follow one another closely.

    Counted from one step back, until a gap or a larger move, at most the number of
    steps in two hours.  Rows with a NULL value are targets only.
    """
    step = grid * MINUTE
    limit = max(2, SENSOR_WINDOW_MIN // grid)
    haloed = with_halo(series, ts, (limit + 1) * step, 7 * DAY)
    order = Window.partitionBy(*keys, CHUNK).orderBy(US)
    at = lambda back: F.max(value).over(order.rangeBetween(-back * step, -back * step))
    alive, total = F.lit(True), F.lit(0)
    values = [at(i) for i in range(1, limit + 1)]
    haloed = haloed.withColumns({f"_v{i}": c for i, c in enumerate(values, 1)})
    for i in range(1, limit + 1):
        here = F.col(f"_v{i}")
        close = here.isNotNull() if i == 1 else here.isNotNull() & (F.abs(here - F.col(f"_v{i - 1}")) <= FLAT_STEP_TOLERANCE)
        alive = alive & F.coalesce(close, F.lit(False))
        total = total + alive.cast("int")
    return haloed.withColumn("flat_steps", total).filter(~F.col(HALO)).drop(US, CHUNK, HALO, *[f"_v{i}" for i in range(1, limit + 1)])


DELTAS = {"delta_1h": "lag_1h", "delta_3h": "lag_3h", "delta_12h": "lag_12h", "delta_24h": "lag_24h", "delta_7d": "lag_7d"}
TRENDS = {
    "trend_short": ("roll_1h", "roll_2h"), "trend_mid": ("roll_2h", "roll_6h"), "trend_long": ("roll_2h", "roll_24h"),
    "trend_accel_short": ("trend_short", "trend_mid"), "trend_accel_mid": ("trend_mid", "trend_long"),
}


def deltas_and_trends(rows: DataFrame) -> DataFrame:
    """Differences of lags and of rolling means, and missing shares per group."""
    from crowdtide.functions.levels import missing_share
    from crowdtide.operators.asof import LAGS

    rows = rows.withColumns({n: F.col("lag_15m") - F.col(lag) for n, lag in DELTAS.items()})
    first = {n: F.col(a) - F.col(b) for n, (a, b) in TRENDS.items() if not n.startswith("trend_accel")}
    rows = rows.withColumns(first)
    rows = rows.withColumns({n: F.col(a) - F.col(b) for n, (a, b) in TRENDS.items() if n.startswith("trend_accel")})
    shares = {
        "lag_missing": list(LAGS), "delta_missing": list(DELTAS), "trend_missing": list(TRENDS),
        "roll_missing": [*MEAN_HOURS, *STD_HOURS, *RANGE_HOURS],
    }
    rows = rows.withColumns({n: missing_share(cols) for n, cols in shares.items()})
    total = F.lit(0.0)
    for n in shares:
        total = total + F.col(n)
    return rows.withColumn("dynamics_missing", total / float(len(shares)))


def weather_rolling_mean(weather_at_targets: DataFrame, ts: str, keys: tuple[str, ...] = config.WEATHER_ROLLING_KEYS, *, grid: int = config.RESAMPLE_MINUTES, steps: int = 12) -> DataFrame:
    """Mean of the as-of weather over the grid points of the last three hours.

    ``weather_at_targets`` has one row per grid point, without gaps.
    """
    span = steps * grid * MINUTE
    frames = {f"{k}_roll": (-span, -1, lambda w, k=k: F.avg(k).over(w)) for k in keys}
    return rolling(weather_at_targets, [], ts, frames, size=7 * DAY)
