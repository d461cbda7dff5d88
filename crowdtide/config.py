"""Defaults of every operator.  All values are fixed values of the domain."""

from __future__ import annotations

LOCAL_ZONE = "America/Chicago"

# -- grid -----------------------------------------------------------------
RESAMPLE_MINUTES = 15
WINDOW_MINUTES = 30
BRIDGE_MINUTES = 90
DAY_START_HOUR = 6
DAY_END_HOUR = 23
FORECAST_DAYS = 7

# -- cleaning ---------------------------------------------------------------
RATIO_MAX = 1.2
JUMP_SHARE = 0.60
JUMP_MAX_GAP_MIN = 120
FLAT_MAX_GAP_MIN = 20
FLAT_MIN_DURATION_MIN = 360
FLAT_KEEP_MIN = 60
FLAT_TOLERANCE = 0.01
STALE_HOURS = 24

# -- data quality -------------------------------------------------------------
MAX_INVALID_RATE = 0.35
MAX_STALE_RATE = 0.6
MAX_FLATLINE_RATE = 0.4
MIN_LOCATIONS = 6
WARN_SHARE = 0.75

# -- training -------------------------------------------------------------------
MIN_SAMPLES_PER_LOCATION = 80
MIN_TRAIN_ROWS = 300
TRAIN_SHARE = 0.8
HOLDOUT_SHARE = 0.12
HOLDOUT_MIN_ROWS = 120
TRAIN_WORKERS = 2
TRAINABLE_CATEGORIES = ("fitness_floors", "basketball_courts")
MISSING_MIN_ROWS = 240
MISSING_MAX_ALL = 0.45
MISSING_MAX_LAG = 0.55
MISSING_MAX_WEATHER = 0.65
CLIP_LOW_Q = 0.002
CLIP_HIGH_Q = 0.998
CLIP_MIN_SPREAD = 0.01
FEATURE_ABS_MAX = 500.0
FEATURE_MIN_FINITE = 0.30
BOOST_ROUNDS = 500
BOOST_PATIENCE = 50        # rounds without a lower validation error that end the search for their number
BOOST_DEPTH = 4
BOOST_ETA = 0.05
BOOST_SUBSAMPLE = 0.9
BOOST_COLSAMPLE = 0.9
BOOST_BINS = 256
TUNE_MIN_ROWS = 1200
TUNE_FOLDS = 3
TUNE_MAX_CANDIDATES = 16
TUNE_SURVIVORS = 3         # one candidate in so many goes on to the next rung
TUNE_ROUNDS = 250
TUNE_SEED = 7
TUNE_COVERAGE_WEIGHT = 0.2
TUNE_TAIL_WEIGHT = 0.15
TUNE_TAIL_QUANTILE = 0.9
TUNE_COMPLEXITY_WEIGHT = 0.03

# -- row weights ------------------------------------------------------------------
RECENCY_HALFLIFE_DAYS = 45.0
RECENCY_FLOOR = 0.2
OCCUPANCY_ALPHA = 1.2
OCCUPANCY_GAMMA = 1.4
BALANCE_POWER = 0.5
BALANCE_MIN = 0.55
BALANCE_MAX = 1.8
WEIGHT_CLIP_LOW_Q = 0.02
WEIGHT_CLIP_HIGH_Q = 0.98
WEIGHT_MIN = 0.08
WEIGHT_MAX = 6.0
SENSOR_WEIGHT_MIN = 0.25
FEATURE_WEIGHT_MIN = 0.35
FEATURE_WEIGHT_POWER = 1.25
TRANSITION_MULTIPLIER = 1.35

# -- horizons -----------------------------------------------------------------------
HORIZON_HOURS = (1, 2, 3, 6, 12)
HORIZON_MIN_PAIRS = 30
HORIZON_OCCUPANCY_MIN_PAIRS = 18
HORIZON_TOTAL_MIN_PAIRS = 100
HORIZON_MAX_BLEND = 0.45

# -- calibration ----------------------------------------------------------------------
INTERVAL_MIN_POINTS = 30
INTERVAL_LOW_Q = 0.10
INTERVAL_HIGH_Q = 0.90
BIAS_MIN_POINTS = 30
BIAS_MIN_POINTS_OCCUPANCY = 24
BIAS_MAX_ABS = 0.25
SUPPORT_MULT = 3.0
CONFORMAL_DAYS = 21
CONFORMAL_ALPHA = 0.20
CONFORMAL_MIN_POINTS = 120
CONFORMAL_MIN_SEGMENT = 20
CONFORMAL_MAX_MARGIN = 0.35
DRIFT_DAYS = 14
DRIFT_MIN_POINTS = 120
DRIFT_MULTIPLIER = 0.2
DRIFT_BIAS_MAX_ABS = 0.12
DRIFT_BIAS_MIN_POINTS = 20
DRIFT_BIAS_MIN_POINTS_OCCUPANCY = 24
DRIFT_BIAS_DECAY_HOURS = 8.0
DRIFT_BIAS_BLEND = 0.6

# -- crowd baseline -----------------------------------------------------------------------
BASELINE_MIN_COVERAGE = 0.6
BASELINE_MIN_POINTS = 120
BASELINE_LOW_Q = 0.3
BASELINE_PEAK_Q = 0.7

# -- spike adjustment ---------------------------------------------------------------------
SPIKE_MAX_AGE_MIN = 90.0
SPIKE_ROWS = 6
SPIKE_DECAY = 0.55
SPIKE_CAP_MULTIPLIER = 1.35

# -- governance ---------------------------------------------------------------------------
RETRAIN_HOURS = 24
CHAMPION_RECENT_DAYS = 14
CHAMPION_MIN_ROWS = 240
CHAMPION_MIN_MAE_GAIN = 0.0015
CHAMPION_MAX_RMSE_LOSS = 0.01
CHAMPION_MAX_COVERAGE_LOSS = 0.01
GUARD_MAX_HOLDOUT_MAE = 0.03
GUARD_MAX_HOLDOUT_COVERAGE = 0.02
GUARD_MAX_VAL_MAE = 0.05
GUARD_MAX_VAL_COVERAGE = 0.015
GUARD_MIN_VAL_ROWS = 200
DRIFT_STREAK_RETRAIN = 2
DRIFT_STREAK_ROLLBACK = 3
DRIFT_FORCE_HOURS = 24
DRIFT_WIDEN_STEP = 0.15
DRIFT_WIDEN_MAX = 1.7
HISTORY_POINTS = 60

# -- alerts -------------------------------------------------------------------------------
ALERT_MIN_THRESHOLD = 20
ALERT_MAX_THRESHOLD = 90
LIVE_BIAS_MAX_AGE_MIN = 45.0

WEATHER_KEYS = (
    "temp_c", "feels_like_c", "precip_mm", "rain_mm", "snow_cm",
    "wind_mps", "wind_gust_mps", "humidity_pct", "weather_code",
)
WEATHER_ROLLING_KEYS = ("temp_c", "precip_mm", "wind_mps")
WEATHER_API_NAMES = {
    "temp_c": "temperature_2m",
    "feels_like_c": "apparent_temperature",
    "precip_mm": "precipitation",
    "rain_mm": "rain",
    "snow_cm": "snowfall",
    "wind_mps": "wind_speed_10m",
    "wind_gust_mps": "wind_gusts_10m",
    "humidity_pct": "relative_humidity_2m",
    "weather_code": "weather_code",
}
