"""Table schemas, feature lists and the fixed parameters of the reports."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import types as T

INF = float("inf")

ID = "load_id"
DATE = "date"
TARGET = "posted_rate"
RPM = "posted_rate_per_mile"
LOG_RPM = "log_posted_rate_per_mile"

# The column layout of a load and the feature lists derived from it.
LOADS = T.StructType(
    [
        T.StructField("load_id", T.StringType()),
        T.StructField("pickup", T.StringType()),
        T.StructField("delivery", T.StringType()),
        T.StructField("pickup_lat", T.DoubleType()),
        T.StructField("pickup_lon", T.DoubleType()),
        T.StructField("delivery_lat", T.DoubleType()),
        T.StructField("delivery_lon", T.DoubleType()),
        T.StructField("distance", T.DoubleType()),
        T.StructField("equipment", T.StringType()),
        T.StructField("weight", T.DoubleType()),
        T.StructField("date", T.DateType()),
        T.StructField("market_index", T.DoubleType()),
        T.StructField("quote_signal", T.DoubleType()),
        T.StructField("posted_rate", T.DoubleType()),
    ]
)
HOLDOUT = T.StructType([f for f in LOADS.fields if f.name != TARGET])

CATEGORICAL = ["pickup", "delivery", "equipment"]
NUMERIC = [
    "pickup_lat",
    "pickup_lon",
    "delivery_lat",
    "delivery_lon",
    "distance",
    "weight",
    "market_index",
    "quote_signal",
]
CALENDAR = ["month", "day_of_week", "day_of_month", "day_of_year", "days_since_start"]
HISTORY = [
    "hist_global_rpm_mean",
    "hist_route_rpm_mean",
    "hist_route_rpm_count",
    "hist_pickup_rpm_mean",
    "hist_pickup_rpm_count",
    "hist_delivery_rpm_mean",
    "hist_delivery_rpm_count",
    "hist_equipment_rpm_mean",
    "hist_equipment_rpm_count",
]
HISTORY_KEYS = {
    "global": [],
    "route": ["pickup", "delivery"],
    "pickup": ["pickup"],
    "delivery": ["delivery"],
    "equipment": ["equipment"],
}

SUBMISSION_COLUMNS = ["load_id", "predicted_rate"]
SCENARIO_COLUMNS = [
    "pickup",
    "delivery",
    "distance",
    "equipment",
    "weight",
    "date",
    "predicted_rate",
]

PREDICTIONS = T.StructType(
    [
        T.StructField("load_id", T.StringType()),
        T.StructField("actual_rate", T.DoubleType()),
        T.StructField("predicted_rate", T.DoubleType()),
        T.StructField("actual_rate_per_mile", T.DoubleType()),
        T.StructField("predicted_rate_per_mile", T.DoubleType()),
        T.StructField("actual_log_rate_per_mile", T.DoubleType()),
        T.StructField("predicted_log_rate_per_mile", T.DoubleType()),
    ]
)


@dataclass(frozen=True)
class Bins:
    """Right-closed bins (edge, next edge] over one column."""

    column: str
    edges: tuple[float, ...]
    labels: tuple[str, ...]


# Report bins, all right-closed.
DISTANCE_BINS = Bins(
    "distance",
    (0, 250, 500, 750, 1000, 1500, 2000, INF),
    ("<=250", "251-500", "501-750", "751-1000", "1001-1500", "1501-2000", ">2000"),
)
RATE_BINS = Bins(
    "actual_rate",
    (0, 1000, 1500, 2000, 2500, 3000, 4000, 6000, 10000, INF),
    (
        "<1000",
        "1000-1500",
        "1500-2000",
        "2000-2500",
        "2500-3000",
        "3000-4000",
        "4000-6000",
        "6000-10000",
        ">10000",
    ),
)
WEIGHT_BINS = Bins(
    "weight",
    (-INF, 10000, 20000, 30000, 40000, 50000, INF),
    ("<=10k", "10k-20k", "20k-30k", "30k-40k", "40k-50k", ">50k"),
)

# Report parameters.
MIN_ROUTE_ROWS = 10
TOP_ROUTES = 15
WORST_ROWS = 100
TOP_UNDERPREDICTED = 20
QUANTILE_BINS = 5
HIGH_RATE = 6000.0
ERROR_QUANTILES = {"median_abs_error": 0.5, "p90_abs_error": 0.9, "p95_abs_error": 0.95, "p99_abs_error": 0.99}
RPM_TAIL = {"p99": 0.99, "p995": 0.995, "p999": 0.999}
SEED = 42
CLOSE_ABS = 1e-8
CLOSE_REL = 1e-5


@dataclass(frozen=True)
class Split:
    """Half-open windows: train [.., train_end), validation [train_end, valid_end)."""

    train_end: date
    valid_end: date
    origin: date


@dataclass(frozen=True)
class Fold:
    name: str
    train_start: date
    train_end: date
    valid_start: date
    valid_end: date


@dataclass(frozen=True)
class Scenario:
    """One fixed load priced on every day of [first_day, last_day]."""

    pickup: str
    delivery: str
    distance: float
    equipment: str
    weight: float
    first_day: date
    last_day: date


# Parameters of the original workload.
CALENDAR_2025 = Split(date(2025, 10, 1), date(2025, 11, 1), date(2025, 1, 1))
FOLDS_2025 = (
    Fold("fold_1", date(2025, 1, 1), date(2025, 7, 1), date(2025, 7, 1), date(2025, 9, 1)),
    Fold("fold_2", date(2025, 1, 1), date(2025, 8, 1), date(2025, 8, 1), date(2025, 10, 1)),
    Fold("fold_3", date(2025, 1, 1), date(2025, 10, 1), date(2025, 10, 1), date(2025, 11, 1)),
)
SCENARIO_2025 = Scenario(
    "Lexington", "Fort Wayne", 360.0, "Dry Van", 32000.0, date(2025, 12, 1), date(2025, 12, 31)
)
SUBMISSION_IDS_2025 = ("TE-%06d", 12000)

# The same roles on the star-schema tables (1995-2001).
STAR_SPLIT = Split(date(2000, 1, 1), date(2001, 1, 1), date(1995, 1, 1))
STAR_HOLDOUT_START = date(2001, 1, 1)
STAR_FOLDS = (
    Fold("fold_1", date(1995, 1, 1), date(1998, 1, 1), date(1998, 1, 1), date(1999, 1, 1)),
    Fold("fold_2", date(1995, 1, 1), date(1998, 7, 1), date(1998, 7, 1), date(1999, 7, 1)),
    Fold("fold_3", date(1995, 1, 1), date(2000, 1, 1), date(2000, 1, 1), date(2001, 1, 1)),
)
