"""Data model of the machine log: one row per machine and day."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Column names, class names, task names, decision constants.
# ---------------------------------------------------------------------------
KEYS = ("ID", "DATE")
SENSORS = ("S5", "S8", "S13", "S15", "S16", "S17", "S18", "S19")
CATEGORICAL = ("REGION_CLUSTER", "MAINTENANCE_VENDOR", "MANUFACTURER")
STATIC_NUMERIC = ("WELL_GROUP", "AGE_OF_EQUIPMENT")
FLAG = "EQUIPMENT_FAILURE"
REQUIRED_COLUMNS = (*KEYS, *CATEGORICAL, *STATIC_NUMERIC, *SENSORS, FLAG)

HORIZON_CLASSES = ("NOW", "D1_7", "D8_30", "GT_30")
TASKS = (("NOW", 0), ("LE_7_DAYS", 7), ("LE_30_DAYS", 30))
DEFAULT_BETA = 2.0
TASK_BETA = {
    "NOW": 3.0,
    "LE_7_DAYS": 1.5,
    "LE_30_DAYS": 0.8,
    "LE_0_DAYS": 3.0,
}
SEQUENCE_TASK_BETA = {"LE_0_DAYS": 3.0, "LE_7_DAYS": 1.5, "LE_30_DAYS": 0.5}
IMMINENT_DAYS = 7
IMMINENT_THRESHOLD = 0.1
IMMINENT_BETA = 2.5
TRAIN_FRACTION = 0.70
VAL_FRACTION = 0.15
SEED = 42

DEPLOY_THRESHOLDS_ONE_VS_REST = {"NOW": 0.1, "LE_7_DAYS": 0.05, "LE_30_DAYS": 0.02}
DEPLOY_THRESHOLDS_THREE_HORIZON = {
    "NOW": 0.0010621459223330021,
    "LE_7_DAYS": 0.011700638569891453,
    "LE_30_DAYS": 0.0003786543384194374,
}
CLASS_COST = {0: 20.0, 1: 12.0, 2: 6.0, 3: 1.0}
PRIORITY_WEIGHTS = (0.45, 0.30, 0.20, 0.05)
RECALL_FLOORS = (0.28, 0.22, 0.08, 0.0)
# Log-spaced threshold grids: (first exponent, last exponent, points).
THRESHOLD_GRIDS = {
    "NOW": (-4.0, -1.5, 20),
    "LE_7_DAYS": (-4.0, -1.5, 25),
    "LE_30_DAYS": (-6.0, -2.0, 20),
}
# End of fixed values.

_STRINGS = ("DATE", *CATEGORICAL, FLAG)

# DATE and the failure flag arrive as text and are parsed by ``parse_log``.
RAW_LOG_SCHEMA = T.StructType(
    [
        T.StructField(
            name,
            T.LongType()
            if name == "ID"
            else T.IntegerType()
            if name == "WELL_GROUP"
            else T.StringType()
            if name in _STRINGS
            else T.DoubleType(),
        )
        for name in REQUIRED_COLUMNS
    ]
)

MODEL_METADATA_SCHEMA = (
    "task string, run_stamp string, selection_metric string, beta_task double, "
    "threshold double, val_metric double, sequence_length int, bins array<int>, "
    "params struct<lstm_units:int,lstm_layers:int,dropout_after_lstm:double,"
    "dense_units:int,l2_reg:double,batch_size:int,learning_rate:double,epochs:int>"
)


def require_columns(df: DataFrame, columns: Iterable[str] = REQUIRED_COLUMNS) -> DataFrame:
    """Return ``df`` unchanged, or raise naming every absent column in sorted order."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"Missing expected columns: {missing}")
    return df


def make_tasks(days: Iterable[int]) -> list[tuple[str, int]]:
    """Cumulative tasks for the given cut-offs: de-duplicated, ascending, named by day."""
    cutoffs = sorted({int(d) for d in days})
    if not cutoffs:
        raise ValueError("At least one cut-off in days must be given")
    return [(f"LE_{d}_DAYS", d) for d in cutoffs]


def beta_for(task: str, fallback: float = DEFAULT_BETA, table: dict[str, float] = TASK_BETA) -> float:
    return table.get(task, fallback)


def lagged_features(sensors: Iterable[str] = SENSORS) -> list[str]:
    names = list(sensors)
    return [f"{s}_lag1" for s in names] + [f"{s}_roll7_mean" for s in names]


def numeric_features(sensors: Iterable[str] = SENSORS) -> list[str]:
    """Numeric model inputs of the horizon experiments."""
    names = list(sensors)
    return [*STATIC_NUMERIC, *names, *lagged_features(names)]
