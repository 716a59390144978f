"""The driver's test tables as telemetry, events, windows and hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOW_MS = 3_600_000


def events_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream with its tail and flight: two tails, a flight a week. Remainders of
    negative keys are negative, as in SQL, and make tails and kinds of their own."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    ts = F.col("ts").cast("timestamp")
    return e.select(
        F.concat(F.lit("T"), F.col("user_id") % 2).alias("tail_id"),
        F.concat(F.lit("F"), F.date_format(F.date_trunc("week", ts), "yyyyMMdd")).alias("flight_id"),
        ts.alias("timestamp_utc"),
        "event_id",
        "user_id",
        "event_type",
        "value",
    )


def numeric_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as numeric parameters, with missing values put in by id."""
    text = F.when(F.col("event_id") % 97 == 0, F.lit(None)).when(F.col("event_id") % 89 == 0, F.lit("nan")).otherwise(F.col("value").cast("string"))
    return events_table(spark, sf_dir).select("tail_id", "flight_id", "timestamp_utc", F.col("event_type").alias("parameter_name"), text.alias("parameter_value"), "event_id")


def categorical_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as the states of four parameters, some missing."""
    text = F.when(F.col("event_id") % 61 == 0, F.lit("none")).otherwise(F.col("event_type"))
    name = F.concat(F.lit("STATE_"), F.col("user_id") % 4)
    return events_table(spark, sf_dir).select("tail_id", "flight_id", "timestamp_utc", name.alias("parameter_name"), text.alias("parameter_value"), "event_id")


def detected_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event of the stream as a detected one, numbered within its flight."""
    from vaporline.operators.events import sequence_ids

    e = events_table(spark, sf_dir).select("tail_id", "flight_id", "timestamp_utc", F.col("event_type").alias("parameter_name"), F.concat(F.lit("kind_"), F.col("user_id") % 3).alias("event_type_detected"), "value", "event_id")
    return sequence_ids(e, ["timestamp_utc", "event_id"])


def fixed_windows(events: DataFrame, window_ms: int = WINDOW_MS) -> DataFrame:
    """Windows of equal length that hold an event, numbered within the flight."""
    cell = F.floor(F.unix_millis("timestamp_utc") / window_ms).cast("long")
    w = events.select("tail_id", "flight_id", cell.alias("win_id")).distinct()
    return w.select("tail_id", "flight_id", "win_id", (F.col("win_id") * window_ms).alias("start_ms"), ((F.col("win_id") + 1) * window_ms).alias("end_ms"))


def hierarchy(spark: SparkSession) -> DataFrame:
    """Five parameters in three modules and two subsystems (fixed values)."""
    rows = [("click", "MOD_A", "SUB_1", "SYS"), ("view", "MOD_A", "SUB_1", "SYS"), ("purchase", "MOD_B", "SUB_1", "SYS"), ("signup", "MOD_C", "SUB_2", "SYS"), ("error", "MOD_C", "SUB_2", "SYS")]
    return spark.createDataFrame(rows, "parameter_name string, module_id string, subsystem_id string, system_id string")
