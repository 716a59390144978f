"""Raw telemetry: one normal form for whatever columns the input brings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaporline.functions.exprs import as_number, empty_map

REQUIRED = ("tail_id", "flight_id", "parameter_name", "parameter_value")


def require(df: DataFrame, columns, what: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks the columns {', '.join(missing)}")
    return df


def normalize(raw: DataFrame) -> DataFrame:
    """Trimmed texts, one UTC timestamp, the value as a number where it is one, the
    date to partition by; rows without tail, flight, time or parameter go. Unknown
    columns pass through."""
    require(raw, REQUIRED, "raw telemetry")
    times = [F.col(c).cast("timestamp") for c in ("timestamp_utc", "timestamp") if c in raw.columns]
    if not times:
        raise ValueError("raw telemetry lacks a timestamp")
    rest = [c for c in raw.columns if c not in (*REQUIRED, "timestamp_utc", "timestamp", "unit", "sensor", "val", "meta", "date_utc")]
    value, unit = F.trim(F.col("parameter_value").cast("string")), F.trim(F.col("unit").cast("string")) if "unit" in raw.columns else F.lit(None).cast("string")
    out = raw.select(
        F.col("tail_id").cast("string").alias("tail_id"),
        F.col("flight_id").cast("string").alias("flight_id"),
        F.coalesce(*times).alias("timestamp_utc"),
        F.col("parameter_name").cast("string").alias("parameter_name"),
        F.col("parameter_name").cast("string").alias("sensor"),
        value.alias("parameter_value"),
        as_number(value).alias("val"),
        unit.alias("unit"),
        empty_map("string", "string").alias("meta"),
        *rest,
    )
    return out.dropna(subset=["tail_id", "flight_id", "timestamp_utc", "parameter_name"]).withColumn("date_utc", F.to_date("timestamp_utc"))
