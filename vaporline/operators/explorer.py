"""Tables for exploring: scaled telemetry with a catalogue, markers, intervals."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaporline.functions.exprs import as_number, is_missing
from vaporline.operators.relational import median_mad
from vaporline.sources.tables import write_table


def scaled_telemetry(telemetry: DataFrame, hierarchy: DataFrame | None = None) -> DataFrame:
    """Numeric samples with z-score and robust score (1.4826 MAD) of their parameter."""
    rows = telemetry.withColumn("value_num", F.when(~is_missing("parameter_value"), as_number("parameter_value"))).where("value_num IS NOT NULL")
    stats = rows.groupBy("parameter_name").agg(F.avg("value_num").alias("mean"), F.stddev_samp("value_num").alias("std"))
    out = rows.join(F.broadcast(stats), "parameter_name").join(F.broadcast(median_mad(rows, ["parameter_name"], ["value_num"])), "parameter_name")
    out = out.withColumn("z_score", F.coalesce(F.try_divide(F.col("value_num") - F.col("mean"), F.col("std")), F.lit(0.0))).withColumn("robust_score", F.coalesce(F.try_divide(F.col("value_num") - F.col("value_num_median"), 1.4826 * F.col("value_num_mad")), F.lit(0.0)))
    out = out.drop("mean", "std", "value_num_median", "value_num_mad")
    return out if hierarchy is None else out.join(F.broadcast(hierarchy), "parameter_name", "left")


def catalogue(telemetry: DataFrame) -> DataFrame:
    """Count, range and moments of each parameter."""
    x = F.when(~is_missing("parameter_value"), as_number("parameter_value"))
    return telemetry.groupBy("parameter_name").agg(F.count(F.lit(1)).alias("sample_count"), F.count(x).alias("numeric_count"), F.min(x).alias("min_value"), F.max(x).alias("max_value"), F.avg(x).alias("mean_value"), F.stddev_samp(x).alias("std_value"), F.min("timestamp_utc").alias("first_utc"), F.max("timestamp_utc").alias("last_utc"))


def markers(events: DataFrame, emitted: DataFrame) -> DataFrame:
    """Events and emitted windows as points in time."""
    e = events.select("tail_id", "flight_id", F.unix_millis("timestamp_utc").alias("at_ms"), F.lit("event").alias("marker_kind"), F.col("event_type_detected").alias("label"), "parameter_name")
    a = emitted.select("tail_id", "flight_id", F.col("start_ms").alias("at_ms"), F.lit("anomaly").alias("marker_kind"), F.col("severity").alias("label"))
    return e.unionByName(a, allowMissingColumns=True)


def phase_intervals(phases: DataFrame, windows: DataFrame) -> DataFrame:
    keys = ["tail_id", "flight_id", "win_id"]
    return phases.join(windows.select(*keys, "start_ms", "end_ms"), keys).select(*keys, "start_ms", "end_ms", "phase_id", "phase_state")


def write_bundle(tables: Mapping[str, DataFrame], root: str, *, fmt: str = "parquet", mode: str = "overwrite") -> dict[str, int]:
    """Write the tables and a manifest with their row counts, observed on the way."""
    from pyspark.sql import Observation

    counts = {}
    spark = None
    for name, df in tables.items():
        spark, seen = df.sparkSession, Observation(name)
        write_table(df.observe(seen, F.count(F.lit(1)).alias("n")), f"{root}/{name}", mode, fmt)
        counts[name] = seen.get["n"]
    if spark is not None:
        spark.createDataFrame([(json.dumps({"counts": counts, "format": fmt}),)], "value string").coalesce(1).write.mode(mode).text(f"{root}/bundle_manifest")
    return counts


def read_slice(telemetry: DataFrame, *, parameters=None, start_ms: int | None = None, end_ms: int | None = None, **hierarchy) -> DataFrame:
    """Rows by parameter, time and level; the predicates reach the scan."""
    out = telemetry
    if parameters:
        out = out.where(F.col("parameter_name").isin(*parameters))
    if start_ms is not None:
        out = out.where(F.col("timestamp_utc") >= F.timestamp_millis(F.lit(start_ms)))
    if end_ms is not None:
        out = out.where(F.col("timestamp_utc") <= F.timestamp_millis(F.lit(end_ms)))
    for level, names in hierarchy.items():
        out = out.where(F.col(level).isin(*names))
    return out
