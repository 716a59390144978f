"""Synthetic telemetry: five behaviours, made by expressions over a range, and faults."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BEHAVIORS = ("regulated", "tracking", "inertial", "accumulative", "discrete_state")


def noise(*keys: Column, seed: int = 0) -> Column:
    """A repeatable number in [-1, 1) for each combination of keys."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(2_000_000)) / F.lit(1_000_000.0) - 1


def behavior(name: str, step: Column, shade: Column) -> Column:
    """The value of a behaviour at a step, as text."""
    t = step.cast("double")
    value = {
        "regulated": 50 + 0.4 * shade,
        "tracking": 30 + 10 * F.floor(t / 40) % 3 + 4 * (1 - F.exp(-(t % 40) / 6)) + 0.2 * shade,
        "inertial": 20 + 12 * F.sin(t / 25) + 0.1 * shade,
        "accumulative": (t % 200) * 0.5 + 0.05 * shade,
    }
    if name == "discrete_state":
        return F.element_at(F.array(F.lit("OFF"), F.lit("ARMED"), F.lit("ON")), (F.floor(t / 15) % 3 + 1).cast("int"))
    return F.round(value[name], 6).cast("string")


def telemetry(spark: SparkSession, *, tails: int = 1, flights: int = 1, sensors: int = 5, steps: int = 200, step_ms: int = 100, start: str = "2024-01-01 00:00:00") -> DataFrame:
    """tails x flights x sensors x steps rows, the same on every run; partitions of a
    range, so any size is made in parallel."""
    each = F.col("id")
    size = tails * flights * sensors * steps
    rows = spark.range(size).select((each % steps).alias("step"), (F.floor(each / steps) % sensors).alias("sensor_no"), (F.floor(each / (steps * sensors)) % flights).alias("flight_no"), F.floor(each / (steps * sensors * flights)).alias("tail_no"))
    shade = noise(F.col("tail_no"), F.col("flight_no"), F.col("sensor_no"), F.col("step"))
    value = F.lit(None).cast("string")
    for n, name in enumerate(BEHAVIORS):
        value = F.when(F.col("sensor_no") % len(BEHAVIORS) == n, behavior(name, F.col("step"), shade)).otherwise(value)
    family = F.element_at(F.array(*map(F.lit, BEHAVIORS)), (F.col("sensor_no") % len(BEHAVIORS) + 1).cast("int"))
    at = F.timestamp_millis(F.unix_millis(F.lit(start).cast("timestamp")) + F.col("step") * step_ms)
    return rows.select(F.concat(F.lit("TAIL_"), "tail_no").alias("tail_id"), F.concat(F.lit("FLIGHT_"), "flight_no").alias("flight_id"), at.alias("timestamp"), F.concat(F.upper(family), F.lit("_"), "sensor_no").alias("parameter_name"), value.alias("parameter_value"), "step", family.alias("behavior_family_label"))


def with_fault(rows: DataFrame, parameter: str, kind: str, first: int, last: int, size: float = 10.0) -> DataFrame:
    """A fault on one parameter between two steps: offset, drift, stuck, drop-out."""
    inside = (F.col("parameter_name") == parameter) & F.col("step").between(first, last)
    x = F.col("parameter_value").try_cast("double")
    changed: Mapping[str, Column] = {"offset": (x + size).cast("string"), "drift": (x + size * (F.col("step") - first) / max(last - first, 1)).cast("string"), "stuck": F.lit(str(size)), "drop_out": F.lit(None).cast("string")}
    return rows.withColumn("misbehavior_active", inside).withColumn("parameter_value", F.when(inside, changed[kind]).otherwise(F.col("parameter_value")))


def seed_dataset(spark: SparkSession, root: str, **size) -> str:
    """Write raw telemetry where the stages look for it."""
    telemetry(spark, **size).write.mode("overwrite").parquet(f"{root}/raw")
    return f"{root}/raw"
