"""What a window looks like: values held at its ends, its events, its drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vaporline.functions.exprs import as_number, is_missing
from vaporline.operators.relational import as_of, map_of, range_join

WINDOW = ("tail_id", "flight_id", "win_id")


def snapshots(telemetry: DataFrame, windows: DataFrame, at: str, parameters: DataFrame | None = None, tie: str | None = None) -> DataFrame:
    """(window, parameter, value): the last text of each parameter at or before the
    window's start or end. Each window is asked for each parameter of its flight."""
    flights = telemetry.select("tail_id", "flight_id", "parameter_name").distinct() if parameters is None else parameters
    anchors = windows.select(*WINDOW, F.col(at).alias("anchor_ms")).join(flights, ["tail_id", "flight_id"])
    samples = telemetry.withColumn("sample_ms", F.unix_millis("timestamp_utc"))
    out = as_of(anchors, samples, ["tail_id", "flight_id", "parameter_name"], "anchor_ms", "sample_ms", ["parameter_value"], tie)
    return out.where(~is_missing("parameter_value"))


def scaled(values: DataFrame, scaling: DataFrame) -> DataFrame:
    """Numeric values with the scaled one; null where the profile lacks the parameter."""
    rows = values.withColumn("value_num", as_number("parameter_value")).where("value_num IS NOT NULL")
    s = F.broadcast(scaling.select("parameter_name", "scaling_center", "scaling_iqr"))
    return rows.join(s, "parameter_name", "left").withColumn("value_scaled", (F.col("value_num") - F.col("scaling_center")) / F.greatest(F.col("scaling_iqr"), F.lit(1e-6))).drop("scaling_center", "scaling_iqr")


def vectors(values: DataFrame, column: str, name: str) -> DataFrame:
    """One map from parameter to value for each window."""
    return values.groupBy(*WINDOW).agg(map_of("parameter_name", column).alias(name))


def events_in_windows(events: DataFrame, windows: DataFrame, bucket_ms: int, how: str = "inner") -> DataFrame:
    """Events with every window that holds them; a shared border counts for both."""
    w = windows.select(*WINDOW, "start_ms", "end_ms")
    return range_join(events.withColumn("at_ms", F.unix_millis("timestamp_utc")), w, ["tail_id", "flight_id"], "at_ms", "start_ms", "end_ms", bucket_ms, how)


def event_summary(joined: DataFrame) -> DataFrame:
    """Counts and impulses of slope, switch, threshold, oscillation and guard events of
    each window and parameter."""
    kind = F.col("event_type_detected")
    slope = kind.startswith("slope")
    delta = F.element_at("payload", "delta").try_cast("double")
    peak = F.element_at("payload", "peak_abs_delta").try_cast("double")
    return joined.groupBy(*WINDOW, "parameter_name").agg(
        F.count_if(slope & (F.element_at("payload", "emission") == "run_start")).alias("slope_runs"),
        F.count_if(slope & (F.element_at("payload", "emission") == "run_strengthen")).alias("slope_reinforcements"),
        F.sum(F.when(slope, delta)).alias("signed_impulse"),
        F.sum(F.when(slope, F.abs(delta))).alias("abs_impulse"),
        F.max(F.when(slope, peak)).alias("peak_abs_delta"),
        *[F.count_if(kind == k).alias(f"{k}_count") for k in ("switch", "threshold", "oscillation", "drift_guard")],
    )


def drift(values: DataFrame, windows: DataFrame, column: str = "value_scaled") -> DataFrame:
    """L2 norm of the change of a window's vector against the window before, a missing
    parameter being 0; the first window's is its own norm."""
    order = Window.partitionBy("tail_id", "flight_id").orderBy("end_ms", "win_id")
    maps = windows.select(*WINDOW, "end_ms").join(vectors(values.where(F.col(column).isNotNull()), column, "v"), list(WINDOW), "left")
    none = F.create_map().cast("map<string,double>")
    rows = maps.withColumn("v", F.coalesce("v", none)).withColumn("before", F.coalesce(F.lag("v").over(order), none))
    zero = F.lit(0.0)
    gaps = F.map_values(F.map_zip_with("v", "before", lambda _, a, b: F.coalesce(a, zero) - F.coalesce(b, zero)))
    return rows.select(*WINDOW, F.sqrt(F.aggregate(gaps, zero, lambda s, d: s + d * d)).alias("drift_magnitude"))


def window_features(telemetry: DataFrame, events: DataFrame, windows: DataFrame, scaling: DataFrame, bucket_ms: int) -> DataFrame:
    """The whole feature row of each window: vectors at both ends, raw and scaled,
    states, event counts and drift."""
    out = windows
    ends = {}
    for at, name in (("start_ms", "t_start"), ("end_ms", "t_end")):
        held = snapshots(telemetry, windows, at)
        ends[name] = scaled(held, scaling)
        states = held.where(as_number("parameter_value").isNull())
        for values, column, label in ((ends[name], "value_num", f"continuous_vector_{name}"), (ends[name].where("value_scaled IS NOT NULL"), "value_scaled", f"continuous_vector_{name}_scaled"), (states, "parameter_value", f"categorical_state_{name}")):
            out = out.join(vectors(values, column, label), list(WINDOW), "left")
    summary = event_summary(events_in_windows(events, windows, bucket_ms))
    fields = [c for c in summary.columns if c not in (*WINDOW, "parameter_name")]
    packed = summary.groupBy(*WINDOW).agg(F.struct(*[map_of("parameter_name", c).alias(f"{c}_by_parameter") for c in fields]).alias("continuous_event_summary"))
    return out.join(packed, list(WINDOW), "left").join(drift(ends["t_end"], windows), list(WINDOW), "left")
