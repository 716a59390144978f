"""Window scores on eight channels, their calibration and severity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaporline.functions.exprs import absolute_deviation, clip01, positive_deviation, severity
from vaporline.operators.features import WINDOW
from vaporline.operators.relational import median_mad

PHASE = ("tail_id", "phase_id")
#: Channels, in the order that breaks ties (fixed values).
CHANNELS = ("regime_deviation", "reconstruction_error", "event_discordance", "bound_violation", "accumulation_violation", "response_violation", "state_violation", "coherence_break")
DISCORDANCE = ("event_rate", "type_diversity", "continuous_share", "state_share", "active_parameters")


def window_event_metrics(events_with_windows: DataFrame, durations: DataFrame) -> DataFrame:
    """Rate, diversity, shares and parameters of each window's events."""
    kind = F.col("event_type_detected")
    continuous = kind.startswith("slope") | kind.isin("switch", "threshold", "oscillation", "drift_guard")
    rows = events_with_windows.groupBy(*WINDOW).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.count_distinct("event_type_detected").cast("double").alias("type_diversity"),
        F.avg(continuous.cast("double")).alias("continuous_share"),
        F.avg((~continuous).cast("double")).alias("state_share"),
        F.count_distinct("parameter_name").cast("double").alias("active_parameters"),
    )
    return durations.join(rows, list(WINDOW), "left").fillna(0.0, ["n", "type_diversity", "continuous_share", "state_share", "active_parameters"]).withColumn("event_rate", F.col("n") * 1000 / F.greatest(F.col("duration_ms"), F.lit(1)))


def event_discordance(metrics: DataFrame) -> DataFrame:
    """Mean distance of a window's event metrics from its phase's medians, in MADs."""
    base = median_mad(metrics, PHASE, DISCORDANCE)
    rows = metrics.join(F.broadcast(base), list(PHASE))
    total = F.lit(0.0)
    for c in DISCORDANCE:
        total = total + absolute_deviation(F.col(c), F.col(f"{c}_median"), F.col(f"{c}_mad"))
    return rows.select(*WINDOW, *PHASE[1:], (total / len(DISCORDANCE)).alias("event_discordance"))


def mad_deviation(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns as their positive distance from the phase's median, in MADs."""
    base = median_mad(rows, PHASE, columns)
    return rows.join(F.broadcast(base), list(PHASE)).select(*WINDOW, "phase_id", *[positive_deviation(F.col(c), F.col(f"{c}_median"), F.col(f"{c}_mad")).alias(c) for c in columns])


def relevance(*parts: Column) -> Column:
    """Mean of values clipped to 0 and 1, null ones as 0."""
    total = F.lit(0.0)
    for p in parts:
        total = total + clip01(F.coalesce(p, F.lit(0.0)))
    return total / len(parts)


def behavior_activation(evidence: DataFrame) -> DataFrame:
    """Raw violations of each window and parameter. ``evidence`` has residual_share,
    counts by event kind and the parameter's profiles (missing ones count as 0)."""
    c = lambda n: F.coalesce(F.col(n), F.lit(0.0)).cast("double") if n in evidence.columns else F.lit(0.0)
    share = c("residual_share")
    bound = relevance(c("regulated_score"), c("bound_occupancy"), c("saturation_rate"))
    novelty = relevance(1 - c("recommended_emit_threshold"), 1 - c("bound_occupancy"), 1 - c("saturation_rate"))
    accumulation = relevance(c("accumulative_score"), c("monotone_accumulation_score"), c("persistent_run_strength"), c("run_reinforcement_score"), c("drift_score"))
    reset = relevance(c("reset_drop_rate"), c("monotone_accumulation_score"), c("accumulative_score"))
    response = relevance(F.greatest(c("tracking_score"), c("regulated_score"), c("inertial_score")), c("tracking_error_score"), c("lagged_response_score"), c("oscillation_score"))
    rough = relevance(1 - c("smoothness_score"), 1 - c("repeatability_score"), 1 - c("recommended_emit_oscillation"))
    state = relevance(c("discrete_state_score"), c("transition_rate"), c("state_chatter_rate"), 1 - c("dominant_state_ratio"))
    return evidence.withColumns(
        {
            "bound_violation": share * F.log1p(c("threshold_count") + c("drift_guard_count") + 0.5 * c("switch_count")) * (0.5 + 0.25 * bound + 0.25 * novelty),
            "accumulation_violation": share * (0.7 * accumulation + 0.3 * reset),
            "response_violation": share * F.log1p(c("slope_count") + c("switch_count") + c("oscillation_count")) * (0.5 + 0.25 * response + 0.25 * rough),
            "state_violation": share * F.log1p(c("state_count") + c("enter_exit_count") + 2 * c("illegal_count") + 2 * c("dwell_violation_count")) * (0.5 + 0.5 * state),
        }
    )


def shares(rows: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Each row's part of its window's total."""
    total = F.sum(value).over(Window.partitionBy(*keys))
    return rows.withColumn(name, F.coalesce(F.try_divide(F.col(value), total), F.lit(0.0)))


def coherence_break(residual_by_subsystem: DataFrame, events_by_subsystem: DataFrame) -> DataFrame:
    """Half the distance between where residuals and events lie among subsystems, less
    certain for fewer than three events. Inputs: window, subsystem_id, score or count."""
    r = residual_by_subsystem.select(*WINDOW, "subsystem_id", F.col("score").alias("r"), F.lit(0.0).alias("e"))
    e = events_by_subsystem.select(*WINDOW, "subsystem_id", F.lit(0.0).alias("r"), F.col("count").cast("double").alias("e"))
    both = r.unionByName(e).groupBy(*WINDOW, "subsystem_id").agg(F.sum("r").alias("r"), F.sum("e").alias("e"))
    both = shares(shares(both, WINDOW, "r", "rs"), WINDOW, "e", "es")
    return both.groupBy(*WINDOW).agg((0.5 * F.sum(F.abs(F.col("rs") - F.col("es"))) * F.least(F.lit(1.0), F.sum("e") / 3)).alias("coherence_break"))


def combine(channels: DataFrame) -> DataFrame:
    """Global score (mean of the channels above 0), its severity, the leading channel."""
    value = {c: F.coalesce(F.col(c), F.lit(0.0)) if c in channels.columns else F.lit(0.0) for c in CHANNELS}
    total, active = F.lit(0.0), F.lit(0)
    top = F.greatest(*value.values())
    leading = F.lit(CHANNELS[-1])
    for c in reversed(CHANNELS):
        leading = F.when(value[c] == top, c).otherwise(leading)
    for v in value.values():
        total, active = total + F.when(v > 0, v).otherwise(0.0), active + (v > 0).cast("int")
    out = channels.withColumn("score", F.coalesce(F.try_divide(total, active), F.lit(0.0))).withColumn("dominant_channel", leading)
    return out.withColumn("severity", severity("score"))


def component_map(names: Sequence[str] = CHANNELS) -> Column:
    return F.create_map(*[x for n in names for x in (F.lit(n), F.coalesce(F.col(n), F.lit(0.0)))])


def calibrate(scores: DataFrame, *, min_warm: int = 100, p_limit: float = 0.10, keys: Sequence[str] = ("tail_id", "flight_id", "phase_id")) -> DataFrame:
    """Empirical tail of each score in its flight and phase, and whether to emit: warm,
    and of medium or high severity, or low with a small tail."""
    group = Window.partitionBy(*keys)
    rows = scores.withColumn("n_phase", F.count(F.lit(1)).over(group)).withColumn("warm", F.col("n_phase") >= min_warm)
    rows = rows.withColumn("p_value", F.when(F.col("warm"), F.cume_dist().over(group.orderBy(F.col("score").desc()))))
    emit = F.col("severity").isin("medium", "high") | ((F.col("severity") == "low") & (F.col("p_value") <= p_limit))
    return rows.withColumn("emit_ready", F.col("warm") & emit)
