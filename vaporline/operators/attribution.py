"""Emitted windows traced back to parameters, modules, samples, events and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaporline.functions.exprs import as_number, millis
from vaporline.operators.features import WINDOW
from vaporline.operators.relational import first_row, range_join, top_k
from vaporline.operators.scores import CHANNELS

#: Words that mark a text as a message of the panel (fixed values).
PANEL_WORDS = ("lcd", "panel", "msg", "message", "cas", "warn", "warning", "fault", "caution", "annunc", "text")
MESSAGE_CODE = r"([A-Z]{2,}[A-Z0-9_-]*)"


def channel_weight(name: str) -> Column:
    """A channel's part of all channels' logarithmic mass."""
    mass = lambda c: F.log1p(F.coalesce(F.col(c), F.lit(0.0)))
    total = F.lit(0.0)
    for c in CHANNELS:
        total = total + mass(c)
    return F.coalesce(F.try_divide(mass(name), total), F.lit(0.0))


def localize(evidence: DataFrame, k: int = 5) -> DataFrame:
    """The k parameters that account most for each window.

    ``evidence``: a row a window and parameter with the window's channels, the
    parameter's module and subsystem, the module's size, residual_share, and the shares
    event, bound, response, state and the accumulation relevance (0 if absent).
    """
    have = lambda n: F.coalesce(F.col(n), F.lit(0.0)) if n in evidence.columns else F.lit(0.0)
    size = F.sqrt(F.greatest(have("module_size"), F.lit(1.0)))
    residual = have("residual_share") / size
    support = (
        residual * (channel_weight("regime_deviation") + channel_weight("coherence_break") + channel_weight("reconstruction_error"))
        + have("event_share") / size * channel_weight("event_discordance")
        + have("bound_share") / size * channel_weight("bound_violation")
        + residual * have("accumulation_relevance") * channel_weight("accumulation_violation")
        + have("response_share") / size * channel_weight("response_violation")
        + have("state_share_of_parameter") / size * channel_weight("state_violation")
    )
    rows = evidence.withColumns({c: F.lit(0.0) for c in CHANNELS if c not in evidence.columns}).withColumn("support", support)
    modules = rows.groupBy(*WINDOW, "module_id").agg(F.sqrt(F.sum(F.col("support") * F.col("support"))).alias("module_support"))
    modules = modules.withColumn("module_share", F.col("module_support") / F.greatest(F.sum("module_support").over(Window.partitionBy(*WINDOW)), F.lit(1e-12)))
    rows = rows.join(modules, [*WINDOW, "module_id"]).withColumn("support", F.col("support") * (1 + F.col("module_share")))
    order = [F.round("support", 9).desc(), F.round("module_share", 9).desc(), have("state_share_of_parameter").desc(), have("response_share").desc(), have("accumulation_relevance").desc(), have("event_share").desc(), have("residual_share").desc(), F.col("parameter_name")]
    return top_k(rows, WINDOW, order, k, "parameter_rank").select(*WINDOW, "parameter_name", "subsystem_id", "module_id", "support", "parameter_rank")


def targets(localized: DataFrame, level: str = "module_id", k: int = 3, cut: int = 3) -> DataFrame:
    """The k modules or subsystems with most support by rank among the first parameters."""
    rows = localized.where(F.col("parameter_rank") <= cut).groupBy(*WINDOW, level).agg(F.sum(F.col("support") / F.col("parameter_rank")).alias("target_support"))
    return top_k(rows, WINDOW, [F.round("target_support", 9).desc(), F.col(level)], k, "target_rank")


def raw_rows(telemetry: DataFrame, windows: DataFrame, bucket_ms: int) -> DataFrame:
    """The samples inside emitted windows, both ends included."""
    return range_join(telemetry.withColumn("at_ms", millis("timestamp_utc")), windows.select(*WINDOW, "start_ms", "end_ms"), ["tail_id", "flight_id"], "at_ms", "start_ms", "end_ms", bucket_ms)


def shouldered_events(events: DataFrame, windows: DataFrame, hierarchy: DataFrame, bucket_ms: int) -> DataFrame:
    """Events of known parameters in a window widened by its length on both sides."""
    shoulder = F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(1))
    wide = windows.select(*WINDOW, (F.col("start_ms") - shoulder).alias("from_ms"), (F.col("end_ms") + shoulder).alias("to_ms"))
    known = events.join(F.broadcast(hierarchy), "parameter_name").withColumn("at_ms", millis("timestamp_utc"))
    return range_join(known, wide, ["tail_id", "flight_id"], "at_ms", "from_ms", "to_ms", 3 * bucket_ms)


def latest_covering(events: DataFrame, windows: DataFrame, bucket_ms: int) -> DataFrame:
    """Each event with the window that covers it and started last."""
    rows = range_join(events.withColumn("at_ms", millis("timestamp_utc")), windows.select(*WINDOW, "start_ms", "end_ms"), ["tail_id", "flight_id"], "at_ms", "start_ms", "end_ms", bucket_ms)
    return first_row(rows, ["tail_id", "flight_id", "event_seq_id"], [F.col("start_ms").desc(), F.col("win_id").desc()])


def subsystem_context(events_with_windows: DataFrame, hierarchy: DataFrame, k: int = 5) -> DataFrame:
    """The k parameters with most events of each window's subsystems, and their shares."""
    rows = events_with_windows.join(F.broadcast(hierarchy), "parameter_name").groupBy(*WINDOW, "subsystem_id", "parameter_name").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*WINDOW, "subsystem_id")))
    return top_k(rows, [*WINDOW, "subsystem_id"], [F.col("n").desc(), F.col("parameter_name")], k, "sensor_rank")


def panel_items(telemetry: DataFrame, windows: DataFrame, bucket_ms: int, k: int = 5) -> DataFrame:
    """The k texts that say most about each window: panel words first, then the latest."""
    words = "|".join(PANEL_WORDS)
    rows = telemetry.where(as_number("parameter_value").isNull() & (F.trim("parameter_value") != ""))
    hit = F.lower("parameter_name").rlike(words) | F.lower("parameter_value").rlike(words)
    rows = raw_rows(rows.withColumn("keyword_hit", hit.cast("int")), windows, bucket_ms)
    return top_k(rows, WINDOW, [F.col("keyword_hit").desc(), F.col("at_ms").desc(), F.col("parameter_name"), F.col("parameter_value")], k, "item_rank")


def panel_context(items: DataFrame) -> DataFrame:
    """Distinct sorted texts, message codes and sources of each window."""
    code = F.regexp_extract("parameter_value", MESSAGE_CODE, 1)
    distinct = lambda c: F.array_sort(F.collect_set(c))
    return items.groupBy(*WINDOW).agg(F.struct(distinct("parameter_value").alias("text"), distinct(F.when(code != "", code)).alias("message_codes"), distinct("parameter_name").alias("source")).alias("panel_context"))


def window_attribution(calibrated: DataFrame, context: DataFrame, panel: DataFrame, localized: DataFrame) -> DataFrame:
    """One nested row for each window to emit."""
    subsystems = context.groupBy(*WINDOW).agg(F.sort_array(F.collect_list(F.struct("subsystem_id", "sensor_rank", "parameter_name", "share"))).alias("subsystem_context"))
    parameters = localized.groupBy(*WINDOW).agg(F.sort_array(F.collect_list(F.struct("parameter_rank", "parameter_name", "module_id", "support"))).alias("parameters"))
    out = calibrated.where("emit_ready")
    for side in (subsystems, panel, parameters):
        out = out.join(side, list(WINDOW), "left")
    return out


def candidate_evidence(evidence: DataFrame, localized: DataFrame, *, keep: int = 5, structural: int = 3) -> DataFrame:
    """Evidence rows with their localisation rank and whether the cuts retain them."""
    ranks = localized.select(*WINDOW, "parameter_name", "parameter_rank", "support")
    rows = evidence.join(ranks, [*WINDOW, "parameter_name"], "left")
    return rows.withColumn("retained", F.coalesce(F.col("parameter_rank") <= keep, F.lit(False))).withColumn("retained_structural", F.coalesce(F.col("parameter_rank") <= structural, F.lit(False)))


def bounded_evidence(rows: DataFrame, k: int = 16) -> DataFrame:
    """Rows that are among the k first of their window by residual or by activation."""
    residual = Window.partitionBy(*WINDOW).orderBy(F.round("residual_share", 9).desc(), "parameter_name")
    active = Window.partitionBy(*WINDOW).orderBy(F.round("activation", 9).desc(), "parameter_name")
    return rows.withColumn("residual_rank", F.row_number().over(residual)).withColumn("activation_rank", F.row_number().over(active)).where((F.col("residual_rank") <= k) | (F.col("activation_rank") <= k))
