"""From samples to discrete events.

What a window function can express is one; the detectors that carry a state from
sample to sample (a run's last emission, a refractory time, a guard) are folds over one
parameter of one flight, run as grouped maps. ``vaporline.streaming`` runs the same
folds over an unbounded stream.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaporline.functions.exprs import as_number, datatype, dwell_bucket, is_missing, millis, sorted_map_json
from vaporline.operators.profiling import FLIGHT
from vaporline.operators.relational import islands

EVENT_SCHEMA = "tail_id string, flight_id string, parameter_name string, timestamp_utc timestamp, event_type_detected string, payload map<string,string>"


@dataclass(frozen=True)
class ContinuousConfig:
    alpha: float = 0.35
    slope_source: str = "ema"
    delta_threshold: float = 0.0
    emit_threshold: bool = False
    slope_threshold: float = 2.0
    threshold_mode: str = "fixed"
    threshold_quantile: float = 0.75
    threshold_scale: float = 0.35
    threshold_min: float = 1e-6
    persistence: int = 2
    reemit_ratio: float = 1.5
    warmup: int = 4
    min_sigma: float = 1e-3
    emit_switch: bool = False
    switch_min_abs_delta: float = 0.0
    switch_delta_scale: float = 6.0
    switch_residual_z_min: float = 2.0
    switch_delta_z: float = 6.0
    switch_z: float = 6.0
    switch_refractory: int = 20
    drift_guard_delta: float = 0.0
    drift_guard_ms: int = 0
    emit_oscillation: bool = False
    oscillation_window: int = 40
    oscillation_smoothing: int = 5
    oscillation_sign_changes: int = 4
    oscillation_min_amplitude: float = 0.0
    oscillation_min_extrema: int = 4
    oscillation_min_period: float = 2.0
    oscillation_min_alternation: float = 0.5
    oscillation_period_cv: float = 0.5
    oscillation_band: float = 0.35
    oscillation_refractory: int = 80


@dataclass(frozen=True)
class CategoricalConfig:
    emit_enter: bool = False
    emit_exit: bool = False
    emit_dwell_bucket: bool = False
    emit_transition: bool = True
    emit_dropped: bool = True
    min_dwell_ms: int = 0
    dwell_guard_ms: int = 0
    illegal: tuple[tuple[str, str], ...] = ()


def channels(telemetry: DataFrame, datatypes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numeric and constant parameters, binary and categorical ones; no others."""
    kinds = F.broadcast(datatypes.select("parameter_name", datatype("parameter_datatype").alias("__kind")))
    rows = telemetry.join(kinds, "parameter_name")
    return rows.where(F.col("__kind").isin("numeric", "constant")).drop("__kind"), rows.where(F.col("__kind").isin("binary", "categorical")).drop("__kind")


def smoothing_span(alpha: float) -> int:
    """Samples of the moving average that stands in for an exponential one."""
    return max(round(2 / alpha - 1), 1)


def numbers(telemetry: DataFrame) -> DataFrame:
    """The samples that are numbers, as ``val``."""
    return telemetry.withColumn("val", F.when(~is_missing("parameter_value"), as_number("parameter_value"))).where("val IS NOT NULL")


def continuous_features(telemetry: DataFrame, cfg: ContinuousConfig = ContinuousConfig(), *, tie: Sequence[str] = ("val",), exact: bool = True) -> DataFrame:
    """Each sample with its moving average, steps, residual, sigma, slope sign and
    candidates; all windows share one partitioning and order, so one shuffle and sort."""
    order = Window.partitionBy(*FLIGHT).orderBy("timestamp_utc", *tie)
    whole = Window.partitionBy(*FLIGHT)
    span = smoothing_span(cfg.alpha)
    near = order.rowsBetween(-(span - 1), 0)
    wide = order.rowsBetween(-(max(span, cfg.warmup, 2) - 1), 0)
    rows = numbers(telemetry).withColumn("sample_index", F.row_number().over(order)).withColumn("smoothed", F.avg("val").over(near))
    rows = rows.withColumn("prev_val", F.lag("val").over(order)).withColumn("prev_smoothed", F.lag("smoothed").over(order))
    rows = rows.withColumn("delta_raw", F.col("val") - F.col("prev_val")).withColumn("delta_smoothed", F.col("smoothed") - F.col("prev_smoothed"))
    rows = rows.withColumn("delta", F.coalesce(F.col("delta_raw" if cfg.slope_source == "raw" else "delta_smoothed"), F.lit(0.0)))
    if cfg.threshold_mode == "adaptive_run":
        q = F.percentile(F.abs("delta_raw"), cfg.threshold_quantile) if exact else F.percentile_approx(F.abs("delta_raw"), cfg.threshold_quantile, 1000)
        threshold = F.greatest(F.coalesce(q.over(whole), F.lit(0.0)) * cfg.threshold_scale, F.lit(cfg.threshold_min))
    else:
        threshold = F.lit(float(cfg.slope_threshold))
    rows = rows.withColumn("slope_threshold", threshold)
    rows = rows.withColumn("slope_sign", F.when(F.col("delta") > F.col("slope_threshold"), 1).when(F.col("delta") < -F.col("slope_threshold"), -1).otherwise(0))
    rows = rows.withColumn("residual", F.col("val") - F.col("prev_smoothed"))
    rows = rows.withColumn("sigma", F.greatest(F.sqrt(F.avg(F.pow(F.coalesce("residual", F.lit(0.0)), F.lit(2.0))).over(wide)), F.lit(cfg.min_sigma)))
    rows = rows.withColumn("warm", F.col("sample_index") >= cfg.warmup).withColumn("usual_step", F.avg(F.abs(F.coalesce("delta_raw", F.lit(0.0)))).over(near))
    step, off = F.abs("delta_raw"), F.abs("residual")
    floor = F.lit(float(cfg.switch_min_abs_delta))
    candidate = (
        ((step >= F.greatest(floor, cfg.switch_delta_scale * F.greatest(F.col("usual_step"), F.lit(cfg.min_sigma)))) & (off >= cfg.switch_residual_z_min * F.col("sigma")))
        | (step >= F.greatest(floor, cfg.switch_delta_z * F.col("sigma")))
        | (off >= cfg.switch_z * F.col("sigma"))
    )
    return rows.withColumn("switch_candidate", F.coalesce(F.col("warm") & F.col("prev_smoothed").isNotNull() & candidate, F.lit(False)))


def oscillation_features(features: DataFrame, cfg: ContinuousConfig = ContinuousConfig()) -> DataFrame:
    """Extrema of the smoothed signal, their spacing, alternation and the candidate."""
    order = Window.partitionBy(*FLIGHT).orderBy("sample_index")
    span = order.rowsBetween(-(max(cfg.oscillation_window, 2) - 1), 0)
    prior = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = features.withColumn("osc", F.avg("val").over(order.rowsBetween(-(cfg.oscillation_smoothing - 1), 0)))
    rows = rows.withColumn("osc_prev", F.lag("osc").over(order)).withColumn("osc_next", F.lead("osc").over(order))
    rows = rows.withColumn("osc_sign", F.coalesce(F.signum(F.col("osc") - F.col("osc_prev")), F.lit(0.0)))
    rows = rows.withColumn("sign_change", (F.coalesce(F.lag("osc_sign").over(order), F.lit(0.0)) * F.col("osc_sign") < 0).cast("int"))
    rows = rows.withColumn("sign_changes", F.sum("sign_change").over(span)).withColumn("amplitude", F.max("osc").over(span) - F.min("osc").over(span))
    peak = (F.col("osc") > F.col("osc_prev")) & (F.col("osc") >= F.col("osc_next"))
    trough = (F.col("osc") < F.col("osc_prev")) & (F.col("osc") <= F.col("osc_next"))
    rows = rows.withColumn("extremum", F.when(peak, "peak").when(trough, "trough"))
    at = F.when(F.col("extremum").isNotNull(), F.col("sample_index"))
    rows = rows.withColumn("extrema", F.count("extremum").over(span)).withColumn("prev_at", F.last(at, True).over(prior)).withColumn("prev_kind", F.last("extremum", True).over(prior))
    rows = rows.withColumn("spacing", F.when(F.col("extremum").isNotNull(), F.col("sample_index") - F.col("prev_at")))
    rows = rows.withColumn("period", F.avg("spacing").over(span)).withColumn("period_std", F.stddev_pop("spacing").over(span))
    rows = rows.withColumn("alternates", F.coalesce(F.col("extremum") != F.col("prev_kind"), F.lit(False)).cast("int"))
    rows = rows.withColumn("alternation", F.when(F.col("extrema") > 1, F.sum("alternates").over(span) / (F.col("extrema") - 1)).otherwise(0.0))
    steady = F.col("period").isNull() | (F.try_divide(F.coalesce("period_std", F.lit(0.0)), F.col("period")) <= cfg.oscillation_period_cv)
    in_band = F.coalesce(F.col("spacing").between(F.col("period") * (1 - cfg.oscillation_band), F.col("period") * (1 + cfg.oscillation_band)), F.lit(True))
    return rows.withColumn(
        "oscillation_candidate",
        F.col("warm")
        & F.col("extremum").isNotNull()
        & (F.col("sign_changes") >= cfg.oscillation_sign_changes)
        & (F.col("amplitude") >= cfg.oscillation_min_amplitude)
        & (F.col("extrema") >= cfg.oscillation_min_extrema)
        & (F.coalesce("period", F.lit(0.0)) >= cfg.oscillation_min_period)
        & (F.col("alternation") >= cfg.oscillation_min_alternation)
        & (steady | in_band),
    )


def payload(**values: Column) -> Column:
    """Present values as text, by name."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in values.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e.value.isNotNull()))


def threshold_events(features: DataFrame, cfg: ContinuousConfig = ContinuousConfig()) -> DataFrame:
    """Samples far from the average, or far from the last one; no state."""
    far = F.abs("residual") >= 3 * F.col("sigma")
    step = F.abs("delta_raw") >= cfg.delta_threshold if cfg.delta_threshold > 0 else F.lit(False)
    rows = features.where(F.col("warm") & (F.coalesce(far, F.lit(False)) | F.coalesce(step, F.lit(False))))
    return rows.withColumn("event_type_detected", F.lit("threshold")).withColumn("payload", payload(value=F.col("val"), delta=F.col("delta_raw"), residual=F.col("residual"), sigma=F.col("sigma")))


def slope_run_starts(features: DataFrame, cfg: ContinuousConfig = ContinuousConfig()) -> DataFrame:
    """The sample at which each run of one slope sign has lasted long enough: the first
    emission of the fold below, as gaps and islands."""
    w = Window.partitionBy(*FLIGHT).orderBy("sample_index")
    rows = features.withColumn("__before", F.lag("slope_sign").over(w))
    rows = islands(rows, FLIGHT, ["sample_index"], F.col("__before").isNull() | (F.col("__before") != F.col("slope_sign")), "run")
    rows = rows.withColumn("run_length", F.row_number().over(Window.partitionBy(*FLIGHT, "run").orderBy("sample_index")))
    return rows.where((F.col("slope_sign") != 0) & (F.col("run_length") == cfg.persistence)).drop("__before")


class SlopeFold:
    """Slope runs, switches and guards of one parameter, sample by sample."""

    def __init__(self, cfg: ContinuousConfig):
        self.cfg = cfg
        self.sign, self.length, self.peak, self.emitted = 0, 0, 0.0, None
        self.last_switch = self.last_oscillation = None
        self.moved, self.guard_at = 0.0, None

    def step(self, index: int, at_ms: int, val: float, delta: float, delta_raw: float, sign: int, switch: bool, oscillation: bool = False) -> list[tuple[str, dict]]:
        cfg, out = self.cfg, []
        if sign == 0:
            self.sign, self.length, self.peak, self.emitted = 0, 0, 0.0, None
        else:
            if sign != self.sign:
                self.sign, self.length, self.peak, self.emitted = sign, 0, 0.0, None
            self.length += 1
            self.peak = max(self.peak, abs(delta))
            if self.length >= cfg.persistence:
                what = None
                if self.emitted is None:
                    what = "run_start"
                elif self.peak >= self.emitted * max(cfg.reemit_ratio, 1.0) and self.peak > self.emitted:
                    what = "run_strengthen"
                if what:
                    self.emitted = self.peak
                    out.append(("slope_pos" if sign > 0 else "slope_neg", {"emission": what, "run_length": self.length, "peak_abs_delta": self.peak, "delta": delta, "value": val}))
        if cfg.emit_switch and switch and (self.last_switch is None or index - self.last_switch >= cfg.switch_refractory):
            self.last_switch = index
            out.append(("switch", {"delta": delta_raw, "value": val}))
        if cfg.emit_oscillation and oscillation and (self.last_oscillation is None or index - self.last_oscillation >= cfg.oscillation_refractory):
            self.last_oscillation = index
            out.append(("oscillation", {"value": val}))
        if cfg.drift_guard_delta > 0 or cfg.drift_guard_ms > 0:
            self.guard_at = at_ms if self.guard_at is None else self.guard_at
            self.moved += abs(delta_raw)
            far, late = cfg.drift_guard_delta > 0 and self.moved >= cfg.drift_guard_delta, cfg.drift_guard_ms > 0 and at_ms - self.guard_at >= cfg.drift_guard_ms
            if far or late:
                out.append(("drift_guard", {"moved": self.moved, "value": val}))
                self.moved, self.guard_at = 0.0, at_ms
        return out


class StateFold:
    """Transitions, dwell, drop-outs and guards of one parameter's states."""

    def __init__(self, cfg: CategoricalConfig):
        self.cfg, self.illegal = cfg, frozenset(cfg.illegal)
        self.state, self.since, self.guard_at, self.dropped = None, 0, 0, False

    def step(self, at_ms: int, value: str | None) -> list[tuple[str, dict]]:
        cfg, out = self.cfg, []
        if value is None:
            if self.state is not None:
                if cfg.emit_dropped:
                    out.append(("dropped", {"from": self.state}))
                if cfg.emit_exit:
                    out.append(("state_exit", {"state": self.state, "dwell_ms": at_ms - self.since}))
            self.state = None
            return out
        if self.state is None:
            if cfg.emit_enter:
                out.append(("state_enter", {"state": value}))
            self.state, self.since, self.guard_at = value, at_ms, at_ms
        elif value != self.state:
            dwell = at_ms - self.since
            if cfg.emit_exit:
                out.append(("state_exit", {"state": self.state, "dwell_ms": dwell}))
            if cfg.emit_dwell_bucket:
                out.append(("dwell_bucket", {"state": self.state, "bucket": bucket(dwell)}))
            if cfg.emit_transition:
                out.append(("transition", {"from": self.state, "to": value, "dwell_ms": dwell}))
            if cfg.min_dwell_ms > 0 and dwell < cfg.min_dwell_ms:
                out.append(("dwell_violation", {"state": self.state, "dwell_ms": dwell}))
            if (self.state, value) in self.illegal:
                out.append(("illegal_transition", {"from": self.state, "to": value}))
            if cfg.emit_enter:
                out.append(("state_enter", {"state": value}))
            self.state, self.since, self.guard_at = value, at_ms, at_ms
        elif cfg.dwell_guard_ms > 0 and at_ms - self.since >= cfg.dwell_guard_ms and at_ms - self.guard_at >= cfg.dwell_guard_ms:
            out.append(("dwell_guard", {"state": value, "dwell_ms": at_ms - self.since}))
            self.guard_at = at_ms
        return out


def bucket(ms: int) -> str:
    return "<1s" if ms < 1_000 else "1-5s" if ms < 5_000 else "5-30s" if ms < 30_000 else ">=30s"


def event_rows(keys: dict, found: Iterator[tuple[pd.Timestamp, str, dict]]) -> pd.DataFrame:
    rows = [(keys["tail_id"], keys["flight_id"], keys["parameter_name"], at, kind, {k: str(v) for k, v in values.items()}) for at, kind, values in found]
    return pd.DataFrame(rows, columns=["tail_id", "flight_id", "parameter_name", "timestamp_utc", "event_type_detected", "payload"])


def slope_events(features: DataFrame, cfg: ContinuousConfig = ContinuousConfig()) -> DataFrame:
    """The stateful events of numeric parameters, one task group a parameter's flight."""
    settings = asdict(cfg)
    wanted = [*FLIGHT, "timestamp_utc", "sample_index", "val", "delta", "delta_raw", "slope_sign", "switch_candidate"]
    has_oscillation = "oscillation_candidate" in features.columns

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        state = SlopeFold(ContinuousConfig(**settings))
        pdf = pdf.sort_values("sample_index")
        found = []
        for r in pdf.itertuples(index=False):
            step = 0.0 if pd.isna(r.delta_raw) else r.delta_raw
            for kind, values in state.step(int(r.sample_index), int(r.timestamp_utc.value // 1_000_000), r.val, r.delta, step, int(r.slope_sign), bool(r.switch_candidate), bool(r.oscillation_candidate) if has_oscillation else False):
                found.append((r.timestamp_utc, kind, values))
        return event_rows(dict(zip(FLIGHT, key, strict=True)), found)

    return features.select(*wanted, *(["oscillation_candidate"] if has_oscillation else [])).groupBy(*FLIGHT).applyInPandas(fold, EVENT_SCHEMA)


def state_events(telemetry: DataFrame, cfg: CategoricalConfig = CategoricalConfig(), tie: Sequence[str] = ("parameter_value",)) -> DataFrame:
    """The stateful events of categorical parameters."""
    settings = asdict(cfg)
    rows = telemetry.select(*dict.fromkeys([*FLIGHT, "timestamp_utc", *tie]), F.when(~is_missing("parameter_value"), F.col("parameter_value")).alias("state"))

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        state = StateFold(CategoricalConfig(**settings))
        found = []
        for r in pdf.sort_values(["timestamp_utc", *tie], na_position="first").itertuples(index=False):
            for kind, values in state.step(int(r.timestamp_utc.value // 1_000_000), None if pd.isna(r.state) else r.state):
                found.append((r.timestamp_utc, kind, values))
        return event_rows(dict(zip(FLIGHT, key, strict=True)), found)

    return rows.groupBy(*FLIGHT).applyInPandas(fold, EVENT_SCHEMA)


def transitions(telemetry: DataFrame, tie: Sequence[str] = ("parameter_value",)) -> DataFrame:
    """Changes from one state to the next without a gap between, with the dwell of the
    state left and its bucket: the fold's transitions as gaps and islands."""
    w = Window.partitionBy(*FLIGHT).orderBy("timestamp_utc", *tie)
    rows = telemetry.withColumn("state", F.when(~is_missing("parameter_value"), F.col("parameter_value")))
    rows = rows.withColumn("__before", F.lag("state").over(w)).withColumn("__n", F.row_number().over(w))
    rows = islands(rows, FLIGHT, ["__n"], (F.col("__n") == 1) | ~F.col("__before").eqNullSafe(F.col("state")), "run")
    runs = rows.groupBy(*FLIGHT, "run").agg(F.first("state").alias("state"), F.min("timestamp_utc").alias("since"))
    v = Window.partitionBy(*FLIGHT).orderBy("run")
    runs = runs.withColumn("from_state", F.lag("state").over(v)).withColumn("dwell_ms", millis("since") - F.lag(millis("since")).over(v))
    moved = runs.where("state IS NOT NULL AND from_state IS NOT NULL")
    return moved.select(*FLIGHT, F.col("since").alias("timestamp_utc"), "from_state", F.col("state").alias("to_state"), "dwell_ms", dwell_bucket("dwell_ms").alias("dwell_bucket"))


def drop_outs(telemetry: DataFrame, tie: Sequence[str] = ("parameter_value",)) -> DataFrame:
    """Samples at which a state is lost, and at which one comes after none."""
    w = Window.partitionBy(*FLIGHT).orderBy("timestamp_utc", *tie)
    state = F.when(~is_missing("parameter_value"), F.col("parameter_value"))
    rows = telemetry.withColumn("state", state).withColumn("before", F.lag("state").over(w))
    kind = F.when(F.col("state").isNull() & F.col("before").isNotNull(), "dropped").when(F.col("state").isNotNull() & F.col("before").isNull(), "state_enter")
    return rows.withColumn("event_type_detected", kind).where("event_type_detected IS NOT NULL").select(*FLIGHT, "timestamp_utc", "event_type_detected", F.coalesce("state", "before").alias("state"))


def sequence_ids(events: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """Number the events of a flight from 1."""
    return events.withColumn("event_seq_id", F.row_number().over(Window.partitionBy("tail_id", "flight_id").orderBy(*order)).cast("long"))


def canonical(events: DataFrame) -> DataFrame:
    """Events in their total order, with sequence ids and the columns of an artifact."""
    rows = events.withColumn("__payload", sorted_map_json("payload"))
    rows = sequence_ids(rows, ["timestamp_utc", "parameter_name", "event_type_detected", "__payload"])
    none = F.lit(None)
    return rows.select("tail_id", "flight_id", "event_seq_id", none.cast("long").alias("win_id"), "timestamp_utc", "parameter_name", "event_type_detected", none.cast("string").alias("anomaly_type_detected"), none.cast("double").alias("anomaly_score_detected"), "payload", F.to_date("timestamp_utc").alias("date_utc"))


def detect(telemetry: DataFrame, datatypes: DataFrame, continuous: ContinuousConfig = ContinuousConfig(), categorical: CategoricalConfig = CategoricalConfig()) -> DataFrame:
    """Route parameters to their detectors and put all events in one order."""
    numeric, discrete = channels(telemetry, datatypes)
    features = continuous_features(numeric, continuous)
    if continuous.emit_oscillation:
        features = oscillation_features(features, continuous)
    found = slope_events(features, continuous)
    if continuous.emit_threshold:
        found = found.unionByName(threshold_events(features, continuous).select(found.columns))
    return canonical(found.unionByName(state_events(discrete, categorical)))


def calibrate(telemetry: DataFrame, candidates: Sequence[ContinuousConfig], window_ms: int = 10_000, target_share: float = 0.75, target_events: float = 20.0) -> DataFrame:
    """One row a candidate: its events, share of slopes, events a window and score,
    the smaller the better."""
    spark = telemetry.sparkSession
    out = None
    for n, cfg in enumerate(candidates):
        features = continuous_features(telemetry, cfg)
        found = slope_events(features, cfg).select("tail_id", "flight_id", "timestamp_utc", "event_type_detected").unionByName(threshold_events(features, cfg).select("tail_id", "flight_id", "timestamp_utc", "event_type_detected"))
        per_window = found.groupBy("tail_id", "flight_id", F.floor(millis("timestamp_utc") / window_ms)).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type_detected").startswith("slope")).alias("slopes"))
        row = per_window.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("event_count"), F.coalesce(F.sum("slopes"), F.lit(0)).alias("slope_count"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("events_per_window"))
        share = F.coalesce(F.try_divide("slope_count", "event_count"), F.lit(0.0))
        row = row.select(F.lit(n).alias("candidate"), F.lit(cfg.alpha).alias("alpha"), F.lit(cfg.slope_threshold).alias("slope_threshold"), "event_count", share.alias("slope_share"), "events_per_window", (F.abs(share - target_share) + F.abs(F.col("events_per_window") - target_events) / target_events).alias("score"))
        out = row if out is None else out.unionByName(row)
    return out if out is not None else spark.createDataFrame([], "candidate int")
