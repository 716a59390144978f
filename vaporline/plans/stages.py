"""The batch pipeline: named stages, their artifacts, and replay of a part of them."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaporline.operators import attribution, backbone, features, graphs, phases, profiling, scores
from vaporline.operators import events as ev
from vaporline.operators import windows as wd
from vaporline.sources import telemetry as raw
from vaporline.sources.tables import Artifact, path_exists

KEYS = ["tail_id", "flight_id", "win_id"]


@dataclass(frozen=True)
class Settings:
    """Everything a run can be told; the defaults are the engine's."""

    continuous: ev.ContinuousConfig = ev.ContinuousConfig(alpha=0.2, slope_threshold=1.0)
    categorical: ev.CategoricalConfig = ev.CategoricalConfig()
    policy: wd.WindowPolicy = wd.WindowPolicy()
    sensors: int = 8
    bands: tuple[graphs.LagBand, ...] = graphs.BANDS
    phase: phases.PhaseConfig = phases.PhaseConfig()
    min_warm: int = 100
    top_parameters: int = 5


@dataclass(frozen=True)
class Stage:
    """A step from artifacts to artifacts."""

    name: str
    inputs: tuple[str, ...]
    outputs: tuple[str, ...]
    run: Callable[[Mapping[str, DataFrame], Settings], Mapping[str, DataFrame]]


def ingest(a, s):
    return {"telemetry": raw.normalize(a["raw"])}


def profile(a, s):
    kinds = profiling.parameter_profile(a["telemetry"])
    return {"datatypes": kinds, "scaling": profiling.scaling_profile(a["telemetry"], kinds)}


def extract_events(a, s):
    return {"events": ev.detect(a["telemetry"], a["datatypes"], s.continuous, s.categorical)}


def make_windows(a, s):
    return {"windows": wd.adaptive_windows(a["events"], s.policy), "event_windows": wd.assigned_events(a["events"], s.policy)}


def make_features(a, s):
    numeric = features.scaled(features.snapshots(a["telemetry"], a["windows"], "end_ms"), a["scaling"])
    return {"values": numeric, "drift": features.drift(numeric, a["windows"])}


def fit_backbone(a, s):
    summary = features.event_summary(a["events"].drop("win_id").join(a["event_windows"], ["tail_id", "flight_id", "event_seq_id"]))
    energy = backbone.sensor_energy(a["values"], summary)
    chosen = backbone.select_sensors(energy, s.sensors)
    weights = backbone.fit(a["values"], chosen)
    return {"backbone": weights, "sensors": energy.where(F.col("parameter_name").isin(*chosen)), "residuals": backbone.residuals(a["values"], chosen, weights)}


def chosen_sensors(a) -> list[str]:
    return [r.parameter_name for r in a["sensors"].orderBy(F.col("selection_score").desc(), F.col("energy").desc(), "parameter_name").collect()]


def build_graphs(a, s):
    joined = a["events"].drop("win_id").join(a["event_windows"], ["tail_id", "flight_id", "event_seq_id"])
    event, moves = graphs.event_graph(joined), graphs.transition_graph(a["events"])
    lag = graphs.lag_graph(graphs.lag_profile(a["events"], graphs.candidate_pairs(event, moves), s.bands), s.bands)
    names = chosen_sensors(a)
    return {"fused": graphs.fuse(graphs.precision_graph(backbone.dense(a["values"], names), names), event, lag), "lag_edges": lag}


def fit_hierarchy(a, s):
    names = [r.parameter_name for r in a["datatypes"].select("parameter_name").orderBy("parameter_name").limit(backbone.MOST_PARAMETERS + 1).collect()]
    if len(names) > backbone.MOST_PARAMETERS:
        raise ValueError(f"more than {backbone.MOST_PARAMETERS} parameters")
    return {"hierarchy": graphs.hierarchy(a["fused"], names)}


def fit_phases(a, s):
    names = chosen_sensors(a)
    rows = phases.phase_windows(phases.observations(backbone.dense(a["values"], names), len(names), a["drift"]), s.phase)
    return {"phases": phases.with_states(rows)}


def score_windows(a, s):
    durations = a["windows"].select(*KEYS, "duration_ms")
    joined = a["events"].drop("win_id").join(a["event_windows"], ["tail_id", "flight_id", "event_seq_id"])
    metrics = scores.window_event_metrics(joined, durations).join(a["phases"].select(*KEYS, "phase_id", "distance"), KEYS)
    errors = metrics.select(*KEYS, "phase_id", "distance").join(backbone.reconstruction_error(a["residuals"]), KEYS, "left").fillna(0.0, ["reconstruction_error"])
    channels = scores.mad_deviation(errors, ["distance", "reconstruction_error"]).withColumnRenamed("distance", "regime_deviation")
    channels = channels.join(scores.event_discordance(metrics).drop("phase_id"), KEYS)
    h = F.broadcast(a["hierarchy"].select("parameter_name", "subsystem_id"))
    residual = a["residuals"].join(h, "parameter_name").groupBy(*KEYS, "subsystem_id").agg(F.sum(F.col("residual") * F.col("residual")).alias("score"))
    counts = joined.join(h, "parameter_name").groupBy(*KEYS, "subsystem_id").agg(F.count(F.lit(1)).alias("count"))
    return {"scores": scores.combine(channels.join(scores.coherence_break(residual, counts), KEYS, "left").fillna(0.0, ["coherence_break"]))}


def calibrate(a, s):
    return {"calibrated": scores.calibrate(a["scores"], min_warm=s.min_warm)}


def attribute(a, s):
    h = a["hierarchy"]
    sizes = h.groupBy("module_id").agg(F.count(F.lit(1)).cast("double").alias("module_size"))
    joined = a["events"].drop("win_id").join(a["event_windows"], ["tail_id", "flight_id", "event_seq_id"])
    counts = joined.groupBy(*KEYS, "parameter_name").agg(F.count(F.lit(1)).alias("events"))
    energy = a["residuals"].groupBy(*KEYS, "parameter_name").agg(F.sum(F.col("residual") * F.col("residual")).alias("energy"))
    per = energy.join(counts, [*KEYS, "parameter_name"], "full_outer").fillna(0.0, ["energy"]).fillna(0, ["events"])
    per = scores.shares(scores.shares(per, KEYS, "energy", "residual_share"), KEYS, "events", "event_share")
    emitted = a["calibrated"].where("emit_ready")
    evidence = per.join(emitted.drop("phase_id"), KEYS).join(F.broadcast(h), "parameter_name").join(F.broadcast(sizes), "module_id")
    localized = attribution.localize(evidence, s.top_parameters)
    bounds = a["windows"].join(emitted.select(*KEYS), KEYS)
    return {"localized": localized, "raw_evidence": attribution.raw_rows(a["telemetry"], bounds, s.policy.max_ms).select(*KEYS, "parameter_name", "timestamp_utc", "parameter_value"), "event_evidence": attribution.shouldered_events(a["events"].drop("win_id"), bounds, h, s.policy.max_ms).select(*KEYS, "event_seq_id", "module_id")}


STAGES = (
    Stage("ingest", ("raw",), ("telemetry",), ingest),
    Stage("profile", ("telemetry",), ("datatypes", "scaling"), profile),
    Stage("events", ("telemetry", "datatypes"), ("events",), extract_events),
    Stage("windows", ("events",), ("windows", "event_windows"), make_windows),
    Stage("features", ("telemetry", "windows", "scaling"), ("values", "drift"), make_features),
    Stage("backbone", ("values", "events", "event_windows"), ("backbone", "sensors", "residuals"), fit_backbone),
    Stage("graphs", ("events", "event_windows", "values", "sensors"), ("fused", "lag_edges"), build_graphs),
    Stage("hierarchy", ("fused", "datatypes"), ("hierarchy",), fit_hierarchy),
    Stage("phases", ("values", "drift", "sensors"), ("phases",), fit_phases),
    Stage("scores", ("windows", "events", "event_windows", "phases", "residuals", "hierarchy"), ("scores",), score_windows),
    Stage("calibrate", ("scores",), ("calibrated",), calibrate),
    Stage("attribute", ("hierarchy", "events", "event_windows", "residuals", "calibrated", "windows", "telemetry"), ("localized", "raw_evidence", "event_evidence"), attribute),
)


def between(start: str | None = None, end: str | None = None, stages: Sequence[Stage] = STAGES) -> list[Stage]:
    """The stages from one name to another, both included."""
    names = [s.name for s in stages]
    for n in (start, end):
        if n is not None and n not in names:
            raise ValueError(f"no stage {n}; there are {', '.join(names)}")
    out = list(stages[names.index(start) if start else 0 : names.index(end) + 1 if end else None])
    if not out:
        raise ValueError(f"{start} comes after {end}")
    return out


def run(spark: SparkSession, source: DataFrame | None, root: str, settings: Settings = Settings(), *, start: str | None = None, end: str | None = None) -> dict[str, str]:
    """Run stages, each artifact written once and read again by what needs it; gives the
    artifacts' paths. A replay from a later stage needs the earlier artifacts in place."""
    todo = between(start, end)
    made: set[str] = set()
    for stage in todo:
        for name in stage.inputs:
            if name not in made and not (name == "raw" and source is not None) and not path_exists(spark, f"{root}/{name}"):
                raise FileNotFoundError(f"stage {stage.name} needs {name}, which isn't in {root}")
        made |= set(stage.outputs)
    paths = {}
    for stage in todo:
        inputs = {n: source if n == "raw" and source is not None else spark.read.parquet(f"{root}/{n}") for n in stage.inputs}
        for name, df in stage.run(inputs, settings).items():
            Artifact(f"{root}/{name}", replayable_from=(stage.name,)).replace(df)
            paths[name] = f"{root}/{name}"
    manifest = json.dumps({"stages": [s.name for s in todo], "artifacts": paths})
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/manifest")
    return paths
