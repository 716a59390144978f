"""The event detectors over an unbounded stream.

The folds are those of ``vaporline.operators.events``; their state is kept for each
parameter of each flight, and a flight that is silent for long is let go. Samples that
come later than the watermark are dropped by it; within a micro-batch they are put in
time order.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import asdict
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vaporline.operators.events import EVENT_SCHEMA, CategoricalConfig, ContinuousConfig, SlopeFold, StateFold, event_rows
from vaporline.operators.profiling import FLIGHT

STATE = "fold binary"


def _stateful(rows: DataFrame, make: Callable, step: Callable, idle_ms: int) -> DataFrame:
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        fold = pickle.loads(state.get[0]) if state.exists else make()
        pdf = pd.concat(list(batches)).sort_values("timestamp_utc", kind="stable")
        found = [(r.timestamp_utc, kind, values) for r in pdf.itertuples(index=False) for kind, values in step(fold, r)]
        state.update((pickle.dumps(fold),))
        state.setTimeoutDuration(idle_ms)
        yield event_rows(dict(zip(FLIGHT, key, strict=True)), found)

    return rows.groupBy(*FLIGHT).applyInPandasWithState(run, EVENT_SCHEMA, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def stream_slope_events(telemetry: DataFrame, cfg: ContinuousConfig, *, late: str = "1 minute", idle_ms: int = 3_600_000) -> DataFrame:
    """Slope events from a stream of telemetry, with steps from raw values and a fixed
    threshold: what needs no look at the whole flight."""
    rows = telemetry.withWatermark("timestamp_utc", late).select(*FLIGHT, "timestamp_utc", F.col("parameter_value").try_cast("double").alias("val")).where("val IS NOT NULL AND NOT isnan(val)")
    return _stateful(rows, partial(_SlopeCarry, asdict(cfg)), _slope_step, idle_ms)


class _SlopeCarry:
    """What a slope stream carries from batch to batch."""

    def __init__(self, settings: dict):
        self.fold, self.last, self.n, self.limit = SlopeFold(ContinuousConfig(**settings)), None, 0, settings["slope_threshold"]


def _slope_step(carried: _SlopeCarry, r) -> list:
    delta = 0.0 if carried.last is None else r.val - carried.last
    carried.last, carried.n = r.val, carried.n + 1
    sign = 1 if delta > carried.limit else -1 if delta < -carried.limit else 0
    return carried.fold.step(carried.n, int(r.timestamp_utc.value // 1_000_000), r.val, delta, delta, sign, False)


def stream_state_events(telemetry: DataFrame, cfg: CategoricalConfig, *, late: str = "1 minute", idle_ms: int = 3_600_000) -> DataFrame:
    """State events from a stream of telemetry."""
    from vaporline.functions.exprs import is_missing

    settings = asdict(cfg)
    rows = telemetry.withWatermark("timestamp_utc", late).select(*FLIGHT, "timestamp_utc", F.when(~is_missing("parameter_value"), F.col("parameter_value")).alias("state"))
    return _stateful(rows, lambda: StateFold(CategoricalConfig(**settings)), _state_step, idle_ms)


def _state_step(fold: StateFold, r) -> list:
    return fold.step(int(r.timestamp_utc.value // 1_000_000), None if pd.isna(r.state) else r.state)


def event_rates(telemetry: DataFrame, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Samples a window and parameter, late ones within the watermark included."""
    return telemetry.withWatermark("timestamp_utc", late).groupBy(F.window("timestamp_utc", window), "tail_id", "parameter_name").agg(F.count(F.lit(1)).alias("samples"))
