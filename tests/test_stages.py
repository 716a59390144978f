import datetime as dt
import json
import math

import pytest

from vaporline.operators.events import ContinuousConfig
from vaporline.operators.graphs import LagBand
from vaporline.operators.windows import WindowPolicy
from vaporline.plans import stages
from vaporline.streaming import detectors

T0 = dt.datetime(2024, 1, 1)


def telemetry(spark, seconds=240):
    rows = []
    for i in range(seconds):
        at = T0 + dt.timedelta(seconds=i)
        rows += [("T", "F", at, "TEMP", str(20 + 8 * math.sin(i / 9) + (15 if i > 200 else 0))), ("T", "F", at, "PRESS", str(100 + 20 * math.cos(i / 7))), ("T", "F", at, "PUMP", "OFF" if i % 30 < 10 else "ON")]
    return spark.createDataFrame(rows, "tail_id string, flight_id string, timestamp timestamp, parameter_name string, parameter_value string")


def test_all_stages_and_a_replay(spark, tmp_path):
    settings = stages.Settings(continuous=ContinuousConfig(slope_source="raw", slope_threshold=1.0), policy=WindowPolicy(10_000, 6, 50), sensors=2, min_warm=2, bands=(LagBand("quick", 0, 5_000, 1.0), LagBand("slow", 5_000, 30_000, 0.5)))
    root = f"{tmp_path}/run"
    paths = stages.run(spark, telemetry(spark), root, settings)
    counts = {n: spark.read.parquet(p).count() for n, p in paths.items()}
    assert all(counts[n] for n in ("telemetry", "datatypes", "events", "windows", "values", "backbone", "fused", "hierarchy", "phases", "scores", "calibrated"))
    assert counts["scores"] == counts["phases"] <= counts["windows"]
    again = stages.run(spark, None, root, settings, start="scores")
    assert set(again) == {"scores", "calibrated", "localized", "raw_evidence", "event_evidence"}
    manifest = json.loads(spark.read.text(f"{root}/manifest").first()[0])
    assert manifest["stages"] == ["scores", "calibrate", "attribute"]
    with pytest.raises(FileNotFoundError, match="events"):
        stages.run(spark, None, f"{tmp_path}/nothing", settings, start="windows")
    with pytest.raises(ValueError):
        stages.between("scores", "events")


def test_streamed_states_equal_the_batch(spark, tmp_path):
    from vaporline.operators.events import CategoricalConfig, state_events

    rows = telemetry(spark, 90).withColumnRenamed("timestamp", "timestamp_utc").where("parameter_name = 'PUMP'")
    source = f"{tmp_path}/in"
    rows.where("second(timestamp_utc) < 30").coalesce(1).write.parquet(source)
    rows.where("second(timestamp_utc) >= 30").coalesce(1).write.mode("append").parquet(source)
    cfg = CategoricalConfig()
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(source)
    query = detectors.stream_state_events(stream, cfg).writeStream.format("memory").queryName("streamed_states").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    pick = lambda df: sorted((r.timestamp_utc, r.event_type_detected, sorted(r.payload.items())) for r in df.collect())
    assert pick(spark.table("streamed_states")) == pick(state_events(rows, cfg)) and spark.table("streamed_states").count() > 0
