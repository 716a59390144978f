import datetime as dt

from vaporline.operators import events as E

T0 = dt.datetime(2024, 1, 1)


def run(values, **cfg):
    fold, out = E.SlopeFold(E.ContinuousConfig(slope_threshold=0.5, **cfg)), []
    before = None
    for i, v in enumerate(values):
        d = 0.0 if before is None else v - before
        before = v
        sign = 1 if d > 0.5 else -1 if d < -0.5 else 0
        out += [(i, kind, p.get("emission")) for kind, p in fold.step(i + 1, i * 1000, v, d, d, sign, switch=abs(d) > 4)]
    return out


def test_runs_start_once_and_strengthen():
    assert run([0, 1, 2, 3, 4, 4, 3, 2]) == [(2, "slope_pos", "run_start"), (7, "slope_neg", "run_start")]
    assert run([0, 1, 2, 4, 5, 9]) == [(2, "slope_pos", "run_start"), (3, "slope_pos", "run_strengthen"), (5, "slope_pos", "run_strengthen")]


def test_switch_refractory_and_guard():
    assert [x[:2] for x in run([0, 9, 0, 9], emit_switch=True, switch_refractory=2, persistence=99)] == [(1, "switch"), (3, "switch")]
    assert [x[:2] for x in run([0, 3, 6, 9], drift_guard_delta=5.0, persistence=99)] == [(2, "drift_guard")]


def states(values, **cfg):
    fold = E.StateFold(E.CategoricalConfig(**cfg))
    return [(i, kind) for i, v in enumerate(values) for kind, _ in fold.step(i * 1000, v)]


def test_states():
    assert states(["a", None, "a", "b"]) == [(1, "dropped"), (3, "transition")]
    everything = dict(emit_enter=True, emit_exit=True, emit_dwell_bucket=True, min_dwell_ms=5000, illegal=(("a", "b"),))
    assert states(["a", "b"], **everything) == [(0, "state_enter"), (1, "state_exit"), (1, "dwell_bucket"), (1, "transition"), (1, "dwell_violation"), (1, "illegal_transition"), (1, "state_enter")]
    assert states(["a"] * 7, dwell_guard_ms=2000) == [(2, "dwell_guard"), (4, "dwell_guard"), (6, "dwell_guard")]
    assert states(["a", "b"], emit_transition=False) == []


def test_detection_routes_by_kind(spark):
    rows = [("T", "F", T0 + dt.timedelta(seconds=i), "N", str(float(i % 7))) for i in range(40)] + [("T", "F", T0 + dt.timedelta(seconds=i), "S", "on" if i % 10 < 5 else "off") for i in range(40)] + [("T", "F", T0, "X", "text")]
    frame = spark.createDataFrame(rows, "tail_id string, flight_id string, timestamp_utc timestamp, parameter_name string, parameter_value string")
    kinds = spark.createDataFrame([("N", "numeric"), ("S", "state"), ("X", "text")], "parameter_name string, parameter_datatype string")
    found = E.detect(frame, kinds, E.ContinuousConfig(slope_source="raw", slope_threshold=0.5), E.CategoricalConfig()).collect()
    assert {(r.parameter_name, r.event_type_detected) for r in found} == {("N", "slope_pos"), ("S", "transition")}
    assert [r.event_seq_id for r in sorted(found, key=lambda r: r.event_seq_id)] == list(range(1, len(found) + 1))
    assert E.detect(frame.limit(0), kinds).count() == 0


def test_calibration_ranks_candidates(spark):
    rows = [("T", "F", T0 + dt.timedelta(milliseconds=100 * i), "N", str(float(i % 7))) for i in range(60)]
    frame = spark.createDataFrame(rows, "tail_id string, flight_id string, timestamp_utc timestamp, parameter_name string, parameter_value string")
    got = E.calibrate(frame, [E.ContinuousConfig(slope_threshold=t) for t in (0.1, 100.0)]).orderBy("candidate").collect()
    assert got[0].event_count > got[1].event_count and all(r.score >= 0 for r in got)
