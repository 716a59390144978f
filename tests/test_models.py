import datetime as dt
import itertools

import numpy as np
import pytest

from vaporline.operators import backbone, graphs, phases, scores

T0 = dt.datetime(2024, 1, 1)


def events(spark, rows, flight="F"):
    frame = [("T", flight, T0 + dt.timedelta(seconds=s), p, n) for n, (p, s) in enumerate(rows, 1)]
    return spark.createDataFrame(frame, "tail_id string, flight_id string, timestamp_utc timestamp, parameter_name string, event_seq_id long")


def every_pair(spark, names):
    return spark.createDataFrame([(a, b) for a in names for b in names if a != b], "source string, target string")


def test_nearest_prior_lags(spark):
    rows = [("A", 0), ("B", 0), ("A", 5), ("C", 6), ("B", 10), ("A", 11), ("C", 21), ("B", 21)]
    got = graphs.lag_profile(events(spark, rows), every_pair(spark, "ABC"), [graphs.LagBand("all", 0, 10_000, 1.0)]).collect()
    assert {(r.source, r.target): (r.lag_count, round(r.weight, 6), round(r.mean_lag_ms / 1000, 6)) for r in got} == {("A", "B"): (3, 0.3, 5.0), ("A", "C"): (2, 0.18, 5.5), ("B", "A"): (2, 0.466667, 3.0), ("B", "C"): (1, 0.133333, 6.0), ("C", "A"): (1, 0.166667, 5.0), ("C", "B"): (2, 0.533333, 2.0)}


def test_transitions_and_bands(spark):
    got = graphs.transition_graph(events(spark, [(p, n) for n, p in enumerate("AABCB")])).collect()
    assert {(r.source, r.target): r.weight for r in got} == {("A", "B"): 1.0, ("B", "C"): 1.0, ("C", "B"): 1.0}
    with pytest.raises(ValueError):
        graphs.checked_bands([graphs.LagBand("a", 0, 5, 1), graphs.LagBand("b", 4, 9, 1)])


def test_calibration(spark):
    severity = ["normal", "low", "high", "normal"] + ["normal"] * 16
    rows = [("T", "F", n, 1, float(20 - n), severity[n]) for n in range(20)] + [("T", "F", 30 + n, 2, 1.0, "high") for n in range(2)]
    got = {r.win_id: r for r in scores.calibrate(spark.createDataFrame(rows, "tail_id string, flight_id string, win_id long, phase_id int, score double, severity string"), min_warm=3).collect()}
    assert [round(got[n].p_value, 2) for n in range(4)] == [0.05, 0.10, 0.15, 0.20] and [got[n].emit_ready for n in range(4)] == [False, True, True, False]
    assert not got[30].warm and got[30].p_value is None and not got[30].emit_ready


def test_combination(spark):
    rows = spark.createDataFrame([(1, 2.0, 2.0), (2, 0.0, 0.0), (3, 0.0, 8.0)], "win_id long, regime_deviation double, coherence_break double")
    got = {r.win_id: (r.score, r.dominant_channel, r.severity) for r in scores.combine(rows).collect()}
    assert got == {1: (2.0, "regime_deviation", "low"), 2: (0.0, "regime_deviation", "normal"), 3: (8.0, "coherence_break", "high")}


def test_ridge_residuals_are_orthogonal_up_to_the_ridge(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(60, 2))
    y = x @ [0.5, -2.0] + 0.01 * r.normal(size=60)
    rows = [("T", "F", w, p, float(v)) for w in range(60) for p, v in (("a", x[w, 0]), ("b", x[w, 1]), ("c", y[w]))]
    values = spark.createDataFrame(rows, "tail_id string, flight_id string, win_id long, parameter_name string, value_scaled double")
    assert set(backbone.select_sensors(backbone.sensor_energy(values), 2)) <= {"a", "b", "c"}
    weights = {w.parameter_name: np.array(w.weights) for w in backbone.fit(values, ["a", "b"], ridge=1.0).collect()}
    want = np.linalg.solve(x.T @ x + np.eye(2), x.T @ y)
    assert np.allclose(weights["c"], want)
    errors = backbone.reconstruction_error(backbone.residuals(values, ["a", "b"], backbone.fit(values, ["a", "b"]))).count()
    assert errors == 60


def test_decode_is_the_cheapest_monotone_path():
    r = np.random.default_rng(1)
    for _ in range(60):
        w, k = r.integers(1, 7), r.integers(1, 4)
        cost = r.integers(0, 9, size=(w, k)).astype(float)
        price = lambda p: sum(cost[t, s] for t, s in enumerate(p)) + 1.5 * sum(b - a for a, b in zip(p, p[1:]))
        best = min(price(p) for p in itertools.product(range(k), repeat=int(w)) if all(0 <= b - a <= 1 for a, b in zip(p, p[1:])))
        got = phases.decode(cost, 1.5)
        assert price(got) == best and all(0 <= b - a <= 1 for a, b in zip(got, got[1:]))


def test_short_inner_runs_are_merged():
    path, cost = np.array([0, 0, 0, 1, 2, 2, 2, 3]), np.ones((8, 4))
    assert phases.merge_short(path, cost, 2).tolist() == [0, 0, 0, 0, 2, 2, 2, 3]
    cost[3, 0] = 5
    assert phases.merge_short(path, cost, 2).tolist() == [0, 0, 0, 2, 2, 2, 2, 3]


def test_components_and_agreement(spark):
    assert graphs.components(list("abcdef"), [("a", "b"), ("b", "c"), ("e", "d")]) == [["a", "b", "c"], ["d", "e"], ["f"]]
    same = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "a int, b string")
    assert all(abs(v - 1) < 1e-9 for v in graphs.agreement(same, "a", "b").values())


def test_hierarchy_needs_mutual_support(spark):
    rows = [("a", "b", 0.9), ("a", "c", 0.8), ("a", "d", 0.7), ("a", "e", 0.6)]
    fused = spark.createDataFrame([(u, v, 0.0, 0.0, 2 * w, w) for u, v, w in rows], "parameter_name_u string, parameter_name_v string, precision_weight double, event_weight double, lag_weight double, fused_weight double")
    got = {r.parameter_name: r.module_id for r in graphs.hierarchy(fused, list("abcdef"), k=2).collect()}
    assert got["a"] == got["b"] == got["c"] != got["d"] and len(set(got.values())) == 4


def test_limits_raise_instead_of_cutting(spark, monkeypatch):
    from vaporline.plans import queries_models, stages

    monkeypatch.setattr(graphs, "MOST_EDGES", 0)
    with pytest.raises(ValueError, match="edges"):
        queries_models.mutual_components(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(backbone, "MOST_PARAMETERS", 1)
    with pytest.raises(ValueError, match="parameters"):
        stages.fit_hierarchy({"datatypes": spark.createDataFrame([("a",), ("b",)], "parameter_name string")}, None)
