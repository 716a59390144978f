"""Queries against their SQL where events fall on borders of windows or on one instant."""

import duckdb
import pytest

from tests.test_queries import SMALL, plain
from vaporline.plans import catalog


def events_with(tmp_path_factory, ts, copies=1):
    out = tmp_path_factory.mktemp("events")
    shifted = f"SELECT event_id + i * 1000 AS event_id, {ts} AS ts, user_id + i * 30 AS user_id, event_type, value, props FROM '{SMALL}/events.parquet', range({copies}) r(i)"
    duckdb.connect().execute(f"COPY ({shifted}) TO '{out}/events.parquet' (FORMAT parquet)")
    return str(out)


@pytest.fixture(scope="module")
def full_hours(tmp_path_factory):
    """Every third event lies on a full hour, where one window ends and another may start."""
    return events_with(tmp_path_factory, "CASE WHEN event_id % 3 = 0 THEN date_trunc('hour', ts) ELSE ts END")


def assert_equals_sql(spark, name, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf_dir}/events.parquet'")
    want = con.sql(catalog.ORACLES[name])
    columns = sorted(want.columns)
    rows = want.select(", ".join(f'"{c}"' for c in columns)).fetchall()
    got = catalog.QUERIES[name](spark, sf_dir).select(*columns).collect()
    assert len(rows) > 0 and sorted(map(str, map(plain, got))) == sorted(map(str, map(plain, rows)))


def test_global_score_counts_an_event_on_the_border_in_both_windows(spark, full_hours):
    assert_equals_sql(spark, "global_score_and_severity", full_hours)


def test_phase_separation_counts_an_event_on_the_border_once(spark, full_hours):
    assert_equals_sql(spark, "phase_separation", full_hours)


def test_discordance_counts_an_event_on_the_border_in_both_windows(spark, full_hours):
    assert_equals_sql(spark, "score_event_discordance", full_hours)


def test_subsystems_count_an_event_on_the_border_in_both_windows(spark, full_hours):
    assert_equals_sql(spark, "subsystem_context", full_hours)


def test_history_counts_an_event_on_the_border_in_both_windows(spark, full_hours):
    assert_equals_sql(spark, "temporal_history_features", full_hours)


@pytest.fixture(scope="module")
def same_instants(tmp_path_factory):
    """Three copies of every event at one instant: windows close and start within it."""
    return events_with(tmp_path_factory, "ts", copies=3)


def test_an_event_belongs_to_the_last_window_that_starts_by_its_instant(spark, same_instants):
    assert_equals_sql(spark, "window_event_assignment", same_instants)


def test_types_are_counted_in_the_window_of_the_look_up(spark, same_instants):
    assert_equals_sql(spark, "window_event_type_counts", same_instants)


def test_last_values_are_those_of_the_window_of_the_look_up(spark, same_instants):
    assert_equals_sql(spark, "window_zoh_snapshot", same_instants)


def test_type_statistics_count_the_windows_of_the_look_up(spark, same_instants):
    assert_equals_sql(spark, "event_type_statistics", same_instants)
