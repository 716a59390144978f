"""Queries against their SQL on events with odd keys and values."""

import duckdb
import pytest

from tests.test_queries import SMALL
from tests.test_shared_borders import assert_equals_sql


def events_with(tmp_path_factory, **columns):
    out = tmp_path_factory.mktemp("events")
    made = ", ".join(f"{made} AS {name}" for name, made in columns.items())
    duckdb.connect().execute(f"COPY (SELECT * REPLACE ({made}) FROM '{SMALL}/events.parquet') TO '{out}/events.parquet' (FORMAT parquet)")
    return str(out)


@pytest.fixture(scope="module")
def negative_keys(tmp_path_factory):
    """About half of the users have a key below 0, whose remainders SQL leaves negative."""
    return events_with(tmp_path_factory, user_id="user_id - (SELECT CAST(median(user_id) AS BIGINT) FROM '" + f"{SMALL}/events.parquet')")


@pytest.mark.parametrize("name", ["score_event_discordance", "subsystem_context", "event_type_statistics", "window_event_type_counts"])
def test_negative_keys_have_the_tails_and_kinds_of_the_sql(spark, negative_keys, name):
    assert_equals_sql(spark, name, negative_keys)


@pytest.fixture(scope="module")
def infinite_values(tmp_path_factory):
    return events_with(tmp_path_factory, value="CASE WHEN event_id % 7 = 0 THEN 'nan'::DOUBLE WHEN event_id % 11 = 0 THEN 'inf'::DOUBLE ELSE value END")


def test_one_window_has_no_spread_even_if_infinite(spark, infinite_values):
    assert_equals_sql(spark, "temporal_history_features", infinite_values)


@pytest.fixture(scope="module")
def null_values(tmp_path_factory):
    """Every third event has no value, and one parameter never has one."""
    return events_with(tmp_path_factory, value="CASE WHEN event_id % 3 > 0 AND event_type <> 'view' THEN value END")


def test_a_null_value_leaves_the_last_one(spark, null_values):
    assert_equals_sql(spark, "window_zoh_snapshot", null_values)
