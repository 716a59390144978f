"""Every registered query of the core against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from vaporline.plans import catalog

SMALL = "/root/testdata/sf0.001"
SOME = ["parameter_datatype_profile", "behavior_family_choice", "slope_run_events_full", "categorical_transitions", "adaptive_windows", "asof_snapshot_end", "lag_profile", "fused_graph", "calibrated_tail_pvalue", "localize_parameters_topk", "upsert_attribution"]


def plain(row):
    return tuple(None if v is None or isinstance(v, float) and math.isnan(v) else round(float(v), 5) if isinstance(v, (float, int)) and not isinstance(v, bool) else str(v) for v in row)


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("events", "orders"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    want = con.sql(catalog.ORACLES[name])
    columns = sorted(want.columns)
    rows = want.select(", ".join(f'"{c}"' for c in columns)).fetchall()
    got = catalog.QUERIES[name](spark, SMALL)
    assert sorted(got.columns) == columns
    assert sorted(map(str, map(plain, got.select(*columns).collect()))) == sorted(map(str, map(plain, rows)))


def test_every_sql_has_its_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES) and len(catalog.ORACLES) > 50


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
