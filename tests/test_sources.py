import datetime as dt

import pytest
from pyspark.sql import functions as F

from vaporline.sources import tables, telemetry


def test_normalize_trims_casts_and_drops(spark):
    at = dt.datetime(2024, 1, 2, 3, 4, 5)
    rows = [("T", "F", at, "P", " 1.5 ", " m ", 7), ("T", "F", at, "P", "bad", None, 8), ("T", "F", at, "P", "nan", None, 9), ("T", None, at, "P", "1", None, 10), ("T", "F", None, "P", "1", None, 11)]
    out = telemetry.normalize(spark.createDataFrame(rows, "tail_id string, flight_id string, timestamp timestamp, parameter_name string, parameter_value string, unit string, extra int"))
    got = sorted((r.extra, r.val, r.parameter_value, r.unit) for r in out.collect())
    assert got == [(7, 1.5, "1.5", "m"), (8, None, "bad", None), (9, None, "nan", None)]
    assert out.schema["meta"].dataType.simpleString() == "map<string,string>" and out.first().date_utc == at.date()
    with pytest.raises(ValueError, match="parameter_value"):
        telemetry.normalize(out.drop("parameter_value"))


def test_tables_round_trip_empty_and_upsert(spark, tmp_path):
    path = f"{tmp_path}/t"
    first = spark.createDataFrame([(1, "a", "x"), (None, "b", "x"), (3, "c", "y")], "k long, v string, p string")
    tables.upsert_table(first, path, ["k"], partition_by=["p"])
    tables.upsert_table(spark.createDataFrame([(None, "B", "y"), (4, "d", "y")], "k long, v string, p string"), path, ["k"], partition_by=["p"])
    assert sorted((r.k or 0, r.v) for r in spark.read.parquet(path).collect()) == [(0, "B"), (1, "a"), (3, "c"), (4, "d")]
    with pytest.raises(ValueError):
        tables.upserted(first, first, [])
    tables.write_table(first.limit(0), f"{tmp_path}/e", "overwrite", partition_by=["p"])
    assert spark.read.parquet(f"{tmp_path}/e").columns == ["k", "v", "p"]


def test_artifacts_check_their_schema(spark, tmp_path):
    a = tables.Artifact(f"{tmp_path}/a", "k long, v string")
    a.replace(spark.range(3).select(F.col("id").alias("k"), F.lit("x").alias("v")))
    assert a.read(spark).count() == 3 and a.manifest(spark)["rows"] == 3
    with pytest.raises(ValueError, match="schema differs"):
        a.write(spark.range(1))
    assert tables.as_schema("k long").fieldNames() == ["k"]
