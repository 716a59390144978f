"""All named queries over the driver's tables and the SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vaporline.plans import queries_models, queries_profiles, queries_windows  # noqa: F401  they register
from vaporline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The datatype profile of all parameters of the smallest tables."""
    return QUERIES["parameter_datatype_profile"](spark, sf_dir)
