"""The backbone: a few sensors from which all others are reconstructed linearly."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vaporline.operators.features import WINDOW

#: Weights of the event prior (fixed values).
PRIOR = {"abs_impulse": 1.0, "switch_count": 0.75, "threshold_count": 0.5, "drift_guard_count": 0.25, "slope_reinforcements": 0.25}
#: Parameters that a model may have; more is an error, not a cut.
MOST_PARAMETERS = 50_000


def sensor_energy(values: DataFrame, summary: DataFrame | None = None, alpha: float = 0.35) -> DataFrame:
    """Energy of each parameter, its event prior, and the score that selects sensors."""
    x = F.col("value_scaled")
    out = values.where(x.isNotNull()).groupBy("parameter_name").agg(F.sum(x * x).alias("energy"), F.count(F.lit(1)).alias("support_count"))
    prior = F.lit(0.0)
    if summary is not None:
        totals = summary.withColumn("threshold_count", F.col("threshold_count") + F.col("oscillation_count")).groupBy("parameter_name").agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in PRIOR])
        out = out.join(totals, "parameter_name", "left")
        for c, weight in PRIOR.items():
            prior = prior + weight * F.log1p(F.coalesce(F.col(c), F.lit(0)).cast("double"))
    out = out.withColumn("event_prior", prior).withColumn("log_energy", F.log1p("energy"))
    every = Window.partitionBy()  # one row a parameter
    z = lambda c: F.coalesce(F.try_divide(F.col(c) - F.avg(c).over(every), F.stddev_pop(c).over(every)), F.lit(0.0))
    return out.withColumn("selection_score", z("log_energy") + alpha * z("event_prior")).select("parameter_name", "energy", "support_count", "event_prior", "selection_score")


def select_sensors(energy: DataFrame, k: int = 8) -> list[str]:
    """The k best parameters, by score, energy, name."""
    return [r.parameter_name for r in energy.orderBy(F.col("selection_score").desc(), F.col("energy").desc(), "parameter_name").limit(k).collect()]


def dense(values: DataFrame, sensors: Sequence[str]) -> DataFrame:
    """One row a window with columns x_0, x_1, ... of these sensors, 0 if missing."""
    return values.groupBy(*WINDOW).agg(*[F.coalesce(F.max(F.when(F.col("parameter_name") == s, F.col("value_scaled"))), F.lit(0.0)).alias(f"x_{i}") for i, s in enumerate(sensors)])


def gram(x: DataFrame, c: int) -> DataFrame:
    """Sums of products of the sensors, the upper triangle, in one row."""
    return x.agg(*[F.coalesce(F.sum(F.col(f"x_{i}") * F.col(f"x_{j}")), F.lit(0.0)).alias(f"g_{i}_{j}") for i in range(c) for j in range(i, c)])


def cross_terms(values: DataFrame, x: DataFrame, c: int) -> DataFrame:
    """Sums of products of the sensors with each parameter."""
    rows = values.where("value_scaled IS NOT NULL").join(x, list(WINDOW))
    return rows.groupBy("parameter_name").agg(*[F.sum(F.col(f"x_{i}") * F.col("value_scaled")).alias(f"h_{i}") for i in range(c)])


def fit(values: DataFrame, sensors: Sequence[str], ridge: float = 1.0) -> DataFrame:
    """(parameter_name, weights): B = (G + ridge I)^-1 H, solved on the driver from
    sums alone, for at most MOST_PARAMETERS parameters."""
    c = len(sensors)
    x = dense(values, sensors)
    row = gram(x, c).first().asDict()
    g = np.array([[row[f"g_{min(i, j)}_{max(i, j)}"] for j in range(c)] for i in range(c)])
    terms = cross_terms(values, x, c).orderBy("parameter_name").limit(MOST_PARAMETERS + 1).collect()
    if len(terms) > MOST_PARAMETERS:
        raise ValueError(f"more than {MOST_PARAMETERS} parameters")
    h = np.array([[t[f"h_{i}"] for t in terms] for i in range(c)]).reshape(c, len(terms))
    b = np.linalg.solve(g + ridge * np.eye(c), h)
    return values.sparkSession.createDataFrame([(t.parameter_name, [float(v) for v in b[:, n]]) for n, t in enumerate(terms)], "parameter_name string, weights array<double>")


def residuals(values: DataFrame, sensors: Sequence[str], weights: DataFrame) -> DataFrame:
    """Each value with its reconstruction and residual."""
    x = dense(values, sensors).select(*WINDOW, F.array(*[f"x_{i}" for i in range(len(sensors))]).alias("x"))
    rows = values.where("value_scaled IS NOT NULL").join(x, list(WINDOW)).join(F.broadcast(weights), "parameter_name")
    hat = F.aggregate(F.zip_with("x", "weights", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return rows.withColumn("reconstructed", hat).withColumn("residual", F.col("value_scaled") - F.col("reconstructed")).drop("x", "weights")


def reconstruction_error(residual_rows: DataFrame) -> DataFrame:
    return residual_rows.groupBy(*WINDOW).agg(F.sqrt(F.sum(F.col("residual") * F.col("residual"))).alias("reconstruction_error"))
