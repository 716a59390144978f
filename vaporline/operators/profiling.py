"""Profiles of parameters: datatype, scale, behaviour and detector settings.

Steps from sample to sample lie within a flight (``keys``), which also is what keeps
a parameter of many flights off a single task.

Quantiles are exact where ``exact`` is set (small data, compared queries) and sketches
of bounded size otherwise, which is what large tables need.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaporline.functions.exprs import as_number, clip01, is_missing, ratio, weighted
from vaporline.operators.relational import islands, top_k

FLIGHT = ("tail_id", "flight_id", "parameter_name")

# Fixed values of the behaviour model.
SIGNIFICANT = 0.05
CENTER_BAND, SOFT_BOUND, HARD_BOUND = 1.0, 2.5, 2.0
RAW_DIFF_MULTIPLIER, RAW_IQR_FLOOR = 2.0, 0.12
SCALED_RETURN_WEIGHT, RAW_RETURN_WEIGHT = 0.85, 0.15
RESET_JUMP = 1.5
NUMERIC_TYPES = ("numeric", "constant")
DISCRETE_TYPES = ("binary", "categorical", "high_cardinality")
FAMILIES = {
    "regulated": (
        {"center_occupancy": 0.28, "bound_occupancy": 0.20, "excursion_return_ratio": 0.26, "tracking_recovery_score": 0.10, "reversal_rate": 0.04},
        {"monotone_accumulation_score": 0.28, "saturation_rate": 0.12, "excursion_rate": 0.18, "lagged_response_score": 0.08},
        NUMERIC_TYPES,
    ),
    "tracking": (
        {"persistent_run_strength": 0.24, "excursion_rate": 0.20, "tracking_error_score": 0.24, "tracking_recovery_score": 0.08, "lagged_response_score": 0.34},
        {"center_occupancy": 0.08, "monotone_accumulation_score": 0.12, "saturation_rate": 0.06},
        NUMERIC_TYPES,
    ),
    "inertial": (
        {"persistent_run_strength": 0.20, "lagged_response_score": 0.52, "bound_occupancy": 0.02, "run_reinforcement_score": 0.12, "tracking_error_score": 0.02, "excursion_rate": 0.16},
        {"reversal_rate": 0.08, "tracking_recovery_score": 0.10, "monotone_accumulation_score": 0.10, "center_occupancy": 0.06, "oscillation_score": 0.08},
        NUMERIC_TYPES,
    ),
    "accumulative": (
        {"monotone_accumulation_score": 0.62, "persistent_run_strength": 0.18, "reset_drop_rate": 0.16, "run_reinforcement_score": 0.08, "lagged_response_score": 0.06},
        {"reversal_rate": 0.12, "excursion_return_ratio": 0.24, "center_occupancy": 0.14, "tracking_recovery_score": 0.08},
        NUMERIC_TYPES,
    ),
    "discrete_state": (
        {"discrete_low_cardinality_score": 0.25, "discrete_low_transition_score": 0.20, "discrete_dwell_score": 0.25, "dominant_state_ratio": 0.15, "transition_balance_score": 0.15},
        {"state_chatter_rate": 0.20},
        DISCRETE_TYPES,
    ),
}
LOW_SCORE, AMBIGUOUS_SCORE, AMBIGUOUS_MARGIN = 0.38, 0.55, 0.03
MIXED_BASE, MIXED_MARGIN, LOW_FLOOR, AMBIGUOUS_FLOOR = 0.85, 0.18, 0.55, 0.52


def quantile(column: Column | str, q: float, exact: bool) -> Column:
    return F.percentile(column, q) if exact else F.percentile_approx(column, q, 10_000).cast("double")


def sampling_intervals(telemetry: DataFrame, keys: Sequence[str] = FLIGHT, exact: bool = False) -> DataFrame:
    """Median positive interval and rate of each parameter. With the default keys
    intervals lie within a flight; pass ("parameter_name",) to span flights."""
    w = Window.partitionBy(*keys).orderBy("timestamp_utc")
    gap = telemetry.select("parameter_name", (F.unix_millis("timestamp_utc") - F.lag(F.unix_millis("timestamp_utc")).over(w)).alias("gap"))
    out = gap.where("gap > 0").groupBy("parameter_name").agg(quantile("gap", 0.5, exact).alias("median_interval_ms"))
    return out.withColumn("sampling_rate_hz", F.lit(1000.0) / F.col("median_interval_ms"))


def parameter_profile(telemetry: DataFrame, *, numeric_ratio: float = 0.8, most_categories: int = 200, exact: bool = False) -> DataFrame:
    """One row a parameter: counts, rates, moments, quantiles, interval and datatype."""
    value, missing = F.col("parameter_value"), is_missing("parameter_value")
    number = F.when(~missing, as_number("parameter_value"))
    rows = telemetry.select("parameter_name", missing.alias("missing"), F.when(~missing, value).alias("text"), number.alias("x"))
    stats = rows.groupBy("parameter_name").agg(
        F.count(F.lit(1)).alias("total_count"),
        F.count_if("missing").alias("missing_count"),
        F.count("x").alias("numeric_count"),
        (F.count_distinct("text") if exact else F.approx_count_distinct("text")).alias("distinct_value_count"),
        F.count_if(F.col("x").isin(0.0, 1.0)).alias("flag_count"),
        F.avg("x").alias("num_mean"),
        F.stddev_pop("x").alias("num_std"),
        F.min("x").alias("num_min"),
        F.max("x").alias("num_max"),
        *[quantile("x", q, exact).alias(n) for q, n in ((0.01, "num_q01"), (0.5, "num_q50"), (0.99, "num_q99"))],
    )
    numeric_rate = F.col("numeric_count") / F.greatest(F.col("total_count") - F.col("missing_count"), F.lit(1))
    distinct = F.col("distinct_value_count")
    flags_only = (F.col("flag_count") == F.col("numeric_count")) & (F.col("numeric_count") > 0)
    kind = (
        F.when(distinct <= 1, "constant")
        .when((F.col("numeric_rate") >= numeric_ratio) & ((distinct > 2) | ~flags_only), "numeric")
        .when(distinct <= most_categories, "categorical")
        .otherwise("high_cardinality")
    )
    return (
        stats.withColumn("missing_rate", F.col("missing_count") / F.col("total_count"))
        .withColumn("numeric_rate", numeric_rate)
        .withColumn("parameter_datatype", kind)
        .drop("flag_count", "numeric_count")
        .join(sampling_intervals(telemetry, exact=exact), "parameter_name", "left")
    )


def scaling_profile(telemetry: DataFrame, datatypes: DataFrame, *, exact: bool = False) -> DataFrame:
    """Quartiles and their range of numeric and constant parameters."""
    kept = F.broadcast(datatypes.where(F.col("parameter_datatype").isin(*NUMERIC_TYPES)).select("parameter_name"))
    rows = telemetry.join(kept, "parameter_name").select("parameter_name", F.when(~is_missing("parameter_value"), as_number("parameter_value")).alias("x")).where("x IS NOT NULL")
    out = rows.groupBy("parameter_name").agg(F.count(F.lit(1)).alias("support_count"), *[quantile("x", q, exact).alias(n) for q, n in ((0.25, "scaling_q25"), (0.5, "scaling_center"), (0.75, "scaling_q75"))])
    return out.withColumn("scaling_iqr", F.col("scaling_q75") - F.col("scaling_q25"))


def top_categories(telemetry: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent values of each parameter, ties by value."""
    counts = telemetry.where(~is_missing("parameter_value")).groupBy("parameter_name", "parameter_value").agg(F.count(F.lit(1)).alias("n"))
    return top_k(counts, ["parameter_name"], [F.col("n").desc(), F.col("parameter_value")], k)


def discrete_behavior(telemetry: DataFrame, keys: Sequence[str] = FLIGHT, order: Sequence[str] = ("timestamp_utc",)) -> DataFrame:
    """Transitions, dwell, dominance and chatter of each parameter's states."""
    w = Window.partitionBy(*keys).orderBy(*order)
    v = F.col("parameter_value")
    rows = telemetry.where(~is_missing("parameter_value")).select("parameter_name", v, F.lag(v).over(w).alias("before"), F.lag(v, 2).over(w).alias("earlier"))
    moved = v != F.col("before")
    base = rows.groupBy("parameter_name").agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.count_distinct("parameter_value").cast("double").alias("states"),
        F.count_if(moved).cast("double").alias("moves"),
        F.count_if(moved & (v == F.col("earlier"))).cast("double").alias("chatter"),
    )
    most = rows.groupBy("parameter_name", "parameter_value").count().groupBy("parameter_name").agg(F.max("count").cast("double").alias("most"))
    n, moves = F.col("n"), F.col("moves")
    rate = moves / F.greatest(n - 1, F.lit(1.0))
    dwell = n / (moves + 1)
    return base.join(most, "parameter_name").select(
        "parameter_name",
        rate.alias("transition_rate"),
        dwell.alias("mean_dwell"),
        (F.col("most") / n).alias("dominant_state_ratio"),
        (F.col("chatter") / F.greatest(n - 2, F.lit(1.0))).alias("state_chatter_rate"),
        clip01(1 - F.least(F.col("states") - 1, F.lit(9.0)) / 9).alias("discrete_low_cardinality_score"),
        clip01(1 - rate).alias("discrete_low_transition_score"),
        (F.least(dwell, F.lit(10.0)) / 10).alias("discrete_dwell_score"),
        clip01(1 - F.abs(rate - 0.18) / 0.18).alias("transition_balance_score"),
    )


def numeric_behavior(telemetry: DataFrame, scaling: DataFrame, *, keys: Sequence[str] = FLIGHT, order: Sequence[str] = ("timestamp_utc",), exact: bool = False) -> DataFrame:
    """Runs, reversals, occupancy, excursions, accumulation and response of each
    numeric parameter, over its samples scaled by median and quartile range."""
    w = Window.partitionBy(*keys).orderBy(*order)
    x = F.col("x")
    rows = telemetry.join(F.broadcast(scaling), "parameter_name").withColumn("x", F.when(~is_missing("parameter_value"), as_number("parameter_value"))).where("x IS NOT NULL")
    rows = rows.withColumn("s", (x - F.col("scaling_center")) / F.greatest(F.abs("scaling_iqr"), F.lit(1e-6))).withColumn("off", F.abs(x - F.col("scaling_center")))
    rows = rows.select(*keys, *order, "x", "s", "off", "scaling_iqr", *[F.lag(c).over(w).alias(f"p{c}") for c in ("x", "s", "off")])
    rows = rows.withColumn("d", F.col("s") - F.col("ps")).withColumn("pd", F.lag("d").over(w))
    rows = rows.withColumn("sign", F.when(F.abs("d") >= SIGNIFICANT, F.signum("d")).otherwise(0.0)).withColumn("psign", F.lag("sign").over(w))
    rows = islands(rows, list(keys), list(order), (F.col("sign") != 0) & ((F.col("psign").isNull()) | (F.col("psign") != F.col("sign"))), "run")
    geometry = rows.groupBy("parameter_name").agg(F.greatest(F.coalesce(quantile(F.abs(x - F.col("px")), 0.75, exact), F.lit(0.0)) * RAW_DIFF_MULTIPLIER, F.max(F.abs("scaling_iqr")) * RAW_IQR_FLOOR, F.lit(1e-6)).alias("unit"))
    runs = rows.where("sign <> 0").groupBy(*keys, "run").agg(F.count(F.lit(1)).cast("double").alias("len"))
    runs = runs.groupBy("parameter_name").agg(F.max("len").alias("longest"), F.avg("len").alias("mean_len"), F.count_if(F.expr("len >= 2")).cast("double").alias("lasting"))
    center = F.lit(CENTER_BAND)
    far, pfar = F.abs("s"), F.abs("ps")
    rows = rows.join(F.broadcast(geometry), "parameter_name")
    wide = F.col("unit") * CENTER_BAND
    base = rows.groupBy("parameter_name").agg(
        F.count("d").cast("double").alias("nd"),
        F.sum(F.abs(x - F.col("px"))).alias("gross"),
        F.avg(F.col("d") * F.col("d")).alias("diff_energy"),
        F.avg(F.col("s") * F.col("s")).alias("level_energy"),
        F.count_if(F.expr("d > 0")).cast("double").alias("up"),
        F.count_if(F.expr("d < 0")).cast("double").alias("down"),
        F.count_if(F.expr(f"d < -{RESET_JUMP}")).cast("double").alias("drops"),
        F.count_if(F.expr(f"d > {RESET_JUMP}")).cast("double").alias("jumps"),
        F.count_if(F.col("d") * F.col("pd") < 0).cast("double").alias("flips"),
        F.corr("px", "x").alias("lag1"),
        F.min_by("x", F.struct(*order)).alias("first_x"),
        F.max_by("x", F.struct(*order)).alias("last_x"),
        F.avg((far <= center).cast("double")).alias("center_occupancy"),
        F.avg((far > center).cast("double")).alias("excursion_rate"),
        F.avg((far <= SOFT_BOUND).cast("double")).alias("bound_occupancy"),
        F.avg((far >= HARD_BOUND).cast("double")).alias("saturation_rate"),
        F.avg((F.col("off") > wide).cast("double")).alias("raw_excursion_rate"),
        F.avg((F.abs(x - F.col("px")) > F.col("unit") / 2).cast("double")).alias("raw_motion"),
        F.count_if(pfar > center).cast("double").alias("out"),
        F.count_if((pfar > center) & (far <= pfar) & (far <= center)).cast("double").alias("back"),
        F.count_if(F.col("poff") > wide).cast("double").alias("raw_out"),
        F.count_if((F.col("poff") > wide) & (F.col("off") <= F.col("poff")) & (F.col("off") <= wide)).cast("double").alias("raw_back"),
    )
    one = F.lit(1.0)
    f = base.join(runs, "parameter_name", "left").withColumns(
        {
            "persistent_run_strength": F.coalesce(F.col("longest"), F.lit(0.0)) / F.greatest(F.col("nd"), one),
            "run_reinforcement_score": clip01(F.coalesce(F.col("lasting"), F.lit(0.0)) / F.greatest(F.coalesce(F.col("mean_len"), one), one)),
            "reversal_rate": F.col("flips") / F.greatest(F.col("nd") - 1, one),
            "excursion_return_ratio": SCALED_RETURN_WEIGHT * F.col("back") / F.greatest(F.col("out"), one) + RAW_RETURN_WEIGHT * F.col("raw_back") / F.greatest(F.col("raw_out"), one),
            "net_share": F.abs(F.col("last_x") - F.col("first_x")) / F.greatest(F.coalesce(F.col("gross"), F.lit(0.0)), F.lit(1e-6)),
            "reset_drop_rate": F.when(F.col("up") >= F.col("down"), F.col("drops")).otherwise(F.col("jumps")) / F.greatest(F.col("nd"), one),
            "lag1": F.coalesce(F.col("lag1"), F.lit(0.0)),
        }
    )
    c = {n: F.col(n) for n in f.columns}
    return f.select(
        "parameter_name",
        "persistent_run_strength",
        "run_reinforcement_score",
        "reversal_rate",
        F.col("reversal_rate").alias("sign_flip_rate"),
        "center_occupancy",
        "excursion_rate",
        "excursion_return_ratio",
        "bound_occupancy",
        "saturation_rate",
        clip01(0.5 * F.greatest(c["up"], c["down"]) / F.greatest(c["nd"], one) + 0.35 * c["net_share"] + 0.15 * (1 - c["reversal_rate"])).alias("monotone_accumulation_score"),
        "reset_drop_rate",
        clip01(0.55 * c["reversal_rate"] + 0.25 * c["bound_occupancy"] + 0.2 * (1 - c["net_share"])).alias("oscillation_score"),
        clip01(
            0.1 * c["bound_occupancy"]
            + 0.05 * (1 - c["saturation_rate"])
            + 0.1 * clip01(2 * c["excursion_rate"])
            + 0.15 * clip01(1.5 * c["raw_excursion_rate"])
            + 0.3 * c["persistent_run_strength"]
            + 0.1 * (1 - c["center_occupancy"])
            + 0.3 * c["raw_motion"]
        ).alias("tracking_error_score"),
        clip01(0.65 * c["excursion_return_ratio"] + 0.35 * c["excursion_rate"]).alias("tracking_recovery_score"),
        clip01(
            0.35 * clip01((c["lag1"] + 1) / 2)
            + 0.25 * (1 - F.least(F.coalesce(c["diff_energy"], F.lit(0.0)) / F.greatest(c["level_energy"], F.lit(1e-6)), one))
            + 0.12 * clip01(1.5 * c["excursion_rate"])
            + 0.1 * c["persistent_run_strength"]
            + 0.05 * (1 - c["center_occupancy"])
            + 0.08 * clip01(1.5 * c["raw_excursion_rate"])
            + 0.05 * c["raw_motion"]
        ).alias("lagged_response_score"),
    )


def family_scores(primitives: DataFrame) -> DataFrame:
    """The primitives with a score for each behaviour family."""
    out = primitives
    for family, (plus, minus, kinds) in FAMILIES.items():
        have = lambda weights: {k: v for k, v in weights.items() if k in primitives.columns}
        score = clip01(weighted(have(plus)) - weighted(have(minus)))
        out = out.withColumn(f"{family}_score", F.when(F.col("parameter_datatype").isin(*kinds), score).otherwise(0.0))
    return out


def family_choice(scored: DataFrame) -> DataFrame:
    """The best family, ties to the later name, or mixed_unknown; and a confidence."""
    ranked = F.sort_array(F.array(*[F.struct(F.col(f"{f}_score").alias("score"), F.lit(f).alias("family")) for f in FAMILIES]), asc=False)
    rows = scored.withColumn("top", ranked[0]["score"]).withColumn("family", ranked[0]["family"]).withColumn("margin", ranked[0]["score"] - ranked[1]["score"])
    low, unclear = F.col("top") < LOW_SCORE, (F.col("top") < AMBIGUOUS_SCORE) & (F.col("margin") < AMBIGUOUS_MARGIN)
    mixed = clip01(F.greatest(MIXED_BASE - F.col("top"), MIXED_MARGIN - F.col("margin")))
    mixed = F.when(low, F.greatest(mixed, F.lit(LOW_FLOOR))).when(unclear, F.greatest(mixed, F.lit(AMBIGUOUS_FLOOR))).otherwise(mixed)
    return (
        rows.withColumn("mixed_unknown_score", mixed)
        .withColumn("behavior_family", F.when(low | unclear, "mixed_unknown").otherwise(F.col("family")))
        .withColumn("behavior_confidence", clip01(F.when(low | unclear, F.greatest("mixed_unknown_score", "top")).otherwise(F.col("top"))))
        .drop("top", "family", "margin")
    )


ARCHETYPES = {
    # slope source, quantile, scale factor, threshold factor, persistence offset, re-emission offset, warm-up offset (fixed values)
    "responsive_low_scale": ("raw", None, 0.65, 0.65, 0, 0.0, -2),
    "repeatable_low_scale": ("raw", None, 0.7, 0.75, 0, 0.0, 0),
    "meso_drift": ("ema", 0.75, 0.8, 0.75, 0, 0.0, -1),
    "strong_drift": ("ema", 0.9, 1.5, 1.15, 1, 0.25, 1),
    "chattery": ("ema", 0.9, 1.75, 1.25, 2, 0.5, None),
}


def event_profile(telemetry: DataFrame, *, keys: Sequence[str] = FLIGHT, order: Sequence[str] = ("timestamp_utc",), slope_abs_threshold: float = 1.0, threshold_min: float = 1e-6, threshold_scale: float = 0.35, quantile_default: float = 0.75, persistence: int = 2, reemit: float = 1.5, warmup: int = 4, exact: bool = False) -> DataFrame:
    """Motion statistics of each numeric parameter, an archetype, and the detector
    settings recommended for it."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = telemetry.select(*keys, *order, F.when(~is_missing("parameter_value"), as_number("parameter_value")).alias("x")).where("x IS NOT NULL")
    rows = rows.withColumn("before", F.lag("x").over(w)).withColumn("behind", F.lead("x").over(w)).withColumn("d", F.col("x") - F.col("before")).withColumn("sign", F.coalesce(F.signum("d"), F.lit(0.0)))
    rows = rows.withColumn("psign", F.lag("sign").over(w))
    flip = (F.col("sign") * F.col("psign")) < 0
    peak = ((F.col("x") > F.col("before")) & (F.col("x") >= F.col("behind"))) | ((F.col("x") < F.col("before")) & (F.col("x") <= F.col("behind")))
    rows = islands(rows, list(keys), list(order), (F.col("sign") != 0) & (F.col("psign").isNull() | (F.col("psign") != F.col("sign"))), "run")
    lengths = rows.where("sign <> 0").groupBy(*keys, "run").agg(F.count(F.lit(1)).cast("double").alias("len"))
    # The quantile counts a run once for each of its samples.
    weighted_runs = lengths.groupBy("parameter_name").agg(F.expr("percentile(len, 0.9D, CAST(len AS BIGINT))").alias("run_length_p90"))
    base = rows.groupBy("parameter_name").agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.coalesce(F.sum(F.abs("d")), F.lit(0.0)).alias("total_abs_change"),
        F.abs(F.coalesce(F.sum("d"), F.lit(0.0))).alias("net_change_abs"),
        *[quantile(F.abs("d"), q, exact).alias(n) for q, n in ((0.5, "delta_abs_q50"), (0.75, "delta_abs_q75"), (0.9, "delta_abs_q90"))],
        F.avg(F.coalesce(flip, F.lit(False)).cast("double")).alias("sign_flip_rate"),
        F.avg(F.coalesce(peak, F.lit(False)).cast("double")).alias("local_extrema_rate"),
    ).join(weighted_runs, "parameter_name", "left")
    # One row a parameter: the ranking has a small input.
    base = base.withColumn("delta_scale_rank", F.percent_rank().over(Window.orderBy(F.col("delta_abs_q90").asc_nulls_last())))
    base = base.withColumns(
        {
            "run_length_p90": F.coalesce("run_length_p90", F.lit(0.0)),
            "directionality": F.least(F.lit(1.0), ratio(F.col("net_change_abs"), F.col("total_abs_change"), 0.0)),
            "reversal": F.greatest("sign_flip_rate", "local_extrema_rate"),
            "q90": F.coalesce("delta_abs_q90", F.lit(0.0)),
        }
    ).withColumn("run_score", F.least(F.lit(1.0), F.col("run_length_p90") / 8))
    base = base.withColumns(
        {
            "repeatability_score": F.least(F.lit(1.0), (1 - F.col("delta_scale_rank")) * F.col("reversal") * (0.35 + 0.65 * F.col("run_score"))),
            "drift_score": F.least(F.lit(1.0), (0.4 + 0.6 * F.col("delta_scale_rank")) * F.col("directionality") * (1 - 0.7 * F.col("reversal"))),
            "chatter_score": F.least(F.lit(1.0), F.col("reversal") * (1 - 0.7 * F.col("run_score")) * (1 - 0.5 * F.col("directionality"))),
        }
    ).withColumn("smoothness_score", F.greatest(F.lit(0.0), 1 - F.greatest("repeatability_score", "drift_score", "chatter_score")))
    q90 = F.col("q90")
    archetype = (
        F.when((q90 < 1) & (F.col("reversal") < 0.55) & (F.col("repeatability_score") < 0.25) & (F.col("run_length_p90") <= 120), "responsive_low_scale")
        .when(q90 < 1, "repeatable_low_scale")
        .when((q90 >= 5) & (q90 < 25) & (F.col("delta_scale_rank") >= 0.85), "meso_drift")
        .when((q90 >= 25) | ((q90 >= 5) & (F.col("sign_flip_rate") <= 0.15) & (F.col("local_extrema_rate") <= 0.15)), "strong_drift")
        .when((F.col("sign_flip_rate") >= 0.4) | (F.col("local_extrema_rate") >= 0.4), "chattery")
        .otherwise("smooth_midscale")
    )
    base = base.withColumn("recommended_archetype", archetype)

    def pick(index: int, default) -> Column:
        out = F.lit(default)
        for name, values in ARCHETYPES.items():
            if values[index] is not None:
                out = F.when(F.col("recommended_archetype") == name, F.lit(values[index])).otherwise(out)
        return out

    warm = pick(6, 0)
    return base.select(
        "parameter_name",
        "sample_count",
        "delta_abs_q50",
        "delta_abs_q75",
        "delta_abs_q90",
        "total_abs_change",
        "net_change_abs",
        "directionality",
        "run_length_p90",
        "delta_scale_rank",
        F.when(F.coalesce("delta_abs_q50", F.lit(0.0)) > threshold_min, F.col("delta_abs_q90") / F.greatest(F.col("delta_abs_q50"), F.lit(threshold_min))).otherwise(1.0).alias("motion_scale_ratio"),
        "sign_flip_rate",
        "local_extrema_rate",
        "repeatability_score",
        "drift_score",
        "chatter_score",
        "smoothness_score",
        "recommended_archetype",
        pick(0, "ema").alias("recommended_source"),
        pick(1, quantile_default).alias("recommended_quantile"),
        F.greatest(F.lit(threshold_min), threshold_scale * pick(2, 1.0)).alias("recommended_scale"),
        F.greatest(F.lit(threshold_min), F.coalesce("delta_abs_q90", "delta_abs_q75", "delta_abs_q50", F.lit(0.0)) * slope_abs_threshold * pick(3, 1.0)).alias("recommended_threshold"),
        F.greatest(F.lit(1), persistence + pick(4, 1)).alias("recommended_persistence"),
        F.greatest(F.lit(1.0), reemit + pick(5, 0.25)).alias("recommended_reemit_ratio"),
        F.greatest(F.lit(1), warmup + warm).alias("recommended_warmup"),
    )
