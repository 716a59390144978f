"""Queries over raw telemetry: normal form, profiles, behaviour, detector features."""

from __future__ import annotations

from pyspark.sql import functions as F

from vaporline.functions import exprs
from vaporline.operators import events as ev
from vaporline.operators import profiling
from vaporline.operators.relational import median_mad
from vaporline.plans.registry import query, sql
from vaporline.sources import adapters, tables, telemetry

FLIGHT = ["tail_id", "flight_id", "parameter_name"]


def numeric(spark, sf_dir):
    return adapters.numeric_telemetry(spark, sf_dir)


def states(spark, sf_dir):
    return adapters.categorical_telemetry(spark, sf_dir)


def both(spark, sf_dir):
    return numeric(spark, sf_dir).unionByName(states(spark, sf_dir))


def profile(spark, sf_dir):
    return profiling.parameter_profile(both(spark, sf_dir), exact=True)


def scaling(spark, sf_dir):
    kinds = spark.createDataFrame([(p, "numeric") for p in ("click", "view", "purchase", "signup", "error")], "parameter_name string, parameter_datatype string")
    return profiling.scaling_profile(numeric(spark, sf_dir), kinds, exact=True)


@query(sql("SELECT tail_id, flight_id, parameter_name, event_id, x AS val, CAST(CAST(ts AS DATE) AS VARCHAR) AS date_utc, ts AS timestamp_utc FROM t", "t"))
def raw_normalize(spark, sf_dir):
    rows = numeric(spark, sf_dir).withColumn("parameter_value", F.concat(F.lit("  "), "parameter_value", F.lit(" ")))
    return telemetry.normalize(rows).select("tail_id", "flight_id", "parameter_name", "event_id", "val", F.col("date_utc").cast("string").alias("date_utc"), "timestamp_utc")


PROFILE_SQL = sql(
    """
SELECT parameter_name, total_count, missing_count, missing_count / total_count AS missing_rate_, round(missing_count / total_count, 6) AS missing_rate,
  round(numeric_count / greatest(total_count - missing_count, 1), 6) AS numeric_rate, distinct_value_count,
  round(num_mean, 6) AS num_mean, round(num_std, 6) AS num_std, num_min, num_max, round(num_q01, 6) AS num_q01, round(num_q50, 6) AS num_q50, round(num_q99, 6) AS num_q99,
  round(median_interval_ms, 6) AS median_interval_ms, round(1000.0 / median_interval_ms, 6) AS sampling_rate_hz,
  CASE WHEN distinct_value_count <= 1 THEN 'constant'
       WHEN numeric_count / greatest(total_count - missing_count, 1) >= 0.8 AND (distinct_value_count > 2 OR NOT (flags = numeric_count AND numeric_count > 0)) THEN 'numeric'
       WHEN distinct_value_count <= 200 THEN 'categorical' ELSE 'high_cardinality' END AS parameter_datatype
FROM stats LEFT JOIN gaps USING (parameter_name)
""".replace("missing_count / total_count AS missing_rate_, ", ""),
    "t",
    "c",
    """u AS (
  SELECT tail_id, flight_id, ts, ms, parameter_name, x, CASE WHEN x IS NULL THEN NULL ELSE CAST(x AS VARCHAR) END AS said FROM t
  UNION ALL SELECT tail_id, flight_id, ts, ms, parameter_name, NULL, state FROM c)""",
    """stats AS (
  SELECT parameter_name, count(*) AS total_count, count(*) FILTER (said IS NULL) AS missing_count, count(x) AS numeric_count, count(DISTINCT said) AS distinct_value_count,
    count(*) FILTER (x IN (0, 1)) AS flags, avg(x) AS num_mean, stddev_pop(x) AS num_std, min(x) AS num_min, max(x) AS num_max,
    quantile_cont(x, 0.01) AS num_q01, quantile_cont(x, 0.5) AS num_q50, quantile_cont(x, 0.99) AS num_q99
  FROM u GROUP BY ALL)""",
    """steps AS (SELECT parameter_name, ms - lag(ms) OVER (PARTITION BY tail_id, flight_id, parameter_name ORDER BY ts) AS gap FROM u)""",
    """gaps AS (SELECT parameter_name, quantile_cont(gap, 0.5) AS median_interval_ms FROM steps WHERE gap > 0 GROUP BY ALL)""",
)


@query(PROFILE_SQL)
def parameter_datatype_profile(spark, sf_dir):
    return profile(spark, sf_dir)


@query(sql("SELECT parameter_name, round(avg(CAST(missing AS INT)), 6) AS missing_rate, count(x) AS numeric_count FROM t GROUP BY ALL", "t"))
def missing_and_numeric_rate(spark, sf_dir):
    rows = numeric(spark, sf_dir)
    return rows.groupBy("parameter_name").agg(F.avg(exprs.is_missing("parameter_value").cast("int")).alias("missing_rate"), F.count(exprs.as_number("parameter_value")).alias("numeric_count"))


@query(
    sql(
        "SELECT parameter_name, round(quantile_cont(gap, 0.5), 6) AS median_interval_ms, round(1000.0 / quantile_cont(gap, 0.5), 6) AS sampling_rate_hz FROM steps WHERE gap > 0 GROUP BY ALL",
        "t",
        "steps AS (SELECT parameter_name, ms - lag(ms) OVER (PARTITION BY tail_id, flight_id, parameter_name ORDER BY ts) AS gap FROM t)",
    )
)
def sampling_interval_median(spark, sf_dir):
    return profiling.sampling_intervals(numeric(spark, sf_dir), exact=True)


@query(sql("SELECT parameter_name, support_count, round(scaling_q25, 6) AS scaling_q25, round(scaling_center, 6) AS scaling_center, round(scaling_q75, 6) AS scaling_q75, round(scaling_iqr, 6) AS scaling_iqr FROM s", "t", "s"))
def continuous_scaling_profile(spark, sf_dir):
    return scaling(spark, sf_dir)


@query(
    sql(
        "SELECT * FROM (SELECT parameter_name, state AS parameter_value, n, CAST(row_number() OVER (PARTITION BY parameter_name ORDER BY n DESC, state) AS INTEGER) AS rank FROM k) WHERE rank <= 3",
        "c",
        "k AS (SELECT parameter_name, state, count(*) AS n FROM c WHERE state IS NOT NULL GROUP BY ALL)",
    )
)
def topk_categorical_values(spark, sf_dir):
    return profiling.top_categories(states(spark, sf_dir), 3)


DISCRETE = (
    "c",
    "o AS (SELECT parameter_name, state, lag(state) OVER v AS before, lag(state, 2) OVER v AS earlier FROM c WHERE state IS NOT NULL WINDOW v AS (PARTITION BY tail_id, flight_id, parameter_name ORDER BY ts))",
    "m AS (SELECT parameter_name, max(n) AS most FROM (SELECT parameter_name, state, count(*) AS n FROM o GROUP BY ALL) GROUP BY ALL)",
    """b AS (SELECT parameter_name, CAST(count(*) AS DOUBLE) AS n, count(DISTINCT state) AS states, CAST(count(*) FILTER (state <> before) AS DOUBLE) AS moves,
    CAST(count(*) FILTER (state <> before AND state = earlier) AS DOUBLE) AS chatter FROM o GROUP BY ALL)""",
    """d AS (SELECT parameter_name, moves / greatest(n - 1, 1) AS transition_rate, n / (moves + 1) AS mean_dwell, most / n AS dominant_state_ratio, chatter / greatest(n - 2, 1) AS state_chatter_rate,
    greatest(0, least(1, 1 - least(states - 1, 9) / 9.0)) AS discrete_low_cardinality_score, greatest(0, least(1, 1 - moves / greatest(n - 1, 1))) AS discrete_low_transition_score,
    least(n / (moves + 1), 10) / 10 AS discrete_dwell_score, greatest(0, least(1, 1 - abs(moves / greatest(n - 1, 1) - 0.18) / 0.18)) AS transition_balance_score
  FROM b JOIN m USING (parameter_name))""",
)


@query(
    sql(
        """SELECT parameter_name, round(transition_rate, 6) AS transition_rate, round(mean_dwell, 6) AS mean_dwell, round(dominant_state_ratio, 6) AS dominant_state_ratio, round(state_chatter_rate, 6) AS state_chatter_rate,
  round(discrete_low_cardinality_score, 6) AS discrete_low_cardinality_score, round(discrete_low_transition_score, 6) AS discrete_low_transition_score, round(discrete_dwell_score, 6) AS discrete_dwell_score, round(transition_balance_score, 6) AS transition_balance_score FROM d""",
        *DISCRETE,
    )
)
def behavior_primitives_discrete(spark, sf_dir):
    return profiling.discrete_behavior(states(spark, sf_dir))


NUMERIC = (
    "t",
    "s",
    """n0 AS (SELECT t.*, (x - scaling_center) / greatest(abs(scaling_iqr), 1e-6) AS sc, abs(x - scaling_center) AS off, scaling_iqr FROM t JOIN s USING (parameter_name) WHERE x IS NOT NULL)""",
    """n1 AS (SELECT *, lag(x) OVER v AS px, lag(sc) OVER v AS ps, lag(off) OVER v AS poff, sc - lag(sc) OVER v AS d FROM n0 WINDOW v AS (PARTITION BY tail_id, flight_id, parameter_name ORDER BY ts))""",
    """n2 AS (SELECT *, lag(d) OVER v AS pd, CASE WHEN abs(d) >= 0.05 THEN sign(d) ELSE 0 END AS sg FROM n1 WINDOW v AS (PARTITION BY tail_id, flight_id, parameter_name ORDER BY ts))""",
    """n3 AS (SELECT *, lag(sg) OVER v AS psg FROM n2 WINDOW v AS (PARTITION BY tail_id, flight_id, parameter_name ORDER BY ts))""",
    """n4 AS (SELECT *, sum(CASE WHEN sg <> 0 AND (psg IS NULL OR psg <> sg) THEN 1 ELSE 0 END) OVER v AS run FROM n3 WINDOW v AS (PARTITION BY tail_id, flight_id, parameter_name ORDER BY ts ROWS UNBOUNDED PRECEDING))""",
    """geo AS (SELECT parameter_name, greatest(2 * quantile_cont(abs(x - px), 0.75), 0.12 * max(abs(scaling_iqr)), 1e-6) AS unit FROM n4 GROUP BY ALL)""",
    """runs AS (SELECT parameter_name, max(len) AS longest, avg(len) AS mean_len, count(*) FILTER (len >= 2) AS lasting FROM (SELECT parameter_name, tail_id, flight_id, run, count(*) AS len FROM n4 WHERE sg <> 0 GROUP BY ALL) GROUP BY ALL)""",
    """base AS (
  SELECT parameter_name, CAST(count(d) AS DOUBLE) AS nd, sum(abs(x - px)) AS gross, avg(d * d) AS de, avg(sc * sc) AS le, count(*) FILTER (d > 0) AS up, count(*) FILTER (d < 0) AS down,
    count(*) FILTER (d < -1.5) AS drops, count(*) FILTER (d > 1.5) AS jumps, count(*) FILTER (d * pd < 0) AS flips, coalesce(corr(px, x), 0) AS lag1,
    arg_min(x, ts) AS fx, arg_max(x, ts) AS lx,
    avg(CAST(abs(sc) <= 1 AS INT)) AS center, avg(CAST(abs(sc) > 1 AS INT)) AS excursion, avg(CAST(abs(sc) <= 2.5 AS INT)) AS bound, avg(CAST(abs(sc) >= 2 AS INT)) AS saturation,
    avg(CAST(off > unit AS INT)) AS rawexc, avg(CASE WHEN abs(x - px) > unit / 2 THEN 1 WHEN px IS NULL THEN NULL ELSE 0 END) AS motion,
    count(*) FILTER (abs(ps) > 1) AS outs, count(*) FILTER (abs(ps) > 1 AND abs(sc) <= abs(ps) AND abs(sc) <= 1) AS backs,
    count(*) FILTER (poff > unit) AS routs, count(*) FILTER (poff > unit AND off <= poff AND off <= unit) AS rbacks
  FROM n4 JOIN geo USING (parameter_name) GROUP BY ALL)""",
    """f AS (SELECT *, longest / greatest(nd, 1) AS prs, greatest(0, least(1, lasting / greatest(mean_len, 1))) AS rein, flips / greatest(nd - 1, 1) AS rev,
    0.85 * backs / greatest(outs, 1) + 0.15 * rbacks / greatest(routs, 1) AS ret, abs(lx - fx) / greatest(gross, 1e-6) AS net, (CASE WHEN up >= down THEN drops ELSE jumps END) / greatest(nd, 1) AS reset FROM base JOIN runs USING (parameter_name))""",
    """nb AS (SELECT parameter_name, prs AS persistent_run_strength, rein AS run_reinforcement_score, rev AS reversal_rate, rev AS sign_flip_rate, center AS center_occupancy, excursion AS excursion_rate, ret AS excursion_return_ratio, bound AS bound_occupancy, saturation AS saturation_rate,
    greatest(0, least(1, 0.5 * greatest(up, down) / greatest(nd, 1) + 0.35 * net + 0.15 * (1 - rev))) AS monotone_accumulation_score, reset AS reset_drop_rate,
    greatest(0, least(1, 0.55 * rev + 0.25 * bound + 0.2 * (1 - net))) AS oscillation_score,
    greatest(0, least(1, 0.1 * bound + 0.05 * (1 - saturation) + 0.1 * least(1, 2 * excursion) + 0.15 * least(1, 1.5 * rawexc) + 0.3 * prs + 0.1 * (1 - center) + 0.3 * motion)) AS tracking_error_score,
    greatest(0, least(1, 0.65 * ret + 0.35 * excursion)) AS tracking_recovery_score,
    greatest(0, least(1, 0.35 * least(1, greatest(0, (lag1 + 1) / 2)) + 0.25 * (1 - least(de / greatest(le, 1e-6), 1)) + 0.12 * least(1, 1.5 * excursion) + 0.1 * prs + 0.05 * (1 - center) + 0.08 * least(1, 1.5 * rawexc) + 0.05 * motion)) AS lagged_response_score FROM f)""",
)
NUMERIC_COLUMNS = "persistent_run_strength run_reinforcement_score reversal_rate sign_flip_rate center_occupancy excursion_rate excursion_return_ratio bound_occupancy saturation_rate monotone_accumulation_score reset_drop_rate oscillation_score tracking_error_score tracking_recovery_score lagged_response_score".split()


@query(sql("SELECT parameter_name, " + ", ".join(f"round({c}, 6) AS {c}" for c in NUMERIC_COLUMNS) + " FROM nb", *NUMERIC))
def behavior_primitives_numeric(spark, sf_dir):
    return numeric_behavior(spark, sf_dir)


def numeric_behavior(spark, sf_dir):
    return profiling.numeric_behavior(numeric(spark, sf_dir), scaling(spark, sf_dir), exact=True)


def family_sql() -> str:
    """The families' scores and choice, for numeric parameters."""
    score = lambda family: "greatest(0, least(1, " + " + ".join(f"{w} * {c}" for c, w in profiling.FAMILIES[family][0].items()) + "".join(f" - {w} * {c}" for c, w in profiling.FAMILIES[family][1].items()) + "))"
    names = [f for f in profiling.FAMILIES if f != "discrete_state"]
    return sql(
        """SELECT parameter_name, round(regulated_score, 6) AS regulated_score, round(tracking_score, 6) AS tracking_score, round(inertial_score, 6) AS inertial_score, round(accumulative_score, 6) AS accumulative_score,
  CASE WHEN low OR unclear THEN 'mixed_unknown' ELSE family END AS behavior_family,
  round(greatest(0, least(1, CASE WHEN low OR unclear THEN greatest(mixed, top) ELSE top END)), 6) AS behavior_confidence FROM m""",
        *NUMERIC,
        f"fs AS (SELECT parameter_name, {', '.join(f'{score(f)} AS {f}_score' for f in names)} FROM nb)",
        "long AS (SELECT parameter_name, family, score, row_number() OVER (PARTITION BY parameter_name ORDER BY score DESC, family DESC) AS n FROM ("
        + " UNION ALL ".join(f"SELECT parameter_name, '{f}' AS family, {f}_score AS score FROM fs" for f in names)
        + " UNION ALL SELECT parameter_name, 'discrete_state', 0.0 FROM fs))",
        "tops AS (SELECT a.parameter_name, a.family, a.score AS top, a.score - b.score AS margin FROM long a JOIN long b ON a.parameter_name = b.parameter_name AND a.n = 1 AND b.n = 2)",
        "p AS (SELECT *, top < 0.38 AS low, top < 0.55 AND margin < 0.03 AS unclear, greatest(0, least(1, greatest(0.85 - top, 0.18 - margin))) AS raw FROM tops)",
        "m AS (SELECT *, CASE WHEN low THEN greatest(raw, 0.55) WHEN unclear THEN greatest(raw, 0.52) ELSE raw END AS mixed FROM p JOIN fs USING (parameter_name))",
    )


@query(family_sql())
def behavior_family_choice(spark, sf_dir):
    rows = numeric_behavior(spark, sf_dir).withColumn("parameter_datatype", F.lit("numeric"))
    return profiling.family_choice(profiling.family_scores(rows)).select("parameter_name", "regulated_score", "tracking_score", "inertial_score", "accumulative_score", "behavior_family", "behavior_confidence")


EVENT_PROFILE = (
    "t",
    "p0 AS (SELECT parameter_name, tail_id, flight_id, ts, x, lag(x) OVER v AS before, lead(x) OVER v AS behind, x - lag(x) OVER v AS d FROM t WHERE x IS NOT NULL WINDOW v AS (PARTITION BY tail_id, flight_id, parameter_name ORDER BY ts))",
    "p1 AS (SELECT *, coalesce(sign(d), 0) AS sg FROM p0)",
    "p2 AS (SELECT *, lag(sg) OVER v AS psg FROM p1 WINDOW v AS (PARTITION BY tail_id, flight_id, parameter_name ORDER BY ts))",
    "p3 AS (SELECT *, sum(CASE WHEN sg <> 0 AND (psg IS NULL OR psg <> sg) THEN 1 ELSE 0 END) OVER (PARTITION BY tail_id, flight_id, parameter_name ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM p2)",
    "rl AS (SELECT parameter_name, quantile_cont(len, 0.9) AS run_length_p90 FROM (SELECT parameter_name, count(*) OVER (PARTITION BY parameter_name, tail_id, flight_id, run) AS len FROM p3 WHERE sg <> 0) GROUP BY ALL)",
    """b AS (SELECT parameter_name, count(*) AS sample_count, sum(abs(d)) AS total, abs(sum(d)) AS net, quantile_cont(abs(d), 0.5) AS q50, quantile_cont(abs(d), 0.75) AS q75, quantile_cont(abs(d), 0.9) AS q90,
    avg(CASE WHEN sg * psg < 0 THEN 1.0 ELSE 0 END) AS flip, avg(CASE WHEN (x > before AND x >= behind) OR (x < before AND x <= behind) THEN 1.0 ELSE 0 END) AS extrema FROM p3 GROUP BY ALL)""",
    """k AS (SELECT *, percent_rank() OVER (ORDER BY q90) AS rank, least(1, CASE WHEN total > 0 THEN net / total ELSE 0 END) AS dir, greatest(flip, extrema) AS rev, least(1, run_length_p90 / 8.0) AS rs FROM b JOIN rl USING (parameter_name))""",
    """q AS (SELECT *, least(1, (1 - rank) * rev * (0.35 + 0.65 * rs)) AS rep, least(1, (0.4 + 0.6 * rank) * dir * (1 - 0.7 * rev)) AS dri, least(1, rev * (1 - 0.7 * rs) * (1 - 0.5 * dir)) AS cha FROM k)""",
    """a AS (SELECT *, CASE WHEN q90 < 1 AND rev < 0.55 AND rep < 0.25 AND run_length_p90 <= 120 THEN 'responsive_low_scale' WHEN q90 < 1 THEN 'repeatable_low_scale'
    WHEN q90 >= 5 AND q90 < 25 AND rank >= 0.85 THEN 'meso_drift' WHEN q90 >= 25 OR (q90 >= 5 AND flip <= 0.15 AND extrema <= 0.15) THEN 'strong_drift'
    WHEN flip >= 0.4 OR extrema >= 0.4 THEN 'chattery' ELSE 'smooth_midscale' END AS archetype FROM q)""",
)


@query(
    sql(
        """SELECT parameter_name, sample_count, round(q50, 6) AS delta_abs_q50, round(q75, 6) AS delta_abs_q75, round(q90, 6) AS delta_abs_q90, round(total, 6) AS total_abs_change, round(net, 6) AS net_change_abs, round(dir, 6) AS directionality,
  round(run_length_p90, 6) AS run_length_p90, round(rank, 6) AS delta_scale_rank, round(CASE WHEN q50 > 1e-6 THEN q90 / greatest(q50, 1e-6) ELSE 1 END, 6) AS motion_scale_ratio, round(flip, 6) AS sign_flip_rate, round(extrema, 6) AS local_extrema_rate,
  round(rep, 6) AS repeatability_score, round(dri, 6) AS drift_score, round(cha, 6) AS chatter_score, round(greatest(0, 1 - greatest(rep, dri, cha)), 6) AS smoothness_score, archetype AS recommended_archetype,
  CASE WHEN archetype IN ('responsive_low_scale', 'repeatable_low_scale') THEN 'raw' ELSE 'ema' END AS recommended_source,
  CASE WHEN archetype IN ('strong_drift', 'chattery') THEN 0.9::DOUBLE ELSE 0.75::DOUBLE END AS recommended_quantile,
  round(greatest(1e-6, q90 * CASE archetype WHEN 'responsive_low_scale' THEN 0.65 WHEN 'repeatable_low_scale' THEN 0.75 WHEN 'meso_drift' THEN 0.75 WHEN 'strong_drift' THEN 1.15 WHEN 'chattery' THEN 1.25 ELSE 1.0 END), 6) AS recommended_threshold FROM a""",
        *EVENT_PROFILE,
    )
)
def event_profile_recommendations(spark, sf_dir):
    return profiling.event_profile(numeric(spark, sf_dir), exact=True).drop("recommended_scale", "recommended_persistence", "recommended_reemit_ratio", "recommended_warmup")


CFG = ev.ContinuousConfig(alpha=0.35, slope_source="raw", slope_threshold=20.0)
FEATURES = (
    "t",
    """f0 AS (SELECT *, row_number() OVER v AS i, avg(x) OVER (PARTITION BY tail_id, flight_id, parameter_name ORDER BY ts, event_id ROWS 4 PRECEDING) AS sm, lag(x) OVER v AS px FROM t WHERE x IS NOT NULL WINDOW v AS (PARTITION BY tail_id, flight_id, parameter_name ORDER BY ts, event_id))""",
    """f1 AS (SELECT *, lag(sm) OVER v AS psm, x - px AS dr, x - lag(sm) OVER v AS residual FROM f0 WINDOW v AS (PARTITION BY tail_id, flight_id, parameter_name ORDER BY i))""",
    """f2 AS (SELECT *, greatest(sqrt(avg(coalesce(residual, 0) * coalesce(residual, 0)) OVER (PARTITION BY tail_id, flight_id, parameter_name ORDER BY i ROWS 4 PRECEDING)), 1e-3) AS sigma,
    CASE WHEN dr > 20 THEN 1 WHEN dr < -20 THEN -1 ELSE 0 END AS sg FROM f1)""",
)


def features(spark, sf_dir, cfg=CFG):
    return ev.continuous_features(numeric(spark, sf_dir), cfg, tie=("event_id",))


@query(sql("SELECT event_id, CAST(i AS INTEGER) AS sample_index, round(sm, 6) AS smoothed, round(residual, 6) AS residual, round(sigma, 6) AS sigma, CAST(sg AS INTEGER) AS slope_sign FROM f2", *FEATURES))
def moving_average_residual_sigma(spark, sf_dir):
    return features(spark, sf_dir).select("event_id", "sample_index", "smoothed", "residual", "sigma", "slope_sign")


@query(
    sql(
        "SELECT tail_id, flight_id, parameter_name, round(greatest(quantile_cont(abs(dr), 0.75) * 0.35, 1e-6), 6) AS slope_threshold FROM f1 GROUP BY ALL",
        *FEATURES[:3],
    )
)
def adaptive_slope_threshold(spark, sf_dir):
    return features(spark, sf_dir, ev.ContinuousConfig(threshold_mode="adaptive_run")).select(*FLIGHT, "slope_threshold").distinct()


@query(sql("SELECT event_id, round(residual, 6) AS residual FROM f2 WHERE i >= 4 AND (abs(residual) >= 3 * sigma OR abs(dr) >= 120)", *FEATURES))
def threshold_events(spark, sf_dir):
    return ev.threshold_events(features(spark, sf_dir), ev.ContinuousConfig(delta_threshold=120.0)).select("event_id", "residual")


RUNS = (
    *FEATURES,
    "g1 AS (SELECT *, lag(sg) OVER (PARTITION BY tail_id, flight_id, parameter_name ORDER BY i) AS psg FROM f2)",
    "g2 AS (SELECT *, sum(CASE WHEN psg IS NULL OR psg <> sg THEN 1 ELSE 0 END) OVER (PARTITION BY tail_id, flight_id, parameter_name ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM g1)",
    "g3 AS (SELECT *, row_number() OVER (PARTITION BY tail_id, flight_id, parameter_name, run ORDER BY i) AS len FROM g2)",
)


@query(sql("SELECT event_id, CAST(sg AS INTEGER) AS slope_sign FROM g3 WHERE sg <> 0 AND len = 2", *RUNS))
def slope_run_starts(spark, sf_dir):
    return ev.slope_run_starts(features(spark, sf_dir), CFG).select("event_id", "slope_sign")


FOLD = (
    *RUNS,
    "g4 AS (SELECT *, max(abs(dr)) OVER (PARTITION BY tail_id, flight_id, parameter_name, run ORDER BY i ROWS UNBOUNDED PRECEDING) AS peak FROM g3 WHERE sg <> 0)",
    # one row a sample of a run: the last emitted peak is carried on
    """fold AS (
  SELECT tail_id, flight_id, parameter_name, run, len, ts, sg, peak, CASE WHEN len >= 2 THEN peak END AS emitted, len >= 2 AS emits, 'run_start' AS emission FROM g4 WHERE len = 2
  UNION ALL
  SELECT g.tail_id, g.flight_id, g.parameter_name, g.run, g.len, g.ts, g.sg, g.peak, CASE WHEN g.peak >= f.emitted * 1.5 AND g.peak > f.emitted THEN g.peak ELSE f.emitted END, g.peak >= f.emitted * 1.5 AND g.peak > f.emitted, 'run_strengthen'
  FROM fold f JOIN g4 g ON g.tail_id = f.tail_id AND g.flight_id = f.flight_id AND g.parameter_name = f.parameter_name AND g.run = f.run AND g.len = f.len + 1)""",
)


@query(sql("SELECT tail_id, flight_id, parameter_name, ts AS timestamp_utc, CASE WHEN sg > 0 THEN 'slope_pos' ELSE 'slope_neg' END AS event_type_detected, emission, CAST(len AS INTEGER) AS run_length FROM fold WHERE emits", *FOLD).replace("WITH ", "WITH RECURSIVE ", 1))
def slope_run_events_full(spark, sf_dir):
    found = ev.slope_events(features(spark, sf_dir), CFG)
    return found.select(*FLIGHT, "timestamp_utc", "event_type_detected", F.element_at("payload", "emission").alias("emission"), F.element_at("payload", "run_length").cast("int").alias("run_length"))


OSC = (
    *FEATURES,
    "o1 AS (SELECT *, avg(x) OVER (PARTITION BY tail_id, flight_id, parameter_name ORDER BY i ROWS 4 PRECEDING) AS osc FROM f2)",
    "o2 AS (SELECT *, lag(osc) OVER v AS op, lead(osc) OVER v AS onx FROM o1 WINDOW v AS (PARTITION BY tail_id, flight_id, parameter_name ORDER BY i))",
    "o3 AS (SELECT *, CASE WHEN osc > op AND osc >= onx THEN 'peak' WHEN osc < op AND osc <= onx THEN 'trough' END AS extremum FROM o2)",
)


@query(sql("SELECT event_id, extremum FROM o3 WHERE extremum IS NOT NULL", *OSC))
def local_extrema(spark, sf_dir):
    return ev.oscillation_features(features(spark, sf_dir), CFG).where("extremum IS NOT NULL").select("event_id", "extremum")


@query(
    sql(
        "SELECT event_id, extrema, round(max(osc) OVER v - min(osc) OVER v, 6) AS amplitude, coalesce(i - prev_at, 0) AS spacing FROM o4 WINDOW v AS (PARTITION BY tail_id, flight_id, parameter_name ORDER BY i ROWS 39 PRECEDING) QUALIFY extremum IS NOT NULL",
        *OSC,
        """o4 AS (SELECT *, count(extremum) OVER (PARTITION BY tail_id, flight_id, parameter_name ORDER BY i ROWS 39 PRECEDING) AS extrema,
    last_value(CASE WHEN extremum IS NOT NULL THEN i END IGNORE NULLS) OVER (PARTITION BY tail_id, flight_id, parameter_name ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_at FROM o3)""",
    )
)
def oscillation_features(spark, sf_dir):
    return ev.oscillation_features(features(spark, sf_dir), CFG).where("extremum IS NOT NULL").select("event_id", "extrema", "amplitude", F.coalesce("spacing", F.lit(0)).cast("long").alias("spacing"))


STATES = (
    "c",
    "k1 AS (SELECT *, lag(state) OVER v AS before, row_number() OVER v AS n FROM c WINDOW v AS (PARTITION BY tail_id, flight_id, parameter_name ORDER BY ts, event_id))",
    "k2 AS (SELECT *, sum(CASE WHEN n = 1 OR before IS DISTINCT FROM state THEN 1 ELSE 0 END) OVER (PARTITION BY tail_id, flight_id, parameter_name ORDER BY n ROWS UNBOUNDED PRECEDING) AS run FROM k1)",
    "k3 AS (SELECT tail_id, flight_id, parameter_name, run, any_value(state) AS state, min(ts) AS since FROM k2 GROUP BY ALL)",
    "k4 AS (SELECT *, lag(state) OVER v AS from_state, (epoch_us(since) // 1000) - lag((epoch_us(since) // 1000)) OVER v AS dwell_ms FROM k3 WINDOW v AS (PARTITION BY tail_id, flight_id, parameter_name ORDER BY run))",
)


@query(sql("SELECT tail_id, flight_id, parameter_name, since AS timestamp_utc, from_state, state AS to_state, dwell_ms, CASE WHEN dwell_ms < 1000 THEN '<1s' WHEN dwell_ms < 5000 THEN '1-5s' WHEN dwell_ms < 30000 THEN '5-30s' ELSE '>=30s' END AS dwell_bucket FROM k4 WHERE state IS NOT NULL AND from_state IS NOT NULL", *STATES))
def categorical_transitions(spark, sf_dir):
    return ev.transitions(states(spark, sf_dir), tie=("event_id",))


@query(sql("SELECT tail_id, flight_id, parameter_name, ts AS timestamp_utc, CASE WHEN state IS NULL THEN 'dropped' ELSE 'state_enter' END AS event_type_detected, coalesce(state, before) AS state FROM k1 WHERE (state IS NULL) <> (before IS NULL)", *STATES[:2]))
def categorical_dropouts(spark, sf_dir):
    return ev.drop_outs(states(spark, sf_dir), tie=("event_id",))


@query(sql("SELECT tail_id, flight_id, parameter_name, since AS timestamp_utc, from_state, state AS to_state, dwell_ms FROM k4 WHERE state IS NOT NULL AND from_state IS NOT NULL", *STATES))
def state_fold_transitions(spark, sf_dir):
    found = ev.state_events(states(spark, sf_dir), ev.CategoricalConfig(emit_dropped=False), tie=("event_id",))
    get = lambda k: F.element_at("payload", k)
    return found.select(*FLIGHT, "timestamp_utc", get("from").alias("from_state"), get("to").alias("to_state"), get("dwell_ms").cast("long").alias("dwell_ms"))


@query()
def dwell_guard_events(spark, sf_dir):
    cfg = ev.CategoricalConfig(emit_enter=True, emit_exit=True, emit_dwell_bucket=True, dwell_guard_ms=600_000, min_dwell_ms=60_000, illegal=(("view", "error"),))
    return ev.state_events(states(spark, sf_dir), cfg, tie=("event_id",)).drop("payload")


@query()
def detected_event_stream(spark, sf_dir):
    kinds = profile(spark, sf_dir).select("parameter_name", "parameter_datatype")
    return ev.detect(both(spark, sf_dir), kinds, CFG).select("tail_id", "flight_id", "event_seq_id", "timestamp_utc", "parameter_name", "event_type_detected", exprs.sorted_map_json("payload").alias("payload_json"))


@query(sql("SELECT tail_id, flight_id, event_id, event_seq_id FROM e", "e"))
def event_sequence_ids(spark, sf_dir):
    return adapters.detected_events(spark, sf_dir).select("tail_id", "flight_id", "event_id", "event_seq_id")


@query(
    sql(
        "SELECT parameter_name, round(any_value(m), 6) AS x_median, round(quantile_cont(abs(x - m), 0.5), 6) AS x_mad FROM k GROUP BY ALL",
        "t",
        "k AS (SELECT parameter_name, x, quantile_cont(x, 0.5) OVER (PARTITION BY parameter_name) AS m FROM t WHERE x IS NOT NULL)",
    )
)
def median_and_mad(spark, sf_dir):
    return median_mad(ev.numbers(numeric(spark, sf_dir)).withColumnRenamed("val", "x"), ["parameter_name"], ["x"])


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 150000 THEN 0 ELSE round(o_totalprice, 2) END AS amount FROM orders UNION ALL SELECT -o_orderkey, 1 FROM orders WHERE o_totalprice < 20000")
def upsert_attribution(spark, sf_dir):
    """Large orders are replaced, small ones bring a second row under a new key."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.round("o_totalprice", 2).alias("amount"), "o_totalprice")
    old = orders.select("o_orderkey", "amount")
    changed = orders.where("o_totalprice > 150000").select("o_orderkey", F.lit(0.0).alias("amount"))
    added = orders.where("o_totalprice < 20000").select((-F.col("o_orderkey")).alias("o_orderkey"), F.lit(1.0).alias("amount"))
    return tables.upserted(old, changed.unionByName(added), ["o_orderkey"])
