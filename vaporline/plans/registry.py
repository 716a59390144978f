"""Named queries and the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, TimestampType

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6


def query(sql: str | None = None, name: str | None = None):
    """Register a query; its doubles are rounded so that the order of addition of
    either engine doesn't show, and timestamps lose their zone as SQL's have none."""

    def put(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return comparable(f(spark, sf_dir))

        run.__doc__ = f.__doc__
        key = name or f.__name__
        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = sql
        return f

    return put


def comparable(df: DataFrame) -> DataFrame:
    changed = {}
    for field in df.schema:
        if isinstance(field.dataType, DoubleType):
            changed[field.name] = F.round(field.name, DIGITS) + F.lit(0.0)
        elif isinstance(field.dataType, TimestampType):
            changed[field.name] = F.col(field.name).cast("timestamp_ntz")
    return df.withColumns(changed) if changed else df


#: The adapters of ``vaporline.sources.adapters`` in SQL.
COMMON = {
    "t": """t AS (
  SELECT 'T' || (user_id % 2) AS tail_id, 'F' || strftime(date_trunc('week', ts), '%Y%m%d') AS flight_id, ts, (epoch_us(ts) // 1000) AS ms,
    event_type AS parameter_name, event_id, (event_id % 97 = 0 OR event_id % 89 = 0) AS missing,
    CASE WHEN event_id % 97 = 0 OR event_id % 89 = 0 THEN NULL ELSE value END AS x
  FROM events)""",
    "c": """c AS (
  SELECT 'T' || (user_id % 2) AS tail_id, 'F' || strftime(date_trunc('week', ts), '%Y%m%d') AS flight_id, ts, (epoch_us(ts) // 1000) AS ms,
    'STATE_' || (user_id % 4) AS parameter_name, event_id, CASE WHEN event_id % 61 = 0 THEN NULL ELSE event_type END AS state
  FROM events)""",
    "e": """e AS (
  SELECT 'T' || (user_id % 2) AS tail_id, 'F' || strftime(date_trunc('week', ts), '%Y%m%d') AS flight_id, ts, (epoch_us(ts) // 1000) AS ms,
    event_type AS parameter_name, 'kind_' || (user_id % 3) AS event_type_detected, value, event_id,
    row_number() OVER (PARTITION BY 'T' || (user_id % 2), date_trunc('week', ts) ORDER BY ts, event_id) AS event_seq_id
  FROM events)""",
    "w": """w AS (
  SELECT DISTINCT tail_id, flight_id, CAST(floor(ms / 3600000) AS BIGINT) AS win_id,
    CAST(floor(ms / 3600000) AS BIGINT) * 3600000 AS start_ms, (CAST(floor(ms / 3600000) AS BIGINT) + 1) * 3600000 AS end_ms
  FROM e)""",
    "s": """s AS (
  SELECT parameter_name, count(*) AS support_count, quantile_cont(x, 0.25) AS scaling_q25, quantile_cont(x, 0.5) AS scaling_center,
    quantile_cont(x, 0.75) AS scaling_q75, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS scaling_iqr
  FROM t WHERE x IS NOT NULL GROUP BY ALL)""",
    "y": """held AS (
  SELECT w.tail_id, w.flight_id, w.win_id, w.end_ms, t.parameter_name, arg_max(CASE WHEN t.missing THEN NULL ELSE t.x END, t.ms * 1000000 + t.event_id) AS dummy,
    arg_max(struct_pack(x := t.x), t.ms * 1000000 + t.event_id).x AS x
  FROM w JOIN t ON w.tail_id = t.tail_id AND w.flight_id = t.flight_id AND t.ms <= w.end_ms GROUP BY ALL),
y AS (
  SELECT tail_id, flight_id, win_id, end_ms, parameter_name, x, (x - scaling_center) / greatest(scaling_iqr, 1e-6) AS z
  FROM held JOIN s USING (parameter_name) WHERE x IS NOT NULL)""",
    "ew": """ew AS (
  SELECT e.*, w.win_id, w.start_ms, w.end_ms FROM e JOIN w ON e.tail_id = w.tail_id AND e.flight_id = w.flight_id AND e.ms BETWEEN w.start_ms AND w.end_ms)""",
    "h": """h AS (
  SELECT * FROM (VALUES ('click', 'MOD_A', 'SUB_1', 'SYS'), ('view', 'MOD_A', 'SUB_1', 'SYS'), ('purchase', 'MOD_B', 'SUB_1', 'SYS'), ('signup', 'MOD_C', 'SUB_2', 'SYS'), ('error', 'MOD_C', 'SUB_2', 'SYS')) AS v(parameter_name, module_id, subsystem_id, system_id))""",
}


def sql(select: str, *parts: str) -> str:
    """A SELECT behind the named adapters; a part with a parenthesis is one itself."""
    return "WITH " + ",\n".join(COMMON.get(p, p) for p in parts) + "\n" + select


def union(frames: Iterable[DataFrame]) -> DataFrame:
    first, *rest = frames
    for f in rest:
        first = first.unionByName(f)
    return first
