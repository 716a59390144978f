"""Joins and selections that Spark has no single operator for.

All of them are compositions of equi joins, windows and aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaporline.functions.exprs import col


def range_join(points: DataFrame, intervals: DataFrame, keys: Sequence[str], point: str, start: str, end: str, bucket: int, how: str = "inner") -> DataFrame:
    """Rows of ``points`` with the intervals that hold them, both ends included.

    An interval goes to every bucket of ``bucket`` units that it touches and a point to
    one, so the join has an equality to shuffle by and compares only what is near. The
    bucket should be about as long as an interval: shorter copies intervals more often,
    longer compares more. Columns other than the keys must differ between the sides.
    """
    cell = F.floor(F.col(point) / F.lit(bucket)).cast("long")
    cells = F.explode(F.sequence(F.floor(F.col(start) / F.lit(bucket)).cast("long"), F.floor(F.col(end) / F.lit(bucket)).cast("long")))
    left = points.withColumn("__cell", cell)
    right = intervals.where(F.col(start) <= F.col(end)).withColumn("__cell", cells)
    for k in keys:
        right = right.withColumnRenamed(k, f"__{k}")
    on = (left["__cell"] == right["__cell"]) & (F.col(point) >= F.col(start)) & (F.col(point) <= F.col(end))
    for k in keys:
        on = on & (left[k] == right[f"__{k}"])
    joined = left.join(right, on, how)
    return joined.drop(left["__cell"]).drop(right["__cell"]).drop(*[f"__{k}" for k in keys])


def as_of(anchors: DataFrame, samples: DataFrame, keys: Sequence[str], anchor_time: str, sample_time: str, values: Sequence[str], tie: str | None = None) -> DataFrame:
    """Each anchor with the values of the last sample at or before it (null if none).

    Both sides are laid in one order and the last sample is carried along it: one
    shuffle by the keys and one sort, whatever the gaps are.
    """
    packed = F.struct(*[F.col(v) for v in values])
    kept = [c for c in anchors.columns if c not in keys]
    a = anchors.select(*keys, F.col(anchor_time).alias("__t"), F.lit(1).alias("__side"), F.lit(0).cast("long").alias("__tie"), F.struct(*kept).alias("__anchor"), F.lit(None).cast(samples.select(packed.alias("p")).schema["p"].dataType).alias("__sample"))
    s = samples.select(*keys, F.col(sample_time).alias("__t"), F.lit(0).alias("__side"), (F.col(tie) if tie else F.lit(0)).cast("long").alias("__tie"), F.lit(None).cast(anchors.select(F.struct(*kept).alias("p")).schema["p"].dataType).alias("__anchor"), packed.alias("__sample"))
    order = Window.partitionBy(*keys).orderBy("__t", "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    carried = a.unionByName(s).withColumn("__last", F.last("__sample", ignorenulls=True).over(order)).where("__side = 1")
    return carried.select(*keys, *[F.col("__anchor")[c].alias(c) for c in kept], *[F.col("__last")[v].alias(v) for v in values])


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key, with their rank from 1."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row of each key: the best match."""
    return top_k(df, keys, order, 1, "__rank").drop("__rank")


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], starts: Column, name: str = "island") -> DataFrame:
    """Number the runs of rows: a run begins where ``starts`` holds."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(w))


def median_mad(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Median and median absolute deviation of columns for each key, both exact."""
    centers = df.groupBy(*keys).agg(*[F.percentile(c, 0.5).alias(f"{c}_median") for c in columns])
    off = df.join(centers, list(keys)).select(*keys, *[F.abs(F.col(c) - F.col(f"{c}_median")).alias(c) for c in columns])
    return centers.join(off.groupBy(*keys).agg(*[F.percentile(c, 0.5).alias(f"{c}_mad") for c in columns]), list(keys))


def top_k_either_end(edges: DataFrame, u: str, v: str, order: Sequence[Column], k: int) -> DataFrame:
    """Undirected edges that are among the k first of at least one of their ends."""
    ends = edges.withColumn("__end", F.explode(F.array(u, v)))
    kept = top_k(ends, ["__end"], order, k, "__rank").select(u, v).distinct()
    return edges.join(kept, [u, v], "left_semi")


def mutual_top_k(edges: DataFrame, u: str, v: str, order: Sequence[Column], k: int) -> DataFrame:
    """Undirected edges that are among the k first of both their ends."""
    ends = edges.withColumn("__end", F.explode(F.array(u, v)))
    ranked = top_k(ends, ["__end"], order, k, "__rank")
    both = ranked.groupBy(u, v).agg(F.count(F.lit(1)).alias("__n")).where("__n = 2").select(u, v)
    return edges.join(both, [u, v], "left_semi")


def map_of(key: Column | str, value: Column | str) -> Column:
    """Aggregate to a map in key order; keys must be unique in a group."""
    return F.map_from_entries(F.array_sort(F.collect_list(F.struct(col(key).alias("key"), col(value).alias("value")))))


def jaccard(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: shared, all and their ratio for two sets of keys."""
    a, b = left.select(*keys).distinct().withColumn("__a", F.lit(1)), right.select(*keys).distinct().withColumn("__b", F.lit(1))
    both = a.join(b, list(keys), "full_outer")
    return both.agg(F.count_if(F.col("__a").isNotNull() & F.col("__b").isNotNull()).alias("shared"), F.count(F.lit(1)).alias("total")).withColumn("jaccard", F.coalesce(F.try_divide("shared", "total"), F.lit(0.0)))
