"""Reading, writing and merging artifacts, their schemas and manifests."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def as_schema(schema: StructType | str) -> StructType:
    return schema if isinstance(schema, StructType) else StructType.fromDDL(schema)


def assert_schema(df: DataFrame, schema: StructType | str) -> DataFrame:
    """Names and types must be those of the schema; order and nullability are free."""
    want = {f.name: f.dataType.simpleString() for f in as_schema(schema)}
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    if want != have:
        raise ValueError(f"schema differs: lacks {sorted(set(want.items()) - set(have.items()))}, has besides {sorted(set(have.items()) - set(want.items()))}")
    return df


def schema_hash(df: DataFrame) -> str:
    fields = sorted((f.name, f.dataType.simpleString()) for f in df.schema)
    return hashlib.sha256(json.dumps(fields).encode()).hexdigest()


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).load(path)


def write_table(df: DataFrame, path: str, mode: str = "append", fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Write; an empty partitioned result still leaves a readable schema."""
    if partition_by and not df.isEmpty():
        df.write.format(fmt).mode(mode).partitionBy(*partition_by).save(path)
    else:
        (df.coalesce(1) if partition_by else df).write.format(fmt).mode(mode).save(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def upserted(target: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Target rows that no update has the keys of (nulls equal), and all updates."""
    if not keys:
        raise ValueError("an upsert needs keys")
    fresh = updates.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return target.join(fresh, same, "left_anti").unionByName(updates)


def upsert_table(df: DataFrame, path: str, keys: Sequence[str], fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Create the table or merge into it by keys.

    Plain files have no MERGE, so the merged table is written beside the old one and
    takes its place by rename; until then readers see the old one, and a run that fails
    before leaves it untouched.
    """
    spark = df.sparkSession
    if not path_exists(spark, path):
        write_table(df, path, "errorifexists", fmt, partition_by)
        return
    beside, old = f"{path.rstrip('/')}__new_{uuid.uuid4().hex}", f"{path.rstrip('/')}__old_{uuid.uuid4().hex}"
    write_table(upserted(read_table(spark, path, fmt), df, keys), beside, "errorifexists", fmt, partition_by)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not (fs.rename(hadoop(path), hadoop(old)) and fs.rename(hadoop(beside), hadoop(path))):
        raise OSError(f"{path}: the merged table couldn't take its place; it is {beside}, the old one {old}")
    fs.delete(hadoop(old), True)


@dataclass(frozen=True)
class Artifact:
    """A persisted relation: where it is, how it is stored, what it must look like."""

    path: str
    schema: StructType | str | None = None
    fmt: str = "parquet"
    partition_by: tuple[str, ...] = ()
    replayable_from: tuple[str, ...] = field(default=())

    def read(self, spark: SparkSession) -> DataFrame:
        df = read_table(spark, self.path, self.fmt)
        return assert_schema(df, self.schema) if self.schema is not None else df

    def write(self, df: DataFrame, mode: str = "append") -> None:
        write_table(assert_schema(df, self.schema) if self.schema is not None else df, self.path, mode, self.fmt, self.partition_by)

    def replace(self, df: DataFrame) -> None:
        self.write(df, "overwrite")

    def upsert(self, df: DataFrame, keys: Sequence[str]) -> None:
        upsert_table(assert_schema(df, self.schema) if self.schema is not None else df, self.path, keys, self.fmt, self.partition_by)

    def manifest(self, spark: SparkSession) -> dict:
        df = self.read(spark)
        return {"path": self.path, "format": self.fmt, "schema_hash": schema_hash(df), "rows": df.count(), "version": 1, "replayable_from": list(self.replayable_from)}
