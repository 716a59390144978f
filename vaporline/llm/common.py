"""What the operators of this subpackage share: cluster plumbing and text rules."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every contract here: space and the five ASCII controls TAB to CR.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


#: Rows that a Python worker gets at once: texts are long and some very long.
ROWS_AT_ONCE = 1000


def ready(spark: SparkSession) -> None:
    """Let Python workers import this package when it isn't installed on them, and
    bound the rows that they hold at once (a setting of the session)."""
    most = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(most)) <= ROWS_AT_ONCE:
        spark.conf.set(most, str(ROWS_AT_ONCE))
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def free_memory() -> None:
    """A Python worker's end of a task: what it no longer uses goes back to the system,
    as the worker stays and its executor's memory is for other tasks, too."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session without that setting and without a checkpoint folder of its
    own (a test) gets a temporary one; on a cluster that is an error, as executors
    don't share such a folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="vaporline-checkpoints-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Write a reliable checkpoint in the shared folder and read on from it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """For each name one that no column of ``df`` has, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: A key is heavy if it has at least this fraction of all rows; so no more than
#: HEAVY_KEYS keys are, whatever the size of the data.
HEAVY_KEYS = 2000


def join_counted(left: DataFrame, right: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join where ``right`` has one row a key with ``count``, the number of
    rows that ``left`` has of it, and ``total`` is the sum of these.

    Heavy keys, of which there are HEAVY_KEYS at most, are broadcast, so that no
    task gets all rows of one; the rest is joined by shuffle.
    """
    is_heavy = F.col(count) * HEAVY_KEYS >= F.lit(total)
    heavy = F.broadcast(right.where(is_heavy))
    light = left.join(heavy.select(key), key, "left_anti").join(right.where(~is_heavy), key)
    return left.join(heavy, key).unionByName(light)
