"""Exact deduplication against a persistent digest index.

The index is a Parquet table of one row a digest, bucketed and sorted by the
digest. New data is reduced to one row a digest (partial aggregation before the
shuffle, so a group of copies of any size is one row a task), the digests that
the index lacks are found by a sort-merge anti join, and those are appended.

Everything is DataFrame or SQL code.

Defined results: a null text counts as empty; texts are equal when equal after
each run of white space is replaced by one space; of equal texts the smallest
non-null id stays, null ids come last; of repeated rows (same id and text) one
stays; an empty table gives an empty result and leaves the index as it is; extra
columns are neither read nor returned by ``classes`` and are kept by ``kept_rows``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vaporline.llm.common import SPACE, fresh, join_counted, settle, text_of

#: Buckets of the index; fixed when it is made. 100 TB of web text is some 3e10
#: documents and 2.5 TB of index; the default suits some 1e9, pass more for more.
BUCKETS = 64
#: Repeats of one row that are spread out by one array.
REPEATS_AT_ONCE = 4096


def digest(text: Column) -> Column:
    """Lowercase hex of the SHA-256 of the normalised text in UTF-8."""
    return F.sha2(F.regexp_replace(text, SPACE, " ").cast("binary"), 256)


class DigestIndex:
    """A persistent, bucketed and sorted table (text_sha256, keep_id)."""

    def __init__(self, spark: SparkSession, name: str, buckets: int = BUCKETS, location: str | None = None):
        """Open the table ``name``, or make it. With ``location`` its files are
        there, and an index that another session left at that place is opened."""
        self.spark, self.name, self.buckets = spark, name, buckets
        if not spark.catalog.tableExists(name):
            where = f"LOCATION '{location}'" if location else ""
            spark.sql(f"CREATE TABLE {name} (text_sha256 STRING, keep_id BIGINT) USING parquet CLUSTERED BY (text_sha256) SORTED BY (text_sha256) INTO {buckets} BUCKETS {where}")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def lacking(self, digests: DataFrame) -> DataFrame:
        """The rows of ``digests`` whose text_sha256 the index doesn't have."""
        return digests.join(self.table().select("text_sha256").hint("merge"), "text_sha256", "left_anti")

    def drop(self) -> None:
        """Remove the table. What ``classes`` and ``kept_rows`` returned doesn't read it."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def add(self, digests: DataFrame) -> None:
        """Append rows (text_sha256, keep_id) that the index lacks.

        The rows are laid out by the index's own hash before the write, so that
        each bucket gets one file an append. A failed append leaves no committed
        files; run again it finds the same digests lacking.
        """
        new = self.lacking(digests).select("text_sha256", "keep_id").repartition(self.buckets, "text_sha256")
        new.write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)


def batch_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text_sha256, doc_id) for each row."""
    return docs.select(digest(text_of(text_col)).alias("text_sha256"), F.col(id_col).cast("long").alias("doc_id"))


def classes(docs: DataFrame, index: DigestIndex, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deduplicate a batch against the index, append what is new, and return one
    row a document: doc_id, keep_id, group_size, kept, text_sha256.

    keep_id is the id that the index holds for the text, so in a first batch it
    is the batch's smallest; group_size counts the batch's rows with that text.
    A row of a later batch whose text the index already held is not kept, unless
    it has the very id that the index holds (the batch was given before).

    Rows are counted by (digest, id) first, which leaves nothing to do for
    repeated rows and is settled, so that each text is hashed once; each count is spread out again at the end, the first one kept. Large
    groups, of which there are few, come by broadcast, so none is one task's.
    """
    by_id = settle(batch_digests(docs, id_col, text_col).groupBy("text_sha256", "doc_id").agg(F.count(F.lit(1)).alias("__n")))
    groups = by_id.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.sum("__n").alias("group_size"))
    index.add(groups)
    known = index.table().hint("merge")
    sizes = settle(groups.select("text_sha256", "group_size").join(known, "text_sha256"))
    rows = join_counted(by_id, sizes, "text_sha256", "group_size", by_id.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0])
    # Spread out in two steps, so that no array has more than REPEATS_AT_ONCE elements
    # for each REPEATS_AT_ONCE squared repeats.
    last = (F.col("__n") - 1).cast("long")
    rows = rows.withColumn("__from", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(REPEATS_AT_ONCE).cast("long"))))
    rows = rows.withColumn("__i", F.explode(F.sequence(F.col("__from"), F.least(F.col("__from") + REPEATS_AT_ONCE - 1, last))))
    return rows.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("__i") == 0)).alias("kept"), "text_sha256")


def kept_rows(docs: DataFrame, index: DigestIndex, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of a batch whose text the index lacked, one of each text, with
    every column; their digests are appended.

    Of rows with the same id and text an arbitrary one stays if their other
    columns differ. The rows are settled before their digests are appended: after a
    crash in between, the batch given again returns the same rows again.
    """
    digests = batch_digests(docs, id_col, text_col).groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"))
    sha, found, least = fresh(docs, "sha_of_text", "sha_of_new", "least_id")
    new = index.lacking(digests).select(F.col("text_sha256").alias(found), F.col("keep_id").alias(least))
    held = docs.withColumn(sha, digest(text_of(text_col)))
    won = held.join(new, (F.col(sha) == F.col(found)) & F.col(id_col).cast("long").eqNullSafe(F.col(least))).dropDuplicates([sha]).select(*docs.columns)
    won = settle(won)
    index.add(digests)
    return won


def scratch_index(spark: SparkSession, buckets: int = BUCKETS) -> DigestIndex:
    """A new, empty index in the warehouse, under a name of its own."""
    return DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}", buckets)
